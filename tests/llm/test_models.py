import math
import random
import zlib

import numpy as np
import pytest

from docloom.llm import ann, html_extract, langid, language_model
from tests.llm.fixtures import SCHEMA, corpus, words


def test_language_is_recognised(spark):
    rng = random.Random(3)
    made = {"aa": "ba ni ko lu".split(), "bb": "str ung ich keit".split()}
    rows = [(i, " ".join("".join(rng.choice(made[lang]) for _ in range(3)) for _ in range(40)), lang) for i in range(200) for lang in [rng.choice(["aa", "bb"])]]
    rows += [(900, None, "aa"), (901, "", None), (902, "12 3!", "bb"), (903, "Ünïcode", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.language_of(docs).collect()}
    assert all(got[i].lang_pred == lang and 0.5 < got[i].score <= 1 for i, _, lang in rows[:200])
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert {r.doc_id for r in langid.recognised(docs, langid.training_sample(docs)).collect()} == {*range(200), 903}
    empty = docs.limit(0)
    assert langid.language_of(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def greedy(text, known):
    phrases, k = 0, 0
    while k < len(text):
        n = 1
        while k + n <= len(text) and any(text[k : k + n] in t for t in known):
            n += 1
        k += max(1, n - 1)
        phrases += 1
    return phrases


def test_automaton_parses_into_longest_matches():
    rng = random.Random(8)
    known = ["".join(rng.choice("abc") for _ in range(60)) for _ in range(3)]
    codes = {"a": 1, "b": 2, "c": 3, "d": 4}
    encode = lambda s: np.array([codes[c] for c in s], np.int64)
    model = langid.Automaton([encode(t) for t in known], 5)
    queries = sorted(("".join(rng.choice("abccd") for _ in range(rng.randint(1, 50))) for _ in range(40)), key=len, reverse=True)
    lengths = np.array([len(q) for q in queries])
    lanes = np.zeros((lengths[0], len(queries)), np.int64)
    for i, q in enumerate(queries):
        lanes[: len(q), i] = encode(q)
    assert model.phrases(lanes, lengths).tolist() == [greedy(q, known) for q in queries]


def brute_nearest(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, q in ok:
        if i % every == 0:
            scored = sorted((-float(q @ v / np.sqrt((q @ q) * (v @ v))), j) for j, v in ok if j != i)
            out[i] = scored[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    vectors = [(i, (centres[i % 6] + 0.4 * rng.normal(size=16)).tolist()) for i in range(600)]
    same = vectors[0][1]
    vectors += [(1000 + i, same) for i in range(40)] + [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] + [1.0] * 15), (2150, [None] + [1.0] * 15), (2200, [1.0, 2.0])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(table, k=5, query_every=50).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    want = brute_nearest([v for v in vectors if v[0] != 2200], 5, 50)
    assert got.keys() == want.keys()
    hits = sum(len({j for _, j in want[q]} & {v for v, _ in got[q].values()}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    assert [got[1000][r][0] for r in range(1, 6)] == [0, 1001, 1002, 1003, 1004]  # ties go to the smaller id
    exact = dict(vectors)
    for q, found in got.items():
        a = np.array(exact[q])
        for v, score in found.values():
            b = np.array(exact[v])
            assert v != q and score == pytest.approx(float(a @ b / np.sqrt((a @ a) * (b @ b))), abs=1e-12)
    assert ann.nearest(table.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in ann.nearest(few).collect()] == [(0, 1)]


def test_scores(spark):
    rows = [r[:2] for r in corpus()]
    docs = spark.createDataFrame(corpus(), SCHEMA)
    tokens = {i: [*words(t, lower=True), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts, pairs = {}, {}
    for i, ts in tokens.items():
        for before, t in zip(["<", *ts], ts, strict=False) if not held[i] else ():
            counts[t] = counts.get(t, 0) + 1
            pairs[before, t] = pairs.get((before, t), 0) + 1
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in language_model.score_documents(docs, chunk_bytes=4000).collect()}
    assert got.keys() == tokens.keys()
    for i, ts in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ts), sum(t in counts for t in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(t, 0) + 1) / (n + v + 1)) for t in ts))
    one = {r.doc_id: r.score for r in language_model.score_documents(docs, chunk_bytes=1 << 30).collect()}
    assert one == pytest.approx({i: r.score for i, r in got.items()})  # however the documents are dealt
    assert language_model.score_documents(docs.limit(0)).count() == 0


def test_mixture_follows_the_held_out_counts():
    c = language_model
    cell = lambda bucket, p2, p1: (bucket * c.CLASSES + p2) * c.CLASSES + p1
    zero = c.CLASSES - 1
    sure, unsure = cell(5, 1, 20), cell(2, zero, 10)
    weights = c.fit_weights(np.array([sure, unsure]), np.array([100, 100]), types=1000)
    assert weights[5, 0] > 0.95 and weights[2, 1] > 0.95 and np.allclose(weights.sum(axis=1), 1)


PAGE = """<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">Accept</div>
<div id=main><div class="post p7"><h1>Title &amp; more</h1><p>First <b>bold<br>line<p>Second&nbsp;one &#8212; &eacute;<form><input><p>Subscribe</form></div><div class="comments"><p>{reader}</p></div></div><footer>&copy; x</footer></body>"""


def test_main_text(spark):
    pages = [(i, f"https://A.example.com:80/{i}", PAGE.format(reader="nice " * (300 if i == 3 else 5))) for i in range(8)]
    pages += [(20, None, None), (21, "bad url", ""), (22, "http://b.org/", "just text &lt;here&gt;"), (23, "http://a.example.com/x", "<body><div><p>other layout</div></body>"), (24, "http://b.org/2", "<p>a<p>b</p><![CDATA[c]]><!-- no -->")]
    got = {r.page_id: r for r in html_extract.main_text(spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, path string")).collect()}
    want = "Title & more\nFirst bold line\nSecond one — é"
    assert [got[i].text for i in range(8)] == [want] * 8 and got[0].n_chars == len(want)
    assert got[20].text == got[21].text == "" and got[22].text == "just text <here>" and got[23].text == "other layout" and got[24].text == "a\nb\nc"


def test_votes_decide_for_a_host(spark):
    page = '<body><div class="a1"><p>{}</p></div><div class="b"><p>{}</p></div></body>'
    rows = [(i, "http://h/", page.format("x " * 50, "y")) for i in range(5)] + [(9, "http://h/", page.format("x", "y " * 50))]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [tuple(r) for r in html_extract.host_paths(table).collect()] == [("h", "/body/div.a#")]
    assert {r.page_id: r.text for r in html_extract.main_text(table).collect()}[9] == "x"
