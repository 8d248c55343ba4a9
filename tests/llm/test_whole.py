"""Cases in which an operator would once have done less than the whole job."""

import math
import random
import time
import tracemalloc

import numpy as np
import pytest

from docloom.llm import ann, html_extract, langid, packing
from tests.llm.test_models import greedy


def made_languages(rng):
    """Three scripts whose letters together are more than 96, and one of many signs."""
    scripts = {"lat": "abcdefghijklmnopqrstuvwxyzäöüßéèñçå", "ell": "αβγδεζηθικλμνξοπρστυφχψωάέήίόύώ", "cyr": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "signs": "".join(map(chr, range(0x4E00, 0x4E00 + 1500))), "kana": "".join(map(chr, range(0x3042, 0x3042 + 70)))}
    made = {}
    for lang, letters in scripts.items():
        words = ["".join(rng.choice(letters) for _ in range(3)) for _ in range(800)]
        # rarer languages have less text
        made[lang] = [" ".join(rng.choice(words) for _ in range(60 if lang == "lat" else 15)) for _ in range(60)]
    return made


@pytest.mark.parametrize("cells", [langid.DENSE_CELLS, 0])
def test_letters_of_every_script_count(cells):
    made = made_languages(random.Random(5))
    model = langid.Identifier({k: v[:40] for k, v in made.items()}, dense_cells=cells)
    for lang, rows in made.items():
        assert model.predict(rows[40:])[0] == [lang] * 20


def test_sparse_automaton_equals_dense():
    rng = np.random.default_rng(6)
    texts = [rng.integers(1, 5, 300) for _ in range(3)]
    dense, sparse = langid.Automaton(texts, 6), langid.Automaton(texts, 6, dense_cells=0)
    lanes, lengths = rng.integers(0, 6, (40, 50)), np.sort(rng.integers(1, 41, 50))[::-1]
    assert dense.table is not None and sparse.table is None
    assert dense.phrases(lanes, lengths).tolist() == sparse.phrases(lanes, lengths).tolist()


LONG, SHORT = "text of the article " * 40, "another passage " * 30
LAYOUTS = {
    "lead": ("<article><h1>Title</h1><p>Lead of the story</p><div class=content><p>{long}</p></div></article>", ["Title", "Lead of the story", LONG]),
    "deep": ("<main><h1>Title</h1><div class=x><div class=y><p>{long}</p></div></div></main>", ["Title", LONG]),
    "split": ("<article><section class=one><p>{long}</p></section><section class=two><p>{short}</p></section></article>", [LONG, SHORT]),
    "plain": ("<div class=post><h1>Title</h1><p>Lead</p><div class=content><p>{long}</p></div></div>", ["Title", "Lead", LONG]),
    "comments": ("<article><h1>Title</h1><div class=content><p>{long}</p></div><div class=comments><p>{short}</p></div></article>", ["Title", LONG]),
    "wrapped": ("<div class=page><div class=links><a href=\"/x\">" + "elsewhere " * 9 + "</a></div><div class=content><p>{long}</p></div></div>", [LONG]),
}


def test_whole_article_is_taken(spark):
    rows = [(k, f"http://{name}/", "<body><nav>Menu</nav>" + page.format(long=LONG, short=SHORT) + "<footer>End</footer></body>") for name, (page, _) in LAYOUTS.items() for k in range(3)]
    got = html_extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text == "\n".join(" ".join(x.split()) for x in LAYOUTS[r.url[7:-1]][1]), r.url


def exact(rows, k, every):
    """Neighbours by brute force, each vector among those of its length."""
    rows = [(i, np.array(v, float)) for i, v in rows]
    out = {}
    for i, q in rows:
        if i % every == 0:
            near = sorted((-float((q * v).sum() / np.sqrt((q * q).sum() * (v * v).sum())), j) for j, v in rows if j != i and len(v) == len(q))
            out[i] = [j for _, j in near[:k]]
    return out


def found(spark, rows, **options):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {}
    for r in sorted(ann.nearest(table, **options).collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_ties_of_collinear_vectors_go_to_smaller_ids(spark):
    base = np.random.default_rng(1).normal(size=16)
    rows = [(i, (base * 2.0 ** (i % 37 - 18)).tolist()) for i in range(400)]
    assert found(spark, rows) == exact(rows, 5, 50)


def test_lengths_few_rows_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8 if i % 3 else 5).tolist()) for i in range(12)] + [(50, [1e300] * 3), (51, [1e300, 1e300, 0.0]), (100, [1.0])]
    want = {q: js for q, js in exact(rows, 5, 50).items() if js}
    got = found(spark, rows, query_every=50)
    assert got == want and got[50] == [51]
    rows = [(0, [1.0, 0.0]), (7, [1.0, 0.1]), (7, [0.0, 1.0]), (7, [0.0, 1.0]), (9, [1.0, 1.0]), (0, [1.0, 0.0])]
    assert found(spark, rows) == {0: [7, 9]}


@pytest.mark.parametrize("hashes", [1, 2])
def test_recall_at_each_number_of_hashes(spark, hashes):
    rng = np.random.default_rng(hashes)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(1500, 16)).tolist())]
    got, want = found(spark, rows, plan=lambda n, d: (*ann.PLANS[hashes], hashes)), exact(rows, 5, 50)
    assert got.keys() == want.keys() and sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_cells_grow_with_the_vectors():
    assert [ann.layout(n, 64)[2] for n in (500, 4000, 4100, 500_000, 530_000, 10**12)] == [1, 1, 2, 2, 3, 3]


def test_three_hashes_take_bounded_memory_and_two_copies(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4096, 64))
    tables, share, hashes = ann.layout(615_384, 64)
    assert (tables, hashes) == (2, 3) and all(plan[0] <= 2 for plan in ann.PLANS.values())
    turns = ann.Rotations(64, tables, hashes)
    tracemalloc.start()
    unit = ann._unit(x)
    reach = np.concatenate([turns.reach(turns.losses(unit[i : i + 256], 0), share) for i in range(0, len(x), 256)])
    cell = turns.cells(unit, 0)
    found = list(ann.best_in_cells(turns, 0, x[:512], reach[:512], x, cell, np.arange(len(x)), 6))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    near = unit[:512] @ unit.T
    row, col, score = (np.concatenate(part) for part in zip(*found, strict=True))
    assert np.allclose(score, near[row, col], atol=1e-12) and (np.bincount(row, minlength=512) == 6).all()
    cost = sum(loss[:, axis] for loss, axis in zip(turns.losses(unit[:512], 0), turns.axes(cell), strict=True))
    for i in range(512):  # nothing within reach is nearer than what is found
        mine = set(col[row == i].tolist())
        rest = [j for j in np.flatnonzero(cost[i] <= reach[i]).tolist() if j not in mine]
        assert max(near[i, rest], default=-1) <= score[row == i].min() + 1e-12


def test_crowded_axes_are_spread_over_shards():
    first, blocks = ann.shards(np.array([5, 3, 250, 0, 2, 100, 1]), 100)
    assert blocks.tolist() == [1, 1, 3, 1, 1, 1, 1] and first.tolist() == [0, 0, 1, 3, 4, 5, 6]


def test_deep_and_unclosed_pages_take_linear_time():
    began = time.process_time()
    deep = "<body><p>start</p>" + "<div class=x>" * 100_000 + "<p>end</p>"
    assert html_extract.extract(deep, None) == "start" or html_extract.extract(deep, None).endswith("end")
    assert html_extract.extract(deep, "/body/div.x").endswith("end")
    stray = "<body><article>" + "<p><span>a</i></b>" * 30_000 + "</em>" * 100_000 + "<li><h2>x</h2>" * 20_000 + "</article>"
    assert html_extract.extract(stray, None).startswith("a\na")
    assert time.process_time() - began < 60


PARTS = {
    "header": ("<article><header><h1>Title</h1></header><p>Text of it</p><footer>Tags</footer></article>", "Title\nText of it"),
    "page": ("<header><h1>Site</h1></header><main><p>Text of it</p></main>", "Text of it"),
    "class": ('<article><p>Text of it</p><div class="related-work"><p>Others did</p></div><div class="related-posts"><p>See also</p></div></article>', "Text of it\nOthers did"),
    "table": ("<article><table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e</ul></article>", "a\nb\nc\nd\ne"),
}


@pytest.mark.parametrize("name", PARTS)
def test_parts_of_an_article(name):
    page, want = PARTS[name]
    assert html_extract.extract("<body>" + page + "</body>", None) == want


def test_votes_and_paths_follow_the_pages(spark):
    """Winning paths against a count by hand over the given pages; ties go to the first path in order."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    votes = {}
    for r in pages.collect():
        blocks, nodes = html_extract.parse(r.html or "")
        if blocks:
            host = (r.url or "").split("//")[-1].split("/")[0].split(":")[0].lower()
            path = html_extract.best_container(nodes).path
            votes.setdefault(host, []).append(path)
    want = {h: min(set(v), key=lambda p: (-v.count(p), p)) for h, v in votes.items()}
    assert {r.host: r.path for r in html_extract.host_paths(pages).collect()} == want


def cross_parsed(text, samples):
    """The language by brute force: greedy phrases over each sample, by bits."""
    folded = " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split())
    bits = {lang: greedy(folded, rows) * math.log2(sum(map(len, rows))) for lang, rows in samples.items()}
    return min(sorted(bits), key=bits.get)


def test_predictions_follow_the_parse():
    rng = random.Random(11)
    made = {"aa": "ba ni ko lu ma".split(), "bb": "ba ni str keit ung".split(), "cc": "lu ma ko ung".split()}
    line = lambda lang: " ".join("".join(rng.choice(made[lang]) for _ in range(2)) for _ in range(12))
    samples = {lang: [line(lang) for _ in range(6)] for lang in made}
    texts = [line(rng.choice(list(made))) for _ in range(40)] + ["Ba-ni, KO! 7 lu", "x", "ung"]
    assert langid.Identifier(samples).predict(texts)[0] == [cross_parsed(t, samples) for t in texts]


def test_equal_languages_go_by_name_and_long_texts_count_whole():
    model = langid.Identifier({"b": ["same words here"], "a": ["same words here"], "c": ["quite other stuff"]})
    assert model.predict(["same words", "quite other " * 50_000 + "same"])[0] == ["a", "c"]


def test_passages_lie_all_over_a_long_row(spark):
    text = "".join(chr(0x4E00 + k) for k in range(8000))
    docs = spark.createDataFrame([(1, text, "zz"), (1, text, "zz"), (2, "short one", "zz")], "doc_id long, text string, lang string")
    sample = langid.training_sample(docs)["zz"]
    long = [p for p in sample if p != "short one"]
    assert [len(p) for p in sample].count(250) == 8 and all(p in text for p in long)
    assert {text.index(p) // 2000 for p in long} == {0, 1, 2, 3}


@pytest.mark.parametrize("demand", ["dense", "long", "one"])
def test_patterns_reach_the_optimum(demand):
    rng = np.random.default_rng(3)
    counts = {"dense": rng.integers(0, 4000, 64), "long": np.append(np.zeros(40, int), rng.integers(0, 90, 24)), "one": np.eye(64, dtype=int)[30] * 7}[demand]
    patterns, amount = packing.solve_patterns(counts, 64)
    assert (patterns @ np.arange(1, 65) <= 64).all() and np.allclose(amount @ patterns, counts, rtol=1e-4)
    rows = np.flatnonzero(counts)
    duals = np.linalg.solve(patterns[:, rows].astype(float), np.ones(len(rows)))
    prices = np.zeros(64)
    prices[rows] = np.maximum(duals, 0)
    value, _ = packing.best_pattern(prices, 64)  # prices that no pattern exceeds bound the linear program
    least = max(counts @ prices / max(value, 1e-9), (counts * np.arange(1, 65)).sum() / 64)
    assert amount.sum() <= least * (1 + 1e-3) + 0.5


def test_fast_transform_is_the_hadamard_matrix():
    for width in (2, 8, 16, 64):
        h = np.ones((1, 1))
        while len(h) < width:
            h = np.block([[h, h], [h, -h]])
        x = np.random.default_rng(width).normal(size=(5, width))
        assert np.allclose(ann._hadamard(x), x @ h / np.sqrt(width))
