"""Hybrid search of whole texts and all vectors against brute force."""

import math
import random
from collections import Counter

import numpy as np

from docloom.operators import retrieval
from docloom.plans.queries import QUERIES


def grams(text):
    out = Counter()
    for w in (text or "").lower().split():
        w = f" {w} "
        out.update(w[i : i + n] for n in (3, 4, 5) if len(w) >= n for i in range(len(w) - n + 1))
    return out


def unit_weights(texts):
    tf = {i: grams(t) for i, t in texts.items()}
    df = Counter(g for c in tf.values() for g in c)
    out = {}
    for i, c in tf.items():
        w = {g: (1 + math.log(k)) * (math.log((1 + len(tf)) / (1 + df[g])) + 1) for g, k in c.items()}
        length = math.sqrt(sum(x * x for x in w.values()))
        out[i] = {g: x / length for g, x in w.items()}
    return out


def best(scored, k):
    return sorted(scored, key=lambda x: (-x[1], x[0]))[:k]


def brute_hybrid(texts, vectors):
    weights = unit_weights(texts)
    length = {i: v / math.sqrt(v @ v) for i, v in vectors.items()}
    out = {}
    for q in sorted(i for i in texts.keys() | vectors.keys() if i % 20 == 0):
        scores = {}
        own = weights.get(q, {})
        said = [(i, round(sum(x * w.get(g, 0.0) for g, x in own.items()), 12)) for i, w in weights.items()]
        for r, (i, s) in enumerate(best([x for x in said if x[1] > 0], 20)):
            scores[i] = [s, r, 99]
        near = [(i, min(1.0, max(0.0, round(float(length[q] @ v), 12)))) for i, v in length.items()] if q in length else []
        for r, (i, s) in enumerate(best(near, 20)):
            entry = scores.setdefault(i, [0.0, 99, 99])
            entry[0], entry[2] = max(entry[0], (s - 0.25) / 0.75), r
        order = sorted(scores.items(), key=lambda x: (-x[1][0], *x[1][1:]))[:5]
        if order:
            out[q] = [(i, s[0]) for i, s in order]
    return out


def test_hybrid_asks_whole_texts_of_all_documents(spark, tmp_path):
    rng, noise = random.Random(4), np.random.default_rng(4)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    texts = {i: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 5))) for i in range(90)}
    texts |= {20: "same opening\n" + texts[41], 40: None, 7: texts[60], 8: texts[60], 61: ""}
    vectors = {i: noise.normal(size=8) for i in range(0, 130, 3)} | {20: noise.normal(size=8)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in sorted(QUERIES["hybrid_topk"](spark, str(tmp_path)).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.entry_id, round(r.score, 9)))
    want = {q: [(i, round(s, 9)) for i, s in found] for q, found in brute_hybrid(texts, vectors).items()}
    assert got == want
    assert any(i == 41 for i, _ in got[20]) and {0, 20, 60, 80, 120} == got.keys()


def test_text_search_by_blocks_equals_the_index(spark, monkeypatch):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdeÉ😀") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    rows += [(5, "more of\tit"), (200, rows[9][1]), (201, None), (202, " \n"), (203, "x"), (204, "abcde " * 3000)]
    entries = spark.createDataFrame(rows, "entry_id long, text string")
    queries = entries.where("entry_id % 4 = 0 or entry_id > 199 or entry_id = 5").withColumnRenamed("entry_id", "query_id")
    listed = lambda found: sorted((r.query_id, r["rank"], r.entry_id, round(r.score, 10)) for r in found.collect())
    want = listed(retrieval.TfidfIndex(entries).search(queries, 6))
    for settings in ({}, {"BLOCK_CHARS": 900, "ASKED": 7, "DENSE": 30}, {"VOCABULARY": 10}):
        with monkeypatch.context() as changed:
            for name, value in settings.items():
                changed.setattr(retrieval, name, value)
            assert listed(retrieval.text_search(queries, entries, 6)) == want, settings
    plan = retrieval.text_search(queries, entries, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "gram" not in plan  # no table of postings
    assert retrieval.text_search(queries, entries.limit(0), 6).count() == 0


def test_text_search_sends_queries_once_and_bounds_what_follows(spark, monkeypatch):
    rng = random.Random(11)
    kinds = [["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(60)] for letters in ("abcde", "fghij", "éüñçklm")]
    rows = [(i, " ".join(rng.choice(kinds[i % 7 % 3]) for _ in range(rng.randint(1, 60)))) for i in range(300)]
    rows += [(300 + i, rows[i * 5][1]) for i in range(40)] + [(400, "aa " * 70_000)]
    entries = spark.createDataFrame(rows, "entry_id long, text string")
    queries = entries.where("entry_id % 5 = 0").withColumnRenamed("entry_id", "query_id")
    listed = lambda found: sorted((r.query_id, r["rank"], r.entry_id, round(r.score, 10)) for r in found.collect())
    for name, value in {"BLOCK_CHARS": 12_000, "ASKED": 40, "AHEAD": 3, "SENT": 20_000}.items():
        monkeypatch.setattr(retrieval, name, value)
    found = retrieval.text_search(queries, entries, 4)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()  # no copy of the queries for each block
    assert listed(found) == listed(retrieval.TfidfIndex(entries).search(queries, 4))
