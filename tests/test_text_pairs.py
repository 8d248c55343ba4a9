"""Text similarity of all neighbouring benchmark items against a plain edit distance."""

import pytest

from docloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_all_pairs_are_compared(spark):
    texts = {r.item_id: " ".join(r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    pairs = {i: (texts[i], texts[i + 1]) for i in texts if i + 1 in texts}
    assert any(not a.isascii() or not b.isascii() for a, b in pairs.values())
    got = {r.id: (r.cer, r.anls) for r in QUERIES["text_similarity_all"](spark, SF).collect()}
    assert got.keys() == pairs.keys()
    for i, (a, b) in pairs.items():
        assert got[i] == pytest.approx((edits(a, b) / len(a), 1 - edits(a.lower(), b.lower()) / max(len(a), len(b))))
