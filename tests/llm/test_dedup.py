import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import components, hashing, near_dedup, substring_dedup, suffix_dedup, suffix_sort
from tests.llm.fixtures import SCHEMA, corpus, sha, words


def shingles(text):
    w = words(text, lower=True)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def groups(rows, percent=85):
    sets = {r[0]: shingles(r[1]) for r in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for i in ids:
        for j in ids:
            if j < i and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def near_copies(n=80):
    """One large group: copies of a text at all distances around the threshold, which link in chains if at all."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(n):
        w = list(base)
        for k in range(i % 9):
            w[rng.randrange(len(w))] = f"x{i}.{k}"
        rows.append((n - i, " ".join(w)))
    return rows


@pytest.mark.parametrize("rows", [[r[:2] for r in corpus()], near_copies()])
def test_near_duplicates(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == groups(rows)


def test_near_duplicates_of_odd_tables(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, None), (9, "")], "doc_id long, text string")
    got = sorted(map(repr, ((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())))
    assert got == sorted(map(repr, [(None, 2, None, True), (4, 2, 4, True), (4, 2, 4, True), (9, 0, 9, True), (9, 0, 9, True)]))
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_agree_as_often_as_sets_do():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate([a[:200], rng.integers(0, 2**63, 100).astype(np.uint64)])
    sig = near_dedup.super_minhash(np.concatenate([a, b, a[:1], a[::-1]]), np.array([0, 300, 600, 601, 601, 901]), 512)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.1
    assert (sig[0] == sig[4]).all() and (sig[3] == np.iinfo(np.uint64).max).all()
    assert sorted((sig[2] >> np.uint64(32)).tolist()) == list(range(512))  # one element fills every place once


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 130)}


def spans(flags):
    return sum(1 for i, f in enumerate(flags) if f and not (i and flags[i - 1]))


def cut_bytes(rows, length=50):
    seen, out = set(), {}
    for i, text in sorted((r[0], (r[1] or "").encode()) for r in rows):
        gone, own = bytearray(len(text)), set()
        for k in range(len(text) - length + 1):
            s = text[k : k + length]
            own.add(s)
            if s in seen:
                gone[k : k + length] = b"\1" * length
        seen |= own
        out[i] = (len(text), sum(gone), spans(gone), sha(bytes(c for c, g in zip(text, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("crowd", [2, 4096])
def test_suffix_dedup(spark, crowd):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = suffix_dedup.remove_repeats(docs, chunk_bytes=5000, crowd=crowd).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == cut_bytes(rows)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_rows_of_one_id_never_remove_each_other(spark):
    text = "".join(random.Random(2).choice("abc") for _ in range(90))
    docs = spark.createDataFrame([(None, text), (5, text), (5, text), (3, text[:60])], "doc_id long, text string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == [(-1, 0), (3, 60), (5, 90), (5, 90)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=60, max_size=300), st.sampled_from([8, 16, 24, 32]))
def test_deep_shallow_orders_suffixes(letters, shallow):
    data = np.array(letters, np.uint8)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at = np.arange(len(data) - 50 + 1)
    order, same = suffix_sort.deep_shallow(padded, at, 50, shallow)
    raw = data.tobytes()
    strings = [raw[i : i + 50] for i in at[order].tolist()]
    assert strings == sorted(strings)
    assert same.tolist() == [k > 0 and strings[k] == strings[k - 1] for k in range(len(strings))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=6, max_size=6), min_size=1, max_size=40))
def test_blind_trie(strings):
    found = suffix_sort.blind_trie(strings)
    assert [strings[g[0]] for g in found] == sorted(set(strings))
    assert sorted(i for g in found for i in g) == list(range(len(strings)))


def cut_words(rows, window=35):
    seqs = {r[0]: words(r[1]) for r in rows}
    counts = Counter(tuple(w[k : k + window]) for w in seqs.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in seqs.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if counts[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


def test_substring_dedup(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    want = cut_words(rows)
    got = substring_dedup.repeats(docs, chunk_bytes=5000).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == {i: (n, k, sha(t)) for i, (n, k, t) in want.items()}
    whole = substring_dedup.without_repeats(docs, chunk_bytes=5000)
    assert whole.columns == docs.columns
    for r in whole.collect():
        before = rows[r.doc_id]
        text = want[r.doc_id][2] if want[r.doc_id][1] else before[1]
        assert tuple(r) == (before[0], text, before[2], before[3], len(text) if text is not None else None, *before[5:])
    assert substring_dedup.repeats(docs.limit(0)).count() == 0


def test_windows_choose_their_anchor_by_content():
    rng = np.random.default_rng(4)
    grams = rng.integers(0, 2**63, 500).astype(np.uint64)
    place = hashing.anchors(grams, 28)
    again = hashing.anchors(np.concatenate([grams[100:], grams[:100]]), 28)
    assert (place[100:] - 100 == again[: len(place) - 100]).all()
    assert all(k <= p < k + 28 for k, p in enumerate(place.tolist()))


def test_a_shared_id_is_one_document(spark):
    """Whatever links with any text of an id links with all of them, and one row of a group stays."""
    x, y = (" ".join(f"{c}{k}" for k in range(60)) for c in "xy")
    rows = [(4, x), (4, y), (9, x + " more"), (2, y + " more"), (2, y), (5, ""), (5, x), (7, "alone"), (7, "alone"), (None, x), (None, x)]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, rep long, keys string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {(4, 2, False), (9, 2, False), (2, 2, True), (5, 2, False), (7, 7, True), (None, None, True)}
    kept = near_dedup.first_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(repr, kept.select("doc_id", "text").collect())) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in [(2, y), (7, "alone"), (None, x), (None, x)])
