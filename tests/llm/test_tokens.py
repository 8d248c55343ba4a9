import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docloom.llm import bitpack, decontaminate, packing, tokenize
from tests.llm.fixtures import SCHEMA, UPPER, corpus

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PLAIN = {}


def plain(path, text):
    if path not in PLAIN:
        PLAIN[path] = Tokenizer.from_file(path)
        PLAIN[path].encode_special_tokens = True
    return PLAIN[path].encode(text or "", add_special_tokens=False).ids


ODD = ["", " ", "a  b", "a   b\n\nc", "x\ty \n z", "don't I'll 'S", "é è́ ̈x", "ΣΑΣ ΣΑΣ.", "\x1c a\x1cb c", "<|endoftext|> a<|endoftext|>", "a\r\nb", "a\x85b c \x85 d", "it's, so. ok! 'tis", "ÄÖ ß, İ", "a.b,c d..", "٣٤ x²"]


@pytest.mark.parametrize("path, blanks", [(BYTES, True), (PIECES, False)])
def test_pieces_encode_as_whole_texts(path, blanks, monkeypatch):
    texts = ODD + [r[1] or "" for r in corpus()]
    for limit in (1 << 20, 7):
        monkeypatch.setattr(tokenize, "SEGMENT_CHARS", limit)
        for cap in (10**6, 5):
            ids, counts = tokenize.PieceEncoder(path, blanks, cap).encode(texts)
            ends = np.cumsum(counts)
            for text, a, b in zip(texts, ends - counts, ends, strict=True):
                assert ids[a:b].tolist() == plain(path, text), text[:80]


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=40))
def test_any_text_encodes_as_a_whole(text):
    for path, blanks in ((BYTES, True), (PIECES, False)):
        assert tokenize.encoder(path, blanks).encode([text])[0].tolist() == plain(path, text)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 20), st.integers(0, 100), st.data())
def test_bits_round_trip(bits, n, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), min_size=n, max_size=n)), np.uint32)
    payload = bitpack.pack(ids, bits, block_ids=16)
    assert bitpack.read_ids(payload).tolist() == ids.tolist()
    start, length = data.draw(st.integers(0, 110)), data.draw(st.integers(0, 50))
    assert bitpack.read_ids(payload, start, length).tolist() == ids[start : start + length].tolist()
    assert len(payload) <= bitpack.HEADER.size + 8 * (n // 16 + 1) + n * bits / 8 + 1


def test_packed_files(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows[::-1], SCHEMA)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in bitpack.packed_round_trip(docs, BYTES, 2).collect()}
    at = 0
    for i, text, *_ in rows:
        ids = np.array([*plain(BYTES, text), 2], "<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert bitpack.packed_round_trip(docs.limit(0), BYTES, 2).count() == 0


def test_packing(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    sequence = 256
    pieces = packing.pack_documents(docs, PIECES, 1, sequence=sequence).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert by_doc.keys() == {r[0] for r in rows}
    for i, text, *_ in rows:
        ids, at = np.array([*plain(PIECES, text), 1], "<u4"), 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for members in by_seq.values():
        at = 0
        for p in sorted(members, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= sequence
    full = sum(p.length for p in pieces)
    assert len(by_seq) <= 1.1 * full / sequence + 2
    assert packing.pack_documents(docs.limit(0), PIECES, 1).count() == 0


def test_patterns_hold_the_demand_and_waste_little():
    rng = np.random.default_rng(6)
    demand = rng.integers(0, 400, 64)
    chosen = packing.plan(demand, 64)
    assert (sum(n * p for n, p in chosen) == demand).all()
    assert all((p * np.arange(1, 65)).sum() <= 64 for _, p in chosen)
    used, least = sum(n for n, _ in chosen), (demand * np.arange(1, 65)).sum() / 64
    patterns, amount = packing.solve_patterns(demand, 64)
    assert amount.sum() >= least - 1e-6 and used <= amount.sum() * 1.01 + 3


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, window=13):
    split = lambda t: WORDS.findall((t or "").translate(UPPER))
    phrases = {}
    for item, text in items:
        w = split(text)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            phrases.setdefault(tuple(w[k : k + window]), set()).update(() if item is None else (str(item),))
    out = {}
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if (p := tuple(w[k : k + n])) in phrases:
                    hit.update(range(k, k + n))
                    found |= phrases[p]
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination(spark):
    rows = [r[:2] for r in corpus()]
    long = rows[1][1].split()
    items = [(1, " ".join(long[-20:])), (2, rows[6][1][:200]), (3, "x"), (4, None), (5, " ., "), (10, " ".join(long[-20:])), (None, "1, 2; 3"), (6, "not there at all"), (6, "1 2")]
    rows += [(500, "X-x " * 9), (501, "Before " + " ".join(long[-20:]).upper() + " after " + "filler " * 700)]
    docs = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, text string, phrase string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.decontaminate(docs, bench).collect()}
    want = contamination(rows, items)
    assert got == want
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, x in want.items() if not x[4]}
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def test_repeated_and_nameless_documents(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, "c d e"), (None, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "A, b")], "item_id long, text string")
    got = sorted(map(repr, ((r.doc_id, r.n_hit, r.contaminated) for r in decontaminate.decontaminate(docs, bench).collect())))
    assert got == sorted(map(repr, [(None, 2, True), (1, 2, True), (1, 2, True), (1, 0, False), (None, 0, False)]))
    assert decontaminate.clean_documents(docs, bench).count() == 2


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red cat sat by the blue dog"), (2, "dog x x x x x x x x cat"), (3, "cat dog")], "doc_id long, text string")
    index = decontaminate.postings(docs, spark.createDataFrame([("cat",), ("dog",)], "term string"))
    assert sorted(r.doc_id for r in decontaminate.proximity(index, ["dog", "cat"], 6).collect()) == [1, 3]
    assert [r.doc_id for r in decontaminate.proximity(index, ["dog", "cat"], 2).collect()] == [3]
