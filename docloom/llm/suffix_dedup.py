"""Exact dedup of byte strings: deep-shallow sorted suffixes of what can repeat.

Every string of `LENGTH` bytes within a document has one winnowed anchor, its least hashed run of `GRAM` bytes. Chunks
of documents join on anchors; strings around an anchor that occurs once anywhere cannot repeat. Around the others a
chunk sends its distinct contexts, the bytes of all strings that share the anchor, with the smallest doc_id that has
them. A bucket sorts the suffixes of contexts that differ around the same anchor (`suffix_sort`); equal neighbours of
`LENGTH` bytes are one string, and its smallest doc_id goes back. A byte is removed if a string over it also starts
in a document with a smaller doc_id.

A common passage is one entry for each chunk. Where a common anchor stands in many chunks its contexts may all
differ, so they are sent string by string, which spreads them over the buckets. Null and empty texts have no bytes.
Rows with a null doc_id count as before all others; rows that share a doc_id never remove each other. Columns other
than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from docloom.llm import exchange, hashing, workers
from docloom.llm.batches import string_buffers
from docloom.llm.suffix_sort import deep_shallow

LENGTH = 50
GRAM = 24
SLICE_BYTES = 1 << 18
#: Strings whose suffixes are sorted at once.
SORT_STRINGS = 250_000
#: Chunks that share an anchor from which on its contexts are sent string by string: what a bucket gets of one anchor is
#: bounded by so many chunks' contexts.
CROWD = 512
FIRST = np.iinfo(np.int64).min


class Runs:
    """The strings of a few documents in runs that share an anchor. `whole`: single strings will be asked for, too."""

    def __init__(self, docs: pa.Table, length: int, gram: int, whole: bool = True):
        self.data, self.offsets = string_buffers(docs.column("text"))
        self.ids = docs.column("doc_id").fill_null(FIRST).to_numpy()
        rolling = hashing.Rolling(self.data + np.uint64(1), hashing.BYTE_BASE)
        self.length = length
        size = np.diff(self.offsets)
        n = np.maximum(size - length + 1, 0)
        starts = np.arange(n.sum()) + np.repeat(self.offsets[:-1] - (np.cumsum(n) - n), n)
        grams = rolling.every(gram)
        place = hashing.anchors(grams, length - gram + 1)[starts]
        fresh = np.ones(len(place), bool)
        fresh[1:] = place[1:] != place[:-1]
        at = np.flatnonzero(fresh)
        self.anchor = grams[place[at]]
        self.low = starts[at]
        self.count = np.diff(np.append(at, len(place)))
        self.doc = np.searchsorted(self.offsets, self.low, "right") - 1
        self.id = self.ids[self.doc]
        #: an even hash of each run's bytes
        self.context = hashing.mixed(rolling.runs(self.low, self.low + self.count + length - 1) + self.count.astype(np.uint64)) & ~np.uint64(1)
        self.rolling, self.starts = (rolling, starts) if whole else (None, None)

    def singles(self, low: np.ndarray) -> np.ndarray:
        """An odd hash of each string that is sent by itself."""
        return self.rolling.runs(low, low + self.length) | np.uint64(1)


def _ranges(low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """low[0], low[0] + 1, ... for each pair, in a row."""
    return np.arange(count.sum()) + np.repeat(low - (np.cumsum(count) - count), count)


def _least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the smallest id of each, and where that is."""
    order = np.lexsort((ids, keys))
    keys = keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    return keys[fresh], ids[order][fresh], order[fresh]


def _packed(*arrays: np.ndarray) -> bytes:
    raw = b"".join(a.tobytes() for a in arrays)
    return struct.pack(f"<{len(arrays)}Q", *(a.nbytes for a in arrays)) + zstandard.ZstdCompressor(level=3).compress(raw)


def _unpacked(payload: bytes, *types: type) -> list[np.ndarray]:
    sizes = struct.unpack_from(f"<{len(types)}Q", payload)
    raw = zstandard.ZstdDecompressor().decompress(payload[8 * len(types) :], max_output_size=sum(sizes) + 1)
    out, at = [], 0
    for kind, size in zip(types, sizes, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


CONTEXT = (np.uint32, np.uint64, np.int64, np.uint8, np.uint8)  # anchor, hash, id, strings, bytes
VERDICT = (np.uint64, np.uint8, np.uint8, np.int64)  # hash, runs, strings in each run, id of each run


def _anchors(length: int, gram: int, buckets: int):
    def question(chunk: int, docs: pa.Table) -> pa.Table:
        keys = [np.zeros(0, np.uint64), *(Runs(part, length, gram, False).anchor for part in exchange.doc_slices(docs, SLICE_BYTES))]
        return exchange.presence(chunk, np.concatenate(keys), buckets)

    return question


def _contexts(length: int, gram: int, buckets: int):
    def use(chunk: int, docs: pa.Table, sent: list[bytes]) -> pa.Table:
        marked = exchange.keys_in(sent)
        seeds, crowded = marked & ~np.uint64(1), (marked & np.uint64(1)).astype(bool)
        found = []
        for part in exchange.doc_slices(docs, SLICE_BYTES) if len(seeds) else ():
            r = Runs(part, length, gram)
            key = r.anchor & ~np.uint64(1)
            hit = hashing.within(key, seeds)
            alone = hit & hashing.within(key, seeds[crowded])
            hit &= ~alone
            low, count = r.low[hit], r.count[hit]
            anchor, ids, hashes = key[hit], r.id[hit], r.context[hit]
            if alone.any():
                single = _ranges(r.low[alone], r.count[alone])
                low, count = np.append(low, single), np.append(count, np.ones(len(single), np.int64))
                anchor, hashes = np.append(anchor, r.singles(single)), np.append(hashes, r.singles(single))
                ids = np.append(ids, np.repeat(r.id[alone], r.count[alone]))
            hashes, least, at = _least(hashes, ids)
            low, count = low[at], count[at]
            found.append((anchor[at], hashes, least, count, r.data[_ranges(low, count + length - 1)]))
        if not found:
            return exchange.rows(chunk, [])
        anchor, hashes, ids, count, text = (np.concatenate(x) for x in zip(*found, strict=True))
        begin = np.cumsum(count + length - 1) - (count + length - 1)
        _, ids, at = _least(hashes, ids)
        at = at[(order := np.argsort(anchor[at], kind="stable"))]
        ids = ids[order]
        parts = []
        for b, i, j in exchange.split(anchor[at], buckets):
            k = at[i:j]
            parts.append((b, _packed(anchor[k].astype(np.uint32), hashes[k], ids[i:j], count[k].astype(np.uint8), text[_ranges(begin[k], count[k] + length - 1)])))
        return exchange.rows(chunk, parts)

    return use


def _judge(length: int, shallow: int):
    def answer(table: pa.Table) -> pa.Table:
        workers.trim()
        held = [_unpacked(p, *CONTEXT) for p in table.column("payload").to_pylist()]
        anchor, hashes, ids, count, text = (np.concatenate(x) for x in zip(*held, strict=True))
        count = count.astype(np.int64)
        begin = np.cumsum(count + length - 1) - (count + length - 1)
        owner = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
        distinct, least, at = _least(hashes, ids)
        # the contexts of an anchor that has several: their suffixes are sorted, so many at once
        strings = count[at]
        first = np.cumsum(strings) - strings
        smallest = np.repeat(least, strings)
        by_anchor = np.argsort(anchor[at], kind="stable")
        around = anchor[at][by_anchor]
        edge = np.flatnonzero(np.append(True, around[1:] != around[:-1])) if len(around) else np.zeros(0, np.int64)
        members = np.diff(np.append(edge, len(around)))
        mixed = np.repeat(members > 1, members)
        todo, group = by_anchor[mixed], np.repeat(np.arange(len(members)), members)[mixed]
        text = np.concatenate([text, np.zeros(8, np.uint8)])
        done = 0
        while done < len(todo):
            held_strings = np.cumsum(strings[todo[done:]])
            stop = done + max(1, int(np.searchsorted(held_strings, SORT_STRINGS, "right")))
            stop = done + int(np.searchsorted(group[done:], group[stop - 1], "right"))  # an anchor's contexts stay together
            k = todo[done:stop]
            where = _ranges(first[k], strings[k])
            order, same = deep_shallow(text, _ranges(begin[at[k]], strings[k]), length, shallow)
            head = np.flatnonzero(~same)
            smallest[where[order]] = np.repeat(np.minimum.reduceat(smallest[where[order]], head), np.diff(np.append(head, len(order))))
            done = stop
        # what a chunk does not know itself: strings with a smaller id than the context has there
        slot = np.searchsorted(distinct, hashes)
        lowest = np.minimum.reduceat(smallest, first) if len(first) else smallest
        tell = (lowest[slot] < ids) | ((hashes & np.uint64(1)) == 1)
        parts = []
        for i, chunk in enumerate(table.column("chunk").to_pylist()):
            mine = _owned(owner, i)
            mine = mine[tell[mine]]
            if not len(mine):
                continue
            s = slot[mine]
            values = smallest[_ranges(first[s], strings[s])]
            edge = np.cumsum(strings[s]) - strings[s]
            fresh = np.ones(len(values), bool)
            fresh[1:] = values[1:] != values[:-1]
            fresh[edge] = True
            heads = np.flatnonzero(fresh)
            runs = np.searchsorted(heads, edge + strings[s]) - np.searchsorted(heads, edge)
            parts.append((chunk, _packed(hashes[mine], runs.astype(np.uint8), np.diff(np.append(heads, len(values))).astype(np.uint8), values[heads])))
        return exchange.answers(parts)

    return answer


def _owned(owner: np.ndarray, i: int) -> np.ndarray:
    """Places of owner i; owners are in order."""
    return np.arange(np.searchsorted(owner, i), np.searchsorted(owner, i, "right"))


def crowded(sent: list[bytes]) -> bool:
    """Whether any verdict is on a single string."""
    return any((_unpacked(p, *VERDICT)[0] & np.uint64(1)).any() for p in sent)


def removal(parts: list[Runs], sent: list[bytes]) -> list[np.ndarray]:
    """For each slice of a chunk which bytes are removed."""
    held = [_unpacked(p, *VERDICT) for p in sent]
    told, runs, size, ids = (np.concatenate(x) if held else np.zeros(0, t) for x, t in zip(zip(*held, strict=True) if held else ((),) * 4, VERDICT, strict=True))
    order = np.argsort(told, kind="stable")
    run_at = (np.cumsum(runs.astype(np.int64)) - runs)[order]
    told, runs, size = told[order], runs[order].astype(np.int64), size.astype(np.int64)
    single = told[(told & np.uint64(1)) == 1]
    own = [r.context for r in parts]
    keys, least, _ = _least(np.concatenate(own), np.concatenate([r.id for r in parts])) if parts else (np.zeros(0, np.uint64), None, None)
    out = []
    for r, hashes in zip(parts, own, strict=True):
        edge = np.zeros(len(r.data) + 1, np.int64)

        def cover(low: np.ndarray, strings: np.ndarray, edge: np.ndarray = edge, length: int = r.length) -> None:
            np.add.at(edge, low, 1)
            np.add.at(edge, low + strings + length - 1, -1)

        known = hashing.within(hashes, told)
        plain = ~known & (r.id > least[np.searchsorted(keys, hashes)])
        cover(r.low[plain], r.count[plain])
        k = np.flatnonzero(known)
        if len(k):
            slot = np.searchsorted(told, hashes[k])
            n = runs[slot]
            at = _ranges(run_at[slot], n)
            behind = np.cumsum(size[at]) - size[at]
            behind -= np.repeat(behind[np.cumsum(n) - n], n)
            gone = np.repeat(r.id[k], n) > ids[at]
            cover((np.repeat(r.low[k], n) + behind)[gone], size[at][gone])
        if len(single):
            each = r.singles(r.starts)
            hit = np.flatnonzero(hashing.within(each, single))
            slot = np.searchsorted(told, each[hit])
            doc = np.searchsorted(r.offsets, r.starts[hit], "right") - 1
            gone = r.ids[doc] > ids[run_at[slot]]
            cover(r.starts[hit][gone], np.ones(int(gone.sum()), np.int64))
        out.append(np.cumsum(edge)[:-1] > 0)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_text: bool = False, chunk_bytes: int = exchange.CHUNK_BYTES, crowd: int = CROWD, shallow: int = 24) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; with `keep_text` also what is left, as bytes."""
    n = exchange.chunk_count(docs, chunk_bytes)
    chunks = exchange.chunked(docs, n)
    seeds = exchange.repeated(exchange.ask(chunks, _anchors(length, gram, n)), crowd)
    contexts = exchange.with_answers(chunks, seeds, _contexts(length, gram, n), exchange.QUESTION)
    verdicts = contexts.groupBy("bucket").applyInArrow(_judge(length, shallow), exchange.ANSWER)

    def result(_: int, table: pa.Table, sent: list[bytes]) -> pa.Table:
        tables = list(exchange.doc_slices(table, SLICE_BYTES))
        parts = [Runs(t, length, gram, crowded(sent)) for t in tables]
        out = [[], [], [], [], [], []]
        for t, r, gone in zip(tables, parts, removal(parts, sent), strict=True):
            enters = gone.copy()
            enters[1:] &= ~gone[:-1]
            inner = r.offsets[(r.offsets > 0) & (r.offsets < len(gone))]
            enters[inner] = gone[inner]
            lost, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, enters))
            for i, doc in enumerate(t.column("doc_id").to_pylist()):
                a, b = int(r.offsets[i]), int(r.offsets[i + 1])
                kept = r.data[a:b][~gone[a:b]].tobytes() if lost[b] > lost[a] else r.data[a:b].tobytes()
                for x, v in zip(out, (doc, b - a, int(lost[b] - lost[a]), int(spans[b] - spans[a]), hashlib.sha256(kept).hexdigest(), kept if keep_text else None), strict=True):
                    x.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
        return pa.table({c: pa.array(x, k) for c, x, k in list(zip(names, out, kinds, strict=True))[: 5 + keep_text]})

    return exchange.with_answers(chunks, verdicts, result, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
