"""Questions about content that chunks of documents send to buckets of keys, and the answers.

Documents are dealt to chunks of a few megabytes by a hash. A chunk's task reduces its documents to distinct 64-bit
keys and sends each bucket (a range of key values) one packed row; the bucket's task sees what all chunks hold of its
keys and sends each chunk one packed row back. A key that is in a third of all documents is one entry for each chunk,
never one for each document, so no task's input grows with a hot key's occurrences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import codec, workers
from docloom.llm.batches import slices

#: Bytes of text in a chunk, on average.
CHUNK_BYTES = 4 << 20

QUESTION = "chunk int, bucket int, payload binary"
ANSWER = "chunk int, payload binary"


def chunk_count(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> int:
    """How many chunks the texts make, by one rule at every size. There are as many buckets. A chunk sends a row to those
    buckets only that it has keys for: rows grow with the square of the chunks as long as they hold many keys each, and
    never beyond one for each distinct key of a chunk."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // chunk_bytes))


def chunked(docs: DataFrame, chunks: int, rest: list[str] | None = None) -> DataFrame:
    """chunk, doc_id, text: the first column deals rows evenly, whatever their source, length or id.

    Columns named in `rest` come along in one struct, under whatever names they have.
    """
    spread = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(chunks)).cast("int")
    more = [F.struct(*rest).alias("rest")] if rest else []
    return docs.select(spread.alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), "text", *more)


def split(keys: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of each bucket's share of the sorted keys."""
    step = (1 << 64) // buckets + 1
    bounds = np.array([b * step for b in range(1, buckets)], np.uint64)
    cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
    return [(b, cuts[b], cuts[b + 1]) for b in range(buckets) if cuts[b] < cuts[b + 1]]


def rows(chunk: int, parts: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"chunk": pa.array([chunk] * len(parts), pa.int32()), "bucket": pa.array([b for b, _ in parts], pa.int32()), "payload": pa.array([p for _, p in parts], pa.binary())})


def answers(parts: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"chunk": pa.array([c for c, _ in parts], pa.int32()), "payload": pa.array([p for _, p in parts], pa.binary())})


def presence(chunk: int, keys: np.ndarray, buckets: int) -> pa.Table:
    """A chunk's keys for `repeated`: each distinct one once, its lowest bit telling whether the chunk has it twice."""
    keys = np.sort(keys & ~np.uint64(1))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(fresh)
    twice = (np.diff(np.append(at, len(keys))) > 1).astype(np.uint64)
    own = keys[at]
    return rows(chunk, [(b, codec.pack(codec.gaps(own[i:j] | twice[i:j]))) for b, i, j in split(own, buckets)])


def repeated(questions: DataFrame, crowd: int | None = None) -> DataFrame:
    """For each chunk the keys of its own that occur twice or more in the corpus, as uint64.

    With `crowd` the lowest bit of a key tells that at least so many chunks have it.
    """

    def answer(table: pa.Table) -> pa.Table:
        chunks = table.column("chunk").to_pylist()
        held = [codec.from_gaps(codec.unpack(p)[0]) for p in table.column("payload").to_pylist()]
        flat = np.concatenate(held)
        owner = np.repeat(np.arange(len(held)), [len(h) for h in held])
        keys = flat & ~np.uint64(1)
        order = np.argsort(keys, kind="stable")
        keys, owner, twice = keys[order], owner[order], (flat[order] & np.uint64(1)).astype(bool)
        same = np.zeros(len(keys), bool)
        same[1:] = keys[1:] == keys[:-1]
        again = twice | same
        again[:-1] |= same[1:]
        if crowd is not None:
            begin = np.flatnonzero(~same)
            size = np.diff(np.append(begin, len(keys)))
            keys = keys | np.repeat((size >= crowd).astype(np.uint64), size)
        keys, owner = keys[again], owner[again]
        order = np.argsort(owner, kind="stable")
        keys, owner = keys[order], owner[order]
        cuts = np.searchsorted(owner, np.arange(len(held) + 1))
        return answers([(c, keys[cuts[i] : cuts[i + 1]].tobytes()) for i, c in enumerate(chunks) if cuts[i] < cuts[i + 1]])

    return questions.groupBy("bucket").applyInArrow(answer, ANSWER)


def tally(chunk: int, keys: np.ndarray, buckets: int) -> pa.Table:
    """A chunk's distinct keys with how often it has each, for `frequencies`."""
    keys, counts = np.unique(keys, return_counts=True)
    counts = counts.astype(np.uint32)
    return rows(chunk, [(b, keys[i:j].tobytes() + counts[i:j].tobytes()) for b, i, j in split(keys, buckets)])


def tallied(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(payload) // 12
    return np.frombuffer(payload, np.uint64, n), np.frombuffer(payload, np.uint32, n, 8 * n)


def frequencies(questions: DataFrame) -> DataFrame:
    """For each chunk its keys that occur twice or more in the corpus, with their counts there."""

    def answer(table: pa.Table) -> pa.Table:
        held = [tallied(p) for p in table.column("payload").to_pylist()]
        distinct, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, np.concatenate([n for _, n in held]).astype(np.int64))
        parts, at = [], 0
        for chunk, (keys, _) in zip(table.column("chunk").to_pylist(), held, strict=True):
            mine = np.minimum(total[place[at : at + len(keys)]], 0xFFFFFFFF).astype(np.uint32)
            at += len(keys)
            if (mine > 1).any():
                parts.append((chunk, keys[mine > 1].tobytes() + mine[mine > 1].tobytes()))
        return answers(parts)

    return questions.groupBy("bucket").applyInArrow(answer, ANSWER)


def ask(chunks: DataFrame, question: Callable[[int, pa.Table], pa.Table]) -> DataFrame:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        workers.release()
        out = question(key[0].as_py(), table)
        workers.trim()
        return out

    return chunks.groupBy("chunk").applyInArrow(run, QUESTION)


def with_answers(chunks: DataFrame, replies: DataFrame, use: Callable[[int, pa.Table, list[bytes]], pa.Table], schema: str) -> DataFrame:
    """`use` sees a chunk's documents with the payloads sent to it; chunks without answers are there too."""

    def run(key: tuple, docs: pa.Table, sent: pa.Table) -> pa.Table:
        workers.release()
        out = use(key[0].as_py(), docs, sent.column("payload").to_pylist())
        workers.trim()
        return out

    return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)


def keys_in(payloads: list[bytes]) -> np.ndarray:
    """All keys of several answers, sorted."""
    return np.sort(np.frombuffer(b"".join(payloads), np.uint64)) if payloads else np.zeros(0, np.uint64)


def doc_slices(docs: pa.Table, limit: int) -> Iterator[pa.Table]:
    yield from slices(docs.combine_chunks(), "text", limit)
