"""Token ids as fixed-width bit-packed files.

Every id takes the fewest bits that the vocabulary needs. A shard row of the written table holds a run of whole
documents in ascending doc_id order: their ids and counts, and one `payload` in the format of `pack`:

    fixed header   magic "DLBP", version, bits, ids in a block, number of ids, number of blocks
    offsets        uint64 start of each block within the payload
    blocks         ids, each `bits` wide, least significant bit first

A block is a multiple of eight ids, so it starts at a byte; `read_ids` opens only the blocks that a range
touches. Null and empty texts have only the end id. Rows that share a doc_id stay separate, in text order; a null
doc_id comes first. Columns of the input other than the id and the text are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.batches import slices
from docloom.llm.shared import scratch
from docloom.llm.tokenize import SLICE_BYTES, encoder

MAGIC, VERSION = b"DLBP", 1
HEADER = struct.Struct("<4sHHIQI")
BLOCK_IDS = 4096
#: Ids after which a shard row is closed at the next document's end.
SHARD_IDS = 1 << 18

SHARDS = "part int, shard int, first long, doc_ids array<long>, counts array<int>, payload binary"


def bits_for(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def _pack_block(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype("<u2").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def _unpack_block(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return raw[: 2 * n].view("<u2").astype(np.uint32)
    spread = np.unpackbits(raw, count=n * bits, bitorder="little").reshape(n, bits)
    return spread.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def pack(ids: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """The payload for a run of ids."""
    if block_ids % 8:
        raise ValueError("a block is a multiple of eight ids")
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError("an id needs more bits than the vocabulary has")
    blocks = [_pack_block(ids[k : k + block_ids], bits) for k in range(0, len(ids), block_ids)]
    base = HEADER.size + 8 * len(blocks)
    starts = base + np.concatenate([[0], np.cumsum([len(b) for b in blocks])])[: len(blocks)].astype("<u8")
    return HEADER.pack(MAGIC, VERSION, bits, block_ids, len(ids), len(blocks)) + starts.astype("<u8").tobytes() + b"".join(blocks)


def read_ids(payload: bytes, start: int = 0, length: int | None = None) -> np.ndarray:
    """Ids `start` to `start + length` of a payload; only the blocks in that range are unpacked."""
    magic, version, bits, block_ids, n_ids, n_blocks = HEADER.unpack_from(payload)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a packed run of ids")
    stop = n_ids if length is None else min(n_ids, start + length)
    if start >= stop:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(payload, np.uint8)
    starts = np.frombuffer(payload, "<u8", n_blocks, HEADER.size).astype(np.int64)
    first, last = start // block_ids, (stop - 1) // block_ids
    parts = []
    for k in range(first, last + 1):
        n = min(block_ids, n_ids - k * block_ids)
        parts.append(_unpack_block(raw[starts[k] : starts[k] + (n * bits + 7) // 8], n, bits))
    flat = np.concatenate(parts)
    return flat[start - first * block_ids : stop - first * block_ids]


def write_packed(docs: DataFrame, path: str, vocabulary: str, end_id: int, keeps_blanks: bool = True, doc_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, in ascending doc_id order, as shard rows below `path`.

    One range shuffle of the texts gives each task a run of the order; a task that runs again writes the same rows.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary, keeps_blanks), TaskContext.get().partitionId()
        bits = bits_for(max(enc.vocab_size, end_id + 1))
        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("payload", pa.binary())])
        shard = first = held = 0
        ids_of, docs_of, counts_of = [], [], []

        def row() -> pa.RecordBatch:
            flat = np.concatenate(ids_of)
            return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "first": first, "doc_ids": docs_of, "counts": counts_of, "payload": pack(flat, bits)}], schema=schema)

        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                flat, counts = enc.encode(piece.column("text").to_pylist())
                ends = np.cumsum(counts)
                flat = np.insert(flat, ends, end_id)
                counts = counts + 1
                at = 0
                for doc, n in zip(piece.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                    ids_of.append(flat[at : at + n])
                    docs_of.append(doc)
                    counts_of.append(n)
                    at += n
                    held += n
                    if held >= SHARD_IDS:
                        yield row()
                        shard, first, held = shard + 1, first + held, 0
                        ids_of, docs_of, counts_of = [], [], []
        if ids_of:
            yield row()

    texts = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, SHARDS).write.option("compression", "none").parquet(path)


def read_packed(spark, path: str) -> DataFrame:
    """One row per document of a written table: doc_id, start, n_tokens, ids_crc32.

    `start` adds the totals of earlier parts, one number per write task, to the place within the part.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    totals = shards.groupBy("part").agg(F.max(F.col("first") + F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))
    base, at = {}, 0
    for r in sorted(totals.collect()):
        base[r["part"]] = at
        at += r["total"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, docs, counts, payload in zip(*(batch.column(c).to_pylist() for c in ("part", "first", "doc_ids", "counts", "payload")), strict=True):
                ids = read_ids(payload).astype("<u4")
                size = np.array(counts, np.int64)
                begin = np.cumsum(size) - size
                sums = [zlib.crc32(ids[b : b + n]) for b, n in zip(begin.tolist(), counts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(begin + base[part] + first), pa.array(size), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed_round_trip(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Write `docs` in the packed format to the shared folder and return what the files say of each document."""
    path = scratch(docs.sparkSession, "packed-ids")
    write_packed(docs, path, vocabulary, end_id)
    return read_packed(docs.sparkSession, path)
