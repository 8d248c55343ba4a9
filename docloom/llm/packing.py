"""Packing documents into sequences by cutting-stock column generation.

A document's ids are cut into full sequences and one rest. Rests fall into classes of `unit` tokens, rounded up. The
class counts are the demand of a cutting-stock problem with one row per class: a linear program over patterns, whose
columns come from knapsack dynamic programming over the dual prices. Rounded-down pattern counts and a first-fit pass
over the few classes' remainders give the list of patterns; documents, ranked within their class, take the pattern
places in rank order. The program sees class counts only, so its size is fixed by the sequence length.

Null and empty texts have the end id alone. Rows that share a doc_id are packed as separate documents. Columns other
than the id and the text are not read; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.batches import slices
from docloom.llm.shared import written
from docloom.llm.tokenize import SLICE_BYTES, encoder

SEQUENCE = 2048
UNIT = 8
#: Rounds of column generation without gain after which it ends.
STALL = 2000


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: item k weighs k + 1 and is worth prices[k]; best value and item counts."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for w in range(1, capacity + 1):
        k = min(w, len(prices))
        offers = prices[:k] + value[w - 1 :: -1][:k]
        best = int(offers.argmax())
        if offers[best] > value[w - 1]:
            value[w], choice[w] = offers[best], best
        else:
            value[w] = value[w - 1]
    counts, w = np.zeros(len(prices), np.int64), capacity
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            counts[choice[w]] += 1
            w -= choice[w] + 1
    return float(value[capacity]), counts


def solve_patterns(demand: np.ndarray, capacity: int, gap: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """The cutting-stock linear program by column generation: patterns (rows) and how often each is used.

    Class k weighs k + 1 units. Any prices, scaled so that no pattern is worth more than one, bound the optimum from
    below. Columns are priced between the best such prices and the program's duals, which saves rounds, and by the duals
    alone where that finds none. It runs until the value is within `gap` of the bound, or half a sequence, however many
    rounds that takes; `STALL` rounds without gain mean that rounding allows no better.
    """
    rows = np.flatnonzero(demand)
    if not len(rows):
        return np.zeros((0, len(demand)), np.int64), np.zeros(0)
    need = demand[rows] * (1 + 1e-7 * np.arange(1, len(rows) + 1))  # bases hardly tie, so steps are of some length
    patterns = np.zeros((len(rows), len(demand)), np.int64)
    patterns[np.arange(len(rows)), rows] = capacity // (rows + 1)
    inverse = np.diag(1.0 / patterns[np.arange(len(rows)), rows])
    amount = inverse @ need
    safe = (rows + 1) / capacity
    bound, done = float(need @ safe), 0

    def priced(duals: np.ndarray) -> np.ndarray:
        nonlocal safe, bound
        prices = np.zeros(len(demand))
        prices[rows] = np.maximum(duals, 0)
        value, column = best_pattern(prices, capacity)
        if value > 0 and need @ prices[rows] / value > bound:
            bound, safe = float(need @ prices[rows] / value), prices[rows] / value
        return column

    least, gained = np.inf, 0
    while (now := amount.sum()) > bound + max(0.5, gap * bound) and done - gained < STALL:
        if now < least * (1 - 1e-12):
            least, gained = now, done
        duals = inverse.sum(axis=0)
        column = priced((safe + duals) / 2)
        if column[rows] @ duals <= 1 + 1e-9 and (column := priced(duals))[rows] @ duals <= 1 + 1e-9:
            break  # no pattern is worth more than it costs
        step = inverse @ column[rows]
        positive = step > 1e-12
        ratios = np.where(positive, amount / np.where(positive, step, 1), np.inf)
        leave = int(ratios.argmin())
        move = ratios[leave]
        amount -= move * step
        amount[leave] = move
        pivot = inverse[leave] / step[leave]
        inverse -= np.outer(step, pivot)
        inverse[leave] = pivot
        patterns[leave] = column
        done += 1
        if done % 500 == 0:  # what rounding has left goes
            inverse = np.linalg.inv(patterns[:, rows].T.astype(float))
            amount = inverse @ need
    return patterns, np.maximum(amount, 0)


def first_fit(left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Remaining items, largest first, each into the first open pattern with room."""
    open_, room = [], []
    for k in np.flatnonzero(left)[::-1]:
        for _ in range(int(left[k])):
            at = next((i for i, r in enumerate(room) if r > k), -1)
            if at < 0:
                open_.append(np.zeros(len(left), np.int64))
                room.append(capacity)
            open_[at][k] += 1
            room[at] -= k + 1
    return open_


def plan(demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(number of sequences, items of each class in one) that hold exactly `demand` items of each class."""
    patterns, amount = solve_patterns(demand, capacity)
    left, out = demand.astype(np.int64).copy(), []
    for pattern, x in sorted(zip(patterns, amount, strict=True), key=lambda p: -p[1]):
        fits = (left[pattern > 0] // pattern[pattern > 0]).min() if pattern.any() else 0
        times = min(int(np.floor(x + 1e-9)), int(fits))
        if times:
            out.append((times, pattern))
            left -= times * pattern
    return out + [(1, p) for p in first_fit(left, capacity)]


def places(demand: np.ndarray, capacity: int) -> dict[int, tuple[np.ndarray, ...]]:
    """For each class: first ranks, items of it in a sequence, first sequences and place of the first item there."""
    table: dict[int, list] = {}
    sequence, seen = 0, np.zeros(len(demand), np.int64)
    for times, pattern in plan(demand, capacity):
        place = 0
        for k in np.flatnonzero(pattern)[::-1]:
            n = int(pattern[k])
            table.setdefault(int(k), []).append((int(seen[k]), n, sequence, place))
            seen[k] += times * n
            place += n
        sequence += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for k, rows in table.items()}


def cut(docs: DataFrame, vocabulary: str, end_id: int, sequence: int = SEQUENCE, unit: int = UNIT, keeps_blanks: bool = False) -> DataFrame:
    """Pieces of each document: doc_id, start, length, ids_crc32, doc_tokens, class, and the rank in class and task."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(vocabulary, keeps_blanks), TaskContext.get().partitionId()
        seen = np.zeros(sequence // unit + 1, np.int64)
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                flat, counts = enc.encode(rows.column("text").to_pylist())
                flat = np.insert(flat, np.cumsum(counts), end_id).astype("<u4")
                counts = counts + 1
                n_pieces = -(-counts // sequence)
                doc = np.repeat(np.arange(len(counts)), n_pieces)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = k * sequence
                length = np.minimum(counts[doc] - start, sequence)
                begin = (np.cumsum(counts) - counts)[doc] + start
                sums = [zlib.crc32(flat[b : b + n]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
                kind = -(-length // unit) - 1
                order = np.argsort(kind, kind="stable")
                sizes = np.bincount(kind, minlength=len(seen))
                rank = np.empty(len(kind), np.int64)
                rank[order] = np.arange(len(kind)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                rank += seen[kind]
                seen += sizes
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(doc)), *map(pa.array, (start, length)), pa.array(sums, pa.int64()), pa.array(counts[doc]), pa.array(kind.astype(np.int32)), pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "part", "rank"],
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, kind int, part int, rank long")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, sequence: int = SEQUENCE, unit: int = UNIT, keeps_blanks: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if sequence % unit:
        raise ValueError("the sequence length must be a multiple of the unit")
    pieces = written(cut(docs, vocabulary, end_id, sequence, unit, keeps_blanks), "pieces")
    sizes = written(pieces.groupBy("kind", "part").agg(F.count("*").alias("n")), "piece-counts")
    capacity = sequence // unit
    demand = np.zeros(capacity, np.int64)
    for r in sizes.groupBy("kind").agg(F.sum("n").alias("n")).collect():  # one row per class
        demand[r["kind"]] = r["n"]
    table = places(demand, capacity)

    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("kind", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["kind", "part"]).withColumn("rank", F.col("rank") + F.col("base"))

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "rank"))
            seq, place = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
            for k in np.unique(kind):
                first, n, at, slot = table[int(k)]
                mine = np.flatnonzero(kind == k)
                run = np.searchsorted(first, rank[mine], "right") - 1
                ahead = rank[mine] - first[run]
                seq[mine] = at[run] + ahead // n[run]
                place[mine] = slot[run] + ahead % n[run]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(seq), pa.array(place)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "place"])

    seated = ranked.mapInArrow(seat, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long")
    ahead = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return seated.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("place")
