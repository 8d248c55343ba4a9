"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are scaled to length one and turned by fast pseudo-rotations (three rounds of random signs and a Hadamard
transform); a hash is the signed axis nearest to the turned vector. A cell of a table joins several of them: the more
vectors, the more (`layout`). There are two tables, so a vector moves twice, whatever the size. A query loses something
by each axis that is not its best one; it asks for the cells of least loss, a stated share of all cells (`PLANS`), which
is measured on a fixed sample of cells where there are many. Cells are dealt to shards by their first axis, and a query
goes to the shards whose axes it reaches; a shard compares runs of cells with all queries that reach them and returns
each query's best few, scored exactly on the original vectors. A query for which the cells give too few is compared
with all vectors, block by block.

Equal vectors are one class, by a 64-bit hash: copies are left out where they are read and again in a shard, and a class
keeps the smallest ids that any answer can need. A crowded axis is dealt to shards of bounded size. Vectors that are null, zero or hold null or non-finite
components take no part, as queries or candidates. Vectors of different lengths are never compared; each length has an
index of its own. Of equal scores the smaller id comes first, however many there are. Rows
that share an id are one: it counts once, with the vector that is nearest, and never as a neighbour of itself. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from docloom.llm import hashing
from docloom.llm.shared import Workspace, written

#: Tables, and the share of all cells that a query asks for in each, by the number of hashes that a cell joins.
PLANS = {1: (2, 0.4), 2: (2, 0.13), 3: (2, 0.03)}
#: Bytes of vectors in a shard, at least and at most: the more vectors, the larger, so that queries go to few.
SHARD_BYTES = 1 << 25, 1 << 26
#: Cells of one run, which share all axes but the last, where three hashes are joined.
RUN_CELLS = 16
#: Cells by which a query's share is measured, and costs of cells that are held at once.
SAMPLED_CELLS, COSTS = 4096, 1 << 22
#: Pairs that are scored at once, and that wait for their exact score.
PAIRS, WAITING = 1 << 16, 1 << 17
SEED = 20260101


def layout(vectors: int, dimension: int) -> tuple[int, float, int]:
    """Tables, share of cells asked for and hashes for so many vectors: up to four cells for each vector, within the plans."""
    cells = 2 << max(1, (dimension - 1).bit_length())
    hashes = min(max(1, int(np.log(4 * max(vectors, 2)) / np.log(cells))), max(PLANS))
    return *PLANS[hashes], hashes


class Rotations:
    """Seeded pseudo-rotations for vectors of one length."""

    def __init__(self, dimension: int, tables: int = PLANS[1][0], hashes: int = 1, seed: int = SEED):
        self.width = 1 << max(1, (dimension - 1).bit_length())
        self.dimension, self.tables, self.hashes = dimension, tables, hashes
        signs = np.random.Generator(np.random.PCG64(seed)).integers(0, 2, (tables, hashes, 3, self.width))
        self.signs = (signs * 2 - 1).astype(np.float64)

    def turn(self, unit: np.ndarray, table: int, part: int) -> np.ndarray:
        x = np.zeros((len(unit), self.width))
        x[:, : self.dimension] = unit
        for signs in self.signs[table, part]:
            x *= signs
            x = _hadamard(x)
        return x

    def cells(self, unit: np.ndarray, table: int) -> np.ndarray:
        """The cell of each vector: the signed axes nearest to it, as the digits of one number."""
        cell = np.zeros(len(unit), np.int64)
        for part in range(self.hashes):
            turned = self.turn(unit, table, part)
            top = np.abs(turned).argmax(axis=1)
            cell = cell * (2 * self.width) + top + self.width * (turned[np.arange(len(top)), top] < 0)
        return cell

    def axes(self, cell: np.ndarray) -> np.ndarray:
        """The signed axes of cells, a row for each hash."""
        return np.array([cell // (2 * self.width) ** part % (2 * self.width) for part in reversed(range(self.hashes))])

    def losses(self, unit: np.ndarray, table: int) -> np.ndarray:
        """What a vector loses by each signed axis of each hash against its best, squared: hashes, vectors, axes."""
        out = np.empty((self.hashes, len(unit), 2 * self.width), np.float32)
        for part in range(self.hashes):
            turned = self.turn(unit, table, part)
            best = np.abs(turned).max(axis=1, keepdims=True)
            out[part, :, : self.width], out[part, :, self.width :] = (best - turned) ** 2, (best + turned) ** 2
        return out

    def reach(self, losses: np.ndarray, share: float) -> np.ndarray:
        """For each vector the loss within which `share` of all cells lie, by all of them or a fixed sample."""
        cells = (2 * self.width) ** self.hashes
        some = np.arange(cells) if cells <= SAMPLED_CELLS else np.random.Generator(np.random.PCG64(SEED)).integers(0, cells, SAMPLED_CELLS)
        cost = sum(loss[:, axis] for loss, axis in zip(losses, self.axes(some), strict=True))
        place = min(len(some) - 1, int(share * len(some)))
        return np.partition(cost, place, axis=1)[:, place] * np.float32(1 + 1e-5)


def _hadamard(x: np.ndarray) -> np.ndarray:
    """The fast transform, three steps of the butterfly at a time: each pass turns the last eight (or fewer) places of
    all rows and moves them to the front, so after the last pass every place is where it was."""
    n, width = x.shape
    left = width
    while left > 1:
        radix = min(8, left)
        small = np.ones((1, 1))
        while len(small) < radix:
            small = np.block([[small, small], [small, -small]])
        x = (x.reshape(-1, radix) @ small).reshape(n, width // radix, radix).swapaxes(1, 2).reshape(n, width)
        left //= radix
    return x / np.sqrt(width)


def _raw(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Packed vectors of one length as they are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(column), -1)


def _scaled(raw: np.ndarray) -> np.ndarray:
    """Vectors scaled by a power of two each: cosines stay as they are and nothing overflows."""
    x = raw.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(raw: np.ndarray) -> np.ndarray:
    x = _scaled(raw)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector of the rows that take part."""
    whole = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    kind = "array<float>" if isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "array<double>"
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("vec")).where("id is not null and vec is not null").where(whole)


def best_pairs(q: np.ndarray, c: np.ndarray, reps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query by exact cosine, of equal ones those with the smallest reps: rows, columns, scores."""
    out = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    norm_q, norm_c = (q * q).sum(axis=1), (c * c).sum(axis=1)
    unit_q, unit_c = q / np.sqrt(norm_q)[:, None], c / np.sqrt(norm_c)[:, None]
    step = max(1, (1 << 22) // max(1, len(c)))
    for at in range(0, len(q), step):
        near = unit_q[at : at + step] @ unit_c.T
        if len(c) > k:  # what rounding may have put below the k-th is scored as well
            row, col = np.nonzero(near >= np.partition(near, len(c) - k, axis=1)[:, len(c) - k, None] - 1e-9)
        else:
            row, col = (x.ravel() for x in np.indices(near.shape))
        row = row + at
        score = np.empty(len(row))
        for i in range(0, len(row), PAIRS):
            r, d = row[i : i + PAIRS], col[i : i + PAIRS]
            score[i : i + PAIRS] = (q[r] * c[d]).sum(axis=1) / np.sqrt(norm_q[r] * norm_c[d])
        order = np.lexsort((reps[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < k
        for x, v in zip(out, (row[keep], col[keep], score[keep]), strict=True):
            x.append(v)
    return tuple(np.concatenate(x) for x in out)


def _best(own: np.ndarray, col: np.ndarray, score: np.ndarray, reps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs of each query the k best, each once."""
    order = np.lexsort((col, reps[col], -score, own))
    own, col, score = own[order], col[order], score[order]
    fresh = np.append(True, (own[1:] != own[:-1]) | (col[1:] != col[:-1]))
    own, col, score = own[fresh], col[fresh], score[fresh]
    keep = np.arange(len(own)) - np.searchsorted(own, own) < k
    return own[keep], col[keep], score[keep]


def best_in_cells(turns: Rotations, table: int, q: np.ndarray, reach: np.ndarray, c: np.ndarray, cell: np.ndarray, reps: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k best candidates of each query by exact cosine among the cells within its reach: rows, columns, scores.

    A run of cells meets all queries that reach one of them in one product, in single precision. Pairs that may be
    among a query's best by that are scored exactly, and what it holds then bounds the pairs that come after.
    """
    order = np.argsort(cell, kind="stable")
    unit_c = np.empty(c.shape, np.float32)
    for at in range(0, len(c), 4096):
        unit_c[at : at + 4096] = _unit(c[order[at : at + 4096]])
    cells, first = np.unique(cell[order], return_index=True)
    axes = turns.axes(cells)
    # runs: one cell, or with three hashes some cells that differ in the last axis only
    heads = cells // (2 * turns.width if turns.hashes > 2 else 1)
    start = np.flatnonzero(np.append(True, heads[1:] != heads[:-1]))
    place = np.arange(len(cells)) - np.repeat(start, np.diff(np.append(start, len(cells))))
    start = np.flatnonzero(place % RUN_CELLS == 0)
    runs = list(zip(start.tolist(), np.append(start[1:], len(cells)).tolist(), first[start].tolist(), np.append(first[start[1:]], len(c)).tolist(), strict=True))
    margin = 1e-6 + 1e-7 * c.shape[1]
    step = max(64, min(1 << 13, COSTS // (2 * turns.width * turns.hashes)))
    for base in range(0, len(q), step):
        double = _unit(q[base : base + step])
        losses = np.ascontiguousarray(turns.losses(double, table).transpose(0, 2, 1))
        unit_q, limit = double.astype(np.float32), reach[base : base + step]
        exact_q = _scaled(q[base : base + step])
        norm_q = (exact_q * exact_q).sum(axis=1)
        floor = np.full(len(unit_q), -2, np.float32)
        held = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        rows, cols, nears, waiting = [], [], [], 0

        def settled(held, rows, cols, nears):
            row, col, near = np.concatenate(rows), order[np.concatenate(cols)], np.concatenate(nears)
            by = np.lexsort((-near, row))
            row, col, near = row[by], col[by], near[by]
            kth = np.searchsorted(row, row) + k - 1  # what is below the k-th by more than rounding is no answer
            at = np.minimum(kth, len(row) - 1)
            few = (row[at] != row) | (kth != at) | (near >= near[at] - np.float32(2 * margin))
            row, col = row[few], col[few]
            score = np.empty(len(row))
            for i in range(0, len(row), PAIRS):
                r, x = row[i : i + PAIRS], _scaled(c[col[i : i + PAIRS]])
                score[i : i + PAIRS] = (exact_q[r] * x).sum(axis=1) / np.sqrt(norm_q[r] * (x * x).sum(axis=1))
            held = _best(*(np.concatenate(x) for x in zip(held, (row, col, score), strict=True)), reps, k)
            full = np.flatnonzero(np.arange(len(held[0])) - np.searchsorted(held[0], held[0]) == k - 1)
            floor[held[0][full]] = held[2][full] - margin
            return held

        for a, b, lo, hi in runs:
            cost = losses[0][axes[0, a]]
            if turns.hashes > 1:
                cost = cost + losses[1][axes[1, a]]
            asks = np.flatnonzero(cost <= limit)
            if turns.hashes > 2 and len(asks):
                asks = asks[cost[asks] + losses[2][axes[2, a:b]][:, asks].min(axis=0) <= limit[asks]]
            if not len(asks):
                continue
            for at in range(lo, hi, 4096):  # a cell may hold many
                some = unit_c[at : min(hi, at + 4096)]
                few = max(1, (1 << 21) // len(some))
                for i in range(0, len(asks), few):
                    part = asks[i : i + few]
                    near = unit_q[part] @ some.T
                    row, col = np.nonzero(near >= floor[part, None])
                    if len(row):
                        nears.append(near[row, col])
                        rows.append(part[row])
                        cols.append(col + at)
                        waiting += len(row)
                    if waiting >= WAITING:
                        held = settled(held, rows, cols, nears)
                        rows, cols, nears, waiting = [], [], [], 0
        if rows:
            held = settled(held, rows, cols, nears)
        yield held[0] + base, held[1], held[2]


def _by_length(column: pa.Array, kind: str) -> Iterator[tuple[int, np.ndarray]]:
    """(dimension, places) of the packed vectors of each length."""
    size = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) // np.dtype(kind).itemsize
    for d in np.unique(size).tolist():
        yield d, np.flatnonzero(size == d)


def _slices(batches: Iterator[pa.RecordBatch], kind: str, plans: dict[int, tuple]) -> Iterator[tuple[pa.RecordBatch, int, Rotations, float, np.ndarray]]:
    """Slices of the batches that have one length, with that, its rotations, the share asked for, and unit vectors."""
    made: dict[int, Rotations] = {}
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            part = whole.slice(at, 1024)
            for d, places in _by_length(part.column("vec"), kind):
                tables, share, hashes = plans[d]
                turns = made.setdefault(d, Rotations(d, tables, hashes))
                some = pa.RecordBatch.from_arrays([c.take(pa.array(places)) for c in part.columns], part.schema.names)
                yield some, d, turns, share, _unit(_raw(some.column("vec"), kind))


def _same(n: int, value: int) -> pa.Array:
    return pa.array(np.full(n, value, np.int32))


FOUND = "q long, cls long, rep long, score double"


def _found(parts: list[tuple[np.ndarray, ...]]) -> pa.Table:
    cols = [np.concatenate([np.zeros(0, t), *(p[i] for p in parts)]) for i, t in enumerate((np.int64, np.int64, np.int64, np.float64))]
    return pa.table(dict(zip(("q", "cls", "rep", "score"), cols, strict=True)))


def _distinct(cls: np.ndarray, rep: np.ndarray) -> np.ndarray:
    """Places of one row for each class, that with the smallest id."""
    order = np.lexsort((rep, cls))
    return order[np.append(True, cls[order][1:] != cls[order][:-1])] if len(order) else order


def shards(counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards for each first axis: crowded axes are spread, neighbours with few vectors share one."""
    first, blocks = np.zeros(len(counts), np.int64), np.maximum(1, -(-counts // most))
    shard, room = -1, 0
    for axis, n in enumerate(counts.tolist()):
        if blocks[axis] > 1 or n > room:
            shard += 1
            room = most
        first[axis], room = shard, room - n
        if blocks[axis] > 1:
            shard, room = shard + int(blocks[axis]) - 1, 0
    return first, blocks


def _candidates(asked: DataFrame, ids: DataFrame, kind: str, plans: dict[int, tuple], sizes: dict[int, int], k: int) -> DataFrame:
    """q, cls, rep, score: the best few that each shard has for a query class."""
    width = np.dtype(kind).itemsize

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for _, d, turns, _, unit in _slices(batches, kind, plans):
            for table in range(turns.tables):
                n = np.bincount(turns.axes(turns.cells(unit, table))[0], minlength=2 * turns.width)
                total[d, table] = total.get((d, table), 0) + n
        for (d, table), n in total.items():
            axis = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([_same(len(axis), d), _same(len(axis), table), pa.array(axis), pa.array(n[axis])], ["d", "tab", "axis", "n"])

    # a row for each length, table and axis
    crowd = ids.select("vec").mapInArrow(counted, "d int, tab int, axis long, n long").groupBy("d", "tab", "axis").agg(F.sum("n").alias("n")).collect()
    dealt: dict[tuple, tuple] = {}
    for d, (tables, _, hashes) in plans.items():
        size = min(max(sizes[d] * d * width // 32, SHARD_BYTES[0]), SHARD_BYTES[1])
        for table in range(tables):
            counts = np.zeros(2 * Rotations(d, 1, 1).width, np.int64)
            for r in crowd:
                if (r["d"], r["tab"]) == (d, table):
                    counts[r["axis"]] = r["n"]
            dealt[d, table] = shards(counts, max(1, size // (d * width)))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, d, turns, _, unit in _slices(batches, kind, plans):
            n, cls = part.num_rows, part.column("cls").to_numpy()
            for table in range(turns.tables):
                first, blocks = dealt[d, table]
                cell = turns.cells(unit, table)
                axis = turns.axes(cell)[0]
                shard = first[axis] + (hashing.mixed(cls.view(np.uint64)) % blocks[axis].astype(np.uint64)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("cls"), part.column("rep"), part.column("vec"), _same(n, d), _same(n, table), pa.array(shard.astype(np.int32)), pa.array(cell)], ["cls", "rep", "vec", "d", "tab", "shard", "cell"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, d, turns, share, unit in _slices(batches, kind, plans):
            for at in range(0, part.num_rows, 256):
                for table in range(turns.tables):
                    first, blocks = dealt[d, table]
                    losses = turns.losses(unit[at : at + 256], table)
                    reach = turns.reach(losses, share)
                    has = np.zeros((len(first), int((first + blocks).max())), np.float32)
                    for axis, (a, n) in enumerate(zip(first.tolist(), blocks.tolist(), strict=True)):
                        has[axis, a : a + n] = 1
                    row, shard = np.nonzero((losses[0] <= reach[:, None]).astype(np.float32) @ has)
                    for i in range(0, len(row), 1 << 14):
                        r, to = row[i : i + (1 << 14)], shard[i : i + (1 << 14)]
                        owner, n = pa.array(r + at), len(r)
                        yield pa.RecordBatch.from_arrays([part.column("q").take(owner), part.column("vec").take(owner), _same(n, d), _same(n, table), pa.array(to.astype(np.int32)), pa.array(reach[r])], ["q", "vec", "d", "tab", "shard", "reach"])

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _found([])
        d, table = key[0].as_py(), key[1].as_py()
        tables, _, hashes = plans[d]
        cls, rep = right.column("cls").to_numpy(), right.column("rep").to_numpy()
        keep = _distinct(cls, rep)
        cls, rep, c = cls[keep], rep[keep], _raw(right.column("vec"), kind)
        c = c if len(keep) == len(c) and (keep[1:] > keep[:-1]).all() else c[keep]
        qi, reach = left.column("q").to_numpy(), left.column("reach").to_numpy()
        found = best_in_cells(Rotations(d, tables, hashes), table, _raw(left.column("vec"), kind), reach, c, right.column("cell").to_numpy()[keep], rep, k + 1)
        return _found([(qi[row], cls[col], rep[col], score) for row, col, score in found])

    cells = ids.mapInArrow(index, "cls long, rep long, vec binary, d int, tab int, shard int, cell long")
    probed = asked.select("q", "vec").mapInArrow(probe, "q long, vec binary, d int, tab int, shard int, reach float")
    of = ["d", "tab", "shard"]
    return probed.groupBy(*of).cogroup(cells.groupBy(*of)).applyInArrow(compare, FOUND)


def _among_all(asked: DataFrame, ids: DataFrame, kind: str, sizes: dict[int, int], k: int) -> DataFrame:
    """q, cls, rep, score: the best few of each block of all vectors."""
    width = np.dtype(kind).itemsize
    blocks = asked.sparkSession.createDataFrame([(d * width, max(1, -(-n * d * width // SHARD_BYTES[0]))) for d, n in sizes.items()], "d int, blocks int")
    every = asked.select("q", "vec", F.octet_length("vec").alias("d")).join(blocks, "d").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    dealt = ids.select("cls", "rep", "vec", F.octet_length("vec").alias("d")).join(blocks, "d").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")).drop("blocks")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _found([])
        cls, rep = right.column("cls").to_numpy(), right.column("rep").to_numpy()
        keep = _distinct(cls, rep)
        cls, rep = cls[keep], rep[keep]
        row, col, score = best_pairs(_scaled(_raw(left.column("vec"), kind)), _scaled(_raw(right.column("vec"), kind)[keep]), rep, k + 1)
        return _found([(left.column("q").to_numpy()[row], cls[col], rep[col], score)])

    return every.groupBy("d", "block").cogroup(dealt.groupBy("d", "block")).applyInArrow(compare, FOUND)


def nearest(vectors: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", plan=layout) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query row, by cosine; ties to the smaller id.

    `plan` gives tables, the share of cells asked for and hashes for a number of vectors and their length.
    """
    rows = usable(vectors, id_col, vector_col)
    kind = "<f4" if rows.schema["vec"].dataType.elementType == FloatType() else "<f8"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vec")
            raw = (lists.flatten().to_numpy(zero_copy_only=False).astype(kind) + np.dtype(kind).type(0)).tobytes()
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)) * np.dtype(kind).itemsize
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)], pa.binary())], ["id", "vec"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each class of a task, or a few with ever smaller ids: copies stay where they are read."""
        least: dict[int, int] = {}
        for batch in batches:
            cls, rep = batch.column("cls").to_numpy(), batch.column("rep").to_numpy()
            places = []
            for i, c, r in ((i, int(cls[i]), int(rep[i])) for i in _distinct(cls, rep).tolist()):
                if c not in least or r < least[c]:
                    least[c] = r
                    places.append(i)
            if places:
                yield batch.take(pa.array(places, pa.int64()))

    work = Workspace(vectors.sparkSession)
    rows = rows.mapInArrow(packed, "id long, vec binary").withColumn("cls", F.xxhash64("vec"))
    width = np.dtype(kind).itemsize
    # a class keeps its k + 1 smallest ids: no answer holds more of it, the query itself left out
    place = Window.partitionBy("cls").orderBy("id")
    keys = rows.select("cls", "id", F.octet_length("vec").alias("bytes")).distinct()
    members = written(keys.withColumn("r", F.row_number().over(place)).where(F.col("r") <= k + 1), "vector-members")
    sizes = {r["bytes"] // width: r["count"] for r in members.where("r = 1").groupBy("bytes").count().collect()}  # one row for each length
    members = members.select("cls", "id")
    ids = rows.select("cls", F.col("id").alias("rep"), "vec").mapInArrow(once, "cls long, rep long, vec binary")
    asked = work.written(rows.where(F.col("id") % query_every == 0).select(F.col("id").alias("query_id"), F.col("cls").alias("q"), "vec").distinct(), "vector-queries")
    plans = {d: plan(n, d) for d, n in sizes.items()}

    def classes(queries: DataFrame) -> DataFrame:
        return queries.groupBy("q").agg(F.first("vec").alias("vec"))

    def ranked(found: DataFrame, queries: DataFrame) -> DataFrame:
        best = found.groupBy("q", "cls").agg(F.max("score").alias("score"), F.min("rep").alias("rep"))
        order = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
        best = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
        # the classes' k + 1 smallest ids, the query's own id left out
        answers = queries.select("query_id", "q").join(best, "q").join(members, "cls").where(F.col("id") != F.col("query_id"))
        answers = answers.groupBy("query_id", "id").agg(F.max("score").alias("score"))
        final = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return answers.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")

    near = written(ranked(_candidates(classes(asked), ids, kind, plans, sizes, k), asked), "neighbours")
    got = near.groupBy("query_id").agg(F.count("*").alias("got"))
    short = work.written(asked.join(got.where(F.col("got") >= k), "query_id", "left_anti"), "short-queries")
    if not short.isEmpty():
        whole = written(ranked(_among_all(classes(short), ids, kind, sizes, k), short), "neighbours")
        near = near.join(short.select("query_id").distinct(), "query_id", "left_anti").unionByName(whole)
    return near
