"""Scoring by a bigram model with deleted interpolation.

Training counts of words and word pairs are taken over all training documents through `exchange`: each chunk sends
its distinct words and pairs with their counts and gets the corpus totals back. A pair's probability mixes its
maximum-likelihood estimate, the word's, and a uniform share, by weights that depend on how often the context occurs.
The weights come from expectation-maximisation on deleted counts: every training token is held out in turn, its own
occurrence taken off the counts it is predicted from. What EM sees of the corpus is a table of (context bucket,
rounded estimates) with the number of tokens in each cell, so its size is fixed while its counts cover everything.

A document is its words, with A-Z in lower case, and an end token; a null or empty text has the end token only.
Rows that repeat a document count and score each. Without training documents the uniform share is all. A null
doc_id has remainder 0. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import codec, exchange, hashing
from docloom.llm.batches import string_buffers
from docloom.llm.shared import id_hash, written

SLICE_BYTES = 2 << 20
END = np.uint64(0x5851F42D4C957F2D)
BEGIN = np.uint64(0x14057B7EF767814F)
PAIR_BASE = np.uint64(0xD1342543DE82EF95)
#: Context buckets: 0 for contexts seen once or never, then one for each doubling.
BUCKETS = 32
#: Estimates are rounded to half powers of two down to 2 ** -LEAST / 2; the last class is zero.
LEAST = 80
CLASSES = LEAST + 2
ROUNDS = 60
KINDS = 2  # words, pairs


class Tokens:
    """The tokens of a few documents: key of each token and of the pair with the one before it."""

    def __init__(self, docs: pa.Table):
        data, offsets = string_buffers(docs.column("text"))
        low = hashing.LOWER[data]
        starts, ends, upto = hashing.words(low, offsets)
        n = np.diff(upto)
        self.bounds = np.concatenate([[0], np.cumsum(n + 1)])
        last = self.bounds[1:] - 1
        self.word = np.empty(self.bounds[-1], np.uint64)
        inner = np.ones(len(self.word), bool)
        inner[last] = False
        self.word[inner] = hashing.word_hashes(low, starts, ends)
        self.word[last] = END
        before = np.empty_like(self.word)
        before[1:] = self.word[:-1]
        self.first = self.bounds[:-1]
        before[self.first] = BEGIN
        # pairs may meet by chance once in 2 ** 56; words keep all bits
        self.pair = hashing.mixed(before * PAIR_BASE + self.word) & ~np.uint64(0xFF)
        self.train = np.repeat(docs.column("train").to_numpy(zero_copy_only=False).astype(bool), n + 1)


def _tokens(docs: pa.Table) -> list[tuple[pa.Table, Tokens]]:
    return [(part, Tokens(part)) for part in exchange.doc_slices(docs, SLICE_BYTES)]


def _tally(parts: list[Tokens], kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a chunk in order, their training counts, and the place of each token's key."""
    keys, place = np.unique(np.concatenate([getattr(t, kind) for t in parts]), return_inverse=True)
    train = np.concatenate([t.train for t in parts])
    return keys, np.bincount(place[train], minlength=len(keys)).astype(np.uint64), place


def _count(buckets: int):
    def question(chunk: int, docs: pa.Table) -> pa.Table:
        parts = [t for _, t in _tokens(docs)]
        columns: list[dict[int, tuple]] = []
        for kind in ("word", "pair"):
            keys, counts, _ = _tally(parts, kind)
            columns.append({b: (codec.gaps(keys[i:j]), counts[i:j]) for b, i, j in exchange.split(keys, buckets)})
        none = np.zeros(0, np.uint64)
        both = sorted(columns[0].keys() | columns[1].keys())
        return exchange.rows(chunk, [(b, codec.pack(*columns[0].get(b, (none, none)), *columns[1].get(b, (none, none)))) for b in both])

    return question


TOTALS = "chunk int, bucket int, payload binary, types long, tokens long"


def _total(table: pa.Table) -> pa.Table:
    """Corpus totals for each chunk's keys in the order sent; the bucket's word types and tokens on its first row."""
    held = [codec.unpack(p) for p in table.column("payload").to_pylist()]
    sent: list[list[np.ndarray]] = [[] for _ in held]
    types = tokens = 0
    for kind in range(KINDS):
        keys = np.concatenate([codec.from_gaps(h[2 * kind]) for h in held])
        counts = np.concatenate([h[2 * kind + 1] for h in held]).astype(np.int64)
        distinct, place = np.unique(keys, return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, counts)
        if kind == 0:
            types, tokens = int((total > 0).sum()), int(total.sum())
        at = 0
        for i, h in enumerate(held):
            n = len(h[2 * kind])
            sent[i].append(total[place[at : at + n]].astype(np.uint64))
            at += n
    rows = len(held)
    columns = {"chunk": table.column("chunk"), "bucket": table.column("bucket"), "payload": pa.array([codec.pack(*s) for s in sent], pa.binary())}
    return pa.table(columns | {"types": pa.array([types] + [0] * (rows - 1), pa.int64()), "tokens": pa.array([tokens] + [0] * (rows - 1), pa.int64())})


def _known(parts: list[Tokens], sent: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of a chunk: count of the pair, of the context and of the word."""
    replies = [codec.unpack(p) for _, p in sorted(sent)]
    word_total, pair_total = (np.concatenate([r[k] for r in replies]).astype(np.int64) for k in range(KINDS))
    keys, _, place = _tally(parts, "word")
    c1 = word_total[place]
    _, _, place = _tally(parts, "pair")
    context = np.empty_like(c1)
    context[1:] = c1[:-1]
    # a document's first token follows the begin mark, which occurs as often as the end token
    end = word_total[np.searchsorted(keys, END)]
    shift, at = [], 0
    for t in parts:
        shift.append(t.first + at)
        at += len(t.word)
    context[np.concatenate(shift)] = end
    return pair_total[place], context, c1


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(count > 1, np.log2(np.maximum(count, 1)).astype(np.int64) + 1, 0), BUCKETS - 1)


def _class(p: np.ndarray) -> np.ndarray:
    """Rounded half powers of two; zero has the last class."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.rint(-2 * np.log2(np.maximum(p, 1e-300))), 0, LEAST), LEAST + 1).astype(np.int64)


def _deleted(tokens: int):
    def use(_: int, docs: pa.Table, sent: pa.Table) -> pa.Table:
        parts = [t for _, t in _tokens(docs)]
        pair, context, word = _known(parts, list(zip(sent.column("bucket").to_pylist(), sent.column("payload").to_pylist(), strict=True)))
        train = np.concatenate([t.train for t in parts])
        pair, context, word = pair[train], context[train], word[train]
        p2 = (pair - 1) / np.maximum(context - 1, 1)
        p1 = (word - 1) / max(tokens - 1, 1)
        cell = (context_bucket(context) * CLASSES + _class(p2)) * CLASSES + _class(p1)
        cells, n = np.unique(cell, return_counts=True)
        return pa.table({"cell": pa.array(cells, pa.int32()), "n": pa.array(n, pa.int64())})

    return use


def fit_weights(cells: np.ndarray, n: np.ndarray, types: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of pair, word and uniform estimates for each context bucket, by EM over the cells of held-out tokens."""
    bucket, rest = np.divmod(cells, CLASSES * CLASSES)
    p = np.stack([*(np.where(k > LEAST, 0.0, np.exp2(-k / 2)) for k in np.divmod(rest, CLASSES)), np.full(len(cells), 1 / (types + 1))])
    weights = np.tile(np.array([0.4, 0.4, 0.2]), (BUCKETS, 1))
    weights[0] = 0, 0.8, 0.2  # no pair is known to follow such a context
    for _ in range(rounds):
        share = weights[bucket].T * p
        share *= n / share.sum(axis=0)
        mass = np.stack([np.bincount(bucket, weights=s, minlength=BUCKETS) for s in share], axis=1)
        seen = mass.sum(axis=1) > 0
        weights[seen] = mass[seen] / mass[seen].sum(axis=1, keepdims=True)
    # no estimate may lose all weight: a new text holds words that training never had
    weights[:, 2] = np.maximum(weights[:, 2], 1e-6)
    return weights / weights.sum(axis=1, keepdims=True)


def _fit(types: int, chunks: int):
    def run(table: pa.Table) -> pa.Table:
        weights = fit_weights(table.column("cell").to_numpy().astype(np.int64), table.column("n").to_numpy(), types)
        return pa.table({"chunk": pa.array(range(chunks), pa.int32()), "bucket": pa.array([-1] * chunks, pa.int32()), "payload": pa.array([weights.tobytes()] * chunks, pa.binary())})

    return run


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _score(types: int, tokens: int):
    def use(_: int, docs: pa.Table, sent: pa.Table) -> pa.Table:
        held = list(zip(sent.column("bucket").to_pylist(), sent.column("payload").to_pylist(), strict=True))
        fitted = [p for b, p in held if b < 0]
        weights = np.frombuffer(fitted[0], np.float64).reshape(BUCKETS, 3) if fitted else np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))
        tables = _tokens(docs)
        parts = [t for _, t in tables]
        pair, context, word = _known(parts, [h for h in held if h[0] >= 0])
        mix = weights[context_bucket(context)]
        p = mix[:, 0] * (pair / np.maximum(context, 1)) + mix[:, 1] * (word / max(tokens, 1)) + mix[:, 2] / (types + 1)
        own, base, known = np.log10(p), np.log10((word + 1) / (tokens + types + 1)), word > 0
        ids, cut, at = [], [0], 0
        for table, t in tables:
            ids.append(table.column("doc_id").combine_chunks() if isinstance(table.column("doc_id"), pa.ChunkedArray) else table.column("doc_id"))
            cut += (t.bounds[1:] + at).tolist()
            at = cut[-1]
        begin = np.array(cut[:-1])
        sums = [np.add.reduceat(x, begin) for x in (known.astype(np.int64), base, own)]
        return pa.table({"doc_id": pa.concat_arrays(ids), "n_tokens": pa.array(np.diff(cut), pa.int64()), "n_known": pa.array(sums[0]), "base_score": pa.array(sums[1]), "score": pa.array(sums[2])})

    return use


def score_documents(docs: DataFrame, folds: int = 7, held_out: int = 2, chunk_bytes: int = exchange.CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    n = exchange.chunk_count(docs, chunk_bytes)
    chunks = exchange.chunked(docs, n).withColumn("train", id_hash("doc_id", folds) != held_out)
    totals = written(exchange.ask(chunks, _count(n)).groupBy("bucket").applyInArrow(_total, TOTALS), "ngram-totals")
    types, tokens = totals.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()

    replies = totals.select("chunk", "bucket", "payload")
    by_chunk = chunks.groupBy("chunk")
    cells = by_chunk.cogroup(replies.groupBy("chunk")).applyInArrow(lambda key, d, s: _deleted(tokens)(0, d, s), "cell int, n long")
    cells = cells.groupBy("cell").agg(F.sum("n").alias("n"))
    weights = cells.withColumn("all", F.lit(True)).groupBy("all").applyInArrow(_fit(types, n), "chunk int, bucket int, payload binary")  # cells are bounded in number
    scored = by_chunk.cogroup(replies.unionByName(weights).groupBy("chunk")).applyInArrow(lambda key, d, s: _score(types, tokens)(0, d, s), SCORES)
    return scored.select("doc_id", (id_hash("doc_id", folds) == held_out).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
