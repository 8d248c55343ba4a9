"""Language identification by cross-parsing entropy.

A suffix automaton of each language's labelled text gives the longest match at any place of a query. Parsing a text
greedily into longest matches takes few phrases in its own language and many in others; phrases times the logarithm
of the model's length, over the text's length, estimates the cross entropy, and the language with the least wins.
Texts are folded to lower-case letters and single blanks and parsed whole, in segments side by side.

The automata are fitted on a bounded sample of labelled rows: `TRAIN_ROWS` for each language. Of a row with more than
`TRAIN_CHARS_PER_ROW` characters, `PASSAGES` passages at hashed places, spread over the whole of it, are taken. Two
languages that need equally many bits are told apart by name, the first in order wins. A text that is null, or has no letter, or meets no
learned language is `und` with score 0. Rows that repeat a document are judged alike. Only the id, the text and, in
training, the label are read.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm import workers
from docloom.llm.batches import slices
from docloom.llm.shared import id_hash

TRAIN_ROWS = 60
TRAIN_CHARS_PER_ROW = 1000
PASSAGES = 4
#: Folded characters in one segment; a phrase ends where a segment does, so a parse has at most one phrase too many for each.
SEGMENT = 1024
SLICE_BYTES = 1 << 20
#: Cells of an automaton's dense table; one with more states times letters is kept as sorted transitions.
DENSE_CELLS = 1 << 24
UNKNOWN = "und"

_fold_table: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """For each code point its lower-case letter, or a blank for what is no letter or mark."""
    global _fold_table
    if _fold_table is None:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))
            if kind[0] in "LM":
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _fold_table = table
    return _fold_table


def folded(text: str) -> np.ndarray:
    """Code points of the folded text: letters in lower case, other runs as one blank, none at the ends."""
    points = fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = points == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    points = points[keep]
    return points[: len(points) - 1] if len(points) and points[-1] == 32 else points


class Automaton:
    """Suffix automaton of several texts as one dense table, or as sorted transitions if that were too large: state 0 is dead, 1 is the start."""

    def __init__(self, texts: list[np.ndarray], alphabet: int, dense_cells: int = DENSE_CELLS):
        follow: list[dict[int, int]] = [{}, {}]
        link, length = [0, 0], [0, 0]
        self.size = sum(map(len, texts))
        for text in texts:
            last = 1
            for c in text.tolist():
                if c == 0:
                    last = 1
                    continue
                known = follow[last].get(c)
                if known is not None and length[known] == length[last] + 1:
                    last = known
                    continue
                if known is None:
                    new = len(follow)
                    follow.append({})
                    link.append(1)
                    length.append(length[last] + 1)
                else:
                    new = 0
                p, q = last, 0
                while p and (q := follow[p].get(c, 0)) == 0:
                    follow[p][c] = new
                    p = link[p]
                end = 1
                if p:
                    q = follow[p][c]
                    end = q
                    if length[q] != length[p] + 1:
                        end = len(follow)
                        follow.append(dict(follow[q]))
                        link.append(link[q])
                        length.append(length[p] + 1)
                        link[q] = end
                        while p and follow[p].get(c) == q:
                            follow[p][c] = end
                            p = link[p]
                if new:
                    link[new] = end
                    last = new
                else:
                    last = end
        self.width = alphabet
        self.start = np.zeros(alphabet, np.int32)
        self.start[list(follow[1])] = list(follow[1].values())
        edges = sum(map(len, follow))
        key = np.fromiter((s * alphabet + c for s, d in enumerate(follow) for c in d), np.int64, edges)
        to = np.fromiter((t for d in follow for t in d.values()), np.int32, edges)
        self.table = None
        if len(follow) * alphabet <= dense_cells:
            self.table = np.zeros(len(follow) * alphabet, np.int32)
            self.table[key] = to
        else:
            order = np.argsort(key)
            self.keys, self.to = key[order], to[order]

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[state * self.width + c]
        key = state.astype(np.int64) * self.width + c
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], np.int32(0))

    def phrases(self, lanes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of the greedy parse of each lane; lanes are columns, longest first."""
        start = self.start
        restart = np.where(start == 0, 1, start).astype(np.int32)
        alone = (start == 0).astype(np.int32)
        state, count = np.ones(lanes.shape[1], np.int32), np.zeros(lanes.shape[1], np.int32)
        active = np.searchsorted(-lengths, -np.arange(len(lanes)), "left")
        for t in range(len(lanes)):
            n = active[t]
            c, s = lanes[t, :n], state[:n]
            after = self.step(s, c)
            dead = after == 0
            count[:n] += dead & (s != 1)
            count[:n] += np.where(dead, alone[c], 0)
            state[:n] = np.where(dead, restart[c], after)
        return count + (state != 1)


class Identifier:
    """The automata of all languages, each over the letters of its own training text; any other matches nothing in it."""

    def __init__(self, samples: dict[str, list[str]], dense_cells: int = DENSE_CELLS):
        texts = {lang: parts for lang, rows in sorted(samples.items()) if (parts := [p for p in map(folded, rows) if len(p)])}
        self.langs = list(texts)
        points = np.unique(np.concatenate([p for ps in texts.values() for p in ps])) if texts else np.zeros(0, np.int64)
        self.codes = np.zeros(0x110000, np.min_scalar_type(len(points)))
        self.codes[points] = np.arange(1, len(points) + 1)
        self.models, self.own = [], []
        for x in self.langs:
            parts = [self.codes[p] for p in texts[x]]
            known = np.unique(np.concatenate(parts))
            own = np.zeros(len(points) + 1, self.codes.dtype)
            own[known] = np.arange(1, len(known) + 1)
            self.own.append(own)
            self.models.append(Automaton([own[p] for p in parts], len(known) + 1, dense_cells))
        self.bits = np.array([np.log2(max(2, m.size)) for m in self.models])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        parts = [folded(t) if t else np.zeros(0, np.uint32) for t in texts]
        size = np.array([len(p) for p in parts], np.int64)
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs or not size.sum():
            return langs, scores
        flat = self.codes[np.concatenate(parts)]
        segments = -(-size // SEGMENT)
        doc = np.repeat(np.arange(len(size)), segments)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(segments) - segments, segments)
        begin = (np.cumsum(size) - size)[doc] + k * SEGMENT
        length = np.minimum(size[doc] - k * SEGMENT, SEGMENT)
        order = np.argsort(-length, kind="stable")
        doc, begin, length = doc[order], begin[order], length[order]
        flat = np.concatenate([flat, np.zeros(SEGMENT, flat.dtype)])
        lanes = np.ascontiguousarray(flat[begin[None, :] + np.arange(int(length[0]))[:, None]])
        entropy = np.zeros((len(self.langs), len(size)))
        for i, model in enumerate(self.models):
            phrases = np.bincount(doc, weights=model.phrases(self.own[i][lanes], length), minlength=len(size))
            entropy[i] = phrases * self.bits[i] / np.maximum(size, 1)
        best = entropy.argmin(axis=0)
        weight = np.exp2(entropy.min(axis=0) - entropy)
        share = 1.0 / weight.sum(axis=0)
        for i in np.flatnonzero(size):
            langs[i] = self.langs[best[i]]
        return langs, np.where(size > 0, share, 0.0)


def training_sample(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS_PER_ROW, folds: int = 5, held_out: int = 0) -> dict[str, list[str]]:
    """Passages of labelled texts outside the held-out fold: of each language the first `rows` in the order of hashed ids."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (id_hash("doc_id", folds) != held_out))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    # a long text is cut into as many parts as passages; each passage lies somewhere in its part
    size, part = chars // PASSAGES, F.floor(F.length("text") / PASSAGES).cast("int")
    places = [F.col("text").substr(k * part + F.pmod(F.xxhash64("doc_id", F.lit(k)), part - size + 1).cast("int") + 1, F.lit(size)) for k in range(PASSAGES)]
    passages = F.when(F.length("text") <= chars, F.array("text")).otherwise(F.array(*places))
    picked = labelled.select("lang", "doc_id", "text").withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows).select("lang", "r", passages.alias("passages"))
    samples: dict[str, list[str]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r["lang"], r["r"])):
        samples.setdefault(r["lang"], []).extend(r["passages"])
    return samples


def _model(key: int, samples: dict[str, list[str]]) -> Identifier:
    return workers.hold(("languages", key), lambda: Identifier(samples))


def _shared(docs: DataFrame, samples: dict[str, list[str]]):
    return docs.sparkSession.sparkContext.broadcast(samples), zlib.crc32(repr(sorted(samples.items())).encode("utf-8", "surrogatepass"))


def identify(docs: DataFrame, samples: dict[str, list[str]]) -> DataFrame:
    """doc_id, lang_pred and score of each row."""
    shared, key = _shared(docs, samples)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(key, shared.value)
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                langs, scores = model.predict(rows.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def recognised(docs: DataFrame, samples: dict[str, list[str]]) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text is in a learned language."""
    shared, key = _shared(docs, samples)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(key, shared.value)
        for batch in batches:
            for rows in slices(batch, "text", SLICE_BYTES):
                langs, _ = model.predict(rows.column("text").to_pylist())
                yield rows.filter(pa.array([x != UNKNOWN for x in langs], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def language_of(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned outside the held-out fold."""
    found = identify(docs, training_sample(docs))
    return found.select("doc_id", (id_hash("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
