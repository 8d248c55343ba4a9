"""Substring dedup by seed and extend.

Documents are sequences of words. Every window of `WINDOW` words has one winnowed anchor, its least hashed run of
`GRAM` words. Chunks of documents join on anchors: only anchors that occur twice anywhere are seeds. Each seed is
extended both ways to all windows that chose it, the windows are joined in turn, and windows whose words occur twice
or more anywhere, the same document included, run together into maximal repeats. Words in a repeat are removed.

Both joins go through `exchange`: a common passage is one entry for each chunk. A document with null or empty text
has no words; one of fewer words than a window loses none. Repeated rows are repeats of each other; each row has its
result. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import exchange, hashing
from docloom.llm.batches import string_buffers

WINDOW = 35
GRAM = 8
SLICE_BYTES = 1 << 20


class Words:
    """The words of a few documents with the hashes of their windows."""

    def __init__(self, docs: pa.Table, window: int):
        self.data, self.offsets = string_buffers(docs.column("text"))
        self.starts, self.ends, self.upto = hashing.words(self.data, self.offsets)
        self.rolling = hashing.Rolling(hashing.word_hashes(self.data, self.starts, self.ends), hashing.WORD_BASE)
        self.doc = np.repeat(np.arange(len(self.upto) - 1), np.diff(self.upto))
        n = len(self.starts) - window + 1
        self.valid = np.flatnonzero(self.doc[:n] == self.doc[window - 1 :]) if n > 0 else np.zeros(0, np.int64)
        self.window = window

    def windows(self) -> np.ndarray:
        """Hash of each whole window within one document, in the order of `valid`."""
        return self.rolling.runs(self.valid, self.valid + self.window)

    def anchors(self, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window's anchor, in the order of `valid`, and whether the window is the first with it."""
        grams = self.rolling.every(gram)
        place = hashing.anchors(grams, self.window - gram + 1)[self.valid]
        fresh = np.ones(len(place), bool)
        fresh[1:] = place[1:] != place[:-1]
        return grams[place], fresh


def _seeds(window: int, gram: int, buckets: int):
    def question(chunk: int, docs: pa.Table) -> pa.Table:
        keys = []
        for part in exchange.doc_slices(docs, SLICE_BYTES):
            found, fresh = Words(part, window).anchors(gram)
            keys.append(found[fresh])
        return exchange.presence(chunk, np.concatenate(keys) if keys else np.zeros(0, np.uint64), buckets)

    return question


def _extensions(window: int, gram: int, buckets: int):
    def use(chunk: int, docs: pa.Table, sent: list[bytes]) -> pa.Table:
        seeds, keys = exchange.keys_in(sent), [np.zeros(0, np.uint64)]
        for part in exchange.doc_slices(docs, SLICE_BYTES) if len(seeds) else ():
            w = Words(part, window)
            found, _ = w.anchors(gram)
            keys.append(w.windows()[hashing.within(found & ~np.uint64(1), seeds)])
        return exchange.presence(chunk, np.concatenate(keys), buckets)

    return use


def removed_words(w: Words, again: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window whose hash is in the sorted set `again`."""
    hit = w.valid[hashing.within(w.windows() & ~np.uint64(1), again)]
    edge = np.zeros(len(w.starts) + 1, np.int32)
    edge[hit] += 1
    edge[hit + w.window] -= 1  # starts differ, so no place is met twice
    return np.cumsum(edge)[:-1] > 0


def _repeated_windows(chunks: DataFrame, n: int, window: int, gram: int) -> DataFrame:
    seeds = exchange.repeated(exchange.ask(chunks, _seeds(window, gram, n)))
    return exchange.repeated(exchange.with_answers(chunks, seeds, _extensions(window, gram, n), exchange.QUESTION))


def _kept(part: pa.Table, w: Words, gone: np.ndarray):
    """For each document: its place, words, words lost and the kept words joined by one blank."""
    raw = w.data.tobytes()
    total = np.concatenate([[0], np.cumsum(gone)])
    lost = total[w.upto[1:]] - total[w.upto[:-1]]
    for i in range(part.num_rows):
        a, b = int(w.upto[i]), int(w.upto[i + 1])
        left = a + np.flatnonzero(~gone[a:b])
        yield i, b - a, int(lost[i]), b" ".join([raw[s:e] for s, e in zip(w.starts[left].tolist(), w.ends[left].tolist(), strict=True)])


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, chunk_bytes: int = exchange.CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    n = exchange.chunk_count(docs, chunk_bytes)
    chunks = exchange.chunked(docs, n)

    def result(_: int, table: pa.Table, sent: list[bytes]) -> pa.Table:
        again, out = exchange.keys_in(sent), []
        for part in exchange.doc_slices(table, SLICE_BYTES):
            w, ids = Words(part, window), part.column("doc_id").to_pylist()
            out += [(ids[i], words, lost, hashlib.sha256(kept).hexdigest()) for i, words, lost, kept in _kept(part, w, removed_words(w, again))]
        kinds = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}
        return pa.table({name: pa.array([row[k] for row in out], kind) for k, (name, kind) in enumerate(kinds.items())})

    return exchange.with_answers(chunks, _repeated_windows(chunks, n, window, gram), result, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, chunk_bytes: int = exchange.CHUNK_BYTES) -> DataFrame:
    """The rows of `docs` with all their columns, repeats cut from the text; `n_chars`, if there, follows the text.

    A text that loses nothing stays as it is; of another the kept words are joined by one blank.
    """
    n = exchange.chunk_count(docs, chunk_bytes)
    chunks = exchange.chunked(docs, n, docs.columns)

    def result(_: int, table: pa.Table, sent: list[bytes]) -> pa.Table:
        again, out = exchange.keys_in(sent), []
        for part in exchange.doc_slices(table, SLICE_BYTES):
            w, texts = Words(part, window), part.column("text").to_pylist()
            cut = [kept.decode("utf-8", "replace") if lost else texts[i] for i, _, lost, kept in _kept(part, w, removed_words(w, again))]
            out.append(pa.table({"rest": part.column("rest"), "kept": pa.array(cut, pa.string())}))
        return pa.concat_tables(out)

    rest = chunks.schema["rest"].dataType.simpleString()
    cut = exchange.with_answers(chunks, _repeated_windows(chunks, n, window, gram), result, f"rest {rest}, kept string")
    text = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return cut.select(*(text[c].alias(c) if c in text else F.col("rest")[c].alias(c) for c in docs.columns))
