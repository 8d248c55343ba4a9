"""Encoding with a vocabulary file of the tokenizers library, one distinct piece at a time.

A text is cut only where every pre-tokenizer of the two supported kinds cuts as well, so encoding the
pieces and joining their ids gives what encoding the whole text gives. Each distinct piece goes through the
library once and then comes from two bounded tables, of which the older goes when the younger is full.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from docloom.llm import workers
from docloom.llm.batches import string_buffers

#: Pieces that the two tables of a Python worker hold, about. When the younger one has half of them it becomes the older
#: one, whose pieces move back as they are met; what was not met meanwhile goes.
TABLE_PIECES = 600_000
#: Bytes of text that are encoded at once: each distinct piece among them is looked up once.
SLICE_BYTES = 1 << 21
#: Characters of one text that are in pieces at the same time.
SEGMENT_CHARS = 1 << 20
#: Pieces that go through the library in one call.
GROUP = 4096
#: Marks that the pre-tokenizers of both kinds part from a letter before them.
ENDS = frozenset(".,!?;:")
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")

#: Parts the keys of pieces; no byte of UTF-8.
PART = b"\xff"

_LOWER_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r ABCDEFGHIJKLMNOPQRSTUVWXYZ", 6 * PART + b"abcdefghijklmnopqrstuvwxyz")
_WHITE = [chr(c) for c in range(0x110000) if chr(c).isspace()]
_LINES = frozenset(" \n")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: `PART` in a text that was decoded with its bytes escaped.
_GAP = PART.decode("utf-8", "surrogateescape")


#: The key of one run of Latin letters, with or without a blank before it: a single pre-token of either kind.
_WORD = re.compile(r"\n?[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _visible_bytes() -> dict[int, int]:
    """Byte-level vocabularies spell each unprintable byte as the next free character from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


_VISIBLE = _visible_bytes()
_BLANK = chr(_VISIBLE[32])


def _segments(text: str) -> Iterator[str]:
    """The text in parts that end before a blank with no white space beside it."""
    start = 0
    while len(text) - start > SEGMENT_CHARS:
        cut = _CUT.search(text, start + SEGMENT_CHARS - 1)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def prefixed_pieces(text: str) -> bytes:
    """Keys of the pieces for byte-level pre-tokenizers, which give a blank to the word behind it.

    A key that begins with a line end stands for what follows it there, any other for itself behind a blank. A line end
    between two other marks is a piece of its own, so lines that meet do not make ever new pieces.
    """
    start = "\n"
    if text[:1] == " " and len(text) > 1 and not text[1].isspace():
        start, text = "", text[1:]
    other = [c for c in _WHITE if c in text]
    if text[:1].isspace() or text[-1:].isspace() or any(c + " " in text or " " + c in text for c in other):
        return (start + _CUT.sub(_GAP, text)).encode("utf-8", "surrogateescape")
    if "\n\n" not in text and _LINES.issuperset(other):
        text = text.replace("\n", " \n\n \n")
    return (start + text).encode().replace(b" ", PART)


def blank_pieces(text: str) -> bytes:
    """Keys of the pieces for pre-tokenizers that lower-case and drop white space: cut at the ASCII blanks."""
    return text.encode().translate(_LOWER_BLANKS)


def distinct(raw: bytes) -> tuple[list[str], np.ndarray]:
    """The distinct keys among `raw`, each with a `PART` behind it, and which of them stands at each place."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == PART[0]) + 1
    offsets = np.concatenate([[0], ends]).astype(np.int64)  # a text without a place to cut may pass 2 GB
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
    keys = string_buffers(coded.dictionary)[0].tobytes().decode("utf-8", "surrogateescape").split(_GAP)
    return keys[:-1], coded.indices.to_numpy()


class Table:
    """Distinct pieces and their ids, one after another."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {"": 0}  # only vocabularies that drop blanks have empty keys
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.used = 0

    def places(self, pieces: list[str]) -> np.ndarray:
        """Where each piece is; -1 for one that is not there."""
        return np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))

    def add(self, fresh: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        first, total = len(self.known), len(flat)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(fresh) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[self.used : self.used + total] = flat
        self.start[first + 1 : first + 1 + len(fresh)] = self.used + np.cumsum(size)
        self.used += total
        self.known.update(zip(fresh, range(first, first + len(fresh)), strict=True))

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, size = self.start[at], self.start[at + 1] - self.start[at]
        shift = np.repeat(begin - (np.cumsum(size) - size), size)
        return self.flat[shift + np.arange(len(shift))], size


class PieceEncoder:
    """Texts to token ids. `keeps_blanks`: the vocabulary is byte-level and blanks are part of tokens."""

    def __init__(self, path: str, keeps_blanks: bool, table_pieces: int = TABLE_PIECES):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model
        self.keeps_blanks = keeps_blanks
        self.alone = "\n" if keeps_blanks else ""  # the key of a mark without a blank
        self.pieces = prefixed_pieces if keeps_blanks else blank_pieces
        self.table_pieces = table_pieces
        self.young, self.old = Table(), Table()

    def _learn(self, fresh: list[str]) -> None:
        """Whole pieces go through the library in groups; a mark behind an ASCII letter is a token of its own."""
        ended = [p for p in fresh if p[-1] in ENDS and len(p) > 1 and p[-2] in LETTERS]
        marks = [self.alone + p[-1] for p in ended]
        plain = set(fresh).difference(ended)
        plain.update(p[:-1] for p in ended)
        plain.update(marks)
        whole = self._recalled(list(plain.difference(self.young.known)))
        is_word = [_WORD.fullmatch(p) is not None for p in whole]
        words = list(compress(whole, is_word))
        if words:
            flat, ends = array("I"), array("q", [0])  # no tokens are held, so none are there to be collected
            for p in words:
                flat.extend([t.id for t in self.model.tokenize(self._spelled(p))])
                ends.append(len(flat))
            self.young.add(words, np.frombuffer(flat, np.uint32), np.diff(np.frombuffer(ends, np.int64)))
        mixed = [p for p, w in zip(whole, is_word, strict=True) if not w]
        for k in range(0, len(mixed), GROUP):
            part = mixed[k : k + GROUP]
            code = self.tokenizer.encode_batch([list(map(self._piece, part))], is_pretokenized=True, add_special_tokens=False)[0]
            self.young.add(part, np.array(code.ids, np.uint32), np.bincount(np.array(code.word_ids, np.int64), minlength=len(part)))
        pairs = [(p, m) for p, m in zip(ended, marks, strict=True) if p not in self.young.known]
        if pairs:
            flat, size = self.young.gather(self.young.places([x for p, m in pairs for x in (p[:-1], m)]))
            self.young.add([p for p, _ in pairs], flat, size.reshape(-1, 2).sum(axis=1))

    def _piece(self, key: str) -> str:
        if not self.keeps_blanks:
            return key
        return key[1:] if key[0] == "\n" else " " + key

    def _spelled(self, key: str) -> str:
        """A word in the characters of the vocabulary; ASCII letters stand for themselves."""
        if not self.keeps_blanks:
            word = key.lower()
        else:
            word = key[1:] if key[0] == "\n" else _BLANK + key
            if key.isascii():
                return word
            word = self._piece(key)
        return word if word.isascii() else word.encode().decode("latin-1").translate(_VISIBLE)

    def _recalled(self, pieces: list[str]) -> list[str]:
        """Takes what the older table knows over into the younger; the pieces that neither knows."""
        at = self.old.places(pieces)
        there = at >= 0
        if there.any():
            self.young.add(list(compress(pieces, there.tolist())), *self.old.gather(at[there]))
        return list(compress(pieces, (~there).tolist()))

    def _encode_pieces(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row and how many each has."""
        if len(self.young.known) > self.table_pieces // 2:
            self.young, self.old = Table(), self.young
        pieces, place = distinct(raw)
        at = self.young.places(pieces)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            unknown = [pieces[i] for i in missing.tolist()]
            if fresh := self._recalled(unknown):
                self._learn(fresh)
            at[missing] = self.young.places(unknown)
        return self.young.gather(at[place])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the number of ids of each text."""
        counts = np.zeros(len(texts), np.int64)
        out: list[np.ndarray] = []
        pending: list[bytes] = []
        owners: list[int] = []
        held = 0

        def flush() -> None:
            if pending:
                ids, size = self._encode_pieces(PART.join(pending) + PART)
                out.append(ids)
                n = np.array([p.count(PART) + 1 for p in pending])
                np.add.at(counts, owners, np.add.reduceat(size, np.cumsum(n) - n))
            pending.clear()
            owners.clear()

        for k, text in enumerate(texts):
            if not text:
                continue
            for segment in _segments(text) if len(text) > SEGMENT_CHARS else (text,):
                pending.append(self.pieces(segment))
                owners.append(k)
                held += len(pending[-1])
                if held > 2 * SLICE_BYTES:
                    flush()
                    held = 0
        flush()
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), counts


def encoder(path: str, keeps_blanks: bool) -> PieceEncoder:
    """The worker's encoder for a vocabulary file; later tasks in the same worker find it filled."""
    return workers.hold(("vocabulary", path, keeps_blanks), lambda: PieceEncoder(path, keeps_blanks))
