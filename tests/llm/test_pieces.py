"""Pieces are told apart in flat bytes; ids must stay those of the whole texts."""

import numpy as np
import pytest

from docloom.llm import tokenize
from tests.llm.test_tokens import plain

BYTES, WORDS = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/word_bpe_49k.json"
TEXTS = ["", " ", "ÿ ÿÿÿ.", " lead and trail ", "a\nb\n\nc \n d", "nul\x00 and\x00 \x00", " wide　blank   x", "same same same", "Ends, here; there: now. Ends,", "\n", "  ", "日本語 のテキスト", "x" * 3000]


@pytest.mark.parametrize("path, blanks", [(BYTES, True), (WORDS, False)])
def test_ids_of_odd_texts(path, blanks, monkeypatch):
    want = [plain(path, t) for t in TEXTS]
    for size in (1, 64, 1 << 21):  # how much is looked up at once changes nothing
        monkeypatch.setattr(tokenize, "SLICE_BYTES", size)
        ids, counts = tokenize.PieceEncoder(path, blanks, 4).encode(TEXTS)
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


def test_distinct_keys_rebuild_the_row():
    raw = "bÿb a a é bÿb".encode().replace(b" ", tokenize.PART) + tokenize.PART
    keys, place = tokenize.distinct(raw)
    assert len(set(keys)) == len(keys) == 3
    assert np.array(keys)[place].tolist() == ["bÿb", "a", "a", "é", "bÿb"]
