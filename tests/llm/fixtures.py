"""Small tables with the cases that bite, and brute-force versions of what the operators return."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk int, bucket int, score double, kept boolean"


def corpus(seed=7, n=60):
    """Random texts with exact and near copies, shared passages, empties, nulls, one long text and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 150))]
        if i % 6 == 0:
            words = list(base)
            for _ in range(i // 12):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        text = " ".join(words)
        if i % 5 == 1:
            text += "\n" + passage + "\t" + rng.choice(vocabulary)
        texts.append(text)
    texts += [texts[3], texts[3].upper(), "", None, " \n ", "x", "1 2 3", "aaaa " * 80, " ".join(rng.choice(vocabulary) for _ in range(4000)) + " " + passage, "😀 " * 60, "a  b c\x1cd"]
    rows = [(i, t, rng.choice(["aa", "bb", None]), "s", len(t or ""), 1, 2, 0.5, True) for i, t in enumerate(texts)]
    return rows


def words(text, lower=False):
    text = text or ""
    return WORD.findall(text.translate(UPPER) if lower else text)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()
