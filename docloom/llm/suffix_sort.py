"""Deep-shallow sorting of fixed-length suffixes of a byte buffer.

Shallow: multikey quicksort over digits of eight bytes, all segments of a level at once, to a set depth. Deep: the
suffixes of a segment share that many bytes; blind tries order what is left of them, looking only at the bytes where
they branch.
"""

from __future__ import annotations

import numpy as np

DIGIT = 8
#: Bytes that the shallow levels compare.
SHALLOW = 24


def _digits(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one big-endian number."""
    out = np.zeros(len(at), np.uint64)
    for k in range(DIGIT):
        out = (out << np.uint64(8)) | data[at + k]
    return out


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """Indices of equal strings together, the groups in order. All strings have the same length.

    Inner nodes hold the place of the byte that tells their children apart. A new string descends by those bytes
    alone, meets one leaf, and is compared once with it; the first difference says where it branches off.
    """
    leaves: dict[bytes, list[int]] = {}
    for i, s in enumerate(strings):
        leaves.setdefault(s, []).append(i)
    distinct = iter(leaves)
    root = next(distinct)
    width = len(root)
    for s in distinct:
        node = root
        while not isinstance(node, bytes):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        differ = int.from_bytes(s, "big") ^ int.from_bytes(node, "big")
        place = width - (differ.bit_length() + 7) // 8
        old = node[place]
        up, node = None, root
        while not isinstance(node, bytes) and node[0] < place:
            up, node = node, node[1][s[node[0]]]
        if not isinstance(node, bytes) and node[0] == place:
            node[1][s[place]] = s
            continue
        fresh = (place, {old: node, s[place]: s})
        if up is None:
            root = fresh
        else:
            up[1][s[up[0]]] = fresh
    ordered, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, bytes):
            ordered.append(leaves[node])
        else:
            stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
    return ordered


def deep_shallow(data: np.ndarray, at: np.ndarray, length: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of `length` bytes at the places `at`, and whether each equals the one before it.

    `data` reaches at least eight bytes beyond the last suffix.
    """
    shallow = min(shallow, length) // DIGIT * DIGIT
    order = np.arange(len(at))
    head = np.zeros(len(at), bool)  # true where a suffix differs from the one before it
    head[:1] = True
    for depth in range(0, shallow, DIGIT):
        segment = np.cumsum(head)
        size = np.bincount(segment)
        tied = np.flatnonzero(size[segment] > 1)
        if not len(tied):
            break
        digit = _digits(data, at[order[tied]] + depth)
        resort = np.lexsort((digit, segment[tied]))
        order[tied] = order[tied][resort]
        digit = digit[resort]
        change = np.ones(len(tied), bool)
        change[1:] = digit[1:] != digit[:-1]
        head[tied] |= change
    begin = np.flatnonzero(head)
    size = np.diff(np.append(begin, len(at)))
    raw = data.tobytes()
    places = at.tolist()
    for a, n in zip(begin[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        members = order[a : a + n].tolist()
        groups = blind_trie([raw[places[i] + shallow : places[i] + length] for i in members])
        if len(groups) > 1:
            order[a : a + n] = [members[i] for g in groups for i in g]
            cuts = np.cumsum([len(g) for g in groups])[:-1]
            head[a + cuts] = True
    return order, ~head
