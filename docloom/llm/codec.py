"""Compact columns of 64-bit numbers: byte planes, compressed."""

from __future__ import annotations

import struct

import numpy as np
import zstandard


def pack(*columns: np.ndarray) -> bytes:
    """uint64 columns of any lengths. Bytes of equal weight stand together, so what is zero costs next to nothing."""
    planes = (np.ascontiguousarray(c.view(np.uint8).reshape(len(c), 8).T).tobytes() for c in columns)
    return struct.pack(f"<H{len(columns)}Q", len(columns), *map(len, columns)) + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(payload: bytes) -> list[np.ndarray]:
    (n,) = struct.unpack_from("<H", payload)
    sizes = struct.unpack_from(f"<{n}Q", payload, 2)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[2 + 8 * n :], max_output_size=8 * sum(sizes) + 1), np.uint8)
    out, at = [], 0
    for size in sizes:
        out.append(np.ascontiguousarray(raw[at : at + 8 * size].reshape(8, size).T).view(np.uint64).ravel())
        at += 8 * size
    return out


def gaps(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted keys, the first one from zero."""
    return np.diff(keys, prepend=np.uint64(0))


def from_gaps(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=np.uint64)
