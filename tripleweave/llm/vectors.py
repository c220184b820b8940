"""Vectorised text work in numpy: words, their hashes, shingles."""

from __future__ import annotations

import hashlib

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20_240_607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_P = int(_rng.integers(2**62, 2**63, dtype=np.uint64)) | 5
_Q = pow(_P, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Texts are worked on in pieces of about so many bytes, cut between words.
PIECE = 1 << 20
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        m = 1 << max(12, (n - 1).bit_length())
        _pow = np.concatenate([[U(1)], np.cumprod(np.full(m - 1, _P, np.uint64))])
        _inv = np.concatenate([[U(1)], np.cumprod(np.full(m - 1, _Q, np.uint64))])
    return _pow[:n], _inv[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def fold_case(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower()


def _hashes(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, np.uint8)
    gap = np.concatenate([[True], _SPACE[a], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(a))
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE[a] * power, out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + U(0x9E3779B97F4A7C15) * (end - start).astype(np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of data (runs of anything but ASCII white space), in order."""
    if len(data) <= PIECE:
        return _hashes(data)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        if end < len(data):
            cut = end
            while cut > at and not _SPACE[data[cut]]:
                cut -= 1
            if cut == at and not _SPACE[data[at]]:  # one word longer than a piece
                cut = at
                while cut < len(data) and not _SPACE[data[cut]]:
                    cut += 1
                out.append(np.array([int.from_bytes(hashlib.blake2b(data[at:cut], digest_size=8).digest(), "little")], np.uint64))
                at = cut
                continue
            end = cut if cut > at else at + 1
        out.append(_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


_SEQ = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of k consecutive words; with fewer words the whole sequence as one; none without words."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(k, n)
    h = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        h = h + words[j : n - size + 1 + j] * _SEQ[j]
    return np.unique(mix(h))
