"""Sets of word shingles as arrays of 64-bit hashes, made for a whole text at a time."""

from __future__ import annotations

import numpy as np

_M = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bytes that are hashed at once; longer texts are cut between words, or inside one that is longer still.
_AT_ONCE = 1 << 18
with np.errstate(over="ignore"):
    _POWER = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(_AT_ONCE + 8, _M, np.uint64)]))
    _BACK = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(_AT_ONCE + 8, np.uint64(pow(int(_M), -1, 1 << 64)), np.uint64)]))


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed permutation of the 64-bit numbers that spreads their bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _A
        h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def _hashes(b: np.ndarray) -> np.ndarray:
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[b].astype(np.uint64) + np.uint64(1)) * _POWER[: len(b)], dtype=np.uint64)])
        return mix((sums[ends] - sums[starts]) * _BACK[starts])


def word_hashes(raw: bytes) -> np.ndarray:
    """A hash for each word (bytes between white space: space, tab to carriage return), A-Z in lower case."""
    b = np.frombuffer(raw, np.uint8)
    if len(b) <= _AT_ONCE:
        return _hashes(b)
    out, at = [], 0
    while at < len(b):
        end = min(len(b), at + _AT_ONCE)
        if end < len(b):
            spaces = np.flatnonzero(_SPACE[b[at:end]])
            if len(spaces):
                end = at + int(spaces[-1]) + 1
            else:  # a word longer than the chunk: hashed on its own, piece by piece
                over = np.flatnonzero(_SPACE[b[end:]])
                end = end + int(over[0]) if len(over) else len(b)
                h = np.zeros(1, np.uint64)
                for k in range(at, end, _AT_ONCE):
                    with np.errstate(over="ignore"):
                        h = mix(h * _M + _hashes(b[k : min(end, k + _AT_ONCE)])[:1])
                out.append(h)
                at = end
                continue
        out.append(_hashes(b[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(raw: bytes, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all n-word shingles; of the whole sequence if it has fewer words; none without words."""
    w = word_hashes(raw)
    if not len(w):
        return w
    with np.errstate(over="ignore"):
        width = min(n, len(w))
        h = np.full(len(w) - width + 1, np.uint64(width), np.uint64)
        for k in range(width):
            h = h * _M + w[k : len(w) - width + 1 + k]
    return np.unique(mix(h))
