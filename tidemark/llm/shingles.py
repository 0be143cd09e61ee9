"""Word shingles of a text as 64-bit hashes, computed over whole arrays of bytes."""

from __future__ import annotations

import numpy as np

SHINGLE_WORDS = 5
_RADIX = 0x9E3779B97F4A7C15 | 1
_SALT = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Powers:
    """Powers of the radix and of its inverse modulo 2**64, as far as a text has needed them."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = pow(_RADIX, -1, 1 << 64)
            for name, base in (("up", _RADIX), ("down", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.multiply.accumulate(steps))
        return cls.up[:n], cls.down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingles: runs of five words with A-Z lower-cased, words being
    stretches without ASCII blanks; of fewer words the whole sequence; none without words."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    up, down = _Powers.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_SALT[data] * up[:-1], out=sums[1:])
    spaces = np.flatnonzero(data == 32)
    starts = np.concatenate(([0], spaces + 1))
    ends = np.concatenate((spaces, [len(data)]))
    k = min(SHINGLE_WORDS, len(words))
    a, b = starts[: len(starts) - k + 1], ends[k - 1 :]
    return np.unique(mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)))
