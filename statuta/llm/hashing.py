"""Rolling 64-bit fingerprints of word n-grams, vectorised over one text."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
CHUNK = 1 << 16

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """BASE**k and its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(BASE, k, MASK + 1))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(pow(BASE, -1, MASK + 1), k, MASK + 1))])
        return self.up, self.down


POWERS = Powers()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words_of(text: str | None, lower: bool = True) -> list[bytes]:
    """Words between ASCII white space; only A-Z are lower-cased."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.translate(LOWER) if lower else data).split()


def ngram_hashes(words: list[bytes], width: int) -> np.ndarray:
    """One fingerprint per run of `width` words, in order; none if there are fewer words."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    ends = starts + lengths
    up, down = POWERS.get(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[data] * up[: len(data)])])
    a, b = starts[:n], ends[width - 1 :]
    return mixed((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct fingerprints of a text's word shingles; shorter texts are one shingle, blank ones have none."""
    words = words_of(text)
    return np.unique(ngram_hashes(words, min(width, len(words)))) if words else np.zeros(0, np.uint64)
