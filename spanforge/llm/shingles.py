"""Word shingles as 64-bit hashes, for the Python side of the near-duplicate operators."""

from __future__ import annotations

import numpy as np

from .common import held

# Odd multipliers of the positions in a shingle, from a fixed generator.
_RNG = np.random.default_rng(20240229)
_PLACES = _RNG.integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MEMO = 1 << 17


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class _Memo(dict):
    """Hashes of words, made when they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


class WordHashes:
    """64-bit hashes of words, remembered for at most MEMO distinct words and those of one text more."""

    def __init__(self):
        self.memo = _Memo()

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.memo) > MEMO:
            self.memo = _Memo()
        return np.fromiter(map(self.memo.__getitem__, words), dtype=np.uint64, count=len(words))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """Hashes by the worker's memo."""
    return held("words", WordHashes)(words)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, in order; one for the whole sequence if it is shorter, none if empty."""
    if len(hashes) == 0:
        return hashes
    if len(hashes) < n:
        return mix(_combine(hashes, len(hashes)) + np.uint64(len(hashes)))
    return mix(_combine(hashes, n))


def _combine(hashes: np.ndarray, n: int) -> np.ndarray:
    m = len(hashes) - n + 1
    out = hashes[:m] * _PLACES[0]
    for j in range(1, n):
        out = out + hashes[j : j + m] * _PLACES[j]
    return out
