"""Word shingles of whole texts as 64-bit numbers, and their MinHash signatures."""

from __future__ import annotations

import numpy as np
import xxhash

from akin.llm.tables import kept

WORDS = 5
MEMO_WORDS = 1 << 16
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64)) for i in range(WORDS)]
MIX = np.uint64(0xD6E8FEB86659FD93)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _word_hashes() -> _WordHashes:
    return kept("word hashes", _WordHashes)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, memo: dict[bytes, int] | None = None) -> np.ndarray:
    """The distinct shingles of a text, in order: of WORDS words, or of all its words if they are fewer.

    A-Z are lower-cased; words are split at the ASCII white space. No word, no shingle.
    """
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    memo = _word_hashes() if memo is None else memo
    hashes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total += hashes[i : i + n] * FACTORS[i]
    return np.unique(_mixed(total))


def coefficients(n: int, seed: int = 11) -> np.ndarray:
    """Odd multipliers of ``n`` signature coordinates."""
    return np.random.default_rng(seed).integers(1 << 62, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For each coordinate the smallest 32-bit hash of the shingles."""
    out = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 1024):
        np.minimum(out, np.multiply.outer(found[at : at + 1024], factors).min(0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)
