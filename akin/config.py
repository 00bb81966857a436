"""Search parameters, band layout and the permutation family."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache
from hashlib import md5

import numpy as np

# Modulus of the permutation family, the Mersenne prime 2^31 - 1.
PRIME = (1 << 31) - 1


@dataclass(frozen=True)
class SearchConfig:
    """Parameters of one search run; ``content_size`` 0 means the whole corpus."""

    shingle_size: int = 4
    num_perm: int = 64
    threshold: float = 0.3
    n_results: int = 3
    query_divisor: int = 10
    content_size: int = 0
    n_keywords: int = 25
    seed: int = 42
    # Shingles of exactly ``shingle_size`` characters (``exact``) or of every length up to it (``upto``).
    shingle_mode: str = "exact"

    @property
    def bands(self) -> tuple[int, int]:
        return band_layout(self.threshold, self.num_perm)

    def with_(self, **changes) -> "SearchConfig":
        return replace(self, **changes)


@lru_cache(maxsize=None)
def band_layout(threshold: float, num_perm: int) -> tuple[int, int]:
    """Bands and rows per band that minimise false positives plus false negatives.

    A pair of similarity s shares a band with probability 1 - (1 - s^r)^b; the two error areas
    lie under that curve left of the threshold and above it right of the threshold.
    """
    step = 0.001
    left = np.arange(step / 2, threshold, step)
    right = np.arange(threshold + step / 2, 1.0, step)
    best, layout = float("inf"), (1, num_perm)
    for b in range(1, num_perm + 1):
        for r in range(1, num_perm // b + 1):
            false_pos = (1 - (1 - left**r) ** b).sum() * step
            false_neg = ((1 - right**r) ** b).sum() * step
            error = 0.5 * false_pos + 0.5 * false_neg
            if error < best:
                best, layout = error, (b, r)
    return layout


@lru_cache(maxsize=None)
def permutations(num_perm: int) -> tuple[tuple[int, int], ...]:
    """Coefficients (a, b) of x -> (a*x + b) mod PRIME, drawn from MD5 of the position.

    Position i does not depend on ``num_perm``: the family for a smaller number is a prefix of
    the larger one, so a signature can be shortened by slicing.
    """

    def draw(name: str) -> int:
        return 1 + int(md5(name.encode()).hexdigest()[:15], 16) % (PRIME - 1)

    return tuple((draw(f"a{i}"), draw(f"b{i}")) for i in range(num_perm))
