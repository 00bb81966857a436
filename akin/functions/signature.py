"""MinHash signatures, their ids, sizes and bands."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from akin.config import PRIME, permutations
from akin.functions.text import id_set_and_bytes, list_array, starts_run

# Values permuted at a time: the (permutations x ids) block stays in cache.
CACHED = 32_768
# Ids of texts that are signed together, and of a text that is signed alone.
GROUP_IDS, ALONE = 1 << 16, 1 << 14


class Permuter:
    """Minimum of every permutation over a set of ids."""

    def __init__(self, coefficients: tuple[tuple[int, int], ...]):
        self.num_perm = len(coefficients)
        self.step = max(16, CACHED // self.num_perm)
        self.a, self.b = (np.array(c, dtype=np.uint64)[:, None] for c in zip(*coefficients))

    def sign(self, ids: np.ndarray) -> np.ndarray | None:
        if len(ids) == 0:
            return None
        prime, half = np.uint64(PRIME), np.uint64(31)
        base = np.asarray(ids).view(np.uint64) & prime
        low = np.full(self.num_perm, PRIME, dtype=np.uint32)
        held = [np.empty((self.num_perm, min(self.step, len(base))), dtype=kind) for kind in (np.uint64, np.uint64, np.uint32, np.uint32)]
        for start in range(0, len(base), self.step):
            part = base[start : start + self.step]
            value, high, folded, less = (block[:, : len(part)] for block in held)
            # a*x + b is below PRIME^2, so its halves (2^31 = 1 mod PRIME) add up to less than 2 PRIME: 32 bits, from
            # which the minimum with the wrapped difference takes off the last multiple.
            np.multiply(self.a, part, out=value)
            value += self.b
            np.right_shift(value, half, out=high)
            value &= prime
            value += high
            np.copyto(folded, value, casting="unsafe")
            np.subtract(folded, np.uint32(PRIME), out=less)
            np.minimum(low, np.minimum(folded, less, out=less).min(axis=1), out=low)
        return low.astype(np.int64)

    def values(self, ids: np.ndarray) -> np.ndarray:
        """Every permutation of every id, a row for each id."""
        prime, half = np.uint64(PRIME), np.uint64(31)
        a, b = self.a[:, 0], self.b[:, 0]
        out = np.empty((len(ids), self.num_perm), np.uint32)
        for start in range(0, len(ids), self.step):
            value = (ids[start : start + self.step].view(np.uint64) & prime)[:, None] * a
            value += b
            high = value >> half
            value &= prime
            value += high
            folded = value.astype(np.uint32)
            np.minimum(folded, folded - np.uint32(PRIME), out=out[start : start + self.step])
        return out

    def sign_together(self, sets: list[np.ndarray]) -> list[np.ndarray | None]:
        """``sign`` of each set; an id that several of them hold is permuted once."""
        every = np.concatenate(sets)
        order = np.argsort(every)
        every = every[order]
        starts = starts_run(every)
        if 2 * np.count_nonzero(starts) > len(every):
            del every, order, starts
            return [self.sign(found) for found in sets]
        at = np.empty(len(every), np.int32)
        at[order] = np.cumsum(starts, dtype=np.int32) - 1
        table, ends = self.values(every[starts]), np.cumsum([len(found) for found in sets])
        places = np.split(at, ends[:-1])
        return [table[own].min(axis=0).astype(np.int64) if len(own) else None for own in places]


def minhash(ids: Column, num_perm: int) -> Column:
    """MinHash signature of a set of ids; null for a missing or empty set.

    One Arrow batch per call: a grouped minimum per permutation in SQL would need the shingles
    as rows, a shuffle of many times the text, and ``num_perm`` aggregates over each of them.
    """
    permuter = Permuter(permutations(num_perm))

    @F.arrow_udf("array<bigint>")
    def sign(batch: pa.Array) -> pa.Array:
        rows = np.split(batch.flatten().to_numpy(zero_copy_only=False), _ends(batch))
        return list_array([permuter.sign(row) for row in rows])

    return sign(ids)


def _ends(batch: pa.Array) -> np.ndarray:
    return np.cumsum(batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))[:-1]


def text_signature(text: Column, k: int, num_perm: int, mode: str = "exact") -> Column:
    """Struct (n_shingles, shingle_bytes, sig) of a text, whose shingle set stays in the worker."""
    permuter = Permuter(permutations(num_perm))

    @F.arrow_udf("struct<n_shingles:bigint,shingle_bytes:bigint,sig:array<bigint>>")
    def sign(batch: pa.Array) -> pa.Array:
        return signed_texts(batch, k, mode, permuter)

    return sign(text)


def signed_texts(batch: pa.Array, k: int, mode: str, permuter: Permuter) -> pa.StructArray:
    """A bounded number of ids at a time: the sets of a batch are many times its texts. Texts share most short shingles."""
    counts, signatures = np.zeros((2, len(batch)), dtype=np.int64), []
    group: list[np.ndarray] = []
    size = 0
    for i, text in enumerate(batch):
        ids, n_bytes = id_set_and_bytes(text.as_py() or "", k, mode)
        counts[:, i] = len(ids), n_bytes
        if group and size + len(ids) > GROUP_IDS or len(ids) > ALONE:
            signatures += permuter.sign_together(group) if group else []
            group, size = [], 0
        if len(ids) > ALONE:
            signatures.append(permuter.sign(ids))
        else:
            group.append(ids)
            size += len(ids)
    signatures += permuter.sign_together(group) if group else []
    columns = [*(pa.array(column) for column in counts), list_array(signatures)]
    return pa.StructArray.from_arrays(columns, names=["n_shingles", "shingle_bytes", "sig"])


def prefix(sig: Column, num_perm: int) -> Column:
    """The signature a smaller number of permutations would have given."""
    return F.slice(sig, 1, num_perm)


def joined(sig: Column) -> Column:
    return F.array_join(sig.cast("array<string>"), ",")


def sig_id(sig: Column) -> Column:
    """Content id: SHA-256 of the signature."""
    return F.sha2(joined(sig), 256)


def sig_bytes(sig: Column) -> Column:
    """Size of a signature at 8 bytes per position."""
    return F.size(sig).cast("long") * 8


def band_buckets(sig: Column, bands: tuple[int, int]) -> Column:
    """One bucket per band: MD5 of the band's positions in order."""
    b, r = bands
    return F.transform(
        F.sequence(F.lit(0), F.lit(b - 1)),
        lambda band: F.md5(joined(F.slice(sig, band * r + 1, r))),
    )


def band_hashes(cell: Column, sig: Column, bands: tuple[int, int]) -> Column:
    """(key, check) of every band: two hashes of 64 bits of the cell, the band and its positions, for joining."""
    b, r = bands

    def hashed(band: Column) -> Column:
        part = F.slice(sig, band * r + 1, r)
        return F.struct(F.xxhash64(cell, band, part).alias("key"), F.xxhash64(F.lit(b), part, band, cell).alias("check"))

    return F.transform(F.sequence(F.lit(0), F.lit(b - 1)), hashed)


def shares_band(left: Column, right: Column, bands: tuple[int, int]) -> Column:
    """Whether two signatures agree on all positions of at least one band."""
    b, r = bands
    return F.exists(
        F.sequence(F.lit(0), F.lit(b - 1)),
        lambda band: F.slice(left, band * r + 1, r) == F.slice(right, band * r + 1, r),
    )
