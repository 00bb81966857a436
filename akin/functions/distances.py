"""Pair-level similarities and distances."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard_sets(left: Column, right: Column) -> Column:
    """Shared over united elements of two sets; null when both are empty. Their union is counted, not built."""
    return jaccard_counts(F.size(F.array_intersect(left, right)), F.size(left), F.size(right))


def jaccard_counts(shared: Column, left: Column, right: Column) -> Column:
    """Jaccard from the three counts; null when both sets are empty."""
    return shared.cast("double") / F.nullif(left + right - shared, F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def equal_positions(left: Column, right: Column) -> Column:
    same = F.zip_with(left, right, lambda x, y: (x == y).cast("long"))
    return F.aggregate(same, F.lit(0).cast("long"), lambda total, x: total + x)


def jaccard_estimate(left: Column, right: Column) -> Column:
    """Fraction of equal signature positions."""
    return equal_positions(left, right).cast("double") / F.size(left)


def hamming(left: Column, right: Column) -> Column:
    """Fraction of differing signature positions."""
    return (F.size(left) - equal_positions(left, right)).cast("double") / F.size(left)


def xor(left: Column, right: Column) -> Column:
    """Element-wise exclusive or: a vector."""
    return F.zip_with(left, right, lambda x, y: x.bitwiseXOR(y))


def cosine(left: Column, right: Column) -> Column:
    """One minus the cosine of the angle between two vectors."""

    def dot(x: Column, y: Column) -> Column:
        return _sum(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))

    return 1 - dot(left, right) / (F.sqrt(dot(left, left)) * F.sqrt(dot(right, right)))


def euclidean(left: Column, right: Column) -> Column:
    """Length of the difference of two vectors."""
    return F.sqrt(
        _sum(F.zip_with(left, right, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))))
    )


def norm(values: Column) -> Column:
    """Length of a vector."""
    return F.sqrt(_sum(F.transform(values, lambda x: x.cast("double") * x.cast("double"))))


def metrics(left: Column, right: Column, left_norm: Column, right_norm: Column) -> Column:
    """Struct of the four metrics that are numbers, of vectors of one length whose norms are known: a batch is two matrices."""

    @F.arrow_udf("struct<jaccard:double,cosine:double,hamming:double,euclidean:double>")
    def compare(left: pa.Array, right: pa.Array, left_norm: pa.Array, right_norm: pa.Array) -> pa.Array:
        a, b = (side.flatten().to_numpy(zero_copy_only=False).reshape(len(side), -1) for side in (left, right))
        width = max(1, a.shape[1])
        equal = (a == b).sum(axis=1)
        a, b = a.astype(np.float64), b.astype(np.float64)
        lengths = left_norm.to_numpy(zero_copy_only=False) * right_norm.to_numpy(zero_copy_only=False)
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = 1 - np.einsum("ij,ij->i", a, b) / lengths
        a -= b
        columns = [equal / width, cosine, (width - equal) / width, np.sqrt(np.einsum("ij,ij->i", a, a))]
        return pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns], ["jaccard", "cosine", "hamming", "euclidean"])

    return compare(left, right, left_norm, right_norm)


def pct_change(current: Column, previous: Column) -> Column:
    """Relative difference in percent: equal values give 100, a zero base gives 0."""
    return (
        F.when(current == previous, F.lit(100.0))
        .when(previous == 0, F.lit(0.0))
        .otherwise(F.abs(current - previous) / previous * 100.0)
    )
