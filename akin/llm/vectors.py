"""Embedding rows that can be compared: one for each id, finite, without nulls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(embedding: Column) -> Column:
    """Whether a vector is present and all its components are finite numbers."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(embedding.isNotNull() & ~odd & (F.size(embedding) > 0), F.lit(False))


def one_per_id(rows: DataFrame) -> DataFrame:
    """vec_id, embedding of the usable rows. Of several vectors of one id the smallest counts; null ids are left out."""
    good = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    good = good.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    return good.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
