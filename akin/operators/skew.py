"""Equi-join for keys that may hold a large share of the rows on either side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from akin.session import materialise

# A key with fewer rows is never dealt to several tasks.
SLICE_ROWS = 100_000


def hot_keys(side: DataFrame, keys: list[str], slices: str, slice_rows: int) -> DataFrame | None:
    """Keys with more rows than an average task has (``slice_rows`` at least), and their number of slices.

    Rows are counted with a partial aggregate, in jobs of their own: pass written tables, not long plans. With t tasks at most
    t keys can lie above the average, so the result has no more rows than that at any size of ``side``. None
    if the whole side has no more rows than a slice, when no key needs a count.
    """
    tasks = int(side.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_rows = side.count()
    if n_rows <= slice_rows:
        return None
    limit = max(slice_rows, n_rows // tasks)
    counts = side.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > limit)
    return counts.select(*keys, F.ceil(F.col("_rows") / limit).cast("long").alias(slices))


def _every(slices: str) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(slices, F.lit(1)).cast("long") - 1))


def _one(columns: list[str], slices: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.coalesce(slices, F.lit(1)))


def sliced_join(
    many: DataFrame, few: DataFrame, keys: list[str], row_id: str, slice_rows: int = SLICE_ROWS, unique: bool = False
) -> DataFrame:
    """Inner join that spreads the hot keys of both sides over several tasks.

    The rows of a key that is hot in ``many`` are dealt to slices by ``row_id`` and the matching rows of ``few`` are
    copied to each of them; the rows of a key that is hot in ``few`` are dealt by all their columns and
    those of ``many`` are copied. A key hot on both sides gets a grid of slices. With ``unique`` no key occurs twice in
    ``few``, so its rows are not counted. Hot keys are found once and written, for both sides to read.
    """
    one = F.lit(1).cast("long")
    own = hot_keys(many, keys, "_own", slice_rows)
    other = None if unique else hot_keys(few, keys, "_other", slice_rows)
    found = [] if own is None else [own.withColumn("_other", one)]
    found += [] if other is None else [other.withColumn("_own", one)]
    if not found:
        return many.join(few, keys)
    hot = reduce(DataFrame.unionByName, found).groupBy(*keys).agg(F.max("_own").alias("_own"), F.max("_other").alias("_other"))
    hot = F.broadcast(materialise(hot, "hot-keys"))
    left = many.join(hot, keys, "left").withColumn("_slice", _one([row_id], "_own"))
    left = left.withColumn("_copy", _every("_other")).drop("_own", "_other")
    right = few.join(hot, keys, "left").withColumn("_copy", _one(few.columns, "_other"))
    right = right.withColumn("_slice", _every("_own")).drop("_own", "_other")
    return left.join(right, [*keys, "_slice", "_copy"]).drop("_slice", "_copy")
