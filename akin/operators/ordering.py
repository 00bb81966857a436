"""Reproducible shuffles, samples and train/query splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Hex digits of the shuffle key and of the bucket they start with: 16^3 = 4096 buckets. The
# offsets table has one row per bucket whatever the corpus size, so it may be broadcast; the
# buckets hold equal shares of a corpus because they are cut from a hash of unique ids.
KEY_DIGITS = 15
BUCKET_DIGITS = 3


def order_key(id_col: str = "doc_id", seed: int | str | Column = 42) -> Column:
    """Sort key of the seeded permutation; documents are ordered by (order_key, id)."""
    start = seed if isinstance(seed, Column) else F.lit(seed)
    digest = F.md5(F.concat(start.cast("string"), F.lit(":"), F.col(id_col).cast("string")))
    return F.conv(F.substring(digest, 1, KEY_DIGITS), 16, 10).cast("long")


def shuffled(
    df: DataFrame, id_col: str = "doc_id", seed: int | str | Column = 42, by: Sequence[str] = ()
) -> DataFrame:
    """Add ``pos``, the 1-based place in a seeded permutation, and ``n_docs``.

    Places are counted per bucket and moved by the bucket's offset, so no task sorts more than
    one bucket. With ``by`` every group of these columns has its own order; there must be few of
    them. All columns of ``df`` move; hand over ids and narrow columns only.
    """
    shift = 4 * (KEY_DIGITS - BUCKET_DIGITS)
    keyed = df.withColumn("_key", order_key(id_col, seed)).withColumn("_bucket", F.shiftright("_key", shift))
    group = Window.partitionBy(*by)
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy(*by, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *by,
            "_bucket",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
            F.sum("_n").over(group).alias("n_docs"),
        )
    )
    within = Window.partitionBy(*by, "_bucket").orderBy("_key", id_col)
    return (
        keyed.join(F.broadcast(offsets), [*by, "_bucket"])
        .withColumn("pos", F.col("_offset") + F.row_number().over(within))
        .drop("_key", "_bucket", "_offset")
    )


def cuts(df: DataFrame, ranks: Sequence[int], id_col: str = "doc_id", seed: int | str = 42) -> dict:
    """(order_key, id) of the documents at the given places.

    The driver sees one count per bucket (at most 16^3 rows) and one row per place; only the
    buckets that hold a place are sorted.
    """
    bucket = F.shiftright("key", 4 * (KEY_DIGITS - BUCKET_DIGITS)).alias("bucket")
    keyed = df.select(id_col, order_key(id_col, seed).alias("key")).select("*", bucket)
    wanted, before = {}, 0
    for row in sorted(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()):
        for rank in ranks:
            if before < rank <= before + row["n"]:
                wanted[(row["bucket"], rank - before)] = rank
        before += row["n"]
    if not wanted:
        return {}
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("key", id_col))
    found = (
        keyed.filter(F.col("bucket").isin([bucket for bucket, _ in wanted]))
        .withColumn("place", place)
        .filter(F.col("place").isin([place for _, place in wanted]))
    )
    rows = [r for r in found.collect() if (r["bucket"], r["place"]) in wanted]
    return {wanted[(r["bucket"], r["place"])]: (r["key"], r[id_col]) for r in rows}


def up_to(cut: tuple | None, id_col: str = "doc_id") -> Column:
    """Whether a document's place is not behind the cut; a cut at place 0 is None."""
    if cut is None:
        return F.lit(False)
    key, last = cut
    return (F.col("order_key") < key) | ((F.col("order_key") == key) & (F.col(id_col) <= last))


def limit_content(ordered: DataFrame, content_size: int) -> DataFrame:
    """The first ``content_size`` documents of the order; 0 keeps all."""
    if not content_size:
        return ordered
    return ordered.filter(F.col("pos") <= content_size).withColumn(
        "n_docs", F.least("n_docs", F.lit(content_size).cast("long"))
    )


def with_role(ordered: DataFrame, query_divisor: int = 10) -> DataFrame:
    """Add ``is_query``: the last 1/``query_divisor`` of the order, rounded down."""
    return ordered.withColumn("is_query", F.col("pos") > F.col("n_docs") - F.floor(F.col("n_docs") / query_divisor))


def split_train_query(ordered: DataFrame, query_divisor: int = 10) -> tuple[DataFrame, DataFrame]:
    roles = with_role(ordered, query_divisor)
    return roles.filter(~F.col("is_query")), roles.filter("is_query")


def split_full(ordered: DataFrame, n_skip: int = 500) -> tuple[DataFrame, DataFrame]:
    """Train on everything, query with all but the first ``n_skip``: queries find themselves."""
    return ordered, ordered.filter(F.col("pos") > n_skip)


def sample_first(ordered: DataFrame, fraction: float) -> DataFrame:
    """The first ``fraction`` of the order, rounded down."""
    return ordered.filter(F.col("pos") <= F.floor(F.col("n_docs") * fraction))


def two_samples(df: DataFrame, n: int, id_col: str = "doc_id", seeds: tuple = (1, 2)) -> tuple[DataFrame, DataFrame]:
    """Two independent samples of ``n`` documents each; they may overlap."""
    first, second = (shuffled(df, id_col, seed).filter(F.col("pos") <= n) for seed in seeds)
    return first, second
