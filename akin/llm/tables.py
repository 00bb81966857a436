"""Helpers that the operators of this subpackage share: tables in the shared folder, gapless numbers and what workers hold."""

from __future__ import annotations

import sys
from collections.abc import Callable, Hashable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MOST_BYTES = 1 << 22  # of a batch that goes to a Python worker while a table is written
PART_ROWS = 1024  # rows of a batch that a task works on and hands back at once


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one beside the warehouse if unset."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    Its lineage ends there, every later reader finds it complete and a lost executor takes nothing
    with it. Meanwhile batches for Python workers are bounded in bytes: by rows alone, texts or sets make batches of
    tens of MB, which executor and worker both hold. The caller's setting comes back afterwards.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid4().hex}"
    given = spark.conf.get(BATCH_BYTES, None)
    if given is None:
        spark.conf.set(BATCH_BYTES, MOST_BYTES)
    try:
        df.write.parquet(path)
    finally:
        if given is None:
            spark.conf.unset(BATCH_BYTES)
    return spark.read.schema(df.schema).parquet(path)


def kept(name: Hashable, make: Callable[[], object]) -> object:
    """What ``make`` gives, held in the Python process until another name is asked for.

    A worker outlives its task and serves the next operator: with one place for all of them, what one leaves does not add to
    what the next one holds.
    """
    # Task code travels by value: the place is on the interpreter.
    held = sys.__dict__.get("_akin_kept")
    if held is None or held[0] != name:
        held = sys.__dict__["_akin_kept"] = None  # the old one goes before the new one is made
        held = sys.__dict__["_akin_kept"] = name, make()
    return held[1]


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most PART_ROWS rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            yield batch.slice(at, PART_ROWS)


def dropped(*frames: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# Bits of a bitmap of keys at most, at least, for one key, and of one of its rows; it never has more than BITS / ROW_BITS rows.
BITS, LEAST_BITS, KEY_BITS, ROW_BITS = 1 << 27, 1 << 22, 128, 1 << 15


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def parted(df: DataFrame, key: str, small: DataFrame, small_key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of ``df`` that may have their key in ``small``, and those that surely don't, which need no join.

    The keys of ``small`` are hashed into a bitmap of KEY_BITS bits each, in all 16 MB at most, that is broadcast: what the
    rest weighs is never shuffled. The driver holds several copies of it, so few keys get few bits. ``small`` is read twice
    for it: pass a written table.
    """
    size = min(BITS, max(LEAST_BITS, 1 << (KEY_BITS * small.count()).bit_length()))
    row, bit, bits = (unused(df, c) for c in ("_row", "_bit", "_bits"))
    hashed = lambda column: F.pmod(F.xxhash64(F.col(column)), F.lit(size))
    places = small.select(hashed(small_key).alias("h")).select(F.expr(f"h div {ROW_BITS}").alias(row), F.expr(f"h % {ROW_BITS}").alias("bit"))
    bitmap = written(places.groupBy(row).agg(F.bitmap_construct_agg("bit").alias(bits)), "bitmap")
    keyed = df.withColumn(bit, hashed(key)).withColumn(row, F.expr(f"`{bit}` div {ROW_BITS}"))
    joined = keyed.join(F.broadcast(bitmap), row, "left")
    byte = F.expr(f"cast(conv(hex(substring(`{bits}`, cast(`{bit}` % {ROW_BITS} div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = F.coalesce(F.getbit(byte, (F.col(bit) % 8).cast("int")) == 1, F.lit(False))
    return joined.where(hit).select(*df.columns), joined.where(~hit).select(*df.columns)


def numbered(df: DataFrame, groups: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``: long numbers without gaps from 0 in every group of ``groups``, by ``order``.

    The rows are range-partitioned by group and order, so that a hot group spreads over as many
    partitions as it needs; a partition numbers its own rows, and a group's part in it starts where the
    parts before it end. What is broadcast has one row per partition and at most one more per
    group. Rows equal in ``order`` take their numbers in any order. ``df`` is read twice: pass a
    written table, not a long plan. Group columns must not be null.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*groups, *order]
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    # The id counts the rows of a partition, whose number is in the bits from 33 on.
    dealt = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "dealt")
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))
    runs = dealt.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(*groups, "_part", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return (
        dealt.join(F.broadcast(starts), [*groups, "_part"])
        .withColumn(name, F.col("_start") + F.col("_at") - F.col("_first"))
        .drop("_part", "_start", "_first", "_at")
    )
