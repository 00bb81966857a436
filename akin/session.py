"""Where intermediate and result tables are written, and how they are released."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MOST_BYTES = 1 << 20  # of a batch that goes to a Python worker while a table is written: a set is many times its text

# Paths of the intermediate tables written since the last release, and names of those in the catalog, by application.
_written: dict[str, list[str]] = {}
_named: dict[str, list[str]] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one beside the warehouse if unset."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_akin"
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the scratch folder that nothing else writes to."""
    return f"{scratch_folder(spark)}/{name}-{uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: shared by several consumers, safe from lost executors.

    Meanwhile batches for Python workers are bounded in bytes, unless the session sets that itself: by rows alone a batch of
    texts, sets or blocks has hundreds of MB, which executor and worker both hold.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    given = spark.conf.get(BATCH_BYTES, None)
    if given is None:
        spark.conf.set(BATCH_BYTES, MOST_BYTES)
    try:
        df.write.parquet(path)
    finally:
        if given is None:
            spark.conf.unset(BATCH_BYTES)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def held_table(spark: SparkSession, name: str, path: str) -> None:
    """Note a table of the catalog, and its folder, that goes with the next release."""
    application = spark.sparkContext.applicationId
    _named.setdefault(application, []).append(name)
    _written.setdefault(application, []).append(path)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of all results that have been consumed; call it at the end of a run."""
    for name in _named.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path in _written.pop(spark.sparkContext.applicationId, []):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
