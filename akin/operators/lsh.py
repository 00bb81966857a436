"""A persistent banded index over signatures and the candidates it returns.

The index is a table in buckets by band key, sorted within them: a search moves its probes to the buckets and leaves the
index where it is. Later documents are appended, and a folder can be opened again in another session.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from akin.functions.signature import band_buckets, band_hashes
from akin.operators.skew import SLICE_ROWS, sliced_join
from akin.session import fresh_path, held_table, materialise

KEYS = ["key", "check", "slice"]
CLASS = ["cell", "first_doc_id", "n_docs"]
ROW_SCHEMA = "cell int, first_doc_id bigint, n_docs bigint, band int, before array<bigint>, key bigint, check bigint, slice bigint"


def lsh_index(signed: DataFrame, bands: tuple[int, int]) -> DataFrame:
    """One row (band, bucket, doc_id) per document and band."""
    buckets = F.posexplode(band_buckets(F.col("sig"), bands)).alias("band", "bucket")
    return signed.select("doc_id", buckets).withColumn("band", F.col("band").cast("long"))


def signature_classes(train: DataFrame) -> DataFrame:
    """Train documents with equal signatures share every bucket: one row per distinct signature.

    ``first_doc_id`` is the earliest of them in train order and ``n_docs`` counts them, so a group
    of copies of any size enters the index once. Grid cells (``cell``) stay apart.
    """
    return train.groupBy("cell", "sig").agg(
        F.min_by("doc_id", F.struct("order_key", "doc_id")).alias("first_doc_id"),
        F.count(F.lit(1)).alias("n_docs"),
    )


@dataclass(frozen=True)
class BandIndex:
    """A bucketed table of band keys, the slices of its hot keys and its layout, in one folder."""

    spark: SparkSession
    folder: str
    bands: tuple[int, int]
    buckets: int

    @property
    def table(self) -> str:
        return "band_index_" + "".join(c if c.isalnum() else "_" for c in self.folder.rsplit("/", 1)[-1])

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    @property
    def hot(self) -> DataFrame:
        """key, check, slices of the keys that are dealt; at most one for each bucket (see ``build_index``)."""
        return F.broadcast(self.spark.read.schema("key bigint, check bigint, slices bigint").parquet(f"{self.folder}/hot"))

    def append(self, train: DataFrame) -> None:
        """Add documents. Signatures that are there already get a further row with the new documents' number."""
        self._write(self._keyed(signature_classes(train)), "append")

    def _keyed(self, classes: DataFrame) -> DataFrame:
        return keyed(classes, CLASS, self.bands)

    def _write(self, keyed: DataFrame, mode: str) -> None:
        dealt = F.pmod(F.xxhash64("first_doc_id"), F.coalesce("slices", F.lit(1)))
        rows = keyed.join(self.hot, KEYS[:2], "left").withColumn("slice", dealt).drop("slices")
        # One file for each bucket and write.
        placed = rows.select(*CLASS, "band", "before", *KEYS).repartition(self.buckets, *KEYS)
        writer = placed.write.mode(mode).bucketBy(self.buckets, *KEYS).sortBy(*KEYS)
        (writer.option("path", f"{self.folder}/rows") if mode != "append" else writer).saveAsTable(self.table)


def keyed(signed: DataFrame, columns: list[str], bands: tuple[int, int]) -> DataFrame:
    """One row per band: ``columns``, band, key, check, and ``before``, the keys of the bands before it."""
    hashed = signed.select(*columns, band_hashes(F.col("cell"), F.col("sig"), bands).alias("hashes"))
    rows = hashed.select(*columns, F.col("hashes.key").alias("all"), F.posexplode("hashes").alias("band", "hash"))
    return rows.select(*columns, "band", F.slice("all", F.lit(1), F.col("band")).alias("before"), "hash.key", "hash.check")


def build_index(train: DataFrame, bands: tuple[int, int], folder: str | None = None) -> BandIndex:
    """Write the index of the signed documents ``train`` (cell, doc_id, order_key, sig).

    A key above an average bucket's rows (SLICE_ROWS at least) is dealt to slices of that size, so at most as
    many keys are hot as there are buckets. Without a folder the index goes to the scratch folder until its release.
    """
    spark = train.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = BandIndex(spark, folder or fresh_path(spark, "band-index"), bands, buckets)
    if folder is None:
        held_table(spark, index.table, index.folder)
    classes = materialise(signature_classes(train), "classes")
    rows = index._keyed(classes)
    limit = max(SLICE_ROWS, classes.count() * bands[0] // buckets)
    counts = rows.groupBy("key", "check").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > limit)
    counts.select("key", "check", F.ceil(F.col("rows") / limit).alias("slices")).write.parquet(f"{index.folder}/hot")
    layout = spark.createDataFrame([(*bands, buckets)], "bands int, rows int, buckets int")
    layout.write.parquet(f"{index.folder}/layout")
    index._write(rows, "error")
    return index


def open_index(spark: SparkSession, folder: str) -> BandIndex:
    """An index that was written before, in this session or another."""
    b, r, buckets = spark.read.parquet(f"{folder}/layout").first()
    index = BandIndex(spark, folder, (b, r), buckets)
    columns = ", ".join(KEYS)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {index.table} ({ROW_SCHEMA}) USING parquet "
        f"CLUSTERED BY ({columns}) SORTED BY ({columns}) INTO {buckets} BUCKETS LOCATION '{folder}/rows'"
    )
    return index


def search_index(queries: DataFrame, index: BandIndex) -> DataFrame:
    """Train signatures sharing at least one band with each query, not checked by similarity.

    Rows: cell, query_id, first_doc_id, n_docs, each once; only the probes are moved to the buckets. A pair is taken at its first common
    band, so the meetings are not shuffled to be told apart. Only pairs of an id that has several signatures (or of an
    index row that was appended again) can come twice; these are made distinct by themselves.
    """
    asked = queries.select("cell", F.col("doc_id").alias("query_id"), "sig").distinct()
    often_asked = repeated(asked, ["cell", "query_id"])
    often_held = repeated(index.rows.filter("band = 0"), CLASS)
    rows = index.rows
    if often_asked is None and often_held is None:
        return met(rows, asked, index)
    single_rows, more_rows = parted(rows, often_held, CLASS)
    single, more = parted(asked, often_asked, ["cell", "query_id"])
    again = [met(*sides, index) for sides in ((single_rows, more), (more_rows, asked)) if None not in sides]
    return met(single_rows, single, index).unionByName(reduce(DataFrame.unionByName, again).distinct())


def met(rows: DataFrame, asked: DataFrame, index: BandIndex) -> DataFrame:
    """Rows of the index and queries at their first common band."""
    probes = keyed(asked, ["cell", "query_id"], index.bands).withColumnRenamed("before", "before_asked").drop("cell", "band")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("slices", F.lit(1)) - 1))
    probes = probes.join(index.hot, KEYS[:2], "left").withColumn("slice", every).drop("slices")
    first = ~F.arrays_overlap("before", "before_asked")
    return rows.join(probes, KEYS).filter(first).select("cell", "query_id", "first_doc_id", "n_docs")


def repeated(rows: DataFrame, columns: list[str]) -> DataFrame | None:
    """Values of ``columns`` that several rows have; None if there are none."""
    found = rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    found = materialise(found, "repeated-ids")
    return None if found.isEmpty() else found


def parted(rows: DataFrame, named: DataFrame | None, columns: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose ``columns`` are not in ``named``, and the others; nulls are values."""
    if named is None:
        return rows, None
    same = reduce(Column.__and__, [rows[c].eqNullSafe(named[c]) for c in columns])
    return rows.join(named, same, "left_anti"), rows.join(named, same, "left_semi")


def candidate_classes(queries: DataFrame, train: DataFrame, bands: tuple[int, int]) -> DataFrame:
    """``search_index`` over an index built for this search."""
    return search_index(queries, build_index(train, bands))


def candidate_counts(queries: DataFrame, train: DataFrame, bands: tuple[int, int]) -> DataFrame:
    """Number of train documents the index returns per query; queries without any are absent."""
    return counted(candidate_classes(queries, train, bands))


def counted(found: DataFrame) -> DataFrame:
    return found.groupBy("cell", "query_id").agg(F.sum("n_docs").alias("n_candidates"))


def candidate_documents(queries: DataFrame, train: DataFrame, bands: tuple[int, int]) -> DataFrame:
    """The candidates document by document: cell, query_id, doc_id. As long as the result it lists."""
    first = materialise(signature_classes(train).select("cell", "sig", "first_doc_id"), "class-firsts")
    members = sliced_join(train.select("cell", "sig", "doc_id"), first, ["cell", "sig"], "doc_id", unique=True).drop("sig")
    found = candidate_classes(queries, train, bands).select("cell", "query_id", "first_doc_id")
    # Both sides are read for their frequencies and for the join.
    members, found = materialise(members, "class-members"), materialise(found, "candidate-classes")
    return sliced_join(members, found, ["cell", "first_doc_id"], "doc_id").select("cell", "query_id", "doc_id")
