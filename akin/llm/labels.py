"""Labelled training rows: the fold rule and the bounded sample that classifiers are fitted on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % folds


def training_labels(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """doc_id, label: one row for every labelled id of ``docs`` outside the held-out fold.

    Only ids are compared, the texts are not moved. An id with several labels takes the largest; null labels are none.
    """
    given = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("label is not null")
    given = given.where(remainder(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.max("label").alias("label"))
    return given.join(docs.select("doc_id"), "doc_id", "left_semi")


def bounded_sample(docs: DataFrame, given: DataFrame, per_label: int) -> DataFrame:
    """doc_id, text, label of at most ``per_label`` ids of each label, those with the smallest hashes.

    The chosen ids number at most twice ``per_label``, so they are broadcast to the texts.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [given.where(F.col("label") == c).orderBy(*order).limit(per_label) for c in (0, 1)]
    ids = reduce(DataFrame.unionAll, chosen)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def prior(given: DataFrame) -> tuple[int, int]:
    """How many training rows have label 0 and label 1."""
    counts = {r["label"]: r["count"] for r in given.groupBy("label").count().collect()}
    return counts.get(0, 0), counts.get(1, 0)
