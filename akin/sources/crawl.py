"""Crawl lists: CSV files of content ids with their file type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CRAWL_SCHEMA = "cid string, ext string"
ID_SCHEMA = "cid string"


def write_crawl_list(frame: DataFrame, path: str) -> str:
    frame.select("cid", "ext").write.csv(path, header=True)
    return path


def read_crawl_lists(spark: SparkSession, lists: list[str]) -> DataFrame:
    return spark.read.csv(lists, schema=CRAWL_SCHEMA, header=True)


def union_frames(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames, duplicates kept."""
    return reduce(DataFrame.unionByName, frames)


def filter_crawl_ids(crawl: DataFrame, ext: str) -> DataFrame:
    """Ids of one file type, duplicates kept."""
    return crawl.filter(F.col("ext") == ext).select("cid")


def append_ids(ids: DataFrame, path: str) -> None:
    ids.select("cid").write.mode("append").csv(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=ID_SCHEMA)


def scan_limit(ids: DataFrame, n: int) -> DataFrame:
    """The first ``n`` ids in order."""
    return ids.orderBy("cid").limit(n)
