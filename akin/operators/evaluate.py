"""How well the approximate result lists agree with the exact one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from akin.functions.signature import shares_band
from akin.operators.skew import sliced_join

QUERY = ["cell", "query_id"]


def result_overlap(exact: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of the exact list that the other list holds too."""
    return exact.join(other.select(*QUERY, "doc_id"), [*QUERY, "doc_id"], "left_semi")


def list_overlap(exact: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """Per query: hits, and their share of the other list. Queries with an empty list are absent."""
    hits = result_overlap(exact, other).groupBy(*QUERY).agg(F.count(F.lit(1)).alias("hits"))
    lengths = other.groupBy(*QUERY).agg(F.count(F.lit(1)).alias("n_listed"))
    found = F.coalesce("hits", F.lit(0))
    return lengths.join(hits, QUERY, "left").select(
        *QUERY,
        found.cast("long").alias(f"hits_{name}"),
        (found / F.col("n_listed")).alias(f"overlap_{name}"),
    )


def candidate_flags(exact: DataFrame, table: DataFrame, bands: tuple[int, int]) -> DataFrame:
    """The exact lists with ``is_candidate``: whether the neighbour is among the LSH candidates.

    That follows from its signature and the query's, so no candidate list is written out.
    """
    query_sig = table.filter("is_query").select("cell", F.col("doc_id").alias("query_id"), F.col("sig").alias("q"))
    train_sig = table.filter("is_train").select("cell", "doc_id", F.col("sig").alias("t"))
    # The first of many copies is a neighbour of all of them, so train ids may be hot keys here.
    both = sliced_join(exact.join(query_sig, QUERY), train_sig, ["cell", "doc_id"], "query_id", unique=True)
    return both.select(
        *QUERY, "rank", "doc_id", shares_band(F.col("q"), F.col("t"), bands).alias("is_candidate")
    )


def candidate_overlap(flags: DataFrame, counts: DataFrame) -> DataFrame:
    """Per query with candidates: their number, hits, share of hits in the candidates, true recall."""
    hits = flags.groupBy(*QUERY).agg(F.count_if("is_candidate").alias("hits"), F.count(F.lit(1)).alias("n_exact"))
    return counts.join(hits, QUERY).select(
        *QUERY,
        "n_candidates",
        F.col("hits").alias("hits_lsh"),
        (F.col("hits") / F.col("n_candidates")).alias("overlap_lsh"),
        (F.col("hits") / F.col("n_exact")).alias("recall_lsh"),
    )


def list_grid(exact: DataFrame, lists: DataFrame, tops: Sequence[int]) -> DataFrame:
    """Overlap of the lists of all kinds with the exact ones for every list length, from one join.

    A row of both lists belongs to length t if both of its ranks do. Rows: cell, query_id, kind, n_results, overlap.
    """
    places = exact.select(*QUERY, "doc_id", F.col("rank").alias("exact_rank"))
    both = lists.join(places, [*QUERY, "doc_id"], "left")
    found = both.groupBy(*QUERY, "kind").agg(
        *[F.count_if((F.col("rank") <= t) & (F.col("exact_rank") <= t)).alias(f"hits_{t}") for t in tops],
        *[F.count_if(F.col("rank") <= t).alias(f"listed_{t}") for t in tops],
    )
    return by_length(found, {t: F.col(f"hits_{t}") / F.col(f"listed_{t}") for t in tops}, F.col("kind"))


def candidate_grid(flags: DataFrame, counts: DataFrame, tops: Sequence[int]) -> DataFrame:
    """The same rows for the LSH candidates, as kind ``lsh``; queries without candidates are absent."""
    hits = [F.count_if(F.col("is_candidate") & (F.col("rank") <= t)).alias(f"hits_{t}") for t in tops]
    found = counts.join(flags.groupBy(*QUERY).agg(*hits), QUERY)
    return by_length(found, {t: F.col(f"hits_{t}") / F.col("n_candidates") for t in tops}, F.lit("lsh"))


def by_length(found: DataFrame, overlaps: dict[int, Column], kind: Column) -> DataFrame:
    entries = [F.struct(F.lit(t).cast("long").alias("n_results"), o.alias("overlap")) for t, o in overlaps.items()]
    return found.select(*QUERY, kind.alias("kind"), F.inline(F.array(*entries)))


def grid_means(overlaps: DataFrame, runs: dict[int, dict[str, str]], run_name: str) -> DataFrame:
    """Mean overlaps per cell, run and list length over the queries that have a value of every kind of the run.

    ``runs`` maps a value of the grid column ``run_name`` to its kinds by output name.
    """
    kinds = sorted({kind for run in runs.values() for kind in run.values()})
    wide = overlaps.groupBy(*QUERY, "n_results").agg(
        *[F.max(F.when(F.col("kind") == kind, F.col("overlap"))).alias(kind) for kind in kinds]
    )
    entries = [
        F.struct(F.lit(run).cast("long").alias(run_name), *[F.col(kind).alias(f"overlap_{name}") for name, kind in named.items()])
        for run, named in runs.items()
    ]
    names = [f"overlap_{name}" for name in next(iter(runs.values()))]
    rows = wide.select("cell", "n_results", F.inline(F.array(*entries))).dropna(subset=names)
    return rows.groupBy("cell", run_name, "n_results").agg(
        F.count(F.lit(1)).alias("n_evaluated"), *[F.round(F.avg(name), 9).alias(f"avg_{name}") for name in names]
    )


def query_stats(parts: list[DataFrame]) -> DataFrame:
    """One row per query that has a value in every part; a query without candidates has no row."""
    return reduce(lambda left, right: left.join(right, QUERY), parts)


def global_stats(queries: DataFrame, stats: DataFrame, sizes: list[str], overlaps: list[str]) -> DataFrame:
    """Per cell: mean sizes over all queries, mean overlaps over the queries that have them."""
    joined = queries.join(stats.select(*QUERY, *overlaps), QUERY, "left")
    return joined.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n_queries"),
        F.count(overlaps[0]).alias("n_evaluated"),
        *[F.floor(F.avg(name)).cast("long").alias(f"avg_{name}") for name in sizes],
        *[F.round(F.avg(name), 9).alias(f"avg_{name}") for name in overlaps],
    )

