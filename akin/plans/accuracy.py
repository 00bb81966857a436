"""Estimated against exact Jaccard, and the distance metrics of neighbouring signatures."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from akin.functions import distances
from akin.functions.signature import minhash, prefix, sig_id, text_signature
from akin.functions.text import shingle_ids
from akin.operators.blocks import Postings, coded, equal_positions, meet, ragged
from akin.operators.ordering import cuts, order_key, shuffled, up_to
from akin.session import materialise


def numbered_sample(docs: DataFrame, n: int, seed: int) -> DataFrame:
    """The first ``n`` documents of a seeded order, with ``slot`` 1..n.

    The sample has at most ``n`` rows, so numbering it in one task is safe.
    """
    n_docs = docs.count()
    cut = cuts(docs, [min(n, n_docs)], seed=seed).get(min(n, n_docs))
    keyed = docs.withColumn("order_key", order_key(seed=seed)).filter(up_to(cut))
    slot = F.row_number().over(Window.orderBy("order_key", "doc_id"))
    return keyed.withColumn("slot", slot).drop("order_key")


def sample_pairs(first: DataFrame, second: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """Ordered pairs of two samples of at most ``n`` rows whose titles differ.

    Each row of the first sample asks for the slots 1..n of the second: an equi-join of n x n rows.
    """
    left = first.select(*[F.col(c).alias(c if c in keys else f"a_{c}") for c in first.columns]).withColumn(
        "b_slot", F.explode(F.sequence(F.lit(1), F.lit(n)))
    )
    right = second.select(*[F.col(c).alias(c if c in keys else f"b_{c}") for c in second.columns])
    return left.join(right, [*keys, "b_slot"]).filter(F.col("a_title") != F.col("b_title"))


def sample_accuracy(docs: DataFrame, n: int, ks: tuple[int, ...], num_perm: int, seeds=(1, 2)) -> DataFrame:
    """Pairs of two samples with exact similarity and signatures for every shingle size ``k``.

    Only ids are paired before the sets join, and the exact similarity is taken once for all signature lengths.
    """
    sides = []
    for seed in seeds:
        sample = numbered_sample(docs, n, seed)
        per_k = []
        for k in ks:
            rows = sample.select("doc_id", "title", "slot", F.lit(k).alias("k"), shingle_ids(F.col("text"), k).alias("set"))
            per_k.append(rows.withColumn("sig", minhash(F.col("set"), num_perm)))
        sides.append(materialise(reduce(DataFrame.unionByName, per_k), "sample").filter(F.col("set").isNotNull()))
    pairs = sample_pairs(*(side.select("k", "doc_id", "title", "slot") for side in sides), n, ["k"])
    for name, side in zip("ab", sides):
        own = side.select("k", F.col("doc_id").alias(f"{name}_doc_id"), F.col("set").alias(f"{name}_set"), F.col("sig").alias(f"{name}_sig"))
        pairs = pairs.join(own, ["k", f"{name}_doc_id"])
    shared = F.size(F.array_intersect("a_set", "b_set"))
    exact = distances.jaccard_counts(shared, F.size("a_set"), F.size("b_set"))
    return materialise(pairs.select("k", "a_doc_id", "b_doc_id", exact.alias("jaccard"), "a_sig", "b_sig"), "sample-pairs")


def pair_accuracy(pairs: DataFrame, num_perm: int) -> DataFrame:
    """Exact and estimated Jaccard of each pair of ``sample_accuracy`` and their relative difference in percent."""
    estimate = distances.jaccard_estimate(prefix(F.col("a_sig"), num_perm), prefix(F.col("b_sig"), num_perm))
    return judged_pairs(pairs, F.lit(num_perm), estimate)


def judged_pairs(pairs: DataFrame, num_perm: Column, estimate: Column) -> DataFrame:
    return pairs.select(
        F.col("k").cast("long").alias("k"),
        num_perm.cast("long").alias("num_perm"),
        "a_doc_id",
        "b_doc_id",
        "jaccard",
        estimate.alias("estimate"),
    ).withColumn("pct_diff", distances.pct_change(F.col("jaccard"), F.col("estimate")))


def mean_accuracy(rows: DataFrame) -> DataFrame:
    return rows.groupBy("k", "num_perm").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("pct_diff"), 9).alias("avg_pct_diff")
    )


def accuracy_sweep(
    docs: DataFrame, n: int, k: int, num_perms: tuple[int, ...], num_perm: int, ks: tuple[int, ...]
) -> DataFrame:
    """Per-pair accuracy over (k, each of num_perms) and (num_perm, each of ks).

    Both axes share one pass: every shingle size is cut, signed with the longest signature and paired once, and a pair
    is judged at the lengths its size asks for.
    """
    longest = max(*num_perms, num_perm)
    pairs = sample_accuracy(docs, n, tuple(sorted({k, *ks})), longest)
    asked = sorted({*num_perms, num_perm} if k in ks else set(num_perms))
    lengths = F.when(F.col("k") == k, F.array(*map(F.lit, asked))).otherwise(F.array(F.lit(num_perm)))
    rows = pairs.withColumn("num_perm", F.explode(lengths))
    estimate = distances.jaccard_estimate(F.slice("a_sig", F.lit(1), "num_perm"), F.slice("b_sig", F.lit(1), "num_perm"))
    return judged_pairs(rows, F.col("num_perm"), estimate)


SELF_SCHEMA = "cell int, query_id long, n_pairs long, sum_pct_diff double"


def _self_task(left: pa.Table) -> Callable:
    """Number of partners and summed difference of every left row with the rows of a block."""
    n_left = left.num_rows
    sets, sizes, vocabulary = coded(left["set"])
    postings = Postings(sets, sizes, vocabulary)
    # A position is a row.
    positions = lambda rows: np.ascontiguousarray(ragged(rows["sig"])[0].reshape(rows.num_rows, -1).T)
    mine = positions(left)
    ids = left["query_id"].to_numpy()

    def compared(right: pa.Table) -> pa.Table:
        n_pairs, total = np.zeros(n_left, dtype=np.int64), np.zeros(n_left)
        others, (other, lengths, vocabulary) = right["doc_id"].to_numpy(), coded(right["set"])
        theirs = positions(right)
        for part, shared in postings.overlaps(other, lengths, vocabulary):
            exact = shared / (sizes[:, None] + lengths[None, part] - shared)
            estimate = equal_positions(mine, theirs[:, part]) / len(mine)
            with np.errstate(divide="ignore", invalid="ignore"):
                change = np.where(estimate == 0, 0.0, np.abs(exact - estimate) / estimate * 100.0)
            change = np.where(exact == estimate, 100.0, change)
            other_doc = ids[:, None] != others[None, part]
            n_pairs += other_doc.sum(axis=1)
            total += np.where(other_doc, change, 0.0).sum(axis=1)
        cell = np.zeros(n_left, dtype=np.int32)
        return pa.table(
            {"cell": cell, "query_id": ids, "n_pairs": n_pairs, "sum_pct_diff": total},
            schema=pa.schema(
                [("cell", pa.int32()), ("query_id", pa.int64()), ("n_pairs", pa.int64()), ("sum_pct_diff", pa.float64())]
            ),
        )

    return compared


def self_accuracy(docs: DataFrame, fraction: float, k: int, num_perm: int, seed: int = 42) -> DataFrame:
    """Every document of a sample against all others of it, both directions, summed per document.

    Rows: doc_id, n_pairs, avg_pct_diff. The pairs are compared in blocks and never written out.
    """
    n = int(docs.count() * fraction)
    cut = cuts(docs, [n], seed=seed).get(n)
    sample = (
        docs.withColumn("order_key", order_key(seed=seed))
        .filter(up_to(cut))
        .select(F.lit(0).alias("cell"), "doc_id", shingle_ids(F.col("text"), k).alias("set"))
        .withColumn("sig", minhash(F.col("set"), num_perm))
    )
    sums = meet(sample.withColumnRenamed("doc_id", "query_id"), sample, _self_task, SELF_SCHEMA)
    return sums.groupBy(F.col("query_id").alias("doc_id")).agg(
        F.sum("n_pairs").alias("n_pairs"), F.sum("sum_pct_diff").alias("sum_pct_diff")
    )


def raw_signatures(docs: DataFrame, k: int, num_perm: int) -> DataFrame:
    """doc_id, signature id and signature of the raw text, written once."""
    signed = docs.select("doc_id", text_signature(F.col("text"), k, num_perm).alias("signed"))
    rows = signed.select("doc_id", "signed.n_shingles", "signed.sig")
    return materialise(rows, "raw-signatures").filter("n_shingles > 0").withColumn("sig_id", sig_id(F.col("sig")))


def consecutive_pairs(signatures: DataFrame, seeds: Sequence[int], columns: Sequence[str] = ("sig",)) -> DataFrame:
    """Neighbours in seeded orders of the signatures, except the last pair of each order.

    Rows: repetition (the seed), pos, a_doc_id, b_doc_id and the ``columns`` of both, as a_sig, b_sig. Neighbours meet in an
    equi-join on their place, so no task sees a whole order, and only ids are ordered.
    """
    ids = signatures.select("doc_id", F.explode(F.array(*[F.lit(s).cast("long") for s in seeds])).alias("repetition"))
    ordered = shuffled(ids, seed=F.col("repetition"), by=["repetition"])
    first = ordered.filter(F.col("pos") <= F.col("n_docs") - 2).select(
        "repetition", "pos", F.col("doc_id").alias("a_doc_id")
    )
    second = ordered.select("repetition", (F.col("pos") - 1).alias("pos"), F.col("doc_id").alias("b_doc_id"))
    pairs = first.join(second, ["repetition", "pos"])
    for side in ("a", "b"):
        own = signatures.select(F.col("doc_id").alias(f"{side}_doc_id"), *[F.col(c).alias(f"{side}_{c}") for c in columns])
        pairs = pairs.join(own, f"{side}_doc_id")
    return pairs


def pair_metrics(pairs: DataFrame) -> DataFrame:
    """The five metrics of each pair; the exclusive or is a vector, kept as text."""
    a, b = F.col("a_sig"), F.col("b_sig")
    return pairs.select(
        "pos",
        "a_doc_id",
        "b_doc_id",
        distances.jaccard_estimate(a, b).alias("jaccard"),
        F.array_join(distances.xor(a, b).cast("array<string>"), ",").alias("xor"),
        F.round(distances.cosine(a, b), 9).alias("cosine"),
        distances.hamming(a, b).alias("hamming"),
        F.round(distances.euclidean(a, b), 3).alias("euclidean"),
    )


def metric_summary(signatures: DataFrame, repetitions: int) -> DataFrame:
    """Mean of each metric over the neighbours of every reshuffle.

    Norms are taken once for each signature, not for each pair; a pair's vectors are joined at four bytes a position and
    compared a batch at a time.
    """
    narrow = signatures.select("doc_id", F.col("sig").cast("array<int>").alias("sig"), distances.norm(F.col("sig")).alias("norm"))
    narrow = materialise(narrow, "norms")
    pairs = consecutive_pairs(narrow, range(1, repetitions + 1), ("sig", "norm"))
    compared = distances.metrics(F.col("a_sig"), F.col("b_sig"), F.col("a_norm"), F.col("b_norm"))
    rows = pairs.select("repetition", compared.alias("metrics")).select("repetition", "metrics.*")
    return rows.groupBy("repetition").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        *[F.round(F.avg(name), 9).alias(f"avg_{name}") for name in ("jaccard", "cosine", "hamming")],
        F.round(F.avg("euclidean"), 2).alias("avg_euclidean"),
    )
