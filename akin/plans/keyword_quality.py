"""Keyword signatures beside full signatures, over holdout and whole-corpus splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from akin.config import PRIME, SearchConfig
from akin.functions.signature import minhash
from akin.functions.text import normalise, strip_prefix, title_and_text
from akin.operators.evaluate import candidate_grid, grid_means, list_grid, query_stats
from akin.operators.keywords import extract_keywords, keyword_ids
from akin.operators.lsh import candidate_counts
from akin.operators.rejects import reject_reason
from akin.operators.textsearch import title_search
from akin.plans.corpus import Split, exact_top, signature_tops, signed, written_split
from akin.plans.quality import lsh_results, quality_parts, query_sizes
from akin.session import materialise


def keyword_input(docs: DataFrame) -> DataFrame:
    """doc_id, lang and full_text: the title without its prefix, then the clean text. ``lang`` is null if ``docs`` has none."""
    full_text = title_and_text(strip_prefix(F.col("title")), normalise(F.col("text")))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select("doc_id", lang.alias("lang"), full_text.alias("full_text")).filter(F.col("full_text").isNotNull())


def keyword_signatures(docs: DataFrame, sizes: tuple[int, ...], num_perm: int) -> DataFrame:
    """doc_id and one signature column ``kw_<m>`` per number of keywords for every document, written once.

    The keywords are extracted once for the largest number; the smaller sets are their first ones. A document
    without keywords keeps its place: the signature of the empty list is the maximum in every position.
    """
    keywords = materialise(extract_keywords(keyword_input(docs), max(sizes)), "keywords")
    signatures = [minhash(keyword_ids(F.col("keywords"), m), num_perm).alias(f"kw_{m}") for m in sizes]
    signed_lists = docs.select("doc_id").join(keywords.select("doc_id", *signatures), "doc_id", "left")
    nothing = F.array_repeat(F.lit(PRIME).cast("long"), num_perm)
    every = [F.coalesce(f"kw_{m}", nothing).alias(f"kw_{m}") for m in sizes]
    return materialise(signed_lists.select("doc_id", *every), "keyword-signatures")


def with_a_role(split: Split, docs: DataFrame) -> DataFrame:
    """The documents of ``docs`` that some cell of the split holds."""
    asked = split.docs.filter(F.size("roles") > 0).select("doc_id")
    return docs.join(asked, "doc_id", "left_semi")


def keyword_quality(split: Split, docs: DataFrame) -> DataFrame:
    """One row per query with the overlaps of LSH, signature and keyword search and the sizes of what is compared."""
    cfg, split = split.cfg, written_split(split)
    n = cfg.n_results
    keywords = keyword_signatures(docs, (cfg.n_keywords,), cfg.num_perm)
    table = materialise(signed(split).join(keywords, "doc_id"), "keyword-table")
    exact = materialise(exact_top(split, n), "exact")
    found = materialise(signature_tops(table, n, signature_kinds(cfg, (cfg.n_keywords,))), "lists")
    lists = {"sig": of_kind(found, "sig"), "kw": of_kind(found, f"kw_{cfg.n_keywords}")}
    stats = query_stats(quality_parts(exact, lsh_results(table, exact, cfg), lists, n))
    return stats.join(keyword_sizes(table, cfg.num_perm), ["cell", "query_id"])


def keyword_sizes(table: DataFrame, num_perm: int) -> DataFrame:
    """Footprint of every query with its keyword signature."""
    return query_sizes(table, num_perm).withColumn("keyword_sig_bytes", F.lit(8 * num_perm).cast("long"))


def query_stages(split: Split, docs: DataFrame) -> DataFrame:
    """cell, query_id and ``stage``: where the work on a query ends.

    ``missing`` and ``short`` texts cannot be read, ``keywords`` have no keyword, ``candidates`` find nothing in the index;
    all others are ``evaluated``. Each stage sees what the one before it has left, and only the stage is carried on.
    """
    cfg = split.cfg
    table = signed(split)
    asked = split.side("is_query", F.col("doc_id").alias("query_id"), reject_reason(F.col("text"), cfg.shingle_size).alias("stage"))
    lists = extract_keywords(keyword_input(docs.join(asked.select(F.col("query_id").alias("doc_id")).distinct(), "doc_id", "left_semi")), 1)
    lists = materialise(lists, "first-keywords")
    named = lists.select(F.col("doc_id").alias("query_id"), F.col("keywords").isNotNull().alias("has_keywords"))
    counts = candidate_counts(table.filter("is_query"), table.filter("is_train"), cfg.bands)
    reached = asked.join(named, "query_id", "left").join(counts, ["cell", "query_id"], "left")
    stage = (
        F.when(F.col("stage").isNotNull(), F.col("stage"))
        .when(~F.coalesce("has_keywords", F.lit(False)), "keywords")
        .when(F.col("n_candidates").isNull(), "candidates")
        .otherwise("evaluated")
    )
    return reached.select("cell", "query_id", stage.alias("stage"))


def signature_kinds(cfg: SearchConfig, sizes: tuple[int, ...]) -> dict[str, tuple[str, int]]:
    """The full signature and those of the keyword lists, for one pass of ``signature_tops``."""
    return {"sig": ("sig", cfg.num_perm)} | {f"kw_{m}": (f"kw_{m}", cfg.num_perm) for m in sizes}


def of_kind(lists: DataFrame, kind: str) -> DataFrame:
    return lists.filter(F.col("kind") == kind).drop("kind")


def keyword_sweep(split: Split, docs: DataFrame, sizes: tuple[int, ...], tops: tuple[int, ...]) -> DataFrame:
    """Mean overlaps per content size (cell), number of keywords and list length.

    One pass with the longest lists finds those of all signatures, and one long table (cell, query, kind, length) is grouped
    for the whole grid.
    """
    cfg, split = split.cfg, written_split(split)
    n = max(tops)
    table = materialise(
        signed(split).join(keyword_signatures(with_a_role(split, docs), sizes, cfg.num_perm), "doc_id"), "keyword-table"
    )
    exact = materialise(exact_top(split, n), "exact")
    lists = materialise(signature_tops(table, n, signature_kinds(cfg, sizes)), "lists")
    overlaps = list_grid(exact, lists, tops).unionByName(candidate_grid(*lsh_results(table, exact, cfg), tops))
    return grid_means(overlaps, {m: {"lsh": "lsh", "sig": "sig", "kw": f"kw_{m}"} for m in sizes}, "n_keywords")


def external_top(split: Split, n: int, without_first: bool = False) -> DataFrame:
    """The title search that stands for an external engine; ``without_first`` asks for one more and drops the best.

    A query over the whole corpus may find itself, which the second form leaves out if it comes first.
    """
    titles = split.side("is_query", "doc_id", "title")
    train = split.side("is_train", "doc_id", "text", "order_key")
    found = title_search(titles, train, split.n_docs[0], n + without_first)
    return found.filter("rank > 1").withColumn("rank", F.col("rank") - 1) if without_first else found


def whole_corpus_lists(split: Split, docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures, exact lists, and the lists of kinds sig, kw and ext (signature, keyword and title search) of a split."""
    cfg = split.cfg
    m = cfg.n_keywords
    table = materialise(signed(split).join(keyword_signatures(docs, (m,), cfg.num_perm), "doc_id"), "whole-table")
    exact = materialise(exact_top(split, n), "exact")
    kinds = {"sig": ("sig", cfg.num_perm), "kw": (f"kw_{m}", cfg.num_perm)}
    external = external_top(split, n).withColumn("kind", F.lit("ext"))
    columns = ["cell", "query_id", "kind", "rank", "doc_id"]
    lists = signature_tops(table, n, kinds).select(*columns).unionByName(external.select(*columns))
    return table, exact, materialise(lists, "lists")


def top_sweep(split: Split, docs: DataFrame, tops: tuple[int, ...]) -> DataFrame:
    """Mean overlaps per list length over the whole corpus, trained once and grouped once for all lengths."""
    table, exact, lists = whole_corpus_lists(split, docs, max(tops))
    overlaps = list_grid(exact, lists, tops).unionByName(candidate_grid(*lsh_results(table, exact, split.cfg), tops))
    kinds = {name: name for name in ("lsh", "sig", "kw", "ext")}
    return grid_means(overlaps, {split.cfg.n_keywords: kinds}, "n_keywords").drop("cell", "n_keywords")


def whole_stats(split: Split, docs: DataFrame, dataset: str) -> DataFrame:
    """The row per query of a run over the whole corpus: overlaps of all four searches, sizes, and how much was compared.

    A query without an LSH candidate or without an external result has no row, as it has no overlap there.
    """
    cfg, n = split.cfg, split.cfg.n_results
    table, exact, lists = whole_corpus_lists(split, docs, n)
    named = {kind: of_kind(lists, kind) for kind in ("sig", "kw", "ext")}
    stats = query_stats(quality_parts(exact, lsh_results(table, exact, cfg), named, n))
    rows = stats.join(keyword_sizes(table, cfg.num_perm), ["cell", "query_id"])
    titles = table.select("cell", F.col("doc_id").alias("query_id"), "title")
    compared = table.filter("is_train").count()
    return rows.join(titles, ["cell", "query_id"]).select(
        F.lit(dataset).alias("dataset"), "*", F.lit(compared).cast("long").alias("n_compared")
    )
