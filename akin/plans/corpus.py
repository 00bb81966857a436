"""From a source table to documents with a role, and to their signatures."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from akin.config import SearchConfig
from akin.functions.text import normalise, shingle_ids
from akin.functions.signature import text_signature
from akin.operators.blocks import set_scorer, signature_scorer, top_rows, tops_of
from akin.operators.ordering import cuts, order_key, up_to
from akin.session import materialise


@dataclass(frozen=True)
class Split:
    """Documents of a corpus with their roles.

    ``docs`` has one row per document: doc_id, title, text (normalised), order_key and ``roles``,
    an array of (cell, is_train, is_query) with one entry per grid cell the document belongs to.
    ``n_docs`` counts the requested documents of each cell, and ``cells`` names the cell of each size asked for: sizes
    that the corpus cuts to the same number of documents share a cell and are searched once.
    """

    docs: DataFrame
    cfg: SearchConfig
    n_docs: dict[int, int]
    cells: tuple[int, ...] = (0,)

    def side(self, role: str, *columns: Column | str) -> DataFrame:
        """``cell`` and the given columns of the documents with a role, once per cell.

        The columns are computed before a document is copied to its cells.
        """
        asked = self.docs.filter(F.exists("roles", lambda r: r[role]))
        rows = asked.select(*columns, F.filter("roles", lambda r: r[role]).alias("roles"))
        return rows.select("*", F.explode("roles.cell").alias("cell")).drop("roles")


def role(cell: int, in_cell: Column, is_train: Column, is_query: Column) -> Column:
    entry = F.struct(F.lit(cell).alias("cell"), is_train.alias("is_train"), is_query.alias("is_query"))
    return F.when(in_cell, entry)


def with_roles(docs: DataFrame, cfg: SearchConfig, roles: list[Column]) -> DataFrame:
    keyed = docs.select("doc_id", "title", "text", order_key(seed=cfg.seed).alias("order_key"))
    return keyed.select(
        "doc_id",
        "title",
        normalise(F.col("text")).alias("text"),
        "order_key",
        F.filter(F.array(*roles), lambda r: r.isNotNull()).alias("roles"),
    )


def holdout(docs: DataFrame, cfg: SearchConfig, sizes: tuple[int, ...] | None = None) -> Split:
    """The last 1/``query_divisor`` of the shuffled content are queries, the rest is train.

    ``sizes`` are content sizes, one grid cell each (default: the configured one). The roles
    follow from comparing a document's order key with the keys at the cuts, so the texts are
    neither sorted nor shuffled.
    """
    n_all = docs.count()
    held = [min(size, n_all) if size else n_all for size in sizes or (cfg.content_size,)]
    distinct = list(dict.fromkeys(held))
    n_docs = dict(enumerate(distinct))
    ends = {cell: (n - n // cfg.query_divisor, n) for cell, n in n_docs.items()}
    found = cuts(docs, sorted({rank for pair in ends.values() for rank in pair}), seed=cfg.seed)
    roles = []
    for cell, (split, n) in ends.items():
        is_train = up_to(found.get(split))
        roles.append(role(cell, up_to(found.get(n)), is_train, ~is_train))
    return Split(with_roles(docs, cfg, roles), cfg, n_docs, tuple(distinct.index(n) for n in held))


def whole(docs: DataFrame, cfg: SearchConfig, n_skip: int) -> Split:
    """Train on all documents; all but the first ``n_skip`` of them are queries as well."""
    n = docs.count()
    cut = cuts(docs, [n_skip], seed=cfg.seed).get(n_skip) if n_skip <= n else None
    is_query = ~up_to(cut) if n_skip <= n else F.lit(False)
    roles = [role(0, F.lit(True), F.lit(True), is_query)]
    return Split(with_roles(docs, cfg, roles), cfg, {0: n})


def written_split(split: Split) -> Split:
    """The split with its documents written once, for plans that read the texts several times."""
    return replace(split, docs=materialise(split.docs, "split"))


def signed(split: Split) -> DataFrame:
    """Signatures and shingle counts of the readable documents, written once for all readers.

    One row per grid cell and document, with its roles in that cell; a document is signed once.
    """
    cfg = split.cfg
    signature = text_signature(F.col("text"), cfg.shingle_size, cfg.num_perm, cfg.shingle_mode).alias("signed")
    rows = split.docs.filter(F.size("roles") > 0).select("doc_id", "title", "order_key", "roles", signature)
    table = materialise(rows.select("*", "signed.*").drop("signed"), "signatures").filter("n_shingles > 0")
    return table.select("*", F.inline("roles")).drop("roles")


def exact_sides(split: Split) -> tuple[DataFrame, DataFrame, Callable]:
    """Query and train shingle sets for a search in blocks, with their scorer."""
    shingles = shingle_ids(F.col("text"), split.cfg.shingle_size, split.cfg.shingle_mode).alias("shingles")
    queries = split.side("is_query", F.col("doc_id").alias("query_id"), shingles)
    train = split.side("is_train", "doc_id", "order_key", shingles)
    return queries, train, set_scorer("shingles")


def signature_sides(table: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Query and train signatures for a search in blocks; rows without one of the columns are left out."""
    rows = table.dropna(subset=columns)
    queries = rows.filter("is_query").select("cell", F.col("doc_id").alias("query_id"), *columns)
    return queries, rows.filter("is_train").select("cell", "doc_id", "order_key", *columns)


def signature_profile(table: DataFrame, column: str = "sig") -> tuple[DataFrame, DataFrame, Callable]:
    """Both sides and their scorer for sums over all pairs."""
    return *signature_sides(table, [column]), signature_scorer(column)


def exact_top(split: Split, n: int) -> DataFrame:
    """The ``n`` train documents with the highest Jaccard similarity of each query."""
    return top_rows(*exact_sides(split), n)


def signature_tops(table: DataFrame, n: int, kinds: dict[str, tuple[str, int]]) -> DataFrame:
    """The lists of several searches in one pass: ``kinds`` names the signature column and its length of each.

    Rows: cell, kind, query_id, rank, doc_id, shared, score.
    """
    sides = signature_sides(table, sorted({column for column, _ in kinds.values()}))
    scorers = {kind: signature_scorer(column, length) for kind, (column, length) in kinds.items()}
    return tops_of(*sides, scorers, n)


def signature_top(table: DataFrame, n: int, column: str = "sig") -> DataFrame:
    """The ``n`` train documents with the most equal signature positions of each query."""
    return top_rows(*signature_profile(table, column), n)
