"""How far the word use of the sources of a language diverges, in exact integers.

Terms are counted per language, source and term, first in the task that reads the texts, then in Spark. A language keeps the
terms of at least ``LEAST`` of its documents; they get ids, and ids are cut into chunks. A group (language, source) is
a sorted array of (term id, count) per chunk.

Pair tasks: a language's sources are dealt to small blocks, and for every two blocks and every chunk the arrays meet in one
task. There each unordered pair is merged sparsely: a galloping search finds the common ids, and the terms of
both, of one and of neither side are priced without ever listing the absent ones. The price of a pair is the
same both ways, so a merge serves both directions. Sums over chunks are taken in Spark.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from akin.llm.minhash import groups
from akin.llm.tables import dropped, written

LEAST, ADDED, ONE, TOP = 10, 2, 1_000_000_000, 10
# ONE as steps of a long division, so that counts up to 9 * 10^15 stay exact.
STEPS = (1000, 1000, 1000)
CHUNK_BITS, BLOCK = 16, 16
TEXT_BYTES, HELD = 1 << 22, 300_000

# A term is a run of ASCII letters and of bytes above 7F; only A-Z are lowered, all other bytes part terms.
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded number of bytes at a time (a single term is never cut)."""
    text, start = text.translate(LETTERS), 0
    while start < len(text):
        end = text.find(b" ", start + TEXT_BYTES)
        end = len(text) if end < 0 else end
        yield text[start:end].split()
        start = end


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, n, docs: sums over the texts of a task, handed on whenever many terms are held."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            if n:
                terms = pa.array(list(n), pa.binary()).cast(pa.string())
                columns = [pa.array([lang] * len(n)), pa.array([source] * len(n)), terms]
                columns += [pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        names = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        for key, text in zip(names, batch.column("text"), strict=True):
            n, docs = held.setdefault(key, (Counter(), Counter()))
            before, found = len(n), set()
            for terms in term_lists(text.as_py()):
                n.update(terms)
                found.update(terms)
            docs.update(found)
            size += len(n) - before
            if size >= HELD:
                yield from given()
                held, size = {}, 0
    yield from given()


def leap(ids: np.ndarray, wanted: int, at: int) -> int:
    """The first place from ``at`` on whose id is at least ``wanted``: steps that double, then halving."""
    step = 1
    while at + step < len(ids) and ids[at + step] < wanted:
        at += step
        step *= 2
    return at + int(np.searchsorted(ids[at : at + step + 1], wanted))


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the ids of both, by galloping through the longer one."""
    if len(a) > len(b):
        right, left = common(b, a)
        return left, right
    found, places, at, step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 256
    for start in range(0, len(a), step):
        part = a[start : start + step]
        at = leap(b, part[0], at)
        if at >= len(b):
            break
        end = min(leap(b, part[-1], at) + 1, len(b))
        place = at + np.searchsorted(b[at:end], part)
        hit = np.flatnonzero(b[np.minimum(place, len(b) - 1)] == part)
        found.append(start + hit)
        places.append(place[hit])
        at = end - 1
    return np.concatenate(found), np.concatenate(places)


def prices(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(ONE * (count + ADDED) / (total + ADDED * terms)) of every count, by long division."""
    whole, rest = np.divmod(np.asarray(counts, np.int64) + ADDED, total + ADDED * terms)
    for step in STEPS:
        more, rest = np.divmod(rest * step, total + ADDED * terms)
        whole = whole * step + more
    return 1 + whole


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Group:
    """A source's counts in one chunk of the terms, priced."""

    def __init__(self, source: str, block: int, total: int, terms: int, ids: np.ndarray, counts: np.ndarray):
        self.source, self.block, self.ids = source, block, ids
        self.prices = prices(counts, total, terms) if terms else counts
        self.absent = prices(np.zeros(1, np.int64), total, terms) if terms else np.zeros(1, np.int64)


def divergence(a: Group, b: Group, size: int) -> int:
    """The sum of gaps over the ``size`` terms of the chunk."""
    if not size:
        return 0
    left, right = common(a.ids, b.ids)
    only_a, only_b = np.ones(len(a.ids), bool), np.ones(len(b.ids), bool)
    only_a[left], only_b[right] = False, False
    value = int(gap(a.prices[left], b.prices[right]).sum())
    value += int(gap(a.prices[only_a], b.absent).sum()) + int(gap(a.absent, b.prices[only_b]).sum())
    neither = size - len(a.ids) - len(b.ids) + len(left)
    return value + neither * int(gap(a.absent, b.absent)[0])


def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, a, b, value: the divergence of each pair of sources of two blocks within a chunk, a before b."""
    for rows in groups(batches, ["lang", "left", "right", "chunk"]):
        members, empty = [], np.zeros(0, np.int64)
        for row, counts in zip(rows.drop_columns("counts").to_pylist(), rows.column("counts"), strict=True):
            ids, values = (counts.values.field(f).to_numpy() if counts.is_valid else empty for f in ("id", "n"))
            members.append(Group(row["source"], row["block"], row["total"], row["terms"], ids, values))
        lang, left, right, size = (rows.column(c)[0].as_py() for c in ("lang", "left", "right", "size"))
        firsts, seconds = ([m for m in members if m.block == block] for block in (left, right))
        found = []
        for i, a in enumerate(firsts):
            for b in firsts[i + 1 :] if left == right else seconds:
                low, high = sorted((a.source, b.source))
                found.append((lang, low, high, divergence(a, b, size)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], ["lang", "a", "b", "value"])


def price(count: str, total: str) -> Column:
    """``prices`` as a column expression; ``terms`` is the number of kept terms."""
    below = f"({total} + {ADDED} * terms)"
    whole, rest = f"(({count} + {ADDED}) div {below})", f"(({count} + {ADDED}) % {below})"
    for step in STEPS:
        whole, rest = f"({whole} * {step} + ({rest} * {step}) div {below})", f"(({rest} * {step}) % {below})"
    return F.expr(f"1 + {whole}")


def ranked(rows: DataFrame) -> DataFrame:
    """Add rank from 1 in every group: higher values first, ties by the item's bytes."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def audited(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: divergence of the sources of each language, and the terms that mark a source.

    Part ``pair`` has every other source of the language, part ``term`` the TOP terms that a source uses more than its language.
    Null text, lang and source are empty strings. Every row is a document of its own, repeated ones too. Texts without
    terms make a group without counts; a language without kept terms has divergence 0 everywhere. Ties go by the bytes of
    the item. Texts of any length are counted in parts of bounded size. An empty table gives no rows; other columns are ignored.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").cast("binary").alias("text"))
    found = rows.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    sums = [F.sum("n").alias("n"), F.sum("docs").alias("docs")]
    terms = written(found.groupBy("lang", "source", "term").agg(*sums), "term-counts")

    vocabulary = terms.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST)
    # Ids are consecutive within a written partition, so a chunk holds at most 2^CHUNK_BITS terms of all languages.
    vocabulary = written(vocabulary.select("lang", "term", "in_lang", F.monotonically_increasing_id().alias("id")), "vocabulary")
    vocabulary = vocabulary.withColumn("chunk", F.shiftright("id", CHUNK_BITS))
    kept = written(terms.drop("docs").join(vocabulary, ["lang", "term"]), "kept-counts")

    sources = rows.select("lang", "source").distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("in_lang").alias("lang_total"))
    blocks = sources.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    members = sources.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").join(blocks, "lang")
    members = written(members.fillna(0, ["total", "terms", "lang_total"]), "sources")

    nothing = F.lit(0).cast("long")
    chunks = vocabulary.groupBy("lang", "chunk").agg(F.count(F.lit(1)).alias("size"))
    chunks = members.select("lang").distinct().join(chunks, "lang", "left").fillna(0, ["chunk", "size"])
    arrays = kept.groupBy("lang", "source", "chunk").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("counts"))
    block = F.pmod(F.xxhash64("source"), F.col("blocks"))
    tiles = members.withColumn("block", block).join(chunks, "lang").join(arrays, ["lang", "source", "chunk"], "left")
    tiles = tiles.withColumn("other", F.explode(F.sequence(nothing, F.col("blocks") - 1)))
    tiles = tiles.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
    keys = ["lang", "left", "right", "chunk"]
    tiles = tiles.select(*keys, "size", "source", "block", "total", "terms", "counts").repartition(*keys).sortWithinPartitions(*keys)
    pairs = tiles.mapInArrow(paired, "lang string, a string, b string, value long")
    pairs = pairs.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in ("ab", "ba")]))
    pairs = ranked(pairs.select("lang", ways.alias("way"), "value").select("lang", "way.source", "way.item", "value"))

    priced = kept.join(members.select("lang", "source", "total", "terms", "lang_total"), ["lang", "source"])
    priced = priced.select("lang", "source", F.col("term").alias("item"), price("n", "total").alias("p"), price("in_lang", "lang_total").alias("q"))
    marks = ranked(priced.where("p > q").select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value")))
    marks = marks.where(F.col("rank") <= TOP)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    result = written(columns(pairs, "pair").unionAll(columns(marks, "term")), "divergence")
    dropped(terms, vocabulary, kept, members)
    return result
