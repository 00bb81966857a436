"""Hard negatives for contrastive training, from exact integer scores by Strassen's multiplication.

An anchor's scores with a block of candidates are a matrix product. It is taken tile by tile, by Strassen's recursion:
seven products of half the size instead of eight, odd sizes padded with zeros, and sums that stay 64-bit integers.
A tile's scores go into heaps: for each anchor the best rows of its own label (positives), then, for each positive, the best
rows of other labels whose score lies in the positive's window (negatives). Heaps merge: tiles are merged in the task, tasks
by a window over rows that are already cut to the heap's size.

Positives need only rows of the anchor's label, so the first pass meets by label. A label that holds many
rows is dealt to blocks. The second pass knows each window and meets all rows, in blocks. In a task a slice of the
anchors is resident and candidates stream past, so memory depends on neither the block nor the label.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from akin.llm.tables import dropped, written
from akin.llm.vectors import usable

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 5
LOW, HIGH = 80, 100
# Anchors resident in a task, candidates and anchors of a tile, and vector components of either.
ANCHORS, CANDIDATES, TILE, COMPONENTS = 16_384, 2_048, 512, 4_000_000
# Rows of a block, and labels that are dealt to several blocks at most.
BLOCK_MIN, BLOCK_MAX, MANY_LABELS = 4_096, 65_536, 10_000
LEAF = 16
EXACT = 1 << 53


def largest(a: np.ndarray) -> int:
    return max(int(a.max()), -int(a.min()))


def plain_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer product of small matrices: by floating point where every partial sum is an exact double."""
    if largest(a) * largest(b) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def even(a: np.ndarray) -> np.ndarray:
    """The matrix with a row and a column of zeros added where their number is odd."""
    return np.pad(a, [(0, n % 2) for n in a.shape]) if a.shape[0] % 2 or a.shape[1] % 2 else a


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of int64 matrices by Strassen's recursion; like int64 itself, exact modulo 2^64."""
    m, n = a.shape[0], b.shape[1]
    if 0 in (m, n, a.shape[1]):
        return np.zeros((m, n), np.int64)
    if min(m, n, a.shape[1]) <= LEAF:
        return plain_product(a, b)
    a, b = even(a), even(b)
    i, j, k = a.shape[0] // 2, b.shape[1] // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :k], a[:i, k:], a[i:, :k], a[i:, k:]
    b11, b12, b21, b22 = b[:k, :j], b[:k, j:], b[k:, :j], b[k:, j:]
    p1 = product(a11 + a22, b11 + b22)
    p2 = product(a21 + a22, b11)
    p3 = product(a11, b12 - b22)
    p4 = product(a22, b21 - b11)
    p5 = product(a11 + a12, b22)
    p6 = product(a21 - a11, b11 + b12)
    p7 = product(a12 - a22, b21 + b22)
    c = np.empty((2 * i, 2 * j), np.int64)
    c[:i, :j] = p1 + p4 - p5 + p7
    c[:i, j:] = p3 + p5
    c[i:, :j] = p2 + p4
    c[i:, j:] = p1 - p2 + p3 + p6
    return c[:m, :n]


class Heaps:
    """The ``k`` best (score, id) of every slot; higher scores first, ties to the smaller id."""

    def __init__(self, slots: int, k: int):
        self.k, self.fill = k, np.zeros(slots, np.int64)
        self.scores, self.ids = np.zeros((slots, k), np.int64), np.zeros((slots, k), np.int64)

    def least(self, slot: int) -> int | None:
        """The score below which nothing enters the slot; None while it has room."""
        return int(self.scores[slot, -1]) if self.fill[slot] == self.k else None

    def merge(self, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        held = self.fill[slot]
        scores = np.concatenate([self.scores[slot, :held], scores])
        ids = np.concatenate([self.ids[slot, :held], ids])
        best = np.lexsort((ids, ~scores))[: self.k]
        self.fill[slot] = len(best)
        self.scores[slot, : len(best)], self.ids[slot, : len(best)] = scores[best], ids[best]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slot, score and id of everything held."""
        held = np.arange(self.k)[None, :] < self.fill[:, None]
        return np.nonzero(held)[0], self.scores[held], self.ids[held]


class Side:
    """Ids, labels and vectors of some rows, and the windows of anchors."""

    def __init__(self, parts: list[pa.RecordBatch], dim: int):
        rows = pa.Table.from_batches(parts)
        self.ids = rows.column("vec_id").to_numpy()
        self.labels = rows.column("label").to_numpy()
        self.vectors = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        self.windows = rows.column("windows").to_pylist()


class PositiveTask:
    schema = "anchor_id long, positive_id long, score long"

    def __init__(self, anchors: Side):
        self.anchors, self.heaps = anchors, Heaps(len(anchors.ids), POSITIVES)

    def offer(self, start: int, scores: np.ndarray, rows: Side) -> None:
        """Scores of the anchors from ``start`` on with some candidates."""
        for i, line in enumerate(scores, start):
            able = (rows.labels == self.anchors.labels[i]) & (rows.ids != self.anchors.ids[i])
            least = self.heaps.least(i)
            at = np.flatnonzero(able if least is None else able & (line >= least))
            if len(at):
                self.heaps.merge(i, line[at], rows.ids[at])

    def result(self) -> pa.RecordBatch:
        slot, scores, ids = self.heaps.rows()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (self.anchors.ids[slot], ids, scores)], ["anchor_id", "positive_id", "score"])


class NegativeTask:
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, score long"

    def __init__(self, anchors: Side):
        self.anchors = anchors
        self.first, self.ids, self.scores = [], [], []
        for window in anchors.windows:
            self.first.append(len(self.ids))
            self.ids += [w["positive_id"] for w in window or ()]
            self.scores += [w["score"] for w in window or ()]
        self.first.append(len(self.ids))
        # Whole scores of the window: LOW * positive <= 100 * score <= HIGH * positive.
        self.low = [-(-LOW * s // 100) for s in self.scores]
        self.high = [HIGH * s // 100 for s in self.scores]
        self.heaps = Heaps(len(self.ids), NEGATIVES)

    def offer(self, start: int, scores: np.ndarray, rows: Side) -> None:
        for i, line in enumerate(scores, start):
            slots = range(self.first[i], self.first[i + 1])
            if not slots:
                continue
            low, high = min(self.low[s] for s in slots), max(self.high[s] for s in slots)
            at = np.flatnonzero((rows.labels != self.anchors.labels[i]) & (line >= low) & (line <= high))
            at = at[np.lexsort((rows.ids[at], ~line[at]))]
            falling = ~line[at]
            for s in slots:
                low, least = self.low[s], self.heaps.least(s)
                begin = np.searchsorted(falling, ~self.high[s], "left")
                end = np.searchsorted(falling, ~(low if least is None else max(low, least)), "right")
                chosen = at[begin : min(end, begin + NEGATIVES)]
                if len(chosen):
                    self.heaps.merge(s, line[chosen], rows.ids[chosen])

    def result(self) -> pa.RecordBatch:
        slot, scores, ids = self.heaps.rows()
        owner = np.repeat(self.anchors.ids, np.diff(self.first))
        columns = [owner[slot], np.array(self.ids, np.int64)[slot], np.array(self.scores, np.int64)[slot], ids, scores]
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "score"]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def pieces(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    """Parts of the batches that are equal in ``keys`` and side, in their order."""
    for batch in batches:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in (*keys, "side")]
        changes = np.zeros(batch.num_rows + 1, bool)
        changes[[0, -1]] = True
        for c in columns:
            changes[1:-1] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(changes)
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(int(c[begin]) for c in columns)
            yield key[:-1], key[-1], batch.slice(begin, end - begin)


def scored(anchors: Side, rows: Side, task) -> None:
    for start in range(0, len(anchors.ids), TILE):
        tile = anchors.vectors[start : start + TILE]
        task.offer(start, product(tile, np.ascontiguousarray(rows.vectors.T)), rows)


def heaps_of(kind: type, keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reads sorted rows of the form keys, side (0 anchors, 1 candidates): the anchors of a key stay, candidates pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, resident, waiting, n_waiting, task, anchors = None, [], [], 0, None, None

        def take() -> None:
            nonlocal waiting, n_waiting, task, anchors
            if waiting and resident:
                if task is None:
                    anchors = Side(resident, key[0])
                    task = kind(anchors)
                scored(anchors, Side(waiting, key[0]), task)
            waiting, n_waiting = [], 0

        for here, side, part in pieces(batches, keys):
            if here != key:
                take()
                if task is not None:
                    yield task.result()
                key, resident, task, anchors = here, [], None, None
            if side == 0:
                resident.append(part)
                continue
            room = max(1, min(CANDIDATES, COMPONENTS // key[0]))
            for start in range(0, part.num_rows, room):
                waiting.append(part.slice(start, room))
                n_waiting += waiting[-1].num_rows
                if n_waiting >= room:
                    take()
        take()
        if task is not None:
            yield task.result()

    return run


def dealt(n: Column | int) -> Column:
    return F.pmod(F.xxhash64("vec_id"), n if isinstance(n, Column) else F.lit(n)).cast("long")


def every(n: Column | int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), (n if isinstance(n, Column) else F.lit(n)).cast("long") - 1))


def meet(anchors: DataFrame, rows: DataFrame, keys: list[str], blocks, slices, kind: type) -> DataFrame:
    """Every anchor with every row of its ``keys``: ``rows`` in blocks, ``anchors`` in slices, a task for each of both."""
    keys = [*keys, "block", "slice"]
    columns = [c for c in ("side", "vec_id", "label", "x", "windows") if c not in keys]
    left = anchors.withColumn("side", F.lit(0)).withColumn("slice", dealt(slices)).withColumn("block", every(blocks))
    right = rows.withColumn("side", F.lit(1)).withColumn("block", dealt(blocks)).withColumn("slice", every(slices))
    right = right.withColumn("windows", F.lit(None).cast(anchors.schema["windows"].dataType))
    both = left.select(*keys, *columns).unionAll(right.select(*keys, *columns))
    both = both.repartition(*keys).sortWithinPartitions(*keys, "side")
    return both.mapInArrow(heaps_of(kind, keys), kind.schema)


def ranked(rows: DataFrame, groups: list[str], order: list, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return rows.withColumn("rank", place).where(F.col("rank") <= k)


def quantised(rows: DataFrame) -> DataFrame:
    """vec_id, label, dim, x: the rows that take part, one for each id, components as floor(SCALE * component)."""
    vectors = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("long").alias("label"),
    )
    good = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    one = good.groupBy("vec_id").agg(F.min(F.struct("embedding", "label")).alias("row"))
    x = F.transform("row.embedding", lambda c: F.floor(c * SCALE).cast("long"))
    return one.select("vec_id", F.col("row.label").alias("label"), F.size("row.embedding").cast("long").alias("dim"), x.alias("x"))


def mined(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows of vec_id, label, dim, x.

    An anchor's positives are the POSITIVES best other rows of its label; a positive's negatives are the NEGATIVES best rows of
    other labels with LOW * positive_score <= 100 * negative_score <= HIGH * positive_score.
    """
    rows = written(rows, "vectors")
    no_windows = F.lit(None).cast("array<struct<score:bigint,positive_id:bigint>>")
    anchors = rows.where(is_anchor).withColumn("windows", no_windows)
    total = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("dim"), F.lit(1)), F.count_if(is_anchor)).first()
    n, dim, n_anchors = total
    cores = rows.sparkSession.sparkContext.defaultParallelism
    block = min(BLOCK_MAX, max(BLOCK_MIN, n // (2 * cores)))
    resident = max(1, min(ANCHORS, COMPONENTS // dim))
    parts = lambda count, size: max(1, -(-count // size))

    # Labels above the limit number at most MANY_LABELS, whatever the rows.
    limit = max(block, n // MANY_LABELS)
    counts = rows.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(is_anchor).alias("n_anchors"))
    large = counts.where(F.col("n_rows") > limit).select(
        "dim",
        "label",
        F.ceil(F.col("n_rows") / limit).alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.col("n_anchors") / resident)).alias("slices"),
    )
    large = F.broadcast(written(large, "large-labels"))
    one = lambda name: F.coalesce(F.col(name), F.lit(1)).cast("long")
    split = lambda df: df.join(large, ["dim", "label"], "left")
    found = meet(split(anchors), split(rows), ["dim", "label"], one("blocks"), one("slices"), PositiveTask)
    positives = ranked(found, ["anchor_id"], [F.desc("score"), "positive_id"], POSITIVES)
    windows = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("score", "positive_id")).alias("windows"))
    asking = written(anchors.drop("windows").join(windows, "vec_id"), "anchors")

    found = meet(asking, rows, ["dim"], parts(n, block), parts(n_anchors, resident), NegativeTask)
    negatives = ranked(found, ["anchor_id", "positive_id"], [F.desc("score"), "negative_id"], NEGATIVES)
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score")]
    result = written(negatives.select(*columns), "hard-negatives")
    dropped(rows, asking)
    return result


def hard_negatives(rows: DataFrame) -> DataFrame:
    """Hard negatives of the anchors, the rows whose id is divisible by EVERY; labels of ids divisible by 7 are moved by one first.

    Null ids and labels, null or empty vectors and vectors with null or non-finite components take no part. Of several rows of
    one id the one with the smallest vector, then label, counts. Vectors of different lengths don't meet. Ties go to the smaller
    id. Scores are 64-bit integers: components or products beyond them wrap. An anchor without positives and a positive without
    negatives give no rows, nor does an empty table; other columns are ignored.
    """
    good = quantised(rows)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(good.withColumn("label", moved), F.col("vec_id") % EVERY == 0)
