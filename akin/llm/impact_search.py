"""Exact top-k search by integer inner product over an impact-ordered index.

Vectors are turned into integers and dealt to blocks. In a block every dimension has a posting list in the order of
impact, cut into segments of one quantised impact. A query takes segments score at a time: from the largest
contribution down, in rounds. After a round each vector has an upper bound: what its seen postings contribute and,
for every dimension not seen, the largest contribution still to come. The k-th best exact score among the most
promising vectors is a lower bound for the result; when few vectors can still reach it, these are scored exactly and the
block is done. Nothing is left out without that proof.

The queries are a stated set; blocks of queries meet blocks of vectors, and only the k best of each leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from akin.llm.minhash import groups
from akin.llm.tables import written
from akin.llm.vectors import one_per_id

SCALE, TOP, EVERY = 256, 5, 50
BLOCK, QUERIES = 4096, 1024
SEGMENTS = 512
ROUNDS = (4, 16, None)
FEW = 8


class Block:
    """Posting lists of one block. ``ids`` ascend, so that the smaller position has the smaller id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        n, dims = values.shape
        self.low = values.min(0)
        width = max(1, int((values.max(0) - self.low).max()) + 1)
        self.shift = max(0, (width - 1).bit_length() - (SEGMENTS - 1).bit_length())
        segment = (values - self.low) >> self.shift
        # Postings by rising value; a segment is a range of them.
        self.postings = np.argsort(values, axis=0, kind="stable").T.copy()
        self.impacts = np.take_along_axis(values.T, self.postings, 1)
        counts = np.zeros((dims, (width - 1 >> self.shift) + 2), np.int64)
        np.add.at(counts, (np.arange(dims)[None, :].repeat(n, 0), segment + 1), 1)
        self.begins = counts.cumsum(1)

    def top(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, ties to the smaller id; the row with id ``own`` is left out."""
        n, dims = self.values.shape
        k = min(k, n)
        rise, last = query > 0, self.begins.shape[1] - 1
        greatest = np.maximum(query * self.impacts[:, 0], query * self.impacts[:, -1])
        most, free = int(greatest.max()), self.ids != own
        used = np.flatnonzero(query)
        for part in ROUNDS:
            if part is None or most <= 0:
                start, stop = np.zeros(dims, np.int64), np.full(dims, n)
                ahead = np.zeros(dims, np.int64)
                part = None
            else:
                # Whole segments whose largest contribution is at least this: values from, or up to, a bound.
                bound = np.divide(most / part, query, out=np.zeros(dims), where=query != 0)
                segment = np.clip((np.floor(bound).astype(np.int64) - self.low) >> self.shift, -1, last)
                start = np.where(rise, self.begins[np.arange(dims), np.clip(segment, 0, last)], 0)
                stop = np.where(rise, n, self.begins[np.arange(dims), np.clip(segment + 1, 0, last)])
                # The largest contribution that is still to come in each dimension.
                edge = np.where(rise, np.maximum(start - 1, 0), np.minimum(stop, n - 1))
                ahead = np.where(query == 0, 0, query * self.impacts[np.arange(dims), edge])
            seen = np.concatenate([self.postings[d, start[d] : stop[d]] for d in used]) if len(used) else np.zeros(0, np.int64)
            gain = np.concatenate([query[d] * self.impacts[d, start[d] : stop[d]] - ahead[d] for d in used]) if len(used) else seen
            reach = np.bincount(seen, gain, n).astype(np.int64) + int(ahead.sum())
            best = np.flatnonzero(free)
            if len(best) > k:
                best = best[np.argpartition(-reach[best], k - 1)[:k]]
            least = int((self.values[best] @ query).min()) if len(best) == k else None
            able = np.flatnonzero(free & (reach >= least)) if least is not None else np.flatnonzero(free)
            if part is None or len(able) * FEW <= n:
                score = self.values[able] @ query
                order = np.lexsort((able, -score))[:k]
                return self.ids[able[order]], score[order]
        raise AssertionError("the last round sees everything")


def _rows(group: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    values = group.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return group.column("vec_id").to_numpy(), values.reshape(-1, dim)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in groups(batches, ["dim", "block", "part"]):
        side = group.column("side").to_numpy()
        dim = int(group.column("dim")[0].as_py())
        ids, values = _rows(group.filter(pa.array(side == 0)), dim)
        asked, queries = _rows(group.filter(pa.array(side == 1)), dim)
        if not len(ids) or not len(asked):
            continue
        order = np.argsort(ids, kind="stable")
        block = Block(ids[order], values[order])
        found = [block.top(q, own, TOP) for own, q in zip(asked, queries, strict=True)]
        columns = [
            np.repeat(asked, [len(i) for i, _ in found]),
            np.concatenate([i for i, _ in found]),
            np.concatenate([s for _, s in found]),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])


def quantised(rows: DataFrame) -> DataFrame:
    """vec_id, x: floor(SCALE * component) of every usable vector."""
    good = one_per_id(rows)
    return good.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x * SCALE).cast("long")).alias("x")
    )


def top_scores(rows: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: the TOP best of every query, all if there are fewer.

    Queries are the rows whose id is divisible by EVERY, candidates all other rows; vectors of different lengths don't
    meet. Vectors that are null or empty or hold null or non-finite components take no part, nor do null ids.
    Rows of one id count once. Ties go to the smaller id. An empty table gives no rows; other columns are ignored.
    """
    good = written(quantised(rows), "quantised").withColumn("dim", F.size("x"))
    asked = good.where(F.col("vec_id") % EVERY == 0)
    parts = max(1, -(-asked.count() // QUERIES))
    blocks = max(1, -(-good.count() // BLOCK))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = good.select("dim", deal(blocks).alias("block"), every(parts).alias("part"), F.lit(0).alias("side"), "vec_id", "x")
    right = asked.select("dim", every(blocks).alias("block"), deal(parts).alias("part"), F.lit(1).alias("side"), "vec_id", "x")
    keys = ["dim", "block", "part"]
    meeting = left.unionAll(right).repartition(*keys).sortWithinPartitions(*keys, "side")
    best = meeting.mapInArrow(_search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return ranked.select("query_id", "rank", "vec_id", "score")
