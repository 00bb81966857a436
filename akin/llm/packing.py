"""Packing of token sequences by large-item matching and best fit.

Documents become pieces of at most ``CAPACITY`` tokens. Where a piece goes depends on its length and on its
number among the pieces of that length only, so the packing is planned on the histogram of
lengths: at most ``CAPACITY`` numbers, whatever the size of the corpus. Pieces above a third of the
capacity go at most two to a sequence: from the longest down, each takes the longest partner that still fits.
The smaller ones follow from the longest down, each into the smallest gap that holds it. Equal lengths and
equal gaps are handled in one step, so a plan has a few thousand runs. The pieces are then numbered
within their length, a hot length in parts, and look up their run.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from akin.llm.bpe import LibraryTokenizer, tokenizer
from akin.llm.tables import numbered, written

CAPACITY = 4096
END = 1


class Run(NamedTuple):
    """Pieces ``first`` on of a length: ``each`` in every sequence from ``sequence`` on, from ``offset`` on."""

    length: int
    first: int
    each: int
    sequence: int
    offset: int


class _Plan:
    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.capacity = dict(counts), capacity
        self.placed = dict.fromkeys(counts, 0)
        self.sequences = 0
        self.runs: list[Run] = []
        self.gaps: list[int] = []  # in order; groups: for each gap the sequences (first, number) that have it
        self.groups: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in self.groups:
                insort(self.gaps, gap)
                self.groups[gap] = []
            self.groups[gap].append((first, n))

    def take(self, gap: int) -> tuple[int, int]:
        first = self.groups[gap].pop()
        if not self.groups[gap]:
            del self.groups[gap]
            self.gaps.pop(bisect_left(self.gaps, gap))
        return first

    def opened(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def put(self, length: int, n: int, each: int, sequence: int, offset: int) -> None:
        self.runs.append(Run(length, self.placed[length], each, sequence, offset))
        self.placed[length] += n * each
        self.left[length] -= n * each

    def pair_large(self) -> None:
        large = sorted(x for x, n in self.left.items() if 3 * x > self.capacity and n)
        while large:
            longest = large[-1]
            at = bisect_left(large, self.capacity - longest + 1) - 1
            n = self.left[longest]
            if at < 0:
                first, gap = self.opened(n), self.capacity - longest
                self.put(longest, n, 1, first, 0)
            elif (partner := large[at]) == longest and n > 1:
                first, gap, n = self.opened(n // 2), self.capacity - 2 * longest, n // 2
                self.put(longest, n, 2, first, 0)
            elif partner == longest:
                # Its last piece looks for a shorter partner.
                if at:
                    partner = large[at - 1]
                    first, gap, n = self.opened(1), self.capacity - longest - partner, 1
                    self.put(longest, 1, 1, first, 0)
                    self.put(partner, 1, 1, first, longest)
                else:
                    first, gap = self.opened(1), self.capacity - longest
                    self.put(longest, 1, 1, first, 0)
            else:
                n = min(n, self.left[partner])
                first, gap = self.opened(n), self.capacity - longest - partner
                self.put(longest, n, 1, first, 0)
                self.put(partner, n, 1, first, longest)
            self.add(gap, first, n)
            large = [x for x in large if self.left[x]]

    def fit_small(self) -> None:
        for length in sorted((x for x, n in self.left.items() if n), reverse=True):
            while n := self.left[length]:
                at = bisect_left(self.gaps, length)
                if at < len(self.gaps):
                    gap = self.gaps[at]
                    first, many = self.take(gap)
                else:
                    gap, each = self.capacity, self.capacity // length
                    many = -(-n // each)
                    first = self.opened(many)
                each, offset = gap // length, self.capacity - gap
                full = min(many, n // each)
                if full:
                    self.put(length, full, each, first, offset)
                    self.add(gap - each * length, first, full)
                some = min(n - full * each, each - 1) if full < many else 0
                if some:
                    self.put(length, 1, some, first + full, offset)
                    self.add(gap - some * length, first + full, 1)
                self.add(gap, first + full + bool(some), many - full - bool(some))


def planned(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Runs in the order of length and number, and how many sequences they fill.

    ``counts`` maps lengths from 1 to ``capacity`` to how many pieces have them.
    """
    if any(not 1 <= x <= capacity for x in counts):
        raise ValueError("a length is outside 1 to the capacity")
    plan = _Plan(counts, capacity)
    plan.pair_large()
    plan.fit_small()
    return sorted(plan.runs), plan.sequences


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Token pieces of whole texts: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    Every document's ids end with END. A null or empty text is the END alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path, LibraryTokenizer)
        end = struct.pack("<I", END)
        for batch in batches:
            # Pieces go out every few thousand, so that very long texts don't gather.
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = own.encode(text.as_py() or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    listed = np.frombuffer(part, "<i4") if with_ids else None
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), listed))
                if len(rows) >= 4096:
                    yield _batch(rows, batch.schema.field("doc_id").type, with_ids)
                    rows = []
            if rows:
                yield _batch(rows, batch.schema.field("doc_id").type, with_ids)

    schema = docs.select("doc_id").schema.add("piece", IntegerType()).add("start", "long").add("length", "long")
    schema = schema.add("ids_crc32", "long")
    return docs.select("doc_id", "text").mapInArrow(run, schema.add("ids", ArrayType(IntegerType())) if with_ids else schema)


def _batch(rows: list[tuple], doc_type: pa.DataType, with_ids: bool) -> pa.RecordBatch:
    docs, number, start, length, crc, ids = zip(*rows, strict=True)
    columns = {
        "doc_id": pa.array([d.as_py() for d in docs], doc_type),
        "piece": pa.array(number, pa.int32()),
        "start": pa.array(start, pa.int64()),
        "length": pa.array(length, pa.int64()),
        "ids_crc32": pa.array(crc, pa.int64()),
    }
    if with_ids:
        columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
    return pa.RecordBatch.from_pydict(columns)


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    The sequences are filled without gaps from offset 0. A null or empty text packs its END token; repeated rows
    (also of one doc_id) are packed each; an empty table gives no rows; other columns are ignored.
    """
    found = written(pieces(docs, path, capacity, with_ids), "pieces")
    histogram = found.groupBy("length").count().collect()  # at most ``capacity`` rows
    runs, _ = planned({r["length"]: r["count"] for r in histogram}, capacity)
    keys = np.array([r.length << 44 | r.first for r in runs], np.int64)
    first, each, sequence, offset = np.array([r[1:] for r in runs] or np.zeros((0, 4)), np.int64).T

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_number"))
            run = np.searchsorted(keys, length << 44 | number, "right") - 1
            nth = number - first[run]
            columns = {c: batch.column(c) for c in batch.schema.names if c != "_number"}
            columns["sequence_id"] = pc.cast(pa.array(sequence[run] + nth // each[run]), pa.int64())
            columns["offset"] = pa.array(offset[run] + nth % each[run] * length)
            yield pa.RecordBatch.from_pydict(columns)

    schema = StructType(list(found.schema.fields)).add("sequence_id", "long").add("offset", "long")
    ranked = numbered(found, ["length"], ["doc_id", "piece", "ids_crc32"], "_number")
    ordered = ranked.select(*found.columns, F.col("_number").cast("long").alias("_number"))
    return ordered.mapInArrow(place, schema)
