"""Every query against every train document, in blocks of bounded size.

A search by exact similarity compares all pairs, and on prose nearly every pair shares some
shingle, so an equi-join on shingles would emit almost all pairs once per shared shingle. Here
the rows of both sides are packed into blocks of bounded size where they are, and the blocks are written
once. Every pair of blocks meets in a task that reads them from there, so nothing is shuffled or copied for the
meeting, and only the best rows of a task's blocks (or sums over them) leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from akin.session import materialise

# Elements (shingles, signature positions, terms) of one block, and scores held at a time.
BLOCK_ELEMENTS = 2_000_000
BLOCK_ROWS = 16_384
SCORES = 2_000_000

# Meetings that a walk through inverted lists counts at a time, and cells that signatures are compared in: what they touch
# stays in a core's cache.
EXPANDED = 1 << 15
TILE = 1 << 17

# Cells of a block's frequent elements that are held as a matrix, a byte each.
HELD = 1 << 25

# An element goes to the matrix product when the pairs it joins exceed this share of all pairs;
# below it, one step through the lists per pair is faster (measured on prose).
DENSE = 0.001

# Partial results of a block of queries that are held before they are put together.
PARTIAL = 16

TOP_SCHEMA = "cell int, kind string, query_id long, doc_id long, order_key long, shared long, score double"
TOP_TYPES = pa.schema(
    [("cell", pa.int32()), ("kind", pa.string())]
    + [(name, pa.int64()) for name in ("query_id", "doc_id", "order_key", "shared")]
    + [("score", pa.float64())]
)


BLOCK_SCHEMA = "cell int, size long, block binary"

# Lists of up to this length are filled by repeated search for the maximum, longer ones by a sort.
SHORT_LIST = 16


def packed(rows: DataFrame) -> DataFrame:
    """The rows of each partition as blocks of one cell: (cell, size, block), a block an Arrow stream of at most BLOCK_ELEMENTS
    list elements, and one row more, in at most BLOCK_ROWS rows. Rows with a null in a column are left out.

    A list whose values repeat in the block is stored as places in the block's vocabulary. ``size`` is what the block has of
    BLOCK_ELEMENTS, where a row counts as a share of BLOCK_ROWS at least.
    """
    # Rows without a set are left out here: a filter on a UDF result would be pushed towards the scan and run the UDF twice.
    tables = lambda batches: (pa.Table.from_batches([batch]).drop_null() for batch in batches)
    return rows.mapInArrow(lambda batches: pack(tables(batches)), BLOCK_SCHEMA)


def pack(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[pa.Table]] = {}
    sizes: dict[int, int] = {}
    for table in tables:
        for cell in pc.unique(table["cell"]).to_pylist():
            part = table.filter(pc.equal(table["cell"], cell))
            ends = sizes.get(cell, 0) + np.cumsum(np.maximum(n_elements(part), -(-BLOCK_ELEMENTS // BLOCK_ROWS)))
            start = 0
            while start < part.num_rows:
                stop = min(part.num_rows, int(np.searchsorted(ends, BLOCK_ELEMENTS)) + 1)
                held.setdefault(cell, []).append(part.slice(start, stop - start))
                sizes[cell] = int(ends[stop - 1])
                if sizes[cell] >= BLOCK_ELEMENTS:
                    yield as_block(cell, sizes[cell], held.pop(cell))
                    ends = ends - sizes.pop(cell)
                start = stop
    for cell, parts in held.items():
        yield as_block(cell, sizes[cell], parts)


def merged(written: DataFrame) -> DataFrame:
    """The blocks of a written table in about as few as there can be: queries are spread over many partitions, few in each, and a
    train block costs a small block of queries as much to prepare as a full one."""
    counts = written.groupBy("cell").agg(F.count(F.lit(1)).alias("blocks"), F.sum("size").alias("size")).collect()
    fewest = max((-(-row["size"] // BLOCK_ELEMENTS) for row in counts), default=0)
    if all(2 * row["blocks"] <= 3 * -(-row["size"] // BLOCK_ELEMENTS) for row in counts):
        return written

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in batches:
            for block in batch.column(batch.schema.get_field_index("block")):
                yield with_values(pa.ipc.open_stream(block.as_buffer()).read_all())

    return written.coalesce(fewest).mapInArrow(lambda batches: pack(tables(batches)), BLOCK_SCHEMA)


def with_values(table: pa.Table) -> pa.Table:
    """The rows of a block with the values of their lists instead of places."""
    for i, name in enumerate(table.column_names):
        if pa.types.is_list(table.schema.field(name).type) and pa.types.is_dictionary(table.schema.field(name).type.value_type):
            lists = table[name].combine_chunks()
            lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int32)
            table = table.set_column(i, name, pa.ListArray.from_arrays(pa.array(ends), lists.flatten().dictionary_decode()))
    return table


def n_elements(table: pa.Table) -> np.ndarray:
    """List elements of each row, and one for the row."""
    found = np.ones(table.num_rows, dtype=np.int64)
    for name in table.column_names:
        if pa.types.is_list(table.schema.field(name).type):
            found += pc.list_value_length(table[name]).to_numpy()
    return found


def as_block(cell: int, size: int, parts: list[pa.Table]) -> pa.RecordBatch:
    table = pa.concat_tables(parts).combine_chunks()
    parts.clear()  # the caller holds no other copy
    if "order_key" in table.column_names:
        table = in_order(table)
    for i, name in enumerate(table.column_names):
        if pa.types.is_list(table.schema.field(name).type):
            table = table.set_column(i, name, with_vocabulary(table[name].chunk(0)))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(table)
    del table
    pa.default_memory_pool().release_unused()
    columns = [pa.array([cell], pa.int32()), pa.array([size], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["cell", "size", "block"])


def with_vocabulary(lists: pa.ListArray) -> pa.ListArray:
    """Lists as places in a vocabulary, which is in order so that two of them are compared in order."""
    coded = lists.flatten().dictionary_encode()
    if 2 * len(coded.dictionary) > len(coded):
        return lists
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), dtype=np.int32)
    rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    coded = pa.DictionaryArray.from_arrays(pa.array(rank[coded.indices.to_numpy()]), coded.dictionary.take(order))
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), coded)


def in_order(rows: pa.Table) -> pa.Table:
    """Train rows in the seeded order."""
    order = np.lexsort([rows[name].to_numpy() for name in ("doc_id", "order_key")])
    return rows if (order[1:] > order[:-1]).all() else rows.take(order)


def meet(queries: DataFrame, train: DataFrame, task: Callable, schema: str, combine: Callable | None = None) -> DataFrame:
    """Run ``task(queries)(train)`` on Arrow tables of each pair of blocks.

    Both sides carry ``cell``, the grid cell of a sweep (0 for a single run); cells never meet. The blocks are written once,
    about half of a set's size each, and read by the pairs of partitions of a cross join. A task that meets a query
    block with several train blocks prepares it once, and hands on their results put together by ``combine``, if given.
    """
    blocks = materialise(packed(queries), "query-blocks")
    full = merged(blocks)
    left = (blocks if full is blocks else materialise(full, "query-blocks")).select(F.col("cell").alias("left_cell"), F.col("block").alias("left"))
    right = materialise(packed(train), "train-blocks").select(F.col("cell").alias("right_cell"), F.col("block").alias("right"))

    def together(found: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        if found:
            yield from (found[0] if len(found) == 1 else combine(found)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, prepared, found = None, None, []
        for batch in batches:
            for row in range(batch.num_rows):
                left_cell, left, right_cell, right = (batch.column(i)[row] for i in range(4))
                if left_cell != right_cell:
                    continue
                if last is None or not last.equals(left.as_buffer()):
                    yield from together(found)
                    prepared, found = None, []  # the old block goes before the new one is prepared
                    last = pa.py_buffer(left.as_buffer().to_pybytes())
                    prepared = task(pa.ipc.open_stream(last).read_all())
                found.append(prepared(pa.ipc.open_stream(right.as_buffer()).read_all()))
                if combine is None:
                    yield from found.pop().to_batches()
                elif len(found) == PARTIAL:
                    found = [combine(found)]
        yield from together(found)

    # By pairs of partitions, a query block with all train blocks in turn; a broadcast side would come the other way round.
    return left.hint("shuffle_replicate_nl").crossJoin(right).mapInArrow(run, schema)


def ragged(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and row lengths of a list column."""
    values, lengths, vocabulary = coded(column)
    return values if vocabulary is None else vocabulary[values], lengths


def coded(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Values and row lengths of a list column, and the vocabulary that the values are places in, if it is stored with one."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    values, lengths = column.flatten(), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    if isinstance(values, pa.DictionaryArray):
        return values.indices.to_numpy(zero_copy_only=False), lengths, values.dictionary.to_numpy(zero_copy_only=False)
    return values.to_numpy(zero_copy_only=False), lengths, None


def row_chunks(n_rows: int, width: int) -> Iterator[slice]:
    step = max(1, SCORES // max(1, width))
    for start in range(0, n_rows, step):
        yield slice(start, min(start + step, n_rows))


class Postings:
    """Inverted lists of a block of sets, and their overlap with other sets.

    With a ``vocabulary`` the values are places in it. With ``weights`` of the values a shared element counts the product of
    its weights.
    """

    def __init__(
        self, values: np.ndarray, lengths: np.ndarray, vocabulary: np.ndarray | None = None, weights: np.ndarray | None = None
    ):
        narrow = np.int32 if len(values) < 1 << 31 else np.int64
        self.n_rows = len(lengths)
        if vocabulary is None:
            self.vocabulary, place = np.unique(values, return_inverse=True)
        else:
            in_order = np.argsort(vocabulary, kind="stable")
            rank = np.empty(len(vocabulary), dtype=narrow)
            rank[in_order] = np.arange(len(vocabulary))
            self.vocabulary, place = vocabulary[in_order], rank[values]
        order = np.argsort(place, kind="stable")
        # Narrow numbers: the lists of a block are read all over the place and should stay in the cache.
        self.rows = np.repeat(np.arange(self.n_rows, dtype=np.int16 if self.n_rows < 1 << 15 else np.int64), lengths)[order]
        self.weights = None if weights is None else weights[order]
        self.places = None if weights is None else place[order]
        del order
        counts = np.bincount(place, minlength=len(self.vocabulary))
        self.counts, self.starts = counts.astype(narrow), (np.cumsum(counts) - counts).astype(narrow)
        self._hold()

    def _hold(self) -> None:
        """Hold the elements that will be frequent in blocks like this one as a matrix (element x row of the block)."""
        frequent = np.flatnonzero(self.counts > np.sqrt(DENSE) * self.n_rows)
        most = HELD // max(1, self.n_rows)
        if len(frequent) > most:
            frequent = np.sort(frequent[np.argsort(-self.counts[frequent], kind="stable")[:most]])
        self.slot = np.full(len(self.vocabulary), -1, dtype=np.int32)
        self.slot[frequent] = np.arange(len(frequent))
        slots = np.repeat(self.slot, self.counts)
        at = np.flatnonzero(slots >= 0)
        self.held = np.zeros((len(frequent), self.n_rows), dtype=np.uint8)
        self.held[slots[at], self.rows[at]] = 1

    def _lists(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the given elements, one list after the other, and the lists' lengths."""
        copies = self.counts[part]
        ends = np.cumsum(copies, dtype=np.int64)
        place = np.repeat(self.starts[part] - (ends - copies), copies)
        place += np.arange(len(place))
        return self.rows.take(place), copies

    def _columns(self, part: np.ndarray) -> np.ndarray:
        """Matrix (given elements x rows of the block) of ones and zeros."""
        out = np.zeros((len(part), self.n_rows), dtype=np.float32)
        slots = self.slot[part]
        held = np.flatnonzero(slots >= 0)
        out[held] = self.held[slots[held]]
        other = np.flatnonzero(slots < 0)
        rows, copies = self._lists(part[other])
        out[np.repeat(other, copies), rows] = 1
        return out

    def _places(self, values: np.ndarray, vocabulary: np.ndarray | None) -> np.ndarray:
        """The place of each value in the block's vocabulary, -1 for values that are not in it."""
        distinct = values if vocabulary is None else vocabulary
        place = np.searchsorted(self.vocabulary, distinct).astype(self.starts.dtype)
        place[place == len(self.vocabulary)] = 0
        place[self.vocabulary[place] != distinct] = -1
        return place if vocabulary is None else place[values]

    def _hits(self, values: np.ndarray, lengths: np.ndarray, vocabulary: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """Of the values that the block holds: places in ``values``, in the block's vocabulary, set; and the elements for a product.

        An element in a large share of both sides is cheaper as a column of a matrix product, the others as a walk through
        their inverted lists.
        """
        place = self._places(values, vocabulary)
        hit = np.flatnonzero(place >= 0)
        place, column = place[hit], np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[hit]
        work = np.bincount(place, minlength=len(self.vocabulary)) * self.counts.astype(np.int64)
        return hit, place, column, np.flatnonzero(work > DENSE * self.n_rows * len(lengths))

    def overlap(
        self, values: np.ndarray, lengths: np.ndarray, vocabulary: np.ndarray | None = None, weights: np.ndarray | None = None
    ) -> np.ndarray:
        """Matrix (rows of the block x given sets) of shared elements, or with ``weights`` of their weight."""
        if weights is None:
            parts = [shared for _, shared in self.overlaps(values, lengths, vocabulary)]
            return np.concatenate([np.zeros((self.n_rows, 0), dtype=np.int64), *parts], axis=1)
        shared = np.zeros((self.n_rows, len(lengths)))
        if not len(self.vocabulary) or not len(values):
            return shared
        hit, place, column, dense = self._hits(values, lengths, vocabulary)
        weights = weights[hit]
        self._multiply(dense, place, column, weights, shared)
        rare = np.ones(len(self.vocabulary), dtype=bool)
        rare[dense] = False
        keep = rare[place]
        self._walk(place[keep], column[keep], weights[keep], shared)
        return shared

    def overlaps(
        self, values: np.ndarray, lengths: np.ndarray, vocabulary: np.ndarray | None = None
    ) -> Iterator[tuple[slice, np.ndarray]]:
        """The shared elements as ``overlap`` counts them, of a range of the given sets at a time."""
        if not len(self.vocabulary) or not len(values):
            for part in row_chunks(len(lengths), self.n_rows):
                yield part, np.zeros((self.n_rows, part.stop - part.start), dtype=np.int32)
            return
        _, place, column, dense = self._hits(values, lengths, vocabulary)
        number = np.full(len(self.vocabulary), -1, dtype=np.int32)
        number[dense] = np.arange(len(dense))
        number = number[place]
        for part in row_chunks(len(lengths), self.n_rows):
            some = slice(*np.searchsorted(column, [part.start, part.stop]))
            yield part, self._shared(place[some], column[some] - part.start, number[some], dense, part.stop - part.start)

    def _shared(self, place: np.ndarray, column: np.ndarray, number: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
        """Shared elements with ``n`` sets. ``number``: the place of an element in ``dense``, or -1; ``column`` is in order."""
        shared = np.zeros((self.n_rows, n), dtype=np.int32)
        step = max(1, SCORES // max(1, max(self.n_rows, n)))
        for start in range(0, len(dense), step):
            part = dense[start : start + step]
            at = np.flatnonzero((number >= start) & (number < start + len(part)))
            right = np.zeros((n, len(part)), dtype=np.float32)
            right[column[at], number[at] - start] = 1
            # Sums of at most ``step`` ones: exact.
            shared += (self._columns(part).T @ right.T).astype(np.int32)
        rare = np.flatnonzero(number < 0)
        place, column = place[rare], column[rare]
        ends = np.cumsum(self.counts[place], dtype=np.int64)
        start = 0
        while start < len(place):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + EXPANDED, side="right")))
            rows, copies = self._lists(place[start:stop])
            low, high = column[start], column[stop - 1] + 1
            begin = np.searchsorted(column[start:stop], np.arange(low, high))
            met = np.diff(np.append(ends[start:stop][begin] - copies[begin] - done, len(rows)))
            cell = rows + np.repeat(np.arange(high - low, dtype=np.int64) * self.n_rows, met)
            counted = np.bincount(cell, minlength=(high - low) * self.n_rows)
            shared[:, low:high] += counted.reshape(high - low, self.n_rows).T
            start = stop
        return shared

    def _multiply(
        self, dense: np.ndarray, place: np.ndarray, column: np.ndarray, weights: np.ndarray, shared: np.ndarray
    ) -> None:
        n = shared.shape[1]
        step = max(1, SCORES // max(1, max(self.n_rows, n)))
        slot = np.empty(len(self.vocabulary), dtype=np.int64)
        for start in range(0, len(dense), step):
            part = dense[start : start + step]
            slot.fill(-1)
            slot[part] = np.arange(len(part))
            mine, theirs = slot[self.places], slot[place]
            mine_at, theirs_at = np.flatnonzero(mine >= 0), np.flatnonzero(theirs >= 0)
            left = np.zeros((self.n_rows, len(part)))
            right = np.zeros((len(part), n))
            left[self.rows[mine_at], mine[mine_at]] = self.weights[mine_at]
            right[theirs[theirs_at], column[theirs_at]] = weights[theirs_at]
            shared += left @ right

    def _walk(self, place: np.ndarray, column: np.ndarray, weights: np.ndarray, shared: np.ndarray) -> None:
        n = shared.shape[1]
        expanded = np.cumsum(self.counts[place], dtype=np.int64)
        start = 0
        while start < len(place):
            done = expanded[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(expanded, done + SCORES, side="right")))
            part, copies = place[start:stop], self.counts[place[start:stop]]
            ends = np.cumsum(copies, dtype=np.int64)
            at = np.repeat(self.starts[part] - (ends - copies), copies) + np.arange(ends[-1])
            cell = self.rows[at].astype(np.int64) * n + np.repeat(column[start:stop], copies)
            product = self.weights[at] * np.repeat(weights[start:stop], copies)
            shared += np.bincount(cell, product, minlength=shared.size).reshape(shared.shape)
            start = stop


def best_rows(left: pa.Table, scorers: dict[str, Callable], n: int) -> Callable:
    """For each kind of score the ``n`` best train rows of a block per query; equal scores go to the earlier row.

    ``scorers[kind](left)`` returns a function from a train table to its ranges: (slice, shared, scores, unit of the scores).
    """
    prepared = {kind: scorer(left) for kind, scorer in scorers.items()} if left.num_rows else {}

    def best(right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return TOP_TYPES.empty_table()
        right = in_order(right)
        return pa.concat_tables([best_of_kind(left, right, kind, score, n) for kind, score in prepared.items()])

    return best


def best_of_both(n: int) -> Callable:
    """Puts lists of the same queries from several blocks together: the ``n`` best rows of each kind and query."""

    def combine(found: list[pa.Table]) -> pa.Table:
        rows = pa.concat_tables(found).combine_chunks()
        kinds = rows["kind"].combine_chunks().dictionary_encode().indices.to_numpy()
        number = {name: rows[name].to_numpy() for name in ("query_id", "order_key", "doc_id", "score")}
        order = np.lexsort([number["doc_id"], number["order_key"], -number["score"], number["query_id"], kinds])
        kinds, asked = kinds[order], number["query_id"][order]
        first = np.ones(len(order), dtype=bool)
        first[1:] = (kinds[1:] != kinds[:-1]) | (asked[1:] != asked[:-1])
        begin = np.flatnonzero(first)
        nth = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
        return rows.take(order[nth < n])

    return combine


def best_places(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` highest scores of each row, in order; equal scores in the order of their places."""
    if n > SHORT_LIST or n >= scores.shape[1]:
        return np.argsort(-scores, axis=1, kind="stable")[:, :n]
    left, rows = scores.copy(), np.arange(len(scores))
    lowest = -np.inf if left.dtype.kind == "f" else np.iinfo(left.dtype).min
    found = np.empty((len(scores), n), dtype=np.int64)
    for nth in range(n):
        found[:, nth] = left.argmax(axis=1)
        left[rows, found[:, nth]] = lowest
    return found


def best_of_kind(left: pa.Table, right: pa.Table, kind: str, score: Callable, n: int) -> pa.Table:
    n_left = left.num_rows
    best = np.empty((n_left, 0))
    best_shared = np.empty((n_left, 0), dtype=np.int64)
    best_row = np.empty((n_left, 0), dtype=np.int64)
    for part, shared, scores, unit in score(right):
        keep = best_places(scores, n)
        pick = lambda held, new: np.concatenate([held, np.take_along_axis(new, keep, axis=1)], axis=1)  # noqa: B023, E731
        best, best_shared, best_row = pick(best, scores), pick(best_shared, shared), np.concatenate([best_row, keep + part.start], axis=1)
        keep = np.argsort(-best, axis=1, kind="stable")[:, :n]
        best, best_shared, best_row = (np.take_along_axis(held, keep, axis=1) for held in (best, best_shared, best_row))
    flat = best_row.ravel()
    return pa.table(
        {
            "cell": np.full(len(flat), left["cell"][0].as_py(), dtype=np.int32),
            "kind": pa.array([kind] * len(flat), pa.string()),
            "query_id": np.repeat(left["query_id"].to_numpy(), best_row.shape[1]),
            "doc_id": right["doc_id"].to_numpy()[flat],
            "order_key": right["order_key"].to_numpy()[flat],
            "shared": best_shared.ravel(),
            "score": best.ravel() / unit,
        },
        schema=TOP_TYPES,
    )


def set_scorer(column: str) -> Callable:
    """Exact Jaccard of two set columns."""

    def prepare(left: pa.Table):
        values, n_left, vocabulary = coded(left[column])
        postings = Postings(values, n_left, vocabulary)

        def score(right: pa.Table):
            other, n_right, vocabulary = coded(right[column])
            for part, shared in postings.overlaps(other, n_right, vocabulary):
                yield part, shared, shared / (n_left[:, None] + n_right[None, part] - shared), 1

        return score

    return prepare


def weight_scorer(left_column: str, right_column: str, digits: int) -> Callable:
    """Summed products of the weights (0 or more) of shared ``terms``, rounded; -1 where none is shared."""

    def prepare(left: pa.Table):
        values, lengths, vocabulary = coded(left["terms"])
        postings = Postings(values, lengths, vocabulary, ragged(left[left_column])[0].astype(np.float64))

        def score(right: pa.Table):
            for part in row_chunks(right.num_rows, left.num_rows):
                rows = right.slice(part.start, part.stop - part.start)
                others = coded(rows["terms"])
                shared = postings.overlap(*others)
                weight = postings.overlap(*others, ragged(rows[right_column])[0].astype(np.float64))
                yield part, shared, np.where(shared > 0, np.round(weight, digits), -1.0), 1

        return score

    return prepare


def signature_scorer(column: str, length: int | None = None) -> Callable:
    """Fraction of equal positions of two signature columns, of their first ``length`` positions if given."""

    def matrix(rows: pa.Table) -> np.ndarray:
        # Values lie below 2^31; a position is a row, so that it is read in one go.
        values = ragged(rows[column])[0].reshape(rows.num_rows, -1)
        return np.ascontiguousarray(values[:, :length].astype(np.int32).T)

    def prepare(left: pa.Table):
        mine = matrix(left)

        def score(right: pa.Table):
            theirs = matrix(right)
            # Scores are small whole numbers here, so more of them are held at a time.
            for part in row_chunks(right.num_rows, -(-mine.shape[1] // 4)):
                equal = equal_positions(mine, theirs[:, part])
                yield part, equal, equal, len(mine)

        return score

    return prepare


def equal_positions(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """Matrix of the number of equal positions of signatures, whose positions are rows here; a tile at a time."""
    n_left, n_right = mine.shape[1], theirs.shape[1]
    equal = np.zeros((n_left, n_right), dtype=np.int16 if len(mine) < 1 << 15 else np.int64)
    theirs = np.ascontiguousarray(theirs)
    step = max(1, TILE // max(1, n_right))
    for start in range(0, n_left, step):
        tile = equal[start : start + step]
        same, sums = np.empty(tile.shape, dtype=bool), np.empty(tile.shape, dtype=np.uint8)
        for first in range(0, len(mine), 255):  # as many as a byte counts
            sums.fill(0)
            for own, other in zip(mine[first : first + 255, start : start + step], theirs[first : first + 255], strict=True):
                np.equal(own[:, None], other, out=same)
                np.add(sums, same.view(np.uint8), out=sums)
            tile += sums
    return equal


def agreement_scorer(column: str) -> Callable:
    """As ``signature_scorer``, for signatures that seldom agree: a walk through lists of positions and values, not every position."""

    def elements(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        # Values lie below 2^31, so a position and its value are one element.
        values = ragged(rows[column])[0].reshape(rows.num_rows, -1)
        n = values.shape[1]
        return (values + (np.arange(n, dtype=np.int64) << 32)).ravel(), np.full(rows.num_rows, n)

    def prepare(left: pa.Table):
        mine = elements(left)
        postings = Postings(*mine)

        def score(right: pa.Table):
            for part, shared in postings.overlaps(*elements(right)):
                yield part, shared, shared, mine[1][0]

        return score

    return prepare


def tops_of(queries: DataFrame, train: DataFrame, scorers: dict[str, Callable], n: int) -> DataFrame:
    """For each kind of score the ``n`` best train documents of each query, all kinds in one meeting of the blocks.

    Rows: cell, kind, query_id, rank, doc_id, shared, score.
    """
    # Written, so that batches of blocks are bounded whoever asks for the lists.
    parts = materialise(meet(queries, train, lambda left: best_rows(left, scorers, n), TOP_SCHEMA, best_of_both(n)), "block-tops")
    order = Window.partitionBy("cell", "kind", "query_id").orderBy(F.desc("score"), "order_key", "doc_id")
    return (
        parts.withColumn("rank", F.row_number().over(order).cast("long"))
        .filter(F.col("rank") <= n)
        .select("cell", "kind", "query_id", "rank", "doc_id", "shared", "score")
    )


def top_rows(queries: DataFrame, train: DataFrame, scorer: Callable, n: int) -> DataFrame:
    """The ``n`` best train documents of each query: cell, query_id, rank, doc_id, shared, score."""
    return tops_of(queries, train, {"": scorer}, n).drop("kind")


PROFILE_SCHEMA = "cell int, query_id long, n_pairs long, n_disjoint long, sum_shared long, max_score double"


def profile_rows(left: pa.Table, scorer: Callable, number: str | None = None) -> Callable:
    """Sums over all pairs of each query with the train rows of a block; a row stands for ``number`` documents, if given."""
    score, n_left = scorer(left), left.num_rows

    def profiled(right: pa.Table) -> pa.Table:
        n_pairs, n_disjoint, sum_shared = (np.zeros(n_left, dtype=np.int64) for _ in range(3))
        best = np.zeros(n_left)
        numbers = right[number].to_numpy() if number else np.ones(right.num_rows, dtype=np.int64)
        for part, shared, scores, unit in score(right):
            n_pairs += numbers[part].sum()
            n_disjoint += (shared == 0) @ numbers[part]
            sum_shared += shared @ numbers[part]
            best = np.maximum(best, scores.max(axis=1) / unit)
        return pa.table(
            {
                "cell": left["cell"],
                "query_id": left["query_id"],
                "n_pairs": n_pairs,
                "n_disjoint": n_disjoint,
                "sum_shared": sum_shared,
                "max_score": best,
            }
        )

    return profiled


def added(found: list[pa.Table]) -> pa.Table:
    """Puts sums over several blocks together. A row of the same query comes from each of them, in the same order."""
    out = {name: found[0][name] for name in ("cell", "query_id")}
    for name in ("n_pairs", "n_disjoint", "sum_shared"):
        out[name] = sum(rows[name].to_numpy() for rows in found)
    return pa.table(out | {"max_score": np.max([rows["max_score"].to_numpy() for rows in found], axis=0)})


def profile(queries: DataFrame, train: DataFrame, scorer: Callable) -> DataFrame:
    """Per query over all train documents: pairs, pairs without a shared element, shared elements
    in all and the best score. The pairs themselves are never written out."""
    return profile_of(queries, train, lambda left: profile_rows(left, scorer))


def profile_of(queries: DataFrame, train: DataFrame, task: Callable) -> DataFrame:
    """The sums that ``task`` (see ``profile_rows``) gives for blocks, per query over all of them."""
    parts = materialise(meet(queries, train, task, PROFILE_SCHEMA, added), "block-sums")
    return parts.groupBy("cell", "query_id").agg(
        F.sum("n_pairs").alias("n_pairs"),
        F.sum("n_disjoint").alias("n_disjoint"),
        F.sum("sum_shared").alias("sum_shared"),
        F.max("max_score").alias("max_score"),
    )
