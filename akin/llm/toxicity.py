"""Toxicity by the nearest labelled examples, found exactly by cosine over a block-max inverted index.

Terms are words. Fitted on a bounded sample: ``PER_LABEL`` labelled examples of each class, EXAMPLE_CHARS characters in all,
are the examples to search and their words are the vocabulary; a word that no example has can't add to a cosine and isn't in
the norms. A word weighs 1 + ln of its frequency times its idf, from document frequencies over all documents, times 1 and the
chi-square of its occurrence and the label. That last factor goes beyond plain TF-IDF; what it is worth stands in the README.

The examples are dealt to blocks of BLOCK. The index holds, for every term and block, the largest weight there, and the postings
of the block; terms that many examples hold are rows of a matrix in both. For a document the largest weights give each block
an upper bound. Blocks are opened while their bound reaches the document's k-th best cosine so far, so what stays closed
cannot hold a neighbour and the neighbours are exact. Their votes, weighted by cosine, go through a monotone map
fitted to the votes on the examples themselves. There each is judged without itself, and with weights that have not
seen its label: the chi-squares of a half of the examples are taken from the other half.

The model's size is that of the examples. It goes to every worker as terms and counts, compressed, and is indexed there once;
documents are scored where they are.
"""

from __future__ import annotations

import hashlib
import io
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from akin.llm.divergence import term_lists
from akin.llm.labels import bounded_sample, prior, remainder, training_labels
from akin.llm.tables import dropped, kept, written

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
PER_LABEL, EXAMPLE_CHARS, NEAREST, EVIDENCE = 1500, 24_000_000, 15, 3
BLOCK, QUERIES = 64, 128
COMMON = 8  # terms that one of so many examples holds are rows of a matrix
HALVES = 2
MEMO_WORDS = 1 << 18
DIGITS = 12


class Rows(NamedTuple):
    """Sparse rows: where each row starts, then the terms (rising) and weights of all."""

    starts: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    width: int

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[i], self.starts[i + 1])
        return self.terms[part], self.weights[part]

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))

    def some(self, first: int, last: int) -> Rows:
        low, high = self.starts[first], self.starts[last]
        return Rows(self.starts[first : last + 1] - low, self.terms[low:high], self.weights[low:high], self.width)


def words(text: str | None) -> Counter[bytes]:
    """How often each word occurs: runs of lower-cased ASCII letters and of characters beyond ASCII, as UTF-8."""
    found: Counter[bytes] = Counter()
    for part in term_lists((text or "").lower().encode()):
        found.update(part)
    return found


def stacked(rows: list[tuple[np.ndarray, np.ndarray]], width: int) -> Rows:
    starts = np.cumsum([0, *(len(t) for t, _ in rows)])
    terms = np.concatenate([np.zeros(0, np.int32), *(t for t, _ in rows)])
    return Rows(starts, terms, np.concatenate([np.zeros(0), *(w for _, w in rows)]), width)


def counted(texts: list[str | None], terms: dict[bytes, int]) -> Rows:
    """Terms of each text and how often they occur."""
    rows = []
    for text in texts:
        found = words(text)
        at = np.fromiter((terms.get(w, -1) for w in found), np.int32, len(found))
        often = np.fromiter(found.values(), np.float64, len(found))
        order = np.argsort(at, kind="stable")[np.count_nonzero(at < 0) :]
        rows.append((at[order], often[order]))
    return stacked(rows, len(terms))


def weighted(rows: Rows, value: np.ndarray) -> Rows:
    """Counts turned into rows of length 1 with weights (1 + ln tf) * value of the term; empty rows stay empty."""
    weights = (1 + np.log(rows.weights)) * value[rows.terms]
    of = rows.owners()
    norms = np.sqrt(np.bincount(of, weights**2, len(rows.starts) - 1))
    return rows._replace(weights=weights / np.where(norms > 0, norms, 1)[of])


class Block(NamedTuple):
    """Examples ``first`` on: the matrix of common terms, and postings of the others by term."""

    first: int
    common: np.ndarray
    terms: np.ndarray
    starts: np.ndarray
    places: np.ndarray
    weights: np.ndarray


class Examples(NamedTuple):
    """The index: ids, labels and class weights of the examples, and their vectors in blocks.

    ``column`` is a term's row in the matrices, -1 for the others. ``common_most`` and the rows of ``most`` hold the largest
    weight of a term in each block, ``slots`` the term's place in the postings there. ``ranks`` orders equal cosines.
    """

    doc_ids: np.ndarray
    labels: np.ndarray
    class_weights: np.ndarray
    ranks: np.ndarray
    vectors: Rows
    column: np.ndarray
    blocks: list[Block]
    common_most: np.ndarray
    most: Rows
    slots: np.ndarray


def indexed(doc_ids: np.ndarray, labels: np.ndarray, rows: Rows, counts: tuple[int, int]) -> Examples:
    """Put examples of one kind together, by label and leading common term, and list them by block and term."""
    n, often = len(doc_ids), np.bincount(rows.terms, minlength=rows.width)
    column = np.full(rows.width, -1, np.int32)
    many = np.flatnonzero(often * COMMON >= max(n, 1))
    column[many] = np.arange(len(many))
    ranks = np.empty(n, np.int64)
    ranks[np.lexsort((labels, doc_ids))] = np.arange(n)
    leading = np.full(n, -1)
    for i in range(n):
        terms, weights = rows.row(i)
        shared = column[terms] >= 0
        leading[i] = terms[shared][weights[shared].argmax()] if shared.any() else -1
    order = np.lexsort((ranks, leading, labels))
    kept = stacked([rows.row(i) for i in order], rows.width)
    blocks, tops = [], []
    common_most = np.zeros((len(many), -(-n // BLOCK)))
    for b, first in enumerate(range(0, n, BLOCK)):
        part = kept.some(first, min(n, first + BLOCK))
        of, at = part.owners(), column[part.terms]
        matrix = np.zeros((len(many), len(part.starts) - 1))
        matrix[at[at >= 0], of[at >= 0]] = part.weights[at >= 0]
        common_most[:, b] = matrix.max(axis=1, initial=0)
        rare = np.flatnonzero(at < 0)
        rare = rare[np.argsort(part.terms[rare], kind="stable")]
        terms, starts = np.unique(part.terms[rare], return_index=True)
        blocks.append(Block(first, matrix, terms, np.append(starts, len(rare)), of[rare], part.weights[rare]))
        if len(terms):
            tops.append((terms, np.full(len(terms), b), np.maximum.reduceat(part.weights[rare], starts), np.arange(len(terms))))
    terms, places, weights, slots = (np.concatenate(c) for c in zip(*tops, strict=True)) if tops else (np.zeros(0, np.int64),) * 4
    by_term = np.argsort(terms, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(terms, minlength=rows.width))])
    most = Rows(starts, places[by_term], weights[by_term], len(blocks))
    # The sample takes both classes evenly: an example counts for the labelled rows it stands for.
    shares = np.array(counts) / np.maximum(np.bincount(labels, minlength=2), 1)
    own = (doc_ids[order], labels[order], shares[labels[order]], ranks[order])
    return Examples(*own, kept, column, blocks, common_most, most, slots[by_term])


def spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, and the range each belongs to."""
    sizes = ends - starts
    of = np.repeat(np.arange(len(starts)), sizes)
    return np.arange(len(of)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes), of


class Search:
    """A batch of queries against the index: bounds of all blocks, cosines with those that are opened.

    Of the other terms there is an entry for every query, term and block that holds the term, sorted by block.
    """

    def __init__(self, queries: Rows, index: Examples):
        self.index, self.n = index, len(queries.starts) - 1
        of, at = queries.owners(), index.column[queries.terms]
        self.dense = np.zeros((self.n, len(index.common_most)))
        self.dense[of[at >= 0], at[at >= 0]] = queries.weights[at >= 0]
        of, terms, weights = of[at < 0], queries.terms[at < 0], queries.weights[at < 0]
        at, entry = spread(index.most.starts[terms], index.most.starts[terms + 1])
        order = np.argsort(index.most.terms[at], kind="stable")
        at, entry = at[order], entry[order]
        self.block, self.slot, self.most = index.most.terms[at], index.slots[at], index.most.weights[at]
        self.of, self.weights = of[entry], weights[entry]
        self.begin = np.searchsorted(self.block, np.arange(len(index.blocks) + 1))

    def bounds(self) -> np.ndarray:
        """At least the cosine of every query with any example of each block."""
        n_blocks = len(self.index.blocks)
        rare = np.bincount(self.of * n_blocks + self.block, self.most * self.weights, self.n * n_blocks)
        return self.dense @ self.index.common_most + rare.reshape(self.n, n_blocks)

    def cosines(self, b: int, asking: np.ndarray) -> np.ndarray:
        """Of the queries in ``asking`` with the examples of block ``b``."""
        block = self.index.blocks[b]
        width = block.common.shape[1]
        found = self.dense[asking] @ block.common
        row = np.full(self.n, -1)
        row[asking] = np.arange(len(asking))
        part = slice(self.begin[b], self.begin[b + 1])
        held = np.flatnonzero(row[self.of[part]] >= 0) + part.start
        at, entry = spread(block.starts[self.slot[held]], block.starts[self.slot[held] + 1])
        entry = held[entry]
        cell = row[self.of[entry]] * width + block.places[at]
        found += np.bincount(cell, block.weights[at] * self.weights[entry], found.size).reshape(found.shape)
        return np.round(found, DIGITS)


def nearest(queries: Rows, index: Examples, k: int, leave: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Cosines and places of the ``k`` nearest examples, exactly, and how many blocks were opened; ties to the smaller rank.

    ``leave`` names an example for each query that doesn't count. Missing neighbours have place -1.
    """
    n, opened = len(queries.starts) - 1, 0
    best, where = np.full((n, k), -1.0), np.full((n, k), -1, np.int64)
    behind = np.append(index.ranks, len(index.ranks))  # the rank of no neighbour, at place -1
    for low in range(0, n if index.blocks else 0, QUERIES):
        some = queries.some(low, min(n, low + QUERIES))
        search = Search(some, index)
        bounds = search.bounds()
        closed = np.ones(bounds.shape, bool)
        own, held = best[low : low + search.n], where[low : low + search.n]

        def visit(b: int, asking: np.ndarray) -> None:
            block = index.blocks[b]
            found = search.cosines(b, asking)
            places = np.broadcast_to(np.arange(block.first, block.first + found.shape[1]), found.shape).copy()
            if leave is not None:
                out = places == leave[low + asking][:, None]
                found[out], places[out] = -1, -1
            found, places = np.hstack([own[asking], found]), np.hstack([held[asking], places])
            order = np.lexsort((behind[places], -found), axis=1)[:, :k]
            own[asking], held[asking] = np.take_along_axis(found, order, 1), np.take_along_axis(places, order, 1)
            closed[asking, b] = False

        # Each query's most promising block first, then all others that may still hold a neighbour.
        first = bounds.argmax(axis=1)
        for b in np.unique(first):
            visit(b, np.flatnonzero(first == b))
        for b in np.argsort(-bounds.mean(axis=0), kind="stable"):
            asking = np.flatnonzero(closed[:, b] & (bounds[:, b] + 1e-9 >= own[:, -1]))
            if len(asking):
                visit(b, asking)
        opened += int((~closed).sum())
    return best, where, opened


class Model(NamedTuple):
    terms: dict[bytes, int]
    value: np.ndarray
    examples: Examples
    base: float
    votes: np.ndarray
    scores: np.ndarray


def votes(best: np.ndarray, where: np.ndarray, index: Examples, base: float) -> np.ndarray:
    """Share of label 1 among the neighbours, weighted by cosine; ``base`` where nothing is near."""
    weight = np.maximum(best, 0) * np.where(where >= 0, index.class_weights[where], 0) if len(index.labels) else best * 0
    total = weight.sum(1)
    toxic = (weight * (index.labels[where] if len(index.labels) else 0)).sum(1)
    return np.where(total > 0, toxic / np.where(total > 0, total, 1), base)


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the best non-decreasing fit of ``y`` to ``x`` (pooling neighbours that fall)."""
    pools: list[list[float]] = []  # mean of y, weight, weighted sum of x
    for i in np.lexsort((y, x)):
        pools.append([y[i], weight[i], x[i] * weight[i]])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][2] * pools[-1][1] == pools[-1][2] * pools[-2][1]):
            (m1, w1, s1), (m2, w2, s2) = pools[-2], pools.pop()
            pools[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, s1 + s2]
    return np.array([s / w for _, w, s in pools]), np.array([m for m, _, _ in pools])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many examples of each label and half hold a term."""
    held = [Counter() for _ in range(2 * HALVES)]
    for batch in batches:
        for label, half, text in zip(*(batch.column(c).to_pylist() for c in ("label", "half", "text")), strict=True):
            held[2 * half + label].update(words(text).keys())
            if sum(map(len, held)) >= MEMO_WORDS:
                yield _counts(held)
    yield _counts(held)


def _counts(held: list[Counter]) -> pa.RecordBatch:
    terms = list(set().union(*held))
    columns = [pa.array(terms, pa.binary()).cast(pa.string()), *(pa.array([h[t] for t in terms], pa.int64()) for h in held)]
    for h in held:
        h.clear()
    return pa.RecordBatch.from_arrays(columns, ["term", *(f"n{i}" for i in range(len(held)))])


def chi_square(a: np.ndarray, b: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Of occurrence and label, for terms in ``a`` of ``n1`` and ``b`` of ``n0`` examples; 0 where either doesn't vary."""
    c, d = n1 - a, n0 - b
    below = (a + b) * (c + d) * n1 * n0
    return np.where(below > 0, (n0 + n1) * (a * d - b * c) ** 2 / np.where(below > 0, below, 1), 0)


def vocabulary(sample: DataFrame) -> tuple[list[str], np.ndarray]:
    """All terms of the sample, in order, and a row of chi-squares for each half left out, then of all examples."""
    sizes = np.zeros(2 * HALVES)
    for r in sample.groupBy("half", "label").count().collect():
        sizes[2 * r["half"] + r["label"]] = r["count"]
    names = [f"n{i}" for i in range(2 * HALVES)]
    found = sample.select("label", "half", "text").mapInArrow(_term_counts, "term string, " + ", ".join(f"{n} long" for n in names))
    counts = found.groupBy("term").agg(*[F.sum(n).cast("double").alias(n) for n in names]).toArrow().sort_by("term")
    held = np.array([counts.column(n).to_numpy() for n in names])
    seen = [[h for h in range(HALVES) if h != left] for left in range(HALVES)] + [list(range(HALVES))]
    clean, toxic = ([np.array([2 * h + label for h in halves]) for halves in seen] for label in (0, 1))
    both = [chi_square(held[t].sum(0), held[c].sum(0), sizes[t].sum(), sizes[c].sum()) for c, t in zip(clean, toxic, strict=True)]
    return counts.column("term").to_pylist(), np.array(both)


def document_frequencies(docs: DataFrame, terms: dict[bytes, int]) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many hold each term, over all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(terms) + 1, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                held = [terms[w] for w in words(text.as_py()) if w in terms]
                seen[held] += 1
                seen[-1] += 1
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["term", "n"])

    counts = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(terms) + 1, np.int64)
    got = counts.toArrow()  # one row for each term of the examples
    out[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return int(out[-1]), out[:-1]


def examples_of(docs: DataFrame, given: DataFrame) -> DataFrame:
    """doc_id, label, half, text: the sample, in the order of its hashes while it stays within EXAMPLE_CHARS."""
    sample = bounded_sample(docs, given, PER_LABEL)
    before = Window.orderBy("draw", "doc_id", "text").rowsBetween(Window.unboundedPreceding, 0)
    keyed = sample.withColumn("draw", F.xxhash64("doc_id")).withColumn("text", F.coalesce("text", F.lit("")))
    # At most 2 * PER_LABEL rows (and repeated ones); only their lengths are summed.
    held = keyed.withColumn("chars", F.sum(F.length("text")).over(before)).where(F.col("chars") <= EXAMPLE_CHARS)
    return held.select("doc_id", "label", F.pmod("draw", F.lit(HALVES)).cast("int").alias("half"), "text")


def fitted(docs: DataFrame, labels: DataFrame) -> bytes:
    """The model of the training rows of ``labels`` among ``docs``, for ``unpacked``."""
    given = training_labels(docs, labels, "toxic", FOLDS, HELD_OUT)
    counts = prior(given)
    sample = written(examples_of(docs, given), "toxicity-sample")
    names, chi = vocabulary(sample)
    terms = {t.encode(): i for i, t in enumerate(names)}
    n, often = document_frequencies(docs, terms)
    values = (np.log((n + 1) / (often + 1)) + 1e-3) * (1 + chi)
    base = (counts[1] + 1) / (sum(counts) + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = counted(batch.column("text").to_pylist(), terms)
            both = zip(*(rows.row(i) for i in range(batch.num_rows)), strict=True) if batch.num_rows else ((), ())
            packed = [pa.array([x.astype(np.int32).tobytes() for x in column], pa.binary()) for column in both]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in schema.names[:3]), *packed], schema.names)

    schema = StructType([sample.schema[c] for c in ("doc_id", "label", "half")]).add("terms", "binary").add("counts", "binary")
    found = sample.mapInArrow(run, schema).toArrow()  # at most 2 * PER_LABEL rows, of EXAMPLE_CHARS characters
    pairs = zip(found.column("terms"), found.column("counts"), strict=True)
    held = stacked([tuple(np.frombuffer(x.as_buffer(), np.int32) for x in pair) for pair in pairs], len(terms))
    doc_ids, marks, halves = (found.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "label", "half"))

    # The votes on the examples take several indexes: a task's work, of which only the points of the map come back.
    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            made = calibrated(doc_ids, marks, halves, held, values, counts, base)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in made], ["vote", "score"])

    fit = docs.sparkSession.range(0, 1, 1, 1).mapInArrow(points, "vote double, score double").toArrow().sort_by("vote")
    at, score = (fit.column(c).to_numpy() for c in ("vote", "score"))
    stored = io.BytesIO()
    np.savez_compressed(
        stored,
        names=np.frombuffer("\n".join(names).encode(), np.uint8),
        value=values[-1],
        doc_ids=doc_ids,
        labels=marks,
        starts=held.starts,
        terms=held.terms,
        often=held.weights.astype(np.min_scalar_type(int(held.weights.max(initial=0)))),
        counts=counts,
        base=base,
        votes=at,
        scores=score,
    )
    dropped(sample)
    return stored.getvalue()


def calibrated(
    doc_ids: np.ndarray, labels: np.ndarray, halves: np.ndarray, held: Rows, values: np.ndarray, counts: tuple[int, int], base: float
) -> tuple[np.ndarray, np.ndarray]:
    """The monotone map from votes to scores, by the votes on examples whose labels their weights have not seen."""
    if not len(doc_ids):
        return np.zeros(1), np.array([base])
    share, weight = np.zeros(len(doc_ids)), np.zeros(len(doc_ids))
    for half in range(HALVES):
        index = indexed(doc_ids, labels, weighted(held, values[half]), counts)
        # The index has its own order; rows of one id are told apart by their ranks.
        rows = np.empty(len(doc_ids), np.int64)
        rows[index.ranks] = np.arange(len(doc_ids))
        rows = rows[np.argsort(np.lexsort((labels, doc_ids)), kind="stable")]
        mine = np.flatnonzero(halves == half)
        asked = stacked([index.vectors.row(i) for i in rows[mine]], held.width)
        best, where, _ = nearest(asked, index, NEAREST, rows[mine])
        share[mine] = votes(best, where, index, base)
        weight[mine] = index.class_weights[rows[mine]]
    return monotone(share, labels.astype(float), weight)


def unpacked(model: bytes) -> Model:
    """The model that ``fitted`` stored, indexed once in a Python worker."""

    def indexed_model() -> Model:
        stored = np.load(io.BytesIO(model))
        names, value = stored["names"].tobytes(), stored["value"]
        terms = {t: i for i, t in enumerate(names.split(b"\n"))} if len(value) else {}
        held = Rows(stored["starts"], stored["terms"], stored["often"].astype(np.float64), len(value))
        index = indexed(stored["doc_ids"], stored["labels"], weighted(held, value), tuple(stored["counts"]))
        index = index._replace(vectors=Rows(np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0), 0))
        return Model(terms, value, index, float(stored["base"]), stored["votes"], stored["scores"])

    return kept(("toxicity", hashlib.sha256(model).digest()), indexed_model)


def judged(model: Model, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of a batch of texts, and the cosines and places of their nearest examples."""
    rows = weighted(counted(batch.column("text").to_pylist(), model.terms), model.value)
    best, where, _ = nearest(rows, model.examples, NEAREST)
    share = votes(best, where, model.examples, model.base)
    return np.round(np.clip(np.interp(share, model.votes, model.scores), 0, 1), 9), best, where


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is not predicted to be toxic."""
    stored = fitted(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unpacked(stored)
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                yield part.filter(pa.array(judged(model, part)[0] < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score all documents: doc_id, held_out, score, predicted, evidence, cosines.

    ``evidence`` has the ids of the nearest labelled examples (at most EVIDENCE), ``cosines`` their similarities.
    Learns from labelled rows outside the held-out fold only; the text is a document's only input.
    Null and empty texts, and texts without any term of the vocabulary, get the share of label 1, as do
    all without labels. A null ``doc_id`` is not held out. Repeated rows are scored alike; an empty table
    gives no rows; other columns are ignored. Examples of equal cosine count in the order of their ids. A text of any
    length is read whole; its distinct words are held.
    """
    stored = fitted(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unpacked(stored)
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                part = batch.slice(at, QUERIES)
                score, best, where = judged(model, part)
                near = [
                    [(int(model.examples.doc_ids[w]), float(b)) for w, b in zip(ws, bs, strict=True) if b > 0]
                    for ws, bs in zip(where[:, :EVIDENCE], best[:, :EVIDENCE], strict=True)
                ]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "score": pa.array(score, pa.float64()),
                        "evidence": pa.array([[w for w, _ in x] for x in near], pa.list_(pa.int64())),
                        "cosines": pa.array([[b for _, b in x] for x in near], pa.list_(pa.float64())),
                    }
                )

    schema = docs.select("doc_id").schema.add("score", "double").add("evidence", ArrayType(LongType()))
    scores = docs.select("doc_id", "text").mapInArrow(run, schema.add("cosines", ArrayType(schema["score"].dataType)))
    return scores.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "evidence",
        "cosines",
    )
