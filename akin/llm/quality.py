"""Quality classifier with learned subword embeddings.

A document is the sum of averages of learned vectors: of its words, of its word pairs and of its character n-grams
by size, each hashed to one of ``BUCKETS`` rows. All pairs of equal words share a row. A softmax over two classes follows. Vectors and softmax are trained by
stochastic gradient descent on a bounded sample of labelled rows (``PER_LABEL`` of each class and
``FEATURES`` hashed features in all); the share of the classes is counted on all labelled rows. The
features of the sample are taken in the tasks, the model of fixed size goes to every task, and
documents are scored where they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from akin.llm.labels import bounded_sample, prior, remainder, training_labels
from akin.llm.tables import dropped, parts, written

FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
BITS, DIMENSIONS = 16, 8
BUCKETS = 1 << BITS
SIZES = (3, 4, 5)
PER_LABEL, FEATURES = 1500, 10_000_000
EPOCHS, RATE = 6, 0.3
CHUNK = 1 << 19  # bytes whose features are taken at once; each needs some 80 bytes
MULTIPLIER, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
REPEAT = np.uint64(1)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))


class Model(NamedTuple):
    """Vectors of the buckets, softmax weights and biases, and the log of how the sample shifts the classes."""

    vectors: np.ndarray
    weights: np.ndarray
    biases: np.ndarray
    shift: float


def _buckets(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(29))) * MIX
    return (hashes >> np.uint64(64 - BITS)).astype(np.int32)


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all features of the texts, kind by kind, and the text that each belongs to."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(data))  # bytes up to the end of the text
    codes = data.astype(np.uint64) + np.uint64(1)
    grams = codes
    for size in range(2, max(SIZES) + 1):
        n = len(codes) - size + 1
        if n <= 0:
            break
        grams = grams[:n] * MULTIPLIER + codes[size - 1 :]
        if size in SIZES:
            inside = left[:n] >= size
            yield _buckets(grams[inside] + np.uint64(size)), owner[:n][inside]
    # A word's hash: the sum of its codes times powers counted from its start, as a difference of prefix sums.
    powers = np.multiply.accumulate(np.full(len(codes), MULTIPLIER))
    inverse = np.multiply.accumulate(np.full(len(codes), INVERSE))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * powers, dtype=np.uint64)])
    space = data <= 32
    apart = owner[1:] != owner[:-1]
    start, end = ~space, ~space
    start[1:] &= space[:-1] | apart
    end[:-1] &= space[1:] | apart
    at, to = np.flatnonzero(start), np.flatnonzero(end) + 1
    words = (sums[to] - sums[at]) * inverse[at]
    yield _buckets(words), owner[at]
    if len(words) > 1:
        both = owner[at][1:] == owner[at][:-1]
        # A pair of equal words is the same feature whatever the word.
        pairs = np.where(words[1:] == words[:-1], REPEAT, words[:-1] * MULTIPLIER + words[1:] + np.uint64(1))
        yield _buckets(pairs[both]), owner[at][1:][both]


def trained(examples: list[tuple[np.ndarray, np.ndarray, int]], counts: tuple[int, int], seed: int = 7) -> Model:
    """Fit by SGD with per-row step sizes. An example is (buckets, their shares, label)."""
    draw = np.random.default_rng(seed)
    vectors = draw.normal(0, 0.5, (BUCKETS, DIMENSIONS))
    weights, biases = draw.normal(0, 0.5, (2, DIMENSIONS)), np.zeros(2)
    seen, seen_w, seen_b = np.full(BUCKETS, 1e-8), np.full((2, DIMENSIONS), 1e-8), np.full(2, 1e-8)
    for _ in range(EPOCHS):
        for i in draw.permutation(len(examples)):
            buckets, share, label = examples[i]
            hidden = share @ vectors[buckets]
            logits = weights @ hidden + biases
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[label] -= 1
            back = error @ weights
            seen_w += (slope := np.outer(error, hidden)) ** 2
            seen_b += error**2
            weights -= RATE * slope / np.sqrt(seen_w)
            biases -= RATE * error / np.sqrt(seen_b)
            seen[buckets] += share**2 * (back @ back)
            vectors[buckets] -= (RATE * share / np.sqrt(seen[buckets]))[:, None] * back
    ones = sum(label for _, _, label in examples)
    zeros = len(examples) - ones
    # The sample takes both classes evenly: back to their shares among all labelled rows.
    shift = np.log((counts[1] + 1) / (counts[0] + 1)) - np.log((ones + 1) / (zeros + 1))
    return Model(vectors, weights, biases, float(shift))


def probabilities(model: Model, texts: list[bytes]) -> np.ndarray:
    """Probability of class 1 of each text. A text without features has the average vector 0."""
    # The softmax of two classes needs the difference only, a number for each bucket.
    worth = model.vectors @ (model.weights[1] - model.weights[0])
    total = np.zeros(len(texts))
    for buckets, owner in features(texts):
        number = np.bincount(owner, minlength=len(texts))
        total += np.bincount(owner, worth[buckets], len(texts)) / np.maximum(number, 1)
    logits = total + model.biases[1] - model.biases[0] + model.shift
    return np.round(1 / (1 + np.exp(-np.clip(logits, -500, 500))), 9)


def chunks(texts: Iterable[str | None]) -> Iterator[list[bytes]]:
    """Texts as bytes, in order, about CHUNK bytes at a time."""
    part, size = [], 0
    for text in texts:
        part.append((text or "").encode())
        size += len(part[-1])
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, shares = [], []
        for text in batch.column("text").to_pylist():
            kinds = [b for b, _ in features([(text or "").encode()])]
            share = np.concatenate([np.full(len(b), 1 / max(len(b), 1)) for b in kinds])
            unique, at = np.unique(np.concatenate(kinds), return_inverse=True)
            ids.append(unique.astype(np.uint16).tobytes())
            shares.append(np.bincount(at, share, len(unique)).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_pydict(
            {
                "label": batch.column("label"),
                "doc_id": batch.column("doc_id"),
                "buckets": pa.array(ids, pa.binary()),
                "shares": pa.array(shares, pa.binary()),
            }
        )


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the training rows of ``labels`` among ``docs``."""
    given = training_labels(docs, labels, "quality", FOLDS, HELD_OUT)
    sample = bounded_sample(docs, given, PER_LABEL)
    schema = StructType([sample.schema["label"], sample.schema["doc_id"]])
    schema = schema.add("buckets", "binary").add("shares", "binary")
    rows = written(sample.mapInArrow(_sample_features, schema), "quality-sample")
    counts = prior(given)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples, total = [], 0
        for batch in batches:
            for label, buckets, shares in zip(*(batch.column(c).to_pylist() for c in ("label", "buckets", "shares")), strict=True):
                if total < FEATURES:
                    examples.append((np.frombuffer(buckets, np.uint16), np.frombuffer(shares, np.float32), label))
                    total += len(examples[-1][0])
        model = trained(examples, counts)
        parts = [np.asarray(part, np.float64).tobytes() for part in model]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary()) for part in parts], list(Model._fields))

    # The sample is bounded, so one task fits it; only the model, of fixed size, comes to the driver.
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("buckets"), F.col("shares")]
    placed = rows.repartition(1).sortWithinPartitions(*order)
    made = placed.mapInArrow(fit, ", ".join(f"{name} binary" for name in Model._fields)).first()
    if made is None:  # nothing is labelled
        return trained([], counts)
    vectors, weights, biases, shift = (np.frombuffer(made[name], np.float64) for name in Model._fields)
    dropped(rows)
    return Model(vectors.reshape(BUCKETS, DIMENSIONS), weights.reshape(2, DIMENSIONS), biases, float(shift[0]))


def scores_of(model: Model, batch: pa.RecordBatch) -> np.ndarray:
    scores = [probabilities(model, part) for part in chunks(text.as_py() for text in batch.column("text"))]
    return np.concatenate(scores) if scores else np.zeros(0)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text is predicted to be of quality 1."""
    model = fitted(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            yield batch.filter(pa.array(scores_of(model, batch) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score all documents: doc_id, held_out, score, predicted.

    Learns from labelled rows outside the held-out fold only; the text is a document's only input.
    Null and empty texts get the score of a text without features; without labels all scores are one half.
    A null ``doc_id`` is not held out. Repeated rows are scored alike; an empty table gives no rows; other
    columns are ignored. A very long text is scored whole, which takes some 80 bytes of memory for each of its bytes.
    """
    model = fitted(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column("doc_id"), pa.array(scores_of(model, batch), pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score"])

    scores = docs.select("doc_id", "text").mapInArrow(run, docs.select("doc_id").schema.add("score", "double"))
    return scores.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
