import os
import zlib
from collections import Counter

import numpy as np
import pytest

from akin.llm import quality, toxicity
from tests.llm.fixtures import odd_documents, table

SMALL = "/root/testdata/sf0.01"
LARGER = "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


def held_out_accuracy(spark, run, label, folds, held_out):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    found = run(spark.read.parquet(f"{SMALL}/documents.parquet"), labels).toPandas()
    for r in found.itertuples():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held_out)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    both = found.merge(labels.toPandas(), on="doc_id")
    both = both[both.held_out]
    return (both.predicted == both[label]).mean(), (both[label] == 1).mean()


@needs_data
def test_quality_of_held_out_documents(spark):
    right, _ = held_out_accuracy(spark, quality.scored, "quality", 5, 0)
    assert right >= 0.95


@needs_data
def test_toxicity_of_held_out_documents(spark):
    right, share = held_out_accuracy(spark, toxicity.scored, "toxic", 4, 2)
    assert right >= 0.9 and right > 1 - share


@needs_data
def test_recall_of_toxic_documents(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    found = toxicity.scored(spark.read.parquet(f"{LARGER}/documents.parquet"), labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = found[found.held_out]
    assert held[held.toxic == 1].predicted.mean() >= 0.85
    assert held[held.toxic == 0].predicted.mean() <= 0.03


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_rows(spark, module, label):
    rows = odd_documents()
    marks = [(i, i % 2 if i % 5 else None, "x") for i, _ in rows] + [(10, 1, "x"), (None, 1, "x"), (99_999, 0, "x")]
    labels = spark.createDataFrame(marks, f"doc_id bigint, {label} int, label string")
    docs = table(spark, [*rows, rows[0], (None, "no id"), (None, None)])
    found = module.scored(docs, labels).collect()
    assert len(found) == len(rows) + 3
    assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in found)
    texts = dict(rows)
    by_text = {}
    for r in found:
        if r["doc_id"] is None:
            assert not r["held_out"]
        else:
            text = texts[r["doc_id"]] or ""
            assert by_text.setdefault(text, r["score"]) == r["score"]
    assert module.scored(docs.limit(0), labels).collect() == []
    for none in (labels.limit(0), labels.where(f"{label} is null")):
        assert len({r["score"] for r in module.scored(docs, none).collect()}) >= 1
    keep = module.accepted if module is quality else module.clean
    left = keep(docs, labels)
    assert left.columns == docs.columns
    wanted = sum(r["predicted"] == (1 if module is quality else 0) for r in found)
    assert left.count() == wanted


def test_features_are_those_of_each_text_alone():
    texts = ["one two  two\nthree".encode(), b"", "é".encode(), b"  ", b"ab", b"two two"]
    together = list(quality.features(texts))
    for i, text in enumerate(texts):
        alone = [sorted(b.tolist()) for b, _ in quality.features([text])]
        mixed = [sorted(b[o == i].tolist()) for b, o in together]
        assert [x for x in alone if x] == [x for x in mixed if x]


def sparse(rows):
    return toxicity.stacked([(np.flatnonzero(r).astype(np.int32), r[np.flatnonzero(r)]) for r in rows], rows.shape[1])


def vectors_of(index):
    out = np.zeros((len(index.doc_ids), index.vectors.width))
    for i in range(len(out)):
        terms, weights = index.vectors.row(i)
        out[i, terms] = weights
    return out


@pytest.mark.parametrize("seed", range(6))
def test_nearest_examples_are_exact(seed, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    monkeypatch.setattr(toxicity, "QUERIES", 7)
    monkeypatch.setattr(toxicity, "COMMON", [8, 3, 1 << 40][seed % 3])
    draw = np.random.default_rng(seed)
    rows = draw.random((150, 20)) * (draw.random((150, 20)) < 0.15)
    rows[20:40] = rows[20]
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    rows = rows / np.where(norms > 0, norms, 1)
    index = toxicity.indexed(draw.permutation(150), draw.integers(0, 2, 150), sparse(rows), (100, 50))
    vectors = vectors_of(index)
    queries = np.vstack([vectors[:30], draw.random((10, 20)), np.zeros((1, 20))])
    leave = np.where(np.arange(41) < 30, np.arange(41), -2)
    best, where, opened = toxicity.nearest(sparse(queries), index, 5, leave)
    assert 0 < opened <= 41 * len(index.blocks)
    for q, b, w, own in zip(queries, best, where, leave, strict=True):
        cosines = np.round(vectors @ q, toxicity.DIGITS)
        want = sorted((-c, index.ranks[i], i) for i, c in enumerate(cosines) if i != own)[:5]
        assert np.allclose([-c for c, _, _ in want], b, atol=1e-11)
        assert [i for _, _, i in want] == w.tolist()


def test_bounds_keep_blocks_closed():
    """Queries near one of several kinds of examples open the blocks of their kind and few others."""
    draw = np.random.default_rng(1)
    rows = np.zeros((2048, 400))
    for i in range(2048):
        kind = i // 128
        own = draw.choice(25, 12, replace=False) + 25 * kind
        rows[i, own] = draw.random(12) + 0.5
        rows[i, draw.choice(400, 2)] += 0.2
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    index = toxicity.indexed(np.arange(2048), np.arange(2048) // 128 % 2, sparse(rows), (1024, 1024))
    best, where, opened = toxicity.nearest(sparse(vectors_of(index)[::16]), index, 5)
    assert (best[:, 0] > 0.999).all()
    assert opened < 0.4 * 128 * len(index.blocks)


def test_cosines_are_those_of_all_words(spark):
    draw = np.random.default_rng(5)
    common = ["".join(draw.choice(list("abcdefgh"), 7)) for _ in range(600)]
    texts = {i: " ".join(draw.choice(common, 12)) + f" rare{chr(97 + i % 26) * 3}{chr(97 + i // 52) * 2}" for i in range(400)}
    rows = [(i, i % 2, "x") for i in texts]
    found = toxicity.scored(table(spark, list(texts.items())), spark.createDataFrame(rows, "doc_id bigint, toxic int, x string")).collect()
    held = {i: Counter(toxicity.words(x)) for i, x in texts.items()}
    learnt = [i for i in texts if zlib.crc32(str(i).encode()) % 4 != 2]
    often = Counter(t for h in held.values() for t in h)
    known = {t for i in learnt for t in held[i]}
    # Chi-square of the four-field table: sum of (observed - expected)^2 / expected.
    chi, label = dict.fromkeys(known, 0.0), np.array([i % 2 for i in learnt])
    for term in known:
        has = np.array([term in held[i] for i in learnt])
        for x in (False, True):
            for y in (0, 1):
                expected = (has == x).sum() * (label == y).sum() / len(learnt)
                chi[term] += (((has == x) & (label == y)).sum() - expected) ** 2 / expected if expected else 0
    value = {t: (np.log(401 / (often[t] + 1)) + 1e-3) * (1 + chi[t]) for t in known}
    weights = {i: {t: (1 + np.log(c)) * value[t] for t, c in h.items() if t in known} for i, h in held.items()}
    norms = {i: np.sqrt(sum(x * x for x in w.values())) for i, w in weights.items()}
    for r in found[:100]:
        mine = weights[r["doc_id"]]
        cosines = [sum(x * weights[j].get(t, 0) for t, x in mine.items()) / norms[j] / norms[r["doc_id"]] for j in learnt]
        assert np.allclose(r["cosines"], sorted(cosines, reverse=True)[:3], atol=1e-9)


def test_votes_and_scores_are_brute_force(spark):
    """Scores again from all cosines: votes of the nearest, and the map fitted on examples that did not see their label."""
    draw = np.random.default_rng(8)
    plain = ["".join(draw.choice(list("abcdefg"), 5)) for _ in range(60)]
    texts, labels = {}, {}
    for i in range(260):
        labels[i] = int(i % 4 == 0)
        texts[i] = " ".join([*draw.choice(plain, 15), *(draw.choice(["vile", "nasty"], draw.integers(0, 3)) if labels[i] else [])])
    rows = [(i, labels[i], "x") for i in texts]
    found = toxicity.scored(table(spark, list(texts.items())), spark.createDataFrame(rows, "doc_id bigint, toxic int, x string")).collect()
    learnt = [i for i in texts if zlib.crc32(str(i).encode()) % 4 != 2]
    draws = {r[0]: r[1] for r in spark.sql("select id, pmod(xxhash64(id), 2) from range(260)").collect()}
    held = {i: Counter(toxicity.words(x)) for i, x in texts.items()}
    often = Counter(t for h in held.values() for t in h)
    known = sorted({t for i in learnt for t in held[i]})

    def vectors(seen):
        a, b = (np.array([sum(t in held[i] for i in seen if labels[i] == y) for t in known], float) for y in (1, 0))
        n1, n0 = (float(sum(labels[i] == y for i in seen)) for y in (1, 0))
        value = np.array([np.log(261 / (often[t] + 1)) + 1e-3 for t in known]) * (1 + toxicity.chi_square(a, b, n1, n0))
        out = {i: np.array([(1 + np.log(h[t])) if h[t] else 0.0 for t in known]) * value for i, h in held.items()}
        return {i: v / (np.linalg.norm(v) or 1) for i, v in out.items()}

    n1 = sum(labels[i] for i in learnt)
    weight = {1: 1.0, 0: 1.0}  # fewer than PER_LABEL of each: every example stands for itself
    base = (n1 + 1) / (len(learnt) + 2)

    def vote(i, all_vectors, leave):
        near = sorted((-round(float(all_vectors[i] @ all_vectors[j]), 12), j) for j in learnt if j != leave)[: toxicity.NEAREST]
        total = sum(max(-c, 0) * weight[labels[j]] for c, j in near)
        return sum(max(-c, 0) * weight[labels[j]] * labels[j] for c, j in near) / total if total else base

    own = {}
    for half in (0, 1):
        blind = vectors([i for i in learnt if draws[i] != half])
        own |= {i: vote(i, blind, i) for i in learnt if draws[i] == half}
    x, y = np.array([own[i] for i in learnt]), np.array([labels[i] for i in learnt], float)
    at, score = toxicity.monotone(x, y, np.ones(len(learnt)))
    seen = vectors(learnt)
    for r in found:
        assert r["score"] == pytest.approx(float(np.clip(np.interp(vote(r["doc_id"], seen, None), at, score), 0, 1)), abs=1e-6)


def test_monotone_fit():
    x, y = toxicity.monotone(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]), np.ones(5))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all()
    assert y[0] == 0 and y[-1] == 1 and 0.5 in y


def test_empty_model_gives_the_base():
    index = toxicity.indexed(np.zeros(0, np.int64), np.zeros(0, np.int64), sparse(np.zeros((0, 3))), (0, 0))
    best, where, opened = toxicity.nearest(sparse(np.ones((2, 3))), index, 4)
    assert opened == 0
    assert toxicity.votes(best, where, index, 0.25).tolist() == [0.25, 0.25]
