"""Hard negatives against brute force over all pairs, and Strassen's product against the plain one."""

import numpy as np
import pytest

from akin.llm import hard_negatives
from tests.llm.test_vectors import odd_vectors, usable

SCHEMA = "vec_id bigint, embedding array<float>, label int, score double, rank string, dim int, x string, block int, side int, windows int"


def plain_mining(rows):
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and usable(v):
            moved = (label + 1) % 10 if i % 7 == 0 else label
            good[i] = (moved, np.floor(256 * np.array(v, np.float32).astype(np.float64)).astype(int))
    out = set()
    for a, (label, q) in good.items():
        if a % 100:
            continue
        scores = sorted((-int(q @ v), i, own) for i, (own, v) in good.items() if i != a and len(v) == len(q))
        positives = [(i, -s) for s, i, own in scores if own == label][:5]
        for p, high in positives:
            able = [(i, -s) for s, i, own in scores if own != label and 80 * high <= -100 * s <= 100 * high][:5]
            out |= {(a, p, rank, i, high, s) for rank, (i, s) in enumerate(able, 1)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 7) for r in rows], SCHEMA)


def labelled(rows, seed=5):
    draw = np.random.default_rng(seed)
    labels = draw.choice(10, len(rows), p=[0.37] + [0.07] * 9).tolist()
    return [(i, v, None if i == 33 else label) for (i, v), label in zip(rows, labels, strict=True)]


@pytest.mark.parametrize("small", [False, True])
def test_mining_is_brute_force(spark, monkeypatch, small):
    if small:  # many blocks, slices and tiles
        for name, value in {"ANCHORS": 3, "CANDIDATES": 40, "TILE": 2, "BLOCK_MIN": 50, "BLOCK_MAX": 50, "LEAF": 2}.items():
            monkeypatch.setattr(hard_negatives, name, value)
    draw = np.random.default_rng(2)
    # Coarse vectors give many ties, in the heaps and at the edges of the windows.
    tied = [(2000 + i, (draw.integers(0, 2, 16) / 8).tolist()) for i in range(500)]
    rows = labelled([*odd_vectors(), *tied]) + [(None, [1.0] * 16, 1)]
    got = hard_negatives.hard_negatives(frame(spark, rows)).collect()
    want = plain_mining(rows)
    assert len(want) > 50
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_repeated_rows_count_once_and_empty_tables_give_nothing(spark):
    rows = labelled(odd_vectors(400))
    once = {tuple(r) for r in hard_negatives.hard_negatives(frame(spark, rows)).collect()}
    twice = hard_negatives.hard_negatives(frame(spark, [*rows, *rows[:150]])).collect()
    assert {tuple(r) for r in twice} == once and len(twice) == len(once)
    assert hard_negatives.hard_negatives(frame(spark, [])).collect() == []
    assert hard_negatives.hard_negatives(frame(spark, rows[1:2])).collect() == []


def test_strassen_is_the_plain_product(monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF", 1)
    draw = np.random.default_rng(4)
    for _ in range(60):
        m, k, n = draw.integers(0, 40, 3)
        scale = int(draw.choice([2, 300, 1 << 28]))
        a, b = draw.integers(-scale, scale, (m, k)), draw.integers(-scale, scale, (k, n))
        assert (hard_negatives.product(a, b) == a @ b).all()


def test_large_products_wrap_as_64_bit_integers():
    a, b = np.full((64, 64), 1 << 40), np.full((64, 64), 1 << 30)
    assert (hard_negatives.product(a, b) == a @ b).all()


def test_heaps_merge_in_any_order():
    draw = np.random.default_rng(6)
    for _ in range(50):
        n = int(draw.integers(0, 40))
        scores, ids = draw.integers(0, 6, n), draw.permutation(n)
        heaps = hard_negatives.Heaps(1, 5)
        for part in np.array_split(draw.permutation(n), 4):
            heaps.merge(0, scores[part], ids[part])
        _, s, i = heaps.rows()
        want = sorted(zip((-scores).tolist(), ids.tolist()))[:5]
        assert list(zip((-s).tolist(), i.tolist())) == want
