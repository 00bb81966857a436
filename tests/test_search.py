import random

import pytest
from pyspark.sql import functions as F

from akin.config import SearchConfig, permutations
from akin.functions import signature, text
from akin.operators import blocks, lsh, ordering, skew
from akin.operators.evaluate import candidate_flags, candidate_overlap, list_overlap
from akin.plans import accuracy, corpus, quality
from tests import fixtures

CFG = SearchConfig(shingle_size=4, num_perm=32, n_results=3, query_divisor=5)
TEXTS = fixtures.make_texts(60)


def brute_split():
    ids = fixtures.order(TEXTS)
    n_query = len(ids) // CFG.query_divisor
    sets = {i: fixtures.shingles(fixtures.normalise(t), 4) for i, t in TEXTS.items() if t and len(t) >= 4}
    train = [i for i in ids[: len(ids) - n_query] if i in sets]
    return train, [i for i in ids[len(ids) - n_query :] if i in sets], sets


def brute_top(n):
    train, asked, sets = brute_split()
    out = {}
    for q in asked:
        ranked = sorted(range(len(train)), key=lambda p: (-fixtures.jaccard(sets[q], sets[train[p]]), p))[:n]
        out[q] = [(train[p], fixtures.jaccard(sets[q], sets[train[p]])) for p in ranked]
    return out


def signatures(sets, num_perm):
    sign = signature.Permuter(permutations(num_perm))
    return {i: list(sign.sign(text.id_set(fixtures.normalise(TEXTS[i]), range(4, 5)))) for i in sets}


@pytest.fixture(scope="module")
def split(spark):
    return corpus.holdout(fixtures.frame(spark, TEXTS), CFG)


@pytest.fixture(scope="module")
def table(split):
    return corpus.signed(split)


def listed(top):
    out = {}
    for r in top.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    return out


def test_exact_top_equals_brute_force(split):
    assert listed(corpus.exact_top(split, 3)) == brute_top(3)


@pytest.mark.parametrize("elements,scores,dense", [(300, 40, 0.0), (300, 40, 2.0), (50, 7, 0.01)])
def test_small_blocks_change_nothing(spark, split, monkeypatch, elements, scores, dense):
    monkeypatch.setattr(blocks, "BLOCK_ELEMENTS", elements)
    assert listed(corpus.exact_top(split, 3)) == brute_top(3)
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 20))) for _ in range(25)]
    values, lengths = np.concatenate(sets[:10]), np.array([len(s) for s in sets[:10]])
    others, other_lengths = np.concatenate(sets[10:]), np.array([len(s) for s in sets[10:]])
    monkeypatch.setattr(blocks, "SCORES", scores)
    monkeypatch.setattr(blocks, "EXPANDED", scores)
    monkeypatch.setattr(blocks, "DENSE", dense)
    shared = blocks.Postings(values, lengths).overlap(others, other_lengths)
    assert shared.tolist() == [[len(np.intersect1d(a, b)) for b in sets[10:]] for a in sets[:10]]


def test_blocks_are_bounded_and_meet_without_a_shuffle(spark, split, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(blocks, "BLOCK_ELEMENTS", 400)
    queries, train, scorer = corpus.exact_sides(split)
    found = [pa.ipc.open_stream(r["block"]).read_all() for r in blocks.packed(train).collect()]
    assert len(found) > 3 and sum(b.num_rows for b in found) == len(brute_split()[0])
    for block in found:
        sizes = blocks.n_elements(block)
        assert sizes.sum() - sizes[-1] < 400
    sums = blocks.meet(queries, train, lambda left: blocks.profile_rows(left, scorer), blocks.PROFILE_SCHEMA)
    assert "hashpartitioning" not in sums._jdf.queryExecution().executedPlan().toString()


def test_best_places_take_the_earlier_of_equal_scores():
    import numpy as np

    scores = np.random.default_rng(3).integers(0, 4, (20, 30)) / 4
    for n in (1, 5, 29, 30):
        assert (blocks.best_places(scores, n) == np.argsort(-scores, axis=1, kind="stable")[:, :n]).all()


def test_fewer_train_rows_than_results(spark):
    docs = fixtures.frame(spark, {i: f"text number {i}" for i in range(10)})
    split = corpus.holdout(docs, CFG)
    top = listed(corpus.exact_top(split, 50))
    assert len(top) == 2 and all(len(rows) == 8 for rows in top.values())


def test_signature_top_equals_brute_force(table):
    train, asked, sets = brute_split()
    sigs = signatures(sets, CFG.num_perm)
    want = {}
    for q in asked:
        score = {p: sum(a == b for a, b in zip(sigs[q], sigs[train[p]])) / CFG.num_perm for p in range(len(train))}
        want[q] = [(train[p], score[p]) for p in sorted(score, key=lambda p: (-score[p], p))[:3]]
    assert listed(corpus.signature_top(table, 3)) == want


def brute_candidates():
    train, asked, sets = brute_split()
    sigs = signatures(sets, CFG.num_perm)
    b, r = CFG.bands
    cut = {i: {(j, tuple(s[j * r : j * r + r])) for j in range(b)} for i, s in sigs.items()}
    return {q: {t for t in train if cut[q] & cut[t]} for q in asked}


def test_candidates_equal_brute_force(table):
    want = {q: c for q, c in brute_candidates().items() if c}
    asked, train = table.filter("is_query"), table.filter("is_train")
    got = {}
    for r in lsh.candidate_documents(asked, train, CFG.bands).collect():
        got.setdefault(r["query_id"], set()).add(r["doc_id"])
    assert got == want
    counts = {r["query_id"]: r["n_candidates"] for r in lsh.candidate_counts(asked, train, CFG.bands).collect()}
    assert counts == {q: len(c) for q, c in want.items()}


def test_copies_share_every_band(spark):
    docs = fixtures.frame(spark, {i: "one text of which there are many copies" for i in range(20)})
    table = corpus.signed(corpus.holdout(docs, CFG))
    rows = lsh.candidate_classes(table.filter("is_query"), table.filter("is_train"), CFG.bands).collect()
    assert len(rows) == 4 and all(r["n_docs"] == 16 for r in rows)


def test_overlaps_follow_the_candidates(split, table):
    exact = corpus.exact_top(split, 3)
    counts = lsh.candidate_counts(table.filter("is_query"), table.filter("is_train"), CFG.bands)
    rows = {r["query_id"]: r for r in candidate_overlap(candidate_flags(exact, table, CFG.bands), counts).collect()}
    want = brute_candidates()
    assert set(rows) == {q for q, c in want.items() if c}
    for q, r in rows.items():
        hits = len([d for d, _ in brute_top(3)[q] if d in want[q]])
        assert r["overlap_lsh"] == hits / len(want[q]) and r["recall_lsh"] == hits / 3
    same = list_overlap(exact, exact, "self").collect()
    assert {r["overlap_self"] for r in same} == {1.0}


def test_queries_without_candidates_count_only_for_sizes(spark):
    texts = {i: "shared words in all of these texts" for i in range(9)}
    lone = fixtures.order(list(texts) + [99])[-1]
    texts = {i: t for i, t in texts.items() if i != lone} | {99: "shared words in all of these texts", lone: "qqqqzzzzxxxx"}
    split = corpus.holdout(fixtures.frame(spark, texts), CFG)
    _, overall = quality.search_quality(split)
    row = overall.first()
    assert row["n_queries"] == 2 and row["n_evaluated"] == 1


def test_order_is_a_permutation_in_key_order(spark):
    ids = list(range(500))
    rows = ordering.shuffled(spark.createDataFrame([(i,) for i in ids], "doc_id long"), seed=9).collect()
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["pos"])] == fixtures.order(ids, 9)
    assert {r["n_docs"] for r in rows} == {500} and sorted(r["pos"] for r in rows) == list(range(1, 501))


def test_splits(spark):
    ids = spark.createDataFrame([(i,) for i in range(105)], "doc_id long")
    train, asked = ordering.split_train_query(ordering.limit_content(ordering.shuffled(ids), 0), 10)
    assert (train.count(), asked.count()) == (95, 10)
    assert ordering.limit_content(ordering.shuffled(ids), 20).count() == 20
    assert ordering.split_full(ordering.shuffled(ids), 100)[1].count() == 5
    assert ordering.sample_first(ordering.shuffled(ids), 0.1).count() == 10
    assert [s.count() for s in ordering.two_samples(ids, 30)] == [30, 30]


def test_sliced_join_equals_plain_join(spark):
    rng = random.Random(5)
    many = spark.createDataFrame([(i, 0 if rng.random() < 0.4 else rng.randint(1, 30)) for i in range(2000)], "i long, k long")
    few = spark.createDataFrame([(k, k * 10) for k in range(0, 31, 2)], "k long, v long")
    got = skew.sliced_join(many, few, ["k"], "i", slice_rows=50)
    want = many.join(few, "k")
    assert sorted(map(tuple, got.select("i", "k", "v").collect())) == sorted(map(tuple, want.select("i", "k", "v").collect()))


def test_cells_are_independent(spark):
    docs = fixtures.frame(spark, TEXTS)
    both = corpus.holdout(docs, CFG, (20, 40))
    rows = corpus.exact_top(both, 3)
    for cell, size in enumerate((20, 40)):
        alone = corpus.exact_top(corpus.holdout(docs, CFG.with_(content_size=size)), 3)
        assert listed(rows.filter(F.col("cell") == cell)) == listed(alone)


def test_whole_split_finds_the_query_itself(spark):
    docs = fixtures.frame(spark, {i: t for i, t in TEXTS.items() if i not in (3, 5)})
    top = corpus.exact_top(corpus.whole(docs, CFG, 10), 1).collect()
    assert top and all(r["doc_id"] == r["query_id"] and r["score"] == 1.0 for r in top)


def test_consecutive_pairs_leave_out_the_last(spark):
    ids = [i for i in range(9)]
    sigs = spark.createDataFrame([(i, [i, i + 1]) for i in ids], "doc_id long, sig array<bigint>")
    rows = accuracy.consecutive_pairs(sigs, [4, 5]).orderBy("repetition", "pos").collect()
    for seed in (4, 5):
        got = [(r["a_doc_id"], r["b_doc_id"]) for r in rows if r["repetition"] == seed]
        want = fixtures.order(ids, seed)
        assert got == list(zip(want, want[1:]))[:-1]


def test_self_accuracy_equals_brute_force(spark):
    texts = {i: t for i, t in TEXTS.items() if t and len(t) >= 4}
    rows = {r["doc_id"]: r for r in accuracy.self_accuracy(fixtures.frame(spark, texts), 0.5, 4, 16).collect()}
    chosen = fixtures.order(texts)[: int(len(texts) * 0.5)]
    sign = signature.Permuter(permutations(16))
    sigs = {i: sign.sign(text.id_set(texts[i], range(4, 5))) for i in chosen}
    for a in chosen:
        total = 0.0
        for b in chosen:
            if a != b:
                real = fixtures.jaccard(fixtures.shingles(texts[a], 4), fixtures.shingles(texts[b], 4))
                guess = (sigs[a] == sigs[b]).mean()
                total += 100.0 if real == guess else 0.0 if guess == 0 else abs(real - guess) / guess * 100
        assert rows[a]["n_pairs"] == len(chosen) - 1 and rows[a]["sum_pct_diff"] == pytest.approx(total)


@pytest.mark.parametrize("hot_many, hot_few", [(400, 1), (1, 400), (300, 300)])
def test_sliced_join_of_a_key_hot_on_either_side(spark, hot_many, hot_few):
    many = [(0, i) for i in range(hot_many)] + [(k, 1000 + k) for k in range(1, 40)]
    few = [(0, f"x{i}") for i in range(hot_few)] + [(k, f"y{k}") for k in range(20, 60)] + [(0, "x0")]
    left = spark.createDataFrame(many, "k int, i int")
    right = spark.createDataFrame(few, "k int, v string")
    got = skew.sliced_join(left, right, ["k"], "i", slice_rows=50)
    assert got.columns == ["k", "i", "v"]
    want = sorted(map(tuple, left.join(right, "k").collect()))
    assert sorted(map(tuple, got.collect())) == want
    hot = skew.hot_keys(left, ["k"], "n", 30).collect()
    assert [r["k"] for r in hot] == ([0] if hot_many > 50 else [])
    assert skew.hot_keys(left, ["k"], "n", 1000) is None
    unsliced = skew.sliced_join(left, right, ["k"], "i", slice_rows=1000)
    assert unsliced.columns == got.columns and sorted(map(tuple, unsliced.collect())) == want


def test_more_hot_keys_than_a_list_could_name(spark):
    many = spark.range(1200 * 12).select((F.col("id") % 1200).alias("k"), F.col("id").alias("i"))
    few = spark.range(1200).select(F.col("id").alias("k"), F.col("id").alias("v"))
    assert skew.sliced_join(many, few, ["k"], "i", slice_rows=10).count() == 1200 * 12


def test_title_search_pairs_are_not_shuffled(spark):
    import math
    import re

    from akin.operators.textsearch import title_search

    texts = {i: " ".join(f"w{j}" for j in range(40) if (i * 7 + j * j) % 5 < 2) + " the" * (i % 3) for i in range(30)}
    titles = {i: f"the w{i} w{i + 3} w{i}" for i in range(40)} | {90: "nothing known", 91: None}
    queries = spark.createDataFrame([(0, i, t) for i, t in titles.items()], "cell int, doc_id long, title string").repartition(3)
    train = spark.createDataFrame([(0, i, t, 100 - i) for i, t in texts.items()], "cell int, doc_id long, text string, order_key long")
    found = title_search(queries, train.repartition(4), len(texts), 4)
    assert not re.search(r"hashpartitioning\([^)]*query_id#\w+L?, doc_id", found._jdf.queryExecution().executedPlan().toString())
    tf = {i: {w: t.split().count(w) for w in t.split()} for i, t in texts.items()}
    df = {w: sum(w in t for t in tf.values()) for w in {w for t in tf.values() for w in t}}
    want = {}
    for q, title in titles.items():
        asked = set((title or "").split())
        rows = [(-round(sum(c * math.log(30 / df[w]) for w, c in t.items() if w in asked), 9), 100 - i, i) for i, t in tf.items() if asked & set(t)]
        want |= {(q, r): (i, -s) for r, (s, _, i) in enumerate(sorted(rows)[:4], 1)}
    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in found.collect()}
    assert got.keys() == want.keys() and all(got[k][0] == d and got[k][1] == pytest.approx(s) for k, (d, s) in want.items())
