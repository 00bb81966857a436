"""Grids, whole-corpus rows, stages of failure and the second reading of shingles, against plain recomputation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from akin.config import SearchConfig, permutations
from akin.functions import distances, signature, text
from akin.operators.evaluate import candidate_grid, grid_means, list_grid
from akin.plans import accuracy, corpus, keyword_quality, quality
from tests import fixtures

CFG = SearchConfig(shingle_size=4, num_perm=32, n_results=3, query_divisor=5, n_keywords=6)
TEXTS = fixtures.make_texts(60)


@pytest.fixture(scope="module")
def docs(spark):
    return fixtures.frame(spark, TEXTS)


def keyed(rows, *columns):
    return {tuple(r[c] for c in columns): r for r in rows}


def test_shingles_up_to_a_length_are_signed_and_searched(docs):
    cfg = CFG.with_(shingle_mode="upto", shingle_size=3)
    split = corpus.holdout(docs, cfg)
    sets = {i: set().union(*(fixtures.shingles(fixtures.normalise(t), k) for k in (1, 2, 3))) for i, t in TEXTS.items() if t and len(fixtures.normalise(t)) >= 3}
    sign = signature.Permuter(permutations(32))
    signed = {r["doc_id"]: r for r in corpus.signed(split).collect()}
    assert set(signed) == set(sets)
    for i, r in signed.items():
        assert r["n_shingles"] == len(sets[i])
        assert r["shingle_bytes"] == sum(len(s.encode()) for s in sets[i])
        assert r["sig"] == list(sign.sign(text.id_set(fixtures.normalise(TEXTS[i]), range(1, 4))))
    for r in corpus.exact_top(split, 3).collect():
        assert r["score"] == pytest.approx(fixtures.jaccard(sets[r["query_id"]], sets[r["doc_id"]]))
    with pytest.raises(ValueError):
        text.id_set_and_bytes("some text", 3, "strange")


def test_sizes_that_the_corpus_cuts_share_a_cell(docs):
    split = corpus.holdout(docs, CFG, (20, 500, 40, 1000, 20))
    assert split.cells == (0, 1, 2, 1, 0) and split.n_docs == {0: 20, 1: len(TEXTS), 2: 40}


def test_one_pass_of_all_kinds_is_each_search(docs):
    table = corpus.signed(corpus.holdout(docs, CFG))
    both = corpus.signature_tops(table, 3, {"all": ("sig", 32), "half": ("sig", 16)})
    for kind, length in (("all", 32), ("half", 16)):
        alone = corpus.signature_top(table.withColumn("sig", signature.prefix(F.col("sig"), length)), 3)
        columns = alone.columns
        assert sorted(both.filter(F.col("kind") == kind).select(columns).collect()) == sorted(alone.collect())


def test_the_grid_is_every_run_by_itself(docs):
    split, tops, sizes = corpus.holdout(docs, CFG, (40, 60)), (1, 3), (2, 6)
    grid = keyed(keyword_quality.keyword_sweep(split, docs, sizes, tops).collect(), "cell", "n_keywords", "n_results")
    seen = 0
    for size_at, size in enumerate((40, 60)):
        for m in sizes:
            for t in tops:
                run = corpus.holdout(docs, CFG.with_(content_size=size, n_results=t, n_keywords=m))
                rows = keyword_quality.keyword_quality(run, docs).collect()
                got = grid.get((size_at, m, t))
                assert (got["n_evaluated"] if got else 0) == len(rows)
                for name in ("lsh", "sig", "kw"):
                    if rows:
                        assert got[f"avg_overlap_{name}"] == pytest.approx(np.mean([r[f"overlap_{name}"] for r in rows]))
                seen += bool(rows)
    assert seen == len(grid) > 0


def test_a_missing_kind_leaves_a_query_out(spark):
    rows = lambda data, schema: spark.createDataFrame(data, schema)
    exact = rows([(0, 1, r, r) for r in (1, 2, 3)] + [(0, 2, r, r) for r in (1, 2, 3)], "cell int, query_id long, rank long, doc_id long")
    lists = rows(
        [(0, 1, "sig", 1, 2), (0, 1, "sig", 2, 1), (0, 1, "kw", 1, 9), (0, 2, "sig", 1, 1)],
        "cell int, query_id long, kind string, rank long, doc_id long",
    )
    found = {(r["query_id"], r["kind"], r["n_results"]): r["overlap"] for r in list_grid(exact, lists, (1, 2)).collect()}
    assert found[1, "sig", 1] == 0.0 and found[1, "sig", 2] == 1.0 and found[1, "kw", 2] == 0.0 and found[2, "sig", 1] == 1.0
    flags = exact.withColumn("is_candidate", F.col("doc_id") == 1)
    counts = rows([(0, 1, 4)], "cell int, query_id long, n_candidates long")
    near = candidate_grid(flags, counts, (1, 2))
    means = grid_means(list_grid(exact, lists, (1, 2)).unionByName(near), {7: {"lsh": "lsh", "sig": "sig", "kw": "kw"}}, "run").collect()
    assert {(r["run"], r["n_results"], r["n_evaluated"], r["avg_overlap_lsh"]) for r in means} == {(7, 1, 1, 0.25), (7, 2, 1, 0.25)}


def test_whole_rows_hold_what_each_search_gives(docs):
    named = docs.filter("text is not null").withColumn("title", F.concat_ws(" ", F.slice(F.split("text", " "), 1, 2)))
    split = corpus.whole(named, CFG, 5)
    rows = keyword_quality.whole_stats(split, named, "some").collect()
    table, exact, lists = keyword_quality.whole_corpus_lists(split, named, 3)
    best, listed = {}, {}
    for r in exact.collect():
        best.setdefault(r["query_id"], set()).add(r["doc_id"])
    for r in lists.collect():
        listed.setdefault((r["query_id"], r["kind"]), set()).add(r["doc_id"])
    assert rows
    for r in rows:
        q = r["query_id"]
        for kind in ("sig", "kw", "ext"):
            assert r[f"overlap_{kind}"] == len(listed[q, kind] & best[q]) / len(listed[q, kind])
        assert (r["dataset"], r["sig_bytes"], r["keyword_sig_bytes"]) == ("some", 256, 256)
        assert r["n_compared"] == table.filter("is_train").count()
    stats = quality.search_quality(split)[0].select("query_id", "overlap_lsh", "n_candidates").collect()
    near = {r["query_id"]: (r["overlap_lsh"], r["n_candidates"]) for r in stats}
    assert all((r["overlap_lsh"], r["n_candidates"]) == near[r["query_id"]] for r in rows)


def test_search_without_the_first_result(docs):
    named = docs.filter("text is not null").withColumn("title", F.col("text"))
    split = corpus.whole(named, CFG, 5)
    one_more = keyed(keyword_quality.external_top(split, 4).collect(), "query_id", "rank")
    rest = keyed(keyword_quality.external_top(split, 3, without_first=True).collect(), "query_id", "rank")
    assert {(q, k + 1): r["doc_id"] for (q, k), r in rest.items()} == {k: r["doc_id"] for k, r in one_more.items() if k[1] > 1}


def test_a_query_stops_at_its_first_failure(spark):
    same = "shared words in all of these longer texts"
    order = fixtures.order(range(50))
    asked = order[40:]
    odd = dict(zip(asked, [None, "ab", "of the and with", "zzzz yyyy xxxx wwww", same, same, same, same, same, same]))
    split_docs = fixtures.frame(spark, {i: odd.get(i, same) for i in range(50)}).withColumn("lang", F.lit("en"))
    split_docs = split_docs.withColumn("title", F.when(F.col("text") == "of the and with", "the").otherwise(F.col("title")))
    stages = keyword_quality.query_stages(corpus.holdout(split_docs, CFG), split_docs).collect()
    assert {r["query_id"]: r["stage"] for r in stages} == dict(
        zip(asked, ["missing", "short", "keywords", "candidates"] + ["evaluated"] * 6)
    )


def test_metrics_of_a_batch_are_those_of_each_pair(spark):
    draw = np.random.default_rng(3)
    rows = [(i, draw.integers(0, 4, 16).tolist(), draw.integers(0, 4, 16).tolist()) for i in range(60)] + [(60, [5] * 16, [5] * 16)]
    pairs = spark.createDataFrame(rows, "i int, a array<bigint>, b array<bigint>")
    a, b = F.col("a"), F.col("b")
    one = {"jaccard": distances.jaccard_estimate(a, b), "cosine": distances.cosine(a, b), "hamming": distances.hamming(a, b), "euclidean": distances.euclidean(a, b)}
    found = pairs.select(*[c.alias(n) for n, c in one.items()], distances.metrics(a, b, distances.norm(a), distances.norm(b)).alias("m"))
    for r in found.collect():
        assert [r["m"][n] for n in one] == pytest.approx([r[n] for n in one], abs=1e-12)


def test_metric_means_over_reshuffles(spark):
    draw = np.random.default_rng(4)
    rows = [(i, draw.integers(0, 1 << 30, 8).tolist()) for i in range(12)]
    signatures = spark.createDataFrame(rows, "doc_id long, sig array<bigint>")
    got = {r["repetition"]: r for r in accuracy.metric_summary(signatures, 3).collect()}
    for seed in (1, 2, 3):
        order = fixtures.order(range(12), seed)
        sides = [(np.array(rows[x][1], float), np.array(rows[y][1], float)) for x, y in zip(order, order[1:])][:-1]
        assert got[seed]["n_pairs"] == len(sides)
        assert got[seed]["avg_euclidean"] == pytest.approx(np.mean([np.linalg.norm(x - y) for x, y in sides]), abs=0.01)
        cosine = [1 - x @ y / np.linalg.norm(x) / np.linalg.norm(y) for x, y in sides]
        assert got[seed]["avg_cosine"] == pytest.approx(np.mean(cosine), abs=1e-8)


def test_neighbour_texts_are_joined_not_their_sets(spark, tmp_path):
    import re

    from checks import queries

    rows = [(i, f"some text {i * 7919 % 31} of many words {i}", "en") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.REGISTRY["set_union"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"parquet .*/sets-", plan) and "a_text" in plan
    texts = {i: fixtures.shingles(t, 4) for i, t, _ in rows}
    got = found.collect()
    assert len(got) == 38
    assert all(r["n_united"] == len(texts[r["a_doc_id"]] | texts[r["b_doc_id"]]) for r in got)
