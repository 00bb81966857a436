"""The persistent band index: appended documents, opening again, hot keys, and a plan that leaves the index in place."""

import re

import pytest
from pyspark.sql import functions as F

from akin.config import SearchConfig
from akin.functions.signature import band_hashes
from akin.operators import lsh
from akin.plans import corpus
from akin.session import fresh_path, release
from tests import fixtures

CFG = SearchConfig(shingle_size=4, num_perm=32, n_results=3, query_divisor=5)


@pytest.fixture(scope="module")
def sides(spark):
    copies = {1000 + i: "one text of which there are many copies" for i in range(30)}
    table = corpus.signed(corpus.holdout(fixtures.frame(spark, fixtures.make_texts(60) | copies), CFG))
    return table.filter("is_query"), table.filter("is_train")


def plain(sides):
    """Train documents that agree with a query on all positions of a band."""
    (b, r), found = CFG.bands, {}
    rows = [[(x["doc_id"], x["sig"]) for x in side.collect()] for side in sides]
    for q, mine in rows[0]:
        for t, theirs in rows[1]:
            if any(mine[j * r : j * r + r] == theirs[j * r : j * r + r] for j in range(b)):
                found.setdefault(q, set()).add(t)
    return found


def counts(rows):
    return {r["query_id"]: r["n_candidates"] for r in lsh.counted(rows).collect()}


@pytest.mark.parametrize("limit", [100_000, 3])
def test_a_reopened_index_takes_further_documents(spark, sides, monkeypatch, limit):
    monkeypatch.setattr(lsh, "SLICE_ROWS", limit)
    queries, train = sides
    whole = {q: len(t) for q, t in plain(sides).items()}
    assert counts(lsh.search_index(queries, lsh.build_index(train, CFG.bands))) == whole
    folder = fresh_path(spark, "kept")
    index = lsh.build_index(train.filter("doc_id % 3 = 0"), CFG.bands, folder)
    spark.sql(f"DROP TABLE {index.table}")  # the files stay
    for rest in (1, 2):
        index = lsh.open_index(spark, folder)
        index.append(train.filter(f"doc_id % 3 = {rest}"))
        spark.sql(f"DROP TABLE {index.table}")
    assert counts(lsh.search_index(queries, lsh.open_index(spark, folder))) == whole


def test_searching_does_not_move_the_index(spark, sides):
    queries, train = sides
    index = lsh.build_index(train, CFG.bands)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        plan = lsh.search_index(queries, index)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    # From the join down: the probes' branch has the only exchange, the index is scanned in place.
    below = plan[plan.index("SortMergeJoin") :]
    index_branch, probe_branch = re.split(r"\n[ :]*\+- Sort", below, maxsplit=1)
    assert "band_index" in index_branch and "Exchange hashpartitioning" not in index_branch
    assert "Exchange hashpartitioning(key" in probe_branch


def test_pairs_are_not_shuffled_to_be_told_apart(sides):
    queries, train = sides
    plan = lsh.search_index(queries, lsh.build_index(train, CFG.bands))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_repeated_ids_give_a_pair_once(spark, sides):
    queries, train = sides
    # Ids with two texts, null ids, and documents that come again in a later run.
    same_id = F.when(F.col("doc_id") % 3 == 0, F.lit(7)).when(F.col("doc_id") % 2 == 1, F.lit(None)).otherwise(F.col("doc_id"))
    queries, train = (side.withColumn("doc_id", same_id).unionByName(side) for side in sides)
    index = lsh.build_index(train, CFG.bands)
    index.append(train.filter("doc_id % 2 = 0"))
    keys = lambda side: side.select("*", F.explode(F.transform(band_hashes(F.col("cell"), F.col("sig"), CFG.bands), lambda h: h["key"])).alias("key"))
    runs = [lsh.signature_classes(part) for part in (train, train.filter("doc_id % 2 = 0"))]
    want = keys(queries.withColumnRenamed("doc_id", "query_id")).drop("cell").join(keys(runs[0].unionByName(runs[1])), "key")
    want = want.select("cell", "query_id", "first_doc_id", "n_docs").distinct()
    found = lsh.search_index(queries, index)
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty() and found.filter("query_id is null").count()


def test_an_index_of_nothing_finds_nothing(spark, sides):
    queries, train = sides
    assert lsh.candidate_classes(queries, train.limit(0), CFG.bands).collect() == []
    assert lsh.candidate_classes(queries.limit(0), train, CFG.bands).collect() == []


def test_release_drops_the_index_of_a_single_search(spark, sides):
    index = lsh.build_index(sides[1], CFG.bands)
    assert spark.catalog.tableExists(index.table)
    release(spark)
    assert not spark.catalog.tableExists(index.table)
