"""Blocks: bounded batches, full blocks of queries, results put together in a task, and what is counted in them."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from akin.config import SearchConfig
from akin.operators import blocks, postings
from akin.plans import corpus, keyword_quality
from akin.session import materialise
from tests import fixtures

CFG = SearchConfig(shingle_size=4, num_perm=16, n_results=3, query_divisor=4, n_keywords=4)


@pytest.fixture(scope="module")
def split(spark):
    return corpus.holdout(fixtures.frame(spark, fixtures.make_texts(60)), CFG)


def test_batches_are_bounded_in_bytes_while_a_table_is_written(spark):
    rows = spark.range(400, numPartitions=1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], ["n"])

    found = materialise(rows.mapInArrow(sizes, "n long"), "sizes").agg(F.max("n")).first()[0]
    assert found < 8_000_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == before


def test_small_blocks_of_queries_are_merged(split):
    queries, _, _ = corpus.exact_sides(split)
    queries = materialise(queries.repartition(8, "query_id"), "queries")
    small = materialise(blocks.packed(queries), "small")
    assert small.count() > 2
    full = materialise(blocks.merged(small), "full")
    assert full.count() == 1 and blocks.merged(full) is full
    read = lambda t: pa.concat_tables(blocks.with_values(pa.ipc.open_stream(r["block"]).read_all()) for r in t.collect()).sort_by("query_id")
    assert read(full).to_pydict() == read(small).to_pydict()
    assert [r["size"] for r in full.collect()] == [sum(r["size"] for r in small.collect())]


def test_a_task_hands_on_one_list_and_one_sum_for_a_query(split, monkeypatch):
    queries, train, scorer = corpus.exact_sides(split)
    want = blocks.top_rows(queries, train, scorer, 3).collect()
    monkeypatch.setattr(blocks, "PARTIAL", 2)
    train = materialise(train.coalesce(1), "train")
    n_queries = queries.count()
    monkeypatch.setattr(blocks, "BLOCK_ELEMENTS", 300)
    assert blocks.packed(train).count() > 4
    monkeypatch.setattr(blocks, "merged", lambda written: written.coalesce(1))
    kept = {}
    monkeypatch.setattr(blocks, "materialise", lambda df, name: kept.setdefault(name, materialise(df, name)))
    assert sorted(blocks.top_rows(queries, train, scorer, 3).collect()) == sorted(want)
    assert kept["block-tops"].count() == 3 * n_queries
    kept.clear()
    blocks.profile(queries, train, scorer).collect()
    assert kept["block-sums"].count() == n_queries


def test_overlap_and_equal_positions_equal_brute_force(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.zipf(1.3, rng.integers(0, 60)) % 500) for _ in range(90)]
    mine, others = sets[:40], sets[40:]
    flat = lambda rows: (np.concatenate(rows), np.array([len(r) for r in rows]))
    want = [[len(np.intersect1d(a, b)) for b in others] for a in mine]
    for dense, scores, expanded, held in ((0.001, 300, 20, 1 << 25), (0.02, 1 << 20, 1 << 15, 120), (0.0, 90, 7, 0)):
        for name, value in (("DENSE", dense), ("SCORES", scores), ("EXPANDED", expanded), ("HELD", held)):
            monkeypatch.setattr(blocks, name, value)
        assert blocks.Postings(*flat(mine)).overlap(*flat(others)).tolist() == want
    monkeypatch.setattr(blocks, "TILE", 100)
    a, b = rng.integers(0, 2, (600, 23)), rng.integers(0, 2, (600, 31))
    equal = blocks.equal_positions(a.astype(np.int32), b.astype(np.int32))
    assert equal.tolist() == (a[:, :, None] == b[:, None, :]).sum(axis=0).tolist()


def test_sums_of_keyword_signatures_shuffle_no_pair(spark, monkeypatch):
    copies = {500 + i: "one text of which there are many copies" for i in range(20)}
    docs = fixtures.frame(spark, fixtures.make_texts(40) | copies).withColumn("lang", F.lit("en"))
    table = corpus.signed(corpus.holdout(docs, CFG)).join(keyword_quality.keyword_signatures(docs, (4,), 16), "doc_id")

    def shuffled_pairs(*_):
        raise AssertionError("pairs that meet are formed as rows")

    monkeypatch.setattr(postings, "meet", shuffled_pairs)
    want = blocks.profile(*corpus.signature_profile(table, "kw_4"))
    assert sorted(postings.posting_profile(table, "kw_4").select(want.columns).collect()) == sorted(want.collect())
