import os

import pytest

import __spark_entry__ as driver
import corpus_pipeline
from akin.llm import minhash, quality, suffix_dedup, toxicity
from akin.llm.sql import oracles
from akin.llm.tables import written
from tests.llm.test_repeats import brute_near, brute_repeats

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")


def test_all_are_registered():
    names = driver.queries()
    assert {n.partition("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert names["pipeline"] is corpus_pipeline.run
    assert set(driver.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(oracles()))
def test_queries_equal_their_sql(spark, name):
    base = pytest.importorskip("duckdb").connect()
    for t in ("documents", "embeddings"):
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got, want = driver.queries()[name](spark, SMALL), base.sql(driver.oracle_sql()[name])
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    rows = sorted(map(repr, (tuple(r) for r in got.select(*columns).collect())))
    assert rows == sorted(map(repr, want.select(", ".join(f'"{c}"' for c in columns)).fetchall()))


def test_every_stage_takes_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    before, tables = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, before, SMALL), name)
        assert after.columns == COLUMNS and after.dtypes == docs.dtypes
        tables.append((before, after))
        before = after

    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    (a, b), (c, d), (e, f), (g, h) = tables
    assert ids(b) == {r["doc_id"] for r in quality.scored(a, labels).collect() if r["predicted"]}
    assert ids(d) == {r["doc_id"] for r in toxicity.scored(c, labels).collect() if not r["predicted"]}
    given = sorted(texts(e).items())
    _, root = brute_near(given)
    assert ids(f) == set(root.values())
    given = sorted(texts(g).items())
    gone = brute_repeats(given)
    for doc, text in texts(h).items():
        whole = dict(given)[doc]
        n, removed, _, _ = gone[doc, whole]
        assert n - removed <= len(text.encode()) <= n - removed + 6 * gone[doc, whole][2]
    assert all(r["n_chars"] == len(r["text"]) for r in h.collect())

    packed = corpus_pipeline.run(spark, SMALL).toPandas()
    assert set(packed.doc_id) == ids(h)
    for _, part in packed.sort_values("offset").groupby("sequence_id"):
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]] and part.length.sum() <= 4096


def test_stages_take_the_rows_they_are_given(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).collect() == []
    assert minhash.deduplicated(docs).columns == suffix_dedup.deduplicated(docs).columns == COLUMNS
