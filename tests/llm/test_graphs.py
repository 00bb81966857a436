"""op1: graphs are read where they are, and vectors keep their precision."""

import numpy as np

from akin.llm import hnsw


def test_graphs_and_queries_meet_without_a_shuffle(spark, monkeypatch):
    draw = np.random.default_rng(2)
    base = draw.normal(size=(150, 8))
    rows = np.vstack([base, base * 3.1 + 1e-9, base + draw.normal(0, 0.05, base.shape)])
    monkeypatch.setattr(hnsw, "QUERY_ROWS", 100)
    plans, written = {}, hnsw.written

    def noting(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name)

    monkeypatch.setattr(hnsw, "written", noting)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["n_links"] for r in hnsw.near_duplicates(table).collect()}
    assert "CartesianProduct" in plans["links"] and "Exchange" not in plans["links"]
    unit = hnsw.unit(rows)
    linked = unit @ unit.T >= hnsw.COSINE
    assert found == {i: int(linked[i].sum()) - 1 for i in range(len(rows))}


def test_vectors_are_stored_narrow_only_if_nothing_is_lost():
    single = np.random.default_rng(1).normal(size=(50, 4)).astype(np.float32).astype(np.float64)
    assert hnsw._narrow(single).dtype == np.float32
    assert hnsw._narrow(single + 1e-12).dtype == np.float64
    assert hnsw._narrow(single * 1e300).dtype == np.float64
    assert (hnsw._units(hnsw._narrow(single)) == hnsw.unit(single).astype(np.float32)).all()
