import numpy as np
import pytest

from akin.llm import hnsw, impact_search


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, label int, dim string, n_links int")


def odd_vectors(n=900, dims=16, seed=1):
    draw = np.random.default_rng(seed)
    base = draw.normal(0, 0.2, (n, dims))
    for i in range(0, n, 9):
        base[i : i + 3] = base[i] + draw.normal(0, 0.02, (len(base[i : i + 3]), dims))
    base[100:190] = base[100] + draw.normal(0, 0.03, (90, dims))  # a large group
    base[200:204] = base[200]  # equal ones
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    nan, inf = float("nan"), float("inf")
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * dims), (n + 3, [nan] * dims), (n + 4, [inf] + [1.0] * (dims - 1))]
    return rows + [(n + 5, [None] + [1.0] * (dims - 1)), (1000, [1.0, 2.0]), (1050, [1.0, 2.1])]


def usable(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [4096, 100])
def test_top_scores(spark, monkeypatch, block):
    monkeypatch.setattr(impact_search, "BLOCK", block)
    monkeypatch.setattr(impact_search, "QUERIES", block)
    rows = odd_vectors()
    good = [(i, np.floor(256 * np.array(v, np.float64)).astype(int)) for i, v in rows if usable(v)]
    want = set()
    for i, q in good:
        if i % 50 == 0:
            scores = sorted((-int(q @ v), j) for j, v in good if j != i and len(v) == len(q))
            want |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(scores[:5])}
    got = impact_search.top_scores(embeddings(spark, rows)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert impact_search.top_scores(embeddings(spark, rows[:1])).collect() == []


@pytest.mark.parametrize("scale", [0, 1, 30, 100_000])
def test_blocks_prove_their_results(scale):
    draw = np.random.default_rng(scale)
    values = draw.integers(-scale, scale + 1, (700, 12))
    values[300:] *= draw.integers(0, 2, (400, 1))
    block = impact_search.Block(np.arange(700) * 2, values)
    for q in [*values[:20], np.zeros(12, int), np.full(12, -1)]:
        ids, scores = block.top(q, 8, 5)
        free = np.arange(700) != 4
        order = np.lexsort((np.arange(700), -(values @ q)))
        order = order[free[order]][:5]
        assert ids.tolist() == (order * 2).tolist() and scores.tolist() == (values @ q)[order].tolist()


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "QUERY_ROWS", 300)
    monkeypatch.setattr(hnsw, "BEAM", 16)
    rows = odd_vectors()
    found = hnsw.near_duplicates(embeddings(spark, [*rows, (None, rows[0][1])])).collect()
    assert len(found) == len(rows) + 1
    good = [(i, np.array(v, np.float64)) for i, v in rows if usable(v) and any(v)]
    links, pairs = dict.fromkeys([i for i, _ in rows], 0), []
    for i, a in good:
        for j, b in good:
            if i != j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9:
                links[i] += 1
                pairs.append((i, j))
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert max(links.values()) >= 80
    got = {r["vec_id"]: r for r in found}
    assert sum(got[i]["n_links"] for i in links) >= 0.99 * sum(links.values())
    assert all(got[i]["n_links"] <= n for i, n in links.items())
    assert sum(got[i]["component_id"] == find(i) for i in links) >= 0.99 * len(links)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found if r["vec_id"] is not None)
    assert tuple(got[None]) == (None, 0, None, False)
    assert hnsw.near_duplicates(embeddings(spark, rows[:1]).limit(0)).collect() == []


@pytest.mark.parametrize("scaled", [False, True])
def test_links_of_many_equal_vectors(spark, monkeypatch, scaled):
    monkeypatch.setattr(hnsw, "SHARDS", 1)
    draw = np.random.default_rng(3)
    base = draw.normal(size=(2600, 16)).astype(np.float32)
    base[300:800] = base[300]
    if scaled:  # one direction, so that only their cosines are equal
        base[300:800] *= draw.uniform(0.5, 2, (500, 1)).astype(np.float32)
    base[900:1000] = base[900] + draw.normal(0, 0.02, (100, 16))
    double = hnsw.unit(base.astype(np.float64))
    links = ((double @ double.T) >= 0.9).sum(1) - 1
    found = hnsw.near_duplicates(embeddings(spark, [(i, v.tolist()) for i, v in enumerate(base)])).collect()
    got = {r["vec_id"]: r for r in found}
    assert [got[i]["n_links"] for i in range(300, 800)] == links[300:800].tolist() and links[300] >= 499
    assert {got[i]["component_id"] for i in range(300, 800)} == {got[300]["component_id"]}
    assert sum(got[i]["n_links"] for i in range(len(base))) == links.sum()


def test_rows_without_a_path_are_compared():
    draw = np.random.default_rng(4)
    vectors = hnsw.unit(draw.normal(size=(3000, 16)))
    vectors[2000:2400] = vectors[2000]
    graph = hnsw.Graph(vectors)
    assert len(graph.unreached())
    pieces = list(hnsw.near_rows(graph, vectors, draw, np.arange(3000)))
    pairs = [p for which, row in pieces for p in zip(which.tolist(), row.tolist(), strict=True)]
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(vectors @ vectors.T >= 0.9)), strict=True))
    assert len(set(pairs)) == len(pairs) and want <= set(pairs)


def test_recall_of_a_graph():
    draw = np.random.default_rng(2)
    vectors = hnsw.unit(draw.normal(size=(3000, 32)))
    graph = hnsw.Graph(vectors)
    assert [len(x) for x in graph.layers] == [3000, 187]
    assert all(len(np.unique(row[row >= 0])) == (row >= 0).sum() for row in graph.layers[0])
    query = hnsw.unit(draw.normal(size=(200, 32))).astype(np.float32)
    nearest = (query @ graph.vectors.T).argmax(1)
    found = [(graph.search(query, width)[0] == nearest[:, None]).any(1).mean() for width in (16, 256)]
    assert found[1] >= found[0] and found[1] > 0.97


def test_the_graph_answers_in_a_large_shard(monkeypatch):
    """5,000 vectors in one shard: all links are found, and hardly a query is compared with the whole shard."""
    draw = np.random.default_rng(11)
    base = draw.normal(0, 1, (1250, 24))
    vectors = hnsw.unit(np.repeat(base, 4, axis=0) + draw.normal(0, 0.12, (5000, 24)))
    graph = hnsw.Graph(vectors)
    whole = []
    compared = hnsw._compared

    def counting(query, rest, all_vectors, rows):
        whole.append(len(rest) * len(rows))
        return compared(query, rest, all_vectors, rows)

    monkeypatch.setattr(hnsw, "_compared", counting)
    found = set()
    for which, row in hnsw.near_rows(graph, vectors, np.random.default_rng(5), np.arange(5000)):
        found |= set(zip(which.tolist(), row.tolist(), strict=True))
    cosines = vectors @ vectors.T
    want = set(zip(*(x.tolist() for x in np.nonzero(cosines >= hnsw.COSINE)), strict=True))
    assert len(want) > 15_000 and want <= found
    assert sum(whole) < 0.02 * 5000 * 5000


def test_neighbours_far_from_linking_do_not_widen_the_beams(monkeypatch):
    draw = np.random.default_rng(17)
    vectors = hnsw.unit(draw.normal(size=(4200, 64)))
    query = hnsw.unit(np.vstack([vectors[:200] + draw.normal(0, 0.04, (200, 64)), draw.normal(size=(800, 64))]))
    graph = hnsw.Graph(vectors)
    monkeypatch.setattr(hnsw, "BEAM", 32)
    search, widths = hnsw.Graph.search, []

    def noting(self, query, width):
        widths.append(width)
        return search(self, query, width)

    monkeypatch.setattr(hnsw.Graph, "search", noting)
    pairs = set()
    for which, row in hnsw.near_rows(graph, query, np.random.default_rng(5), np.full(1000, -1)):
        pairs |= set(zip(which.tolist(), row.tolist()))
    cosines = query @ vectors.T
    assert pairs >= set(zip(*(x.tolist() for x in np.nonzero(cosines >= hnsw.COSINE)), strict=True))
    assert set(widths) == {hnsw.BEAM}


def test_a_vector_at_the_edge_just_links():
    draw = np.random.default_rng(18)
    for dimensions in (2, 64):
        rows = hnsw.unit(draw.normal(size=(50, dimensions))).astype(np.float32)
        made = hnsw._at_the_edge(rows, draw)
        np.testing.assert_allclose(np.vecdot(made, rows), hnsw.COSINE, atol=1e-5)
    assert np.isfinite(hnsw._at_the_edge(np.ones((3, 1), np.float32), draw)).all()
