"""Near duplicates among embeddings with hierarchical navigable small-world graphs.

Equal vectors are one node with a number of copies. Nodes are dealt to shards by their id; each shard builds its own graph
and writes it to the shared folder. Every node then searches every shard, in blocks of queries that read the graphs from there. A search descends the
layers and keeps a beam; a beam whose worst member still links is widened until it is not, and an audit against brute
force widens all beams of a block of queries until it finds all links of a few of them, its share of their true nearest
neighbours that come close to linking, and each of some rows from a vector made to just link to it. Where a beam would
cost more than comparing the whole shard, the shard is compared, and rows that no path leads to are always compared.
Links found are confirmed in double precision. A task returns the number of links of each query and a spanning forest of
the links; the components of the forests are the result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from akin.llm.components import components
from akin.llm.tables import written
from akin.llm.vectors import one_per_id

COSINE = 0.9
SHARDS, SHARD_ROWS, QUERY_ROWS = 8, 100_000, 16_384
LINKS, LINKS_BELOW, FANOUT = 16, 32, 16
BUILD_BEAM, BEAM, DESCENT = 64, 64, 8
BATCH, VISITED, TOGETHER, PIECE = 512, 1 << 25, 512, 1024
COMPARED, PAIRS = 1 << 22, 1 << 14
AUDIT, RECALL, CLOSE = 64, 0.97, 0.7
SLACK = 1e-4


def _chosen(query: np.ndarray, ids: np.ndarray, vectors: np.ndarray, keep: int) -> np.ndarray:
    """Of the candidates (rows of ``ids``, -1 for none) the ``keep`` to link: near ones in different directions first.

    A candidate nearer to a chosen one than to the query waits; places that stay free go to the nearest that wait.
    """
    near = np.einsum("qd,qcd->qc", query, vectors[ids])
    near[ids < 0] = -np.inf
    order = np.argsort(-near, axis=1, kind="stable")
    ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
    apart = vectors[ids]
    between = apart @ apart.transpose(0, 2, 1)
    taken = np.zeros(ids.shape, bool)
    for c in range(ids.shape[1]):
        closest = np.where(taken, between[:, c], -np.inf).max(1)
        taken[:, c] = (ids[:, c] >= 0) & (near[:, c] > closest) & (taken.sum(1) < keep)
    place = np.argsort(~taken, axis=1, kind="stable")[:, :keep]
    out = np.take_along_axis(ids, place, 1)
    return out if out.shape[1] == keep else np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=-1)


def _cosines(query: np.ndarray, at: np.ndarray, vectors: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Of each of the pairs (at, node), in pieces whose rows stay in a core's cache."""
    out = np.empty(len(at), np.float32)
    for low in range(0, len(at), PIECE):
        some = slice(low, low + PIECE)
        np.vecdot(query.take(at[some], 0), vectors.take(node[some], 0), out=out[some])
    return out


class Graph:
    """Layers over ``vectors`` (rows of length 1): layer l holds the first ``sizes[l]`` rows."""

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray] | None = None):
        self.vectors = np.ascontiguousarray(vectors, np.float32)
        n = len(vectors)
        if layers is not None:
            self.layers = layers
            return
        sizes = [n]
        while sizes[-1] > FANOUT * LINKS:
            sizes.append(sizes[-1] // FANOUT)
        self.layers: list[np.ndarray] = []
        below = None
        for size in reversed(sizes):
            keep = LINKS_BELOW if size == n else LINKS
            links = np.full((size, keep), -1, np.int32)
            done = 0 if below is None else len(below)
            if below is not None:
                links[:done, : below.shape[1]] = below
            self.layers.insert(0, links)
            while done < size:
                batch = np.arange(done, min(size, done + min(BATCH, max(done, LINKS))))
                self._insert(links, batch, keep)
                done = int(batch[-1]) + 1
            below = links

    def _insert(self, links: np.ndarray, batch: np.ndarray, keep: int) -> None:
        query = self.vectors[batch]
        found = [np.zeros((len(batch), 0), np.int64)]
        if batch[0]:
            found.append(self._beam(query, links, self._entries(query, 1), BUILD_BEAM)[0])
        own = query @ query.T
        np.fill_diagonal(own, -np.inf)
        k = min(LINKS, len(batch) - 1)
        if k > 0:
            found.append(batch[np.argpartition(-own, k - 1, axis=1)[:, :k]])
        ids = np.hstack(found)
        if not ids.shape[1]:
            return
        links[batch] = _chosen(query, ids, self.vectors, keep)
        # The way back: a full list is chosen anew from its members and the newcomers.
        to, place = links[batch].ravel(), np.repeat(batch, keep)
        to, place = to[to >= 0], place[to >= 0]
        order = np.argsort(to, kind="stable")
        to, place = to[order], place[order]
        nodes, starts, counts = np.unique(to, return_index=True, return_counts=True)
        for at in range(0, len(nodes), BATCH):
            some, start, count = nodes[at : at + BATCH], starts[at : at + BATCH], counts[at : at + BATCH]
            new = np.full((len(some), count.max()), -1, np.int64)
            column = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            new[np.repeat(np.arange(len(some)), count), column] = place[np.repeat(start, count) + column]
            both = np.hstack([links[some], new])
            both[:, keep:][(new[:, :, None] == links[some][:, None, :]).any(2)] = -1
            links[some] = _chosen(self.vectors[some], both, self.vectors, keep)

    def _entries(self, query: np.ndarray, above: int) -> np.ndarray:
        """Nearest rows found in the layers from the top down to ``above``."""
        at = np.zeros((len(query), 1), np.int64)
        for links in reversed(self.layers[above:]):
            at = self._beam(query, links, at, DESCENT)[0]
            at = np.where(at < 0, 0, at)
        return at

    def _beam(self, query: np.ndarray, links: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cosines of the beam of every query, best first, -1 where it isn't full."""
        out, rows = [], max(1, min(TOGETHER, VISITED // max(1, len(links))))
        for at in range(0, len(query), rows):
            out.append(self._beam_of(query[at : at + rows], links, entries[at : at + rows], width))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _beam_of(self, query: np.ndarray, links: np.ndarray, entries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n, step = len(query), 4
        # The last column stands for -1, which is never new.
        seen = np.zeros((n, len(links) + 1), bool)
        seen[:, -1] = True
        ids, near = np.full((n, width), -1, np.int64), np.full((n, width), -np.inf, np.float32)
        open_ = np.zeros((n, width), bool)
        rows, fresh = np.arange(n), entries
        while len(rows):
            # Each new row once, and never again; what is no better than the worst of a full beam doesn't enter it.
            which, column = np.nonzero(~seen[rows[:, None], fresh])
            node = fresh[which, column]
            at = rows[which]
            seen[at, node] = True
            cosine = _cosines(query, at, self.vectors, node)
            better = np.flatnonzero(cosine > near[at, -1])
            _, first = np.unique(which[better] * len(links) + node[better], return_index=True)
            which, node, cosine = (x[better[first]] for x in (which, node, cosine))
            counts = np.bincount(which, minlength=len(rows))
            some = np.flatnonzero(counts)
            if len(some):
                column = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
                line = (np.cumsum(counts > 0) - 1)[which]
                new_ids = np.full((len(some), int(counts.max())), -1, np.int64)
                new_near = np.full(new_ids.shape, -np.inf, np.float32)
                new_ids[line, column], new_near[line, column] = node, cosine
                at = rows[some]
                every = np.hstack([near[at], new_near])
                order = np.argsort(-every, axis=1, kind="stable")[:, :width]
                near[at] = np.take_along_axis(every, order, 1)
                ids[at] = np.take_along_axis(np.hstack([ids[at], new_ids]), order, 1)
                open_[at] = np.take_along_axis(np.hstack([open_[at], new_ids >= 0]), order, 1)
            rows = rows[open_[rows].any(1)]
            if len(rows):
                best = np.argsort(~open_[rows], axis=1, kind="stable")[:, :step]
                read = np.take_along_axis(open_[rows], best, 1)
                nodes = np.where(read, np.take_along_axis(ids[rows], best, 1), -1)
                open_[rows[:, None], best] = False
                fresh = np.where(nodes[:, :, None] < 0, -1, links[nodes]).reshape(len(rows), -1)
        return ids, near

    def search(self, query: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        return self._beam(query, self.layers[0], self._entries(query, 1), min(width, len(self.vectors)))

    def unreached(self) -> np.ndarray:
        """Rows that no path of the lowest layer leads to from the first row."""
        seen = np.zeros(len(self.vectors) + 1, bool)  # the last place stands for -1
        fresh = np.zeros(1, np.int64)
        seen[[0, -1]] = True
        while len(fresh):
            fresh = np.unique(self.layers[0][fresh])
            fresh = fresh[~seen[fresh]]
            seen[fresh] = True
        return np.flatnonzero(~seen)


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _narrow(vectors: np.ndarray) -> np.ndarray:
    """In single precision if that loses nothing."""
    with np.errstate(over="ignore"):
        single = vectors.astype(np.float32)
    return single if (single == vectors).all() else vectors


def _units(vectors: np.ndarray) -> np.ndarray:
    """``unit`` in double precision, rounded to single; a block of rows at a time."""
    out = np.empty(vectors.shape, np.float32)
    for low in range(0, len(vectors), QUERY_ROWS):
        out[low : low + QUERY_ROWS] = unit(vectors[low : low + QUERY_ROWS].astype(np.float64))
    return out


def _stored(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    # A random order, the same in every run: the layers are its beginnings.
    order = np.argsort(pd.util.hash_array(frame["vec_id"].to_numpy(np.int64)), kind="stable")
    ids, copies = (frame[name].to_numpy(np.int64)[order] for name in ("vec_id", "copies"))
    vectors = _narrow(np.stack(frame["embedding"].to_numpy()[order]))
    graph = Graph(_units(vectors))
    stored = _stored(ids=ids, copies=copies, vectors=vectors, **{f"l{i}": x for i, x in enumerate(graph.layers)})
    return pd.DataFrame({"dim": [int(frame["dim"].iloc[0])], "shard": [int(frame["shard"].iloc[0])], "graph": [stored]})


def _packed(frame: pd.DataFrame) -> pd.DataFrame:
    """A block of queries as one value."""
    block = _stored(ids=frame["vec_id"].to_numpy(np.int64), vectors=_narrow(np.stack(frame["embedding"].to_numpy())))
    return pd.DataFrame({"asked_dim": [int(frame["dim"].iloc[0])], "block": [block]})


def _compared(query: np.ndarray, rest: np.ndarray, vectors: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the queries ``rest`` and ``rows`` by brute force, in blocks of either."""
    for low in range(0, len(rows), QUERY_ROWS):
        some = rows[low : low + QUERY_ROWS]
        step = max(1, COMPARED // len(some))
        for at in range(0, len(rest), step):
            which, place = np.nonzero(query[rest[at : at + step]] @ vectors[some].T >= COSINE - SLACK)
            yield rest[at : at + step][which], some[place]


def _at_the_edge(rows: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """For each row a vector of random direction that just links to it."""
    aside = draw.standard_normal(rows.shape)
    aside -= np.vecdot(aside, rows)[:, None] * rows
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), SLACK)
    return unit(COSINE * rows + np.sqrt(1 - COSINE**2) * aside).astype(np.float32)


def near_rows(graph: Graph, query: np.ndarray, draw: np.random.Generator, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, row of the graph) whose cosine may reach COSINE, each once, in pieces.

    ``own`` is each query's row in the graph, or -1; it doesn't count in the audit.
    """
    n, width = len(graph.vectors), BEAM
    query = query.astype(np.float32)
    loose = graph.unreached()
    joined = np.ones(n + 1, bool)
    joined[loose] = False
    audited = draw.choice(len(query), min(AUDIT, len(query)), replace=False)
    true = query[audited] @ graph.vectors.T
    here = np.flatnonzero(own[audited] >= 0)
    true[here, own[audited][here]] = -np.inf
    # Of copies that differ only in rounding any is the nearest; loose rows are compared anyway.
    nearest = true.max(1, initial=-np.inf)
    links = (true >= COSINE - SLACK) & joined[:n]
    # Neighbours far from linking are hard to find and tell little about links.
    close = nearest >= CLOSE
    target = draw.choice(np.flatnonzero(joined[:n]), AUDIT)
    asked = np.concatenate([query[audited], _at_the_edge(graph.vectors[target], draw)])
    # A beam of width w reads about w * LINKS_BELOW rows: beyond the shard's rows comparing all is less work.
    trusted = False
    while not trusted and (width == BEAM or width * LINKS_BELOW < n) and width < n:
        ids, near = graph.search(asked, width)
        full = near[:, -1] >= COSINE - SLACK  # such a beam is widened below
        reached = (ids[len(audited) :] == target[:, None]).any(1) | full[len(audited) :]
        found = np.zeros((len(audited), n + 1), bool)
        found[np.arange(len(audited))[:, None], ids[: len(audited)]] = True
        whole = (~links | found[:, :n]).all(1) | full[: len(audited)]
        best = np.where(found[:, :n] | ~joined[:n], true, -np.inf).max(1) >= nearest - SLACK
        trusted = whole.all() and reached.all() and best.sum(where=close) >= RECALL * close.sum()
        width *= 1 if trusted else 2
    rest = np.arange(len(query))
    while trusted and len(rest):
        wide, going = [], width * 4 * LINKS_BELOW < n
        step = max(1, COMPARED // width)
        for at in range(0, len(rest), step):
            some = rest[at : at + step]
            ids, near = graph.search(query[some], width)
            # A beam that links to its end may go on.
            full = near[:, -1] >= COSINE - SLACK
            which, place = np.nonzero((near >= COSINE - SLACK) & ~full[:, None] & joined[ids])
            yield some[which], ids[which, place]
            wide.append(some[full])
            yield from _compared(query, some[~full], graph.vectors, loose)
        rest, width, trusted = np.concatenate(wide), width * 4, going
    yield from _compared(query, rest, graph.vectors, np.arange(n))


def _united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unite the sets of ``a`` and ``b``, whose smallest members ``root`` holds; the pairs that joined two sets."""
    joined = [(a[:0], b[:0])]
    while len(a):
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        high, first = np.unique(high, return_index=True)
        root[high] = low[first]
        joined.append((a[first], b[first]))
        while (root[root] != root).any():
            root[:] = root[root]
    return tuple(np.concatenate(x) for x in zip(*joined, strict=True))


def _searches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of blocks of queries with graphs; a graph that comes with several blocks in turn is read once."""
    last, held = None, None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(name)) for name in ("dim", "shard", "graph", "block")]
        for row in range(batch.num_rows):
            dim, shard, graph, block = (column[row] for column in columns)
            if last != (dim, shard):
                last, held = (dim, shard), None  # the old graph goes before the new one is read
                held = np.load(pa.BufferReader(graph.as_buffer()))
                held = {name: held[name] for name in held.files}
                held["graph"] = Graph(_units(held["vectors"]), [held[f"l{i}"] for i in range(len(held) - 3)])
            stored = np.load(pa.BufferReader(block.as_buffer()))
            found = _search(held["graph"], *(held[name] for name in ("ids", "copies", "vectors")), *(stored[name] for name in stored.files))
            yield from pa.Table.from_pandas(found, preserve_index=False).to_batches()


def _search(graph: Graph, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, asked: np.ndarray, query: np.ndarray) -> pd.DataFrame:
    query = unit(query.astype(np.float64))
    order = np.argsort(ids)
    place = np.minimum(np.searchsorted(ids[order], asked), len(ids) - 1)
    own = np.where(ids[order][place] == asked, order[place], -1)
    nodes, number = np.unique(np.concatenate([asked, ids]), return_inverse=True)
    root, counts, forest = np.arange(len(nodes)), np.zeros(len(asked), np.int64), [(asked[:0], asked[:0])]
    for which, row in near_rows(graph, query, np.random.default_rng(5), own):
        for at in range(0, len(which), PAIRS):
            q, r = which[at : at + PAIRS], row[at : at + PAIRS]
            true = np.einsum("id,id->i", query[q], unit(vectors[r].astype(np.float64))) >= COSINE
            true &= asked[q] != ids[r]
            q, r = q[true], r[true]
            np.add.at(counts, q, copies[r])
            forest.append(_united(root, number[q], number[len(asked) + r]))
    a, b = (nodes[np.concatenate(x)] for x in zip(*forest, strict=True))
    linked = counts > 0
    # Counts are rows without an edge.
    return pd.DataFrame(
        {
            "a": np.concatenate([a, asked[linked]]),
            "b": np.concatenate([b, asked[linked]]),
            "links": np.concatenate([np.zeros(len(a), np.int64), counts[linked]]),
        }
    )


def near_duplicates(rows: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``embeddings``.

    Two vectors of one length link at a cosine of 0.9 or more in double precision. Vectors that are null, empty or zero or hold
    null or non-finite components link with nothing. Rows of one id count as one vector, the smallest; a
    null id has no component and is not kept. Labels and other columns are ignored; an empty table gives no rows.
    """
    every = one_per_id(rows).where(F.exists("embedding", lambda x: x != 0))
    every = written(every.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), "vectors")
    # Equal vectors are the node of their smallest id.
    good = every.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    good = written(good.select("vec_id", "embedding", "copies", F.size("embedding").alias("dim")), "nodes")
    several = good.where("copies > 1").select("embedding", F.col("vec_id").alias("node"), "copies")
    same = every.join(several, "embedding").select("vec_id", "node", "copies")
    n = good.count()
    shards, parts = max(SHARDS, -(-n // SHARD_ROWS)), max(1, -(-n // QUERY_ROWS))
    deal = lambda k, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(k)).cast("long")
    sharded = good.withColumn("shard", deal(shards, 1)).groupBy("dim", "shard")
    index = written(sharded.applyInPandas(_build, "dim long, shard long, graph binary"), "graphs")
    asked = good.select("dim", deal(parts, 2).alias("part"), "vec_id", "embedding").repartition(parts, "dim", "part")
    blocks = written(asked.groupBy("dim", "part").applyInPandas(_packed, "asked_dim long, block binary"), "query-blocks")
    # Graphs and blocks meet where they are read: neither is shuffled, and a task holds one of either.
    pairs = index.hint("shuffle_replicate_nl").join(blocks, F.col("dim") == F.col("asked_dim"))
    found = written(pairs.select("dim", "shard", "graph", "block").mapInArrow(_searches, "a long, b long, links long"), "links")
    counts = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    of = components(found.where("a <> b").select("a", "b")).join(counts, "node", "left")
    out = rows.select(F.col("vec_id").cast("long").alias("vec_id")).join(same, "vec_id", "left")
    out = out.withColumn("node", F.coalesce("node", "vec_id")).join(of, "node", "left")
    component = F.coalesce("component", "node")
    return out.select(
        "vec_id",
        (F.coalesce("n_links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
