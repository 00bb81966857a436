"""Near duplicates by a signature-coordinate inverted join.

Documents with equal shingle sets are one class from the start. A class is posted under each of its
``COORDINATES`` pairs of signature coordinate and value; documents that link collide in at least ``MATCHES``
of them but for one chance in ten million. From there on:

* Skip: postings that no other class has cannot collide. A class with fewer than MATCHES others is out.
* Prefix: of its s remaining postings a class keeps the s - MATCHES + 1 rarest. Two classes that collide
  MATCHES times have one of these in common, and what is frequent is not joined at all.
* Count: the classes in a posting list compare the low bytes of their signatures, which can only overstate
  collisions. Of the pairs that reach MATCHES a list keeps a spanning forest, not all pairs. A list
  of more than ``LIST`` classes is kept as a star.

The components of the kept pairs are candidate clusters. Inside them links are confirmed on the full sets: a
cluster is dealt to blocks of like set sizes, blocks whose sizes allow a link meet in a task of bounded
size, and the task returns a spanning forest of the true links. Their components are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from akin.llm.components import Forest, components
from akin.llm.shingles import coefficients, shingles, signature
from akin.llm.tables import numbered, parts, written

COORDINATES, MATCHES = 64, 28
PERCENT = 75
LIST = 2048
BLOCK_DOCS, BLOCK_SHINGLES = 256, 1 << 20
BROADCAST_IDS = 1_000_000
EDGES = "a long, b long"


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, n, key (two longs that name the set), signature, low (its low bytes) for whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = coefficients(COORDINATES)
        for batch in parts(batches):
            sizes, left, right, signatures, low = [], [], [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_py())
                key = xxhash.xxh3_128_digest(found.tobytes())
                left.append(int.from_bytes(key[:8], "little", signed=True))
                right.append(int.from_bytes(key[8:], "little", signed=True))
                sizes.append(len(found))
                signatures.append(signature(found, factors))
                low.append(signatures[-1].astype(np.uint8).tobytes())
            values = np.concatenate(signatures).view(np.int32) if signatures else np.zeros(0, np.int32)
            offsets = np.arange(0, len(values) + 1, COORDINATES, dtype=np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n": pa.array(sizes, pa.int64()),
                    "key1": pa.array(left, pa.int64()),
                    "key2": pa.array(right, pa.int64()),
                    "signature": pa.ListArray.from_arrays(offsets, values),
                    "low": pa.array(low, pa.binary()),
                }
            )

    schema = docs.select(F.col("doc_id").cast("long").alias("doc_id")).schema
    for name in ("n", "key1", "key2"):
        schema = schema.add(name, "long")
    schema = schema.add("signature", ArrayType(IntegerType())).add("low", "binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def prefixes(classes: DataFrame) -> DataFrame:
    """key, node, low, rows: the rarest postings of every class that may have a partner."""
    place = F.posexplode("signature").alias("k", "v")
    postings = classes.select("node", place).select(
        "node", F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(0xFFFFFFFF)).alias("key")
    )
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    held = postings.join(shared, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("rows", "key"))).alias("p"))
    rare = held.where(F.size("p") >= MATCHES).select("node", F.slice("p", F.lit(1), F.size("p") - (MATCHES - 1)).alias("p"))
    return rare.join(classes.select("node", "low"), "node").select("node", "low", F.explode("p").alias("p")).select("p.key", "p.rows", "node", "low")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the consecutive rows that are equal in ``keys``."""
    rest: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            now = tuple(c[start] for c in columns)
            if rest and now != last:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch.slice(start, end - start))
            last = now
    if rest:
        yield pa.Table.from_batches(rest)


def _edges(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = np.array(rows or np.zeros((0, 2)), np.int64).T
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _list_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple[int, int]] = []
    for group in groups(batches, ["key"]):
        nodes = group.column("node").to_numpy()
        low = np.frombuffer(b"".join(group.column("low").to_pylist()), np.uint8).reshape(len(nodes), COORDINATES)
        apart = np.arange(len(nodes))
        while len(apart):
            queue, apart = [apart[0]], apart[1:]
            while queue and len(apart):
                at = queue.pop()
                near = np.count_nonzero(low[apart] == low[at], axis=1) >= MATCHES
                out += [(nodes[at], nodes[x]) for x in apart[near]]
                queue += list(apart[near])
                apart = apart[~near]
        if len(out) > 1 << 16:
            yield _edges(out)
            out = []
    yield _edges(out)


def retained(lists: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all classes of a list whose pairs reach MATCHES collisions."""
    short = lists.where(F.col("rows") <= LIST).select("key", "node", "low")
    counted = short.repartition("key").sortWithinPartitions("key").mapInArrow(_list_forests, EDGES)
    long = lists.where(F.col("rows") > LIST).select("key", "node")
    stars = long.join(long.groupBy("key").agg(F.min("node").alias("b")), "key").select(F.col("node").alias("a"), "b")
    return counted.unionAll(stars).where("a <> b").distinct()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        found = pa.array([shingles(t.as_py()).tobytes() for t in batch.column("text")], pa.large_binary()).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), found], ["node", "found"])


def _true_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Linked pairs between the sets at ``left`` and ``right``, by counting common shingles."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) <= 8:
        common = np.zeros((len(left), len(right)), np.int64)
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                common[i, j] = sizes[x] if x == y else len(np.intersect1d(sets[x], sets[y], assume_unique=True))
    else:
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # Shingles of one document only are common to nothing.
        several = np.cumsum(often > 1) - 1
        use = often[at] > 1
        owner, at = owner[use], several[at[use]]
        order = np.argsort(at, kind="stable")
        owner, at = owner[order], at[order]
        common = np.zeros((len(left), len(right)), np.float64)
        width = 4096
        for first in range(0, int(at[-1]) + 1 if len(at) else 0, width):
            lo, hi = np.searchsorted(at, (first, first + width))
            grid = np.zeros((len(sets), width), np.float32)
            grid[owner[lo:hi], at[lo:hi] - first] = 1
            common += grid[left] @ grid[right].T
    both = sizes[left][:, None] + sizes[right][None, :] - common
    for i, j in np.argwhere(100 * common >= PERCENT * both):
        yield int(left[i]), int(right[j])


def _block_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in groups(batches, ["cluster", "pair"]):
        nodes, side = group.column("node").to_numpy(), group.column("side").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in group.column("found").to_pylist()]
        one = side.min() == side.max()
        left, right = (np.arange(len(side)),) * 2 if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        forest, out = Forest(), []
        for x, y in _true_links(sets, left, right):
            if forest.union(int(nodes[x]), int(nodes[y])):
                out.append((nodes[x], nodes[y]))
        yield _edges(out)


def confirmed(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all classes linked on full sets. ``members``: cluster, node, n."""
    # Sizes of linked sets differ by less than a factor of two: classes of doubling sizes, each with its own block.
    sized = members.withColumn("c", F.floor(F.log2("n")).cast("int"))
    each = F.least(F.lit(BLOCK_DOCS), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_SHINGLES) / F.pow(F.lit(2.0), "c"))))
    dealt = numbered(written(sized, "members"), ["cluster", "c"], ["n", "node"], "i")
    dealt = written(dealt.withColumn("b", F.floor(F.col("i") / each).cast("long")).drop("i"), "blocks")
    blocks = dealt.groupBy("cluster", "c", "b").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    other = blocks.select("cluster", *(F.col(x).alias(f"{x}2") for x in ("c", "b", "low", "high")))
    ahead = (F.col("c2") > F.col("c")) | ((F.col("c2") == F.col("c")) & (F.col("b2") >= F.col("b")))
    meets = blocks.join(other, "cluster").where(ahead & (100 * F.col("high") >= PERCENT * F.col("low2")))
    pairs = meets.select("cluster", "c", "b", "c2", "b2", F.xxhash64("c", "b", "c2", "b2").alias("pair"))
    same = (F.col("c") == F.col("c2")) & (F.col("b") == F.col("b2"))
    first = pairs.select("cluster", "c", "b", "pair", F.lit(0).alias("side"))
    second = pairs.where(~same).select("cluster", F.col("c2").alias("c"), F.col("b2").alias("b"), "pair", F.lit(1).alias("side"))
    ids = dealt.select(F.col("node").alias("doc_id"))
    # The texts stay where they are while the ids are few enough to go to them; else both are shuffled.
    ids = F.broadcast(ids) if dealt.count() <= BROADCAST_IDS else ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets, "node long, found binary")
    sets = written(sets.dropDuplicates(["node", "found"]), "sets")
    places = dealt.join(first.unionAll(second), ["cluster", "c", "b"]).select("cluster", "pair", "side", "node")
    meeting = places.join(sets, "node").repartition("cluster", "pair").sortWithinPartitions("cluster", "pair")
    return meeting.select("cluster", "pair", "side", "node", "found").mapInArrow(_block_forests, EDGES)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Components of near duplicates: doc_id, n_shingles, component_id, kept.

    Two documents link at 100 * common shingles >= 75 * shingles of either. Null and empty texts and texts
    of white space have no shingle and link with nothing. Repeated rows are one class; rows that share an id
    but not the text share its links; a row with null id has the component of its class, null if no row of the class has an
    id, and is not kept. An empty table gives no rows; other columns are ignored.
    """
    every = written(signed(docs), "signed")
    least = every.where("n > 0 and doc_id is not null").groupBy("key1", "key2")
    classes = least.agg(F.min(F.struct("doc_id", "n", "signature", "low")).alias("c"))
    classes = written(classes.select("key1", "key2", F.col("c.doc_id").alias("node"), "c.n", "c.signature", "c.low"), "classes")
    edges = written(retained(written(prefixes(classes), "prefixes")), "retained")
    clusters = written(components(edges), "clusters")
    members = clusters.select(F.col("component").alias("cluster"), "node").join(classes.select("node", "n"), "node")
    found = components(confirmed(members, docs))
    of = classes.select("key1", "key2", "node").join(found, "node", "left")
    of = of.select("key1", "key2", F.coalesce("component", "node").alias("component"))
    # Equal texts of any number share a key; the other side has one row for each key.
    joined = every.drop("signature", "low").join(of, ["key1", "key2"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs``, all columns as they are, with one row of each group of near duplicates.

    An id stays if any of its rows is kept, with one row of its own if it has several. Rows without an id stay.
    """
    found = written(near_duplicates(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "kept")
    gone = found.where("not kept and doc_id is not null").select("doc_id")
    # Ids go to the texts while they are few enough to be broadcast; else both sides are shuffled.
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    left = docs.join(gone, "doc_id", "left_anti")
    if found.where("kept and n > 1").isEmpty():
        return left
    return left.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(left.where("doc_id is null"))
