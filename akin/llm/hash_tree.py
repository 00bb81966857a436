"""Sharding by a hierarchical weighted hash tree.

A topology is a list of leaves ``(region, rack, shard, weight)``. A row descends from the root: among
the regions, then the racks of the region, then the shards of the rack, it takes the child whose
weighted draw ``ln(u) / weight`` is largest, ``u`` in (0, 1) being a hash of the row's key and of the
child's name. The weight of a region or rack is the sum of its leaves. A child's draw depends on
nothing but key, name and weight, so a change of weights moves only rows that enter or leave the
subtrees whose weight changed; every other row keeps its shard. A shard added as a region of its
own changes no other weight: it takes rows only into itself.

Everything is one column expression: no shuffle, no state, no Python in the tasks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from akin.llm.tables import numbered, written

RACKS, SHARDS_PER_RACK, BASE = 3, 4, 24


class Leaf(NamedTuple):
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(n_shards: int, base: int = BASE) -> list[Leaf]:
    """``n_shards`` equal shards: ``base`` of them in regions of 3 racks of 4, each further one a region.

    From ``base`` on, one more shard takes rows only into itself. Below, a shard joins the last rack
    and movement is confined to the regions whose weight changes.
    """
    if n_shards < 1:
        raise ValueError("at least one shard is needed")
    per_region = RACKS * SHARDS_PER_RACK
    first = [Leaf(s // per_region, s // SHARDS_PER_RACK, s) for s in range(min(n_shards, base))]
    regions, racks = -(-base // per_region), -(-base // SHARDS_PER_RACK)
    return first + [Leaf(regions + s - base, racks + s - base, s) for s in range(base, n_shards)]


def _draw(key: list[Column], level: str, name: int, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(*key, F.lit(level), F.lit(name)), 12)
    return F.log((bits + 0.5) / F.lit(float(1 << 52))) / F.lit(float(weight))


def _descend(key: list[Column], leaves: list[Leaf], levels: tuple[str, ...]) -> Column:
    level, *below = levels
    children: dict[int, list[Leaf]] = {}
    for leaf in leaves:
        children.setdefault(getattr(leaf, level), []).append(leaf)
    children = {c: ls for c, ls in children.items() if sum(x.weight for x in ls) > 0}
    if not children:
        raise ValueError("all weights are zero")
    draws = [
        F.struct(_draw(key, level, c, sum(x.weight for x in ls)).alias("draw"), F.lit(c).alias("child"))
        for c, ls in children.items()
    ]
    best = (F.greatest(*draws) if len(draws) > 1 else draws[0])["child"]
    if not below:
        return best
    found = F.lit(None).cast("int")
    for c, ls in children.items():
        found = F.when(best == c, _descend(key, ls, tuple(below))).otherwise(found)
    return found


def shard_of(key: list[Column], leaves: list[Leaf]) -> Column:
    """The shard (int) of a row with the given key. A key of nulls is a key like any other."""
    return _descend([F.struct(*key)] if len(key) > 1 else key, leaves, ("region", "rack", "shard"))


def sharded(docs: DataFrame, n_shards: int = BASE) -> DataFrame:
    """Place documents: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: ``doc_id`` and the number of shards decide. ``grown_shard`` is the place with
    one more shard. ``slot`` numbers the rows of a shard from 0 without gaps, a hot shard in parts.
    A null text counts as empty (size 8, crc 0); rows with null ``doc_id`` share a shard; repeated rows
    share it too and get slots of their own; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    key = [F.col("doc_id")]
    placed = docs.select("doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, topology(n_shards)).alias("shard"),
        shard_of(key, topology(n_shards + 1)).alias("grown_shard"),
    )
    order = ["doc_id", "text_crc32", "size"]
    return numbered(written(placed, "placed"), ["shard"], order, "slot").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
