"""Shards by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws -ln(u) / weight from a hash of
the row's key and the child's name, and the smallest draw wins, so children win in proportion to their
weights. A child's draw depends on nothing but its own name and weight: when weights change, rows move
only into or out of the subtrees whose weights changed. A shard that joins as a region of its own
therefore takes rows only into itself (law `key`).

Edge cases: a null key is a key of its own; null texts have no bytes. Equal keys always share a shard.
An empty table gives an empty result; columns of the input that are not named here are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import Column, DataFrame, functions as F

from stockloom.llm.numbering import numbered

#: Parts per shard in which slots are numbered; they only spread the work, numbers do not depend on them.
SLOT_PARTS = 128


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(shards: int, regions: int = 2, racks: int = 2) -> list[Leaf]:
    """`shards` leaves: the first regions * racks * 2 fill the racks evenly, each later one is a region of its own."""
    base = min(shards, regions * racks * 2)
    leaves = [Leaf(f"r{k * regions // base}", f"k{k * regions * racks // base}", k) for k in range(base)]
    return leaves + [Leaf(f"r+{k}", f"k+{k}", k) for k in range(base, shards)]


def _draw(key: Column, node: str, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1) from 48 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{node}")).cast("binary")), 1, 12), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(2**48)) / float(weight)


def _winner(key: Column, children: list[tuple[str, float]]) -> Column:
    """The position of the child with the smallest draw."""
    live = [(k, name, weight) for k, (name, weight) in enumerate(children) if weight > 0]
    if len(live) == 1:
        return F.lit(live[0][0])
    return F.least(*(F.struct(_draw(key, name, weight).alias("d"), F.lit(k).alias("k")) for k, name, weight in live))["k"]


def place(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key: three nested choices, of which only the ones on the row's own path are evaluated."""

    def down(part: list[Leaf], levels: tuple[str, ...]) -> Column:
        if not levels:
            return F.lit(part[0].shard)
        children = [(name, list(some)) for name, some in groupby(sorted(part, key=lambda x: (getattr(x, levels[0]), x.shard)), key=lambda x: getattr(x, levels[0]))]
        named = [(f"{levels[0]}:{name}", sum(x.weight for x in some)) for name, some in children]
        if len(children) == 1:
            return down(children[0][1], levels[1:])
        won = _winner(key, named)
        out = None
        for k, (_, some) in enumerate(children):
            below = down(some, levels[1:])
            out = F.when(won == k, below) if out is None else out.when(won == k, below)
        return out

    if sum(x.weight > 0 for x in leaves) == 0:
        raise ValueError("a tree needs a leaf of positive weight")
    return down([x for x in leaves if x.weight > 0], ("region", "rack", "shard")).cast("int")


def shard(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf] | None = None, parts: int = SLOT_PARTS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    # hashes first, the whole text is dropped before anything is shuffled
    slim = docs.select(
        F.col("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        place(key, leaves).alias("shard"),
        (place(key, grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    return numbered(slim, "shard", order, "slot", parts).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
