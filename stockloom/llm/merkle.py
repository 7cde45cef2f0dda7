"""Merkle manifest of a dataset as a persistent path-copying tree.

Every row is a leaf: the digest of its fields. The leaves of a group stand in the order of the key; every three
consecutive nodes (the last run: fewer) become their digest until one remains, the group's subroot, and the
subroots in the order of the groups become the root in the same way. A digest is the lower-case hexadecimal
SHA-256 of the fields or digests written one after the other.

Leaves get dense places by a range sort, so a group of any size is spread. The tree is cut into aligned blocks of
three to the power of STEPS nodes. Going up, a task turns a block into its root, and the block roots are the nodes
of the next stage. Going down, every node of a stage gets its path: the siblings of each level up to the root.
The blocks of the leaves meet their paths last. A changed leaf makes a new version of its block's tree that shares
every untouched node: only the ancestors are copied, inside the block first, then along the block's path through
the stages above. Tasks hold one block and one path, whatever the size of the table.

Edge cases: a null field is `-`, so it differs from an empty one. Null keys and groups come first and are equal to
each other; rows that share a key follow each other by their digest, and identical rows each have a leaf. A group
of one leaf is its own subroot, a single subroot the root. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from stockloom.functions.ids import sequential_numbers
from stockloom.session import published

ARITY = 3
#: Levels of a block; a block has ARITY to this power of nodes.
STEPS = 6
SALTS = 16

_NODE = "tree long, place long, nodes long, digest string"
_PATH = "tree long, place long, before array<string>, after array<string>, subroot string, root string"
_LEAF = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, copied array<string>"


def field(value: Column) -> Column:
    """A field as it enters a leaf: `-`, or its length in UTF-8 bytes, a colon and its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)).cast("binary"), 256)


def digest_of(parts) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def block_levels(digests: list[str], whole: bool, steps: int = STEPS) -> list[list[str]]:
    """All levels of a block from its nodes to its root. A `whole` tree ends when one node is left, a part of
    a larger one after `steps` levels, where a lone node is digested at each."""
    levels = [digests]
    while len(levels[-1]) > 1 if whole else len(levels) <= steps:
        below = levels[-1]
        levels.append([digest_of(below[k : k + ARITY]) for k in range(0, len(below), ARITY)])
    return levels


def siblings(levels: list[list[str]], place: int) -> tuple[list[str], list[str]]:
    """The digests before and after a node's own in its run, for every level of the block."""
    before, after = [], []
    for level in levels[:-1]:
        first = place - place % ARITY
        before.append("".join(level[first:place]))
        after.append("".join(level[place + 1 : first + ARITY]))
        place //= ARITY
    return before, after


def copy_path(changed: str, before: list[str], after: list[str]) -> list[str]:
    """The nodes that a version with another leaf owns, from the lowest ancestor to the root; it shares all others."""
    copied = []
    for left, right in zip(before, after):
        changed = digest_of((left, changed, right))
        copied.append(changed)
    return copied


def _up(block: pd.DataFrame, steps: int) -> pd.DataFrame:
    """The root of one block."""
    block = block.sort_values("place")
    first, nodes, size = block.iloc[0], int(block["nodes"].iloc[0]), ARITY**steps
    root = block_levels(block["digest"].tolist(), nodes <= size, steps)[-1][0]
    return pd.DataFrame({"tree": [first["tree"]], "place": [first["place"] // size], "nodes": [-(-nodes // size)], "digest": [root]})


def _down(block: pd.DataFrame, above: pd.DataFrame, steps: int) -> pd.DataFrame:
    """The path of every node of one block, its own levels first and then those above."""
    block = block.sort_values("place")
    levels = block_levels(block["digest"].tolist(), int(block["nodes"].iloc[0]) <= ARITY**steps, steps)
    top = above.iloc[0]
    rows = []
    for k, (tree, place) in enumerate(zip(block["tree"], block["place"])):
        before, after = siblings(levels, k)
        rows.append((tree, place, before + list(top["before"]), after + list(top["after"]), top["subroot"], top["root"]))
    return pd.DataFrame(rows, columns=["tree", "place", "before", "after", "subroot", "root"])


def _fold(block: pd.DataFrame, above: pd.DataFrame, steps: int, versions: bool) -> pd.DataFrame:
    """Proof and version of every leaf of one block."""
    block = block.sort_values("place")
    levels = block_levels(block["digest"].tolist(), int(block["nodes"].iloc[0]) <= ARITY**steps, steps)
    top = above.iloc[0]
    higher = list(top["before"]), list(top["after"])
    proofs, roots, copies = [], [], []
    for k, (shown, original) in enumerate(zip(block["shown"], block["digest"])):
        before, after = siblings(levels, k)
        before, after = before + higher[0], after + higher[1]
        proofs.append(digest_of(x for both in zip(before, after) for x in both))
        copied = copy_path(shown, before, after)
        roots.append(copied[-1] if copied else shown)
        copies.append(copied if versions and shown != original else None)
    out = pd.DataFrame({"doc_id": block["doc_id"], "leaf": block["digest"], "subroot": top["subroot"], "root": top["root"]})
    return out.assign(proof_sha256=proofs, folded_root=roots, verified=[r == top["root"] for r in roots], copied=copies)


def _placed(leaves: DataFrame) -> tuple[DataFrame, int, int]:
    """tree, place, nodes, doc_id, digest, shown; the number of trees and of nodes in the largest."""
    order = [F.asc_nulls_first("_group"), F.asc_nulls_first("doc_id"), F.asc("digest"), F.asc("shown")]
    rows = sequential_numbers(leaves, order, "_number")
    groups = rows.groupBy("_group").agg(F.min("_number").alias("_first"), F.count("*").alias("nodes"))
    groups = published(sequential_numbers(groups, [F.asc_nulls_first("_group")], "tree"))
    most = groups.agg(F.count("*"), F.coalesce(F.max("nodes"), F.lit(0))).first()
    every = groups.select(F.col("_group").alias("_of"), "_first", "nodes", "tree", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    rows = rows.withColumn("_at", F.pmod(F.xxhash64("_number"), F.lit(SALTS)).cast("int"))
    rows = rows.join(every, F.col("_group").eqNullSafe(F.col("_of")) & (F.col("_at") == F.col("_salt")))
    return published(rows.select("tree", (F.col("_number") - F.col("_first")).alias("place"), "nodes", "doc_id", "digest", "shown")), most[0], most[1]


def manifest(
    rows: DataFrame,
    fields: list[str],
    changed: dict[str, Column] | None = None,
    key: str = "doc_id",
    group: str = "source",
    steps: int = STEPS,
    versions: bool = False,
) -> DataFrame:
    """One row per row: doc_id (the key), leaf, subroot, root, proof_sha256, folded_root, verified, copied.

    `changed` says what some fields hold when the row is shown again; folded_root is computed from that leaf and the
    original siblings, proof_sha256 is the digest of these siblings. With `versions`, `copied` holds the nodes that
    the version of a changed row owns, lowest first; it is null otherwise.
    """
    now = [(changed or {}).get(name, F.col(name)) for name in fields]
    # texts become digests before anything is sorted
    leaves = rows.select(
        F.col(group).cast("string").alias("_group"), F.col(key).cast("long").alias("doc_id"), leaf([F.col(f) for f in fields]).alias("digest"), leaf(now).alias("shown")
    )
    placed, groups, most = _placed(published(leaves))
    size = ARITY**steps
    block = F.floor(F.col("place") / size).cast("long")
    lower = [placed.select("tree", "place", "nodes", "digest")]
    while most > 1:
        lower.append(published(lower[-1].groupBy("tree", block).applyInPandas(partial(_up, steps=steps), _NODE)))
        most = -(-most // size)
    subroots = lower[-1].select(F.lit(0).cast("long").alias("tree"), (F.col("tree") - 1).alias("place"), F.lit(groups).cast("long").alias("nodes"), "digest")
    upper = [subroots]
    while groups > 1:
        upper.append(published(upper[-1].groupBy("tree", block).applyInPandas(partial(_up, steps=steps), _NODE)))
        groups = -(-groups // size)

    def down(stage: DataFrame, above: DataFrame) -> DataFrame:
        return published(stage.groupBy("tree", block).cogroup(above.groupBy("tree", "place")).applyInPandas(partial(_down, steps=steps), _PATH))

    none = F.array().cast("array<string>")
    paths = upper[-1].select("tree", "place", none.alias("before"), none.alias("after"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for stage in reversed(upper[:-1]):
        paths = down(stage, paths)
    # a subroot is the only node of the tree of its group
    paths = paths.drop("subroot").join(subroots.select("place", F.col("digest").alias("subroot")), "place")
    paths = published(paths.select((F.col("place") + 1).alias("tree"), F.lit(0).cast("long").alias("place"), "before", "after", "subroot", "root"))
    for stage in reversed(lower[1:-1]):
        paths = down(stage, paths)
    leaves_of_block = placed.withColumn("doc_id", F.col("doc_id").cast("string"))  # a frame would hold longs beside nulls as doubles
    fold = partial(_fold, steps=steps, versions=versions)
    out = leaves_of_block.groupBy("tree", block).cogroup(paths.groupBy("tree", "place")).applyInPandas(fold, _LEAF)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
