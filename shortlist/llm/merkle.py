"""Merkle manifest of a dataset: leaf, proof and folded root of every row.

Rows of one group (source) are the leaves of a tree of arity three, groups in
order are the leaves of the tree above it.  Leaves are sorted by one
range-partitioned sort and numbered from stored places, so a hot group is
spread over many parts.  ``3 ** LEVELS`` consecutive leaves form a superblock;
superblocks of small groups that start close together share a task.

Upwards, superblocks are reduced to one node each, and these nodes again,
until one is left per group, then over groups.  Downwards, the nodes that lead
from the root to a superblock are passed on, tier by tier.  At the end leaves
and the outer nodes of their superblock are cogrouped: one function finishes
the local reduction, joins local and outer proof, and folds every leaf to the
root.  No group is larger than two superblocks, and no tier leaves Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortlist.llm.common import store
from shortlist.operators.ordinal import with_position

ARITY = 3
#: A superblock has ARITY ** LEVELS leaves.
LEVELS = 7

#: monotonically_increasing_id: the part above, the place in the part in the lower 33 bits.
_PLACE_BITS = 33

_NODES = "tree bigint, i bigint, n bigint, digest string, pack bigint"
_PATHS = "tree bigint, i bigint, pack bigint, path string, top string"


def field(value: Column) -> Column:
    """'-' for a null, else UTF-8 byte count, ':' and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _hash(digests: str) -> str:
    return hashlib.sha256(digests.encode()).hexdigest()


def reduce_levels(digests: list[str], levels: int | None) -> list[list[str]]:
    """All levels above ``digests``, these first: ``levels`` of them, or up to a single node."""
    out = [digests]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        last = out[-1]
        out.append([_hash("".join(last[k:k + ARITY])) for k in range(0, len(last), ARITY)])
    return out


def siblings(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """Digests left and right of node ``i`` in its run, level by level below the last."""
    out = []
    for nodes in levels[:-1]:
        at = i - i % ARITY
        out.append(("".join(nodes[at:i]), "".join(nodes[i + 1:at + ARITY])))
        i //= ARITY
    return out


def pack_path(steps: list[tuple[str, str]]) -> str:
    """Steps as text: how many digests stand left and right, then the digests."""
    return "".join(f"{len(a) // 64}{len(b) // 64}{a}{b}" for a, b in steps)


def unpack_path(path: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(path):
        left, right = at + 2 + 64 * int(path[at]), 64 * int(path[at + 1])
        out.append((path[at + 2:left], path[left:left + right]))
        at = left + right
    return out


def fold(digest: str, steps: list[tuple[str, str]]) -> str:
    for left, right in steps:
        digest = _hash(left + digest + right)
    return digest


def numbered_leaves(rows: DataFrame, block: int) -> tuple[DataFrame, int]:
    """``rows`` (grp, id, leaf, tampered) with tree (number of the group), i (place in it), n (its size)
    and pack (superblocks that start within the same ``block`` places); and the number of groups."""
    order = [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf").asc()]
    at = store(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "merkle-sorted").select(
        *rows.columns, F.shiftright("_at", _PLACE_BITS).alias("part"),
        F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("place"))
    runs = store(at.groupBy("part", "grp").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("rows")), "merkle-runs")
    # One row per part of the sort goes through this window.
    sizes = runs.groupBy(F.col("part").alias("p")).agg(F.sum("rows").alias("rows_in_part"))
    before = F.coalesce(F.sum("rows_in_part").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.join(sizes.select("p", before.alias("before")), F.col("part") == F.col("p")).select(
        "part", "grp", "first", "rows", (F.col("before") + F.col("first")).alias("run_at"))
    groups = runs.groupBy("grp").agg(F.sum("rows").alias("n"), F.min("run_at").alias("start"))
    groups = with_position(groups, F.col("start"), name="tree").withColumn("tree", F.col("tree") - 1)
    named = runs.select("part", F.col("grp").alias("g"), "first", "run_at").join(
        groups, F.col("g").eqNullSafe(F.col("grp"))).select(
        F.col("part").alias("p"), "g", "first", "run_at", "n", "start", "tree")
    i = F.col("place") - F.col("first") + F.col("run_at") - F.col("start")
    out = at.join(named, (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g"))).withColumn("i", i)
    pack = F.expr(f"(start + (i div {block}) * {block}) div {block}")
    return store(out.select("tree", "i", "n", pack.alias("pack"), "id", "leaf", "tampered"), "merkle-leaves"), groups.count()


def _local_levels(n: int, levels: int) -> int | None:
    """Levels of one superblock in a tree of ``n`` nodes: up to the top if it is the only one."""
    return None if n <= ARITY ** levels else levels


def _reduced(levels: int, digest: str):
    """One node per superblock of a group's rows."""
    block = ARITY ** levels

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        rows = rows.sort_values(["tree", "i"])
        for (tree, b), part in rows.groupby(["tree", rows["i"] // block], sort=False):
            n = int(part["n"].iloc[0])
            top = reduce_levels(part[digest].tolist(), _local_levels(n, levels))[-1]
            out.append((tree, b, -(-n // block), top[0], part["pack"].iloc[0]))
        return pd.DataFrame(out, columns=["tree", "i", "n", "digest", "pack"])
    return run


def _climb(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Tiers of nodes from the given ones up to a single node per tree."""
    tiers = [nodes]
    while not (more := tiers[-1].where("n > 1")).isEmpty():
        keyed = more.withColumn("b", F.expr(f"i div {ARITY ** levels}"))
        tiers.append(store(keyed.groupBy("tree", "b").applyInPandas(_reduced(levels, "digest"), _NODES), "merkle-tier"))
    return tiers


def _descend(tiers: list[DataFrame], tops: DataFrame, levels: int) -> DataFrame:
    """(tree, i, pack, path, top) of every node of the lowest tier.

    ``tops`` (tree, path, top) leads from each tree's single node to the root.
    """
    block = ARITY ** levels

    def passed(key, nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(nodes):
            nodes = nodes.sort_values("i")
            local = reduce_levels(nodes["digest"].tolist(), _local_levels(int(nodes["n"].iloc[0]), levels))
            path, top = outer["path"].iloc[0], outer["top"].iloc[0]
            out = [(tree, i, pack, pack_path(siblings(local, i % block)) + path, top)
                   for tree, i, pack in nodes[["tree", "i", "pack"]].itertuples(index=False)]
        return pd.DataFrame(out, columns=["tree", "i", "pack", "path", "top"])

    paths = None
    for nodes in reversed(tiers):
        own = nodes.where("n = 1").join(tops, "tree").select("tree", "i", "pack", "path", "top")
        if paths is not None:
            inner = nodes.where("n > 1").withColumn("b", F.expr(f"i div {block}"))
            own = own.unionByName(inner.groupBy("tree", "b").cogroup(
                paths.withColumn("b", F.col("i")).groupBy("tree", "b")).applyInPandas(passed, _PATHS))
        paths = store(own, "merkle-paths")
    return paths


def _finish(levels: int, root: str):
    """Leaves of a few superblocks with their outer nodes: proofs and folded roots."""
    block = ARITY ** levels

    def run(key, leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        out = []
        leaves = leaves.sort_values(["tree", "i"])
        way = {(t, b): (path, top) for t, b, path, top in outer[["tree", "i", "path", "top"]].itertuples(index=False)}
        for (tree, b), part in leaves.groupby(["tree", leaves["i"] // block], sort=False):
            path, top = way[tree, b]
            above = unpack_path(path)
            rest = "".join(a + c for a, c in above)
            local = reduce_levels(part["leaf"].tolist(), _local_levels(int(part["n"].iloc[0]), levels))
            for i, (name, leaf, tampered) in enumerate(part[["id", "leaf", "tampered"]].itertuples(index=False)):
                steps = siblings(local, i)
                folded = fold(fold(leaf if tampered is None else tampered, steps), above)
                out.append((name, leaf, top, root, _hash("".join(a + c for a, c in steps) + rest), folded, folded == root))
        return pd.DataFrame(out, columns=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    return run


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source",
             fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
             tampered: dict[str, Column] | None = None, when: Column | None = None,
             levels: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the hash of ``fields``.  Rows where ``when`` holds are folded from
    a leaf in which the columns of ``tampered`` replace those of that name; all
    others from their own.  Groups are ordered with null first, rows in a group
    by id (null first), rows of one id by their leaf; equal rows are leaves
    each.  An empty table gives no rows.  Extra columns are ignored.
    """
    changed = tampered or {}
    values = [F.col(f"`{c}`") for c in fields]
    other = [changed.get(c, F.col(f"`{c}`")) for c in fields]
    rows = store(docs.select(
        F.col(group_col).cast("string").alias("grp"), F.col(id_col).alias("id"), leaf_hash(values).alias("leaf"),
        (F.lit(None).cast("string") if when is None else F.when(when, leaf_hash(other))).alias("tampered")), "merkle-rows")
    id_type = docs.schema[id_col].dataType
    leaves, n_groups = numbered_leaves(rows, ARITY ** levels)
    # pandas would turn integers beside nulls into floats: ids travel as text.
    leaves = leaves.withColumn("id", F.col("id").cast("string"))
    tiers = _climb(store(leaves.select("tree", "i", "n", "leaf", "pack").groupBy("pack")
                         .applyInPandas(_reduced(levels, "leaf"), _NODES), "merkle-tier"), levels)
    subroots = None
    for nodes in tiers:
        done = nodes.where("n = 1").select("tree", "digest")
        subroots = done if subroots is None else subroots.unionByName(done)
    forest = _climb(store(subroots.select(F.lit(0).cast("bigint").alias("tree"), F.col("tree").alias("i"),
                                          F.lit(n_groups).cast("bigint").alias("n"), "digest",
                                          F.lit(0).cast("bigint").alias("pack")), "merkle-subroots"), levels)
    top = forest[-1].first()
    root = top["digest"] if top else ""
    single = docs.sparkSession.range(1).select(F.col("id").alias("tree"), F.lit("").alias("path"), F.lit(root).alias("top"))
    ways = _descend(forest, single, levels).select(F.col("i").alias("tree"), "path")
    outer = _descend(tiers, ways.join(subroots.withColumnRenamed("digest", "top"), "tree"), levels)
    schema = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    got = leaves.groupBy("pack").cogroup(outer.groupBy("pack")).applyInPandas(_finish(levels, root), schema)
    return got.withColumn("id", F.col("id").cast(id_type))
