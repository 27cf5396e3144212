"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint's 64 bits form 32 two-bit segments; the embedding holds each
segment's bit count.  The Manhattan distance of two embeddings never exceeds
the Hamming distance of the fingerprints, so fingerprints within ``max_bits``
lie within that Manhattan distance.  The 32 coordinates are dealt to
``max_bits + 2`` groups: a distance of at most ``max_bits`` leaves at least two
groups without any difference, so both points share the grid cell of some pair
of groups.  Cells are joined by sorting; inside a cell the whole Manhattan
distance is tested first, then the exact Hamming distance.

Counts are kept in unary (0: 00, 1: 01, 2: 11), so the Manhattan distance is
the bit count of the xor of two embeddings.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import ASCII_LOWER, map_slices, store, with_row_id

#: A cell with more distinct fingerprints is compared block by block in several tasks.
CELL_BLOCK = 4096
_EVEN = 0x5555555555555555
_VOTE_ROWS = 1 << 15


def shingle_hashes(text: str | None, shingle: int) -> list[int]:
    """XXH64 (seed 42) of every shingle; the whole sequence if there are fewer words."""
    words = (text or "").encode().translate(ASCII_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s:e], 42)
            for s, e in zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())]


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Bit b is 1 if set in over half of the shingle hashes; 0 without words."""
    hashes = np.array(shingle_hashes(text, shingle), np.uint64)
    votes = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _VOTE_ROWS):
        part = hashes[lo:lo + _VOTE_ROWS].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``docs`` without its text, plus ``fp`` (the fingerprint as a signed long)."""
    rest = [c for c in docs.columns if c != text_col]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest) + ", fp bigint"

    def run(batch: pa.RecordBatch):
        got = np.array([fingerprint(x, shingle) for x in batch.column(text_col).to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(got.view(np.int64))],
                                         names=[*rest, "fp"])
    return map_slices(docs, run, schema, by=text_col)


def embedding(fp):
    """Per-segment bit counts of a fingerprint column, in unary."""
    odd = F.shiftrightunsigned(fp, 1)
    some = fp.bitwiseOR(odd).bitwiseAND(F.lit(_EVEN))
    both = fp.bitwiseAND(odd).bitwiseAND(F.lit(_EVEN))
    return some.bitwiseOR(F.shiftleft(both, 1))


def _cell_masks(max_bits: int) -> list[int]:
    """Masks of all pairs of ``max_bits + 2`` coordinate groups, as signed longs."""
    groups = [sum(3 << (2 * s) for s in range(g, 32, max_bits + 2)) for g in range(max_bits + 2)]
    return [int(np.uint64(a | b).astype(np.int64)) for a, b in combinations(groups, 2)]


def _links_in_cells(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of links among the points of each cell; rows sorted by cell.

    Compares each row with the row ``lag`` places further in the same cell,
    for growing lags, and only joins pieces that aren't joined yet: at most
    one link per point leaves a cell, however many pairs it holds.
    """
    odd = fps >> np.uint64(1)
    even = np.uint64(_EVEN)
    grid = ((fps | odd) & even) | (((fps & odd) & even) << np.uint64(1))
    n, piece = len(fps), np.arange(len(fps))
    left, right = [], []
    rows, lag = np.arange(n - 1), 1
    while len(rows):
        rows = rows[rows + lag < n]
        rows = rows[keys[rows] == keys[rows + lag]]
        apart = rows[piece[rows] != piece[rows + lag]]
        other = apart + lag
        near = np.bitwise_count(grid[apart] ^ grid[other]) <= max_bits
        apart, other = apart[near], other[near]
        exact = np.bitwise_count(fps[apart] ^ fps[other]) <= max_bits
        pairs = list(zip(apart[exact].tolist(), other[exact].tolist()))
        for a, b in pairs:
            while piece[a] != a:
                a = piece[a]
            while piece[b] != b:
                b = piece[b]
            if a != b:
                left.append(fps[a])
                right.append(fps[b])
                piece[max(a, b)] = min(a, b)
        if pairs:
            while (jumped := piece[piece] != piece).any():
                piece = np.where(jumped, piece[piece], piece)
        lag += 1
    return np.array(left, np.uint64), np.array(right, np.uint64)


def links(points: DataFrame, max_bits: int = 4, block: int = CELL_BLOCK) -> DataFrame:
    """Links (a, b) that span every set of distinct ``points.fp`` within ``max_bits``.

    Both ends of a link are fingerprints in the same piece of the Hamming
    graph; every pair within ``max_bits`` is connected by links.
    """
    masks = _cell_masks(max_bits)
    grid = points.select("fp", embedding(F.col("fp")).alias("grid"))
    cells = grid.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("g"), F.col("grid").bitwiseAND(F.lit(m)).alias("cell"))
        for i, m in enumerate(masks)])).alias("c")).select("c.g", "c.cell", "fp")
    blocks = (cells.groupBy("g", "cell").agg(F.count("*").alias("n")).where(F.col("n") > block)
              .select("g", "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    # A large cell becomes one group for each pair of its blocks.
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    split = (cells.join(blocks, ["g", "cell"], "left")
             .withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1)))
                                            .otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
             .withColumn("part", F.when(F.col("other") < 0, F.lit(0).cast("bigint")).otherwise(
                 F.least(mine, F.col("other")).cast("bigint") * (1 << 31) + F.greatest(mine, F.col("other")))))
    keyed = (split.select(F.xxhash64("g", "cell", "part").alias("key"), "fp")
             .repartition("key").sortWithinPartitions("key"))

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)

        def out(k, f):
            a, b = _links_in_cells(k, f.view(np.uint64), max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy()])
            if len(keys) and keys[0] != keys[-1]:
                done = int(np.searchsorted(keys, keys[-1]))  # the last cell may go on in the next batch
                yield out(keys[:done], fps[:done])
                keys, fps = keys[done:], fps[done:]
        yield out(keys, fps)
    return keyed.mapInArrow(run, "a bigint, b bigint").distinct()


def connected(edges: DataFrame, name: str = "edges") -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root: the least node reachable.

    Alternates large-star and small-star steps until the edges are stars; each
    round is written to the shared folder.
    """
    now = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), name)
    mark = None
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        now = store(small, name)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = seen


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per row of ``docs`` (a stored table): rid, id, fp, component_id, keep.

    component_id is the smallest id reachable over links of at most
    ``max_bits`` bits; ``keep`` marks one row of each component (its smallest
    id; of repeated rows the first).  Null or empty texts have fingerprint 0
    and are linked like any other; a null id takes part but is never a
    component's name unless all ids there are null.  Extra columns are ignored.
    """
    rows = store(fingerprints(with_row_id(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))),
                              "text", shingle), "fingerprints")
    points = rows.groupBy("fp").agg(F.min("id").alias("id"), F.min(F.struct(F.col("id").isNull(), "id", "rid")).alias("first"))
    points = store(points, "points")
    roots = connected(links(points.select("fp"), max_bits))
    named = points.join(roots, points.fp == roots.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "id", "first")
    groups = named.groupBy("root").agg(F.min("id").alias("component_id"), F.min("first").alias("first"))
    named = named.select("fp", "root").join(groups, "root").select("fp", "component_id", F.col("first.rid").alias("keeper"))
    return rows.join(named, "fp").select("rid", "id", "fp", "component_id", (F.col("rid") == F.col("keeper")).alias("keep"))
