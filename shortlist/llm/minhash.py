"""MinHash near-duplicates by an LSH forest.

A document's set of shingles gets min-hashes, dealt to trees: in each tree its
label is a string of bytes, one per min-hash, and the tree is the sorted order
of all labels.  Rows whose labels share a prefix are a region; within a region
rows are compared with their neighbours in sorted order, those with the longest
common prefix first.  A candidate must agree in size and in enough sketch bits.

Depth follows the region.  At ``DEPTHS[0]`` bytes regions are small wherever
texts differ; rows of a region that is still large go to the second depth, with
more trees, so that a pair at the threshold is missed about as rarely there
(``MISS``).  What is large even there is compared block by block.

Candidates only say which documents must meet: they are joined to groups, and
inside a group every pair of full sets is intersected exactly, so each link is
confirmed on full sets and no candidate chain merges anything by itself.
Documents with equal sets are one point throughout.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shortlist.llm.common import coded_words, map_slices, store, with_row_id
from shortlist.llm.simhash import connected

#: Common prefix, in min-hashes, that makes two rows neighbours: usual and large regions.
DEPTHS = (5, 10)
#: Chance that no tree shows a pair exactly at the threshold; sets the number of trees.
MISS = 1e-6
#: A region with more rows goes to the next depth.
REGION = 512
#: Rows in a block of a large region or candidate group, and shingles in a block of a group.
BLOCK = 1024
BLOCK_SHINGLES = 4 << 20
#: One bit of this many min-hashes is compared before a pair becomes a candidate.
SKETCH = 320
#: Tables up to this many rows of a few numbers may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 1 << 20
#: Rows of one set that take one salt in the last join.
HOT = 4096

_ROWS = 128              # shingles hashed at a time
_M1, _M2, _M3 = 0x9E3779B97F4A7C15, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def trees_for(depth: int, percent: int) -> int:
    """Trees that miss a pair at the threshold with chance ``MISS``."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** depth)) if percent < 100 else 1


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(by)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text (fewer words: the whole sequence)."""
    distinct, index, offsets = coded_words(pc.ascii_lower(pc.fill_null(texts, "")))
    word = np.array([xxhash.xxh64_intdigest(w.encode(), 1) for w in distinct], np.uint64)[index]
    count = np.diff(offsets)
    sizes = np.minimum(count, shingle)
    mixed = np.zeros(len(word), np.uint64)
    doc_size = np.repeat(sizes, count)                  # words in a shingle of this document
    place = np.arange(len(word)) - np.repeat(offsets[:-1], count)
    left = np.repeat(count, count) - place
    mixed += doc_size.astype(np.uint64)
    for k in range(shingle):
        use = np.flatnonzero((doc_size > k) & (left >= doc_size))
        mixed[use] = mixed[use] * np.uint64(_M1) + word[use + k]
    mixed = _mixed(mixed, _M2)
    return [np.unique(mixed[a:a + max(n - s + 1, 0)]) if n else mixed[:0]
            for a, n, s in zip(offsets[:-1].tolist(), count.tolist(), sizes.tolist())]


def min_hashes(shingles: np.ndarray, masks: np.ndarray, factors: np.ndarray) -> np.ndarray:
    low = np.full(len(masks), 0xFFFFFFFF, np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)[:, None]
    for a in range(0, len(short), _ROWS):
        hashed = short[a:a + _ROWS] ^ masks
        hashed *= factors
        np.minimum(low, hashed.min(axis=0), out=low)
    return low


def signatures(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(rid, id, n, c1, c2, labels, bits): set size, two sums that name the set, labels of all trees, sketch."""
    total = max(max(trees_for(d, percent) for d in DEPTHS) * DEPTHS[-1], SKETCH)
    rng = np.random.default_rng(11)
    masks = rng.integers(0, 1 << 32, total, dtype=np.uint64).astype(np.uint32)
    factors = rng.integers(0, 1 << 32, total, dtype=np.uint64).astype(np.uint32) | np.uint32(1)

    def run(batch: pa.RecordBatch):
        out = []
        for s in shingle_sets(batch.column("text"), shingle):
            low = min_hashes(s, masks, factors)
            sketch = np.packbits((low[:SKETCH] * np.uint32(0x85EBCA6B)) >> np.uint32(31))
            out.append((len(s), int(_mixed(s, _M2).sum(dtype=np.uint64).astype(np.int64)),
                        int(_mixed(s, _M3).sum(dtype=np.uint64).astype(np.int64)),
                        ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8).tobytes(), sketch.tobytes()))
        n, c1, c2, labels, bits = zip(*out)
        yield pa.RecordBatch.from_arrays(
            [batch.column("rid"), batch.column("id"), pa.array(n, pa.int64()), pa.array(c1, pa.int64()),
             pa.array(c2, pa.int64()), pa.array(labels, pa.binary()), pa.array(bits, pa.binary())],
            names=["rid", "id", "n", "c1", "c2", "labels", "bits"])
    id_type = docs.schema["id"].dataType.simpleString()
    return map_slices(docs, run, f"rid bigint, id {id_type}, n bigint, c1 bigint, c2 bigint, labels binary, bits binary")


def _grouped(key: str, handle):
    """Arrow batches sorted by ``key`` -> ``handle(table)`` on runs of whole groups."""
    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            keys = held.column(key).to_numpy()
            done = int(np.searchsorted(keys, keys[-1]))   # the last group may go on in the next batch
            if done:
                yield from handle(held.slice(0, done))
                held = held.slice(done)
        if held is not None:
            yield from handle(held)
    return run


def _pairs(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def sketch_limit(percent: int) -> int:
    """Differing sketch bits that a pair at the threshold exceeds with less than a millionth's chance."""
    p = (1 - percent / 100) / 2
    return math.ceil(SKETCH * p + 5 * math.sqrt(SKETCH * p * (1 - p)))


def _neighbours(percent: int):
    """Candidate links that span every region; rows sorted by region and label.

    Each row meets the row ``lag`` places further in its region, for growing
    lags; rows that are joined already need not meet, so at most one link per
    row leaves a region.
    """
    limit = sketch_limit(percent)

    def handle(rows: pa.Table):
        keys, rid, n = (rows.column(c).to_numpy() for c in ("key", "rid", "n"))
        alone = np.ones(len(keys) + 1, bool)
        alone[1:-1] = keys[1:] != keys[:-1]
        some = np.flatnonzero(~(alone[1:] & alone[:-1]))
        if not len(some):
            return
        keys, rid, n = keys[some], rid[some], n[some]
        bits = np.frombuffer(b"".join(rows.column("bits").take(pa.array(some)).to_pylist()), np.uint64).reshape(len(some), -1)
        piece, left, right = np.arange(len(keys)), [], []
        at, lag = np.arange(len(keys) - 1), 1
        while len(at):
            at = at[at + lag < len(keys)]
            at = at[keys[at] == keys[at + lag]]
            one = at[piece[at] != piece[at + lag]]
            two = one + lag
            near = 100 * np.minimum(n[one], n[two]) >= percent * np.maximum(n[one], n[two])
            one, two = one[near], two[near]
            near = np.bitwise_count(bits[one] ^ bits[two]).sum(axis=1) <= limit
            for a, b in zip(one[near].tolist(), two[near].tolist()):
                x, y = a, b
                while piece[x] != x:
                    x = piece[x]
                while piece[y] != y:
                    y = piece[y]
                if x != y:
                    left.append(rid[a])
                    right.append(rid[b])
                    piece[max(x, y)] = min(x, y)
            if near.any():
                while (jumped := piece[piece] != piece).any():
                    piece = np.where(jumped, piece[piece], piece)
            lag += 1
        yield _pairs(left, right)
    return handle


def _labelled(points: DataFrame, depth: int, trees: int) -> DataFrame:
    """One row per point and tree: key of its region at ``depth``, and the rest of the label."""
    size = DEPTHS[-1]
    tree = points.select("rid", "n", "bits", "labels", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    label = F.substring("labels", F.col("tree") * size + 1, F.lit(size))
    return tree.select(F.xxhash64("tree", F.substring(label, 1, depth)).alias("key"),
                       F.substring(label, depth + 1, size).alias("rest"), "rid", "n", "bits")


def _small(df: DataFrame) -> DataFrame:
    """A stored table as a join side: broadcast if its counted rows are few, else as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _compared(keyed: DataFrame, percent: int) -> DataFrame:
    sort = ["key", "rest"]
    return keyed.repartition("key").sortWithinPartitions(*sort).mapInArrow(_grouped("key", _neighbours(percent)), "a bigint, b bigint")


def candidates(points: DataFrame, percent: int, region: int = REGION, block: int = BLOCK) -> DataFrame:
    """(a, b): rows of ``points`` (rid, n, labels, bits) that must meet, spanning every group of such rows."""
    keyed = _labelled(points, DEPTHS[0], trees_for(DEPTHS[0], percent))
    large = store(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > region).select("key"), "minhash-large")
    if large.isEmpty():
        return _compared(keyed, percent).distinct()
    found = _compared(keyed.join(_small(large), "key", "left_anti"), percent)
    deep = store(keyed.select("key", "rid").join(_small(large), "key", "left_semi").select("rid").distinct(), "minhash-deep")
    inner = store(points.join(_small(deep), "rid", "left_semi"), "minhash-deep-points")
    keyed = _labelled(inner, DEPTHS[1], trees_for(DEPTHS[1], percent))
    blocks = store(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > block)
                   .select("key", F.ceil(F.col("rows") / block).cast("int").alias("blocks")), "minhash-blocks")
    split = _split(keyed.join(_small(blocks), "key", "left"), "key", ["rest", "rid", "n", "bits"])
    return found.union(_compared(split, percent)).distinct()


def _split(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with ``blocks`` (null: 1) as one group per pair of blocks, under a new ``key``."""
    blocks = F.coalesce("blocks", F.lit(1))
    mine = F.pmod(F.xxhash64("rid"), blocks).cast("int")
    with_other = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return with_other.select(F.xxhash64(key, F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), *columns)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all pairwise intersections of sorted distinct sets."""
    k = len(sets)
    owner = np.repeat(np.arange(k), [len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((k, k), np.float32)
    common = count[code] > max(16, k // 16)           # in many sets: by matrix products
    columns, place = np.unique(code[common], return_inverse=True)
    rows = owner[common]
    order = np.argsort(place, kind="stable")
    rows, place = rows[order], place[order]
    for a in range(0, len(columns), 4096):
        lo, hi = np.searchsorted(place, [a, a + 4096])
        block = np.zeros((k, min(4096, len(columns) - a)), np.float32)
        block[rows[lo:hi], place[lo:hi] - a] = 1
        out += block @ block.T
    rare = (count[code] > 1) & ~common                # in a few: each with the next ones of its list
    code, rows = code[rare], owner[rare]
    order = np.argsort(code, kind="stable")
    code, rows = code[order], rows[order]
    flat = np.zeros(k * k, np.int64)
    for lag in range(1, max(16, k // 16)):
        same = np.flatnonzero(code[lag:] == code[:-lag])
        if not len(same):
            break
        flat += np.bincount(rows[same] * k + rows[same + lag], minlength=k * k)
    sparse = flat.reshape(k, k)
    out += sparse + sparse.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _confirmed(percent: int):
    """Links confirmed on full sets, spanning each linked part of a group."""
    def handle(rows: pa.Table):
        keys, rid = rows.column("key").to_numpy(), rows.column("rid").to_numpy()
        sets = rows.column("shingles").to_pylist()
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        left, right = [], []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a < 2:
                continue
            some = [np.frombuffer(s, np.uint64) for s in sets[a:b]]
            size = np.array([len(s) for s in some], np.int64)
            both = overlaps(some).astype(np.int64)
            linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
            first = np.arange(b - a)
            while True:   # least row reachable
                lower = np.where(linked, first[None, :], b - a).min(axis=1)
                lower = np.minimum(lower, lower[lower])
                if (lower == first).all():
                    break
                first = lower
            other = np.flatnonzero(first != np.arange(b - a))
            left += rid[a + other].tolist()
            right += rid[a + first[other]].tolist()
        if left:
            yield _pairs(left, right)
    return handle


def _with_sets(docs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """(rid, root, blocks, shingles) of the rows of ``docs`` (rid, text) in ``members``."""
    def run(batch: pa.RecordBatch):
        sets = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), shingle)], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "root", "blocks")), sets],
                                         names=["rid", "root", "blocks", "shingles"])
    return map_slices(docs.join(members, "rid").select("rid", "root", "blocks", "text"), run,
                      "rid bigint, root bigint, blocks int, shingles binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    percent: int = 85) -> DataFrame:
    """One row per row of ``docs`` (a stored table): rid, id, n_shingles, component_id, kept.

    A-Z count as a-z; words are ``[^\\x20\\x09-\\x0D]+``.  A text of fewer words
    than ``shingle`` is one shingle; one without words (or null) has the empty
    set, is linked with nothing, and is its own component.  Documents with
    100 * intersection >= ``percent`` * union are linked.  component_id is the
    smallest id reachable (null only if all ids there are), ``kept`` whether it
    is the row's own; repeated rows share both.  Extra columns are ignored.
    """
    slim = with_row_id(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")))
    rows = store(signatures(slim, shingle, percent), "minhash-rows")
    classes = store(rows.where("n > 0").groupBy("c1", "c2", "n").agg(
        F.min("rid").alias("rid"), F.min("id").alias("id"), F.count(F.lit(1)).alias("rows")), "minhash-classes")
    points = store(rows.select("rid", "n", "labels", "bits").join(classes.select("rid"), "rid", "left_semi"), "minhash-points")

    groups = store(connected(candidates(points, percent)), "minhash-groups")
    members = groups.union(groups.select("root", "root").distinct()).toDF("rid", "root")
    sized = members.join(classes.select("rid", "n"), "rid")
    blocks = sized.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES))
                                       .cast("int").alias("blocks"))
    members = store(members.join(blocks, "root").select("rid", "root", "blocks"), "minhash-members")
    met = _split(_with_sets(slim.select("rid", "text"), _small(members), shingle), "root", ["rid", "shingles"])
    links = met.repartition("key").sortWithinPartitions("key").mapInArrow(_grouped("key", _confirmed(percent)), "a bigint, b bigint")
    roots = connected(links.distinct(), "minhash-links")

    named = classes.join(roots, classes.rid == roots.node, "left").select(
        "c1", "c2", "n", "id", "rows", F.coalesce("root", "rid").alias("root"))
    named = store(named.join(named.groupBy("root").agg(F.min("id").alias("component_id")), "root")
                  .select("c1", "c2", "n", "component_id", F.ceil(F.col("rows") / HOT).cast("int").alias("salts")), "minhash-named")
    # A set that very many rows have meets them in several tasks.
    hot = named.where("salts > 1").select("c1", "c2", "n", "salts")
    salted = rows.select("rid", "id", "n", "c1", "c2").join(_small(hot), ["c1", "c2", "n"], "left").withColumn(
        "salt", F.pmod(F.xxhash64("rid"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    spread = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    full = salted.where("n > 0").join(spread, ["c1", "c2", "n", "salt"]).select("rid", "id", "n", "component_id")
    alone = rows.where("n = 0").select("rid", "id", "n", F.col("id").alias("component_id"))
    return full.unionByName(alone).select("rid", "id", F.col("n").alias("n_shingles"), "component_id",
                                          F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
