"""Approximate nearest neighbours by inner product with an adaptive dimension scan.

Vectors get one more coordinate that brings all to the length of the longest,
so the largest inner product is the smallest Euclidean distance; a random
rotation then spreads each distance evenly over the coordinates.  Every vector
goes to the list of its nearest centroid.  In each probed list the rotated
vectors are scanned in blocks of columns: after each block a candidate is
given up when its distance so far, scaled to all columns, is too large for the
threshold by a hypothesis test.  The survivors get exact scores.

Centroids, rotation and first thresholds come from a bounded sample; every
vector is indexed.  A first threshold looks only at the sample's vectors in the
query's own probed lists, which hold ``k`` + 1 vectors at least; a query that
still ends with fewer rows than there are is compared with every vector.  Equal vectors are searched once: ``k`` + 1 of the smallest
ids stand for them, which is all that a list of ``k`` can show.  Rows equal in
id and vector are one candidate with a count, which is expanded at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shortlist.llm.common import store

#: Vectors that centroids and first thresholds are fitted on, at most.
SAMPLE = 8192
#: Vectors of a list; candidates and queries that meet in one task at a time.
LIST_SIZE, MEET = 500, 2048
#: Share of the sample's own neighbours that the probed lists must hold.
TARGET = 0.94
COLUMNS = 16                # columns scanned between two tests
EPSILON = 2.1               # the test's significance: larger gives up later


def _rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _lists(x: np.ndarray, count: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Centroids of ``x`` by Lloyd's rounds."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), count, replace=False)].copy()
    for _ in range(rounds):
        near = ((centres ** 2).sum(1) - 2 * x @ centres.T).argmin(1)
        size = np.bincount(near, minlength=count)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def probes_for(known: np.ndarray, aim: np.ndarray, near: np.ndarray, centres: np.ndarray, k: int, target: float) -> int:
    """Lists to probe so that ``target`` of the neighbours among ``known`` (their lists: ``near``) are in them.

    Neighbours within a sample are further off than those in the whole table,
    so the whole table's are found at least as well.
    """
    some = np.arange(min(512, len(known)))
    score = known[some] @ known.T
    score[some, some] = -np.inf
    take = min(k, len(known) - 1)
    if take < 1:
        return len(centres)
    best = np.argpartition(score, -take, axis=1)[:, -take:]
    order = ((centres ** 2).sum(1) - 2 * aim[some] @ centres.T).argsort(axis=1).argsort(axis=1)
    place = np.sort(order[some[:, None], near[best]].ravel())
    return int(place[int(np.ceil(target * len(place))) - 1]) + 1


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of rows with an id and a finite, non-zero vector of the commonest length."""
    v = F.col(vector_col).cast("array<double>")
    rows = (vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where("id is not null and v is not null")
            .where(~F.expr("exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))") & F.expr("exists(v, x -> x <> 0)")))
    size = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("v") == (size["size"] if size else 0))


def nearest(vectors: DataFrame, k: int = 20, query_every: int = 20, probes: int | None = None, list_size: int = LIST_SIZE,
            sample: int = SAMPLE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest of every query (id divisible by ``query_every``): query_id, rank, vec_id, score.

    A query has ``k`` rows, or all candidates where they are fewer.
    Candidates are all usable rows but those with the query's own id; ties go
    to the smaller id; the score is the inner product of the original vectors in
    double precision.  Null, zero, non-finite or odd-length vectors and null ids
    take no part; repeated rows are candidates each; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    same = Window.partitionBy("v").orderBy("id")
    counted = rows.groupBy("id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("m"))
    base = store(counted.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n"), "vectors")
    queries = rows.where(F.col("id") % query_every == 0).select(F.col("id").alias("query_id"), "v").distinct()
    classes = store(queries.withColumn("qid", F.xxhash64("v")), "queries")
    facts = base.agg(F.count("*").alias("n"), F.sum("m").alias("rows"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not facts["n"]:
        return spark.createDataFrame([], schema)
    fitted = np.array([r["v"] for r in base.orderBy(F.xxhash64("id"), "id").limit(sample).collect()])
    longest = facts["m"]
    rotation = _rotation(fitted.shape[1] + 1)

    def lifted(x: np.ndarray) -> np.ndarray:
        more = np.sqrt(np.maximum(longest - (x ** 2).sum(1), 0))
        return np.hstack([x, more[:, None]]) @ rotation

    def aimed(x: np.ndarray) -> np.ndarray:
        return np.hstack([x, np.zeros((len(x), 1))]) @ rotation
    count = int(min(max(1, round(facts["n"] / list_size)), max(1, len(fitted) // 8)))
    raised = lifted(fitted)
    centres = _lists(raised, count)
    near = ((centres ** 2).sum(1) - 2 * raised @ centres.T).argmin(1)
    if probes is None:
        probes = probes_for(fitted, aimed(fitted), near, centres, k, TARGET)

    def place(batches):
        for b in batches:
            x = lifted(matrix(b.column("v")))
            near = ((centres ** 2).sum(1) - 2 * x @ centres.T).argmin(1) if len(x) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *b.columns], names=["list", *b.schema.names])

    placed = store(base.select("id", "v", "m").mapInArrow(place, "list int, id bigint, v array<double>, m int"), "placed")
    size = np.zeros(count, np.int64)
    for r in placed.groupBy("list").count().collect():             # at most SAMPLE / 8 lists
        size[r["list"]] = r["count"]
    sent = spark.sparkContext.broadcast((centres, fitted, near, size))

    def probe(batches):
        centres, known, near, size = sent.value
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                x = matrix(part.column("v"))
                order = ((centres ** 2).sum(1) - 2 * aimed(x) @ centres.T).argsort(axis=1)
                # Small lists: further ones, until k + 1 vectors are in them.
                many = np.maximum(probes, 1 + (size[order].cumsum(axis=1) <= k).sum(axis=1))
                use = np.arange(len(centres)) < many[:, None]
                mine = np.zeros(use.shape, bool)
                np.put_along_axis(mine, order, use, axis=1)
                # At least k + 1 vectors of the probed lists score this much.
                score = np.where(mine[:, near], x @ known.T, -np.inf)
                low = np.full(len(x), -np.inf) if len(known) <= k else np.partition(score, -(k + 1), axis=1)[:, -(k + 1)]
                rep = np.nonzero(use)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(order[use].astype(np.int32)), part.column("qid").take(pa.array(rep)),
                     part.column("v").take(pa.array(rep)), pa.array(low[rep])], names=["list", "qid", "v", "low"])
    once = classes.groupBy("v").agg(F.first("qid").alias("qid")).select("qid", "v")
    asked = store(once.mapInArrow(probe, "list int, qid bigint, v array<double>, low double"), "asked")

    def scan(cands: pa.Table, asks: pa.Table) -> pa.Table:
        out_q, out_i, out_m, out_s = [], [], [], []
        if cands.num_rows and asks.num_rows:
            cands = cands.sort_by("id")
            ids, m = cands.column("id").to_numpy(), cands.column("m").to_numpy()
            each = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))        # where each id begins
            x = matrix(cands.column("v").combine_chunks())
            y = lifted(x)
            dim = y.shape[1]
            ask = matrix(asks.column("v").combine_chunks())
            turned = aimed(ask)
            qids = asks.column("qid").to_numpy()
            low = asks.column("low").to_numpy()
            # Scores from ``low`` on are distances up to this.
            reach = (ask ** 2).sum(1) + longest - 2 * low + 1e-9 * (longest + 1)
            for lo in range(0, len(ask), 128):
                q = np.arange(lo, min(lo + 128, len(ask)))
                free, q = q[np.isneginf(low[q])], q[~np.isneginf(low[q])]
                # Without a threshold: all that can be among the k + 1 best ids of these candidates.
                rough = ask[free] @ x.T
                best = np.maximum.reduceat(rough, each, axis=1)
                least = np.partition(best, -(k + 1), axis=1)[:, -(k + 1)] if len(each) > k else np.full(len(free), -np.inf)
                whole = np.nonzero(rough >= (least - 1e-9 * (np.sqrt((ask[free] ** 2).sum(1) * longest) + 1))[:, None])
                t, first = turned[q][:, :COLUMNS], y[:, :COLUMNS]
                part = (t ** 2).sum(1)[:, None] + (first ** 2).sum(1) - 2 * t @ first.T
                a, c = np.nonzero(part * (dim / min(COLUMNS, dim)) <= (reach[q] * (1 + EPSILON / np.sqrt(COLUMNS)) ** 2)[:, None])
                part, a = part[a, c], q[a]
                for at in range(COLUMNS, dim, COLUMNS):
                    hi = min(at + COLUMNS, dim)
                    part = part + ((y[c, at:hi] - turned[a, at:hi]) ** 2).sum(1)
                    slack = 1.0 if hi == dim else (1 + EPSILON / np.sqrt(hi)) ** 2
                    go = part * (dim / hi) <= reach[a] * slack
                    a, c, part = a[go], c[go], part[go]
                a, c = np.concatenate([a, free[whole[0]]]), np.concatenate([c, whole[1]])
                score = (x[c] * ask[a]).sum(axis=1)
                order = np.lexsort((ids[c], -score, a))
                a, c, score = a[order], c[order], score[order]
                # An id shows k rows at most; past k + 1 ids nothing is left to show.
                same = np.lexsort((np.arange(len(a)), ids[c], a))
                key = np.flatnonzero(np.diff(ids[c][same], prepend=0) | np.diff(a[same], prepend=-1))
                nth = np.empty(len(a), np.int64)
                nth[same] = np.arange(len(a)) - np.repeat(key, np.diff(key, append=len(a)))
                seen = np.concatenate([[0], np.cumsum(nth == 0)])
                best = (nth < k) & (seen[1:] - seen[np.searchsorted(a, a)] <= k + 1)
                out_q.append(qids[a[best]])
                out_i.append(ids[c[best]])
                out_m.append(m[c[best]])
                out_s.append(score[best])
        join = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
        return pa.table({"qid": join(out_q, np.int64), "vec_id": join(out_i, np.int64), "m": join(out_m, np.int32), "score": join(out_s, np.float64)})
    order = [F.desc("score"), "vec_id"]

    def meet(asked: DataFrame, name: str) -> DataFrame:
        # Large lists meet their queries in blocks of at most about MEET rows on either side.
        sizes = (placed.groupBy("list").agg(F.ceil(F.count("*") / MEET).cast("int").alias("cs"))
                 .join(asked.groupBy("list").agg(F.ceil(F.count("*") / MEET).cast("int").alias("qs")), "list"))
        left = (placed.join(sizes, "list").withColumn("c", F.pmod(F.xxhash64("id"), F.col("cs")).cast("int"))
                .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1))).select("list", "c", "q", "id", "v", "m"))
        right = (asked.join(sizes, "list").withColumn("q", F.pmod(F.xxhash64("qid"), F.col("qs")).cast("int"))
                 .withColumn("c", F.explode(F.sequence(F.lit(0), F.col("cs") - 1))).select("list", "c", "q", "qid", "v", "low"))
        found = (left.groupBy("list", "c", "q").cogroup(right.groupBy("list", "c", "q"))
                 .applyInArrow(scan, "qid bigint, vec_id bigint, m int, score double"))
        line = Window.partitionBy("qid").orderBy(*order, "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return store(found.withColumn("n", F.row_number().over(Window.partitionBy("qid", "vec_id").orderBy(F.desc("score"))))
                     .where(F.col("n") <= k).withColumn("seen", F.sum((F.col("n") == 1).cast("int")).over(line))
                     .where(F.col("seen") <= k + 1).drop("n", "seen"), name)

    def shown(found: DataFrame) -> DataFrame:
        return classes.select("query_id", "qid").join(found, "qid").where("vec_id <> query_id")
    found = meet(asked, "found")
    # The test gives up a near candidate now and then: queries that lack rows meet all lists, without a threshold.
    own = base.where(F.col("id") % query_every == 0).groupBy(F.col("id").alias("query_id")).agg(F.sum("m").alias("own"))
    lacking = (classes.select("query_id", "qid").join(shown(found).groupBy("query_id", "qid").agg(F.sum("m").alias("has")), ["query_id", "qid"], "left")
               .join(own, "query_id", "left")
               .where(F.coalesce("has", F.lit(0)) < F.least(F.lit(k), F.lit(facts["rows"]) - F.coalesce("own", F.lit(0)))))
    short = store(once.join(lacking.select("qid").distinct(), "qid", "left_semi"), "short")
    if short.head(1):
        every = short.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("low", F.lit(-np.inf))
        again = meet(every.select("list", "qid", "v", "low"), "again")
        found = found.join(short.select("qid"), "qid", "left_anti").unionByName(again)
    return (shown(found).withColumn("one", F.explode(F.sequence(F.lit(1), "m")))
            .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
