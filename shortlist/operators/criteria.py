"""Many rankings at once, with the criteria as a table.

A criteria row is (jd_id, job_description, top_n, min_exp, skills); null top_n,
min_exp and skills mean the defaults.  The plan does not depend on how many
rows there are: criteria stay a relation that documents are joined with.

* Up to ``IN_ROW`` queries: a row's dot products with all of them come from its
  own stored counts, with no shuffle.  Beyond, terms of all job descriptions
  meet the postings in one equi-join on the bucket, and dot products are
  grouped sums by (query, document).
* Each document meets every query once, in blocks of ``BLOCK`` queries, with
  the rules on skills and years as array and number expressions.
* What leaves that join is slim: ids, scores, eligibility.  Thresholds are
  reduced from (query, score) counts, the cut is a group limit before the
  shuffle, and records, reasons and labels are worked out for winners only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shortlist.functions import scoring as sc
from shortlist.functions import text as tx
from shortlist.operators.rank import tie_break
from shortlist.operators.terms import KEY, TermIndex, cosine_of, description_terms
from shortlist.schemas import RECORD_COLUMNS
from shortlist.session import materialize_if_possible

#: Queries that one copy of a document meets.
BLOCK = 256
#: Up to this many queries meet a row's own stored counts in passing; more meet postings by shuffle.
IN_ROW = 4096
#: A criteria table up to this many rows may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000


def criteria_table(spark: SparkSession, criteria: Sequence[sc.Criteria]) -> DataFrame:
    """Criteria objects as a criteria table."""
    rows = [(int(c.jd_id), c.job_description, int(c.top_n), int(c.min_exp), list(c.skills)) for c in criteria]
    return spark.createDataFrame(rows, "jd_id int, job_description string, top_n int, min_exp int, skills array<string>")


def _lower_set(items: Column) -> Column:
    return F.array_distinct(F.transform(items, F.lower))


def parsed(criteria: DataFrame) -> DataFrame:
    """(jd_id, job_description, top_n, min_exp, requested, required, mandatory) with defaults filled in.

    A blank job description fails when the plan runs.
    """
    items = F.coalesce(F.col("skills"), F.array().cast("array<string>"))
    requested, mandatory = tx.parse_skill_input(items)
    blank = F.length(tx.strip_ws(F.coalesce("job_description", F.lit("")))) == 0
    return criteria.select(
        F.col("jd_id"),
        F.when(blank, F.raise_error(F.lit("Job description cannot be empty."))).otherwise(F.col("job_description")).alias("job_description"),
        F.coalesce(F.col("top_n").cast("int"), F.lit(sc.DEFAULT_TOP_N)).alias("top_n"),
        F.coalesce(F.col("min_exp").cast("int"), F.lit(0)).alias("min_exp"),
        requested.alias("requested"), _lower_set(requested).alias("required"), _lower_set(mandatory).alias("mandatory"))


def _checked(queries: DataFrame) -> tuple[int, int]:
    """Number of queries and the largest top_n, from one small aggregate."""
    n, ids, least, most = queries.agg(F.count(F.lit(1)), F.count_distinct("jd_id"), F.min("top_n"), F.max("top_n")).first()
    if not n:
        raise ValueError("at least one query is needed")
    if ids != n:
        raise ValueError("jd_id must be given and unique")
    if least < 0:
        raise ValueError("top_n must be >= 0")
    return n, most


def scored_pairs(index: TermIndex, queries: DataFrame, n_queries: int) -> DataFrame:
    """(jd_id, document key, tie-break columns, Semantic_Score, Final_Score, Eligible) of every pair."""
    in_row = n_queries <= IN_ROW
    terms = description_terms(queries, index.dim).withColumn("w", index.weight_at("bucket"))
    asked = terms.groupBy("jd_id").agg(F.sum(F.col("c") * F.col("c") * F.col("w") * F.col("w")).alias("query_sq"))
    if in_row:
        found: dict[int, dict[int, int]] = {r[0]: {} for r in queries.select("jd_id").collect()}
        for jd, bucket, y in terms.select("jd_id", "bucket", (F.col("c") * F.col("w"))).collect():
            found[jd][bucket] = y
        place = queries.sparkSession.createDataFrame(list(zip(found, range(n_queries))),
                                                     f"jd_id {queries.schema['jd_id'].dataType.simpleString()}, _place int")
        queries = queries.join(F.broadcast(place), "jd_id")
    else:
        queries = queries.withColumn("_place", F.lit(None).cast("int"))
    dots = (index.postings.join(terms.select("jd_id", "bucket", (F.col("c") * F.col("w") * F.col("w")).alias("y")), "bucket")
            .groupBy("jd_id", *KEY).agg(F.sum(F.col("n") * F.col("y")).alias("dot")))
    blocks = -(-n_queries // BLOCK)
    side = queries.join(asked, "jd_id", "left").select(
        F.pmod(F.xxhash64("jd_id"), F.lit(blocks)).cast("int").alias("_block"), "jd_id", "_place", "min_exp", "required", "mandatory", "query_sq")
    if n_queries <= BROADCAST_ROWS:
        side = F.broadcast(side)
    rows = index.rows.drop("_terms")
    ties = tie_break(rows)
    if in_row:
        rows = index.rows.withColumn("_sums", index.sums(list(found.values()))).withColumn("sq", F.col("_sums")[0])
    else:
        rows = rows.join(index.squares(), list(KEY), "left").withColumn("_sums", F.lit(None).cast("array<bigint>"))
    docs = rows.select(
        *ties, "Exp_Years", "sq", "_sums", tx.split_skill_list("Skills_List").alias("cand"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    passes = F.size(F.array_except("mandatory", "cand")) == 0
    wanted = F.size("required")
    share = F.when(wanted == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect("required", "cand")) / wanted.cast("double"))
    pairs = docs.join(side, "_block").select(
        "jd_id", *ties, "sq", "query_sq", F.get("_sums", F.col("_place") + 1).alias("_dot"),
        sc.experience_score("Exp_Years", F.col("min_exp")).alias("exp_score"),
        F.when(passes, share).otherwise(F.lit(0.0)).alias("skill_score"),
        ((F.col("Exp_Years") >= F.col("min_exp")) & passes).alias("Eligible"))
    pairs = pairs.withColumnRenamed("_dot", "dot") if in_row else pairs.drop("_dot").join(dots, ["jd_id", *KEY], "left")
    scored = pairs.withColumn("Semantic_Score", cosine_of(F.coalesce("dot", F.lit(0)), F.col("sq"), F.col("query_sq")))
    return scored.select("jd_id", *ties, "Semantic_Score", "Eligible",
                         sc.final_score("Semantic_Score", "exp_score", "skill_score").alias("Final_Score"))


def rank_table(index: TermIndex, criteria: DataFrame) -> DataFrame:
    """Top rows of every query of a criteria table: (jd_id, rank, the ten record columns).

    Each query's rows are those ``rank_index`` gives for it alone.  jd_id must
    be unique; an empty table, a null jd_id or a negative top_n raises ``ValueError``.
    """
    queries = materialize_if_possible(parsed(criteria), "queries")
    n, most = _checked(queries)
    pairs = materialize_if_possible(scored_pairs(index, queries, n), "pairs")
    counts = pairs.groupBy("jd_id", "Final_Score").agg(F.count(F.lit(1)).alias("n"))
    q = F.percentile("Final_Score", F.array(F.lit(sc.LOW_QUANTILE), F.lit(sc.HIGH_QUANTILE)), F.col("n"))
    cuts = counts.groupBy("jd_id").agg(q.alias("q")).select(
        "jd_id", *[sc.round_half_even(F.col("q")[i], sc.THRESHOLD_DECIMALS).alias(name) for i, name in enumerate(("low", "high"))])
    order = [F.desc("Final_Score"), *[F.asc(c) for c in tie_break(pairs)]]
    best = (pairs.where("Eligible").withColumn("rank", F.row_number().over(Window.partitionBy("jd_id").orderBy(*order)))
            .where(F.col("rank") <= most).select("jd_id", "rank", *KEY, "Semantic_Score", "Final_Score"))
    won = best.join(queries.select("jd_id", "top_n", "requested"), "jd_id").where("rank <= top_n").join(cuts, "jd_id")
    out = won.join(index.rows.drop("_terms"), list(KEY)).withColumn(
        "Reason", sc.reason("Semantic_Score", "Exp_Years", "Skills_List", F.col("requested"))).withColumn(
        "Label", sc.label("Final_Score", F.col("low"), F.col("high")))
    return out.select("jd_id", "rank", *RECORD_COLUMNS)
