"""Rank documents against job criteria.

Plan shape for one query (all lazy):

* ``score_documents``: every document's text becomes sparse term counts in the
  extraction pass (``terms.TermIndex``); dot products and norms are whole-number
  sums over postings, grouped by document.  ``rank_index`` ranks a stored index
  again and reads no text.
* ``semantic_scores``, for vectors stored elsewhere: a narrow projection over the vector table (one DOUBLE
  per row leaves it, never the vector).
* ``score``: resumes ⋈ semantic scores on the document key (a shuffle join
  of two corpus-size tables; AQE broadcasts a side only when it is small at
  run time), then one projection with every rule.
* ``thresholds``: exact quantiles.  Scores are rounded to 4 decimals before
  they are ranked, so ``groupBy(Final_Score)`` has at most ~15.5k rows at any
  corpus size; the percentile runs over that bounded table.
* labels compare every row with the thresholds through a scalar subquery
  (computed once, inlined as a constant) — no join, no cross product.
* ``top``: ``orderBy(...).limit(n)`` → ``TakeOrderedAndProject`` (per-task
  heaps of n rows, no corpus sort).  ``others`` is a plain filter against the
  sort key of the n-th top row (another scalar subquery), so splitting needs
  no join and no global window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortlist.functions import scoring as sc
from shortlist.functions import text as tx
from shortlist.functions.vectors import cosine_to
from shortlist.operators.embed import DEFAULT_DIM, check_description
from shortlist.operators.ordinal import with_position
from shortlist.operators.terms import KEY, TermIndex, transient_index
from shortlist.schemas import RECORD_COLUMNS

TIE_BREAK = ("Resume_ID", "Source_File")
#: Columns that tell rows with the same Resume_ID and Source_File apart, where present.
#: The last ones number stored rows, so that repeated rows differ too.
ROW_KEYS = ("archive", "doc_id", "idx", *KEY, "_row")


def semantic_scores(vectors: DataFrame, query: Sequence[float], key: str | Sequence[str] = "vec_id",
                    vector_col: str = "embedding", out_key: str | None = None) -> DataFrame:
    """(key, Semantic_Score): cosine of each stored vector with the query vector.

    ``key`` may name several columns, such as (archive, Resume_ID).
    """
    keys = [F.col(key).alias(out_key or key)] if isinstance(key, str) else [F.col(k) for k in key]
    return vectors.select(*keys,
                          cosine_to(vector_col, query).alias("Semantic_Score"))


def score_columns(criteria: sc.Criteria, semantic: str = "Semantic_Score") -> dict[str, Column]:
    """Every per-row rule for one criteria, in dependency order."""
    cand = tx.split_skill_list("Skills_List")
    exp_score = sc.experience_score("Exp_Years", criteria.min_exp)
    skill_score = sc.skills_score(cand, criteria.required, criteria.mandatory)
    passes = sc.passes_mandatory(cand, criteria.mandatory)
    return {
        "Exp_Score": exp_score,
        "Skill_Score": skill_score,
        "Passes_Mandatory": passes,
        "Final_Score": sc.final_score(semantic, exp_score, skill_score),
        "Eligible": (F.col("Exp_Years") >= F.lit(int(criteria.min_exp))) & passes,
        "Reason": sc.reason(semantic, "Exp_Years", "Skills_List", criteria.required),
    }


def score(resumes: DataFrame, semantic: DataFrame | None, criteria: sc.Criteria,
          on: str | Sequence[str] = "doc_id") -> DataFrame:
    """Resumes with semantic, experience and skill scores, final score, eligibility, reason.

    Without ``semantic``, ``resumes`` carries Semantic_Score itself.  The
    cleaned text is dropped before the join: only scalar fields move through
    the shuffle.
    """
    keys = [on] if isinstance(on, str) else list(on)
    slim = resumes.drop("Resume_Text")
    joined = slim if semantic is None else slim.join(semantic, keys)
    cols = score_columns(criteria)
    return joined.select("*", *[expr.alias(name) for name, expr in cols.items()])


def with_semantic(resumes: DataFrame, descriptions: Sequence[str], names: Sequence[str],
                  dim: int = DEFAULT_DIM) -> DataFrame:
    """Resumes (text dropped) with one column per job description: its cosine with the text.

    The encoder is fitted on all the texts given.  A blank description raises
    ``ValueError`` before any job runs; a text without tokens scores 0.
    """
    for text in descriptions:
        check_description(text)
    return transient_index(resumes, "Resume_Text", dim).semantic(descriptions, names)


def score_documents(resumes: DataFrame, criteria: sc.Criteria, dim: int = DEFAULT_DIM) -> DataFrame:
    """``score`` with the semantic score of every text against the criteria's job description."""
    return score(with_semantic(resumes, [criteria.job_description], ["Semantic_Score"], dim), None, criteria)


def rank_documents(resumes: DataFrame, criteria: sc.Criteria, dim: int = DEFAULT_DIM, **options) -> RankingResult:
    """``rank`` by the job description, over every row of ``resumes`` (with Resume_Text)."""
    return rank(with_semantic(resumes, [criteria.job_description], ["Semantic_Score"], dim), None, criteria, **options)


def rank_index(index: TermIndex, criteria: sc.Criteria, **options) -> RankingResult:
    """``rank`` by the job description over a stored index: no text is read."""
    return rank(index.semantic([criteria.job_description], ["Semantic_Score"]), None, criteria, **options)


def score_counts(scored: DataFrame) -> DataFrame:
    """(Final_Score, n): bounded by the number of distinct 4-decimal scores."""
    return scored.groupBy("Final_Score").agg(F.count(F.lit(1)).alias("n"))


def thresholds(scored: DataFrame, low_q: float = sc.LOW_QUANTILE,
               high_q: float = sc.HIGH_QUANTILE) -> DataFrame:
    """One row (low, high): exact linear-interpolated quantiles of Final_Score over
    all rows (eligible or not), rounded to 6 decimals."""
    return thresholds_of(score_counts(scored), low_q, high_q)


def thresholds_of(counts: DataFrame, low_q: float = sc.LOW_QUANTILE, high_q: float = sc.HIGH_QUANTILE) -> DataFrame:
    """``thresholds`` from (Final_Score, n) pairs; a score's pairs may be spread over several rows."""
    q = F.percentile("Final_Score", F.array(F.lit(low_q), F.lit(high_q)), F.col("n"))
    return counts.agg(q.alias("q")).select(
        sc.round_half_even(F.col("q")[0], sc.THRESHOLD_DECIMALS).alias("low"),
        sc.round_half_even(F.col("q")[1], sc.THRESHOLD_DECIMALS).alias("high"))


def with_labels(scored: DataFrame, thr: DataFrame | None = None) -> DataFrame:
    """Add ``Label`` by comparing each score with the thresholds (scalar subqueries)."""
    thr = thresholds(scored) if thr is None else thr
    both = thr.select(F.struct("low", "high")).scalar()  # one subquery for both values
    return scored.withColumn("Label", sc.label("Final_Score", both["low"], both["high"]))


def tie_break(df: DataFrame) -> list[str]:
    """Columns that order equal scores: the displayed ids, then whatever keys the rows carry."""
    return [*TIE_BREAK, *[c for c in ROW_KEYS if c in df.columns]]


def sort_key(df: DataFrame) -> Column:
    """Ascending struct key equal to the ranking order: score desc, then ids asc."""
    return F.struct((-F.col("Final_Score")).alias("neg_score"),
                    *[F.col(c).alias(c) for c in tie_break(df)])


def ranking_order(df: DataFrame) -> list[Column]:
    return [F.desc("Final_Score"), *[F.asc(c) for c in tie_break(df)]]


def top_candidates(labelled: DataFrame, top_n: int) -> DataFrame:
    """The ``top_n`` best eligible rows (TakeOrderedAndProject)."""
    return labelled.where("Eligible").orderBy(*ranking_order(labelled)).limit(int(top_n))


def in_top(labelled: DataFrame, top_n: int) -> Column:
    """True for the rows ``top_candidates`` returns, without a join."""
    if top_n <= 0:
        return F.lit(False)
    cut = top_candidates(labelled, top_n).select(F.max(sort_key(labelled))).scalar()
    return F.coalesce(F.col("Eligible") & (sort_key(labelled) <= cut), F.lit(False))


def others(labelled: DataFrame, top_n: int) -> DataFrame:
    """Everything not in the top: remaining eligible rows, then ineligible ones."""
    return labelled.where(~in_top(labelled, top_n))


def others_ordered(labelled: DataFrame, top_n: int) -> DataFrame:
    """``others`` in presentation order (a range-partitioned global sort)."""
    return others(labelled, top_n).orderBy(F.desc("Eligible"), *ranking_order(labelled))


def with_rank_position(labelled: DataFrame, name: str = "pos") -> DataFrame:
    """Add each row's place (from 1) in presentation order: eligible rows first, best score first.

    Where stored rows carry their number, only scores, ids and numbers are
    sorted and stored; the wide rows meet their place in a join.
    """
    order = [F.desc("Eligible"), *ranking_order(labelled)]
    number = ["_row"] if "_row" in labelled.columns else list(KEY) if set(KEY) <= set(labelled.columns) else []
    if not number:
        return with_position(labelled, *order, name=name)
    slim = labelled.select("Eligible", "Final_Score", *tie_break(labelled))
    return labelled.join(with_position(slim, *order, name=name).select(*number, name), number)


def records(df: DataFrame) -> DataFrame:
    """The ten output columns, in their fixed order."""
    return df.select(*RECORD_COLUMNS)


def reduction(scored: DataFrame) -> DataFrame:
    """(Final_Score, Eligible, n): all that thresholds, summary and metrics need of the scored table."""
    return scored.groupBy("Final_Score", "Eligible").agg(F.count(F.lit(1)).alias("n"))


def summary(labelled: DataFrame, top_n: int) -> DataFrame:
    """One row (total, eligible, returned_top) from a single aggregate."""
    return summary_of(reduction(labelled), top_n)


def summary_of(counts: DataFrame, top_n: int) -> DataFrame:
    """``summary`` from the ``reduction``."""
    agg = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
                     F.coalesce(F.sum(F.when(F.col("Eligible"), F.col("n"))), F.lit(0)).alias("eligible"))
    return agg.select("total", "eligible",
                      F.least(F.lit(int(top_n)).cast("long"), F.col("eligible")).alias("returned_top"))


def candidate_cards(top: DataFrame, max_skills: int = 6) -> DataFrame:
    """Display projection of the (at most n) top rows: rank, first skills, score text.

    The rank comes from one sorted ``collect_list`` over the top rows (at most
    n of them) and ``posexplode`` — no window, no corpus-wide ordering.
    """
    card = F.struct(
        sort_key(top).alias("k"),
        F.col("Resume_ID"), F.col("Source_File"), F.col("Email"), F.col("Phone"), F.col("Exp_Years"),
        F.slice(tx.split_skill_list("Skills_List"), 1, max_skills).alias("skills"),
        # Round half-even to 3 places first so every formatter prints the same digits.
        F.format_string("%.3f", sc.round_half_even(F.col("Final_Score"), 3)).alias("score"),
        F.col("Reason"))
    ordered = top.agg(F.sort_array(F.collect_list(card)).alias("cards"))
    exploded = ordered.select(F.posexplode("cards").alias("pos", "c"))
    return exploded.select(
        (F.col("pos") + 1).cast("int").alias("rank"),
        *[F.col(f"c.{f}").alias(f) for f in ("Resume_ID", "Source_File", "Email", "Phone", "Exp_Years",
                                             "skills", "score", "Reason")])


@dataclass
class RankingResult:
    """Lazy outputs of one ranking.  ``others`` is corpus-size: keep it a DataFrame."""

    scored: DataFrame
    thresholds: DataFrame
    top: DataFrame
    others: DataFrame
    summary: DataFrame
    criteria: sc.Criteria
    counts: DataFrame

    def top_records(self) -> DataFrame:
        return records(self.top)

    def other_records(self) -> DataFrame:
        return records(self.others.orderBy(F.desc("Eligible"), *ranking_order(self.others)))

    def metrics(self) -> DataFrame:
        from shortlist.operators.metrics import ranking_metrics
        return ranking_metrics(with_labels(self.counts, self.thresholds), "Label", "Label", weight="n")

    def response(self) -> DataFrame:
        """One-row nested response: summary, thresholds, metrics and the top records."""
        top = self.top.agg(F.sort_array(F.collect_list(F.struct(
            sort_key(self.top).alias("k"), F.struct(*RECORD_COLUMNS).alias("r")))).alias("t"))
        top = top.select(F.transform("t", lambda x: x["r"]).alias("top_candidates"))
        parts = [self.summary.select(F.struct("*").alias("summary")),
                 self.thresholds.select(F.struct("*").alias("thresholds")),
                 self.metrics().select(F.struct("*").alias("metrics")),
                 top]
        out = parts[0]
        for p in parts[1:]:
            out = _one_row_zip(out, p)
        return out

    def response_json(self) -> DataFrame:
        """``response`` as one JSON document (column ``json``)."""
        return self.response().select(F.to_json(F.struct("*")).alias("json"))


def _one_row_zip(left: DataFrame, right: DataFrame) -> DataFrame:
    """Combine two one-row frames side by side (scalar subquery, no join)."""
    col = right.columns[0]
    return left.withColumn(col, right.select(col).scalar())


def rank(resumes: DataFrame, semantic: DataFrame | None, criteria: sc.Criteria,
         on: str | Sequence[str] = "doc_id", materialize: bool | None = None,
         require_rows: bool = False, observation=None) -> RankingResult:
    """Score, label and split resumes for one criteria.

    The scored table (no text, no vectors) is read by every output —
    thresholds, labels, top, others, summary, metrics.  By default it is
    written once under the session's checkpoint folder and read back (or
    persisted when there is none), so extraction and the join run once and
    later filters cannot be pushed back into the extraction projection.
    ``materialize=False`` keeps one lazy plan.  Stored rows are numbered, so the
    top and the others hold every row once even where rows repeat; a lazy plan
    tells repeated rows apart by the ``ROW_KEYS`` they carry only.

    ``require_rows=True`` raises ``ValueError`` for an empty input (one extra,
    short-circuiting job).  ``observation`` (a ``pyspark.sql.Observation``)
    collects the number of ranked rows as a side effect of the first job.
    """
    from shortlist.session import materialize_if_possible
    scored = score(resumes, semantic, criteria, on)
    if observation is not None:
        scored = scored.observe(observation, F.count(F.lit(1)).alias("ranked_rows"))
    if materialize or materialize is None:
        if "_doc" not in scored.columns:
            scored = scored.withColumn("_row", F.monotonically_increasing_id())
        scored = materialize_if_possible(scored, "scored")
    if require_rows and scored.isEmpty():
        raise ValueError("Input DataFrame is empty.")
    # At most some 30,000 rows whatever the corpus: read by every summary instead of the scored table.
    counts = reduction(scored)
    if materialize or materialize is None:
        counts = materialize_if_possible(counts, "counts")
    thr = thresholds_of(counts)
    labelled = with_labels(scored, thr)
    top = top_candidates(labelled, criteria.top_n)
    rest = others(labelled, criteria.top_n)
    return RankingResult(scored=labelled, thresholds=thr, top=top, others=rest,
                         summary=summary_of(counts, criteria.top_n), criteria=criteria, counts=counts)


def semantic_scores_many(vectors: DataFrame, queries: Sequence[Sequence[float]],
                         key: str = "vec_id", vector_col: str = "embedding",
                         out_key: str | None = None) -> DataFrame:
    """(key, sem_0 .. sem_{k-1}): one narrow pass over the vectors for k queries.

    Every query is a constant array, of any dimension; a vector of another
    dimension fails loudly, for one query as for many.
    """
    cols = [cosine_to(vector_col, q).alias(f"sem_{i}") for i, q in enumerate(queries)]
    return vectors.select(F.col(key).alias(out_key or key), *cols)


def rank_many(resumes: DataFrame, vectors: DataFrame,
              queries: Sequence[tuple[sc.Criteria, Sequence[float]]],
              key: str = "vec_id", on: str = "doc_id") -> DataFrame:
    """Top-n per query for several criteria at once.

    One join of resumes with k semantic-score columns, stored with one row per
    document.  The per-query cut is ``row_number() <= n`` partitioned by
    query, which Spark executes as a ``WindowGroupLimit`` before the shuffle,
    so each query's partition holds at most n rows per input task.

    Returns (jd_id, rank, the ten record columns).
    """
    if not queries:
        raise ValueError("at least one query is needed")
    sem = semantic_scores_many(vectors, [q for _, q in queries], key=key, out_key=on)
    return _rank_joined(resumes.drop("Resume_Text").join(sem, on), [c for c, _ in queries])


def rank_many_documents(resumes: DataFrame, criteria: Sequence[sc.Criteria], dim: int = DEFAULT_DIM) -> DataFrame:
    """``rank_many`` by the criteria's job descriptions, over every row of ``resumes`` (``criteria.rank_table``)."""
    from shortlist.operators.criteria import criteria_table, rank_table
    if not criteria:
        raise ValueError("at least one query is needed")
    for c in criteria:
        check_description(c.job_description)
    return rank_table(transient_index(resumes, "Resume_Text", dim), criteria_table(resumes.sparkSession, criteria))


def _rank_joined(joined: DataFrame, criteria: Sequence[sc.Criteria]) -> DataFrame:
    """The rows of ``rank_many`` from resumes with columns sem_0, sem_1, ...

    One row per document is stored, with a semantic score per query.  Rows per
    (query, document) exist only between a scan and the next partial
    aggregate or group limit; reasons and labels are worked out for winners.
    """
    from shortlist.session import materialize_if_possible
    base_cols = [c for c in joined.columns if not c.startswith("sem_")]
    joined = materialize_if_possible(joined, "scored_many")
    rules = [score_columns(crit, semantic=f"sem_{i}") for i, crit in enumerate(criteria)]
    ids = [F.lit(int(crit.jd_id)).alias("jd_id") for crit in criteria]

    scores = joined.select(F.inline(F.array(*[
        F.struct(jd, r["Final_Score"].alias("Final_Score")) for jd, r in zip(ids, rules)])))
    counts = scores.groupBy("jd_id", "Final_Score").agg(F.count(F.lit(1)).alias("n"))
    q = F.percentile("Final_Score", F.array(F.lit(sc.LOW_QUANTILE), F.lit(sc.HIGH_QUANTILE)), F.col("n"))
    thr = counts.groupBy("jd_id").agg(q.alias("q")).select(
        "jd_id",
        sc.round_half_even(F.col("q")[0], sc.THRESHOLD_DECIMALS).alias("low"),
        sc.round_half_even(F.col("q")[1], sc.THRESHOLD_DECIMALS).alias("high"))

    exploded = joined.select(*base_cols, F.inline(F.array(*[
        F.struct(jd, F.lit(int(crit.top_n)).alias("top_n"), F.lit(i).alias("_query"),
                 F.col(f"sem_{i}").alias("Semantic_Score"), r["Final_Score"].alias("Final_Score"),
                 r["Eligible"].alias("Eligible"))
        for i, (crit, jd, r) in enumerate(zip(criteria, ids, rules))])))
    max_n = max(int(c.top_n) for c in criteria)
    w = Window.partitionBy("jd_id").orderBy(*ranking_order(exploded))
    ranked = exploded.where("Eligible").withColumn("rank", F.row_number().over(w))
    top = ranked.where((F.col("rank") <= max_n) & (F.col("rank") <= F.col("top_n")))
    reasons = [F.when(F.col("_query") == i, score_columns(crit)["Reason"]) for i, crit in enumerate(criteria)]
    # At most len(criteria) rows: a proven bound, so broadcasting is safe.
    top = (top.join(F.broadcast(thr), "jd_id").withColumn("Reason", F.coalesce(*reasons))
           .withColumn("Label", sc.label("Final_Score", F.col("low"), F.col("high"))))
    return top.select("jd_id", "rank", *RECORD_COLUMNS)

