"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator.

Every query reads the driver tables (or data Spark derives from them) in
full.  ``oracle.py`` holds the equivalent DuckDB SQL under the same names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.functions import text as tx
from shortlist.functions.scoring import Criteria
from shortlist.functions.vectors import l2_normalize
from shortlist.operators import metrics as mt
from shortlist.operators import rank as rk
from shortlist.operators.embed import cache_misses, embed_hashed
from shortlist.operators.extract import extract_numbered, extract_resumes, resumes_from_table, spread
from shortlist.operators.ordinal import ordinal_within
from shortlist.operators.terms import open_index, transient_index, write_batch
from shortlist.operators.criteria import rank_table
from shortlist.operators.vocabulary import skills_by_vocabulary, vocabulary_matches
from shortlist.plans import fixtures as fx
from shortlist.schemas import RECORD_COLUMNS
from shortlist.session import materialize_if_possible, new_path
from shortlist.sources.extractors import html_to_text

# The UI defaults of the reference: top 5, at least 2 years, python mandatory.
CRITERIA = Criteria(job_description="AI Engineer with Machine Learning and NLP experience",
                    top_n=5, min_exp=2, skills=("!python", "machine learning", "sql"))
# A second criteria, with another job description.
RERANK_CRITERIA = Criteria(job_description="Data engineer", top_n=10, min_exp=5,
                           skills=("!SQL", "Spark", "kafka", "python"), jd_id=1)
# Several queries at once: (criteria, id of the stored vector that stands for it where vectors are given).
MANY_QUERIES = (
    (Criteria("AI Engineer with Machine Learning and NLP experience", top_n=5, min_exp=2,
              skills=("!python", "machine learning", "sql"), jd_id=0), 0),
    (Criteria("Systems programmer: Rust, C++ and Linux", top_n=3, min_exp=0, skills=("rust", "c++"), jd_id=1), 1),
    (Criteria("Database administrator with SQL", top_n=8, min_exp=4, skills=("!sql",), jd_id=2), 2),
)
QUALITY_LABELS = (1, 0)
HTML_EXTENSIONS = (".html",)
QUERY_VECTOR_ID = 0


Query = Callable[[SparkSession, str], DataFrame]


def resumes(spark: SparkSession, sf: str) -> DataFrame:
    return resumes_from_table(fx.resumes_raw(spark, sf), keep=("doc_id",))


def semantic(spark: SparkSession, sf: str, vec_id: int = QUERY_VECTOR_ID) -> DataFrame:
    q = fx.query_vector(spark, sf, vec_id)
    return rk.semantic_scores(fx.embeddings(spark, sf), q, key="vec_id", out_key="doc_id")


def scored(spark: SparkSession, sf: str, criteria: Criteria = CRITERIA) -> DataFrame:
    """The scored table, written once under the checkpoint folder when there is one."""
    return materialize_if_possible(rk.score_documents(resumes(spark, sf), criteria), "scored")


def labelled(spark: SparkSession, sf: str, criteria: Criteria = CRITERIA) -> DataFrame:
    return rk.with_labels(scored(spark, sf, criteria))


def ranking(spark: SparkSession, sf: str, criteria: Criteria = CRITERIA) -> rk.RankingResult:
    """By the job description, over every document."""
    return rk.rank_documents(resumes(spark, sf), criteria)


def stored_ranking(spark: SparkSession, sf: str, criteria: Criteria = CRITERIA) -> rk.RankingResult:
    """By stored vectors, over the documents that have one."""
    return rk.rank(resumes(spark, sf), semantic(spark, sf), criteria, on="doc_id")


# --- extraction -------------------------------------------------------------

def q_extract_email(spark, sf):
    return fx.documents(spark, sf).select("doc_id", tx.extract_email("text").alias("Email"))


def q_extract_phone(spark, sf):
    return fx.documents(spark, sf).select("doc_id", tx.extract_phone("text").alias("Phone"))


def q_clean_text(spark, sf):
    return fx.documents(spark, sf).select("doc_id", tx.clean_text("text").alias("Resume_Text"))


def q_min_length_filter(spark, sf):
    docs = fx.documents(spark, sf)
    return docs.where(tx.long_enough("text")).select(
        "doc_id", tx.stripped_length("text").alias("stripped_chars"))


def q_extract_experience(spark, sf):
    return fx.resumes_raw(spark, sf).select("doc_id", tx.extract_experience("raw_text").alias("Exp_Years"))


def q_extract_skills(spark, sf):
    return fx.resumes_raw(spark, sf).select(
        "doc_id", tx.skills_joined("raw_text").alias("Skills_List"))


def q_skills_theta_join(spark, sf):
    """Every (document, vocabulary entry) with the entry in the text, the vocabulary as a table."""
    entries = spark.createDataFrame([(s,) for s in tx.SKILLS_VOCAB], "skill string")
    long = fx.resumes_raw(spark, sf).where(tx.long_enough("raw_text"))
    return vocabulary_matches(spread(long), entries, ["doc_id"])


def q_skills_vocabulary_table(spark, sf):
    """The same for a vocabulary taken from a given table."""
    found = skills_by_vocabulary(spread(fx.documents(spark, sf).select("doc_id", "text")), fx.vocabulary(spark, sf), ["doc_id"], "text")
    return found.select("doc_id", F.size("skills").cast("bigint").alias("n_skills"), "Skills_List")


def q_extract_fields(spark, sf):
    return resumes(spark, sf)


def q_resume_table(spark, sf):
    raw = fx.resumes_raw(spark, sf).withColumnRenamed("source", "archive")
    raw = raw.withColumn("name", F.concat_ws("/", F.col("archive"),
                                             F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    return extract_numbered(raw, "archive", "doc_id", keep=("archive",))


def q_entry_filter(spark, sf):
    pages = fx.table(spark, sf, "pages")
    return pages.where(tx.entry_selected("url", HTML_EXTENSIONS)).select("page_id", "url")


def q_entry_ordinal(spark, sf):
    docs = fx.documents(spark, sf).select("doc_id", "source")
    numbered = ordinal_within(docs, "source", "doc_id", name="idx")
    return numbered.select("source", "doc_id", "idx", tx.resume_id("idx").alias("Resume_ID"))


def q_html_text(spark, sf):
    # Regex stripping is CPU-bound: spread an under-split scan over the cores first.
    pages = spread(fx.table(spark, sf, "pages").select("page_id", "html"))
    return pages.select("page_id", html_to_text("html").alias("text"))


def q_parse_skills(spark, sf):
    # Every other document's first skill is marked as mandatory.
    mark = F.when(F.col("doc_id") % 2 == 0, "!").otherwise("")
    line = F.concat(mark, F.regexp_extract("raw_text", r"Skills: ([^\n]*)", 1))
    items = tx.parse_skill_text(line)
    required, mandatory = tx.parse_skill_input(items)
    return fx.resumes_raw(spark, sf).select(
        "doc_id",
        F.array_join(required, "|").alias("required"),
        F.array_join(mandatory, "|").alias("mandatory"),
        F.size(required).alias("n_required"))


# --- scoring ----------------------------------------------------------------

def q_experience_score(spark, sf):
    from shortlist.functions.scoring import experience_score
    return resumes(spark, sf).select(
        "doc_id", "Exp_Years", experience_score("Exp_Years", CRITERIA.min_exp).alias("Exp_Score"))


def q_skills_score(spark, sf):
    from shortlist.functions.scoring import passes_mandatory, skills_score
    cand = tx.split_skill_list("Skills_List")
    return resumes(spark, sf).select(
        "doc_id",
        skills_score(cand, CRITERIA.required, CRITERIA.mandatory).alias("Skill_Score"),
        passes_mandatory(cand, CRITERIA.mandatory).alias("Passes_Mandatory"))


def q_mandatory_filter(spark, sf):
    from shortlist.functions.scoring import passes_mandatory
    res = resumes(spark, sf)
    return res.where(passes_mandatory(tx.split_skill_list("Skills_List"), CRITERIA.mandatory)) \
              .select("doc_id", "Resume_ID")


def q_eligibility(spark, sf):
    return scored(spark, sf).select("doc_id", "Exp_Years", "Passes_Mandatory", "Eligible")


def q_final_score(spark, sf):
    return scored(spark, sf).select("doc_id", "Semantic_Score", "Exp_Score", "Skill_Score", "Final_Score")


def q_semantic_scores(spark, sf):
    q = fx.query_vector(spark, sf, QUERY_VECTOR_ID)
    return rk.semantic_scores(fx.embeddings(spark, sf), q)


def q_l2_normalize(spark, sf):
    return fx.embeddings(spark, sf).select("vec_id", l2_normalize("embedding").alias("unit"))


# --- ranking ----------------------------------------------------------------

def q_score_thresholds(spark, sf):
    return rk.thresholds(scored(spark, sf))


def q_score_labels(spark, sf):
    return labelled(spark, sf).select("doc_id", "Final_Score", "Label")


def q_reasons(spark, sf):
    return scored(spark, sf).select("doc_id", "Reason")


def q_eligible_split(spark, sf):
    return labelled(spark, sf).where("Eligible").select("doc_id", "Resume_ID", "Final_Score")


def q_not_eligible_split(spark, sf):
    return labelled(spark, sf).where("NOT Eligible").select("doc_id", "Resume_ID", "Final_Score")


def q_ranked_records(spark, sf):
    """Every record with its place in presentation order."""
    return rk.with_rank_position(labelled(spark, sf)).select("pos", *RECORD_COLUMNS)


def q_top_candidates(spark, sf):
    return ranking(spark, sf).top_records()


def q_others_pool(spark, sf):
    """What is left after the top, with places in presentation order."""
    return rk.with_rank_position(ranking(spark, sf).others).select("pos", *RECORD_COLUMNS)


def q_candidate_cards(spark, sf):
    cards = rk.candidate_cards(ranking(spark, sf).top)
    return cards.withColumn("skills", F.array_join("skills", ", "))


def q_summary(spark, sf):
    return ranking(spark, sf).summary


def q_display_text(spark, sf):
    """Scores as percentages and snake-case names as titles."""
    from shortlist.functions.scoring import percent_text, title_text
    return labelled(spark, sf).select(
        "doc_id", percent_text("Semantic_Score").alias("percent"),
        title_text(F.concat(F.lower("Label"), F.lit("_match"))).alias("title"))


def q_row_counters(spark, sf):
    """How many documents came in, passed the length gate and were ranked, gathered by the jobs themselves."""
    from pyspark.sql import Observation
    members, ranked = Observation("members"), Observation("ranked")
    raw = fx.resumes_raw(spark, sf).select(F.col("doc_id").alias("idx"), F.col("source").alias("name"), "raw_text", F.lit("a").alias("archive"))
    rk.rank_documents(extract_resumes(raw, observation=members), CRITERIA, observation=ranked)
    return spark.createDataFrame([(members.get["members"], members.get["extracted"], ranked.get["ranked_rows"])],
                                 "members bigint, extracted bigint, ranked_rows bigint")


def q_rank_candidates(spark, sf):
    """The whole ranking response flattened into one row."""
    result = ranking(spark, sf)
    resp = result.response()
    return resp.select(
        "summary.total", "summary.eligible", "summary.returned_top",
        "thresholds.low", "thresholds.high",
        "metrics.accuracy", "metrics.macro_precision", "metrics.macro_recall", "metrics.macro_f1",
        F.array_join(F.transform("top_candidates", lambda r: r["Resume_ID"]), ",").alias("top_ids"))


def stored_index(spark: SparkSession, sf: str, batches: int = 2):
    """A term index of the documents, written in batches under the checkpoint folder and opened again."""
    path = new_path(spark, "index")
    res = resumes(spark, sf)
    for b in range(batches):
        write_batch(res.where(F.col("doc_id") % batches == b), path, b)
    return open_index(spark, path)


def q_rerank(spark, sf):
    """Another job description over a stored index: the ranking reads no text."""
    return rk.rank_index(stored_index(spark, sf), RERANK_CRITERIA).top_records()


def q_rank_stored_vectors(spark, sf):
    """Re-ranking on vectors stored beforehand: only documents with one take part."""
    return rk.records(stored_ranking(spark, sf).scored)


def q_topn_per_query(spark, sf):
    return rk.rank_many_documents(resumes(spark, sf), [crit for crit, _ in MANY_QUERIES])


def q_topn_criteria_table(spark, sf):
    """Top rows of every query of a criteria table taken from a given table."""
    return rank_table(transient_index(resumes(spark, sf)), fx.criteria(spark, sf))


def q_topn_stored_vectors(spark, sf):
    queries = [(crit, fx.query_vector(spark, sf, vid)) for crit, vid in MANY_QUERIES]
    return rk.rank_many(resumes(spark, sf), fx.embeddings(spark, sf), queries)


# --- distributions and metrics ----------------------------------------------

def q_score_histogram(spark, sf):
    return mt.score_histogram(scored(spark, sf))


def q_experience_histogram(spark, sf):
    return mt.experience_histogram(scored(spark, sf))


def q_score_density(spark, sf):
    return mt.score_density(scored(spark, sf))


def q_confusion_matrix(spark, sf):
    return mt.confusion_matrix(labelled(spark, sf), "Label", "Label")


def q_per_class_metrics(spark, sf):
    return mt.per_class_metrics(labelled(spark, sf), "Label", "Label")


def q_ranking_metrics(spark, sf):
    return mt.ranking_metrics(labelled(spark, sf))


def _quality(spark, sf) -> DataFrame:
    lab = fx.table(spark, sf, "labels")
    return lab.select("doc_id", F.col("quality").alias("actual"), (1 - F.col("toxic")).alias("predicted"))


def q_quality_confusion_matrix(spark, sf):
    return mt.confusion_matrix(_quality(spark, sf), "actual", "predicted", QUALITY_LABELS)


def q_quality_class_metrics(spark, sf):
    return mt.per_class_metrics(_quality(spark, sf), "actual", "predicted", QUALITY_LABELS)


def q_quality_metrics(spark, sf):
    return mt.classification_metrics(_quality(spark, sf), "actual", "predicted", QUALITY_LABELS)


# --- embeddings -------------------------------------------------------------

def q_embedding_cache_misses(spark, sf):
    """Documents whose cleaned text has no stored vector yet.

    The cache is what the vector table already covers: the cleaned text of
    every document that has a vector, keyed by its SHA-256.  Exact copies of
    a cached text are hits even under another id.
    """
    from shortlist.operators.embed import text_hash
    # (doc_id, text_hash) is written once: both sides of the anti-join read it.
    hashed = materialize_if_possible(
        resumes(spark, sf).select("doc_id", text_hash("Resume_Text").alias("text_hash")), "hashes")
    covered = hashed.join(fx.embeddings(spark, sf).select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    return cache_misses(hashed, covered, text_col="text_hash", key="doc_id",
                        cache_hash_col="text_hash", hashed=True)


def q_embed_documents(spark, sf):
    res = resumes(spark, sf).select("doc_id", "Resume_Text")
    return embed_hashed(res, "Resume_Text").select("doc_id", "embedding")


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items())
    if name.startswith("q_") and callable(fn)
}
