"""Inputs derived from the driver tables.

``documents`` has almost no experience phrases and vocabulary skills, so the
checks append a deterministic contact/experience/skills trailer to every
document.  The expression is plain SQL that Spark and DuckDB evaluate to the
same text, so the Spark side and the DuckDB oracle share it verbatim.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_TEXT_SQL = """text || chr(10) || 'Contact: User' || CAST(doc_id AS STRING) || '@Example.com | +1 (415) 555-'
  || lpad(CAST(doc_id % 10000 AS STRING), 4, '0')
  || CASE WHEN doc_id % 4 = 0 THEN chr(10) ELSE ' | ' END
  || CAST(doc_id % 14 AS STRING)
  || CASE doc_id % 3 WHEN 0 THEN ' years of experience' WHEN 1 THEN '+ yrs' ELSE ' Years Experience' END
  || chr(10) || 'Skills: '
  || CASE doc_id % 6 WHEN 0 THEN 'Python, SQL, Machine Learning'
                     WHEN 1 THEN 'JavaScript, React, Node.js'
                     WHEN 2 THEN 'Python, Spark, Kafka, NoSQL'
                     WHEN 3 THEN 'C++, Rust, Linux'
                     WHEN 4 THEN 'python, machine' || chr(10) || 'learning'
                     ELSE 'excellent communicator, digital' END"""

RESUMES_RAW_SQL = f"SELECT doc_id, source, {RAW_TEXT_SQL} AS raw_text FROM documents"

# Criteria drawn from the benchmark items: their text as job description, the rest by item number.
CRITERIA_SQL = """SELECT item_id AS jd_id, text AS job_description, CAST(1 + item_id % 7 AS INTEGER) AS top_n,
  CAST(item_id % 9 AS INTEGER) AS min_exp,
  CASE item_id % 5 WHEN 0 THEN '!Python, sql ,machine learning' WHEN 1 THEN 'rust,! c++ ' WHEN 2 THEN '!sql,!python,spark'
                   WHEN 3 THEN 'React,react,linux' END AS skill_text
  FROM benchmark"""

# Vocabulary drawn from the benchmark items: their words and pairs of neighbouring words.
VOCABULARY_WORD = r"[^ \n]+"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def resumes_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, raw_text): every document with the trailer appended."""
    return documents(spark, sf_dir).selectExpr("doc_id", "source", f"{RAW_TEXT_SQL} AS raw_text")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A criteria table with one row per benchmark item."""
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("benchmark")
    return spark.sql(CRITERIA_SQL).withColumn("skills", F.split("skill_text", ",")).drop("skill_text")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary table (skill): lower-cased words of the benchmark items and pairs of neighbours."""
    words = table(spark, sf_dir, "benchmark").select(
        F.regexp_extract_all(F.lower("text"), F.lit(VOCABULARY_WORD), F.lit(0)).alias("w"))
    at = words.select("w", F.posexplode("w").alias("i", "word"))
    follower = F.get("w", F.col("i") + 1)
    return at.select("word", follower.alias("next")).select(
        F.explode(F.array("word", F.concat_ws(" ", "word", "next"))).alias("skill")).distinct()


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One stored vector used as the job-description embedding (a bounded 1-row fetch)."""
    row = embeddings(spark, sf_dir).where(f"vec_id = {int(vec_id)}").select("embedding").first()
    if row is None:
        raise ValueError(f"no vector with vec_id {vec_id}")
    return [float(x) for x in row[0]]
