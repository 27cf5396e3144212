"""Corpus cleaning pipeline: each stage applies one operator of ``shortlist.llm``.

A stage takes (spark, docs, sf_dir), where docs is what its predecessor wrote,
and works on all of it; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.llm.common import SLICE_BYTES, free_name, store, table, with_row_id

#: Spark's default is 64 MB (or 10,000 rows).
BATCH_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """From now on rows reach this session's Python workers a slice at a time, unless the session has a size of its own.

    Executor and worker hold a batch whole, the executor outside its heap and twice while the batch grows.
    """
    if spark.conf.get(BATCH_SIZE, None) is None:
        spark.conf.set(BATCH_SIZE, str(SLICE_BYTES))


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with the row number its operators give, under a name that ``docs`` doesn't have."""
    name = free_name(docs, "rid")
    return with_row_id(docs, name), name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    _small_batches(spark)
    from shortlist.llm.toxicity import score
    whole = docs.select("doc_id", "text", F.struct("*").dropFields("text").alias("row"))   # a text goes to a task once
    kept = score(whole, table(spark, sf_dir, "labels").select("doc_id", "toxic")).where("predicted = 0")
    return kept.select([(F.col("text") if c.lower() == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: that with the smallest doc_id."""
    _small_batches(spark)
    from shortlist.llm.simhash import near_duplicates
    kept = near_duplicates(docs, shingle=4, max_bits=4).where("keep")
    rows, rid = _numbered(docs)
    return rows.join(kept.select(F.col("rid").alias(rid)), rid, "left_semi").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose every passage of 35 words that also stands elsewhere; all documents stay.

    Kept words are joined by single spaces, a null text becomes empty, and
    n_chars counts what is left.
    """
    _small_batches(spark)
    from shortlist.llm.substring import substring_dedup as dedup
    rest, rid = _numbered(docs.drop("text", "n_chars"))
    left = dedup(docs, window=35).select(F.col("rid").alias(rid), F.col("kept_text").alias("text"))
    return (rest.join(left, rid).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
            .select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    _small_batches(spark)
    from shortlist.llm.decontam import decontaminate
    clean = decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10).where(F.size("hits") == 0)
    rows, rid = _numbered(docs)
    return rows.join(clean.select(F.col("rid").alias(rid)), rid, "left_semi").select(docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of what is left, and the text that the ids decode to."""
    _small_batches(spark)
    import public_tokenizers

    from shortlist.llm.bpe import encode
    return encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("simhash_near_dedup", simhash_near_dedup), ("substring_dedup", substring_dedup),
          ("decontamination", decontamination), ("bpe", bpe)]

#: SQL can express neither the classifier nor the fingerprints nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
