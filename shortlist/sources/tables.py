"""Table sources and sinks for the resume table and ranking outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.schemas import RECORD_COLUMNS, RESUME_COLUMNS, RESUME_SCHEMA

_STRING_COLUMNS = [f.name for f in RESUME_SCHEMA.fields if f.dataType.simpleString() == "string"]


def read_resumes(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """Read an extracted resume table with the fixed schema (no inference).

    Missing strings become '' and a missing year count 0, so downstream
    string functions never meet a null.
    """
    reader = spark.read.format(fmt).schema(RESUME_SCHEMA)
    if fmt == "csv":
        reader = reader.option("header", "true")
    for key, value in options.items():
        reader = reader.option(key, value)
    df = reader.load(path)
    return df.na.fill("", _STRING_COLUMNS).na.fill(0, ["Exp_Years"])


def write_resumes(resumes: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                  partition_by: str | None = None) -> None:
    """Write the resume table (fixed columns first, extra key columns after)."""
    extra = [c for c in resumes.columns if c not in RESUME_COLUMNS]
    writer = resumes.select(*RESUME_COLUMNS, *extra).write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.save(path)


def records_json(records: DataFrame) -> DataFrame:
    """One JSON string per record, the ten record columns in order."""
    return records.select(F.to_json(F.struct(*RECORD_COLUMNS)).alias("json"))


def write_records(records: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ranked records as JSON lines (distributed; nothing through the driver)."""
    records.select(*RECORD_COLUMNS).write.mode(mode).json(path)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """First ``n`` rows for display."""
    return df.limit(n)


def write_bucketed(df: DataFrame, table: str, key: str | list[str], buckets: int,
                   mode: str = "overwrite") -> DataFrame:
    """Save ``df`` as a table bucketed and sorted by ``key`` and return it.

    Two tables bucketed the same way on the join key (e.g. the resume table
    and its vector or score table, both keyed by document id) join without
    a shuffle: ranking the same corpus again and again then skips the
    corpus-wide exchange of the score join.
    """
    keys = [key] if isinstance(key, str) else list(key)
    df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)
