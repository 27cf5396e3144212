"""Guards that live in the plan: a result fails when it is read, without a job of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EMPTY_INPUT = "Input DataFrame is empty."
NO_RESUMES = "No valid resumes were extracted from the ZIP file."


def nonempty(df: DataFrame, message: str = EMPTY_INPUT) -> DataFrame:
    """``df``; reading it raises ``message`` if it has no row.

    A one-row table asks, through a scalar subquery that stops at the first
    row, whether ``df`` has any, and is empty itself if so; it is appended to
    ``df``.  Give a stored table, or one whose first row comes cheaply.
    """
    found = df.limit(1).agg(F.count(F.lit(1)).alias("n")).scalar()
    asked = df.sparkSession.range(1).where(
        F.when(found == 0, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(False)))
    nothing = asked.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return df.unionByName(nothing)
