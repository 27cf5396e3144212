"""Positions and per-group ordinals without a hot task.

``row_number() OVER (PARTITION BY g ORDER BY k)`` sends a whole group to one
task; when one archive or source holds a third of all rows that task is the
whole job.  Here the rows are sorted by a range-partitioned global sort, whose
splitters Spark takes from the data, so parts stay even for any distribution
of groups and keys.  The sorted rows are stored once with their part and their
place in it; numbering then only adds what stands in earlier parts.

Because places are read back from the stored table, every recomputation after
an executor loss gives the same numbers.  The order must be total (a key unique
within its group).  Give narrow tables: all columns given are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shortlist.session import materialize_if_possible

#: monotonically_increasing_id: the part above, the place in the part in the lower 33 bits.
_PLACE_BITS = 33


def _sorted(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` in the given order, stored, with ``_part`` and ``_place`` (from 0)."""
    at = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    stored = materialize_if_possible(at, "sorted")
    return stored.select(*df.columns, F.shiftright("_at", _PLACE_BITS).alias("_part"),
                         F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).alias("_place"))


def ordinal_within(df: DataFrame, group: str, key: str, name: str = "idx") -> DataFrame:
    """Add ``name`` = row_number() over (partition by ``group`` order by ``key``).

    Groups may be null and count as one group.  The shift of each (part, group)
    run is joined on both columns, so a hot group meets its shift part by part.
    """
    rows = _sorted(df, F.col(group).asc(), F.col(key).asc())
    runs = rows.groupBy("_part", group).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), "_first", "_n").select(
        "_p", "_g", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    out = rows.join(shifts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return out.select(*df.columns, (F.col("_place") + F.col("_shift") + 1).cast("long").alias(name))


def with_position(df: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """Add ``name``: each row's place (from 1) in the given total order."""
    rows = _sorted(df, *order)
    parts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # One row per part of the sort: a bound that doesn't grow with a part's rows.
    out = rows.join(F.broadcast(offsets), F.col("_part") == F.col("_p"))
    return out.select(*df.columns, (F.col("_place") + F.col("_before") + 1).cast("long").alias(name))
