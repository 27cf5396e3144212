"""Distributions and classification metrics of a scored table.

The chart data the reference drew as images are returned as small tables:
histograms, a kernel density curve, a confusion matrix and per-class
precision/recall/F1.  Every one is a single aggregate over the corpus
(partially aggregated map-side) followed by work on a bounded table; none
collects rows to the driver or sends a group to one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.functions.scoring import LABELS, round_half_even

# ---------------------------------------------------------------------------
# Chart parameters of the reference.
# ---------------------------------------------------------------------------
SCORE_BINS = 20
EXPERIENCE_BINS = 15
DENSITY_POINTS = 200
METRIC_DECIMALS = 4
# ---------------------------------------------------------------------------
DENSITY_DECIMALS = 6


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """(value, n) for the non-null values of ``col``."""
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")) \
             .agg(F.count(F.lit(1)).alias("n"))


def _edges(counts: DataFrame) -> tuple[Column, Column]:
    """Outer bin edges as scalar subqueries: min/max, widened by 0.5 when equal."""
    lim = counts.agg(F.min("value").cast("double").alias("lo"),
                     F.max("value").cast("double").alias("hi"))
    lim = lim.select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    both = lim.select(F.struct("lo", "hi")).scalar()  # one subquery for both edges
    return both["lo"], both["hi"]


def _edge(i: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Edge i of ``bins`` equal bins, as numpy's linspace computes it."""
    step = (hi - lo) / F.lit(float(bins))
    return F.when(i >= bins, hi).otherwise(i.cast("double") * step + lo)


def bin_index(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based bin of ``x``: the last edge <= x, the top edge closing the last bin."""
    guess = F.floor((x - lo) / (hi - lo) * F.lit(float(bins)))
    guess = F.least(F.greatest(guess, F.lit(0)), F.lit(bins - 1))
    return (F.when(x < _edge(guess, lo, hi, bins), guess - 1)
             .when((x >= _edge(guess + 1, lo, hi, bins)) & (guess != bins - 1), guess + 1)
             .otherwise(guess)).cast("int")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width histogram between min and max: (bin, bin_lo, bin_hi, count).

    Empty bins are kept.  The corpus is reduced to (value, n) first.
    """
    counts = value_counts(df, col)
    lo, hi = _edges(counts)
    # The edges enter each side once, as columns, and are referenced from there.
    lo_c, hi_c = F.col("_lo"), F.col("_hi")
    x = F.col("value").cast("double")
    per_bin = (counts.select(x.alias("value"), "n", lo.alias("_lo"), hi.alias("_hi"))
                     .groupBy(bin_index(F.col("value"), lo_c, hi_c, bins).alias("b"))
                     .agg(F.sum("n").alias("count")))
    all_bins = df.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("b"), lo.alias("_lo"), hi.alias("_hi"))
    # Both sides have at most ``bins`` rows.
    out = all_bins.join(F.broadcast(per_bin), "b", "left")
    return out.select(
        (F.col("b") + 1).alias("bin"),
        _edge(F.col("b"), lo_c, hi_c, bins).alias("bin_lo"),
        _edge(F.col("b") + 1, lo_c, hi_c, bins).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def score_histogram(scored: DataFrame) -> DataFrame:
    return histogram(scored, "Final_Score", SCORE_BINS)


def experience_histogram(scored: DataFrame) -> DataFrame:
    return histogram(scored, "Exp_Years", EXPERIENCE_BINS)


def density_curve(df: DataFrame, col: str, points: int = DENSITY_POINTS,
                  bins: int = SCORE_BINS) -> DataFrame:
    """Gaussian kernel density of ``col`` on ``points`` evenly spaced points from
    min to max, Scott's bandwidth (n^-1/5 x sample std), scaled by
    n x histogram bin width so it overlays a count histogram.

    Columns: (point, x, density), rounded to 6 decimals.  Empty when fewer than
    two rows or zero variance.  Work: one aggregate to (value, n), then
    ``points`` contributions per distinct value, summed per point.
    """
    counts = value_counts(df, col)
    x = F.col("value").cast("double")
    stats = counts.agg(
        F.sum("n").alias("cnt"),
        F.min(x).alias("lo"), F.max(x).alias("hi"),
        F.sum(F.col("n") * x).alias("s1"),
        F.sum(F.col("n") * x * x).alias("s2"))
    var = (F.col("s2") - F.col("s1") * F.col("s1") / F.col("cnt")) / (F.col("cnt") - 1)
    stats = stats.select(
        "cnt", "lo", "hi",
        (F.sqrt(var) * F.pow(F.col("cnt").cast("double"), F.lit(-0.2))).alias("h"),
        ((F.col("hi") - F.col("lo")) / F.lit(float(bins))).alias("width"))
    st = stats.select(F.struct("cnt", "lo", "hi", "h", "width")).scalar()  # one subquery
    # Bring the statistics in once as a struct column and read its fields from there.
    with_st = counts.select(x.alias("v"), "n", st.alias("_st"))
    cnt, lo, hi, h, width = (F.col(f"_st.{c}") for c in ("cnt", "lo", "hi", "h", "width"))

    step = (hi - lo) / F.lit(float(points - 1))
    valid = (cnt >= 2) & (h > 0)
    # ``points`` evaluation points per distinct value (a fixed fan-out, not pairs of rows).
    contrib = with_st.where(valid).select(
        "v", "n", "_st", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    contrib = contrib.withColumn(
        "x", F.when(F.col("point") == points - 1, hi).otherwise(F.col("point").cast("double") * step + lo))
    z = (F.col("x") - F.col("v")) / h
    kernel = F.col("n") * F.exp(F.lit(-0.5) * z * z)
    scale = width / (h * F.lit(math.sqrt(2.0 * math.pi)))
    dens = contrib.groupBy("point", "x").agg(F.sum(kernel).alias("k"), F.first(scale).alias("scale"))
    return dens.select("point", round_half_even(F.col("x"), DENSITY_DECIMALS).alias("x"),
                       round_half_even(F.col("k") * F.col("scale"), DENSITY_DECIMALS).alias("density"))


def score_density(scored: DataFrame) -> DataFrame:
    return density_curve(scored, "Final_Score")


def _pair_counts(df: DataFrame, actual: str, predicted: str, labels: Sequence) -> list[Column]:
    a, p = F.col(actual).cast("string"), F.col(predicted).cast("string")
    return [F.count_if((a == F.lit(str(x))) & (p == F.lit(str(y)))).alias(f"c_{i}_{j}")
            for i, x in enumerate(labels) for j, y in enumerate(labels)]


def confusion_matrix(df: DataFrame, actual: str, predicted: str,
                     labels: Sequence = LABELS) -> DataFrame:
    """Rows = actual label (fixed order), one count column per predicted label.

    One aggregate pass with a counter per (actual, predicted) pair; labels
    outside ``labels`` are ignored.  Zero rows and columns are kept.
    """
    names = [str(x) for x in labels]
    agg = df.agg(*_pair_counts(df, actual, predicted, labels))
    rows = [F.struct(F.lit(i).alias("row"), F.lit(x).alias("actual"),
                     *[F.col(f"c_{i}_{j}").alias(y) for j, y in enumerate(names)])
            for i, x in enumerate(names)]
    return agg.select(F.inline(F.array(*rows))).drop("row")


def _class_counts(df: DataFrame, actual: str, predicted: str, labels: Sequence, weight: str | None) -> DataFrame:
    """One row: per label hits, predicted and actual rows, then all hits and all rows, from one pass.

    With ``weight`` a row stands for that many rows.
    """
    a, p = F.col(actual).cast("string"), F.col(predicted).cast("string")

    def count(cond: Column) -> Column:
        return F.count_if(cond) if weight is None else F.coalesce(F.sum(F.when(cond, F.col(weight))), F.lit(0))

    aggs = []
    for i, x in enumerate(labels):
        lx = F.lit(str(x))
        aggs += [count((a == lx) & (p == lx)).alias(f"tp_{i}"), count(p == lx).alias(f"pred_{i}"), count(a == lx).alias(f"true_{i}")]
    return df.agg(*aggs, count(a == p).alias("hits"), count((a == p).isNotNull()).alias("rows"))


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def _class_ratios(i: int) -> tuple[Column, Column, Column]:
    """Precision, recall and F1 of label ``i``."""
    tp, pred, true = F.col(f"tp_{i}"), F.col(f"pred_{i}"), F.col(f"true_{i}")
    return _ratio(tp, pred), _ratio(tp, true), _ratio(2 * tp, true + pred)


def per_class_metrics(df: DataFrame, actual: str, predicted: str,
                      labels: Sequence = LABELS, weight: str | None = None) -> DataFrame:
    """(label, precision, recall, f1, support); 0 where a ratio is undefined.

    F1 is 2tp / (2tp + fp + fn), the count form of the harmonic mean.
    """
    rows = []
    for i, x in enumerate(labels):
        precision, recall, f1 = _class_ratios(i)
        rows.append(F.struct(F.lit(i).alias("row"), F.lit(str(x)).alias("label"), precision.alias("precision"),
                             recall.alias("recall"), f1.alias("f1"), F.col(f"true_{i}").alias("support")))
    return _class_counts(df, actual, predicted, labels, weight).select(F.inline(F.array(*rows))).drop("row")


def classification_metrics(df: DataFrame, actual: str, predicted: str,
                           labels: Sequence = LABELS, weight: str | None = None) -> DataFrame:
    """One row: accuracy and macro precision/recall/F1 over the fixed labels
    (absent labels count as 0), rounded to 4 decimals; one pass over ``df``."""
    ratios = [_class_ratios(i) for i in range(len(labels))]
    names = ("macro_precision", "macro_recall", "macro_f1")
    macro = [round_half_even(reduce(add, [r[j] for r in ratios]) / F.lit(float(len(labels))), METRIC_DECIMALS).alias(name)
             for j, name in enumerate(names)]
    return _class_counts(df, actual, predicted, labels, weight).select(
        round_half_even(_ratio(F.col("hits"), F.col("rows")), METRIC_DECIMALS).alias("accuracy"), *macro)


def ranking_metrics(scored: DataFrame, actual: str = "Label", predicted: str = "Label", weight: str | None = None) -> DataFrame:
    """The ranking's own metrics: thresholded label as pseudo-truth vs itself."""
    return classification_metrics(scored, actual, predicted, LABELS, weight)
