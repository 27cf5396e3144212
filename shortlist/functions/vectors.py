"""Dense-vector column functions (embeddings stored as ARRAY<FLOAT|DOUBLE>).

All arithmetic is in DOUBLE and sums run left to right, element 0 first, so
results are reproducible bit for bit across partitionings.  Cosine is
``dot / sqrt(|a|^2 * |b|^2)`` and 0 for a zero vector.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product of two array columns (higher-order form, any dimension)."""
    prods = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def squared_norm(v: Column | str) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity of two array columns; 0 when either vector is zero."""
    denom = F.sqrt(squared_norm(a) * squared_norm(b))
    return F.coalesce(F.try_divide(dot(a, b), denom), F.lit(0.0))


def l2_normalize(v: Column | str) -> Column:
    """Unit-length copy of ``v`` (a zero vector is returned unchanged).

    Lambdas are interpreted and share no subexpressions: the norm is bound as
    the variable of an outer one, else every element would work it out again.
    """
    pair = F.array(F.struct(as_double(v).alias("v"), F.sqrt(squared_norm(v)).alias("n")))
    unit = F.transform(pair, lambda p: F.when(p["n"] == 0.0, p["v"]).otherwise(F.transform(p["v"], lambda x: x / p["n"])))
    return unit[0]


def _python_squared_norm(q: Sequence[float]) -> float:
    total = 0.0
    for x in q:
        total += float(x) * float(x)
    return total


def _double_sql(x: float) -> str:
    """An exact SQL literal for a Python float (repr round-trips)."""
    if math.isnan(x):
        return "CAST('NaN' AS DOUBLE)"
    if math.isinf(x):
        return "CAST('Infinity' AS DOUBLE)" if x > 0 else "CAST('-Infinity' AS DOUBLE)"
    return f"({x!r}D)"


def literal_vector(q: Sequence[float]) -> Column:
    """A constant ARRAY<DOUBLE> (one flat literal, whatever its length)."""
    return F.expr(f"CAST(array({', '.join(_double_sql(float(x)) for x in q)}) AS array<double>)")


def cosine_to(v: Column | str, query: Sequence[float]) -> Column:
    """Cosine of every row's vector with one query vector, of any dimension.

    The query is one constant array and the sums run over it from left to
    right, so the expression does not grow with the dimension.  A row whose
    vector has another dimension fails loudly; a zero vector scores 0.
    """
    q = [float(x) for x in query]
    vd = as_double(v)
    score = F.try_divide(dot(vd, literal_vector(q)), F.sqrt(squared_norm(vd) * F.lit(_python_squared_norm(q))))
    return F.when(F.size(vd) == len(q), F.coalesce(score, F.lit(0.0))).otherwise(
        F.raise_error(F.lit(f"embedding dimension differs from the query's ({len(q)})")))


def normalize_python(q: Sequence[float]) -> list[float]:
    """L2-normalise a driver-side vector (a query), same arithmetic as ``l2_normalize``."""
    n = math.sqrt(_python_squared_norm(q))
    return [float(x) / n for x in q] if n else [float(x) for x in q]
