"""Term index: documents kept as term counts, ranked again without their text.

A document's text becomes counts of hashed terms once, when it comes in.  The
index holds, batch by batch under one folder,

* ``rows``: the extracted fields, a document number, the sparse counts;
* ``postings``: (bucket, document, count), sorted by bucket inside each file,
  so a query's few buckets are found by the files' statistics;
* ``frequency``: documents per bucket and their number (bucket -1), a state
  that adds up over batches.  It is written last and makes a batch visible.

Weights follow from the added-up frequencies: the bit length of (documents //
documents with the bucket), as in ``embed.fit_counts``.  Squared norms are kept
per set of weights and batch under ``norms``; weights seldom change, so a new
batch usually computes its own norms alone.  All sums are over whole numbers,
so cosines are exact whatever the order.

A ranking reads the postings of the query's buckets, the norms and the fields:
one grouped sum by document, one join.  Without a folder (``transient_index``)
a row's sums are taken of its own stored counts, in passing: nothing is joined
or shuffled.  Tokens are found in the JVM; Arrow batches of them are counted,
and sums taken, with numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.operators.embed import (DEFAULT_DIM, HASH_DIGITS, TOKEN_PATTERN, bucket_of, check_description, path_exists)
from shortlist.session import materialize_if_possible

#: Key of a document in the index; ``_batch`` is the folder it came with.
KEY = ("_batch", "_doc")
#: The bucket under which ``frequency`` counts documents.
ALL_DOCUMENTS = -1


#: Rows counted or summed at a time inside an Arrow batch.
ROWS = 512
TERMS = pa.struct([("bucket", pa.int32()), ("n", pa.int64())])


def _by_rows(some: pa.Array, fn: Callable[[pa.Array], pa.Array], kind: pa.DataType) -> pa.Array:
    """``fn`` of every ``ROWS`` rows, put together."""
    return pa.concat_arrays([pa.array([], kind), *[fn(some.slice(at, ROWS)).cast(kind) for at in range(0, len(some), ROWS)]])


def _inner(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Elements of all lists, and the row of each."""
    return lists.flatten(), lists.value_parent_indices().to_numpy(zero_copy_only=False)


def _counted_tokens(dim: int) -> Callable[[Column], Column]:
    """array<string> -> array<struct<bucket,n>>, buckets ascending: ``bucket_of`` each token, counted by row."""
    kind = pa.list_(TERMS)

    def count(tokens: pa.Array) -> pa.Array:
        values, row = _inner(tokens)
        coded = values.dictionary_encode()
        bucket = np.array([int(hashlib.md5(t.encode()).hexdigest()[:HASH_DIGITS], 16) % dim for t in coded.dictionary.to_pylist()], np.int64)
        at = coded.indices.to_numpy(zero_copy_only=False)
        key, n = np.unique(row * dim + bucket[at], return_counts=True)
        ends = np.searchsorted(key, np.arange(len(tokens) + 1) * dim)
        terms = pa.StructArray.from_arrays([pa.array(key % dim, pa.int32()), pa.array(n, pa.int64())], fields=list(TERMS))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), terms)

    @F.arrow_udf("array<struct<bucket:int,n:bigint>>")
    def counted(tokens: pa.Array) -> pa.Array:
        return _by_rows(tokens, count, kind)
    return counted


def row_sums(weights: np.ndarray, columns: np.ndarray) -> Callable[[Column], Column]:
    """``_terms`` -> array<bigint>: the squared norm under ``weights``, then the sum of n * column[bucket] for each column.

    ``columns``: whole numbers, dim x columns.  Sums are exact: in doubles where
    no sum can pass 2 ** 52, else in 64-bit whole numbers.
    """
    kind, width = pa.list_(pa.int64()), columns.shape[1] + 1
    most = int(np.abs(columns).max(initial=0))
    doubles = columns.astype(np.float64)

    def sums(terms: pa.Array) -> pa.Array:
        values, row = _inner(terms)
        bucket, n = (values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
        added = np.concatenate([[0], np.cumsum((n * weights[bucket]) ** 2)])
        edges = np.searchsorted(row, np.arange(len(terms) + 1))
        exact = most * int(np.bincount(row, n, len(terms)).max(initial=0)) < 2 ** 52
        dense = np.zeros((len(terms), len(columns)), np.float64 if exact else np.int64)
        dense[row, bucket] = n
        got = np.column_stack([np.diff(added[edges]), (dense @ (doubles if exact else columns)).astype(np.int64)])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(terms) + 1) * width, pa.int32()), pa.array(got.ravel()))

    @F.arrow_udf("array<bigint>")
    def summed(terms: pa.Array) -> pa.Array:
        return _by_rows(terms, sums, kind)
    return summed


def _postings(rows: DataFrame) -> DataFrame:
    """(_doc, bucket, n) of stored rows, unfolded row by row; nothing is shuffled."""
    keys = [c for c in KEY if c in rows.columns]
    return rows.select(*keys, F.inline("_terms"))


def _frequency(rows: DataFrame) -> DataFrame:
    """(bucket, docs): documents per bucket, and all documents under ``ALL_DOCUMENTS``."""
    per_bucket = _postings(rows).groupBy("bucket").agg(F.count(F.lit(1)).alias("docs"))
    return per_bucket.union(rows.agg(F.lit(ALL_DOCUMENTS), F.count(F.lit(1)))).coalesce(1)


def _counted(resumes: DataFrame, text_col: str, dim: int) -> DataFrame:
    """Rows with sparse counts and a number in place of the text; numbers hold once the rows are stored."""
    if taken := {*KEY, "_terms"} & set(resumes.columns):
        raise ValueError(f"columns {sorted(taken)} are the index's own")
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))
    counted = resumes.withColumn("_terms", _counted_tokens(dim)(tokens)).drop(text_col)
    return counted.withColumn("_doc", F.monotonically_increasing_id())


def write_batch(resumes: DataFrame, path: str, batch: int = 0, text_col: str = "Resume_Text",
                dim: int = DEFAULT_DIM) -> None:
    """Add ``resumes`` (any columns; ``text_col`` is not kept) to the index at ``path`` as one batch.

    A batch written again replaces itself.  All batches need one ``dim``.
    """
    spark = resumes.sparkSession
    part = f"_batch={int(batch)}"
    _counted(resumes, text_col, dim).write.mode("overwrite").parquet(f"{path}/rows/{part}")
    rows = spark.read.parquet(f"{path}/rows/{part}")
    _postings(rows).sortWithinPartitions("bucket", "_doc").write.mode("overwrite").parquet(f"{path}/postings/{part}")
    _frequency(rows).write.mode("overwrite").parquet(f"{path}/frequency/{part}")


def bit_length(x: Column) -> Column:
    return F.length(F.bin(x))


@dataclass(frozen=True)
class TermIndex:
    """An opened index: its tables, the weight of each bucket, and the number of documents."""

    rows: DataFrame
    postings: DataFrame
    weights: dict[int, int]
    n_docs: int
    dim: int
    path: str | None = None

    def weight(self, bucket: int) -> int:
        return self.weights.get(bucket, max(1, self.n_docs.bit_length()))

    def fit_name(self) -> str:
        """Name of the weights: equal weights, equal norms."""
        return hashlib.sha256(repr((self.dim, sorted(self.weights.items()))).encode()).hexdigest()[:16]

    def norms(self) -> DataFrame | None:
        """(_batch, _doc, sq): squared norms, computed once per batch and set of weights; None without a folder."""
        if self.path is None:
            return None
        spark, base = self.rows.sparkSession, f"{self.path}/norms/fit={self.fit_name()}"
        for (batch,) in sorted(self.rows.select("_batch").distinct().collect()):
            if not path_exists(spark, f"{base}/_batch={batch}/_SUCCESS"):
                own = self.postings.where(F.col("_batch") == batch).groupBy("_doc").agg(self._square().alias("sq"))
                own.write.mode("overwrite").parquet(f"{base}/_batch={batch}")
        return spark.read.parquet(base) if path_exists(spark, base) else None

    def _lookup(self, values: Sequence[int], bucket: str = "bucket") -> Column:
        """Whole numbers, one per bucket, read at the posting's bucket: a single folded constant in the plan."""
        numbers = F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<bigint>")
        return F.element_at(numbers, F.col(bucket) + 1)

    def weight_at(self, bucket: str) -> Column:
        """Weight of the bucket in a column."""
        return self._lookup([self.weight(b) for b in range(self.dim)], bucket)

    def _square(self) -> Column:
        weight = self.weight_at("bucket")
        return F.sum(F.col("n") * F.col("n") * weight * weight)

    def query_terms(self, descriptions: Sequence[str]) -> list[dict[int, int]]:
        """Weighted counts (bucket -> y) of each job description; one small job for all.

        A blank description raises ``ValueError`` before the job runs.
        """
        for text in descriptions:
            check_description(text)
        asked = self.rows.sparkSession.createDataFrame(list(enumerate(descriptions)), "jd_id int, job_description string")
        out: list[dict[int, int]] = [{} for _ in descriptions]
        for jd, bucket, c in description_terms(asked, self.dim).collect():
            out[jd][bucket] = c * self.weight(bucket)
        return out

    def weights_list(self) -> np.ndarray:
        return np.array([self.weight(b) for b in range(self.dim)], np.int64)

    def sums(self, terms: Sequence[dict[int, int]]) -> Column:
        """Of each row: its squared norm, then its dot product with every query's weighted counts (bucket -> y)."""
        weights, columns = self.weights_list(), np.zeros((self.dim, len(terms)), np.int64)
        for i, t in enumerate(terms):
            for b, y in t.items():
                columns[b, i] = y * weights[b]
        return row_sums(weights, columns)("_terms")

    def squares(self) -> DataFrame:
        """(_batch, _doc, sq) of every document that has terms."""
        known = self.norms()
        return self.postings.groupBy(*KEY).agg(self._square().alias("sq")) if known is None else known

    def semantic(self, descriptions: Sequence[str], names: Sequence[str]) -> DataFrame:
        """``rows`` without counts, plus one column per job description: its cosine with the document.

        A document that shares no term with the description scores 0.
        """
        terms = self.query_terms(descriptions)
        fields = self.rows.drop("_terms")
        norms = self.norms()
        if norms is None:
            joined = self.rows.withColumn("_sums", self.sums(terms)).select(
                *fields.columns, F.col("_sums")[0].alias("_sq"), *[F.col("_sums")[i + 1].alias(f"_d{i}") for i in range(len(terms))])
        else:
            # Dots and norms meet in one grouped sum: postings of the queries' buckets only.
            dots = [F.coalesce(F.sum(F.col("n") * self._lookup([t.get(b, 0) * self.weight(b) for b in range(self.dim)])), F.lit(0))
                    .alias(f"_d{i}") for i, t in enumerate(terms)]
            asked = sorted({b for t in terms for b in t})
            own = self.postings.where(F.col("bucket").isin(asked)).groupBy(*KEY).agg(*dots).withColumn("_sq", F.lit(0).cast("bigint"))
            known = norms.select(*KEY, *[F.lit(0).cast("bigint").alias(f"_d{i}") for i in range(len(terms))], F.col("sq").alias("_sq"))
            columns = ["_sq", *[f"_d{i}" for i in range(len(terms))]]
            sums = own.unionByName(known).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in columns])
            joined = fields.join(sums, list(KEY), "left")
        scores = [cosine_of(F.col(f"_d{i}"), F.col("_sq"), F.lit(sum(y * y for y in t.values()))).alias(name)
                  for i, (t, name) in enumerate(zip(terms, names))]
        return joined.select(*fields.columns, *scores)


def cosine_of(dot: Column, square: Column, query_square: Column) -> Column:
    """Cosine from whole-number sums; 0 where one side has no terms."""
    whole = F.sqrt(square.cast("double") * query_square.cast("double"))
    return F.coalesce(F.try_divide(dot.cast("double"), whole), F.lit(0.0))


def description_terms(queries: DataFrame, dim: int = DEFAULT_DIM) -> DataFrame:
    """(jd_id, bucket, c): term counts of the job descriptions of ``queries`` (jd_id, job_description)."""
    tokens = F.regexp_extract_all(F.lower(F.col("job_description")), F.lit(TOKEN_PATTERN), F.lit(0))
    return (queries.select("jd_id", F.explode(tokens).alias("token"))
            .groupBy("jd_id", bucket_of(F.col("token"), dim).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("c")))


def _fitted(frequency: DataFrame) -> tuple[dict[int, int], int]:
    """Weights and number of documents from added-up frequencies: at most ``dim`` + 1 numbers."""
    docs = {r["bucket"]: int(r["docs"]) for r in frequency.groupBy("bucket").agg(F.sum("docs").alias("docs")).collect()}
    n = docs.pop(ALL_DOCUMENTS, 0)
    return {b: (n // df).bit_length() for b, df in docs.items()}, n


def open_index(spark: SparkSession, path: str, dim: int = DEFAULT_DIM) -> TermIndex:
    """The index at ``path`` as its complete batches stand now."""
    frequency = spark.read.parquet(f"{path}/frequency")
    batches = [r["_batch"] for r in frequency.select("_batch").distinct().collect()]
    weights, n = _fitted(frequency)

    def known(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}").where(F.col("_batch").isin(batches))
    return TermIndex(known("rows"), known("postings"), weights, n, dim, path)


def transient_index(resumes: DataFrame, text_col: str = "Resume_Text", dim: int = DEFAULT_DIM) -> TermIndex:
    """An index for one ranking: rows stored once, postings read off them, nothing kept for later."""
    rows = materialize_if_possible(_counted(resumes, text_col, dim), "terms")
    rows = rows.withColumn("_batch", F.lit(0))
    weights, n = _fitted(_frequency(rows.drop("_batch")))
    return TermIndex(rows, _postings(rows), weights, n, dim)
