"""Text embeddings and the embedding cache.

* ``embed``: any encoder ``list[str] -> 2-D array`` runs inside an iterator
  pandas UDF: Arrow batches in, one encoder per task (or per Python worker
  process, under a key given by the caller), L2-normalised float vectors out.
  A neural sentence encoder plugs in here; none is bundled.
* ``HashedEncoder``: the built-in encoder, all in the JVM: tokens → buckets
  (leading md5 digits) → sparse term counts → integer rarity weights fitted on
  the corpus (a distributed aggregate of ``dim`` numbers).  Components are whole
  numbers, so dot products and norms are exact in any order of summation.
* ``cache_misses`` / ``update_cache``: vectors keyed by the SHA-256 of the
  text, so re-ranking with new criteria embeds only texts never seen before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Encoder = Callable[[list[str]], "np.ndarray"]

#: Encoders kept by a Python worker under the caller's key.
_ENCODERS: dict[str, Encoder] = {}

DEFAULT_DIM = 1024
TOKEN_PATTERN = r"[\p{L}\p{N}+#.]+"
HASH_DIGITS = 7                   # leading hex digits of a token's md5 that choose its bucket


def _encoder(factory: Callable[[], Encoder], key: str | None) -> Encoder:
    """A new encoder for this task, or the worker's own under ``key``."""
    if key is None:
        return factory()
    if key not in _ENCODERS:
        _ENCODERS[key] = factory()
    return _ENCODERS[key]


def _unit_rows(mat: np.ndarray) -> np.ndarray:
    mat = np.asarray(mat, dtype=np.float64)
    norms = np.linalg.norm(mat, axis=1, keepdims=True)
    norms[norms == 0.0] = 1.0
    return (mat / norms).astype(np.float32)


def embed(df: DataFrame, text_col: str, encoder_factory: Callable[[], Encoder],
          out_col: str = "embedding", normalize: bool = True, encoder_key: str | None = None) -> DataFrame:
    """Add ``out_col`` ARRAY<FLOAT> = encoder(text), batched through Arrow.

    The encoder is built once per task.  With ``encoder_key`` a worker process
    keeps it for later tasks; the key must name the encoder and its settings.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(encoder_factory, encoder_key)
        for texts in batches:
            values = texts.fillna("").tolist()
            mat = np.asarray(enc(values), dtype=np.float32) if values else np.zeros((0, 0), np.float32)
            if normalize and len(values):
                mat = _unit_rows(mat)
            yield pd.Series(list(mat), dtype=object)

    return df.withColumn(out_col, encode(F.col(text_col)))


@dataclass(frozen=True)
class HashedEncoder:
    """Fitted weights, one per bucket."""

    text_col: str
    weights: tuple[int, ...]

    @property
    def dim(self) -> int:
        return len(self.weights)

    def vectors(self, counted: DataFrame, terms_col: str = "terms", out_col: str = "embedding", unit: bool = False) -> DataFrame:
        """Replace term counts by ARRAY<DOUBLE> vectors: whole numbers, or ``unit`` vectors (of zeros: left so).

        Norms are taken of the sparse vectors; a sum of whole numbers is exact in any order.
        """
        from pyspark.ml.feature import ElementwiseProduct, Normalizer
        from pyspark.ml.functions import vector_to_array
        from pyspark.ml.linalg import Vectors
        weigh = ElementwiseProduct(scalingVec=Vectors.dense(self.weights), inputCol=terms_col, outputCol="_weighted")
        weighted = weigh.transform(counted).drop(terms_col)
        if unit:
            weighted = Normalizer(p=2.0, inputCol="_weighted", outputCol="_unit").transform(weighted).drop("_weighted")
        last = "_unit" if unit else "_weighted"
        return weighted.withColumn(out_col, vector_to_array(last)).drop(last)


def bucket_of(token: F.Column, dim: int) -> F.Column:
    """The bucket of a token: leading md5 digits modulo ``dim``."""
    return F.conv(F.substring(F.md5(token), 1, HASH_DIGITS), 16, 10).cast("bigint") % dim


def term_counts(df: DataFrame, text_col: str, dim: int = DEFAULT_DIM, out_col: str = "terms") -> DataFrame:
    """Add ``out_col``: how many tokens of the text (null: none) fall in each bucket, a sparse vector."""
    from pyspark.ml.feature import CountVectorizerModel
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TOKEN_PATTERN), F.lit(0))
    buckets = F.transform(tokens, lambda t: bucket_of(t, dim).cast("string"))
    counter = CountVectorizerModel.from_vocabulary([str(i) for i in range(dim)], inputCol="_buckets", outputCol=out_col)
    return counter.transform(df.withColumn("_buckets", buckets)).drop("_buckets")


def fit_counts(counted: DataFrame, text_col: str, dim: int = DEFAULT_DIM, terms_col: str = "terms") -> HashedEncoder:
    """Weight of a bucket: the bit length of (documents // documents with the bucket).

    Reads ``counted`` once; only ``dim`` numbers reach the driver.  An empty
    corpus weighs every bucket 1, a bucket in no document as if in one.
    """
    from pyspark.ml.stat import Summarizer
    if counted.isEmpty():
        return HashedEncoder(text_col, (1,) * dim)
    got = counted.select(Summarizer.metrics("count", "numNonZeros").summary(F.col(terms_col)).alias("s")).first()["s"]
    return HashedEncoder(text_col, tuple((int(got["count"]) // max(int(n), 1)).bit_length() for n in got["numNonZeros"]))


def hashed_encoder_model(corpus: DataFrame, text_col: str, dim: int = DEFAULT_DIM) -> HashedEncoder:
    """Fit the built-in encoder on a corpus."""
    return fit_counts(term_counts(corpus.select(text_col), text_col, dim), text_col, dim)


def apply_hashed(model: HashedEncoder, df: DataFrame, out_col: str = "embedding") -> DataFrame:
    return model.vectors(term_counts(df, model.text_col, model.dim, "_terms"), "_terms", out_col)


def embed_corpus(df: DataFrame, text_col: str, dim: int = DEFAULT_DIM) -> tuple[DataFrame, HashedEncoder]:
    """``df`` with ``terms`` in place of the text, written once, and the encoder fitted on it.

    The rows behind ``df`` are computed once, however dear: fitting and
    scoring read the stored counts, never the text.
    """
    from shortlist.session import materialize_if_possible
    counted = materialize_if_possible(term_counts(df, text_col, dim).drop(text_col), "terms")
    return counted, fit_counts(counted, text_col, dim)


def embed_hashed(df: DataFrame, text_col: str, dim: int = DEFAULT_DIM,
                 out_col: str = "embedding") -> DataFrame:
    """Unit vectors of ``text_col`` by the built-in encoder fitted on ``df`` itself, in place of the text."""
    counted, model = embed_corpus(df, text_col, dim)
    return model.vectors(counted, out_col=out_col, unit=True)


def check_description(text: str | None) -> None:
    if not text or not text.strip():
        raise ValueError("Job description cannot be empty.")


def embed_queries(model: HashedEncoder, spark, texts: Sequence[str]) -> list[list[float]]:
    """Embed job descriptions with a fitted built-in encoder (one small job for all)."""
    for text in texts:
        check_description(text)
    rows = spark.createDataFrame(list(enumerate(texts)), f"_i int, `{model.text_col}` string")
    got = {r["_i"]: r["embedding"] for r in apply_hashed(model, rows).select("_i", "embedding").collect()}
    return [list(got[i]) for i in range(len(texts))]


def embed_query(model: HashedEncoder, spark, text: str) -> list[float]:
    return embed_queries(model, spark, [text])[0]


def text_hash(text: str | F.Column) -> F.Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.sha2(col, 256)


def cache_misses(docs: DataFrame, cache: DataFrame, text_col: str = "Resume_Text",
                 key: str = "doc_id", cache_hash_col: str | None = None,
                 hashed: bool = False) -> DataFrame:
    """(key, text_hash) of documents whose text hash is not in the cache.

    ``cache`` either has a ``cache_hash_col`` column or the same ``text_col``.
    With ``hashed=True`` the documents' ``text_col`` already holds the hash.
    A left-anti join on the hash: AQE broadcasts the cache side only when it
    is small at run time.
    """
    digest = F.col(text_col) if hashed else text_hash(text_col)
    hashed_docs = docs.select(F.col(key), digest.alias("text_hash"))
    if cache_hash_col:
        known = cache.select(F.col(cache_hash_col).alias("text_hash"))
    else:
        known = cache.select(text_hash(text_col).alias("text_hash"))
    # One row per hash on the cache side (combined map-side), so a hot group of
    # copies on the document side meets a single row and AQE's skew-join split
    # can cut that group over many tasks.
    known = known.dropDuplicates(["text_hash"])
    return hashed_docs.join(known, "text_hash", "left_anti").select(key, "text_hash")


def path_exists(spark, path: str) -> bool:
    """Whether ``path`` is there, in any store that Spark can reach."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def update_cache(docs: DataFrame, cache_path: str, text_col: str,
                 encode: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Embed only unseen texts and append them to the cache table at ``cache_path``.

    ``encode(df, text_col)`` adds an ``embedding`` column.  The cache table is
    (text_hash, embedding); each distinct new text is embedded once.
    A path holds the vectors of one encoder with one fit: use another path for
    another.  A cache that exists but can't be read fails; it isn't re-made.
    Returns the cache as read back after the append.
    """
    spark = docs.sparkSession
    cache = spark.read.parquet(cache_path) if path_exists(spark, cache_path) else None   # None: first run
    hashed = docs.select(text_hash(text_col).alias("text_hash"), F.col(text_col))
    new = hashed if cache is None else hashed.join(cache.select("text_hash"), "text_hash", "left_anti")
    new = new.dropDuplicates(["text_hash"])
    encode(new, text_col).select("text_hash", "embedding").write.mode("append").parquet(cache_path)
    return spark.read.parquet(cache_path)


def lookup_vectors(docs: DataFrame, cache: DataFrame, text_col: str, key: str) -> DataFrame:
    """(key, embedding) for documents, read from the cache by text hash."""
    return docs.select(F.col(key), text_hash(text_col).alias("text_hash")) \
               .join(cache, "text_hash").select(key, "embedding")


def encoder_from_function(fn: Callable[[Sequence[str]], "np.ndarray"]) -> Callable[[], Encoder]:
    """Wrap a plain function as an encoder factory."""
    return lambda: (lambda texts: fn(texts))
