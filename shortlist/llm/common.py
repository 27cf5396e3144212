"""Shared helpers: table access, stored intermediate tables, Arrow slices, words."""

from __future__ import annotations

import ctypes
import os
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlist.session import checkpoint_dir, materialize

#: Text handled at a time inside a task, so that numpy scratch arrays stay small.
SLICE_BYTES = 8 << 20

#: A-Z to a-z, every other byte as it is.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    Where it is unset, a folder is set once: a fresh temporary one for a local
    master (tests), else one in the session's warehouse, which executors share.
    """
    if not (base := checkpoint_dir(spark)):
        master = spark.sparkContext.master
        if master.startswith("local") and not master.startswith("local-cluster"):
            base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        else:
            base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        spark.sparkContext.setCheckpointDir(base)
        base = checkpoint_dir(spark)
    return base


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back (cuts lineage)."""
    shared_dir(df.sparkSession)
    return materialize(df, name)


def new_folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"shortlist-{name}-{uuid.uuid4().hex}")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front as long as ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def other_columns(df: DataFrame, text_col: str, *results: str) -> list[str]:
    """Columns that pass through an operator: all but the text and those named like a result."""
    taken = {c.lower() for c in results}
    return [c for c in df.columns if c != text_col and c.lower() not in taken]


def with_row_id(df: DataFrame, name: str = "rid") -> DataFrame:
    """Number the rows of a stored table; a column ``name`` it already has raises ``ValueError``.

    The number is the place of the row's file among the table's files, sorted by
    path, and the row's place in the file.  So it is the same in every pass,
    however the scan is split; give stored tables only.
    """
    if free_name(df, name) != name:
        raise ValueError(f"the table has a column {name}; give another name for the row number")
    path, row, file = (free_name(df, c) for c in ("__path", "__row", "__file"))
    paths = sorted({re.sub("^([^:/]+):///", r"\1:/", p) for p in df.inputFiles()})
    # As Arrow: rows given as a list would start Python workers of their own on every executor.
    files = df.sparkSession.createDataFrame(pa.table({path: pa.array(paths, pa.string()), file: pa.array(range(len(paths)), pa.int64())}))
    place = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(row))
    number = F.coalesce(file, F.raise_error(F.concat(F.lit("not a file of the table: "), path)).cast("bigint"))
    return (place.join(F.broadcast(files), path, "left").withColumn(name, F.shiftleft(number, 33) + F.col(row))
            .drop(path, file, row))


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]],
               schema: str, by: str = "text", max_bytes: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over slices that hold about ``max_bytes`` of column ``by``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_slices(batches, by, max_bytes):
            yield from fn(part)
    return df.mapInArrow(run, schema)


def in_slices(batches: Iterable[pa.RecordBatch], by: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``slices`` of every batch; what a slice no longer needs goes back to the system before the next."""
    for batch in batches:
        for part in slices(batch, by, max_bytes):
            yield part
            release_memory()


def release_memory() -> None:
    """Give free memory back: Spark keeps a Python worker for later tasks, of other operators too.

    Arrow's pool and the C library hold on to what was freed, and the worker would stay as large as its largest slice.
    """
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def slices(batch: pa.RecordBatch, by: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(by)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // max_bytes
    cuts = np.flatnonzero(np.diff(group)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        yield batch.slice(lo, hi - lo)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text (null: none): values and row offsets."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    values = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    real = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    if not real.all():
        kept = np.concatenate([[0], np.cumsum(real, dtype=np.int64)])
        values, offsets = values.filter(pa.array(real)), kept[offsets]
    return values, offsets


def coded_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, each word's index among them, and row offsets."""
    values, offsets = words_of(texts)
    coded = values.dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False), offsets


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the concatenated ranges ``starts[i] : starts[i] + lengths[i]``."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def per_worker(key: tuple, make: Callable):
    """What ``make`` gives, made once in a Python worker and kept for its later tasks."""
    import sys
    import types
    held = sys.modules.setdefault("_shortlist_worker", types.ModuleType("_shortlist_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]
