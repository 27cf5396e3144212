"""Structured Streaming: archives dropped into a folder → the resume table.

Extraction is stateless per document, so the batch operators run unchanged
on a file stream: ``binaryFile`` lists new archives (content pruned), one
task per archive reads the ZIP directory, members are hash-spread and
decoded, and the native extraction projection writes parquet.  The sink is
exactly-once through the checkpoint location.

The quantile thresholds are global, but a ranking's state merges: scores are
rounded, so (score, count) pairs are few and add up, and the top of all is
among the tops of the batches.  ``refresh_ranking`` is a ``foreachBatch``
handler that scores the micro-batch alone, keeps its counts and its top beside
it (a repeated batch overwrites its own), and rebuilds thresholds and the top-N
table from these.  ``refresh_index`` does so for rankings by job description,
whose term weights shift with the corpus: it adds the batch to a term index and
ranks that, without reading a text again.

``start_ingest_with_errors`` opens archives once per batch and writes resumes
and what could not be read; ``error_stream`` gives the latter as a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shortlist.functions.scoring import Criteria
from shortlist.functions.text import DEFAULT_EXTENSIONS
from shortlist.operators.extract import extract_resumes
from shortlist.schemas import ARCHIVE_SCHEMA
from shortlist.session import materialize_if_possible
from shortlist.sources.archives import list_members, read_members


def archive_stream(spark: SparkSession, source_dir: str, glob: str = "*.zip",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of newly arrived archive files (path, modificationTime, length, content)."""
    reader = spark.readStream.format("binaryFile").schema(ARCHIVE_SCHEMA).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(source_dir)


def resume_stream(archives: DataFrame, extensions: Sequence[str] = DEFAULT_EXTENSIONS,
                  extractor=None, partitions: int | None = None) -> DataFrame:
    """Archive stream → stream of resume rows (archive + the fixed resume columns)."""
    members = list_members(archives, extensions)
    docs = read_members(members, extractor=extractor, partitions=partitions)
    return extract_resumes(docs.where(F.col("error").isNull()), keep=("archive",))


def error_stream(archives: DataFrame, extensions: Sequence[str] = DEFAULT_EXTENSIONS,
                 extractor=None, partitions: int | None = None) -> DataFrame:
    """(archive, idx, name, error) of archives and members that ``resume_stream`` leaves out.

    Write it with ``start_ingest`` to a folder of its own; it opens the
    archives once more than the resume stream does (``start_ingest_with_errors``
    opens them once for both).
    """
    members = list_members(archives, extensions)
    docs = read_members(members, extractor=extractor, partitions=partitions)
    return docs.where(F.col("error").isNotNull()).select("archive", "idx", "name", "error")


def start_ingest(resumes: DataFrame, output_path: str, checkpoint_location: str,
                 available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Write the resume stream as parquet, exactly once via the checkpoint."""
    writer = (resumes.writeStream.format("parquet")
              .option("path", output_path)
              .option("checkpointLocation", checkpoint_location)
              .outputMode("append"))
    if processing_time:
        writer = writer.trigger(processingTime=processing_time)
    elif available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def start_ingest_with_errors(archives: DataFrame, output_path: str, errors_path: str, checkpoint_location: str,
                             extensions: Sequence[str] = DEFAULT_EXTENSIONS, extractor=None,
                             partitions: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Write the resumes of an archive stream, and what could not be read, from one pass over the archives.

    Each batch's members are stored once; both outputs are read from there and
    go to the partition ``ingest_batch=<id>`` of their folders, so a repeated
    batch replaces its own rows.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        members = list_members(batch, extensions)
        docs = materialize_if_possible(read_members(members, extractor=extractor, partitions=partitions), "members")
        _write_batch(extract_resumes(docs.where(F.col("error").isNull()), keep=("archive",)), output_path, batch_id)
        _write_batch(docs.where(F.col("error").isNotNull()).select("archive", "idx", "name", "error"), errors_path, batch_id)
    return _start(archives, handle, checkpoint_location, available_now)


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/ingest_batch={int(batch_id)}")


def _start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint_location: str,
           available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_location)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def refresh_ranking(table_path: str, top_path: str, criteria: Criteria,
                    semantic_for: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` handler: score and store the batch, merge its counts and top into the ranking.

    The batch goes to the partition ``ingest_batch=<id>`` of the table, its
    (score, count) pairs and its top rows to the same partition of
    ``<top_path>_state``; the merged top-N table is written to ``top_path``.  A
    batch reads itself and the state only, and one that Spark repeats after a
    failure replaces its own part.

    ``semantic_for(resumes)`` returns (archive, Resume_ID, Semantic_Score) for
    the given resumes — e.g. a lookup in the embedding cache after embedding
    the unseen texts.  The criteria and the encoder must stay the same; with
    others start with new paths.
    """
    from shortlist.operators import rank as rk
    state = f"{top_path.rstrip('/')}_state"

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _write_batch(batch, table_path, batch_id)
        rows = spark.read.parquet(f"{table_path.rstrip('/')}/ingest_batch={int(batch_id)}")
        scored = materialize_if_possible(rk.score(rows, semantic_for(rows), criteria, ["archive", "Resume_ID"]), "scored")
        _write_batch(rk.score_counts(scored), f"{state}/counts", batch_id)
        _write_batch(rk.top_candidates(scored, criteria.top_n), f"{state}/top", batch_id)
        counts = spark.read.parquet(f"{state}/counts")
        best = rk.top_candidates(spark.read.parquet(f"{state}/top"), criteria.top_n)
        rk.records(rk.with_labels(best, rk.thresholds_of(counts))).withColumn("batch_id", F.lit(int(batch_id))) \
            .write.mode("overwrite").parquet(top_path)

    return handle


def refresh_index(index_path: str, top_path: str, criteria: Criteria) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` handler: add the batch to a term index, rank by the job description, write top-N.

    Texts are read once, when their batch comes in; a repeated batch replaces itself.
    """
    from shortlist.operators.rank import rank_index
    from shortlist.operators.terms import open_index, write_batch

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, index_path, batch_id)
        result = rank_index(open_index(batch.sparkSession, index_path), criteria)
        result.top_records().withColumn("batch_id", F.lit(int(batch_id))).write.mode("overwrite").parquet(top_path)

    return handle


def start_ranked_ingest(resumes: DataFrame, table_path: str, top_path: str, checkpoint_location: str,
                        criteria: Criteria, semantic_for: Callable[[DataFrame], DataFrame],
                        available_now: bool = True) -> StreamingQuery:
    """Ingest with a ranking refresh after every micro-batch."""
    return _start(resumes, refresh_ranking(table_path, top_path, criteria, semantic_for), checkpoint_location, available_now)


def start_indexed_ingest(resumes: DataFrame, index_path: str, top_path: str, checkpoint_location: str,
                         criteria: Criteria, available_now: bool = True) -> StreamingQuery:
    """Ingest into a term index with a ranking by job description after every micro-batch."""
    return _start(resumes, refresh_index(index_path, top_path, criteria), checkpoint_location, available_now)
