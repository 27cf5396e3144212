"""Document text → structured resume rows, as one native projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shortlist.functions import text as tx
from shortlist.schemas import RESUME_COLUMNS


LOWER_COL = "_lower_text"
SPREAD_TASKS_PER_CORE = 4


def field_columns(raw_text: Column | str, vocab: Sequence[str] = tx.SKILLS_VOCAB,
                  lowered: str | None = None) -> dict[str, Column]:
    """All extracted fields of one document.  Extraction reads the raw text;
    only ``Resume_Text`` (the embedding input) is the cleaned text."""
    raw = F.col(raw_text) if isinstance(raw_text, str) else raw_text
    return {
        "Resume_Text": tx.clean_text(raw),
        "Email": tx.extract_email(raw),
        "Phone": tx.extract_phone(raw),
        "Exp_Years": tx.extract_experience(raw),
        "Skills_List": tx.skills_joined(raw, vocab, lowered=lowered),
    }


def _already_shuffled(docs: DataFrame) -> bool:
    """True when the physical plan has an exchange (it is then adaptive).

    Asking such a plan for its partition count would run its shuffle stages
    during planning, and the query would run them again.
    """
    try:
        plan = docs._jdf.queryExecution().executedPlan()
        return plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec"
    except Exception:  # no JVM plan view (e.g. a Spark Connect session)
        return True


def spread(docs: DataFrame) -> DataFrame:
    """Give the CPU-bound extraction every core when the input has fewer splits.

    Regex extraction costs about a second per MB per core, a round-robin
    shuffle a few hundredths of that, so when the scan yields fewer
    partitions than the cluster's default parallelism (few files or row
    groups) the text is spread first.  A large input already has more
    splits than cores and is left as it is: no shuffle is added.  An input
    that already went through a shuffle is left as it is too: its partition
    count is ``spark.sql.shuffle.partitions``, sized for the cluster.
    """
    if docs.isStreaming:  # micro-batches are already spread by the member reader
        return docs
    if _already_shuffled(docs):
        return docs
    try:
        cores = docs.sparkSession.sparkContext.defaultParallelism
        splits = docs.rdd.getNumPartitions()
    except Exception:  # no RDD view (e.g. a Spark Connect session): leave the plan as it is
        return docs
    if splits < cores:
        # Several tasks per core even out documents of very different lengths.
        return docs.repartition(cores * SPREAD_TASKS_PER_CORE)
    return docs


def _gate(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """Spread if needed, length gate, then lower-case the text once for the vocabulary scan."""
    return spread(docs).where(tx.long_enough(text_col, min_chars)) \
                       .withColumn(LOWER_COL, F.lower(F.col(text_col)))


def extract_fields(docs: DataFrame, text_col: str = "raw_text", keep: Sequence[str] = (),
                   vocab: Sequence[str] = tx.SKILLS_VOCAB,
                   min_chars: int = tx.MIN_TEXT_CHARS) -> DataFrame:
    """Length-gate the documents and extract every field in one projection.

    ``keep`` columns are passed through (keys, archive, ordinal...).  The
    raw text itself is not carried forward.
    """
    fields = field_columns(text_col, vocab, lowered=LOWER_COL)
    gated = _gate(docs, text_col, min_chars)
    return gated.select(*[F.col(c) for c in keep],
                        *[expr.alias(name) for name, expr in fields.items()])


def extract_resumes(raw_docs: DataFrame, ordinal_col: str = "idx", name_col: str = "name",
                    text_col: str = "raw_text", keep: Sequence[str] = ("archive",),
                    vocab: Sequence[str] = tx.SKILLS_VOCAB,
                    min_chars: int = tx.MIN_TEXT_CHARS, observation=None) -> DataFrame:
    """Raw documents (one row per archive member) → the resume table.

    The ordinal is the member's position among selected members, numbered
    before the length gate, so identifiers may have gaps.  Columns: ``keep``
    followed by the fixed resume columns.  ``observation`` (a
    ``pyspark.sql.Observation``) receives the member count and the number of
    members that passed the length gate, gathered by the job that runs.
    """
    fields = field_columns(text_col, vocab, lowered=LOWER_COL)
    if observation is not None:
        raw_docs = raw_docs.observe(
            observation, F.count(F.lit(1)).alias("members"),
            F.count_if(tx.long_enough(text_col, min_chars)).alias("extracted"))
    gated = _gate(raw_docs, text_col, min_chars)
    return gated.select(
        *[F.col(c) for c in keep],
        tx.resume_id(ordinal_col).alias("Resume_ID"),
        tx.basename(name_col).alias("Source_File"),
        *[fields[c].alias(c) for c in RESUME_COLUMNS if c in fields],
    )


def resumes_of_archives(archives: DataFrame, extensions: Sequence[str] = tx.DEFAULT_EXTENSIONS, extractor=None,
                        partitions: int | None = None, vocab: Sequence[str] = tx.SKILLS_VOCAB) -> DataFrame:
    """Archive files (``read_archives``) → the resume table, stored once.

    Members that can't be read are left out; if none is left, reading the
    result fails with ``guards.NO_RESUMES``.
    """
    from shortlist.operators.guards import NO_RESUMES, nonempty
    from shortlist.session import materialize_if_possible
    from shortlist.sources.archives import list_members, read_members
    docs = read_members(list_members(archives, extensions), extractor=extractor, partitions=partitions)
    resumes = extract_resumes(docs.where(F.col("error").isNull()), vocab=vocab)
    return nonempty(materialize_if_possible(resumes, "resumes"), NO_RESUMES)


def extract_numbered(raw_docs: DataFrame, group: str, key: str, name_col: str = "name",
                     text_col: str = "raw_text", keep: Sequence[str] = ("archive",),
                     vocab: Sequence[str] = tx.SKILLS_VOCAB, min_chars: int = tx.MIN_TEXT_CHARS) -> DataFrame:
    """``extract_resumes`` for a document table without ordinals: each document
    is numbered by ``key`` within its ``group`` (e.g. archive), before the
    length gate, so identifiers may have gaps.

    The ordinal is computed on the (group, key) columns alone and joined back
    to the extracted rows, so the text never crosses the ordinal's shuffles,
    and extraction runs on the scan's own splits.  ``key`` must be unique
    within a group; groups may be null.
    """
    from shortlist.operators.ordinal import ordinal_within
    numbered = ordinal_within(raw_docs.select(group, key), group, key, name="_idx")
    numbered = numbered.select(F.col(group).alias("_ng"), F.col(key).alias("_nk"), "_idx")
    fields = field_columns(text_col, vocab, lowered=LOWER_COL)
    carried = list(dict.fromkeys([*keep, group, key, name_col]))
    extracted = _gate(raw_docs, text_col, min_chars).select(
        *[F.col(c) for c in carried], *[expr.alias(n) for n, expr in fields.items()])
    joined = extracted.join(numbered, extracted[group].eqNullSafe(numbered["_ng"])
                            & (extracted[key] == numbered["_nk"]))
    return joined.select(
        *[F.col(c) for c in keep],
        tx.resume_id("_idx").alias("Resume_ID"),
        tx.basename(name_col).alias("Source_File"),
        *[F.col(c) for c in RESUME_COLUMNS if c in fields],
    )


def resumes_from_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "raw_text",
                       source_col: str = "source", keep: Sequence[str] = ("doc_id",),
                       vocab: Sequence[str] = tx.SKILLS_VOCAB) -> DataFrame:
    """A document table (id, text, source) → resume table keyed by the document id.

    ``Resume_ID`` is the zero-padded document id and ``Source_File`` the
    document's source.
    """
    fields = field_columns(text_col, vocab, lowered=LOWER_COL)
    gated = _gate(docs, text_col, tx.MIN_TEXT_CHARS)
    return gated.select(
        *[F.col(c) for c in keep],
        tx.resume_id(id_col).alias("Resume_ID"),
        F.coalesce(F.col(source_col), F.lit("")).alias("Source_File"),
        *[fields[c].alias(c) for c in RESUME_COLUMNS if c in fields],
    )


def skill_matches(resumes: DataFrame, key: str, skills_col: str = "Skills_List") -> DataFrame:
    """One row per (document, skill) found: the exploded vocabulary containment."""
    return resumes.select(F.col(key), F.explode(tx.split_skill_list(skills_col)).alias("skill"))
