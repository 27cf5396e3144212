"""Fixed schemas of the tables the library reads and writes."""

from pyspark.sql import types as T

# One row per archive file, as the ``binaryFile`` source produces it.
ARCHIVE_SCHEMA = T.StructType([
    T.StructField("path", T.StringType(), False),
    T.StructField("modificationTime", T.TimestampType(), True),
    T.StructField("length", T.LongType(), True),
    T.StructField("content", T.BinaryType(), True),
])

# One row per archive member that passed the entry filter.
ENTRY_SCHEMA = T.StructType([
    T.StructField("archive", T.StringType(), False),
    T.StructField("idx", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("content", T.BinaryType(), True),
    T.StructField("error", T.StringType(), True),
])

# Entries after text extraction.
RAW_DOCUMENT_SCHEMA = T.StructType([
    T.StructField("archive", T.StringType(), False),
    T.StructField("idx", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("raw_text", T.StringType(), True),
    T.StructField("error", T.StringType(), True),
])

# The extracted resume table; no column is ever null.
RESUME_SCHEMA = T.StructType([
    T.StructField("Resume_ID", T.StringType(), False),
    T.StructField("Source_File", T.StringType(), False),
    T.StructField("Resume_Text", T.StringType(), False),
    T.StructField("Email", T.StringType(), False),
    T.StructField("Phone", T.StringType(), False),
    T.StructField("Exp_Years", T.LongType(), False),
    T.StructField("Skills_List", T.StringType(), False),
])

RESUME_COLUMNS = [f.name for f in RESUME_SCHEMA.fields]

# The ten columns of every ranked record, in output order.
RECORD_COLUMNS = [
    "Resume_ID", "Source_File", "Email", "Phone",
    "Final_Score", "Semantic_Score", "Exp_Years",
    "Skills_List", "Label", "Reason",
]

SUMMARY_SCHEMA = T.StructType([
    T.StructField("total", T.LongType(), False),
    T.StructField("eligible", T.LongType(), False),
    T.StructField("returned_top", T.LongType(), False),
])

METRICS_SCHEMA = T.StructType([
    T.StructField("accuracy", T.DoubleType(), True),
    T.StructField("macro_precision", T.DoubleType(), True),
    T.StructField("macro_recall", T.DoubleType(), True),
    T.StructField("macro_f1", T.DoubleType(), True),
])
