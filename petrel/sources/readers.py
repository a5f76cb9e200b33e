"""Readers (S1-S5).  Schemas are always given, never inferred."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrel.operators.index import dense_index
from petrel.sources.split_csv import read_split_csv

CORPUS_SCHEMA = "doc_id long, data string, category int"
STOP_SCHEMA_NAMES = ("form", "pos", "ratio")
STOP_SCHEMA_TYPES = ("string", "string", "double")

# Options shared by the CSV writer and reader so that text round-trips exactly:
# quoted multi-line fields, doubled quotes, no whitespace trimming.
CSV_OPTIONS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false", "encoding": "UTF-8"}


def spread(df: DataFrame, *key: str, min_partitions: int | None = None) -> DataFrame:
    """Hash-partition by ``key`` only when the scan yields fewer partitions than
    the cluster can run at once (e.g. a corpus stored as one row group).

    A wide input is returned unchanged, so at scale this adds no shuffle; a
    narrow one pays one shuffle of the raw rows so that the per-row text work
    runs on every core.  The explicit partition count keeps AQE from merging
    the partitions back.
    """
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *key)


def read_corpus(spark: SparkSession, path: str, schema: str = CORPUS_SCHEMA,
                null_tokens: Sequence[str] = (), split: bool = True) -> DataFrame:
    """UTF-8 CSV with a header and quoted multi-line text.

    Files are read by byte ranges (``petrel.sources.split_csv``), so one large
    file is many tasks.  ``split=False`` reads a file in one task, by Spark's
    own reader; it also takes bare quotes within unquoted fields.

    ``null_tokens`` lists strings read as null (pandas reads ``NA`` etc. as
    null; Spark keeps them as text unless told).
    """
    if split:
        df = read_split_csv(spark, path, schema, CSV_OPTIONS)
    else:
        df = (spark.read.options(**CSV_OPTIONS).option("header", "true")
              .option("multiLine", "true").option("mode", "FAILFAST").schema(schema).csv(path))
    for tok in null_tokens:
        df = df.select(*[F.when(F.col(c) == F.lit(tok), F.lit(None)).otherwise(F.col(c)).alias(c)
                         if t == "string" else F.col(c) for c, t in df.dtypes])
    return df


def read_tsv(spark: SparkSession, path: str, names: Sequence[str] = STOP_SCHEMA_NAMES,
             types: Sequence[str] = STOP_SCHEMA_TYPES) -> DataFrame:
    """Header-less TSV with supplied column names."""
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, types))
    return (spark.read.option("sep", "\t").option("header", "false")
            .option("mode", "FAILFAST").schema(schema).csv(path))


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """One token per line; id = 0-based line number across the files in name
    order; tokens stripped (S3).

    Line order comes from (file, byte offset of the split, row within the
    split); the dense numbering is distributed (no single-task window).
    """
    raw = spark.read.text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_m"))
    numbered = dense_index(raw, ["_f", "_b", "_m"], name="id")
    return numbered.select(F.trim(F.col("value")).alias("token"), F.col("id").cast("int").alias("id"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole documents, one row per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema (S4, vocabulary JSON)."""
    return spark.read.schema(schema).json(path)


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Saved arrays: parquet with array columns."""
    return spark.read.parquet(path)
