"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept.

1. quality: documents that the quality classifier rejects (junk or toxic) go.
2. near_copies: of each group of near copies (five-word shingles, Jaccard
   similarity of 0.75 or more) the document with the smallest id stays.
   Documents without an id stay: nothing names them.
3. repeats: bytes that a 50-byte string covers which also starts in a document
   with a smaller id are removed.  A character that loses a part of its bytes
   goes whole.  Documents that lose all their text go; empty ones stay.
4. mixture: documents are taken to target weights over domain, language and
   source, each at most once; the last one of a source may be cut after a token.
5. encode: the texts as ids of a byte-level BPE.

All but the last return the columns of ``documents``; ``n_chars`` is the
length of the text as it then is.  A stage's result is written as Parquet and
read again as the next one's ``docs``.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrel.llm import bpe, mixing, ngram_join, quality, suffix_dedup
from petrel.llm.queries import LEVELS, WEIGHTS, with_domain
from petrel.llm.runtime import drop, fresh, setup, stored, table

#: Share of the remaining tokens that the mixture takes.
MIXTURE = (4, 5)


def columns(docs: DataFrame) -> list:
    """The columns of ``docs`` by name, whatever characters the names hold."""
    return [F.col(f"`{c}`") for c in docs.columns]


def with_length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    setup(spark)
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    setup(spark)
    groups = ngram_join.near_copies(docs)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*columns(docs))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are matched by id and text; equal ones lose the same bytes.

    What is stored and matched is where the bytes go, not the texts that are left."""
    setup(spark)
    key, text_hash, spans = fresh(docs, "repeat_id", "repeat_hash", "repeat_spans")
    done = suffix_dedup.remove_repeats(docs, with_text=False, with_spans=True)
    changed = stored(done.where("spans is not null").select(
        F.col("doc_id").alias(key), F.col("text_hash").alias(text_hash), F.col("spans").alias(spans))
        .dropDuplicates([key, text_hash]), "spans-removed")
    drop(done)
    rows = docs.join(changed, F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(text_hash)), "left")
    rows = suffix_dedup.cut_spans(rows.select(*columns(docs), spans), "text", spans)
    return with_length(rows.where(F.col(spans).isNull() | (F.col("text") != ""))).select(*columns(docs))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    setup(spark)
    domain, = fresh(docs, "mix_domain")
    rows, weights = with_domain(docs, domain), WEIGHTS | {domain: WEIGHTS["domain"]}
    taken = mixing.mix_sources(rows, [domain, *LEVELS[1:]], weights, MIXTURE, seed=11, max_epochs=1)
    return with_length(mixing.take_documents(rows, taken)).select(*columns(docs))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    setup(spark)
    done = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
                      keep=["doc_id", "lang", "source"])
    return done.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality_stage), ("near_copies", near_copies_stage), ("repeats", repeats_stage),
          ("mixture", mixture_stage), ("encode", encode_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs


#: SQL cannot express the classifier's fit or the merges of the last stage; tests hold each stage
#: against a brute-force version on a small table with awkward rows.
ORACLE_SQL = None

PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_SQL: dict[str, str] = {}
