"""The registered queries: each operator over its whole table, with production parameters."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrel.llm import (ann, bpe, embedding_dedup, hard_negatives, html_text, mixing, ngram_join, periodic, quality,
                        secret_scan, suffix_dedup, token_files, warc)
from petrel.llm.runtime import setup, table


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    setup(spark)
    folder = token_files.token_folder(spark)
    token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
                             folder, end_id=2)
    return token_files.checksums(spark, folder)


#: Sources lie in domains by the remainder of their number; weights of the tree's levels.
DOMAINS = 4
LEVELS = ["domain", "lang", "source"]
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}


def with_domain(docs: DataFrame, name: str = "domain") -> DataFrame:
    number = F.try_to_number(F.regexp_extract("source", "([0-9]+)", 1), F.lit("999999999")).cast("long")
    return docs.withColumn(name, F.concat(F.lit("d"), (F.coalesce(number, F.lit(0)) % DOMAINS).cast("string")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_domain(table(spark, sf_dir, "documents"))
    return mixing.mix_sources(docs, LEVELS, WEIGHTS, share=(3, 5), seed=11, max_epochs=4).drop("row_hash")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
                      public_tokenizers.PATTERN, decoded="decoded", keep=["doc_id"])
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    setup(spark)
    folder = warc.archive_folder(spark)
    pages = table(spark, sf_dir, "pages")
    warc.write_archive(pages, folder)
    return warc.look_up(pages, folder, with_payload=False).drop("payload")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


def with_repeats(docs: DataFrame) -> DataFrame:
    """``documents`` in which the text of each tenth one goes on periodically from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", (h % 10 == 0).alias("chosen"), F.floor(h / 10).cast("int").alias("g"))
    rows = rows.withColumn("w", F.when(F.col("chosen"), F.regexp_extract_all("text", F.lit(periodic.WORD), F.lit(0))))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int"))
    rest = F.col("n") - F.col("a")
    block = F.slice("w", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(block, F.ceil(rest / F.col("p")).cast("int"))), F.lit(1), rest)
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(with_repeats(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                               r["period"].cast("string")), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(lines, "").alias("lines"),
                        "collapsed")
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
                       F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
                       F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secret_scan.BASE_RULES + secret_scan.MORE_RULES
    found = secret_scan.scan(table(spark, sf_dir, "documents"), rules)
    base = found.withColumn("base", F.filter("spans", lambda s: s["kind"] < len(secret_scan.BASE_RULES)))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{r.kind}")
              for i, r in enumerate(secret_scan.BASE_RULES)]
    return base.select("doc_id", *counts, F.sha2(secret_scan.listed(F.col("base"), rules), 256).alias("base_sha256"),
                       secret_scan.listed(F.col("spans"), rules).alias("spans"))


QUERIES = {f.__name__: f for f in (
    op1_token_files, op2_mixing, op3_embedding_dedup, op4_suffix_dedup, op5_ngram_join, op6_byte_bpe, op7_warc, op8_ann,
    op9_quality, op10_html_text, op11_hard_negatives, op12_periodic_runs, op13_secret_scan)}
