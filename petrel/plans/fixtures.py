"""Stand-in inputs derived by Spark from the given tables.

The reference reads petitions, a stop-word file and a broker feed that are not
shipped; these functions derive equivalents from the test tables, so all work
grows with them:

* corpus   = ``documents`` (doc_id, text); class = rank of ``lang``
* labelled = semi join with ``labels``; unlabelled = anti join
* stop table = most frequent words of ``benchmark`` + the extra entries
* predictions of model m = softmax of ``embeddings.embedding[3m .. 3m+2]``
* securities = ``customer``; ticks = ``events`` (code = user id, price = value)
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrel.functions import arrays as A
from petrel.operators import bars as B
from petrel.operators import tokens as T
from petrel.operators import vocab as V
from petrel.operators.index import dense_index
from petrel.sources.readers import spread

STOP_TOP = 20          # stop table = this many most frequent benchmark words
NUM_WORDS = 5000       # vocabulary cap (exclusive index bound)
N_MODELS = 4           # pseudo-models in the ensemble
N_CLASSES = 3          # classes per pseudo-model
FEW_CATEGORIES = 50_000   # languages up to this number are broadcast
SPECIALS = ["[UNK]", "[PAD]", "[CLS]", "[SEP]", "[MASK]"]  # fixed: sub-word vocab head


# Text tables: per-row work is heavy, so they are spread by key when the scan
# is narrower than the cluster (see ``petrel.sources.readers.spread``).
TEXT_KEYS = {"documents": ["doc_id"], "pages": ["page_id"], "conversations": ["conv_id", "turn"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    key = TEXT_KEYS.get(name)
    return spread(df, *key) if key else df


def _benchmark_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = T.corpus_tokens(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"))
    return V.word_counts(bench)


def _top(counts: DataFrame, n: int) -> DataFrame:
    return counts.orderBy(F.col("cnt").desc(), F.col("word").asc()).limit(n)


def stop_table(spark: SparkSession, sf_dir: str, n: int = STOP_TOP) -> DataFrame:
    """(form, pos, ratio): the n most frequent benchmark words, ties by word."""
    counts = _benchmark_counts(spark, sf_dir)
    total = counts.select(F.sum("cnt")).scalar()
    return _top(counts, n).select(F.col("word").alias("form"), F.lit("NNG").alias("pos"),
                                  F.round(F.col("cnt") / total, 6).alias("ratio"))


def stop_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.build_stop(stop_table(spark, sf_dir))


def stop_list(spark: SparkSession, sf_dir: str) -> list[str]:
    """The stop words as a list, by one top-k job: at most ``STOP_TOP`` words and the extra entries."""
    words = [r["word"] for r in _top(_benchmark_counts(spark, sf_dir), STOP_TOP).select("word").collect()]
    return list(dict.fromkeys([*words, *T.EXTRA_STOP_WORDS]))


def doc_tokens(spark: SparkSession, sf_dir: str, stop: bool = True,
               part: Callable[[SparkSession, DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """(doc_id, lang, tokens) after the full cleaning chain.

    ``part``: ``labelled`` or ``unlabelled``, chosen before the cleaning, which Spark would do for all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = part(spark, docs, sf_dir) if part else docs
    toks = T.corpus_tokens(docs, stop=stop_list(spark, sf_dir) if stop else None)
    return toks.drop("text")


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, category): the 0-based rank of each language; null is no language."""
    langs = table(spark, sf_dir, "documents").select("lang").where(F.col("lang").isNotNull()).distinct()
    return dense_index(langs, ["lang"], name="category").select("lang", F.col("category").cast("int"))


def with_category(spark: SparkSession, df: DataFrame, sf_dir: str) -> DataFrame:
    """Attach ``category``; null for documents without a language.

    A few languages name all documents, so a shuffle by language would fill a
    few tasks: the languages are broadcast unless there are very many."""
    known = categories(spark, sf_dir)
    if known.limit(FEW_CATEGORIES + 1).count() > FEW_CATEGORIES:
        return df.join(known, "lang", "left")
    return df.join(F.broadcast(known), "lang", "left")


def labelled(spark: SparkSession, df: DataFrame, sf_dir: str) -> DataFrame:
    return df.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")


def unlabelled(spark: SparkSession, df: DataFrame, sf_dir: str) -> DataFrame:
    return df.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def train_vocab(spark: SparkSession, sf_dir: str, oov: bool = True) -> DataFrame:
    """Whole vocabulary fitted on the labelled documents."""
    return V.build_vocab(V.word_counts(doc_tokens(spark, sf_dir, part=labelled)), oov=oov)


def capped_vocab(spark: SparkSession, sf_dir: str, oov: bool = True) -> DataFrame:
    """Its indices below ``NUM_WORDS`` only."""
    return V.top_vocab(V.word_counts(doc_tokens(spark, sf_dir, part=labelled)), NUM_WORDS, oov=oov)


def piece_vocab(spark: SparkSession, vocab: DataFrame, num_words: int = NUM_WORDS) -> DataFrame:
    """(token, id): the special tokens, then the capped words in index order."""
    specials = spark.createDataFrame([(t, i) for i, t in enumerate(SPECIALS)], "token string, id int")
    words = (vocab.filter(F.col("idx") < F.lit(num_words))
             .select(F.col("word").alias("token"),
                     (F.col("idx") - F.lit(2) + F.lit(len(SPECIALS))).cast("int").alias("id")))
    return specials.unionByName(words)


def pseudo_predictions(spark: SparkSession, sf_dir: str, n_models: int = N_MODELS,
                       k: int = N_CLASSES) -> DataFrame:
    """(doc_id, model, probs, target): model m = softmax of dims [k*m, k*m+k)."""
    emb = table(spark, sf_dir, "embeddings")
    models = F.explode(F.sequence(F.lit(0), F.lit(n_models - 1))).alias("model")
    rows = emb.select(F.col("vec_id").alias("doc_id"), "embedding", "label", models)
    sl = F.slice("embedding", F.col("model") * F.lit(k) + F.lit(1), F.lit(k))
    probs = F.transform(A.softmax(sl), lambda p: F.round(p, 6))
    return rows.select("doc_id", F.col("model").cast("int").alias("model"), probs.alias("probs"),
                       (F.col("label") % F.lit(k)).cast("int").alias("target"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(B.as_code("user_id").alias("code"), "ts", F.col("value").alias("price"), "event_id")


def daily_bar_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.build_daily_bars(ticks(spark, sf_dir), tiebreak="event_id")


def security_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(B.as_code("c_custkey").alias("code"), F.col("c_name").alias("name"),
                    F.col("c_mktsegment").alias("market"), "c_nationkey", "c_acctbal")
