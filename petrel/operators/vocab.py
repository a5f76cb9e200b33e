"""Vocabulary: counts, ranks, document frequency, rare-word statistics (V1-V6).

Ordering rule of the word index: most frequent first; ties in order of first
appearance (document order, then position); index 1 is the out-of-vocabulary
entry when there is one, so words start at 2 (else at 1); 0 is padding.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from petrel.operators.index import dense_index


def explode_tokens(df: DataFrame, tokens: str, *keep: str, with_pos: bool = False) -> DataFrame:
    """One row per token (``word``, and ``pos`` if asked).

    The outer form is used on purpose: an inner explode makes the optimizer
    infer ``size(tokens) > 0`` and push it below the input exchange, which
    would evaluate the whole cleaning chain twice.  Empty arrays give one null
    row, dropped right after the generator.
    """
    if with_pos:
        ex = df.select(*keep, F.posexplode_outer(tokens).alias("pos", "word"))
    else:
        ex = df.select(*keep, F.explode_outer(tokens).alias("word"))
    return ex.where(F.col("word").isNotNull())


# First appearance (doc, pos) packed into one decimal(38,0): doc * 2^31 + pos
# preserves the (doc, pos) order for any long doc id and int position, and a
# decimal min is hash-aggregatable (a struct min would force a sort aggregate).
_POS_SPAN = 2 ** 31
_DEC = "decimal(38,0)"


def word_counts(df: DataFrame, tokens: str = "tokens", key: str = "doc_id", only: DataFrame | None = None) -> DataFrame:
    """(word, cnt, first_doc, first_pos): one hash aggregation with map-side
    partial aggregation, so Zipf-heavy words collapse before the shuffle (V1).

    ``only`` (word) counts these words alone; the caller bounds its size, as it is broadcast."""
    ex = explode_tokens(df, tokens, key, with_pos=True)
    if only is not None:
        ex = ex.join(F.broadcast(only), "word", "left_semi")
    span = F.lit(_POS_SPAN).cast(_DEC)
    first = F.col(key).cast(_DEC) * span + F.col("pos").cast(_DEC)
    return (ex.groupBy("word")
            .agg(F.count(F.lit(1)).alias("cnt"), F.min(first).alias("_first"))
            .select("word", "cnt",
                    F.floor(F.col("_first") / span).cast("long").alias("first_doc"),
                    F.pmod(F.col("_first"), span).cast("int").alias("first_pos")))


def build_vocab(counts: DataFrame, oov: bool = True) -> DataFrame:
    """(word, cnt, idx) with the index rule above (V2); no one-partition window."""
    start = 2 if oov else 1
    ranked = dense_index(counts, [F.col("cnt").desc(), F.col("first_doc").asc(),
                                  F.col("first_pos").asc()], name="idx", start=start)
    return ranked.select("word", "cnt", F.col("idx").cast("int").alias("idx"))


def top_vocab(counts: DataFrame, num_words: int, oov: bool = True) -> DataFrame:
    """(word, cnt, idx) of the indices below ``num_words`` only (V2 with V5).

    A distributed top-k (each task keeps its best), so the vocabulary is not
    sorted; the numbering window sees at most ``num_words`` rows.
    """
    start = 2 if oov else 1
    order = [F.col("cnt").desc(), F.col("first_doc").asc(), F.col("first_pos").asc()]
    top = counts.orderBy(*order).limit(max(num_words - start, 0))
    idx = F.row_number().over(Window.orderBy(*order)) + F.lit(start - 1)
    return top.select("word", "cnt", idx.cast("int").alias("idx"))


def doc_freq(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(word, doc_count): number of documents containing the word (V3)."""
    return (explode_tokens(df.select(F.array_distinct(tokens).alias("_d")), "_d")
            .groupBy("word").agg(F.count(F.lit(1)).alias("doc_count")))


def rare_stats(counts: DataFrame, threshold: int = 1) -> DataFrame:
    """One global aggregation over the counts (V4).

    Rare = count strictly below ``threshold``.  ``vocab_size`` is
    total - rare + 1 (room for padding), as the capped tokenizer is sized.
    """
    rare = F.col("cnt") < F.lit(threshold)
    agg = counts.agg(
        F.count(F.lit(1)).alias("total_cnt"),
        F.coalesce(F.sum(F.when(rare, 1).otherwise(0)), F.lit(0)).cast("long").alias("rare_cnt"),
        F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("total_freq"),
        F.coalesce(F.sum(F.when(rare, F.col("cnt")).otherwise(0)), F.lit(0)).cast("long").alias("rare_freq"),
    )
    pct = lambda a, b: F.when(F.col(b) > 0, F.col(a) * F.lit(100.0) / F.col(b))
    return agg.select(
        "total_cnt", "rare_cnt", "total_freq", "rare_freq",
        F.round(pct("rare_cnt", "total_cnt"), 6).alias("rare_cnt_pct"),
        F.round(pct("rare_freq", "total_freq"), 6).alias("rare_freq_pct"),
        (F.col("total_cnt") - F.col("rare_cnt") + F.lit(1)).alias("vocab_size"))


def cap_vocab(vocab: DataFrame, num_words: int | None) -> DataFrame:
    """Keep indices below ``num_words`` (exclusive, as the capped tokenizer) (V5)."""
    if num_words is None:
        return vocab
    return vocab.filter(F.col("idx") < F.lit(num_words))


def vocab_size(vocab: DataFrame) -> DataFrame:
    """One row with the number of entries (V6)."""
    return vocab.agg(F.count(F.lit(1)).alias("vocab_size"))
