"""Frequent words: exact hot words for joins, and Misra-Gries summaries for capped vocabularies.

``top_vocab_bounded`` finds the most frequent words without shuffling the whole
vocabulary.  Every task keeps a bounded number of counters: when there are too
many words, the count of the first word too many is taken off all of them, and
added to what the task may have missed.  Summed over the tasks, a word's
counter is at most its count, and at least its count less the total E missed.
With L the counter of the K-th word, each of the K most frequent words occurs
L times at least; so if L > E it has a counter of L - E at least, and only the
words with such counters are counted again, exactly.  If L <= E nothing is
proved, and all words are counted.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrel.operators.vocab import explode_tokens, top_vocab, word_counts
from petrel.session import ensure_checkpoint_dir, ship_package

#: A word is hot if it makes up more than this share of an even shuffle partition.
HOT_SHARE = 0.25
#: Counters of a task, per word asked for.
COUNTERS = 8


def hot_words(df: DataFrame, tokens: str) -> DataFrame:
    """(word): elements that hold more than ``HOT_SHARE`` of what one of the shuffle partitions gets on average.

    Counted on the map side first; there are at most partitions / HOT_SHARE of them, null not among them."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = explode_tokens(df, tokens).groupBy("word").agg(F.count(F.lit(1)).alias("cnt")).checkpoint()
    total = counts.agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]
    return counts.where(F.col("cnt") > F.lit(total * HOT_SHARE / tasks)).select("word")


def _summary(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        missed = 0
        for batch in batches:
            found = pc.value_counts(batch.column(0).flatten())
            for word, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
                if word is not None:
                    held[word] = held.get(word, 0) + n
            if len(held) > counters:
                off = sorted(held.values(), reverse=True)[counters]
                missed += off
                held = {w: n - off for w, n in held.items() if n > off}
        yield pa.RecordBatch.from_arrays([pa.array([None, *held], pa.string()), pa.array([missed, *held.values()], pa.int64())],
                                         ["word", "cnt"])
    return run


def summaries(df: DataFrame, tokens: str, counters: int) -> DataFrame:
    """(word, cnt): a task's counters, and with a null word what it may have missed of any word."""
    ship_package(df.sparkSession)
    return df.select(tokens).mapInArrow(_summary(counters), "word string, cnt long")


def top_vocab_bounded(df: DataFrame, num_words: int, oov: bool = True, tokens: str = "tokens", key: str = "doc_id",
                      counters: int | None = None) -> DataFrame:
    """(word, cnt, idx) of the indices below ``num_words``, as ``top_vocab(word_counts(df), num_words)`` (V2 with V5).

    What is shuffled has ``counters`` rows a task at most, in both passes, unless the summaries prove nothing;
    then all words are counted.  ``df`` is read twice."""
    ensure_checkpoint_dir(df.sparkSession)
    want = num_words - (2 if oov else 1)
    if want <= 0:
        return top_vocab(word_counts(df, tokens, key), num_words, oov)
    candidates = frequent(df, want, tokens, counters or COUNTERS * num_words)
    if candidates is None:
        return top_vocab(word_counts(df, tokens, key), num_words, oov)
    return top_vocab(word_counts(df, tokens, key, only=candidates), num_words, oov)


def frequent(df: DataFrame, want: int, tokens: str, counters: int) -> DataFrame | None:
    """(word): a few words among which the ``want`` most frequent ones are; None if the summaries do not prove it."""
    found = summaries(df, tokens, counters).checkpoint()
    missed = found.where("word is null").agg(F.sum("cnt")).first()[0] or 0
    merged = found.where("word is not null").groupBy("word").agg(F.sum("cnt").alias("cnt")).checkpoint()
    head = merged.orderBy(F.desc("cnt")).limit(want).agg(F.count(F.lit(1)), F.min("cnt")).first()
    least = head[1] if head[0] == want else 0
    if missed and least <= missed:
        return None
    few = merged.where(F.col("cnt") >= F.lit(least - missed)).select("word")
    return few if few.count() <= counters else None
