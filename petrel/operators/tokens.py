"""Word tokens and stop words."""
from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrel.functions import arrays as A
from petrel.functions import text as T
from petrel.operators.vocab import explode_tokens

# --- fixed values -----------------------------------------------------------------
# Short stop list of the first baseline.
SHORT_STOP_WORDS = ["의", "가", "이", "은", "들", "는", "좀", "잘", "걍", "과", "도", "를",
                    "으로", "자", "에", "와", "한", "하다", "을"]
# Entries appended to the stop table (its rows 100 and 101).
EXTRA_STOP_WORDS = ["가", "합니다"]
# ----------------------------------------------------------------------------------


def tokenize(df: DataFrame, col: str, out: str = "tokens", pattern: str = T.WS) -> DataFrame:
    """Text -> word list by a separator pattern, empties dropped."""
    return df.withColumn(out, A.tokenize(F.col(col), pattern))


def corpus_tokens(df: DataFrame, text: str = "text", out: str = "tokens",
                  stop: Iterable[str] | DataFrame | None = None, min_chars: int = 1,
                  newline_repl: str = " ", key: str = "doc_id") -> DataFrame:
    """Cleaning chain + tokenisation + stop words + length filter in one projection.

    With the default blank for the literal newline the fused form of the chain
    is used (see ``corpus_words_text``); it yields the same words.
    """
    if newline_repl == " ":
        words = A.tokenize(T.corpus_words_text(F.col(text)), T.CORPUS_SEPARATORS)
    else:
        words = A.tokenize(T.corpus_text(F.col(text), newline_repl))
    toks = df.withColumn(out, words)
    if stop is not None:
        toks = remove_stop(toks, out, stop, key=key)
    if min_chars:
        toks = toks.withColumn(out, A.min_len(out, min_chars))
    return toks


#: Stop words of a table that are listed by name.
LISTED = 1_000
#: Bits of the Bloom filter per stop word, and at most; stop-like words that are told apart by name.
BLOOM_BITS, BLOOM_MOST, FALSE_HITS = 16, 1 << 23, 2_000


def remove_stop(df: DataFrame, tokens: str, stop: Iterable[str] | DataFrame,
                key: str = "doc_id", form: str = "form") -> DataFrame:
    """Remove stop words keeping order and repeats.

    A literal list becomes a hashed ``InSet`` inside one projection, and so does
    a stop table of up to ``LISTED`` words.  A larger one of whatever size becomes a Bloom filter of bounded size.  The words
    of the corpus that pass it are the stop words and a few others; these
    others are found by one distinct and one anti join, and kept by name.  So
    no row of ``df`` leaves its task; only distinct words that pass are
    shuffled.  If too many others pass (``FALSE_HITS``), rows go through an
    exact join (``remove_stop_join``).  A null array stays null.
    """
    if not isinstance(stop, DataFrame):
        return df.withColumn(tokens, A.drop_listed(tokens, stop))
    words = stop.select(F.col(form).alias("_w")).where(F.col("_w").isNotNull()).distinct().checkpoint()
    listed = words.limit(LISTED + 1).collect()
    if not listed:
        return df
    if len(listed) <= LISTED:
        return df.withColumn(tokens, A.drop_listed(tokens, [r["_w"] for r in listed]))
    filter_ = bloom(words)
    hit = filter_.may_hold
    passing = explode_tokens(df.select(F.filter(tokens, hit).alias("_p")), "_p").distinct()
    others = passing.join(words, passing["word"] == words["_w"], "left_anti").limit(FALSE_HITS + 1).collect()
    if len(others) > FALSE_HITS:
        return remove_stop_join(df, tokens, words, key)
    keep = [r["word"] for r in others]
    return df.withColumn(tokens, F.filter(tokens, lambda t: t.isNotNull() & (~hit(t) | t.isin(keep) if keep else ~hit(t))))


class Bloom(NamedTuple):
    """A Bloom filter as a constant column: 64 bits a number, two places a word."""
    bits: Column
    size: int

    def places(self, word: Column) -> list[Column]:
        h = F.xxhash64(word)
        return [F.pmod(x, F.lit(self.size)) for x in (h, F.shiftright(h, 24))]

    def may_hold(self, word: Column) -> Column:
        """Always true for a word of the table."""
        one, two = [F.getbit(F.get(self.bits, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1
                    for p in self.places(word)]
        return one & two


def bloom(words: DataFrame) -> Bloom | None:
    """The filter of a table's words (_w); None without words."""
    n = words.count()
    if not n:
        return None
    size = 1 << max(10, min(BLOOM_MOST, BLOOM_BITS * n).bit_length())
    places = words.select(F.explode(F.array(*Bloom(F.lit(None), size).places(F.col("_w")))).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))
    rows = places.groupBy(F.shiftright("p", 6).alias("i")).agg(F.bit_or(bit).alias("b")).collect()
    slots = [0] * (size // 64)
    for r in rows:                              # bounded by BLOOM_MOST bits
        slots[r["i"]] = r["b"]
    # as text, a constant of any size is one literal
    return Bloom(F.split(F.lit(",".join(map(str, slots))), ",").cast("array<long>"), size)


def remove_stop_join(df: DataFrame, tokens: str, words: DataFrame, key: str = "doc_id") -> DataFrame:
    """``remove_stop`` by an exact join with ``words`` (_w): tokens are exploded, marked and regrouped per document;
    Spark broadcasts the table if it is small.  ``key`` must be unique (the job fails if it is not)."""
    exploded = df.select(key, F.size(tokens).alias("_n"), F.posexplode_outer(tokens).alias("_pos", "_tok"))
    marked = exploded.join(words.withColumn("_stop", F.lit(True)), exploded["_tok"] == words["_w"], "left")
    kept = F.when(F.col("_tok").isNotNull() & F.col("_stop").isNull(), F.struct(F.col("_pos"), F.col("_tok")))
    regrouped = marked.groupBy(key).agg(
        F.array_sort(F.collect_list(kept)).alias("_kept"), A.check_unique(key, F.count("_pos"), F.max("_n")).alias("_one"))
    rest = df.withColumn("_null", F.col(tokens).isNull()).drop(tokens)
    words_left = F.transform(F.coalesce("_kept", F.array()), lambda s: s["_tok"])
    return (rest.join(regrouped, rest[key].eqNullSafe(regrouped[key]), "left").drop(regrouped[key])
            .where(F.coalesce("_one", F.lit(True)))
            .withColumn(tokens, F.when(~F.col("_null"), words_left)).select(*df.columns))


def build_stop(base: DataFrame, extra: Iterable[str] = EXTRA_STOP_WORDS,
               form: str = "form") -> DataFrame:
    """Stop table: the ``form`` column of ``base`` plus ``extra``, distinct (T4)."""
    spark = base.sparkSession
    more = spark.createDataFrame([(w,) for w in extra], f"{form} string")
    return base.select(form).unionByName(more).distinct()
