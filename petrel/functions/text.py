"""Column functions for text cleaning (JVM-side regex, stays in codegen).

Python's ``\\s`` and ``\\d`` are Unicode-aware; Java's are ASCII.  The classes
below spell the Unicode sets out so that Java regex (Spark), RE2 (the DuckDB
oracle) and Python ``re`` agree.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference's rules) -------------------------
# Hangul whitelist: jamo consonants, jamo vowels, syllables, blank.
HANGUL_WHITELIST = "[^ㄱ-ㅎㅏ-ㅣ가-힣 ]"
# Punctuation class of the (dead) first step of the normalising chain.
PUNCT_CLASS = r"[@%\\*=()/~#&\+á?\xc3\xa1\-\|\.\:\;\!\-\,\_\~\$\'\"]"
# Symbols replaced by a blank after the normalising chain.
SYMBOL_CLASS = "[-=+,#:;//●<>▲\\?:^$.☆!★()Ⅰ@*\"※~>`'…》]"
# Two-character literal backslash-n left in the raw text.
LITERAL_NEWLINE = "\\n"
# Quote normalisation: two backticks and two apostrophes become one double quote.
QUOTE_PAIRS = ("``", "''")
# ------------------------------------------------------------------------------

# Unicode whitespace as Python's str.isspace() sees it.
WS = r"[\s\p{Z}\x1c-\x1f\x85\x0b]+"
DIGITS = r"\p{Nd}+"
TAGS = r"<[^>]+>"


def keep_chars(col: Column | str, negated_class: str = HANGUL_WHITELIST) -> Column:
    """Delete every character matched by ``negated_class``."""
    return F.regexp_replace(_c(col), negated_class, "")


def clean_text(col: Column | str, strip_punct_first: bool = False) -> Column:
    """Normalising chain (C3): digits -> lower -> collapse ws -> drop tags ->
    collapse ws -> trim.  ``strip_punct_first`` applies C4 before the chain
    (off by default: in the reference that step's result is discarded)."""
    c = _c(col)
    if strip_punct_first:
        c = strip_punct(c)
    c = F.regexp_replace(c, DIGITS, "")
    c = F.lower(c)
    c = F.regexp_replace(c, WS, " ")
    c = F.regexp_replace(c, TAGS, "")
    c = F.regexp_replace(c, WS, " ")
    # only U+0020 can be left at the ends after the collapse
    return F.btrim(c, F.lit(" "))


def strip_punct(col: Column | str) -> Column:
    """Remove the punctuation class (C4)."""
    return F.regexp_replace(_c(col), PUNCT_CLASS, "")


def strip_literal_newline(col: Column | str, repl: str = " ") -> Column:
    """Replace the two-character sequence backslash-n, no regex."""
    return F.replace(_c(col), F.lit(LITERAL_NEWLINE), F.lit(repl))


def symbols_to_space(col: Column | str, symbol_class: str = SYMBOL_CLASS) -> Column:
    """Replace each listed symbol by one blank; no trim afterwards."""
    return F.regexp_replace(_c(col), symbol_class, " ")


def squeeze_space(col: Column | str) -> Column:
    """Collapse Unicode whitespace runs to one blank and trim."""
    return F.btrim(F.regexp_replace(_c(col), WS, " "), F.lit(" "))


def norm_quotes(col: Column | str) -> Column:
    """Two backticks, then two apostrophes, become a double quote."""
    c = _c(col)
    for pair in QUOTE_PAIRS:
        c = F.replace(c, F.lit(pair), F.lit('"'))
    return c


def lower(col: Column | str) -> Column:
    """Lower-casing."""
    return F.lower(_c(col))


def corpus_text(col: Column | str, newline_repl: str = " ") -> Column:
    """The full cleaning used before word tokenisation: C3 -> C5 -> C6."""
    return symbols_to_space(strip_literal_newline(clean_text(col), newline_repl))


# Word separators of the cleaned corpus: whitespace, the symbol class, and the
# literal backslash-n (which C5 turns into a blank).
# One class and one loop: an alternative per character would cost a step of the
# stack for each of them.
CORPUS_SEPARATORS = "(?:" + SYMBOL_CLASS[:-1] + WS[1:] + "|" + "\\\\n" + ")+"


def corpus_words_text(col: Column | str) -> Column:
    """The part of C3 -> C5 -> C6 that changes word boundaries: digits removed,
    lower-cased, tags removed.  Splitting this on ``CORPUS_SEPARATORS`` gives
    the same words as splitting ``corpus_text`` on whitespace (the blank
    collapses and trims of C3 only move separators), in three regex passes
    instead of six."""
    c = F.regexp_replace(_c(col), DIGITS, "")
    return F.regexp_replace(F.lower(c), TAGS, "")


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col
