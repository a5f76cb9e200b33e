"""Accent stripping (C9): NFKD decomposition, combining marks dropped, as column expressions.

Spark has no Unicode normalisation function.  Decomposition works character by
character, and the reordering that follows it concerns combining marks alone,
which are dropped; so a table of characters does it.  The table is derived from
Python's Unicode data when an expression is built.  Characters that become one
other character or none are a ``translate``; those that become several, and
Hangul syllables, which are composed by a rule, are looked up one by one, in
texts that hold any.
"""
from __future__ import annotations

import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from petrel.functions import text as T

# --- fixed values: how Unicode composes Hangul syllables -----------------------------
SYLLABLES, LAST = 0xAC00, 0xD7A3                  # first and last syllable
LEADS, VOWELS, TAILS = 0x1100, 0x1161, 0x11A7     # first lead, first vowel, the place before the first tail
N_VOWELS, N_TAILS = 21, 28
# -------------------------------------------------------------------------------------


def stripped(s: str) -> str:
    """The rule in Python: what the table is made from."""
    return "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch))


@cache
def _table() -> tuple[str, str, str, tuple[str, ...]]:
    """(characters that become one or none, what they become, characters that become several, what they become)."""
    one, none, several = {}, [], {}
    for code in range(0x80, sys.maxunicode + 1):
        if SYLLABLES <= code <= LAST or 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        out = stripped(ch)
        if out == ch:
            continue
        if not out:
            none.append(ch)
        elif len(out) == 1:
            one[ch] = out
        else:
            several[ch] = out
    return "".join([*one, *none]), "".join(one.values()), "".join(several), tuple(several.values())


def _hangul(ch: Column) -> Column:
    """A syllable as lead, vowel and tail."""
    n = F.ascii(ch) - F.lit(SYLLABLES)

    def jamo(first: int, count: int, at: Column) -> Column:
        return F.substring(F.lit("".join(chr(first + i) for i in range(count))), at + F.lit(1), F.lit(1))

    lead = jamo(LEADS, 19, F.floor(n / (N_VOWELS * N_TAILS)).cast("int"))
    vowel = jamo(VOWELS, N_VOWELS, F.floor((n % (N_VOWELS * N_TAILS)) / N_TAILS).cast("int"))
    tail = F.when(n % N_TAILS > 0, jamo(TAILS, N_TAILS, (n % N_TAILS).cast("int"))).otherwise(F.lit(""))
    return F.concat(lead, vowel, tail)


def strip_accents(col: Column | str, keep_accents: bool = False) -> Column:
    """NFKD + drop combining marks; identity when ``keep_accents``.

    Plain ASCII has nothing to strip and is left as it is."""
    c = F.col(col) if isinstance(col, str) else col
    if keep_accents:
        return c
    ones, become, several, parts = _table()
    table = F.split(F.lit("\0".join(parts)), "\0")         # folded to a constant

    def one_by_one(ch: Column) -> Column:
        at = F.instr(F.lit(several), ch)
        return (F.when(ch.between(chr(SYLLABLES), chr(LAST)), _hangul(ch))
                .when((ch > F.lit("\x7f")) & (at > 0), F.element_at(table, at)).otherwise(ch))

    spread = F.array_join(F.transform(F.split(c, ""), one_by_one), "")
    any_of = c.rlike(f"[{chr(SYLLABLES)}-{chr(LAST)}]") | (F.translate(c, several, "") != c)
    whole = F.when(any_of, spread).otherwise(c)
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.translate(whole, ones, become)).otherwise(c)


def piece_text(col: Column | str, lower: bool = False, keep_accents: bool = False,
               remove_space: bool = True) -> Column:
    """Text as a sub-word model expects it (T6): spaces squeezed, quotes unified,
    accents stripped, and only then lower-cased (a compatibility character may
    decompose into capitals)."""
    c = F.col(col) if isinstance(col, str) else col
    if remove_space:
        c = T.squeeze_space(c)
    c = strip_accents(T.norm_quotes(c), keep_accents)
    return T.lower(c) if lower else c
