"""Array column functions: tokens, padding, special ids, masks, labels.

All of them are Catalyst higher-order / collection expressions, evaluated per
row inside whole-stage code generation; none of them shuffles.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from petrel.functions.text import WS

# fixed value: the word-piece prefix marking a word start
PIECE_PREFIX = "▁"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _i(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(int(x))


# --- tokens ---------------------------------------------------------------------

def tokenize(col: Column | str, pattern: str = WS) -> Column:
    """Split on ``pattern`` and drop empty strings."""
    return F.filter(F.split(_c(col), pattern), lambda x: x != F.lit(""))


def drop_listed(tokens: Column | str, words: Iterable[str]) -> Column:
    """Remove every token in a short literal list, keeping order and repeats."""
    words = list(words)
    return F.filter(_c(tokens), lambda x: ~x.isin(words))


def min_len(tokens: Column | str, n: int = 1) -> Column:
    """Keep tokens longer than ``n`` characters."""
    return F.filter(_c(tokens), lambda x: F.length(x) > F.lit(n))


def detokenize(tokens: Column | str) -> Column:
    """Join pieces, turn the word-start mark into a blank, trim (T5)."""
    joined = F.array_join(_c(tokens), "")
    return F.btrim(F.replace(joined, F.lit(PIECE_PREFIX), F.lit(" ")), F.lit(" "))


# --- padding --------------------------------------------------------------------

def pad_pre(col: Column | str, length: int, value: int = 0) -> Column:
    """Pad and truncate on the left to ``length``; truncation keeps the tail."""
    c = _c(col)
    n = F.size(c)
    keep = F.slice(c, F.greatest(n - F.lit(length), F.lit(0)) + F.lit(1), F.lit(length))
    pad = F.array_repeat(F.lit(value), F.greatest(F.lit(length) - n, F.lit(0)))
    return F.concat(pad, keep)


def pad_post(col: Column | str, length: int, value: int = 0) -> Column:
    """Truncate and pad on the right to ``length`` (E5)."""
    c = _c(col)
    keep = F.slice(c, 1, length)
    return F.concat(keep, F.array_repeat(F.lit(value), F.lit(length) - F.size(keep)))


def content_len(length: int, pair: bool = False) -> int:
    """Room for content once special ids are added: L-2, or L-3 for a pair."""
    return length - (3 if pair else 2)


# --- special ids ----------------------------------------------------------------

def add_special(a: Column | str, cls_id: int, sep_id: int, b: Column | str | None = None) -> Column:
    """``[CLS] A [SEP]`` or ``[CLS] A [SEP] B [SEP]``."""
    cls, sep = F.array(F.lit(cls_id)), F.array(F.lit(sep_id))
    if b is None:
        return F.concat(cls, _c(a), sep)
    return F.concat(cls, _c(a), sep, _c(b), sep)


def special_mask(a: Column | str, b: Column | str | None = None) -> Column:
    """1 at the special positions that ``add_special`` would add, else 0."""
    one = F.array(F.lit(1))
    zeros_a = F.array_repeat(F.lit(0), F.size(_c(a)))
    if b is None:
        return F.concat(one, zeros_a, one)
    return F.concat(one, zeros_a, one, F.array_repeat(F.lit(0), F.size(_c(b))), one)


def special_mask_done(ids: Column | str, cls_id: int, sep_id: int) -> Column:
    """1 where a finished id list holds ``[CLS]`` or ``[SEP]``."""
    return F.transform(_c(ids), lambda x: x.isin(cls_id, sep_id).cast("int"))


def token_types(a: Column | str, b: Column | str | None = None) -> Column:
    """0 over ``[CLS] A [SEP]``, 1 over ``B [SEP]``."""
    first = F.array_repeat(F.lit(0), F.size(_c(a)) + F.lit(2))
    if b is None:
        return first
    return F.concat(first, F.array_repeat(F.lit(1), F.size(_c(b)) + F.lit(1)))


def attention_mask(ids: Column | str, pad_id: int = 0) -> Column:
    """1 for content, 0 for padding, per position."""
    return F.transform(_c(ids), lambda x: (x != F.lit(pad_id)).cast("int"))


def segments(length: int | Column) -> Column:
    """All-zero segment ids of the given length."""
    return F.array_repeat(F.lit(0), _i(length))


# --- labels ---------------------------------------------------------------------

def one_hot(label: Column | str, k: int | Column) -> Column:
    """Float one-hot vector of width ``k`` (L1)."""
    lab = _c(label)
    return F.transform(F.sequence(F.lit(0), _i(k) - F.lit(1)),
                       lambda i: (i == lab).cast("float"))


def argmax(col: Column | str) -> Column:
    """0-based position of the first maximum (L2)."""
    c = _c(col)
    return (F.array_position(c, F.array_max(c)) - F.lit(1)).cast("int")


def softmax(col: Column | str) -> Column:
    """Numerically stable softmax of a numeric array, in double."""
    c = F.transform(_c(col), lambda x: x.cast("double"))
    mx = F.array_max(c)
    e = F.transform(c, lambda x: F.exp(x - mx))
    s = F.aggregate(e, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return F.transform(e, lambda x: x / s)


def join_ints(col: Column | str, sep: str = ",") -> Column:
    """Render an int array as text (stable across engines for value hashing)."""
    return F.array_join(F.transform(_c(col), lambda x: x.cast("string")), sep)


def check_unique(key: str, seen: Column, size: Column) -> Column:
    """True, or a failed job if more elements were regrouped than one array has:
    two rows then have the same key and would be mixed."""
    return F.when(seen > F.greatest(size, F.lit(0)), F.raise_error(
        F.concat(F.lit("repeated key "), F.coalesce(F.first(F.col(key)).cast("string"), F.lit("null"))))
        .cast("boolean")).otherwise(F.lit(True))
