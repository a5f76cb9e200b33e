"""Secrets in texts, by an inverted index of trigrams.

1.  *Queries.*  Each rule's regular expression is turned into a Boolean query
    over trigrams that every match must contain (``trigram_query``): an OR of
    clauses, each an AND of lower-case trigrams.  A rule such as a run of hex
    digits has no mandatory trigrams.
2.  *Index.*  ``postings`` lists, for each trigram that a rule of the set asks
    for, the texts that hold it in any letter case.  A text is named by its
    64-bit hash, so copies of a text are posted once.
3.  *Intersection.*  The postings of a clause's trigrams are intersected by
    counting, per clause and text, how many of them name the text; a text that
    has all trigrams of one clause is a candidate of the rule.
4.  *Verification.*  A rule's regular expression runs on the whole text of its
    candidates only; a rule without mandatory trigrams runs on all texts.  Two
    texts with one hash are at worst a candidate too many.

Everything is DataFrame expressions.  Candidates are joined to the texts by
hash; Spark broadcasts them if it measures them small and else shuffles.

A finding is a match (leftmost, not overlapping, per rule) whose group
``group`` has at least ``least`` characters.  Null texts are empty, and empty
texts hold no finding; rows are independent, so repeated rows and ids give
each row its own answer; an empty table gives an empty result.
"""
from __future__ import annotations

import re
from re import _constants as C
from re import _parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrel.llm.runtime import setup, stored

#: Character classes up to this size are spelled out, larger ones end a mandatory string.
CLASS = 8
#: So many alternative strings are followed side by side.
STRINGS = 64


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0      # the group that is measured
    least: int = 1      # its least number of characters


# --- fixed values: kinds and patterns, in the order in which findings of one place are listed ---
BASE_RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),        # what is left of a longer stretch is shorter: as with + and 20 or more
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    # header words up to the last two, in a loop that never goes back: a long header needs no stack
    Rule("private_key", r"-----BEGIN (?:(?!PRIVATE KEY-----)[A-Z]++ )*+PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
# ------------------------------------------------------------------------------------------------


# --- mandatory trigrams of a regular expression ---------------------------------

Clauses = frozenset            # of frozensets of trigrams: an OR of ANDs
ANY: Clauses = frozenset([frozenset()])


def _minimal(clauses) -> Clauses:
    """Without clauses that a shorter one already allows; too many clauses ask nothing."""
    clauses = frozenset(c for c in clauses if not any(o < c for o in clauses))
    return clauses if len(clauses) <= STRINGS else ANY


def _both(a: Clauses, b: Clauses) -> Clauses:
    return _minimal({x | y for x in a for y in b}) if len(a) * len(b) <= STRINGS ** 2 else a


def _trigrams(strings: set[str]) -> Clauses:
    """What a text holds that contains one of the strings."""
    return _minimal({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}) if strings else ANY


def _class(items) -> set[str] | None:
    """The characters of a small class in lower case; None for a large or negated one."""
    out: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            out.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < CLASS:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= CLASS else None


class _Walk:
    """Strings that a match may end with at this point, and what it must contain before."""

    def __init__(self):
        self.ends: set[str] = {""}
        self.need: Clauses = ANY
        self.exact = True           # the match is one of ``ends``

    def append(self, strings: set[str]) -> None:
        joined = {a + b for a in self.ends for b in strings}
        if len(joined) > STRINGS:
            self.cut()
            joined = set(strings)
        self.ends = joined

    def cut(self) -> None:
        """Anything may follow: what is open counts, and nothing is open any more."""
        self.need = _both(self.need, _trigrams(self.ends))
        self.ends, self.exact = {""}, False

    def sequence(self, items) -> None:
        for op, value in items:
            self.one(op, value)

    def one(self, op, value) -> None:
        if op is C.LITERAL:
            self.append({chr(value).lower()})
        elif op is C.IN:
            chars = _class(value)
            self.append(chars) if chars else self.cut()
        elif op is C.SUBPATTERN:
            self.sequence(value[-1])
        elif op is C.BRANCH:
            self.branch(value[1])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = value
            if (low, high) == (0, 1):
                self.branch([inner, []])
                return
            for _ in range(min(low, 4)):
                self.sequence(inner)
            if high != low or low > 4:
                self.cut()
                if low:
                    self.sequence(inner)
        elif op is not C.AT:
            self.cut()

    def branch(self, choices) -> None:
        """All choices with strings alone go on side by side; else each counts for itself."""
        parts = []
        for items in choices:
            walk = _Walk()
            walk.sequence(items)
            parts.append(walk)
        if all(w.exact for w in parts):
            self.append(set().union(*(w.ends for w in parts)))
            return
        self.cut()
        for w in parts:
            w.cut()
        self.need = _both(self.need, _minimal(set().union(*(w.need for w in parts))))


def trigram_query(pattern: str) -> Clauses | None:
    """Clauses of lower-case trigrams, one of which every match holds in full; None if there are none."""
    walk = _Walk()
    walk.sequence(parser.parse(pattern))
    walk.cut()
    return None if frozenset() in walk.need else walk.need


# --- index and candidates ----------------------------------------------------------

def _clause_rows(rules) -> list[tuple[str, int, int, str]]:
    rows = []
    for rule in rules:
        for i, clause in enumerate(sorted(map(sorted, trigram_query(rule.pattern) or []))):
            rows += [(rule.kind, i, len(clause), gram) for gram in clause]
    return rows


def any_of(grams: list[str]) -> str:
    """A pattern that finds each of the trigrams wherever it starts, overlapping ones too."""
    by_first: dict[str, list[str]] = {}
    for g in grams:
        by_first.setdefault(g[0], []).append(re.escape(g[1:]))
    return "(?=(" + "|".join(f"{re.escape(a)}(?:{'|'.join(rest)})" for a, rest in sorted(by_first.items())) + "))"


def postings(texts: DataFrame, grams: list[str], text: str = "text", key: str = "key") -> DataFrame:
    """The index as a stored table (gram, key), sorted by trigram within each file; a text is posted once."""
    found = F.regexp_extract_all(F.lower(text), F.lit(any_of(grams)), F.lit(1))
    hits = texts.select(key, F.array_distinct(found).alias("grams"))
    once = hits.where(F.size("grams") > 0).groupBy(key).agg(F.first("grams").alias("grams"))
    rows = once.select(F.explode("grams").alias("gram"), key)
    return stored(rows.sortWithinPartitions("gram", key), "trigram-postings")


def candidates(index: DataFrame, rules, key: str = "key") -> DataFrame:
    """(key, kinds): the rules of which a text has all trigrams of a clause."""
    clauses = index.sparkSession.createDataFrame(_clause_rows(rules), "kind string, clause int, size int, gram string")
    asked = index.join(F.broadcast(clauses), "gram").repartition(key)            # a row per rule, clause and trigram
    held = asked.groupBy(key, "kind", "clause", "size").agg(F.count("*").alias("got")).where("got = size")
    return held.groupBy(key).agg(F.collect_set("kind").alias("kinds"))           # no longer than the rules


# --- verification --------------------------------------------------------------------

SPAN = "array<struct<start: long, kind: int, end: long>>"


def find_all(text: Column, rule: Rule, number: int) -> Column:
    """(start, kind, end) in characters of the rule's findings: pieces between matches and matches add up."""
    pattern = F.lit(rule.pattern)
    pieces = F.arrays_zip(F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)),
                          F.regexp_extract_all(text, pattern, F.lit(rule.group)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(seen, piece):
        begin = seen["at"] + F.length(piece["0"])
        end = begin + F.coalesce(F.length(piece["1"]), F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(number).alias("kind"), end.alias("end"))
        found = F.length(piece["2"]) >= rule.least
        return F.struct(end.alias("at"), F.when(found, F.array_append(seen["spans"], span)).otherwise(seen["spans"]).alias("spans"))

    spans = F.aggregate(pieces, start, step, lambda seen: seen["spans"])
    return F.when(F.regexp_like(text, pattern), spans).otherwise(F.array().cast(SPAN))


def scan(docs: DataFrame, rules=BASE_RULES + MORE_RULES, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of each row with ``spans``: (start, kind, end) by start, then kind.

    ``kind`` is the rule's place in ``rules``; places count characters, the end is exclusive."""
    setup(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    own = {f"_petrel_{i}": c for i, c in enumerate(keep)}
    src = docs.select(*[F.col(c).alias(n) for n, c in own.items()],
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    src = src.withColumn("key", F.xxhash64("text"))
    asked = {r.kind for r in rules if trigram_query(r.pattern)}
    if asked:
        grams = sorted({row[3] for row in _clause_rows(rules)})
        found = stored(candidates(postings(src, grams), rules), "secret-candidates")
        src = src.join(found, "key", "left")
    else:
        src = src.withColumn("kinds", F.array().cast("array<string>"))
    none = F.array().cast(SPAN)
    parts = [F.when(F.coalesce(F.array_contains("kinds", r.kind), F.lit(False)), find_all(F.col("text"), r, i)).otherwise(none)
             if r.kind in asked else find_all(F.col("text"), r, i) for i, r in enumerate(rules)]
    return src.select(*[F.col(n).alias(c) for n, c in own.items()], F.sort_array(F.concat(*parts)).alias("spans"))


def listed(spans: Column, rules) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + F.lit(1)), s["start"].cast("string"), s["end"].cast("string"))), ",")
