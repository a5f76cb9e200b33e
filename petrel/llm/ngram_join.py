"""Near copies by the Jaccard similarity of word shingles, exactly.

A document's set holds its distinct ``words``-word shingles.  Two documents
link if 100 * |A & B| >= percent * |A | B|.

*   Shingles are ordered by how many documents hold them (in classes of powers
    of two), then by hash.  Linked sets share a shingle in their prefixes, so
    a document whose prefix holds only shingles of its own links with nothing;
    in most corpora that settles nearly all documents.
*   Equal sets are one vertex from here on.
*   The rest is indexed by *token combinations*.  Rare shingles (held by at
    most 2^RARE documents) are keys by themselves.  Frequent ones are keys in
    pairs only: the prefix is extended by ``c`` shingles, so linked sets share
    at least c + 1 there; shingles fall into ``c`` classes by hash, so two of
    the shared ones fall into one class, and pairs within classes suffice.
    ``c`` depends on the set's size level; a set sends keys for its level and
    the next, as linked sets are at most one level apart.
*   Candidates are verified on the whole sets.  First each key compares its
    sets with the one whose shingles are most common, which among near copies
    is the one next to the original; then sets that share a key and still lie
    in different components are compared pair by pair.  A pair that is not
    compared is in one component already, so no link is lost, and a group of
    thousands of near copies costs one comparison per member, not one per pair.
    Sizes, and how many shingles of a set any other document holds, rule out
    pairs beforehand.

A null or blank text has an empty set and links with nothing.  A document of
fewer words than ``words`` has one shingle, its whole sequence.  Documents
without an id take part; they never give a component its name unless all its
documents lack one.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrel.llm.graph import components
from petrel.llm.runtime import drop, ints, setup, squeeze, stored, unints, unsqueeze, wide
from petrel.llm.textblocks import (MESSAGE, NO_ID, Block, buckets, exchange, mix, per_row, powers, prefix_hash,
                                   run_starts, text_blocks, unpack)

RARE = 4      # class of shingles held by up to 2^RARE documents
SMALL = 3     # sets below this size use single keys only
PART = 1 << 18     # bytes hashed at a time
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _odd(i: int) -> np.uint64:
    """The i-th of a fixed series of odd multipliers."""
    x = (i + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return np.uint64((x ^ x >> 27) | 1)


def shingle_sets(b: Block, words: int) -> list[np.ndarray]:
    """Each document's sorted distinct shingle hashes."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(b.ends):
        base = int(b.starts[at])
        to = max(at + 1, int(np.searchsorted(b.ends, base + PART, "right")))
        out.extend(_sets(_LOWER[b.body[base:b.ends[to - 1]]], b.ends[at:to] - base, words))
        at = to
    return out


def _sets(body: np.ndarray, ends: np.ndarray, words: int) -> list[np.ndarray]:
    none = np.zeros(0, np.uint64)
    inside = ~_SPACE[body]
    edge = np.zeros(len(body) + 1, bool)              # a word ends with its document
    edge[ends] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(len(body) + 1)
    h = prefix_hash(body, up)
    word = mix((h[e] - h[s]) * down[s] + (e - s).astype(np.uint64))
    upto = np.searchsorted(s, ends)                   # words up to each document's end
    key = np.zeros(max(len(word) - words + 1, 0), np.uint64)
    for i in range(words):
        key += word[i:len(word) - words + 1 + i] * _odd(i) if len(key) else key
    key = mix(key)
    out, at = [], 0
    for n in upto:
        if n - at >= words:
            k = np.sort(key[at:n - words + 1])
            out.append(k[run_starts(k)])
        elif n > at:
            factor = np.array([_odd(i) for i in range(n - at)], np.uint64)
            out.append(mix((word[at:n] * factor).sum(keepdims=True, dtype=np.uint64) + np.uint64(n - at)))
        else:
            out.append(none)
        at = n
    return out


# --- how many documents hold each shingle ------------------------------------

def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    """Buckets are ranges of the hash, so sorted hashes are sorted by bucket."""
    return ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _distinct(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    first = run_starts(keys)
    return keys[first], np.diff(np.append(first, len(keys)))


def _ask_counts(n: int, words: int):
    def make(row):
        keys, count = _distinct(shingle_sets(unpack(row), words))
        to = _bucket(keys, n)
        cut = run_starts(to)
        for s, e in zip(cut, np.append(cut[1:], len(to))):
            mark = (keys[s:e] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            yield {"block": row["block"], "bucket": int(to[s]), "data": mark.tobytes() + squeeze(ints(count[s:e]))
                   + len(mark).to_bytes(4, "little")}
    return per_row(MESSAGE, make)


def _answer_counts(messages: list[bytes]) -> list[bytes]:
    """For each shingle: 0 held by one document, else the power of two that its documents reach."""
    marks, counts = [], []
    for m in messages:
        n = int.from_bytes(m[-4:], "little")
        marks.append(np.frombuffer(m, np.uint32, n))
        counts.append(unints(unsqueeze(m[4 * n:-4])))
    _, where = np.unique(np.concatenate(marks), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate(counts))
    level = np.ceil(np.log2(total)).astype(np.uint8)[where]
    return [squeeze(x.tobytes()) for x in np.split(level, np.cumsum([len(m) for m in marks])[:-1])]


# --- the sets that may link ----------------------------------------------------

SETS = {"row": pa.int64(), "doc_id": pa.int64(), "n": pa.int64(), "digest": pa.binary(), "body": pa.binary()}
SETS_SCHEMA = "row long, doc_id long, n long, digest binary, body binary"


def _least(n: int, percent: int) -> int:
    """A linked partner shares at least this many of n shingles."""
    return -(-percent * n // 100)


def _open_sets(words: int, percent: int):
    import hashlib

    def make(row):
        b = unpack(row)
        sets = shingle_sets(b, words)
        keys, _ = _distinct(sets)
        replies = sorted(row["replies"] or [], key=lambda r: r["bucket"])
        level = np.concatenate([np.frombuffer(unsqueeze(r["data"]), np.uint8) for r in replies]) if replies else None
        base = (b.block >> 32 << 40) | (b.block & 0xFFFFFF) << 16
        for i, s in enumerate(sets):
            out = {"row": base + i, "doc_id": None if b.ids[i] == NO_ID else int(b.ids[i]), "n": len(s),
                   "digest": None, "body": None}
            if len(s):
                of = level[np.searchsorted(keys, s)]
                if np.count_nonzero(of) >= _least(len(s), percent):
                    order = np.argsort(of, kind="stable")          # by class, then by hash
                    s = s[order]
                    out["digest"] = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    out["body"] = np.bincount(of, minlength=64).astype(np.uint32).tobytes() + s.tobytes()
            yield out
    return per_row(SETS, make)


def _read(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in their order, and how many lie in each class."""
    return np.frombuffer(body, np.uint64, offset=256), np.frombuffer(body, np.uint32, 64)


# --- keys ------------------------------------------------------------------------

def _levels() -> list[int]:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-4 * out[-1] // 3)))
    return out


def keys_of(tokens: np.ndarray, per_class: np.ndarray, percent: int,
            steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of a set: single shingles, pairs of frequent ones (see above)."""
    n = len(tokens)
    own, rare = int(per_class[0]), int(per_class[:RARE + 1].sum())
    prefix = n - _least(n, percent) + 1
    here = int(np.searchsorted(steps, n, "right")) - 1
    none = np.zeros(0, np.uint64)
    single, pair = [none], [none]
    for level in (here, here + 1):
        low = int(steps[level])
        if low < SMALL:
            single.append(mix(tokens[own:prefix]))
            continue
        more = max(1, low // 4)                          # extension, and number of classes
        reach = min(prefix + more, n)
        single.append(mix(tokens[own:min(rare, reach)]))
        often = np.sort(tokens[rare:reach])
        of = mix(often ^ np.uint64(low)) % np.uint64(more)
        order = np.argsort(of, kind="stable")
        often, of = often[order], of[order]
        for gap in range(1, len(often)):                 # pairs within a class stand side by side
            same = np.flatnonzero(of[gap:] == of[:-gap])
            if not len(same):
                break
            pair.append(mix(often[same] * _odd(11) + often[same + gap] * _odd(12) + np.uint64(low)))
    return np.unique(np.concatenate(single)), np.unique(np.concatenate(pair))


ENTRIES = "key long, pair boolean, row long, n long, u long, s long"


def _entries(percent: int):
    """The keys of each set, with its size; how many of its shingles a partner
    found by the key can share; and a score: the higher, the more common its
    shingles.

    A set sends pairs only if all its rare shingles are keys, so of two sets
    that meet at a pair and nowhere else only frequent shingles are shared."""
    steps, classes = np.array(_levels(), np.int64), np.arange(64)

    def of(row: int, n: int, body: bytes):
        tokens, per_class = _read(body)
        common = int((per_class * classes).sum() * 1000 // n)
        score = common << 40 | row * 0x9E3779B97F4A7C15 >> 20 & (1 << 40) - 1    # no ties
        for k, left_out in zip(keys_of(tokens, per_class, percent, steps), (1, RARE + 1)):
            u = n - int(per_class[:left_out].sum())
            yield (k.view(np.int64), np.full(len(k), left_out > 1),
                   *(np.full(len(k), x, np.int64) for x in (row, n, u, score)))

    def run(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 64):
                rows = zip(*(c.to_pylist() for c in batch.slice(s, 64).columns))
                parts = [x for r in rows for x in of(*r)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in zip(*parts)], ["key", "pair", "row", "n", "u", "s"])
    return run


def _may_link(percent: int) -> str:
    """SQL: sets of n and m shingles, of which u and v can be shared, are not ruled out by these numbers."""
    return (f"{percent} * n <= 100 * m and {percent} * m <= 100 * n and "
            f"100 * least(u, v) >= {percent} * (n + m - least(u, v))")


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(i).to_pylist() for i in range(4))
            keep = []
            for i in range(batch.num_rows):
                p, q = _read(x[i])[0], _read(y[i])[0]
                both = len(np.intersect1d(p, q, assume_unique=True))
                if 100 * both >= percent * (len(p) + len(q) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([z[i] for i in keep], pa.int64()) for z in (a, b)], ["a", "b"])
    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of rows that link."""
    left = sets.select(F.col("row").alias("a"), F.col("body").alias("x"))
    right = sets.select(F.col("row").alias("b"), F.col("body").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return both.mapInArrow(_verify(percent), "a long, b long")


def _open_pairs(entries: DataFrame, heads: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share a key, lie in different components, and are not ruled out by their numbers.

    Near copies share very many keys of frequent shingles.  Sets whose keys have
    the same centre (the most common set that any of their keys leads to) are
    therefore paired once, by that centre, and by keys only with sets of
    another centre."""
    placed = entries.drop("s").join(first.withColumnRenamed("id", "row"), "row", "left").withColumn(
        "c", F.coalesce("component", "row")).drop("component")
    mixed = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    open_ = stored(placed.join(mixed.select("key"), "key", "left_semi"), "set-open")

    def against(rows: DataFrame, by: str) -> DataFrame:
        other = rows.select(by, F.col("row").alias("b"), F.col("n").alias("m"), F.col("u").alias("v"),
                            F.col("c").alias("d"), F.col("centre").alias("centre_b"))
        return rows.join(other, by).where("c < d and " + _may_link(percent))

    none = F.lit(None).cast("long")
    single = against(open_.where("not pair").withColumn("centre", none), "key")
    often = open_.where("pair")
    centres = often.select("key", "row").join(heads.select("key", "a", "top"), "key").groupBy("row").agg(
        F.max_by("a", "top").alias("centre"))
    often = often.join(centres, "row")
    same = against(often.drop("key").distinct(), "centre")
    apart = often.groupBy("key").agg(F.min("centre").alias("low"), F.max("centre").alias("high")).where("low <> high")
    other = against(often.join(apart.select("key"), "key", "left_semi"), "key").where("centre <> centre_b")
    both = [x.select(F.least("row", "b").alias("a"), F.greatest("row", "b").alias("b")) for x in (single, same, other)]
    return both[0].unionByName(both[1]).unionByName(both[2]).distinct()


#: A digest is hot if it has more than this share of the rows that a shuffle partition gets on average.
HOT_SHARE = 0.25


def _with_lead(rows: DataFrame) -> DataFrame:
    """(row, lead): the smallest row of each digest.

    Hot digests, at most partitions / ``HOT_SHARE`` of them, are broadcast; the others are joined by a shuffle."""
    lead = stored(rows.groupBy("digest").agg(F.min("row").alias("lead"), F.count("*").alias("k")), "set-leads")
    total = lead.agg(F.coalesce(F.sum("k"), F.lit(0))).head()[0]
    limit = max(2.0, total * HOT_SHARE / wide(rows.sparkSession))
    hot = lead.where(F.col("k") > limit).select("digest", F.col("lead").alias("hot"))
    rows = rows.join(F.broadcast(hot), "digest", "left")
    rest = rows.where("hot is null").drop("hot").join(lead.where(F.col("k") <= limit).drop("k"), "digest")
    return rows.where("hot is not null").select("row", F.col("hot").alias("lead")).unionByName(rest.select("row", "lead"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                percent: int = 75) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id."""
    setup(docs.sparkSession)
    blocks = text_blocks(docs, id_col, text_col, "shingle-blocks")
    n = buckets(blocks)
    counts = exchange(blocks.mapInArrow(_ask_counts(n, words), "block long, bucket int, data binary"), _answer_counts)
    sets = stored(blocks.join(counts, "block", "left").mapInArrow(_open_sets(words, percent), SETS_SCHEMA), "sets")
    drop(blocks)
    ids = stored(sets.select("row", "doc_id", F.col("n").alias("n_shingles")), "set-ids")
    some = sets.where("digest is not null")
    copies = stored(_with_lead(some.select("row", "digest")), "set-copies")
    firsts = copies.where("row = lead").select("row")
    reps = stored(some.join(firsts, "row", "left_semi").select("row", "n", "body"), "set-firsts")
    drop(sets)

    entries = stored(reps.mapInArrow(_entries(percent), ENTRIES), "set-keys")
    heads = stored(entries.groupBy("key").agg(
        F.count("*").alias("k"), F.max("s").alias("top"), F.max_by("row", "s").alias("a"),
        F.max_by("n", "s").alias("m"), F.max_by("u", "s").alias("v")).where("k > 1").drop("k"), "set-heads")
    star = stored(entries.drop("s").join(heads, "key").where("a <> row and " + _may_link(percent))
                  .select(F.least("a", "row").alias("a"), F.greatest("a", "row").alias("b")).distinct(), "set-centres")
    links = stored(_links(star, reps, percent), "set-links")
    first = stored(components(links, "set-stars"), "set-components")
    pairs = _open_pairs(entries, heads, first, percent).join(star, ["a", "b"], "left_anti")
    more = _links(pairs, reps, percent)
    whole = copies.where("row <> lead").select(F.col("row").alias("a"), F.col("lead").alias("b"))
    found = stored(components(links.unionByName(more).unionByName(whole), "copy-stars"), "copy-components")
    drop(reps, entries, heads)
    placed = ids.join(found.withColumnRenamed("id", "row"), "row", "left")
    names = (placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("name")))
    return placed.join(names, "component", "left").select(
        "doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("name"))
        .alias("component_id"))
