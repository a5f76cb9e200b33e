"""Periodic runs of words, by enumerating maximal pairs.

A *run* is a stretch of consecutive words with smallest period q and length
of at least ``max(least, times * q)`` that no neighbouring word extends keeping
period q.  Take a run of length L and period q that starts at i: the suffixes
at i and i + q have exactly L - q words in common, and different words to their
left (or none).  So runs are the *maximal pairs* (i, j) with d = j - i whose
common length l satisfies ``l + d >= max(least, times * d)``; nothing is left to
extend.  A stretch with period q also gives pairs at multiples of q; of the
pairs with one start and one end the smallest distance is the period.

1.  *Ranks.*  Words get numbers (a dictionary of the batch), and ranks of
    stretches of 2, 4, 8 .. words follow by doubling, for all documents of a
    batch at once.  A pair needs at least ``shortest`` words in common, so a
    position whose first words occur once in its document belongs to no pair
    and is left out from there on.
2.  *Suffixes* of the rest are sorted by the ranks; common lengths of
    neighbours come from the stored ranks, longest stretches first.
3.  *Tree.*  The LCP intervals are visited bottom-up.  Each holds its
    positions in order and, per word to the left, a list of its positions.
    Two children are joined smaller into larger: a position of the smaller
    child meets those of the larger one in its window of distances, but only
    in lists of another left word, or, where the window holds fewer positions
    than there are lists, the window itself.

The work is per document: no shuffle, and memory in proportion to a batch of
documents (a document is never divided).  Null and empty texts have no words
and no runs; rows are independent, so repeated rows and ids, ties and further
columns change nothing, and an empty table gives an empty result.
"""
from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrel.llm.runtime import column_bytes, setup

#: Words of a row are stretches without blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text whose ranks are computed together.
PART_BYTES = 1 << 21


def words_of(body: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all words without white space, each word's end in them, and each text's end in words."""
    white = (body == 32) | ((body >= 9) & (body <= 13))
    first = ~white
    if len(body):
        inner = first[1:]
        inner &= white[:-1]
        starts = ends[:-1][ends[:-1] < len(body)]
        first[starts] = ~white[starts]
    at = np.flatnonzero(first)
    letters = ~white
    kept = np.cumsum(letters)
    word_ends = np.append(kept[at[1:] - 1], kept[-1]) if len(at) else np.zeros(0, np.int64)
    return body[letters], word_ends.astype(np.int64), np.searchsorted(at, ends, "left")


def word_numbers(letters: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal words get equal numbers."""
    if not len(ends):
        return np.zeros(0, np.int64)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return column.dictionary_encode().indices.to_numpy().astype(np.int64)


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


class Ranks:
    """Ranks of the stretches of 1, 2, 4 .. words from each position of a batch, a level for each width.

    Ranks go by document first, and a document's stretches end with it: what
    lies behind has rank 0.  Equal ranks are equal stretches.  A position whose
    stretch occurs once keeps a rank of its own and is not looked at again."""

    def __init__(self, numbers: np.ndarray, doc: np.ndarray, ends: np.ndarray, shortest: int):
        n = len(numbers)
        self.end = ends[doc] if n else np.zeros(0, np.int64)
        alive = np.arange(n)
        rank = np.zeros(n + 1, np.int64)
        rank[:n] = 1 + _dense(doc * (int(numbers.max(initial=0)) + 1) + numbers)
        small = np.int32 if n < 1 << 31 else np.int64
        self.levels, self.widths, width = [rank.astype(small)], [1], 1
        alive = self._repeated(alive, rank)
        while len(alive):
            rank = self._double(rank, alive, width, n)
            width *= 2
            self.levels.append(rank.astype(small))
            self.widths.append(width)
            alive = self._repeated(alive, rank)
        # the last ranks are all different; they go by document first
        keep = self._common_first(shortest, n)
        self.order = keep[np.argsort(rank[keep], kind="stable")]

    @staticmethod
    def _repeated(alive: np.ndarray, rank: np.ndarray) -> np.ndarray:
        if not len(alive):
            return alive
        return alive[np.bincount(rank[alive])[rank[alive]] > 1]

    def _double(self, rank: np.ndarray, alive: np.ndarray, width: int, n: int) -> np.ndarray:
        behind = np.where(alive + width < self.end[alive], np.minimum(alive + width, n), n)
        key = rank[alive] * (int(rank.max()) + 1) + rank[behind]
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.ones(len(key), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        out = rank.copy()
        # a class of m positions owned one rank; give its parts consecutive ones by shifting the later classes
        sizes = np.zeros(int(rank.max()) + 2, np.int64)
        np.add.at(sizes, rank[alive][order][new], 1)
        sizes[sizes > 0] -= 1
        shift = np.cumsum(sizes) - sizes
        out[:n] = rank[:n] + shift[rank[:n]]
        first = np.flatnonzero(new)
        number = np.cumsum(new) - 1
        cls = rank[alive][order]
        start_of_class = np.ones(len(first), bool)
        start_of_class[1:] = cls[first][1:] != cls[first][:-1]
        within = np.arange(len(first)) - np.maximum.accumulate(np.where(start_of_class, np.arange(len(first)), 0))
        out[alive[order]] = cls + shift[cls] + within[number]
        return out

    def _common_first(self, shortest: int, n: int) -> np.ndarray:
        """Positions with ``shortest`` words ahead that another position of the document has, too."""
        at = np.arange(n)
        at = at[at + shortest <= self.end]
        key, here, left = None, at, shortest
        for rank, width in zip(reversed(self.levels), reversed(self.widths)):
            while width <= left:
                part = rank[here].astype(np.int64)
                key = part if key is None else _dense(key * (int(rank.max()) + 1) + part)
                here, left = here + width, left - width
                own = np.bincount(key)[key] > 1
                at, here, key = at[own], here[own], key[own]
        return at

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words the suffixes at a and at b of one document share."""
        total = np.zeros(len(a), np.int64)
        for rank, width in zip(reversed(self.levels), reversed(self.widths)):
            total += width * (rank[a + total] == rank[b + total])     # less than the widest, so each width once
        return total


class _Node:
    """Positions of an LCP interval: all in order, and in order per left word."""
    __slots__ = ("all", "by_left")

    def __init__(self, position: int, left: int):
        self.all = [position]
        self.by_left = {left: [position]}


def _join(one: _Node, two: _Node, lcp: int, reach: int, least: int, left: list[int], out: list) -> _Node:
    """The union of two children; reports the pairs between them that are maximal and near enough."""
    if len(one.all) < len(two.all):
        one, two = two, one
    for a, places in two.by_left.items():
        for p in places:
            lo, hi = bisect_left(one.all, p - reach), bisect_right(one.all, p + reach)
            if lo == hi:
                continue
            if hi - lo <= len(one.by_left):
                found = [q for q in one.all[lo:hi] if left[q] != a]
            else:
                found = [q for b, others in one.by_left.items() if b != a
                         for q in others[bisect_left(others, p - reach):bisect_right(others, p + reach)]]
            for q in found:
                i, j = (p, q) if p < q else (q, p)
                if lcp + j - i >= least:
                    out.append((i, j, lcp))
    for a, places in two.by_left.items():
        into = one.by_left.setdefault(a, [])
        for p in places:
            insort(into, p)
            insort(one.all, p)
    return one


def maximal_pairs(order: list[int], lcp: list[int], left: list[int], times: int, least: int,
                  shortest: int) -> list[tuple[int, int, int]]:
    """All maximal pairs (i, j, common length l) of a document with l + d >= max(least, times * d), d = j - i.

    ``order`` lists suffixes, ``lcp[k]`` what order[k - 1] and order[k] share
    (0 at the first); ``left[i]`` is the word before position i, and a
    number of its own where there is none."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, _Node]] = []         # open intervals: (common length with what follows, positions)
    for k, position in enumerate(order):
        node = _Node(position, left[position])
        ahead = lcp[k + 1] if k + 1 < len(order) else 0
        # close the intervals that are deeper than what the next suffix shares
        while stack and stack[-1][0] > ahead:
            depth, below = stack.pop()
            node = _join(below, node, depth, depth // (times - 1), least, left, out)
        if ahead < shortest:
            stack.clear()
        elif stack and stack[-1][0] == ahead:
            depth, below = stack.pop()
            stack.append((depth, _join(below, node, depth, depth // (times - 1), least, left, out)))
        else:
            stack.append((ahead, node))
    return out


def runs_of(numbers: np.ndarray, ends: np.ndarray, times: int = 4, least: int = 6) -> list[list[tuple[int, int, int]]]:
    """For each document the runs (start, length, period) by start, then period."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in ends]
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    # l >= (times - 1) * d and l >= least - d for some d >= 1
    shortest = min(max((times - 1) * d, least - d) for d in range(1, least + 1))
    ranks = Ranks(numbers, doc, ends.astype(np.int64), shortest)
    order = ranks.order
    if len(order) < 2:
        return runs
    lcp = np.zeros(len(order), np.int64)
    same = np.flatnonzero(doc[order[1:]] == doc[order[:-1]]) + 1
    lcp[same] = ranks.common(order[same - 1], order[same])
    starts = ends - np.diff(ends, prepend=0)
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(doc[order])) + 1, [len(order)]])
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if e - s < 2:
            continue
        d = int(doc[order[s]])
        begin = int(starts[d])
        places = order[s:e] - begin
        own = numbers[begin:int(ends[d])]
        left = np.concatenate([[-1], own[:-1]]).tolist()
        best: dict[tuple[int, int], int] = {}
        for i, j, common in maximal_pairs(places.tolist(), lcp[s:e].tolist(), left, times, least, shortest):
            key = (i, j + common)
            best[key] = min(best.get(key, j - i), j - i)
        runs[d] = sorted(((i, stop - i, q) for (i, stop), q in best.items()), key=lambda r: (r[0], r[2]))
    return runs


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _collapse(letters: np.ndarray, word_ends: np.ndarray, text_ends: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each text joined by single blanks."""
    size = np.diff(word_ends, prepend=0)
    doc = np.repeat(np.arange(len(text_ends)), np.diff(text_ends, prepend=0))
    kept = np.flatnonzero(keep)
    last = np.ones(len(kept), bool)
    last[:-1] = doc[kept[1:]] != doc[kept[:-1]]
    room = size[kept] + ~last
    stop = np.cumsum(room)
    out = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint8)
    blank = np.zeros(len(out), bool)
    blank[stop[~last] - 1] = True
    out[~blank] = letters[np.repeat(keep, size)]
    total = np.concatenate([[0], np.cumsum(np.bincount(doc[kept], weights=room, minlength=len(text_ends)))]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(text_ends), [None, pa.py_buffer(total), pa.py_buffer(out)])


def _answer(column: pa.Array, times: int, least: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    body, ends = column_bytes(column)
    letters, word_ends, text_ends = words_of(body, ends)
    runs = runs_of(word_numbers(letters, word_ends), text_ends, times, least)
    keep = np.ones(len(word_ends), bool)
    for d, found in enumerate(runs):
        begin = int(text_ends[d - 1]) if d else 0
        for start, length, period in found:
            keep[begin + start + period:begin + start + length] = False
    flat = np.array([r for found in runs for r in found], np.int64).reshape(-1, 3)
    at = np.concatenate([[0], np.cumsum([len(found) for found in runs])]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(RUN))
    return (pa.array(np.diff(text_ends, prepend=0).astype(np.int64)), pa.ListArray.from_arrays(pa.array(at), values),
            _collapse(letters, word_ends, text_ends, keep).cast(pa.string()))


def _parts(column: pa.Array) -> Iterator[pa.Array]:
    """Consecutive rows of up to ``PART_BYTES`` of text, one row at least."""
    _, ends = column_bytes(column)
    at = 0
    while at < len(column):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + PART_BYTES, "right")))
        yield column.slice(at, to - at)
        at = to


def find_runs(docs: DataFrame, text_col: str = "text", times: int = 4, least: int = 6,
              keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of each row with n_words, runs (array of start, length, period) and the collapsed text.

    Runs are listed by start, then period.  The collapsed text keeps, of each
    run, its first period; words of a run that lie in the first period of
    another one go as well."""
    if times < 2:
        raise ValueError("a run repeats its period at least twice")
    setup(docs.sparkSession)
    keep = ["doc_id"] if keep is None else keep
    types = {f.name: f for f in docs.schema.fields}
    src = docs.select(*keep, F.col(text_col).cast("string").alias("_petrel_text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in _parts(batch.column(batch.num_columns - 1)):
                own = [batch.column(i).slice(at, len(part)) for i in range(batch.num_columns - 1)]
                at += len(part)
                yield pa.RecordBatch.from_arrays([*own, *_answer(part, times, least)],
                                                 [*batch.schema.names[:-1], "n_words", "runs", "collapsed"])

    schema = ", ".join(f"`{c}` {types[c].dataType.simpleString()}" for c in keep)
    return src.mapInArrow(work, (schema + ", " if keep else "")
                          + "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
