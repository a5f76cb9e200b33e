"""Byte-level BPE: text to ids and back, by a rank file.

Each match of the pattern (a *pre-token*) is looked up in two tiers.

1.  A minimal perfect hash over the vocabulary (``PerfectHash``): one slot per
    entry, no empty ones.  All distinct pre-tokens of a part are hashed at
    once; the bytes in the slot decide whether it is a hit.
2.  A miss is merged byte by byte: a linked list of pieces and a heap of the
    neighbouring pairs that form an entry, lowest rank and leftmost first,
    which takes O(n log n) steps however long the pre-token is.

Misses repeat, so each worker keeps a bounded number of answered ones.  The
work is per row; there is no shuffle.
"""
from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrel.llm.runtime import setup
from petrel.llm.textblocks import mix, powers, prefix_hash

#: Answered pre-tokens that a worker keeps, in two generations.
KEEP = 300_000
#: Characters of text cut into pre-tokens at a time.
PART = 1 << 19


def hashes(tokens: list[bytes]) -> np.ndarray:
    """One 64-bit hash for each byte string."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    body = np.frombuffer(b"".join(tokens), np.uint8)
    end = np.cumsum(size)
    up, down = powers(len(body) + 1)
    h = prefix_hash(body, up)
    return mix((h[end] - h[end - size]) * down[end - size] + size.astype(np.uint64))


class PerfectHash:
    """A minimal perfect hash: n keys in n slots, by two displacements per bucket of about four keys.

    Buckets are placed in descending size, while many slots are free; the last
    ones hold one key each and take the slots that are left.
    """

    def __init__(self, keys: np.ndarray):
        self.n, self.m, self.seed = len(keys), max(1, len(keys) // 4), 0
        while not self._place(keys):     # two keys of a bucket agree in both hashes: take others
            self.seed += 1
        self.slot_of = self.slots(keys)

    def _place(self, keys: np.ndarray) -> bool:
        n = self.n
        self.a, self.b = np.zeros(self.m, np.int64), np.zeros(self.m, np.int64)
        bucket, one, two = self._parts(keys)
        order = np.argsort(bucket, kind="stable")
        count = np.bincount(bucket, minlength=self.m)
        start = np.cumsum(count) - count
        used = np.zeros(n, bool)
        shift = np.arange(min(n, 256), dtype=np.int64) * (n // 256 + 1)
        descending = np.argsort(-count, kind="stable")
        for j in descending[count[descending] > 1]:
            own = order[start[j]:start[j] + count[j]]
            for tries in range(n + 1024):          # 256 displacements at a time
                more = (shift + tries) % n
                at = ((one[own] + tries * two[own])[:, None] + more) % n
                k = next((k for k in np.flatnonzero(~used[at].any(axis=0)) if len(set(at[:, k].tolist())) == len(own)), -1)
                if k >= 0:
                    used[at[:, k]] = True
                    self.a[j], self.b[j] = tries, more[k]
                    break
            else:
                return False
        alone = descending[count[descending] == 1]
        self.b[alone] = (np.flatnonzero(~used) - one[order[start[alone]]]) % n
        return True

    def _parts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = mix(keys + np.uint64(self.seed))
        second = mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        return ((keys % np.uint64(self.m)).astype(np.int64), ((keys >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64),
                (second % np.uint64(self.n)).astype(np.int64))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        bucket, one, two = self._parts(keys)
        return (one + self.a[bucket] * two + self.b[bucket]) % self.n


class Encoder:
    """Ranks to ids for one rank file and pattern."""

    def __init__(self, entries: list[tuple[bytes, int]], pattern: str):
        self.pattern = pattern
        words = [w for w, _ in entries]
        self.hash = PerfectHash(hashes(words))
        self.word, self.id = [b""] * len(words), [0] * len(words)   # by slot
        for slot, (w, i) in zip(self.hash.slot_of.tolist(), entries):
            self.word[slot], self.id[slot] = w, i
        self.bytes_of = {i: w for w, i in entries}
        rank = dict(entries)
        self.byte = [rank.get(bytes([b])) for b in range(256)]
        self.pair = {}                                              # ids of two neighbours: id of the merged entry
        for w, i in entries:
            for k in range(1, len(w)):
                x, y = rank.get(w[:k]), rank.get(w[k:])
                if x is not None and y is not None:
                    self.pair[x << 32 | y] = i
        self._start()

    def _start(self) -> None:
        import regex
        self.find = regex.compile(self.pattern).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in vars(self).items() if k not in ("find", "young", "old")}

    def __setstate__(self, state: dict) -> None:
        vars(self).update(state)
        self._start()

    def merge(self, token: bytes) -> list[int]:
        """Ids of a pre-token that is no entry: a heap over linked bytes."""
        pair, ids = self.pair, [self.byte[b] for b in token]
        if None in ids:
            raise ValueError("the rank file lacks a single byte")
        n = len(ids)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
        for i in range(n - 1):
            r = pair.get(ids[i] << 32 | ids[i + 1])
            if r is not None:
                heap.append((r, i))
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or pair.get(ids[i] << 32 | ids[j]) != r:
                continue                                            # one of the two has merged meanwhile
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                x = pair.get(r << 32 | ids[k])
                if x is not None:
                    heapq.heappush(heap, (x, i))
            h = before[i]
            if h >= 0:
                x = pair.get(ids[h] << 32 | r)
                if x is not None:
                    heapq.heappush(heap, (x, h))
        return [x for x in ids if x >= 0]

    def answers(self, tokens: set[str]) -> dict[str, bytes]:
        """The ids of each pre-token as little-endian 32-bit integers."""
        out, new = {}, []
        young, old = self.young, self.old
        for t in tokens:
            v = young.get(t)
            if v is None:
                v = old.get(t)
                if v is None:
                    new.append(t)
                    continue
                young[t] = v
            out[t] = v
        if new:
            raw = [t.encode() for t in new]
            slots = self.hash.slots(hashes(raw)).tolist()
            for t, w, s in zip(new, raw, slots):
                ids = [self.id[s]] if self.word[s] == w else self.merge(w)
                out[t] = young[t] = np.array(ids, "<u4").tobytes()
        if len(young) > KEEP:
            self.young, self.old = {}, young
        return out

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text; texts are cut into pre-tokens a part at a time."""
        cut, size = [], 0
        for t in texts:
            cut.append(self.find(t))
            size += len(t)
            if size >= PART:
                yield from self._ids(cut)
                cut, size = [], 0
        yield from self._ids(cut)

    def _ids(self, cut: list[list[str]]) -> list[bytes]:
        known = self.answers(set(chain.from_iterable(cut)))
        return [b"".join(map(known.__getitem__, c)) for c in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(data: bytes) -> list[tuple[bytes, int]]:
    """Entries of a rank file: base64 of the bytes, a space, the rank."""
    return [(base64.b64decode(a), int(b)) for a, b in (x.split() for x in data.splitlines() if x.strip())]


def broadcast_encoder(spark: SparkSession, path: str, pattern: str) -> Broadcast:
    """The encoder of a rank file for all executors: a few MB, whatever the
    size of the corpus; a worker unpacks it once and keeps its answers."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(Encoder(read_ranks(f.read()), pattern))


def _mapper(shared: Broadcast, source: int, decoded: bool):
    def run(batches):
        e = shared.value
        for batch in batches:
            texts = batch.column(source).to_pylist()
            at = 0
            while at < len(texts):                    # rows leave in parts of a few MB
                size, to = 0, at
                while to < len(texts) and size < 4 * PART:
                    size += len(texts[to] or "")
                    to += 1
                ids = list(e.encode(t or "" for t in texts[at:to]))
                columns = [*batch.slice(at, to - at).columns, pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array(map(e.decode, ids), pa.binary()))
                names = [f"c{i}" for i in range(len(columns))]
                yield pa.RecordBatch.from_arrays(columns, names)
                at = to
    return run


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids",
           decoded: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``out``, the ids as little-endian
    unsigned 32-bit integers, and if named ``decoded``, the bytes they stand for.

    A null text has no ids.  A column of ``df`` named like an output is replaced.
    """
    setup(df.sparkSession)
    shared = broadcast_encoder(df.sparkSession, path, pattern)
    added = [out] + [decoded] * bool(decoded)
    kept = [c for c in (df.columns if keep is None else keep) if c not in added]
    src = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)],
                    F.col(f"`{text_col}`").cast("string").alias(f"c{len(kept)}"))
    kinds = [f.dataType.simpleString() for f in src.schema.fields] + ["binary"] * len(added)
    schema = ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))
    done = src.mapInArrow(_mapper(shared, len(kept), bool(decoded)), schema)
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)],
                       *[F.col(f"c{len(kept) + 1 + i}").alias(c) for i, c in enumerate(added)])


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``, the bytes that the ids stand for; null ids give no bytes."""
    setup(df.sparkSession)
    shared = broadcast_encoder(df.sparkSession, path, pattern)

    @F.pandas_udf("binary")
    def read(ids):
        return ids.map(lambda x: shared.value.decode(x or b""))

    return df.withColumn(out, read(F.col(ids_col)))
