"""Texts in blocks of a few MB, and an exchange of packed numbers between blocks and buckets.

A block row holds the ids, the byte ends and the compressed UTF-8 bytes of
consecutive documents.  Array code then works on whole blocks, and a shuffle
moves a few packed rows instead of one row per word.  What a block sends is
unique within the block, so a key that a third of all documents share arrives
once per block and not once per document.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petrel.llm.runtime import column_bytes, ints, squeeze, stored, unints, unsqueeze, wide

BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 1 << 16
BLOCK_SCHEMA = "block long, ids binary, ends binary, body binary"
MESSAGE_SCHEMA = "block long, bucket int, data binary"
#: A document without an id is compared as the one with the largest id.
NO_ID = np.iinfo(np.int64).max


class Block(NamedTuple):
    block: int
    ids: np.ndarray     # int64 of each document
    ends: np.ndarray    # int64, where each document's bytes end
    body: np.ndarray    # uint8

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if len(self.ends) else self.ends


def unpack(row: dict) -> Block:
    return Block(row["block"], unints(row["ids"]), unints(row["ends"]),
                 np.frombuffer(unsqueeze(row["body"]), np.uint8))


def _packer() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        ids, lens, bodies, size = [], [], [], 0

        def row():
            nonlocal number, size
            out = pa.RecordBatch.from_pydict({
                "block": pa.array([number], pa.int64()), "ids": pa.array([ints(np.concatenate(ids))], pa.binary()),
                "ends": pa.array([ints(np.cumsum(np.concatenate(lens)))], pa.binary()),
                "body": pa.array([squeeze(np.concatenate(bodies).tobytes())], pa.binary())})
            number, size = number + 1, 0
            for x in (ids, lens, bodies):
                x.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            body, ends = column_bytes(batch.column(1))
            key = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < len(key):
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + BLOCK_BYTES - size, "right")))
                to = min(to, at + BLOCK_ROWS - sum(map(len, ids)))
                ids.append(key[at:to])
                lens.append(np.diff(ends[at:to], prepend=done))
                bodies.append(body[done:ends[to - 1]].copy())
                size += int(ends[to - 1] - done)
                at = to
                if size >= BLOCK_BYTES * 3 // 4 or sum(map(len, ids)) == BLOCK_ROWS:
                    yield row()
        if ids:
            yield row()
    return run


def text_blocks(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """A stored table of blocks; null texts are empty, the order of rows is the input's."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return stored(src.mapInArrow(_packer(), BLOCK_SCHEMA), name)


#: Blocks of text for each bucket of an exchange, at most.
PER_BUCKET = 16


def buckets(blocks: DataFrame) -> int:
    """Buckets of an exchange between ``blocks``: four for each shuffle partition, and more as there are more blocks, so
    that what one bucket holds does not grow with the table."""
    return max(4 * wide(blocks.sparkSession), -(-blocks.count() // PER_BUCKET))


def per_row(columns: dict[str, pa.DataType], make: Callable[[dict], Iterator[dict]]):
    """A mapInArrow function that turns each input row into the rows of ``make``."""
    names = list(columns)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(make({n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[n] for r in rows], columns[n]) for n in names], names)
    return run


MESSAGE = {"block": pa.int64(), "bucket": pa.int32(), "data": pa.binary()}


def exchange(messages: DataFrame, answer: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """Give all messages of a bucket to ``answer``; one row per block with its answers.

    ``messages`` has (block, bucket, data); ``answer`` returns one reply for
    each message.  The result has (block, replies: array of (bucket, data)).
    """
    def group(t: pa.Table) -> pa.Table:
        out = answer(t.column("data").to_pylist())
        return pa.table({"block": t.column("block"), "bucket": t.column("bucket"), "data": pa.array(out, pa.binary())})

    replies = messages.groupBy("bucket").applyInArrow(group, MESSAGE_SCHEMA)
    return replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias("replies"))


def run_starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of the (sorted) columns begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


# --- hashes of byte ranges -------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def prefix_hash(body: np.ndarray, up: np.ndarray) -> np.ndarray:
    """h with: hash of body[i:j] = (h[j] - h[i]) * down[i] (see ``powers``)."""
    h = np.zeros(len(body) + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[:len(body)], out=h[1:])
    return h
