"""Quoted multi-line CSV read by byte ranges.

A line break may lie inside a quoted field, so Spark's multi-line reader gives
one task per file.  Here files are read as lines, which Spark divides into byte
ranges, in two passes:

1.  Quotes are counted per range.  Their running sum along a file tells for
    each range whether it starts inside a quoted field (an odd sum; a doubled
    quote changes nothing).
2.  Every range cuts its lines into records at the line breaks outside quotes.
    What a range has of a record that began before it, or that goes on behind
    it, are pieces; the pieces of all ranges, two for a range at most, are put
    together in a small second step.

Records are parsed by Spark's own CSV parser.  The file's lines are never
shuffled.  The table that is broadcast has one row per byte range, as the
driver's own list of splits has.
"""
from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from petrel.session import ensure_checkpoint_dir, ship_package

QUOTE = '"'
RECORDS = "file string, block long, part int, first boolean, record string"
#: What a row of ``records`` is: a whole record, the end of one that began before, the start of one, the middle of one.
WHOLE, END, START, MIDDLE = range(4)


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, line): lines in the order of each byte range; only a line feed ends a line."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def ranges(lines: DataFrame) -> DataFrame:
    """(file, block, inside): whether a byte range starts inside quotes; a file that ends inside quotes fails the job."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit(QUOTE), F.lit("")))
    per = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    order = Window.partitionBy("file").orderBy("block")                        # a row per byte range
    before = F.coalesce(F.sum("quotes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum("quotes").over(Window.partitionBy("file"))
    unclosed = F.raise_error(F.concat(F.lit("a quoted field is not closed in "), F.col("file"))).cast("boolean")
    return per.select("file", "block", F.when(whole % 2 == 1, unclosed).otherwise(before % 2 == 1).alias("inside"))


def _joined(lines: pa.Array, starts: np.ndarray) -> pa.Array:
    """Lines put together by line feeds, a new string at each of ``starts`` (the first is 0)."""
    column = lines.cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    size = np.diff(at)
    inner = np.ones(len(size), bool)                   # lines with another one of the same record behind them
    inner[starts[1:] - 1] = False
    inner[-1] = False
    ends = np.cumsum(size + inner)
    out = np.full(int(ends[-1]), 10, np.uint8)
    if at[-1] > at[0]:
        taken = np.ones(len(out), bool)
        taken[ends[inner] - 1] = False
        out[taken] = np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[-1]]
    offsets = np.concatenate([[0], ends[np.append(starts[1:], len(size)) - 1]]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(out)]).cast(pa.string())


class _Range:
    """Cuts the lines of one byte range, batch by batch; holds one open record."""

    def __init__(self, file: str, block: int, inside: bool):
        self.file, self.block, self.inside = file, block, inside
        self.part = END if inside else WHOLE            # what the open record is, once it is complete
        self.first = not inside and block == 0          # the next record is the file's first
        self.open: list[str] = []

    def row(self, part: int, texts: pa.Array, first: np.ndarray) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.file] * n, pa.string()), pa.array(np.full(n, self.block)), pa.array(np.full(n, part, np.int32)),
             pa.array(first), texts], ["file", "block", "part", "first", "record"])

    def add(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        odd = np.cumsum(pc.count_substring(lines, QUOTE).to_numpy(zero_copy_only=False)) % 2 == 1
        ends = np.flatnonzero(odd == self.inside)       # lines behind which no quote is open
        self.inside ^= bool(odd[-1])
        if not len(ends):
            self.open += lines.to_pylist()
            return
        done = lines.slice(0, int(ends[-1]) + 1)
        starts = np.concatenate([[0], ends[:-1] + 1])
        records = _joined(done, starts)
        first = np.zeros(len(records), bool)
        first[0] = self.first
        self.first = False
        if self.open or self.part == END:               # the first one was open
            text = "\n".join([*self.open, records[0].as_py()])
            yield self.row(self.part, pa.array([text]), first[:1])
            records, first = records.slice(1), first[1:]
        self.part, self.open = WHOLE, lines.slice(len(done)).to_pylist()
        if len(records):
            yield self.row(WHOLE, records, first)

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.open:
            part = MIDDLE if self.part == END else START
            yield self.row(part, pa.array(["\n".join(self.open)]), np.array([self.first]))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: _Range | None = None
    last = -1
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.column("at").to_numpy()
        if at[0] <= last or (np.diff(at) <= 0).any():
            raise RuntimeError("lines are not in the order of the file")
        last = int(at[-1])
        block = batch.column("block").to_numpy()
        file = batch.column("file").dictionary_encode().indices.to_numpy()
        new = np.flatnonzero((np.diff(block) != 0) | (np.diff(file) != 0)) + 1
        for s, e in zip([0, *new.tolist()], [*new.tolist(), len(block)]):
            name, start = batch.column("file")[s].as_py(), int(block[s])
            if now is None or (now.file, now.block) != (name, start):
                if now is not None:
                    yield from now.close()
                now = _Range(name, start, batch.column("inside")[s].as_py())
            yield from now.add(batch.column("line").slice(s, e - s))
    if now is not None:
        yield from now.close()


def records(spark: SparkSession, path: str) -> DataFrame:
    """(first, record): the records of all files under ``path`` as text; ``first`` marks a file's first record."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    lines = file_lines(spark, path)
    known = ranges(lines).checkpoint()
    other = F.raise_error(F.lit("the files were divided differently in the two passes; read again")).cast("boolean")
    flagged = lines.join(F.broadcast(known), ["file", "block"], "left").select(
        "file", "block", "at", F.coalesce("inside", other).alias("inside"), "line")
    cut = flagged.mapInArrow(_cut, RECORDS)
    # the pieces between: a start, middles, an end, in the order of the ranges (an end precedes a start of its range)
    pieces = cut.where(F.col("part") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", "part")
    number = F.sum((F.col("part") == START).cast("int")).over(order)
    whole = (pieces.withColumn("number", number).groupBy("file", "number")
             .agg(F.sort_array(F.collect_list(F.struct("block", "part", "first", "record"))).alias("p"))
             .select(F.col("p")[0]["first"].alias("first"), F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record")))
    return cut.where(F.col("part") == WHOLE).select("first", "record").unionByName(whole)


def read_split_csv(spark: SparkSession, path: str, schema: str, options: Mapping[str, str]) -> DataFrame:
    """Rows of CSV files with a header.  Records may end with a line feed or with carriage return and line feed;
    empty records are skipped.  A quote may occur in quoted fields only, doubled, as CSV writers put it."""
    text = F.regexp_replace("record", r"\r\z", "")
    rows = records(spark, path).where(~F.col("first")).select(text.alias("record")).where("record <> ''")
    parsed = F.from_csv("record", F.lit(schema), {**options, "mode": "FAILFAST", "multiLine": "true"})
    return rows.select(parsed.alias("row")).select("row.*")
