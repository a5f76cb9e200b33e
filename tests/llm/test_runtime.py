"""Packed numbers, columns as bytes, blocks of texts."""
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from petrel.llm import textblocks
from petrel.llm.runtime import column_bytes, drop, ints, squeeze, stored, unints, unsqueeze


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-2 ** 63, 2 ** 63 - 1), max_size=30))
def test_numbers_round_trip(values):
    assert unints(ints(np.array(values, np.int64))).tolist() == values


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=2000))
def test_compressed_bytes_round_trip(data):
    assert unsqueeze(squeeze(data)) == data


def test_columns_as_bytes():
    body, ends = column_bytes(pa.array(["é", None, "", "abc"]).slice(1))
    assert body.tobytes() == b"abc" and ends.tolist() == [0, 0, 3]
    body, ends = column_bytes(pa.array([], pa.string()))
    assert not len(body) and not len(ends)


def test_blocks_hold_every_row_in_order(spark, frame):
    rows = [(i, "x" * (i % 7) * 1000) for i in range(300)] + [(None, "last"), (5, None), (6, "long " * 700_000)]
    table = textblocks.text_blocks(frame(rows, "doc_id long, text string"), "doc_id", "text", "t")
    blocks = [textblocks.unpack(r.asDict()) for r in table.collect()]
    assert len({b.block for b in blocks}) == len(blocks)
    got = [(None if i == textblocks.NO_ID else int(i), b.body[s:e].tobytes().decode())
           for b in blocks for i, s, e in zip(b.ids, b.starts, b.ends)]
    assert sorted(got, key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert all(len(b.body) <= textblocks.BLOCK_BYTES or len(b.ids) == 1 or len(b.body) - np.diff(b.ends, prepend=0).max()
               < textblocks.BLOCK_BYTES for b in blocks)


def test_dropped_tables_are_gone(spark):
    import pytest
    table = stored(spark.range(10).toDF("id"), "t")
    assert table.count() == 10
    drop(table)
    with pytest.raises(Exception):
        table.select("id").collect()
