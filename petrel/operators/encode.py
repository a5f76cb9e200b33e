"""Encoding: token -> id and id -> token look-ups, model input.

A table of a bounded number of entries goes to the tasks, and every array is
mapped where it is (``mapped``): no token leaves its row.  For larger tables,
rows are dealt into blocks, the distinct tokens of each block are joined with
the table, and every array is mapped by what its block has found
(``lookup_blocks``).  Keys and elements of other types than strings and whole
numbers are exploded, joined, and regrouped per document.
The regrouping ``collect_list`` aggregates partially on the map side: every
document's tokens sit in one input split, so the shuffle moves one array per
document, not one row per token.  Documents without tokens survive through
``posexplode_outer``.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from petrel.functions import arrays as A
from petrel.operators.heavy import hot_words
from petrel.session import ensure_checkpoint_dir, ship_package

OOV_ID = 1
#: Entries of a table that is sent to the tasks.
ENTRIES = 50_000
#: Elements of a block of rows, on average; a task holds those of one block.
BLOCK = 1_000_000


def lookup_array(df: DataFrame, arr: str, table: DataFrame, tkey: str, tval: str,
                 out: str, key: str = "doc_id", on_missing: str = "drop",
                 default: int | None = None,
                 keep_last: int | None = None, carry: Sequence[str] = (), hot: bool = False) -> DataFrame:
    """Map every element of ``arr`` through ``table`` (tkey -> tval), in order.

    ``on_missing``: "drop" the element, use ``default``, or "error".
    ``keep_last``: only the last n elements are looked up (exact when nothing is
    dropped, e.g. before left truncation to length n).
    A table of up to ``ENTRIES`` entries is read by the driver and sent to the
    tasks (see ``mapped``).  ``hot`` is for tables beyond that, which are not
    read for it.  A larger one meets the distinct elements of blocks of rows
    (see ``lookup_blocks``); ``df`` is then read twice.  With other types
    elements are joined one by one: those that would fill a shuffle
    partition (if ``hot``) are found by their counts, and their entries are
    broadcast; only the others are shuffled.
    ``key`` with ``carry`` must be unique: a repeated one fails the job.
    """
    cols = [key, *carry]
    if not hot:
        entries = _entries(df, arr, table, tkey, tval)
        if entries is not None:
            return mapped(df, arr, entries, out, cols, on_missing, default, keep_last)
    types = [df.schema[c].dataType for c in cols] + [table.schema[tval].dataType, table.schema[tkey].dataType]
    if df.schema[arr].dataType.elementType == types[-1] and all(t in _ATOMS for t in types):
        return lookup_blocks(df, arr, table, tkey, tval, out, cols, on_missing, default, keep_last)
    ex = df.select(*cols, F.size(arr).alias("_n"), F.posexplode_outer(arr).alias("_pos", "_tok"))
    if keep_last is not None:
        ex = ex.where(F.col("_tok").isNull() | (F.col("_pos") >= F.col("_n") - F.lit(keep_last)))
    tbl = table.select(F.col(tkey).alias("_tok"), F.col(tval).alias("_val"))
    joined = head_tail_join(ex, tbl, hot_words(df, arr)) if hot else ex.join(tbl, "_tok", "left")
    val = F.col("_val")
    if on_missing == "default":
        val = F.coalesce(val, F.lit(default))
    elif on_missing == "error":
        val = F.when(val.isNull(), F.raise_error(
            F.concat(F.lit("no table entry for "), F.col("_tok").cast("string")))).otherwise(val)
    present = F.col("_tok").isNotNull() & val.isNotNull()
    most = F.max("_n") if keep_last is None else F.least(F.max("_n"), F.lit(keep_last))
    one = A.check_unique(key, F.count("_pos"), most).alias("_one")
    if dict(tbl.dtypes)["_val"] == "int":
        # (pos, value) packed into one long: pos in the high half, the value's
        # 32 bits in the low half, so a primitive sort restores token order
        low = F.col("_val_i").cast("long").bitwiseAND(F.lit(_LOW32))
        packed = F.shiftleft(F.col("_pos").cast("long"), 32).bitwiseOR(low)
        grouped = (joined.withColumn("_val_i", val)
                   .groupBy(*cols).agg(F.sort_array(F.collect_list(F.when(present, packed))).alias("_s"), one))
        return grouped.where("_one").select(*cols, F.transform("_s", _unpack_int).alias(out))
    elem = F.when(present, F.struct(F.col("_pos"), val.alias("_v")))
    grouped = joined.groupBy(*cols).agg(F.array_sort(F.collect_list(elem)).alias("_s"), one)
    return grouped.where("_one").select(*cols, F.transform("_s", lambda s: s["_v"]).alias(out))


_ATOMS = {ST.StringType(): pa.string(), ST.IntegerType(): pa.int32(), ST.LongType(): pa.int64()}


def _entries(df: DataFrame, arr: str, table: DataFrame, tkey: str, tval: str) -> tuple[pa.Array, pa.Array] | None:
    """Keys and values of a table for ``mapped``; None if it is too large, has a key twice or other types."""
    elem, kind, val = df.schema[arr].dataType.elementType, table.schema[tkey].dataType, table.schema[tval].dataType
    if elem != kind or kind not in _ATOMS or val not in _ATOMS:
        return None
    rows = table.select(F.col(tkey), F.col(tval)).where(F.col(tkey).isNotNull()).limit(ENTRIES + 1).collect()
    if len(rows) > ENTRIES or len({r[0] for r in rows}) < len(rows):
        return None
    return pa.array([r[0] for r in rows], _ATOMS[kind]), pa.array([r[1] for r in rows], _ATOMS[val])


def _mapper(keys: pa.Array, values: pa.Array, on_missing: str, default: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _found(batch.column(batch.num_columns - 1), keys, values, on_missing, default)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], out], names=batch.schema.names)
    return run


def _found(lists: pa.Array, keys: pa.Array, values: pa.Array, on_missing: str, default: int | None) -> pa.Array:
    words = lists.flatten()
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    found = values.take(pc.index_in(words, value_set=keys))
    there = pc.is_valid(words)
    lost = pc.and_(there, pc.is_null(found))
    if on_missing == "error" and pc.any(lost).as_py():
        raise ValueError(f"no table entry for {words.filter(lost)[0].as_py()}")
    if on_missing == "default":
        found = pc.if_else(lost, pa.scalar(default, values.type), found)
    keep = pc.is_valid(found)
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    kept = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False), dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(kept[ends], pa.int32()), found.filter(keep))


def _last(arr: str, keep_last: int | None) -> Column:
    a = F.col(arr)
    if keep_last is None:
        return a
    return F.slice(a, F.greatest(F.size(a) - F.lit(keep_last), F.lit(0)) + F.lit(1), F.lit(keep_last))


def mapped(df: DataFrame, arr: str, entries: tuple[pa.Array, pa.Array], out: str, cols: Sequence[str], on_missing: str,
           default: int | None, keep_last: int | None) -> DataFrame:
    """``lookup_array`` by the ``entries`` (keys, values) in every task; rows stay where they are.

    Only ``cols`` are shuffled, to fail the job if they repeat."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    rows = df.select(*cols, _last(arr, keep_last).alias(out))
    value = next(t for t, kind in _ATOMS.items() if kind == entries[1].type)
    schema = ST.StructType([*[df.schema[c] for c in cols], ST.StructField(out, ST.ArrayType(value))])
    ids = rows.mapInArrow(_mapper(*entries, on_missing, default), schema)
    shown = F.coalesce(F.col(cols[0]).cast("string"), F.lit("null"))
    twice = (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
             .select(shown.alias("_k")).orderBy("_k").limit(1)).scalar()
    fail = F.raise_error(F.concat(F.lit("repeated key "), twice)).cast("boolean")
    return ids.where(F.when(twice.isNotNull(), fail).otherwise(F.lit(True)))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, element): the distinct elements of each block; the rows come sorted by block."""
    at, held = None, []

    def words():
        one = pa.concat_arrays(held).unique().drop_null()
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(one), at, np.int64)), one], ["_b", "_tok"])

    for batch in batches:
        block, lists = batch.column(0).to_numpy(), batch.column(batch.num_columns - 1)
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for lo, hi in zip(cuts, cuts[1:]):
            if lo < hi:
                if held and block[lo] != at:
                    yield words()
                    held.clear()
                at = int(block[lo])
                held.append(lists.slice(lo, hi - lo).flatten().unique())
    if held:
        yield words()


def _one_each(rows: pa.Table, cols: list[str], sizes: pa.Array) -> pa.Table:
    """A row per key, as ``check_unique`` asks: of equal keys, at most one row has elements."""
    place = pa.array(np.arange(len(rows)))
    keys = pa.Table.from_arrays([*(rows[c] for c in cols), sizes, place], [*(f"k{i}" for i in range(len(cols))), "n", "i"])
    found = keys.group_by([f"k{i}" for i in range(len(cols))]).aggregate([("n", "sum"), ("n", "max"), ("i", "min")])
    if len(found) == len(rows):
        return rows
    twice = found.filter(pc.greater(found["n_sum"], found["n_max"]))
    if len(twice):
        raise ValueError(f"repeated key {twice['k0'][0].as_py()}")
    full = keys.filter(pc.greater(keys["n"], 0))
    empty = found.filter(pc.equal(found["n_max"], 0))
    return rows.take(pa.concat_arrays([*full["i"].chunks, *empty["i_min"].chunks]))


def lookup_blocks(df: DataFrame, arr: str, table: DataFrame, tkey: str, tval: str, out: str, cols: Sequence[str],
                  on_missing: str, default: int | None, keep_last: int | None) -> DataFrame:
    """``lookup_array`` by a table of any size: rows are dealt by their keys into blocks of ``BLOCK`` elements on
    average, and each block's distinct elements are joined with the table.

    So a frequent element is joined once a block, and arrays are shuffled whole.  The number of blocks grows with the
    elements.  A repeated key, and an element that the table holds twice, fail the job."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    cols = list(cols)
    rows = df.select(*cols, _last(arr, keep_last).alias(out))
    total = rows.agg(F.sum(F.greatest(F.size(out), F.lit(0)).cast("long"))).first()[0] or 0
    block = F.pmod(F.xxhash64(*cols), F.lit(total // BLOCK + 1)).alias("_b")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(block, *cols, out).repartition(tasks, "_b").sortWithinPartitions("_b")
    word, value = (dict(t.dtypes)[c] for t, c in ((table, tkey), (table, tval)))
    tbl = table.select(F.col(tkey).alias("_tok"), F.col(tval).alias("_val"))
    found = dealt.mapInArrow(_distinct, f"_b long, _tok {word}").join(tbl, "_tok", "left").select("_b", "_tok", "_val")
    kind = _ATOMS[table.schema[tval].dataType]

    def of_block(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.combine_chunks(), right.combine_chunks()
        keys = pa.concat_arrays([pa.array([], right.schema.field("_tok").type), *right["_tok"].chunks])
        values = pa.concat_arrays([pa.array([], kind), *right["_val"].chunks])
        if len(keys.unique()) < len(keys):
            counts = keys.value_counts()
            of = pc.is_in(left[out].combine_chunks().flatten(), counts.field("values").filter(pc.greater(counts.field("counts"), 1)))
            rows = pc.list_parent_indices(left[out].combine_chunks())
            raise ValueError(f"repeated key {left[cols[0]][rows.filter(of)[0].as_py()].as_py()}: an element of it is twice in the table")
        sizes = pc.fill_null(pc.list_value_length(left[out]), 0).combine_chunks()
        left = _one_each(left, cols, sizes).combine_chunks()
        ids = [_found(x, keys, values, on_missing, default) for x in left[out].chunks]
        return pa.Table.from_arrays([*(left[c] for c in cols), pa.chunked_array(ids, pa.list_(kind))], [*cols, out])

    schema = ST.StructType([*[df.schema[c] for c in cols], ST.StructField(out, ST.ArrayType(table.schema[tval].dataType))])
    return dealt.groupBy("_b").cogroup(found.groupBy("_b")).applyInArrow(of_block, schema)


def head_tail_join(rows: DataFrame, table: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` left join ``table`` on _tok: entries of the ``hot`` words broadcast, the others' rows shuffled.

    A hot word that the table does not hold is settled by the broadcast, too."""
    hot = hot.select(F.col("word").alias("_tok"))
    head = hot.join(table, "_tok", "left").withColumn("_hot", F.lit(True)).checkpoint()
    marked = rows.join(F.broadcast(head), "_tok", "left")
    settled = F.col("_hot").isNotNull() | F.col("_tok").isNull()
    tail = marked.where(~settled).drop("_val", "_hot").join(table, "_tok", "left")
    return marked.where(settled).drop("_hot").unionByName(tail)


_LOW32 = 0xFFFFFFFF


def _unpack_int(x):
    low = x.bitwiseAND(F.lit(_LOW32))
    return F.when(low >= F.lit(1 << 31), low - F.lit(1 << 32)).otherwise(low).cast("int")


def encode(df: DataFrame, vocab: DataFrame, num_words: int | None = None, oov: bool = True,
           tokens: str = "tokens", out: str = "ids", key: str = "doc_id",
           keep_last: int | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Words -> ids (E1).  Ids at or above ``num_words``, and unknown words, map
    to the OOV id 1, or are dropped when there is no OOV entry.

    Without ``num_words`` the vocabulary may be too large to broadcast: hot words
    go apart (see ``lookup_array``).

    ``keep_last`` (only with OOV, where lengths are preserved) looks up just the
    tail that left truncation will keep, so each document costs at most that
    many rows.
    """
    if keep_last is not None and not oov:
        raise ValueError("keep_last needs an OOV id: dropping words shifts the tail")
    table = vocab.select("word", "idx")
    if num_words is not None:
        table = table.filter(F.col("idx") < F.lit(num_words))
    return lookup_array(df, tokens, table, "word", "idx", out, key=key,
                        on_missing="default" if oov else "drop",
                        default=OOV_ID if oov else None,
                        keep_last=keep_last, carry=carry, hot=num_words is None)


def pieces_to_ids(df: DataFrame, vocab: DataFrame, unk_id: int, pieces: str = "pieces",
                  out: str = "ids", key: str = "doc_id", carry: Sequence[str] = ()) -> DataFrame:
    """Sub-word piece -> id, unknown -> ``unk_id`` (E2).  ``vocab``: (token, id)."""
    return lookup_array(df, pieces, vocab, "token", "id", out, key=key,
                        on_missing="default", default=unk_id, carry=carry)


def ids_to_tokens(df: DataFrame, vocab: DataFrame, ids: str = "ids", out: str = "tokens",
                  key: str = "doc_id", carry: Sequence[str] = ()) -> DataFrame:
    """Id -> piece; an id outside the vocabulary fails the job."""
    return lookup_array(df, ids, vocab, "id", "token", out, key=key,
                        on_missing="error", carry=carry)


def model_input(ids: Column | str, length: int, cls_id: int, sep_id: int, pad_id: int,
                pair: Column | str | None = None) -> Column:
    """Struct(ids, mask, segment) for one text or a pair (E12 with E5-E11).

    Content is cut to the room left by the special ids (L-2, or L-3 for a pair,
    taken from the first text first), then padded on the right with ``pad_id``.
    Mask and segment are built per position.
    """
    a = F.col(ids) if isinstance(ids, str) else ids
    room = A.content_len(length, pair is not None)
    a_cut = F.slice(a, 1, room)
    if pair is None:
        full = A.add_special(a_cut, cls_id, sep_id)
        types = A.token_types(a_cut)
    else:
        b = F.col(pair) if isinstance(pair, str) else pair
        b_cut = F.slice(b, F.lit(1), F.greatest(F.lit(room) - F.size(a_cut), F.lit(0)))
        full = A.add_special(a_cut, cls_id, sep_id, b_cut)
        types = A.token_types(a_cut, b_cut)
    padded = A.pad_post(full, length, pad_id)
    return F.struct(padded.alias("ids"),
                    A.attention_mask(padded, pad_id).alias("mask"),
                    A.pad_post(types, length, 0).alias("segment"))


def model_input_padded(ids: Column | str, one_hot: Column | str, pad_id: int = 0) -> Column:
    """Struct(ids, mask, segment, target) for already padded ids and one-hot
    labels (E12, second variant): mask per position, all-zero segments, target
    = first argmax of the one-hot vector."""
    a = F.col(ids) if isinstance(ids, str) else ids
    return F.struct(a.alias("ids"), A.attention_mask(a, pad_id).alias("mask"),
                    A.segments(F.size(a)).alias("segment"), A.argmax(one_hot).alias("target"))
