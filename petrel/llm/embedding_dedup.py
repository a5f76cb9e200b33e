"""Near copies among vectors of a label, exactly, by PCA-ordered tiles.

Equal vectors of a label are one vertex, numbered as it is written; ids name
components only at the end.  Vectors are rotated to the principal
axes of all (unit) vectors, which keeps products and puts most of a product
into the leading dimensions, and sorted by label and by a curve through the
``BOX`` leading coordinates (their bits in turn) into tiles of ``TILE`` vectors.
Vectors with cosine >= c are at most sqrt(2 - 2c) apart, so only tiles of a
label are compared whose boxes in these coordinates come that close.

Two tiles are compared some dimensions at a time.  The product over the
leading dimensions plus the product of the norms of what is left bounds the
cosine; a pair goes when its bound falls below c, and the tiles are done when
no pair is left.  For the pairs that remain the cosine is computed from the
vectors as given, in double precision.

A pair of tiles returns each vector's number of links and the stars of its
components, not the links, so a group of copies costs a row per member.

Vectors that are null, zero, or hold null or non-finite components, and
vectors without a label, link with nothing; vectors of different lengths do
not link.  Rows of one id are rows of their own, each with its own links.  A
row without an id counts as the one with the largest: its component is named
by another row's id if there is one, else null.  ``kept`` says that a row's id
is its component's, so all rows of that id are kept, and rows without an id
where no row of the component has one.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrel.llm.graph import components, stars
from petrel.llm.runtime import setup, stored, wide
from petrel.llm.textblocks import NO_ID

TILE = 1024
BOX, BITS = 4, 8                           # leading coordinates of a tile's box; bits of each that order the vectors
STEPS = (8, 16, 32, 64, 128, 256, 512)     # leading dimensions after which pairs are given up
MARGIN = 1e-9                              # of the bounds, for rounding


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite."""
    v = vector.cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(~bad, F.lit(False)) & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def by_length(batch: pa.RecordBatch, at: int):
    """The parts of a batch whose vectors (column ``at``) have one length."""
    sizes = batch.column(at).value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        yield int(n), batch.take(pa.array(np.flatnonzero(sizes == n)))


def unit(m: np.ndarray) -> np.ndarray:
    """Rows divided by their norms; scaled first, so that no square overflows."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _moments(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for n, part in by_length(batch, 0):
            u = unit(matrix(part.column(0)))
            sums[n] = sums.get(n, 0) + u.T @ u
    for n, m in sums.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([n] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([x.tobytes() for x in m])],
            ["n", "i", "row"])


def _add(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.float64) for x in t.column("row").to_pylist())
    return pa.table({"n": t.column("n")[:1], "i": t.column("i")[:1], "row": pa.array([total.tobytes()])})


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length, the principal axes (columns, descending) of all unit vectors.

    Sums of products over all rows, added up on Spark; one square matrix for
    each length of vectors reaches the driver."""
    sums = vectors.mapInArrow(_moments, "n int, i int, row binary").groupBy("n", "i").applyInArrow(
        _add, "n int, i int, row binary")
    rows: dict[int, dict[int, np.ndarray]] = {}
    for r in sums.collect():
        rows.setdefault(r["n"], {})[r["i"]] = np.frombuffer(r["row"], np.float64)
    out = {}
    for n, m in rows.items():
        values, axes = np.linalg.eigh(np.array([m[i] for i in range(n)]))
        out[n] = np.ascontiguousarray(axes[:, ::-1])
    return out


def curve(lead: np.ndarray) -> np.ndarray:
    """Places of points of [-1, 1]^d on a curve that keeps near points near: the bits of their coordinates in turn."""
    cell = np.clip(((lead + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    out = np.zeros(len(lead), np.int64)
    for bit in range(BITS - 1, -1, -1):
        for d in range(lead.shape[1]):
            out = out << 1 | cell[:, d] >> bit & 1
    return out


def _leading(axes: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            for n, part in by_length(batch, 3):
                lead = np.zeros((len(part), BOX))
                lead[:, :min(n, BOX)] = unit(matrix(part.column(3))) @ axes[n][:, :BOX]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([n] * len(lead), pa.int32()), pa.array(curve(lead)), pa.array(list(lead))],
                    [*part.schema.names, "n", "place", "lead"])
    return run


TILES = ("tile long, label long, n int, " + ", ".join(f"low{d} double, high{d} double" for d in range(BOX))
         + ", ids binary, copies binary, vectors binary")


def _tiles(batches):
    from pyspark import TaskContext
    number = TaskContext.get().partitionId() << 32

    def out(rows: pa.Table):
        nonlocal number
        lead = matrix(rows.column("lead"))
        number += 1
        box = [pa.array([x[d]]) for d in range(BOX) for x in (lead.min(axis=0), lead.max(axis=0))]
        return pa.RecordBatch.from_arrays(
            [pa.array([number - 1], pa.int64()), rows.column("label")[:1].combine_chunks(), rows.column("n")[:1].combine_chunks(), *box,
             pa.array([rows.column("rep").to_numpy().astype(np.int64).tobytes()]),
             pa.array([rows.column("copies").to_numpy().astype(np.int64).tobytes()]),
             pa.array([matrix(rows.column("v")).tobytes()])],
            [c.split()[0] for c in TILES.split(", ")])

    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        while held.num_rows:
            label, n = held.column("label").to_numpy(), held.column("n").to_numpy()
            same = int(np.argmax((label != label[0]) | (n != n[0]))) or len(label)
            if same < TILE and same == len(label):
                break
            yield out(held.slice(0, min(same, TILE)))
            held = held.slice(min(same, TILE))
    if held is not None and held.num_rows:
        yield out(held)


def apart() -> str:
    """The squared distance of the boxes of two tiles, as an SQL expression."""
    gaps = [f"greatest(a_low{d} - b_high{d}, b_low{d} - a_high{d}, 0D)" for d in range(BOX)]
    return " + ".join(f"{g} * {g}" for g in gaps)


def close_pairs(a: np.ndarray, b: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (each once, if ``same``) of rotated unit vectors whose cosine may reach ``least``."""
    n = a.shape[1]
    ends = [s for s in STEPS if s < n] + [n]
    product, at = np.zeros((len(a), len(b))), 0
    i = j = None
    for end in ends:
        if i is None:
            product += a[:, at:end] @ b[:, at:end].T
        else:
            product = product + np.einsum("ij,ij->i", a[i, at:end], b[j, at:end])
        rest_a, rest_b = np.linalg.norm(a[:, end:], axis=1), np.linalg.norm(b[:, end:], axis=1)
        if i is None:
            keep = product + rest_a[:, None] * rest_b[None, :] >= least - MARGIN
            if same:
                keep &= np.tri(len(a), len(b), -1, dtype=bool).T
            left = np.count_nonzero(keep)
            if left * 8 <= keep.size or end == n:        # few pairs: go on with a list of them
                i, j = np.nonzero(keep)
                product = product[i, j]
        else:
            keep = product + rest_a[i] * rest_b[j] >= least - MARGIN
            i, j, product = i[keep], j[keep], product[keep]
        if i is not None and not len(i):
            break
        at = end
    return i, j


def _compare(axes: dict[int, np.ndarray], least: float):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                n, same = r["n"], r["a"] == r["b"]
                ids = [np.frombuffer(r[x + "_ids"], np.int64) for x in "ab"]
                copies = [np.frombuffer(r[x + "_copies"], np.int64) for x in "ab"]
                raw = [np.frombuffer(r[x + "_vectors"], np.float64).reshape(-1, n) for x in "ab"]
                i, j = close_pairs(unit(raw[0]) @ axes[n], unit(raw[1]) @ axes[n], least, same)
                if len(i):
                    x, y = (m / np.abs(m).max(axis=1, keepdims=True) for m in (raw[0][i], raw[1][j]))
                    cosine = np.einsum("ij,ij->i", x, y) / np.sqrt(
                        np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
                    i, j = i[cosine >= least], j[cosine >= least]
                if not len(i):
                    continue
                links = [np.bincount(p, weights=c[q], minlength=len(d)).astype(np.int64)
                         for p, q, c, d in ((i, j, copies[1], ids[0]), (j, i, copies[0], ids[1]))]
                u, v = stars(ids[0][i], ids[1][j])
                own = [np.flatnonzero(x) for x in links]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([u, ids[0][own[0]], ids[1][own[1]]])),
                     pa.array([*v.tolist(), *[None] * (len(own[0]) + len(own[1]))], pa.int64()),
                     pa.array(np.concatenate([np.zeros(len(u), np.int64), links[0][own[0]], links[1][own[1]]]))],
                    ["u", "v", "links"])
    return run


def near_vectors(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    setup(spark)
    src = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"),
                         F.col(label_col).cast("long").alias("label"),
                         F.col(vector_col).cast("array<double>").alias("v"))
    src = src.withColumn("ok", F.col("label").isNotNull() & usable(F.col("v")))
    good = src.where("ok").withColumn("hash", F.xxhash64("v"))
    reps = stored(good.groupBy("label", "hash", "v").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
                  .withColumn("rep", F.monotonically_increasing_id()), "vector-firsts")
    axes = principal_axes(reps.select("v"))
    order = ["label", "n", "place", "rep"]
    lead = stored(reps.select("label", "rep", "copies", "v").mapInArrow(
        _leading(axes), "label long, rep long, copies long, v array<double>, n int, place long, lead array<double>"), "vector-leads")
    tiles = stored(lead.repartitionByRange(wide(spark), *order).sortWithinPartitions(*order).mapInArrow(_tiles, TILES),
                   "vector-tiles")
    reach = math.sqrt(max(0.0, 2 - 2 * least)) + MARGIN
    box = [f"{side}{d}" for side in ("low", "high") for d in range(BOX)]
    x, y = (tiles.select("label", "n", *[F.col(c).alias(f"{s}_{c}") for c in box], F.col("tile").alias(s)) for s in "ab")
    pairs = x.join(y, ["label", "n"]).where(f"a <= b and {apart()} <= {reach * reach!r}D")
    x, y = (tiles.select(F.col("tile").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("ids", "copies", "vectors")])
            for s in "ab")
    pairs = pairs.select("n", "a", "b").repartition(wide(spark), "a", "b").join(x, "a").join(y, "b")
    found = stored(pairs.mapInArrow(_compare(axes, least), "u long, v long, links long"), "vector-links")
    counts = found.where("v is null").groupBy("u").agg(F.sum("links").alias("links"))
    groups = components(found.where("v is not null").select("u", "v"), "vector-stars")
    names = (groups.join(reps.select(F.col("rep").alias("id"), "first"), "id")
             .groupBy("component").agg(F.min("first").alias("name")))
    named = groups.join(names, "component").select("id", "name")
    firsts = (reps.join(counts, reps["rep"] == counts["u"], "left").drop("u")
              .join(named, reps["rep"] == named["id"], "left")
              .select("label", "hash", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                      F.coalesce("name", "first").alias("component_id")))
    out = good.join(firsts, ["label", "hash", "v"]).select("id", "n_links", "component_id").unionByName(
        src.where(~F.col("ok")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    none = F.lit(None).cast("long")
    return out.select(F.when(F.col("id") == NO_ID, none).otherwise(F.col("id")).alias("vec_id"), "n_links",
                      F.when(F.col("component_id") == NO_ID, none).otherwise(F.col("component_id")).alias("component_id"),
                      (F.col("id") == F.col("component_id")).alias("kept"))
