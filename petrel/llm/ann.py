"""Approximate nearest neighbours by learned partitions.

1.  *Partition.*  On a bounded sample (``SAMPLE`` vectors, the smallest by hash
    of their ids) the graph of each vector's nearest neighbours is divided into
    parts of nearly equal size with few edges between them.
2.  *Route.*  A small network (one hidden layer) learns to name a vector's
    part.  It places every vector of the table in its most probable part, and
    sends a query to its most probable parts.  A sample divides a table into
    ``SAMPLE`` / ``LEAST`` parts at most; where that leaves more than ``PART_ROWS``
    rows in a part, the part is divided and routed in the same way, by a sample
    of its own, in a task of its own; so parts grow in number, not in size.
3.  *Rerank.*  The query is compared with every vector of those parts by
    Euclidean distance in double precision.

How many parts a query visits is measured, not guessed: for ``TRIALS`` vectors
the true neighbours among all rows are found by comparison with everything (a
stated set against all rows, in blocks), and the smallest number of parts that
holds ``RECALL`` of them is used.

Vectors of a part lie in blocks of ``BLOCK`` rows and queries travel in
blocks, so a part that holds a third of all rows is many blocks in many tasks.
A task keeps ``k`` rows for each of its queries; distances that the fast
formula cannot tell apart are computed again from the differences.

Vectors that are null, zero, or hold null or non-finite components take no
part, nor do vectors of another length than the most frequent one, or rows
without an id.  Rows of one id are rows of their own, told apart by a number
given when the vectors are stored: each is a query with an answer of its own,
and a candidate of the other.
"""
from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from petrel.llm.embedding_dedup import matrix, usable
from petrel.llm.runtime import setup, stored, wide

SAMPLE = 4096       # vectors that the partition and the network are fitted on
TRIALS = 128        # vectors whose true neighbours set the number of visits
RECALL = 0.97       # share of them to be found
PART_ROWS = 4096    # rows of a part aimed at
LEAST = 32          # sampled vectors of a part, at least
CHUNK = 256         # queries whose parts are ordered together
BLOCK = 2048
QUERIES = 512


# --- fitting, on the sample ------------------------------------------------

def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row."""
    square = (x * x).sum(axis=1)
    out = np.empty((len(x), k), np.int64)
    for s in range(0, len(x), 512):
        d = square[s:s + 512, None] + square[None, :] - 2 * x[s:s + 512] @ x.T
        d[np.arange(len(d)), np.arange(s, s + len(d))] = np.inf
        out[s:s + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Parts of nearly equal size with few edges between them.

    Parts grow breadth-first from one seed after the other, then vertices move
    to the part of most of their neighbours while sizes allow."""
    n = len(graph)
    links: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            links[i].append(j)
            links[j].append(i)
    most = -(-n * 11 // (10 * parts))
    part = np.full(n, -1)
    free, order = 0, rng.permutation(n).tolist()
    for p in range(parts):
        room = -(-(n - int((part >= 0).sum())) // (parts - p))
        queue: list[int] = []
        while room:
            if not queue:
                while free < n and part[order[free]] >= 0:
                    free += 1
                if free == n:
                    break
                queue.append(order[free])
            v = queue.pop(0)
            if part[v] < 0:
                part[v] = p
                room -= 1
                queue.extend(w for w in links[v] if part[w] < 0)
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        moved = 0
        for v in rng.permutation(n).tolist():
            votes = np.bincount(part[links[v]], minlength=parts)
            votes[size >= most] = 0
            best = int(votes.argmax())
            if votes[best] > np.count_nonzero(part[links[v]] == part[v]):
                size[part[v]] -= 1
                size[best] += 1
                part[v] = best
                moved += 1
        if not moved:
            break
    return part


class Router:
    """A network with one hidden layer: the log odds of a vector's parts."""

    def __init__(self, x: np.ndarray, part: np.ndarray, parts: int, rng: np.random.Generator, hidden: int = 128,
                 epochs: int = 60, rate: float = 2e-3):
        self.mean, self.scale = x.mean(axis=0), x.std() or 1.0
        x = (x - self.mean) / self.scale
        d = x.shape[1]
        self.w = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden),
                  rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
        one, two = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(x), 256):
                at = order[s:s + 256]
                h = np.maximum(x[at] @ self.w[0] + self.w[1], 0)
                z = h @ self.w[2] + self.w[3]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(at)), part[at]] -= 1
                p /= len(at)
                back = (p @ self.w[2].T) * (h > 0)
                step += 1
                for i, g in enumerate((x[at].T @ back, back.sum(axis=0), h.T @ p, p.sum(axis=0))):
                    one[i] = 0.9 * one[i] + 0.1 * g
                    two[i] = 0.999 * two[i] + 0.001 * g * g
                    self.w[i] -= rate * (one[i] / (1 - 0.9 ** step)) / (np.sqrt(two[i] / (1 - 0.999 ** step)) + 1e-8)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((x - self.mean) / self.scale) @ self.w[0] + self.w[1], 0)
        return h @ self.w[2] + self.w[3]


def fit(sample: np.ndarray, rows: int, k: int = 10, seed: int = 0, part_rows: int | None = None) -> Router:
    rng = np.random.default_rng(seed)
    parts = max(1, min(-(-rows // (part_rows or PART_ROWS)), len(sample) // LEAST))
    if parts == 1:
        return Router(sample, np.zeros(len(sample), np.int64), 1, rng, hidden=1, epochs=0)
    return Router(sample, balanced_parts(neighbour_graph(sample, min(k, len(sample) - 1)), parts, rng), parts, rng)


def log_share(z: np.ndarray) -> np.ndarray:
    """Logarithms of the softmax of each row."""
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


class Parts:
    """The router of the table and the routers of its divided parts; what is not divided is one part."""

    def __init__(self, top: Router, below: dict[int, Router] | None = None):
        self.top, self.below = top, below or {}
        size = [len(self.below[p].w[3]) if p in self.below else 1 for p in range(len(top.w[3]))]
        self.first = np.cumsum([0, *size])

    def __len__(self) -> int:
        return int(self.first[-1])

    def place(self, x: np.ndarray) -> np.ndarray:
        """The part of each row."""
        own = self.top(x).argmax(axis=1)
        out = self.first[own]
        for p in np.unique(own).tolist():
            if p in self.below:
                at = np.flatnonzero(own == p)
                out[at] += self.below[p](x[at]).argmax(axis=1)
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """The log probability of every part."""
        top = log_share(self.top(x))
        return np.concatenate([top[:, p:p + 1] + (log_share(self.below[p](x)) if p in self.below else 0.0)
                               for p in range(top.shape[1])], axis=1)


def _fit_part(rows: dict[int, int], part_rows: int):
    def run(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        t = t.sort_by("row")
        route = fit(matrix(t.column("v")), rows[part], seed=part + 1, part_rows=part_rows)
        return pa.table({"part": pa.array([part], pa.int32()), "route": pa.array([pickle.dumps(route)], pa.binary())})
    return run


def divided(good: DataFrame, top: Router, rows: int) -> Parts:
    """The parts of the table; each part above ``PART_ROWS`` rows gets a router fitted on at most ``SAMPLE`` of its rows."""
    parts = len(top.w[3])
    if rows <= 2 * parts * PART_ROWS:
        return Parts(top)
    shared = good.sparkSession.sparkContext.broadcast(top)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                own = shared.value(matrix(batch.column("v"))).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(own), batch.column("row"), batch.column("v")], ["part", "row", "v"])

    placed = stored(good.select("row", "v").mapInArrow(run, "part int, row long, v array<double>"), "vector-top")
    size = {r["part"]: r["count"] for r in placed.groupBy("part").count().collect() if r["count"] > 2 * PART_ROWS}
    order = Window.partitionBy("part").orderBy(F.xxhash64("row"), "row")
    sample = (placed.where(F.col("part").isin(list(size))).withColumn("n", F.row_number().over(order))
              .where(F.col("n") <= SAMPLE).drop("n"))
    routes = sample.groupBy("part").applyInArrow(_fit_part(size, PART_ROWS), "part int, route binary").collect()   # one for each part
    return Parts(top, {r["part"]: pickle.loads(r["route"]) for r in routes})


# --- exact distances ---------------------------------------------------------

class Nearest:
    """The k nearest of each query so far; ties to the smaller id.  Queries and candidates are named by row."""

    def __init__(self, k: int):
        self.k = k
        self.best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, query_rows: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        square = (vectors * vectors).sum(axis=1)
        own = (queries * queries).sum(axis=1)
        far = square[None, :] + own[:, None] - 2 * queries @ vectors.T
        slack = 1e-9 * (own[:, None] + square[None, :])         # more than what rounding can do
        for q in range(len(queries)):
            name = int(query_rows[q])
            d = far[q]
            if name in self.best and len(self.best[name][0]) == self.k:
                limit = self.best[name][0][-1] ** 2
                at = np.flatnonzero(d - slack[q] <= limit)
            else:
                at = np.arange(len(d))
            if len(at) > self.k + 1:
                kth = np.partition(d[at], self.k)[self.k]        # one more, for the query itself
                at = at[d[at] - slack[q][at] <= kth + slack[q][at].max()]
            at = at[rows[at] != name]
            if not len(at):
                continue
            gap = vectors[at] - queries[q]
            new = np.sqrt((gap * gap).sum(axis=1)), ids[at], rows[at]
            if name in self.best:
                new = tuple(np.append(x, y) for x, y in zip(self.best[name], new))
            order = np.lexsort((new[2], new[1], new[0]))[:self.k]
            self.best[name] = tuple(x[order] for x in new)

    def rows(self) -> pa.RecordBatch | None:
        if not self.best:
            return None
        size = [len(x[0]) for x in self.best.values()]
        score, ids, rows = (np.concatenate([x[i] for x in self.best.values()]) for i in range(3))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.fromiter(self.best, np.int64), size)), pa.array(ids), pa.array(rows), pa.array(score)],
            ["query", "vec_id", "row", "score"])


FOUND = "query long, vec_id long, row long, score double"


def _rerank(k: int, d: int):
    def run(batches):
        best = Nearest(k)
        for batch in batches:
            for q_rows, q, rows, ids, v in zip(*(c.to_pylist() for c in batch.columns)):
                best.add(np.frombuffer(q_rows, np.int64), np.frombuffer(q, np.float64).reshape(-1, d),
                         np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(v, np.float64).reshape(-1, d))
                if len(best.best) > 50_000:
                    yield best.rows()
                    best = Nearest(k)
        if best.best:
            yield best.rows()
    return run


def _visited(scores: np.ndarray, visits: int, held_by: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, part): the most probable ``visits`` parts of each query, and more until they hold ``least`` rows."""
    parts = np.argsort(-scores, axis=1, kind="stable")
    before = np.cumsum(held_by[parts], axis=1) - held_by[parts]
    use = ((np.arange(parts.shape[1]) < visits) | (before < least)) & (held_by[parts] > 0)
    i, j = np.nonzero(use)
    return i, parts[i, j]


def _blocks(route, size: int, visits: int, held_by: np.ndarray | None = None, least: int = 0):
    """Rows of each part in blocks.  With ``held_by``, the rows of each part, a row goes into its ``visits`` most
    probable parts, and into more until they hold ``least``."""
    def run(batches):
        held: dict[int, list] = {}
        count: dict[int, int] = {}

        def out(part):
            columns = [np.concatenate(x).tobytes() for x in zip(*held.pop(part))]
            count.pop(part)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([c]) for c in columns)],
                                              ["part", "rows", "ids", "vectors"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows, ids, x = batch.column("row").to_numpy(), batch.column("id").to_numpy(), matrix(batch.column("v"))
            if held_by is None:
                where, part = np.arange(len(x)), route.place(x)
            else:
                found = [_visited(route(x[s:s + CHUNK]), visits, held_by, least) for s in range(0, len(x), CHUNK)]
                where = np.concatenate([i + s * CHUNK for s, (i, _) in enumerate(found)])
                part = np.concatenate([p for _, p in found])
            order = np.argsort(part, kind="stable")
            where, part = where[order], part[order]
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else part
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(part)]):
                p, at = int(part[a]), where[a:b]
                for s in range(0, len(at), size):
                    piece = at[s:s + size]
                    held.setdefault(p, []).append((rows[piece], ids[piece], x[piece]))
                    count[p] = count.get(p, 0) + len(piece)
                    if count[p] >= size:
                        yield out(p)
        for p in list(held):
            yield out(p)
    return run


BLOCKS = "part int, rows binary, ids binary, vectors binary"


def top(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy("score", "vec_id", "row")
    return rows.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)


def _trial_parts(trials: dict, k: int, d: int):
    """The trials' nearest rows in a partition, compared with every row."""
    def run(batches):
        best = Nearest(k)
        for batch in batches:
            if batch.num_rows:
                best.add(trials["rows"], trials["x"], batch.column("row").to_numpy(), batch.column("id").to_numpy(),
                         matrix(batch.column("v")))
        if best.best:
            yield best.rows()
    return run


def visits_for(route, trials: dict, true: dict[int, list[np.ndarray]], recall: float) -> int:
    """The smallest number of parts that hold this share of the trials' true neighbours."""
    order = np.argsort(-route(trials["x"]), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)                        # when a trial visits each part
    needed = [rank[i, int(p)] + 1 for i, name in enumerate(trials["rows"].tolist())
              if name in true for p in route.place(np.array(true[name]))]
    return int(np.quantile(needed, recall, method="higher")) if needed else 1


class Shared:
    """Parts that workers read from a broadcast."""

    def __init__(self, parts):
        self.parts = parts

    def __call__(self, x):
        return self.parts.value(x)

    def place(self, x):
        return self.parts.value.place(x)


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, recall: float = RECALL, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    setup(spark)
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    src = src.where(F.col("id").isNotNull() & usable(F.col("v")))
    sizes = src.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    none = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], none)
    d, rows = sizes[0]["d"], sizes[0]["count"]
    good = stored(src.where(F.size("v") == d).withColumn("row", F.monotonically_increasing_id()), "vectors")
    picked = good.orderBy(F.xxhash64("id"), "id", "row").limit(SAMPLE + TRIALS).collect()      # bounded by both
    tried = picked[-TRIALS:]
    # the trials are apart from what the router learns, unless the table is that small
    sample = np.array([r["v"] for r in (picked[:-TRIALS] if len(picked) > 2 * TRIALS else picked)])
    route = divided(good, fit(sample, rows), rows)
    shared = spark.sparkContext.broadcast(route)        # bounded by SAMPLE and the length: a router, and one for each part
    parts = len(route)
    visits = 1
    if parts > 1:
        trials = {"rows": np.array([r["row"] for r in tried]), "x": np.array([r["v"] for r in tried])}
        true = top(good.mapInArrow(_trial_parts(trials, k, d), FOUND), k)
        found = true.select("query", "row").join(good.select("row", "v"), "row").collect()
        near: dict[int, list[np.ndarray]] = {}
        for r in found:                                                         # TRIALS * k rows
            near.setdefault(r["query"], []).append(np.array(r["v"]))
        visits = visits_for(route, trials, near, recall)

    router = Shared(shared)
    index = stored(good.mapInArrow(_blocks(router, BLOCK, 1), BLOCKS), "vector-parts")
    asked = good.where(F.col("id") % every == 0)
    held_by = np.zeros(parts, np.int64)
    for r in index.groupBy("part").agg(F.sum(F.length("rows") / 8).alias("n")).collect():    # a row for each part
        held_by[r["part"]] = int(r["n"])
    queries = stored(asked.mapInArrow(_blocks(router, QUERIES, visits, held_by, k + 1), BLOCKS), "vector-queries")
    pairs = (queries.select("part", F.col("rows").alias("q_rows"), F.col("vectors").alias("q"))
             .join(index, "part").select("q_rows", "q", "rows", "ids", "vectors").repartition(2 * wide(spark)))
    out = top(pairs.mapInArrow(_rerank(k, d), FOUND), k)
    names = asked.select(F.col("row").alias("query"), F.col("id").alias("query_id"))
    return out.join(names, "query").select("query_id", "rank", "vec_id", "score")
