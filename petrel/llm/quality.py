"""Quality classifier: document evidence shrunk towards its site, the site towards its host, the host towards all.

*Document evidence.*  Two models, fitted on a bounded sample of the labelled
documents (``SAMPLE`` of them, by hash of their ids), give the probability
that a document is junk, and that it is toxic.

- Junk: an additive logistic model over binned measures of the text's form
  (share of letters, capitals, digits, marks; repeated words and lines; word
  length; ...).
- Toxic: words and word beginnings that toxic documents hold more often than
  chance allows: by Chernoff bounds, at most a tenth of those that count are
  expected to be there by chance (``FALSE``).  The weight of each is its log
  odds, shrunk towards the overall rate.  A logistic model over the summed
  weights gives the probability.

*Sites.*  A document's host and path (here ``source`` and ``lang``) have
posteriors of their own: a Beta prior around all documents' rate for hosts,
and around their host's rate for paths, with strengths estimated from the
spread between groups (method of moments).  A group's evidence is the sum over
all its documents of the label, where there is one, else of the model's
probability.  Sparse groups therefore stay at the rate above them.

A document's log odds are those of its evidence plus the difference between
its path's rate and the overall rate; it is kept if being good is at least as
likely as not.

Sums run over all documents, with partial sums before the shuffle.  The table
of paths is small beside the documents; it is broadcast if it has at most
``BROADCAST_PATHS`` rows and joined by shuffle otherwise.

A null text is empty; it is judged by its measures like any other.  Null
hosts and paths are groups of their own.  With no usable labels every document
is kept.  A document labelled more than once counts with its worst label.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petrel.llm.runtime import drop, fresh, setup, stored

SAMPLE = 8000            # labelled documents that the models are fitted on
BINS = 12
FALSE = 0.1              # share of the words and beginnings that may count by chance
BROADCAST_PATHS = 50_000
STRIP = ".,;:!?\"'()[]{}<>|*#-_/\\"
_CLASS = np.zeros(256, np.int64)      # 0 other, 1 letter, 2 capital, 3 digit, 4 space, 5 mark
_CLASS[list(range(97, 123)) + list(range(128, 256))] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[33, *range(35, 39), *range(40, 44), *range(45, 48), 58, 59, 60, 61, 62, 63, 64, *range(91, 97), *range(123, 127)]] = 5
_RUN = re.compile(r"(.)\1{4,}", re.S)


def measures(text: str) -> tuple[list[float], list[str]]:
    """The form of a text in numbers, and its lower-cased words."""
    raw = np.frombuffer(text.encode(), np.uint8)
    kind = np.bincount(_CLASS[raw], minlength=6) / max(len(raw), 1)
    words = text.lower().split()
    n = max(len(words), 1)
    distinct = set(words)
    lines = [x for x in text.split("\n") if x.strip()]
    m = max(len(lines), 1)
    again = sum(a == b for a, b in zip(words, words[1:]))
    bare = sum(not w.isalpha() for w in distinct)
    sizes = [len(w) for w in distinct]
    ends = sum(x.rstrip()[-1] in ".!?:;\"'" for x in lines)
    return [*kind, math.log1p(len(words)), len(distinct) / n ** 0.75, again / n, bare / max(len(distinct), 1),
            sum(sizes) / max(len(sizes), 1), max(sizes, default=0), len(set(lines)) / m, math.log1p(len(raw) / m),
            ends / m, text.count("|") / n, text.count("!") / n, (text.count(".") + text.count(",")) / n,
            sum(len(x[0]) for x in _RUN.finditer(text)) / max(len(text), 1) if _RUN.search(text) else 0.0,
            sum(len(w) <= 3 for w in words) / n], words


def marks(words: list[str]) -> set[str]:
    """A document's words, and the beginnings of its words (with a star)."""
    whole = {w.strip(STRIP) for w in set(words)}
    return whole | {w[:k] + "*" for w in whole for k in (4, 5) if len(w) > k}


def logit(p):
    return np.log(p) - np.log1p(-p)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic model (the last one is the constant), by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.full(x.shape[1], ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad = x.T @ (p - y) + keep * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep + 1e-9), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    """Probability that a document is bad: junk or toxic."""

    edges: np.ndarray | None = None                 # of the bins of each measure
    junk: np.ndarray | None = None
    weight: dict[str, float] = field(default_factory=dict)
    toxic: np.ndarray | None = None
    base: float = 0.0                               # share of bad documents in the sample

    def binned(self, x: np.ndarray) -> np.ndarray:
        """One column per bin of each measure."""
        out = np.zeros((len(x), x.shape[1] * BINS))
        for k in range(x.shape[1]):
            at = np.searchsorted(self.edges[k], x[:, k], "right")
            out[np.arange(len(x)), k * BINS + at] = 1
        return out

    def hits(self, words: list[str]) -> list[float]:
        """What the weights of a text's marks add up to: in all, per root of its length, and the largest."""
        w = [self.weight[m] for m in marks(words) if m in self.weight] if self.weight else []
        total = sum(w)
        return [min(total, 40.0), total / math.sqrt(len(words) + 1), max(w, default=0.0)]

    def bad(self, texts: list[str]) -> np.ndarray:
        x, h = [], []
        for t in texts:
            m, words = measures(t)
            x.append(m)
            h.append(self.hits(words))
        none = np.zeros(len(texts))
        p = sigmoid(np.column_stack([self.binned(np.array(x)), none + 1]) @ self.junk) if self.junk is not None else none
        q = sigmoid(np.column_stack([np.array(h), none + 1]) @ self.toxic) if self.toxic is not None else none
        return np.clip(1 - (1 - p) * (1 - q), 1e-6, 1 - 1e-6)


def _both(y: np.ndarray) -> bool:
    return len(y) > 0 and 0 < y.sum() < len(y)


def telling(counts: list[tuple[str, int, int]], rate: float, looked_at: int) -> dict[str, float]:
    """Weights of the marks (name, documents, toxic ones) that chance cannot explain."""
    found = []
    for name, n, k in counts:
        share = k / n
        if share > rate:
            gain = share * math.log(share / rate) + (0 if k == n else (1 - share) * math.log((1 - share) / (1 - rate)))
            p = (k + 2 * rate) / (n + 2)
            found.append((-n * gain, name, math.log(p / (1 - p)) - math.log(rate / (1 - rate))))
    found.sort()
    keep = max((i + 1 for i, (log_p, _, _) in enumerate(found)
                if math.log(looked_at) + log_p <= math.log(FALSE * (i + 1))), default=0)
    return {name: w for _, name, w in found[:keep]}


MEASURES = "x array<double>, junk int, toxic int"


def _measure(batches):
    for batch in batches:
        texts, junk, toxic = batch.columns
        yield pa.RecordBatch.from_arrays(
            [pa.array([measures(t or "")[0] for t in texts.to_pylist()], pa.list_(pa.float64())), junk, toxic],
            ["x", "junk", "toxic"])


def _count(batches):
    seen: Counter = Counter()
    bad: Counter = Counter()

    def out():
        names = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([seen[m] for m in names], pa.int64()),
             pa.array([bad[m] for m in names], pa.int64())], ["mark", "n", "k"])
        seen.clear()
        bad.clear()

    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            m = marks((text or "").lower().split())
            seen.update(m)
            if toxic:
                bad.update(m)
        if len(seen) > 500_000:
            yield from out()
    yield from out()


def _score(model: Model):
    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            p = [model.bad([t or "" for t in texts[s:s + 256]]) for s in range(0, len(texts), 256)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(p) if p else np.zeros(0)), *batch.columns[1:]],
                [f"c{i}" for i in range(batch.num_columns)])
    return run


def with_labels(docs: DataFrame, labels: DataFrame, id_col: str) -> DataFrame:
    """(text, junk, toxic) of a bounded sample of the labelled documents."""
    worst = _worst(labels).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(worst), "id").withColumn("t", F.xxhash64("text"))
    picked = rows.select("id", "t").distinct().orderBy(F.xxhash64("id", "t"), "id", "t").limit(SAMPLE)   # an id may be repeated
    return rows.join(F.broadcast(picked), ["id", "t"]).dropDuplicates(["id", "t"]).select("text", "junk", "toxic")


def _worst(labels: DataFrame) -> DataFrame:
    rows = labels.select(F.col("doc_id").cast("long").alias("id"), (1 - F.col("quality").cast("int")).alias("junk"),
                         F.col("toxic").cast("int").alias("toxic"))
    rows = rows.where("id is not null and junk in (0, 1) and toxic in (0, 1)")
    return rows.groupBy("id").agg(F.max("junk").alias("junk"), F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> Model:
    """Fit both models on the sample; what reaches the driver is bounded by ``SAMPLE``."""
    sample = stored(with_labels(docs, labels, id_col), "quality-sample")
    rows = sample.mapInArrow(_measure, MEASURES).collect()
    model = Model()
    if not rows:
        drop(sample)
        return model
    x = np.array([r["x"] for r in rows])
    junk, toxic = np.array([r["junk"] for r in rows]), np.array([r["toxic"] for r in rows])
    order = np.lexsort(x.T)                       # the order of collected rows is not fixed
    x, junk, toxic = x[order], junk[order], toxic[order]
    model.base = float(np.clip(np.maximum(junk, toxic).mean(), 1e-3, 1 - 1e-3))
    if _both(junk):
        model.edges = np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T
        model.junk = logistic(model.binned(x), junk, ridge=1.0)
    if _both(toxic):
        counts = sample.mapInArrow(_count, "mark string, n long, k long").groupBy("mark").agg(
            F.sum("n").alias("n"), F.sum("k").alias("k"))
        counts = stored(counts.where("n > 1"), "quality-marks")
        rate = float(toxic.mean())
        often = counts.where((F.col("k") >= 3) & (F.col("k") / F.col("n") > 2 * rate))
        model.weight = telling([tuple(r) for r in often.orderBy("mark").collect()], rate, counts.count())
        hits = sample.mapInArrow(_hit(model.weight), "h array<double>, toxic int").collect()
        h, y = np.array([r["h"] for r in hits]), np.array([r["toxic"] for r in hits])
        order = np.lexsort(h.T)
        model.toxic = logistic(h[order], y[order], ridge=0.1)
        drop(counts)
    drop(sample)
    return model


def _hit(weight: dict[str, float]):
    def run(batches):
        model = Model(weight=weight)
        for batch in batches:
            h = [model.hits((t or "").lower().split()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.list_(pa.float64())), batch.column(2)], ["h", "toxic"])
    return run


# --- sites --------------------------------------------------------------------

def _strength(groups: DataFrame, above: str) -> float:
    """Strength of the Beta prior of groups (s of n bad) around ``above``: method of moments.

    Of the spread of the groups' rates, what sampling does not explain is real."""
    gap = F.col("s") / F.col("n") - F.col(above)
    noise = F.col(above) * (1 - F.col(above))
    r = groups.agg(F.sum(F.col("n") * gap * gap).alias("spread"), F.sum(noise).alias("noise"),
                   F.sum(F.col("n") * noise).alias("total"), F.sum("n").alias("n")).head()
    if not r["n"] or not r["total"]:
        return 1e6
    real = max((r["spread"] - r["noise"]) / r["n"], 0.0)
    mean = r["total"] / r["n"]
    return float(np.clip(mean / real - 1 if real > 0 else 1e6, 1.0, 1e6))


def site_rates(evidence: DataFrame, host: str, path: str) -> tuple[DataFrame, float]:
    """(host, path, rate): the posterior rate of bad documents of each path, and the overall rate.

    ``evidence`` has host, path, p."""
    groups = stored(evidence.groupBy(host, path).agg(F.sum("p").alias("s"), F.count("*").alias("n")), "quality-paths")
    hosts = groups.groupBy(host).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    whole = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).head()
    rate = float(np.clip(whole["s"] / whole["n"], 1e-4, 1 - 1e-4)) if whole["n"] else 0.5
    hosts = hosts.withColumn("rate", F.lit(rate))
    k = _strength(hosts, "rate")
    hosts = hosts.select(F.col(host).alias("_host"), ((F.col("s") + k * rate) / (F.col("n") + k)).alias("host_rate"))
    groups = groups.join(hosts, groups[host].eqNullSafe(hosts["_host"])).drop("_host")
    k = _strength(groups, "host_rate")
    out = groups.select(F.col(host).alias("_host"), F.col(path).alias("_path"),
                        ((F.col("s") + k * F.col("host_rate")) / (F.col("n") + k)).alias("site_rate"))
    return stored(out, "quality-rates"), rate


def _odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _limit(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))


def _evidence(docs: DataFrame, model: Model, columns: list[Column]) -> DataFrame:
    """``columns`` and ``p``, the probability that the text is bad."""
    src = docs.select(F.col("text").cast("string").alias("c0"), *[c.alias(f"c{i + 1}") for i, c in enumerate(columns)])
    schema = ", ".join(["c0 double"] + [f"c{i + 1} {f.dataType.simpleString()}" for i, f in enumerate(src.schema.fields[1:])])
    return src.mapInArrow(_score(model), schema)


def posterior(rows: DataFrame, rates: DataFrame, rate: float, host: str, path: str, p: str) -> DataFrame:
    """``rows`` with ``site_rate`` and ``p_bad``."""
    if rates.count() <= BROADCAST_PATHS:
        rates = F.broadcast(rates)
    rows = rows.join(rates, rows[host].eqNullSafe(rates["_host"]) & rows[path].eqNullSafe(rates["_path"]), "left").drop(
        "_host", "_path").withColumn("site_rate", _limit(F.coalesce("site_rate", F.lit(rate))))
    z = _odds(_limit(F.col(p))) + _odds(F.col("site_rate")) - float(logit(rate))
    return rows.withColumn("p_bad", 1 / (1 + F.exp(-z)))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", host: str = "source",
             path: str = "lang", carry: list[str] = ()) -> tuple[DataFrame, Model, DataFrame, float]:
    """One row per document (doc_id, host, path, p_document, site_rate, p_bad, kept); the model, the rates, the overall rate.

    The columns ``carry`` of each document follow as ``carried_0``, ``carried_1`` .."""
    setup(docs.sparkSession)
    model = fit(docs, labels, id_col)
    scored = _evidence(docs, model, [F.col(id_col).cast("long"), F.col(host).cast("string"), F.col(path).cast("string"),
                                     *[F.col(f"`{c}`") for c in carry]])
    scored = stored(scored.select(F.col("c1").alias("doc_id"), F.col("c2").alias("host"), F.col("c3").alias("path"),
                                  F.col("c0").alias("p_document"),
                                  *[F.col(f"c{i + 4}").alias(f"carried_{i}") for i in range(len(carry))]), "quality-evidence")
    known = _worst(labels).select(F.col("id").alias("doc_id"), F.greatest("junk", "toxic").cast("double").alias("label"))
    evidence = scored.join(known, "doc_id", "left").select("host", "path", F.coalesce("label", "p_document").alias("p"))
    rates, rate = site_rates(evidence, "host", "path")
    out = posterior(scored, rates, rate, "host", "path", "p_document")
    return out.withColumn("kept", F.col("p_bad") <= 0.5), model, rates, rate


def filter_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", host: str = "source",
                     path: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    Texts are scored once, and no text is stored: rows of one id, site and hash
    of the text are kept or go together, so the keys of those that go are left out."""
    key, other_host, other_path, text_hash = fresh(docs, "gone_id", "gone_host", "gone_path", "gone_hash")
    hashed = docs.withColumn(text_hash, F.xxhash64(F.col("text").cast("string")))
    rows = classify(hashed, labels, id_col, host, path, carry=[text_hash])[0].where("not coalesce(kept, false)")
    gone = rows.select(F.col("doc_id").alias(key), F.col("host").alias(other_host), F.col("path").alias(other_path),
                       F.col("carried_0").alias(text_hash)).distinct()
    same = (F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(key))
            & F.col(f"`{host}`").cast("string").eqNullSafe(F.col(other_host))
            & F.col(f"`{path}`").cast("string").eqNullSafe(F.col(other_path))
            & (F.xxhash64(F.col("text").cast("string")) == F.col(text_hash)))
    return docs.join(gone, same, "left_anti")
