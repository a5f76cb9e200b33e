"""Mixing, embedding near copies, nearest neighbours and the classifier against plain computations."""
import hashlib
import math
import random

import numpy as np
import pytest

from petrel.llm import ann, embedding_dedup, mixing, quality

SF = "/root/testdata/sf0.01"


# --- mixing ----------------------------------------------------------------

def divide(budget, nodes):
    """Plain water-filling of a whole-number budget: nodes {name: (cap, weight)}."""
    nodes = {k: (c if w > 0 else 0, max(w, 1)) for k, (c, w) in nodes.items()}
    budget, open_, out = min(budget, sum(c for c, _ in nodes.values())), dict(nodes), {}
    while open_:
        left, total = budget - sum(out.values()), sum(w for _, w in open_.values())
        full = [k for k, (c, w) in open_.items() if c * total <= left * w]
        if not full:
            parts = {k: left * w // total for k, (c, w) in open_.items()}
            more = left - sum(parts.values())
            for k in sorted(open_)[:more]:
                parts[k] += 1
            return out | parts
        for k in full:
            out[k] = open_.pop(k)[0]
    return out


def plain_mix(rows, weights, share, seed, epochs):
    """{(doc, epoch): take}; rows are (doc, domain, source, tokens)."""
    rows = [r for r in rows if r[3]]
    tree = {}
    for _, d, s, n in rows:
        tree.setdefault(d, {}).setdefault(s, []).append(n)
    w = lambda level, name: weights.get(level, {}).get(name, 1)
    cap = {d: {s: sum(n) * epochs if w("domain", d) > 0 and w("source", s) > 0 else 0 for s, n in k.items()} for d, k in tree.items()}
    budget = sum(r[3] for r in rows) * share[0] // share[1]
    top = divide(budget, {d: (sum(k.values()), w("domain", d)) for d, k in cap.items()})
    out = {}
    for d, k in cap.items():
        for s, b in divide(top[d], {s: (c, w("source", s)) for s, c in k.items()}).items():
            own = [(i, n) for i, dd, ss, n in rows if (dd, ss) == (d, s)]
            full, rest = divmod(b, sum(n for _, n in own))
            out |= {(i, e): n for e in range(full) for i, n in own}
            for i, n in sorted(own, key=lambda r: hashlib.md5(f"{seed}:{full}:{r[0]}".encode()).hexdigest()):
                if rest <= 0:
                    break
                out[i, full] = min(n, rest)
                rest -= n
    return out


def mix_rows(seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice("aab"), rng.choice(["x", "x", "x", "y", "z"]), rng.randint(0, 9)) for i in range(300)]
    return rows + [(900, "c", "only", 1), (901, "zero", "x", 50)]


@pytest.mark.parametrize("share", [(1, 10), (3, 5), (5, 2), (9, 1)])
def test_mixing_equals_plain_budgets(spark, frame, share):
    rows = mix_rows()
    weights = {"domain": {"a": 1, "b": 7, "c": 2, "zero": 0}, "source": {"x": 1, "y": 5}}
    df = frame([(i, " ".join(["w"] * n) if n else None, d, s) for i, d, s, n in rows], "doc_id long, text string, domain string, source string",
               extra=("share", "cap", "w"))
    taken = mixing.mix_sources(df, ["domain", "source"], weights, share, seed=3, max_epochs=3)
    got = {(r["doc_id"], r["epoch"]): r["take"] for r in taken.collect()}
    assert got == plain_mix(rows, weights, share, 3, 3)
    plan = taken._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_mixing_takes_texts_and_repeated_rows(spark, frame):
    rows = [(1, " a\tbb  c ", None, "s"), (1, " a\tbb  c ", None, "s"), (None, "x y z", None, "s"), (2, "", "d", "s"), (3, None, "d", None)]
    df = frame(rows, "doc_id long, text string, domain string, source string")
    taken = mixing.mix_sources(df, ["domain", "source"], {}, (8, 9), max_epochs=1)
    out = mixing.take_documents(df, taken)
    assert out.columns == df.columns
    texts = [r["text"] for r in out.collect()]
    assert sum(len(t.split()) for t in texts) == 8 and len(texts) == 3
    assert all(any(t == f or f.startswith(t) for f in (" a\tbb  c ", "x y z")) for t in texts)
    none = frame([], "doc_id long, text string, domain string, source string")
    assert mixing.mix_sources(none, ["domain"], {}, (1, 2)).count() == 0


# --- vectors -----------------------------------------------------------------

def vector_rows(seed=0, dim=12):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(30):
        base = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 12))):
            v = base + rng.normal(size=dim) * rng.choice([0.0, 0.02, 0.06, 0.15])
            rows.append([len(rows), [float(x) for x in v], int(rng.integers(0, 3)) if g % 4 == 0 else g % 3])
    hot = [float(x) for x in rng.normal(size=dim)]
    rows += [[1000 + i, hot, 1] for i in range(60)] + [[2000 + i, [x * (1 + i) for x in hot], 1] for i in range(5)]
    rows += [[3000, None, 1], [3001, [0.0] * dim, 1], [3002, [float("nan")] + [1.0] * (dim - 1), 1], [3003, hot[:-1] + [None], 1],
             [3004, [float("inf")] + [1.0] * (dim - 1), 1], [3005, hot, None], [3006, hot[:5], 1], [3007, [1e200] * dim, 2], [3008, [1e200] * dim, 2]]
    return rows


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_near_vectors_equal_brute_force(spark, frame):
    rows = vector_rows()
    df = frame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_vectors(df).collect()}
    links = {r[0]: set() for r in rows}
    ok = [(i, np.array(v) / np.abs(v).max(), y) for i, v, y in rows if fine(v) and y is not None]
    for i, v, y in ok:
        for j, u, z in ok:
            if i < j and y == z and len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.98:
                links[i].add(j)
                links[j].add(i)
    name = {}
    for i in sorted(links):
        if i not in name:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in name:
                    name[x] = i
                    todo += links[x]
    assert got == {i: (len(links[i]), name[i], name[i] == i) for i in links}
    none = frame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.near_vectors(none).count() == 0


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(1)
    for _ in range(20):
        a, b = (embedding_dedup.unit(rng.normal(size=(40, 33)) + 2 * rng.normal(size=33)) for _ in "ab")
        i, j = embedding_dedup.close_pairs(a, b, 0.8, False)
        want = set(zip(*np.nonzero(a @ b.T >= 0.8)))
        assert want <= set(zip(i.tolist(), j.tolist()))
        i, j = embedding_dedup.close_pairs(a, a, 0.8, True)
        assert all(x < y for x, y in zip(i, j))


def test_nearest_vectors(spark, frame):
    rows = [[r[0], r[1]] for r in vector_rows(dim=12)] + [[None, [1.0] * 12]]
    df = frame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, k=10, every=100).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = [(i, np.array(v)) for i, v in rows if i is not None and fine(v) and len(v) == 12]
    assert set(got) == {i for i, _ in ok if i % 100 == 0}
    for q, found in got.items():
        x = dict(ok)[q]
        want = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, v in ok if i != q)[:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert len({i for _, i, _ in found} & {i for _, i in want}) >= 9
        assert all(abs(s - np.sqrt(((dict(ok)[i] - x) ** 2).sum())) <= 1e-9 * max(s, 1) for _, i, s in found)
        assert found == sorted(found, key=lambda r: (r[2], r[1]))
    assert ann.nearest(frame([], "vec_id long, embedding array<float>")).count() == 0


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in table.collect()]
    got = {}
    for r in ann.nearest(table).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, found in got.items():
        x = dict(rows)[q]
        hits += len(found & {i for _, i in sorted((float(((v - x) ** 2).sum()), i) for i, v in rows if i != q)[:10]})
    assert hits >= 0.9 * 10 * len(got)


def test_partitions_are_balanced_and_routing_finds_them():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(8, 16)) * 4
    x = np.repeat(centres, 60, axis=0) + rng.normal(size=(480, 16))
    part = ann.balanced_parts(ann.neighbour_graph(x, 8), 8, rng)
    assert np.bincount(part, minlength=8).max() <= 66 and (part >= 0).all()
    route = ann.Router(x, part, 8, rng)
    assert (route(x).argmax(axis=1) == part).mean() > 0.8


# --- quality -------------------------------------------------------------------

def test_held_out_accuracy(spark):
    """Fitted on half of the labels, the classifier keeps clean documents and drops junk of the other half."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.classify(docs, labels.where("doc_id % 2 = 0"))[0]
    assert out.count() == docs.count()
    rows = out.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.97 * len(good) and sum(junk) <= 0.1 * len(junk)


def test_quality_takes_awkward_rows(spark, frame):
    rows = [(1, None, None, None), (None, "", "s", "en"), (2, "word " * 30000, "s", "en"), (2, "twice", "s", None)]
    docs = frame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels)[0]
    assert out.count() == 4 and out.where("p_bad is null or kept is null").count() == 0
    assert quality.filter_documents(docs, labels).columns == docs.columns
    none = labels.limit(0)
    assert quality.filter_documents(docs, none).count() == 4
    assert quality.classify(docs.limit(0), none)[0].count() == 0


def test_sparse_sites_shrink_to_the_rate_above(spark):
    rows = [("h1", "a", 1.0)] * 1 + [("h2", "a", 0.0)] * 500 + [("h3", "a", 1.0)] * 300 + [("h3", "b", 1.0)] + [("h4", "a", 0.0)] * 300
    rates, rate = quality.site_rates(spark.createDataFrame(rows, "host string, path string, p double"), "host", "path")
    got = {(r["_host"], r["_path"]): r["site_rate"] for r in rates.collect()}
    assert got["h3", "a"] > 0.95 and got["h4", "a"] < 0.05 and got["h3", "b"] > 0.9
    assert rate < got["h1", "a"] < got["h3", "a"]


def test_chance_words_do_not_count():
    rng = np.random.default_rng(0)
    counts = [(f"w{i}", n, int(rng.binomial(n, 0.1))) for i, n in enumerate(rng.integers(2, 60, 20000))]
    assert len(quality.telling(counts, 0.1, 20000)) <= 5
    assert "bad" in quality.telling(counts + [("bad", 12, 12)], 0.1, 20001)


def test_pipeline_stages_on_a_small_table(spark, tmp_path):
    import corpus_pipeline as P
    from petrel.llm.runtime import stored
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs, names = rows, set(rows.columns)
    sizes = [docs.count()]
    for name, stage in P.STAGES:
        before = docs
        docs = stored(stage(spark, docs, "/root/testdata/sf0.001"), "t")
        sizes.append(docs.count())
        if name != "encode":
            assert set(docs.columns) == names and docs.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
            assert docs.where("n_chars <> length(text)").count() == 0
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0


def test_sample_bounds_documents_of_repeated_ids(monkeypatch, frame):
    monkeypatch.setattr(quality, "SAMPLE", 20)
    docs = [(1, f"text {i % 60}") for i in range(240)] + [(2, "other"), (2, "other"), (3, "unlabelled")]
    labels = frame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    docs = frame(docs, "doc_id long, text string")
    got = [r["text"] for r in quality.with_labels(docs, labels, "doc_id").collect()]
    assert len(got) == len(set(got)) == 20
    monkeypatch.setattr(quality, "SAMPLE", 100)
    assert quality.with_labels(docs, labels, "doc_id").count() == 61


def test_recall_of_routed_search(monkeypatch, frame):
    monkeypatch.setattr(ann, "PART_ROWS", 150)
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(12, 8)) * 3, 150, axis=0) + rng.normal(size=(1800, 8))
    seen = {}
    fit, visits_for = ann.fit, ann.visits_for
    monkeypatch.setattr(ann, "fit", lambda sample, rows: seen.setdefault("route", fit(sample, rows)) if not seen.update(
        sample={v.tobytes() for v in sample}) else None)
    monkeypatch.setattr(ann, "visits_for", lambda route, trials, true, recall: seen.setdefault("visits", visits_for(
        route, trials, true, recall)) if not seen.update(trials={v.tobytes() for v in trials["x"]}) else None)
    got = {}
    for r in ann.nearest(frame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"),
                         every=10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert len(seen["route"].w[3]) >= 8 and not seen["trials"] & seen["sample"]
    hits = sum(len(found & set(np.argsort(((x - x[q]) ** 2).sum(axis=1) + 1e9 * (np.arange(1800) == q))[:10].tolist()))
               for q, found in got.items())
    print("parts", len(seen["route"].w[3]), "visits", seen["visits"], "recall", hits / 10 / len(got))
    assert len(got) == 180 and hits >= 0.93 * 1800


def test_parts_grow_in_number_with_the_rows(monkeypatch, frame):
    monkeypatch.setattr(ann, "PART_ROWS", 60)
    monkeypatch.setattr(ann, "SAMPLE", 400)
    monkeypatch.setattr(ann, "TRIALS", 64)
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(50, 8)) * 4, 80, axis=0) + rng.normal(size=(4000, 8)) * 0.7
    seen = {}
    divided, visits_for = ann.divided, ann.visits_for
    monkeypatch.setattr(ann, "divided", lambda good, route, rows: seen.setdefault("parts", divided(good, route, rows)))
    monkeypatch.setattr(ann, "visits_for", lambda *a: seen.setdefault("visits", visits_for(*a)))
    got = {}
    for r in ann.nearest(frame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), every=20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    parts = seen["parts"]
    assert len(parts.top.w[3]) <= 12 and len(parts) >= 30
    size = np.bincount(parts.place(x), minlength=len(parts))
    assert size.max() < 6 * 60 and np.allclose(np.exp(parts(x[:50])).sum(axis=1), 1)
    hits = sum(len(found & set(np.argsort(((x - x[q]) ** 2).sum(axis=1) + 1e9 * (np.arange(4000) == q))[:10].tolist()))
               for q, found in got.items())
    print("parts", len(parts), "visits", seen["visits"], "recall", hits / 10 / len(got))
    assert len(got) == 200 and hits >= 0.9 * 2000 and seen["visits"] < len(parts) // 2


def test_queries_short_of_rows_visit_more_parts():
    import pyarrow as pa
    scores = np.array([[5., 4., 3., 2.]])
    x = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([7]), pa.array([[1., 2.]])], ["row", "id", "v"])
    parts = [r["part"] for b in ann._blocks(lambda v: scores, 4, 1, np.array([2, 0, 6, 9]), 8)([x]) for r in b.to_pylist()]
    assert sorted(parts) == [0, 2]
    parts = [r["part"] for b in ann._blocks(lambda v: scores, 4, 1, np.array([2, 0, 6, 9]), 11)([x]) for r in b.to_pylist()]
    assert sorted(parts) == [0, 2, 3]
