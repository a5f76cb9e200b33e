"""Suffix dedup and n-gram join against brute force."""
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from petrel.llm import ngram_join as N
from petrel.llm import suffix_dedup as S
from petrel.llm.graph import components, stars

LAST = 1 << 62
LOWER = {i: i + 32 for i in range(65, 91)}


def words(rng, n, letters="abcdef"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n)]


def brute_repeats(rows, length=50):
    first, out = {}, []
    for i, t in sorted((LAST if a is None else a, (b or "").encode()) for a, b in rows):
        for p in range(len(t) - length + 1):
            first.setdefault(t[p:p + length], i)
    for a, b in rows:
        t, own = (b or "").encode(), LAST if a is None else a
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if first[t[p:p + length]] < own:
                gone[p:p + length] = True
        rest = bytes(c for c, g in zip(t, gone) if not g)
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0
        out.append((a, len(t), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def passages(seed=5, n=150):
    rng = random.Random(seed)
    vocabulary = words(rng, 60)
    shared = [" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(12)]
    rows = []
    for _ in range(n):
        parts = [rng.choice(shared)[rng.randint(0, 60):] if rng.random() < .4 else
                 " ".join(rng.choice(vocabulary) for _ in range(12)) for _ in range(rng.randint(0, 6))]
        rows.append((rng.randint(0, 200), " ".join(parts)))
    rows += [(None, None), (3, None), (None, shared[0]), (None, shared[0]), (7, ""), (9, "a" * 2000), (1000, "a" * 200),
             (1001, "ab" * 300), (1002, "ab" * 100), (11, "é" * 400), (12, "é" * 100), (5, "x" * 49), (6, "x" * 50)]
    line = shared[1][:60]
    return rows + [(2000 + i, line + " ".join(rng.choice(vocabulary) for _ in range(6))) for i in range(40)]


@pytest.mark.parametrize("many", [2, 1024])
def test_repeats_equal_brute_force(frame, many):
    rows = passages()
    got = S.remove_repeats(frame(rows, "doc_id long, text string"), many=many).drop("text", "text_hash").collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows)


def test_repeats_keep_whole_characters(spark, frame):
    rows = [(1, "é" * 40), (2, "x" + "é" * 40), (3, "clean")]
    got = {r["doc_id"]: r for r in S.remove_repeats(frame(rows, "doc_id long, text string"), length=49).collect()}
    assert got[2]["text"] is not None and set(got[2]["text"]) <= set("xé")
    assert got[3]["text"] is None and got[3]["n_removed"] == 0
    hashes = {r[0]: r[1] for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "doc_id", "xxhash64(text)").collect()}
    assert all(got[i]["text_hash"] == h for i, h in hashes.items())


def test_spans_cut_texts_as_they_are_left(frame):
    rows = passages() + [(3000, "é" * 40), (3001, "x" + "é" * 40), (3002, None), (3003, "x" + "é" * 40 + "\n" + "é" * 30), (None, "é" * 40)]
    df = frame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k long")
    done = S.remove_repeats(df, length=49, with_spans=True).where("n_removed > 0").dropDuplicates(["doc_id", "text_hash"])
    done = done.select(F.col("doc_id").alias("i"), F.col("text_hash").alias("h"), "spans", F.col("text").alias("left"), "n_removed", "n_spans")
    both = df.join(done, F.col("doc_id").eqNullSafe(F.col("i")) & (F.xxhash64("text") == F.col("h")), "left")
    got = S.cut_spans(both, "text", "spans").collect()
    own = dict(enumerate(t for _, t in rows))
    assert len(got) == len(rows) and sum(r["spans"] is not None for r in got) > 20
    for r in got:
        if r["spans"] is None:
            assert r["text"] == own[r["k"]]
        else:
            assert r["text"] == r["left"] and len(r["spans"]) == 2 * r["n_spans"]
            assert sum(r["spans"][1::2]) - sum(r["spans"][::2]) == r["n_removed"] and r["spans"] == sorted(set(r["spans"]))


def test_empty_tables(frame):
    none = frame([], "doc_id long, text string")
    assert S.remove_repeats(none).count() == 0 and N.near_copies(none).count() == 0


@pytest.mark.parametrize("letters", ["ab", "ab ", "abcdefgh"])
@pytest.mark.parametrize("length", [5, 12, 50])
def test_matching_statistics_equal_brute_force(letters, length):
    rng = random.Random(length)
    base = "".join(rng.choice(letters) for _ in range(400))

    def cut(n):
        for _ in range(n):
            at = rng.randrange(len(base) - 80)
            p = list(base[at:at + rng.randint(length, 76)])
            if rng.random() < .5:
                p[rng.randrange(len(p))] = rng.choice(letters + "z")
            yield "".join(p).encode()
    old, new = list(cut(60)), list(cut(25))
    index = S.RunIndex(np.frombuffer(b"".join(old), np.uint8), np.array([len(p) for p in old]), length)
    assert len(index.starts) < len(index.text) and len(index.tops) == len(index.tails) == len(index.starts)
    rows = np.argsort([bytes(index.text[i:].astype(">u4")) for i in range(len(index.text))])
    assert (index.tops == rows[index.starts]).all() and (index.tails == rows[np.append(index.starts[1:], len(rows)) - 1]).all()
    size = np.array([len(p) for p in new])
    got = {}
    for step, (live, stat) in enumerate(index.statistics(np.frombuffer(b"".join(new), np.uint8), size), 1):
        got |= {(k, size[k] - step): m for k, m in zip(live.tolist(), stat.tolist())}
    for k, p in enumerate(new):
        for i in range(len(p)):
            m = max(j for j in range(len(p) - i + 1) if any(p[i:i + j] in t for t in old))
            assert got[k, i] == m if m < length else got[k, i] >= length


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefgh"])
def test_pieces_leave_where_no_match_can_be_long_enough(letters):
    rng = random.Random(len(letters))
    length, base = 50, "".join(rng.choice(letters) for _ in range(300))
    old = [base[i:i + 60].encode() for i in range(0, 240, 8)]
    new = [p[:i] + b"?" + p[i + 1:] for p in old for i in (0, 5, 9, 12, 30, 58)] + [b"?" * 55, base[3:70].encode()]
    index = S.RunIndex(np.frombuffer(b"".join(old), np.uint8), np.array([len(p) for p in old]), length)
    body, size = np.frombuffer(b"".join(new), np.uint8), np.array([len(p) for p in new])

    def long_and_steps(**least):
        found, steps = {}, 0
        for step, (live, stat) in enumerate(index.statistics(body, size, **least), 1):
            steps += len(live)
            found |= {(k, size[k] - step): m for k, m in zip(live.tolist(), stat.tolist()) if m >= length}
        return found, steps
    every, some = long_and_steps(), long_and_steps(least=length)
    assert every[0].keys() == some[0].keys() and some[1] < every[1] == size.sum()
    assert some[0].keys() == {(k, i) for k, p in enumerate(new) for i in range(len(p) - length + 1)
                              if any(p[i:i + length] in t for t in old)}


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefgh"])
def test_suffixes_stand_in_order_and_share_what_they_share(letters):
    rng = random.Random(len(letters))
    pieces = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 76))) for _ in range(40)]
    pieces += pieces[:3] + [pieces[4][2:] or "a", "a" * 8, "a" * 7, "a"]
    index = S.RunIndex(np.frombuffer("".join(pieces).encode(), np.uint8), np.array([len(p) for p in pieces]), 50)
    text, n = index.text.tolist(), len(index.text)
    rank, rows = S._suffix_order(index.words)
    assert rows.tolist() == sorted(range(n), key=lambda i: text[i:]) and (rank[rows] == np.arange(n)).all()
    a, b = np.append(rows[:-1], rng.choices(range(n), k=500)), np.append(rows[1:], rng.choices(range(n), k=500))
    a, b = a[a != b], b[a != b]
    most = np.array(rng.choices(range(60), k=len(a)))
    want = [next(k for k in range(m + 1) if k == m or text[i + k:i + k + 1] != text[j + k:j + k + 1])
            for i, j, m in zip(a.tolist(), b.tolist(), most.tolist())]
    assert index.shared(a, b, most).tolist() == want and max(want) > 7


def test_earlier_strings_equal_plain_search():
    rng = random.Random(1)
    base, length = "".join(rng.choice("abcd ") for _ in range(500)), 50
    pieces = []
    for d in range(40):
        text = list(base)
        for _ in range(rng.randint(0, 8)):
            text[rng.randrange(len(text))] = rng.choice("xyz")
        block = S.Block(0, np.array([d]), np.array([len(text)]), np.frombuffer("".join(text).encode(), np.uint8))
        _, first, size, *_ = S.anchors(block, length)
        pieces += [(bytes(block.body[s:s + n]), d // 2) for s, n in zip(first.tolist(), size.tolist())]
    rng.shuffle(pieces)
    size, ids = np.array([len(p) for p, _ in pieces]), np.array([i for _, i in pieces])
    got = S.earlier_strings(np.frombuffer(b"".join(p for p, _ in pieces), np.uint8), size, ids, length)
    low = {}
    for p, i in pieces:
        for s in range(len(p) - length + 1):
            low[p[s:s + length]] = min(low.get(p[s:s + length], LAST), i)
    for (p, i), bits in zip(pieces, got.tolist()):
        assert bits == sum(1 << s for s in range(len(p) - length + 1) if low[p[s:s + length]] < i)


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[j:j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def brute_copies(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    holders = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(k)
    for k, (_, s) in enumerate(sets):
        for o, both in Counter(o for g in s for o in holders[g] if o < k).items():
            if 100 * both >= 75 * (len(s) + len(sets[o][1]) - both):
                parent[root(k)] = root(o)
    name = {}
    for k, (i, s) in enumerate(sets):
        if s and i is not None:
            name[root(k)] = min(name.get(root(k), LAST), i)
    return sorted(((i, len(s), name.get(root(k)) if s else i) for k, (i, s) in enumerate(sets)), key=str)


def near_rows(seed=3):
    rng = random.Random(seed)
    vocabulary = words(rng, 300)
    rows = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 8, 20, 60, 150, 400]))]
        for _ in range(rng.choice([1, 1, 2, 3, 8, 40])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, len(copy) // 40, len(copy) // 25, len(copy) // 16])):
                at = rng.randrange(len(copy) + 1)
                if rng.random() < .5 and at < len(copy):
                    copy[at] = rng.choice(vocabulary)
                else:
                    copy.insert(at, rng.choice(vocabulary))
            text = rng.choice([" ", "\n", "  "]).join(copy)
            rows.append((len(rows), text.title() if rng.random() < .2 else text))
    n = len(rows)
    rows += [(None, None), (n, None), (n + 1, ""), (n + 2, " \n"), (None, rows[5][1]), (None, "one two three"),
             (None, "one two three"), (4, rows[50][1])]
    rng.shuffle(rows)
    return rows


def test_near_copies_equal_brute_force(frame):
    rows = near_rows()
    got = N.near_copies(frame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute_copies(rows)


def test_linked_sets_share_a_key_when_all_shingles_are_frequent():
    rng = np.random.default_rng(0)
    steps = np.array(N._levels(), np.int64)
    for n in (1, 2, 3, 4, 5, 7, 11, 16, 40, 146, 700):
        for _ in range(40):
            pool = np.unique(rng.integers(0, 2 ** 63, 3 * n + 4).astype(np.uint64))
            m = int(rng.integers(max(1, -(-3 * n // 4)), n + 1))
            both = -(-75 * (n + m) // 175)
            if both > m:
                continue
            x = np.sort(np.concatenate([pool[:both], pool[both:n]]))
            y = np.sort(np.concatenate([pool[:both], pool[n:n + m - both]]))
            for level in (1, N.RARE + 1):           # all rare, then all frequent
                keys = []
                for s in (x, y):
                    per_class = np.zeros(64, np.uint32)
                    per_class[level] = len(s)
                    keys.append(np.concatenate(N.keys_of(s, per_class, 75, steps)))
                assert len(np.intersect1d(*keys)), (n, m, level)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(500 + i, 501 + i) for i in range(60)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6), "t").collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    linked = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in linked}
    u, v = stars(np.array([5, 3, 9]), np.array([3, 1, 8]))
    assert dict(zip(u.tolist(), v.tolist())) == {3: 1, 5: 1, 9: 8}


def test_a_passage_that_goes_on_differently_loads_no_bucket(frame):
    rng = random.Random(8)
    vocabulary, n, many = words(rng, 60), 16, 2
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows = [(i, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(20))) for i in range(300)]
    blocks = S.text_blocks(frame(rows, "doc_id long, text string"), "doc_id", "text", "test-blocks")
    message = "block long, bucket int, data binary"
    repeated = S.exchange(blocks.mapInArrow(S._ask_repeated(n, 50), message), S._answer_repeated(1000))
    known = blocks.join(repeated, "block", "left")
    firsts = S.exchange(known.mapInArrow(S._ask_first(n, 50), message), S._answer_first(many))
    asked = known.join(firsts.withColumnRenamed("replies", "firsts"), "block", "left")
    sent = Counter()
    for r in asked.mapInArrow(S._ask_pieces(n, 50), "kind int, block long, bucket int, data binary").where("kind = 1").collect():
        sent[r["bucket"]] += sum(S.unints(S._fields(r["data"])[0]).tolist())
    assert max(sent.values()) < 5000
    got = S.remove_repeats(frame(rows, "doc_id long, text string"), many=many).drop("text", "text_hash").collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows)
