"""Null and repeated ids, hot groups, contract cases of main texts, and every pipeline stage against a brute-force version."""
import math
import os
import random
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as P
from petrel.llm import ann, bpe, embedding_dedup, html_text, mixing, ngram_join, quality, token_files
from petrel.llm.queries import WEIGHTS
from tests.llm.test_text_dedup import LAST, brute_copies
from tests.llm.test_vectors_mixing_quality import divide

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int"


# --- op3, op8: rows of one id, rows without an id -----------------------------------------

def id_rows():
    a, b, c = [1.0, 0.0, 0.0], [0.999, 0.02, 0.0], [0.0, 1.0, 0.0]
    d, e = [0.0, 0.0, 1.0], [0.0, 0.01, 1.0]
    return [(5, a, 1), (None, b, 1), (9, c, 1), (None, [0.02, 0.999, 0.0], 1), (7, d, 1), (3, d, 1), (3, a, 1), (3, e, 2), (4, e, 2),
            (None, [-1.0, 0.0, 0.0], 1), (None, [-1.0, 0.001, 0.0], 1), (None, None, 1), (None, [0.0] * 3, 1), (8, [-1.0, 0.0, 0.0], 2)]


def test_vectors_of_null_and_repeated_ids_link_as_rows(frame):
    rows = id_rows()
    use = [k for k, (_, v, _) in enumerate(rows) if v is not None and any(v)]
    cosine = lambda x, y: np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)      # noqa: E731
    links = {k: {j for j in use if j != k and k in use and rows[j][2] == rows[k][2] and cosine(rows[j][1], rows[k][1]) >= 0.98}
             for k in range(len(rows))}
    want = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        names = [rows[j][0] for j in seen if rows[j][0] is not None]
        name = min(names, default=None)
        want.append((i, len(links[k]), name, i == name))
    got = embedding_dedup.near_vectors(frame(rows, VECTORS, extra=("rep", "first", "name", "u", "hash"))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_queries_of_one_id_have_answers_of_their_own(frame):
    rows = [(100, [0.0, 0.0, 1.0]), (100, [50.0, 0.0, 1.0]), *[(i, [i / 10, 0.5, 0.0]) for i in range(1, 40)],
            *[(200 + i, [50 + i / 10, 0.5, 0.0]) for i in range(1, 40)], (41, [0.0, 0.0, 1.0])]
    got = {}
    for r in ann.nearest(frame(rows, "vec_id long, embedding array<double>", extra=("row", "part", "query")), k=5, every=100).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], round(r["score"], 9)))
    want = []
    for q, (i, x) in enumerate(rows):
        if i == 100:
            near = sorted((float(np.sqrt(((np.array(v) - x) ** 2).sum())), j) for k, (j, v) in enumerate(rows) if k != q)[:5]
            want += [(rank, j, round(s, 9)) for rank, (s, j) in enumerate(near, 1)]
    assert set(got) == {100} and sorted(got[100]) == sorted(want)


# --- op1, op2, op5: hot groups ---------------------------------------------------------------

def test_rows_without_an_id_fill_several_token_files(spark, tmp_path):
    docs = spark.createDataFrame([(None if i % 2 else 7, f"text {i}") for i in range(400)], "doc_id long, text string").repartition(4)
    folder = "file://" + str(tmp_path / "tokens")
    token_files.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), folder, end_id=2)
    files = token_files.read_index(spark, folder).groupBy("file").count().collect()
    assert len(files) >= 4 and max(r["count"] for r in files) < 200
    got = [r["start"] for r in token_files.read_index(spark, folder).orderBy("start").collect()]
    assert len(set(got)) == 400 and token_files.checksums(spark, folder).count() == 400


def test_budgets_of_very_many_siblings(spark):
    rng = random.Random(4)
    few = {f"s{i:03}": (rng.randint(0, 50), 1 + i % 5) for i in range(300)}
    leaves = spark.createDataFrame([("d", s, c) for s, (c, _) in few.items()], "domain string, source string, n long")
    weights = {"source": {s: w for s, (_, w) in few.items()}}
    got = {r["source"]: r["share"] for r in mixing.budgets(leaves, ["domain", "source"], weights, F.lit(2500), 1).collect()}
    assert got == divide(2500, few)
    many = spark.range(300_000).select(F.lit("d").alias("domain"), F.format_string("s%07d", "id").alias("source"), (F.col("id") % 97).alias("n"))
    at = time.time()
    assert mixing.budgets(many, ["domain", "source"], {}, F.lit(1_000_000), 1).agg(F.sum("share")).first()[0] == 1_000_000
    assert time.time() - at < 60


def test_lead_of_a_hot_digest(spark):
    rows = [(i, b"hot" if i % 3 else f"d{i % 50}".encode()) for i in range(900)]
    df = spark.createDataFrame(rows, "row long, digest binary").repartition(6)
    least = {}
    for i, d in rows:
        least[d] = min(least.get(d, i), i)
    assert sorted(map(tuple, ngram_join._with_lead(df).collect())) == [(i, least[d]) for i, d in rows]


# --- op9: posteriors -----------------------------------------------------------------------------

def brute_posteriors(rows, labels):
    """p_bad of each (doc_id, host, path, p): grouped sums, moments and odds in plain Python."""
    evidence = [(h, q, labels.get(i, p)) for i, h, q, p in rows]
    group = lambda key: {k: (sum(e[2] for e in evidence if key(e) == k), sum(key(e) == k for e in evidence))     # noqa: E731
                         for k in {key(e) for e in evidence}}
    hosts, paths = group(lambda e: e[0]), group(lambda e: e[:2])
    rate = min(max(sum(e[2] for e in evidence) / len(evidence), 1e-4), 1 - 1e-4)

    def strength(groups, above):
        spread = sum(n * (s / n - above(k)) ** 2 for k, (s, n) in groups.items())
        noise = sum(above(k) * (1 - above(k)) for k in groups)
        total = sum(n * above(k) * (1 - above(k)) for k, (_, n) in groups.items())
        n = sum(n for _, n in groups.values())
        real = max((spread - noise) / n, 0.0)
        return min(max(total / n / real - 1 if real > 0 else 1e6, 1.0), 1e6)
    k = strength(hosts, lambda _: rate)
    host_rate = {h: (s + k * rate) / (n + k) for h, (s, n) in hosts.items()}
    k = strength(paths, lambda p: host_rate[p[0]])
    site = {p: (s + k * host_rate[p[0]]) / (n + k) for p, (s, n) in paths.items()}
    clip = lambda p: max(min(p, 1 - 1e-6), 1e-6)                # noqa: E731
    odds = lambda p: math.log(p / (1 - p))                      # noqa: E731
    return [1 / (1 + math.exp(-(odds(clip(p)) + odds(clip(site[h, q])) - odds(rate)))) for _, h, q, p in rows]


def quality_inputs(spark, frame):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    docs += [(None, None, None, None, None), (900_001, "", "en", None, 0), (900_002, "word " * 20_000, None, "s1", 100_000), docs[3], docs[3]]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    return docs, frame(docs, "doc_id long, text string, lang string, source string, n_chars long",
                       extra=("c0", "carried_0", "kept", "p_bad", "a`b", "a.b")), labels


def test_posteriors_equal_brute_force(spark, frame):
    docs, df, labels = quality_inputs(spark, frame)
    out = quality.classify(df, labels)[0].collect()
    known = {r["doc_id"]: float(max(1 - r["quality"], r["toxic"])) for r in labels.collect()}
    assert len(out) == len(docs)
    want = brute_posteriors([(r["doc_id"], r["host"], r["path"], r["p_document"]) for r in out], known)
    assert all(abs(r["p_bad"] - p) < 1e-9 and r["kept"] == (p <= 0.5) for r, p in zip(out, want))


# --- the pipeline's stages --------------------------------------------------------------------------

CLASH = ("epoch", "_domain", "mix_id", "mix_domain", "_repeat_id", "repeat_text", "repeat_hash", "block", "row", "n_removed", "n", "a.b",
         "component_id")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stage(name):
    return dict(P.STAGES)[name]


def awkward(seed=0, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = " ".join(f"passage{i}" for i in range(30))
    rows = []
    for i in range(n):
        text = " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 4, 30, 200])))
        if rng.random() < .3:
            text = f"{text} {passage} é{i}"
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["src1", "src2", "src2", "web", None]), len(text)))
    copy = rows[7]
    rows += [(None, copy[1], "en", "src1", 3), (None, None, None, None, None), (n, None, "en", "src1", None), (n + 1, "", "fr", "src9", 0),
             (n + 2, "long " * 30_000 + passage, "en", "src1", 9), rows[9], rows[9], rows[9], (9, "another text of id nine " + passage, "en", "src2", 1),
             (None, passage + " tail", "en", "src1", 0), (n + 3, copy[1].upper(), "en", "src2", 0)]
    return rows


def values(df):
    """Rows without the clashing columns, which must come through as they went in."""
    names = df.columns
    assert names[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and names[5:] == list(CLASH)
    rows = [tuple(r) for r in df.collect()]
    assert all(r[5:] == tuple(range(len(CLASH))) for r in rows)
    return Counter(r[:5] for r in rows)


@pytest.fixture()
def docs(spark, frame):
    rows = awkward()
    return rows, frame(rows, SCHEMA, extra=CLASH)


def test_quality_stage(spark, docs):
    rows, df = docs
    scored = quality.classify(df, spark.read.parquet(f"{SF}/labels.parquet"))[0].collect()
    known = {r["doc_id"]: float(max(1 - r["quality"], r["toxic"])) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    p = brute_posteriors([(r["doc_id"], r["host"], r["path"], r["p_document"]) for r in scored], known)
    kept = Counter((r["doc_id"], r["host"], r["path"]) for r, q in zip(scored, p) if q <= 0.5)
    got = values(stage("quality")(spark, df, SF))
    assert got <= Counter(rows) and Counter((i, s, x) for i, _, x, s, _ in got.elements()) == kept


def scratch_bytes():
    from pyspark.sql import SparkSession

    from petrel.session import ensure_checkpoint_dir
    top = ensure_checkpoint_dir(SparkSession.getActiveSession()).removeprefix("file:") + "/petrel-scratch"
    return sum(os.lstat(f"{d}/{f}").st_size for d, _, names in os.walk(top) if "/package-" not in d for f in names)


@pytest.mark.parametrize("name", ["quality", "repeats"])
def test_stage_leaves_no_texts_behind(spark, frame, name):
    """Whoever reads a stage's result finds its tables in the shared folder: they hold keys and places, no texts."""
    rng = random.Random(1)
    passages = [rng.randbytes(60).hex() for _ in range(4)]
    rows = [(i, rng.randbytes(4_000).hex() + rng.choice(passages), "en", "src1", 0) for i in range(200)]
    df, before = frame(rows, SCHEMA, extra=()), scratch_bytes()
    left = {r["doc_id"]: r["text"] for r in stage(name)(spark, df, SF).collect()}
    own = dict(r[:2] for r in rows)
    assert all(own[i].startswith(t) for i, t in left.items())
    assert name == "quality" or len(left) == 200 and sum(7_950 < len(t) <= 8_000 for t in left.values()) >= 196
    assert scratch_bytes() - before < 0.1 * sum(map(len, own.values()))


def test_kept_rows_of_one_id_go_by_their_texts(spark, frame):
    """Rows of one id, site and text are kept or go together; others of that id do not follow them."""
    rows = awkward() + [(9, None, "en", "src2", 7), (None, "", None, None, 8)]
    df = frame(rows, SCHEMA, extra=CLASH)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.classify(df, labels, carry=["text"])[0].collect()
    want = Counter((r["doc_id"], r["carried_0"], r["path"], r["host"]) for r in scored if r["kept"])
    got = Counter(tuple(r) for r in quality.filter_documents(df, labels).select("doc_id", "text", "lang", "source").collect())
    assert got == want and 0 < sum(want.values())


def test_near_copies_stage(spark, docs):
    rows, df = docs
    gone = {i for i, _, c in brute_copies([r[:2] for r in rows]) if i is not None and c is not None and i != c}
    assert gone and values(stage("near_copies")(spark, df, SF)) == Counter(r for r in rows if r[0] not in gone)


def test_repeats_stage(spark, docs):
    rows, df = docs
    first = {}
    for i, t, *_ in rows:
        t = (t or "").encode()
        for p in range(len(t) - 49):
            k = t[p:p + 50]
            first[k] = min(first.get(k, LAST), LAST if i is None else i)
    want = Counter()
    for i, t, lang, source, _ in rows:
        b, gone = (t or "").encode(), set()
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < (LAST if i is None else i):
                gone.update(range(p, p + 50))
        out, at = "", 0
        for ch in t or "":
            size = len(ch.encode())
            if not gone & set(range(at, at + size)):
                out += ch
            at += size
        if out or not gone:
            text = t if not gone else out
            want[i, text, lang, source, None if text is None else len(text)] += 1
    assert sum(want.values()) < len(rows) and values(stage("repeats")(spark, df, SF)) == want


def test_mixture_stage(spark, docs):
    rows, df = docs
    import hashlib
    import re
    domain = lambda s: "d" + str(int((re.findall("[0-9]+", s or "") or ["0"])[0]) % 4)       # noqa: E731
    size = lambda t: len((t or "").split())                                                  # noqa: E731
    leaves = Counter()
    for _, t, x, s, _ in rows:
        leaves[domain(s), x or "(null)", s or "(null)"] += size(t)
    leaves = {k: n for k, n in leaves.items() if n}
    budget = sum(leaves.values()) * P.MIXTURE[0] // P.MIXTURE[1]
    weights = [WEIGHTS["domain"], WEIGHTS["lang"], {}]

    def share(prefix, budget):
        level = len(prefix)
        if level == 3:
            return {prefix: budget}
        names = {k[level] for k in leaves if k[:level] == prefix}
        caps = {x: (sum(n for k, n in leaves.items() if k[:level + 1] == (*prefix, x)), weights[level].get(x, 1)) for x in names}
        out = {}
        for x, b in divide(budget, caps).items():
            out |= share((*prefix, x), b)
        return out
    budgets = share((), budget)
    got = values(stage("mixture")(spark, df, SF))
    taken = Counter()
    for (i, t, x, s, n), k in got.items():
        assert n == len(t) and any((i, x, s) == (r[0], r[2], r[3]) and (r[1] or "").startswith(t) for r in rows)
        taken[domain(s), x or "(null)", s or "(null)"] += k * size(t)
    assert taken == Counter({k: b for k, b in budgets.items() if b})
    whole = Counter()
    for k, b in budgets.items():        # documents with one row for their id are taken in the order of the seeded hash
        own = [(r[0], size(r[1])) for r in rows if (domain(r[3]), r[2] or "(null)", r[3] or "(null)") == k and size(r[1])]
        passes, rest = divmod(b, sum(n for _, n in own))
        key = lambda i: hashlib.md5(f"11:{passes}:{'' if i is None else i}".encode()).hexdigest()     # noqa: E731
        order = sorted(own, key=lambda r: key(r[0]))
        if passes:
            whole.update(i for i, _ in own)
            continue
        for i, n in order:
            if rest <= 0:
                break
            whole[i] += 1
            rest -= n
    ids = Counter(r[0] for r in rows)
    assert all(sum(c for (i, *_), c in got.items() if i == j) == whole[j] for j in ids if ids[j] == 1)


def test_encode_stage(spark, docs):
    rows, df = docs
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(bpe.read_ranks(f.read())), special_tokens={})
    want = Counter()
    for i, t, x, s, _ in rows:
        ids = library.encode_ordinary(t or "")
        want[i, x, s, len(ids), np.array(ids, "<u4").tobytes()] += 1
    got = Counter((r["doc_id"], r["lang"], r["source"], r["n_tokens"], bytes(r["ids"])) for r in stage("encode")(spark, df, SF).collect())
    assert got == want


def test_stages_of_an_empty_table(spark, docs):
    none = docs[1].limit(0)
    for name, run in P.STAGES:
        out = run(spark, none, SF)
        assert out.count() == 0 and (name == "encode" or out.columns == none.columns)


# --- op10: what its contract says -------------------------------------------------------------------

def text(page):
    return "\n".join(html_text.lines_of(page)[0])


def test_comments_go_however_long_they_are():
    page = ("<article><h1>A story</h1><p>Short.</p><section class='comments'>" + "<p>A reader writes at length, and more.</p>" * 50
            + "</section></article>")
    assert text(page) == "A story\nShort."


@pytest.mark.parametrize("name", ["user-comments", "commentlist", "comments-section", "ad-slot", "ads-top", "adsbygoogle", "sharebar",
                                  "related-posts", "author-sidebar", "cookie-notice-bar", "userComments", "AdBox", "newsletter_signup"])
def test_words_within_a_token_count(name):
    for page in (f"<article><p>One</p><div class='x {name}'><p>gone</p></div><p>two</p></article>",
                 f"<p>One</p><div id='{name}'><p>gone</p></div><p>two</p>"):
        assert text(page) == "One\ntwo"
    assert text(f"<div class='{name}'><article><p>One</p></article><p>x</p></div>") == "One"
    assert text(f"<p>One <span class='{name}'>gone</span>and more</p>") == "One and more"


def test_words_that_only_look_alike_do_not_count():
    for name in ("dialog", "header-free", "shadow", "adhesive", "commentary", "menus-open", "no-sidebar", "has-ads", "research", "navy"):
        assert text(f"<article><div class='{name}'><p>Kept</p></div></article>") == "Kept"
    assert text("<article><p>x</p><div role='dialog'><p>gone</p></div></article>") == "x"


def test_inline_elements_end_no_line():
    assert text("<article><p>Hello <script>var a;</script>world, <svg/>again <button>OK</button>end.</p></article>") == "Hello world, again end."
    assert text("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be <input value='q'>small<svg><path d=''/><text>no</text></svg>.</p>") \
        == "Let x=2 be small."
    assert text("<p>a <noscript>no</noscript>b <select><option>c</select>d <iframe>x</iframe>e</p>") == "a b d e"


def test_headings_that_articles_share_stay(frame):
    rows = [(i, f"http://h.org/{i}", f"<p>Top</p><article><p>Share</p><h1>Dish {i}</h1><h2>Ingredients</h2><p>flour {i}</p><h2>Method</h2>"
             f"<p>mix {i}</p><p>All rights</p></article>") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in html_text.main_text(frame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Dish {i}\nIngredients\nflour {i}\nMethod\nmix {i}" for i in range(9)}


def test_a_page_in_a_marked_wrapper_is_not_lost():
    assert text("<div class='search'><p>All there is</p></div>") == "All there is"
