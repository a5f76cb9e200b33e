"""BPE, token files, archives and main texts: round trips and independent readers."""
import base64
import gzip
import hashlib
import html
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

from petrel.llm import bpe, html_text, token_files, warc

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [(5, "Hello world, it's 12,345 o'clock.\n\n  Größe é ﬁ 日本語 \U0001F600 <|endoftext|>"), (2, None), (9, ""),
         (None, "no id"), (2, "repeated id"), (11, "a" * 5000), (12, "\x1c\x1d\x00 x y　z  "), (13, "İ ΣΑΣ ß Ÿ a, b. ..."),
         (14, " \t\n ")]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(bpe.read_ranks(f.read())),
                                 special_tokens={})


def test_perfect_hash_is_minimal_and_perfect():
    for n in (1, 2, 7, 1000):
        keys = bpe.hashes([f"k{i}".encode() for i in range(n)])
        assert sorted(bpe.PerfectHash(keys).slot_of.tolist()) == list(range(n))


def test_bpe_round_trip(spark, frame, reference):
    df = frame(TEXTS, "doc_id long, text string", extra=("ids", "c0", "c1"))
    got = bpe.encode(df, RANKS, public_tokenizers.PATTERN, decoded="decoded").collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert np.frombuffer(r["ids"], "<u4").tolist() == reference.encode_ordinary(r["text"] or "")
        assert r["decoded"] == (r["text"] or "").encode()
    back = bpe.decode(bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    assert all(r["decoded"] == (r["text"] or "").encode() for r in back)
    assert bpe.encode(frame([], "doc_id long, text string"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_on_documents(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in bpe.encode(docs, RANKS, public_tokenizers.PATTERN).collect():
        assert np.frombuffer(r["ids"], "<u4").tolist() == reference.encode_ordinary(r["text"])


@pytest.mark.parametrize("length", [8, 2048])
def test_token_files(spark, frame, tmp_path, length):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(WORDS)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40).collect()
    rows = TEXTS + [(100 + r[0], r[1]) for r in docs]
    folder = f"file://{tmp_path}/tokens"
    token_files.write_tokens(frame(rows, "doc_id long, text string"), WORDS, folder, end_id=2, length=length)
    got = token_files.checksums(spark, folder).collect()
    ids = [(i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows]
    want = {(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids}
    assert {(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got} == want and len(got) == len(rows)
    order = sorted(got, key=lambda r: r["start"])
    at = 0
    for r in order:
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in order]
    assert keys == sorted(keys)
    masked = 0
    for path in sorted((tmp_path / "tokens" / "data").iterdir()):
        file = token_files.Sequences(str(path))
        n = sum(file.file.get_batch(b).num_rows for b in range(file.file.num_record_batches))
        assert isinstance(file.file.schema.field("ids").type, pa.FixedSizeListType)
        for i in range(n):
            x, mask = file.sequence(i)
            assert len(x) == len(mask) == length
            masked += int(mask.sum())
    assert masked == at
    token_files.write_tokens(frame([], "doc_id long, text string"), WORDS, folder + "-none", end_id=2)
    assert token_files.checksums(spark, folder + "-none").count() == 0


PAGES = [(1, "https://www.Example.com:443/a/b?x=1", "<p>same</p>"), (2, "http://u@example.com/", "<p>same</p>"),
         (3, None, None), (4, "nonsense\nurl\t%41", ""), (None, "http://example.com/", "<p>same</p>"), (7, "http://é.org/ü", "é" * 9000),
         (8, "http://example.com/", "<p>other</p>"), (8, "http://example.com/", "<p>other</p>")]


@pytest.mark.parametrize("least", [0, 11, 12])
def test_archive_round_trip(spark, frame, tmp_path, least):
    df = frame(PAGES, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/archive"
    warc.write_archive(df, folder, min_bytes=least)
    got = warc.look_up(df, folder).collect()
    assert len(got) == len(PAGES)
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        revisit = i != first[h or ""] and len(raw) >= least
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response",
                     first[h or ""] if revisit else None, b"" if revisit else raw))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    some = warc.look_up(spark.createDataFrame([(7, "http://é.org/ü"), (99, "http://no.where/")], "page_id long, url string"), folder)
    assert [r["page_id"] for r in some.collect()] == [7]


def test_archive_files_are_plain_warc(spark, frame, tmp_path):
    warc.write_archive(frame(PAGES, "page_id long, url string, html string"), f"file://{tmp_path}/a")
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "a" / "warc").iterdir())
    assert raw.count(b"WARC/1.1\r\n") == len(PAGES) and raw.count(b"WARC-Type: revisit") == 3
    assert warc.surt("https://www.Example.com:443/a?b") == "com,example,www)/a?b"


class Reader(HTMLParser):
    """An independent reading of a page's article, for well-formed markup."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts = 0, [[]]

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.inside = 1
        if tag in ("p", "h1", "article"):
            self.parts.append([])
        if tag == "br":
            self.parts[-1].append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.parts.append([])
        if tag == "article":
            self.inside = 0

    def handle_data(self, data):
        if self.inside:
            self.parts[-1].append(data)


def test_main_text_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r["page_id"]: r for r in pages.collect()}
    got = html_text.main_text(pages).collect()
    assert len(got) == len(source)
    for r in got:
        reader = Reader()
        reader.feed(source[r["page_id"]]["html"])
        want = "\n".join(t for t in (" ".join("".join(p).split()) for p in reader.parts) if t)
        assert (r["text"], r["n_chars"], r["url"]) == (want, len(want), source[r["page_id"]]["url"])


def test_structure_rules_lines_out():
    page = """<html><head><title>t</title><style>a{}</style></head><body><header>Site</header>
    <nav><a>Menu</a></nav><div class="cookie-notice">We use cookies</div><script>var a = "</p><p>no";</script>
    <article><header><h1>The &lt;title&gt;</h1></header><p>One &amp;&nbsp;two<br>three <b>bold</b>text</p>
    <aside>side</aside><form><input value="x">send</form><div class='ad'>buy</div><p>Last
    <section class="comments"><p>first!</p></section></article><footer>&copy;</footer></body></html>"""
    assert html_text.lines_of(page) == (["The <title>", "One & two three boldtext", "Last"], True)
    assert html_text.lines_of("") == ([], False)
    assert html_text.lines_of("<p>a<p>b<!-- c --><div>d > e < f</div><unclosed") [0][:2] == ["a", "b"]


def test_shared_lines_are_a_longest_common_subsequence():
    import random
    rng = random.Random(4)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]
    for _ in range(200):
        a = [rng.randrange(6) for _ in range(rng.randrange(14))]
        b = [rng.randrange(6) for _ in range(rng.randrange(14))]
        got = sorted(html_text.shared(a, b))
        assert len(got) == lcs(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in got)


def test_differencing_of_pages_without_an_article(spark, frame):
    def page(body):
        return f"<body><div>Home of things</div><div>{body}</div><p>extra {body}</p><p>line {body}</p><div>All rights</div></body>"
    rows = [(1, "http://h.org/a/1", page("first")), (2, "http://h.org/a/2", page("second")),
            (3, "http://h.org/a/3", page("third")), (4, "http://other.org/x", page("alone")),
            (5, "http://copy.org/1", page("copy")), (6, "http://copy.org/2", page("copy")),
            (7, None, None), (8, "http://h.org/z/9", "<article><p>Home of things</p><p>kept</p></article>"),
            (8, "http://h.org/z/9", "<article><p>Home of things</p><p>kept</p></article>")]
    got = [(r["page_id"], r["text"]) for r in html_text.main_text(frame(rows, "page_id long, url string, html string")).collect()]
    text = dict(got)
    assert len(got) == len(rows)
    assert text[1] == "first\nextra first\nline first" and text[3] == "third\nextra third\nline third"
    assert text[4].startswith("Home of things\nalone") and text[5] == text[6] and text[5].endswith("All rights")
    assert text[7] == "" and text[8] == "Home of things\nkept"
    assert html_text.main_text(frame([], "page_id long, url string, html string")).count() == 0
    assert html.unescape("&amp;") == "&"


def test_classes_rule_out_no_element_with_the_article():
    body = "<p>Some words of the article</p><p>and more of them</p>"
    want = ["Some words of the article", "and more of them"]
    for page in (f"<body class='single comments-open'><article>{body}</article></body>",
                 f"<div class='container has-sidebar'>{body}</div>", f"<div id='search-results'>{body}</div>",
                 f"<section class='share-enabled'><article>{body}</article></section>",
                 f"<div class='search'><main>{body}</main></div>", f"<div class='widget'>{body}</div><p>x</p>",
                 f"<article class='comment'>{body}</article>",
                 f"<article>{body}</article><div class='comments'><article class='comment'>A long, long comment, longer than"
                 " all of the article and all of its words</article></div>",
                 f"<article>{body}</article><div class='related'><article>Other</article></div>"):
        assert html_text.lines_of(page)[0][:2] == want
        assert html_text.lines_of(page)[0][2:] in ([], ["x"])
    assert html_text.lines_of(f"{body}<div class='site-nav'>Menu</div><div class='share-bar'>Share</div>")[0] == want


@pytest.mark.parametrize("n, cells", [(60, 1), (60, 200), (2500, 1 << 24)])
def test_alignment_is_exact_at_all_sizes(monkeypatch, n, cells):
    import random
    rng = random.Random(n)
    monkeypatch.setattr(html_text, "CELLS", cells, raising=False)
    a, b = ([rng.randrange(3) for _ in range(n)] for _ in range(2))      # repeated lines only
    got = sorted(html_text.shared(a, b))
    row = np.zeros(n + 1, int)
    for x in a:
        step = np.append(0, np.where(x == np.array(b), row[:-1] + 1, 0))
        row = np.maximum.accumulate(np.maximum(row, step))
    assert len(got) == row[-1]
    rest = iter(b)
    assert all(a[i] in rest for i in got)


def template_rows():
    """Pages without an article: a long template, runs of near copies, a host of two pages."""
    def page(*own):
        lines = [f"Template {i}" for i in range(12)] + list(own) + [f"Foot {i}" for i in range(8)]
        return "".join(f"<p>{x}</p>" for x in lines)

    def own(k):
        return [f"{k} own {i}" for i in range(3)]
    body = [f"A copied line {i}" for i in range(30)]
    rows = [(i, f"http://two.org/{i}", page(*own(i)), own(i)) for i in (1, 2)]
    rows += [(10 + i, f"http://many.org/a/{i}", page(*own(10 + i)), own(10 + i)) for i in range(4)]
    rows += [(20 + i, f"http://many.org/b/{i}", page(*body, f"count {i}"), [*body, f"count {i}"]) for i in range(5)]
    rows += [(30 + i, f"http://many.org/c/{i}", page(*own("same")), own("same")) for i in range(4)]
    return rows + [(40 + i, f"http://many.org/d/{i}", page(*own(40 + i)), own(40 + i)) for i in range(6)]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_copies_go_by_their_own_lines(monkeypatch, frame, parts):
    monkeypatch.setattr(html_text, "wide", lambda spark: parts)
    rows = template_rows()
    got = html_text.main_text(frame([r[:3] for r in rows], "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"].split("\n") for r in got}
    assert text == {r[0]: r[3] for r in rows}


def test_differencing_decides_in_articles(frame):
    rows = []
    for i in range(8):
        quote = "<p>A quotation of some</p>" if i < 3 else ""
        menu = f"<p>Outside {i}</p>" * (i % 3)
        rows.append((i, f"http://h.org/{i}", f"<p>Top</p>{menu}<article><p>Share this</p><p>own {i}</p>{quote}"
                     "<p>All under one licence</p></article><p>Foot</p>"))
    rows += [(20 + i, f"http://few.org/{i}", f"<article><p>Shared by two</p><p>few {i}</p></article>") for i in range(2)]
    got = html_text.main_text(frame(rows, "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[i] == f"own {i}" + "\nA quotation of some" * (i < 3) for i in range(8))
    assert all(text[20 + i] == f"Shared by two\nfew {i}" for i in range(2))


def test_texts_of_pages_are_neither_stored_nor_shuffled(monkeypatch, frame):
    kept = []
    monkeypatch.setattr(html_text, "stored", lambda df, name, _of=html_text.stored: kept.append(df.columns) or _of(df, name))
    rows = template_rows()
    out = html_text.main_text(frame([r[:3] for r in rows], "page_id long, url string, html string"))
    assert len(out.collect()) == len(rows)
    assert kept and not {"text", "html"} & {c for columns in kept for c in columns}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_many_lines_to_delete_are_joined_by_a_shuffle(spark, frame):
    rows = template_rows()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = html_text.main_text(frame([r[:3] for r in rows], "page_id long, url string, html string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r["page_id"]: r["text"].split("\n") for r in got} == {r[0]: r[3] for r in rows}
