"""DuckDB SQL of the queries that SQL can express over whole tables.

The others have none: token ids need the tokenizers' merges (op1, op6), the
classifier and the learned partitions are fitted (op8, op9), and main texts
need an HTML reader (op10); tests hold them against brute force, independent
readers and round trips.
"""
from __future__ import annotations

from petrel.llm.queries import DOMAINS, LEVELS, WEIGHTS

WORD = r"[^\x20\x09-\x0D]+"


def _weight(level: str) -> str:
    cases = " ".join(f"WHEN '{v}' THEN {w}" for v, w in WEIGHTS.get(level, {}).items())
    return f"CASE {level} {cases} ELSE 1 END" if cases else "1"


def _mixing(share: tuple[int, int] = (3, 5), seed: int = 11, epochs: int = 4) -> str:
    ctes = [f"""d AS (SELECT doc_id, 'd' || (coalesce(try_cast(nullif(regexp_extract(source, '([0-9]+)', 1), '') AS BIGINT), 0)
                     % {DOMAINS}) AS domain, coalesce(lang, '(null)') AS lang, coalesce(source, '(null)') AS source,
                     len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n_tokens FROM documents)""",
            f"leaves AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS n FROM d WHERE n_tokens > 0 GROUP BY ALL)",
            f"""above0 AS (SELECT 0 AS root, least((SELECT sum(n_tokens) FROM d)::HUGEINT * {share[0]} // {share[1]},
                           sum(n) * {epochs}) AS b FROM leaves)"""]
    for i, level in enumerate(LEVELS):
        parent = ", ".join(["root", *LEVELS[:i]])
        own = ", ".join(["root", *LEVELS[:i + 1]])
        ctes += [
            f"""n{i} AS (SELECT {own}, cap, b, ({_weight(level)})::HUGEINT AS w FROM
                (SELECT 0 AS root, {', '.join(LEVELS[:i + 1])}, sum(n) * {epochs} AS cap FROM leaves GROUP BY ALL)
                JOIN above{i} USING ({parent}))""",
            f"""f{i} AS (SELECT *, sum(cap) OVER (p ORDER BY cap::DOUBLE / w, {level} ROWS UNBOUNDED PRECEDING) * w
                   + cap * coalesce(sum(w) OVER (p ORDER BY cap::DOUBLE / w, {level} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)
                   <= b * w AS fits FROM n{i} WINDOW p AS (PARTITION BY {parent}))""",
            f"""r{i} AS (SELECT *, b - sum(CASE WHEN fits THEN cap ELSE 0 END) OVER p AS rest,
                   sum(CASE WHEN fits THEN 0 ELSE w END) OVER p AS open_w,
                   row_number() OVER (PARTITION BY {parent}, fits ORDER BY {level}) AS place
                   FROM f{i} WINDOW p AS (PARTITION BY {parent}))""",
            f"s{i} AS (SELECT *, CASE WHEN fits THEN cap ELSE rest * w // nullif(open_w, 0) END AS share FROM r{i})",
            f"""above{i + 1} AS (SELECT {own}, share + CASE WHEN NOT fits AND place <= rest -
                   sum(CASE WHEN fits THEN 0 ELSE share END) OVER (PARTITION BY {parent}) THEN 1 ELSE 0 END AS b FROM s{i})"""]
    ctes += [
        f"""plan AS (SELECT domain, lang, source, (b // n)::BIGINT AS passes, (b % n)::BIGINT AS rest
             FROM leaves JOIN above{len(LEVELS)} USING (domain, lang, source))""",
        f"""rows_ AS (SELECT d.*, passes, rest, md5('{seed}:' || passes || ':' || doc_id) AS key
             FROM d JOIN plan USING (domain, lang, source) WHERE n_tokens > 0)""",
        """last_ AS (SELECT *, least(n_tokens, rest - coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
             ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS take FROM rows_)"""]
    return "WITH " + ",\n".join(ctes) + """
        SELECT doc_id, domain, lang, source, unnest(range(passes))::INTEGER AS epoch, n_tokens, n_tokens AS take
        FROM rows_ WHERE passes > 0
        UNION ALL
        SELECT doc_id, domain, lang, source, passes::INTEGER, n_tokens, take FROM last_ WHERE take > 0"""


_COMPONENT = """
    both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach AS (SELECT {id} AS v, {id} AS r FROM {table} UNION SELECT reach.v, both_.b FROM reach JOIN both_ ON both_.a = reach.r),
    comp AS (SELECT v, min(r) AS c FROM reach GROUP BY v)"""

NEAR_VECTORS = """
    WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    u AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e)
              WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.98::DOUBLE),
    """ + _COMPONENT.format(id="vec_id", table="embeddings").strip() + """
    SELECT vec_id, (SELECT count(*) FROM both_ WHERE a = vec_id)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
    FROM embeddings JOIN comp ON v = vec_id"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_COPIES = f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{WORD}') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
    g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
    both_sets AS (SELECT x.doc_id AS a, y.doc_id AS b, x.n AS n, y.n AS m, count(*) AS k
                  FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM both_sets WHERE 100 * k >= 75 * (n + m - k)),
    """ + _COMPONENT.format(id="doc_id", table="documents").strip() + """
    SELECT doc_id, len(s)::BIGINT AS n_shingles, c AS component_id FROM s JOIN comp ON v = doc_id"""

REPEATS = """
    WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    p AS (SELECT doc_id, h, length(h) // 2 AS n, unnest(range(0, length(h) // 2 - 49)) AS i FROM b WHERE length(h) >= 100),
    t AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM p),
    m AS (SELECT w, min(doc_id) AS first FROM t GROUP BY w),
    hit AS (SELECT t.doc_id, i FROM t JOIN m USING (w) WHERE first < t.doc_id),
    gone AS (SELECT DISTINCT doc_id, i + unnest(range(50)) AS i FROM hit),
    run AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM gone),
    cut AS (SELECT doc_id, r, min(i) AS s, max(i) + 1 AS e FROM run GROUP BY doc_id, r),
    spans AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before,
                     row_number() OVER (PARTITION BY doc_id ORDER BY s DESC) = 1 AS last FROM cut),
    kept AS (SELECT doc_id, count(*) AS n, sum(e - s) AS removed,
                    string_agg(substr(h, 2 * before + 1, 2 * (s - before)) || CASE WHEN last THEN substr(h, 2 * e + 1) ELSE '' END, '' ORDER BY s) AS k
             FROM spans JOIN b USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
           sha256(unhex(coalesce(k, h))) AS kept_sha256
    FROM b LEFT JOIN kept USING (doc_id)"""

ARCHIVE = """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
    q AS (SELECT *, array_to_string(list_transform(range(40), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111',
                 4 * (instr('0123456789abcdef', substr(h, i + 1, 1)) - 1) + 1, 4)), '') AS bits, min(page_id) OVER (PARTITION BY h) AS first FROM p)
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + list_sum(list_transform(range(5), lambda k: (substr(bits, 5 * i + k + 1, 1))::BIGINT * (1 << (4 - k))))::BIGINT, 1)), '') AS payload_digest,
           CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN first = page_id THEN NULL ELSE first END AS refers_to
    FROM q"""

NEGATIVES = """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
               FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
          FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
    SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id)
    WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
    QUALIFY row_number() OVER w <= 3"""

# crc32 of the decimal id bit by bit; runs are islands of equal words q apart, for every q
RUNS = f"""
    WITH c AS (SELECT doc_id, text, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
                        list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                      lambda s, b: list_reduce(list_concat([xor(s, b)], range(8)), lambda x, i:
                        CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS h FROM documents),
    d AS (SELECT doc_id, h % 10 = 0 AS chosen, h // 10 AS g, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM c),
    e AS (SELECT *, len(w) AS n, CASE WHEN chosen AND len(w) > 0 THEN g % len(w) END AS a FROM d),
    f AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM e),
    t AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n),
                 lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM f),
    u AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM t),
    eq AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM u x JOIN u y
           ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
    isl AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS r FROM eq),
    st AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM isl GROUP BY doc_id, q, r
           HAVING count(*) + q >= greatest(6, 4 * q)),
    run AS (SELECT doc_id, start, length, min(q) AS period FROM st GROUP BY doc_id, start, length),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS k FROM u ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
    best AS (SELECT doc_id, count(*) AS n_runs, first(start ORDER BY length DESC, start, period) AS start, max(length) AS length,
                    first(period ORDER BY length DESC, start, period) AS period,
                    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
             FROM run GROUP BY doc_id)
    SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period,
           (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
           sha256(coalesce(k, '')) AS collapsed_sha256
    FROM documents LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def _secrets() -> str:
    """Matches and the pieces between them add up to places; letters in either case are spelled out (no other case rules)."""
    either = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    kinds = [("assign", f"({either})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6, True),
             ("access", "AKIA[A-Z0-9]+", 0, 20, True), ("hex", "[0-9a-f]+", 0, 24, True),
             ("private_key", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 1, False),
             ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, False), ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, False),
             ("google", "AIza[A-Za-z0-9_-]{35}", 0, 1, False),
             ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, False)]
    parts = []
    for number, (kind, pattern, group, least, _) in enumerate(kinds):
        parts.append(f"""
            SELECT doc_id, {number} AS kind, '{kind}' AS name, start, start + length(hit) AS stop FROM (
              SELECT *, sum(length(gap) + coalesce(length(before), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS start FROM (
                SELECT doc_id, i, gaps[i] AS gap, hits[i] AS hit, parts[i] AS part, CASE WHEN i > 1 THEN hits[i - 1] END AS before
                FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
                  SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits,
                         regexp_extract_all(t, '{pattern}', {group}) AS parts FROM d)))) WHERE length(part) >= {least}""")
    base = sum(k[4] for k in kinds)
    span = "name || ':' || start || ':' || stop, ',' ORDER BY start, kind"
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{k[0]}" for i, k in enumerate(kinds) if k[4])
    shown = ", ".join(f"coalesce(n_{k[0]}, 0)::BIGINT AS n_{k[0]}" for k in kinds if k[4])
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    s AS ({' UNION ALL '.join(parts)}),
    a AS (SELECT doc_id, {counts}, string_agg({span}) AS spans, string_agg({span}) FILTER (kind < {base}) AS base FROM s GROUP BY doc_id)
    SELECT doc_id, {shown}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN a USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op2_mixing": _mixing(),
    "op3_embedding_dedup": NEAR_VECTORS,
    "op4_suffix_dedup": REPEATS,
    "op5_ngram_join": NEAR_COPIES,
    "op7_warc": ARCHIVE,
    "op11_hard_negatives": NEGATIVES,
    "op12_periodic_runs": RUNS,
    "op13_secret_scan": _secrets(),
}
