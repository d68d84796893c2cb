"""The same results in SQL, for operators that SQL can express."""

from __future__ import annotations

ONE_SPACED = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"
LOWER_ASCII = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"'[^\x20\x09-\x0D]+'"

EXACT = f"""
SELECT doc_id,
       min(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept,
       sha256(whole) AS text_sha256
FROM (SELECT doc_id, {ONE_SPACED} AS whole FROM documents)
WINDOW same AS (PARTITION BY whole)
"""

NEAR = f"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({LOWER_ASCII}, {WORD}) AS w FROM documents
),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY ALL
),
links AS MATERIALIZED (
  SELECT a, b
  FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)
),
reach (node, other) AS (
  SELECT a, b FROM links
  UNION
  SELECT node, b FROM reach JOIN links ON a = other
)
SELECT doc_id,
       coalesce(n, 0) AS n_shingles,
       least(doc_id, m) AS component_id,
       doc_id <= coalesce(m, doc_id) AS kept
FROM documents
LEFT JOIN sizes USING (doc_id)
LEFT JOIN (SELECT node, min(other) AS m FROM reach GROUP BY node) ON node = doc_id
"""

# Windows are cut from blocks of 1000 bytes and 49 more, as text in hexadecimal.
REPEATS = """
WITH raw AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (
  SELECT doc_id, k, substr(h, 2000 * k + 1, 2098) AS part
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2000 + 1)) AS k FROM raw)
),
windows AS MATERIALIZED (
  SELECT doc_id, 1000 * k + i AS pos, substr(part, 2 * i + 1, 100) AS s
  FROM (SELECT *, unnest(range(0, least(1000, len(part) // 2 - 49))) AS i FROM blocks WHERE len(part) >= 100)
),
firsts AS (SELECT s, min(doc_id) AS first_id FROM windows GROUP BY s),
hits AS (SELECT DISTINCT doc_id, pos FROM windows JOIN firsts USING (s) WHERE first_id < doc_id),
marked AS (
  SELECT *, coalesce(pos > 50 + lag(pos) OVER (PARTITION BY doc_id ORDER BY pos), true)::INT AS opens FROM hits
),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM marked),
spans AS (
  SELECT doc_id, min(pos) AS a, max(pos) + 50 AS b FROM numbered GROUP BY doc_id, n
),
between_ AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans
),
kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS rest,
         string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS pieces
  FROM between_ JOIN raw USING (doc_id) GROUP BY doc_id
)
SELECT doc_id,
       CAST(len(h) // 2 AS BIGINT) AS n_bytes,
       CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(pieces, '') || substr(h, 2 * coalesce(rest, 0) + 1))) AS kept_sha256
FROM raw LEFT JOIN kept USING (doc_id)
"""

AUDIT = f"""
WITH facts AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS whole, regexp_extract_all(coalesce(text, ''), {WORD}) AS w,
         doc_id > min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS later
  FROM documents
),
flags AS MATERIALIZED (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * length(regexp_replace(whole, '[^A-Z]', '', 'g')) > 2 * length(whole) AS c,
         regexp_matches(whole, '[#$%&*|]') AS d, coalesce(later, false) AS e,
         coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM facts LEFT JOIN labels USING (doc_id)
),
failing AS MATERIALIZED (
  SELECT part, good, toxic, list_filter([if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')], lambda x: x <> '') AS fails
  FROM flags
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS MATERIALIZED (
  SELECT v.l || w.l || x.l || y.l || z.l AS filter_order
  FROM letters v, letters w, letters x, letters y, letters z
  WHERE len(list_distinct([v.l, w.l, x.l, y.l, z.l])) = 5
),
gone AS MATERIALIZED (
  SELECT *, coalesce(list_min(list_transform(fails, lambda x: strpos(filter_order, x))), 6) AS left_at FROM failing, orders
),
steps AS MATERIALIZED (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step,
         count(*) FILTER (left_at > step) AS kept, count(*) FILTER (left_at = step) AS removed,
         count(*) FILTER (left_at < step AND list_contains(fails, filter_order[step])) AS redundant,
         count(*) FILTER (len(fails) = 1 AND left_at = step) AS unique_fails,
         count(*) FILTER (left_at = step AND good) AS good_lost, count(*) FILTER (left_at = step AND toxic) AS toxic_lost
  FROM gone, range(1, 6) s(step) GROUP BY ALL
)
SELECT *, CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley FROM steps
"""


def _codes() -> str:
    """Rounds of assigning each part to its nearest entry and moving the entries."""
    parts = ["""
whole AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
points AS MATERIALIZED (
  SELECT id, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM whole, range(0, 4) r(p)
),
first AS (SELECT id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM whole QUALIFY entry < 256),
book_0 AS MATERIALIZED (SELECT p, entry, x AS y FROM points JOIN first USING (id))"""]
    for k in range(5):
        parts.append(f"""
near_{k} AS MATERIALIZED (
  SELECT id, a.p, min({{'d': list_dot_product(x::DOUBLE[], x::DOUBLE[]) + list_dot_product(y::DOUBLE[], y::DOUBLE[])
                       - 2 * list_dot_product(x::DOUBLE[], y::DOUBLE[]), 'entry': entry}}) AS best
  FROM points a JOIN book_{k} b ON a.p = b.p GROUP BY id, a.p
)""")
        if k < 4:
            parts.append(f"""
sums_{k} AS (
  SELECT p, entry, i, sum(c) AS s, count(*) AS n
  FROM (SELECT p, best.entry AS entry, unnest(x) AS c, unnest(range(len(x))) AS i FROM near_{k} JOIN points USING (id, p))
  GROUP BY ALL
),
means_{k} AS (SELECT p, entry, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS y FROM sums_{k} GROUP BY ALL),
book_{k + 1} AS MATERIALIZED (
  SELECT p, entry, coalesce(m.y, b.y) AS y FROM book_{k} b LEFT JOIN means_{k} m USING (p, entry)
)""")
    return "WITH" + ",".join(parts) + """,
coded AS MATERIALIZED (
  SELECT id, string_agg(printf('%02x', best.entry), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near_4 GROUP BY id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, entry)) FROM book_4) AS codebooks_sha256
FROM whole JOIN coded USING (id)
"""


ORACLES: dict[str, str] = {
    "op1_suffix_array_dedup": REPEATS,
    "op2_minhash_near_dedup": NEAR,
    "op8_exact_dedup": EXACT,
    "op11_filter_audit": AUDIT,
    "op12_vector_codes": _codes(),
}
