"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP10_QUALITY_RULES = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
    list_filter(list_transform(string_split(regexp_replace(lower(regexp_replace(
      t, '[\x20\x09\x0B-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ns
  FROM d
), windows AS (
  SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS win
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, sum(least(8, coalesce(nx - i, 8))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM twice) GROUP BY r
), frequent AS (
  SELECT host, line FROM (SELECT host, t, unnest(ns) AS line FROM w) GROUP BY host, line HAVING count(DISTINCT t) > 20
), lost AS (
  SELECT r, sum(len(string_split(line, ' '))) AS n
  FROM (SELECT r, host, unnest(ns) AS line FROM w) JOIN frequent USING (host, line) GROUP BY r
), s AS (
  SELECT w.doc_id, len(ws) AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(lost.n, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN covered USING (r) LEFT JOIN lost USING (r)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s
)
SELECT *, NOT base_failed AND removed_words <= 0.75 * n_words AS kept FROM f
"""

OP6_VECTOR_SEARCH = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP4_REVISITS = r"""
WITH u AS (
  SELECT page_id, octet_length(encode(html)) AS size,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages WHERE url IS NOT NULL
), c AS (
  SELECT page_id, size,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), ':(80|443)$', ''), '^www[0-9]*\.', '')
      || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS page,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(?i:utm_[a-z]+|fbclid|gclid)(=|$)'))), '&') AS query FROM u
), k AS (
  SELECT page_id, size, page || CASE WHEN query = '' THEN '' ELSE '?' || query END AS page,
    '"v' || (page_id % 2) || '"' AS tag, 'day ' || (page_id % 5) AS day FROM c
), a AS (
  SELECT r.page_id, r.tag, f.page_id AS found, f.tag AS found_tag, f.day, f.size,
    row_number() OVER (PARTITION BY r.page_id ORDER BY f.page_id DESC NULLS LAST) AS n
  FROM k AS r LEFT JOIN k AS f
    ON f.page = r.page AND f.page_id <= r.page_id AND f.page_id % 7 <> 1 AND f.page_id % 11 <> 3
)
SELECT 2 * page_id + 1 AS record_id, 2 * found AS refers_to,
  CASE WHEN found IS NULL THEN 'missing' WHEN tag = found_tag THEN 'resolved' ELSE 'mismatch' END AS outcome,
  tag AS etag, CASE WHEN tag = found_tag THEN day END AS last_modified,
  CASE WHEN tag = found_tag THEN 'text/html' END AS content_type,
  CASE WHEN tag = found_tag THEN CAST(size AS VARCHAR) ELSE '0' END AS content_length,
  CAST(page_id % 100 AS VARCHAR) AS age
FROM a WHERE n = 1
"""

OP11_SOURCE_DIVERGENCE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents
), t AS (
  SELECT r, lang, source, unnest(ws) AS term FROM d
), kept AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), g AS (
  SELECT d.lang, d.source, coalesce(any_value(s.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) AS d
  LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY lang, source) AS s USING (lang, source) GROUP BY d.lang, d.source
), p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n,
    CAST(1 + (1000000000 * (coalesce(c.n, 0) + 1)::HUGEINT) // (g.n + v) AS BIGINT) AS p
  FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
), q AS (
  SELECT lang, term, CAST(1 + (1000000000 * (sum(c.n) + 1)::HUGEINT) // (any_value(l.n) + any_value(v)) AS BIGINT) AS q
  FROM c JOIN v USING (lang) JOIN (SELECT lang, sum(n) AS n FROM g GROUP BY lang) AS l USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
), found AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), both_parts AS (
  SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM pairs LEFT JOIN found USING (lang, source, item)
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM both_parts
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def hash_tree(nodes: str, state: str, prefix: str, depth: int) -> str:
    """CTEs that fold (grp, pos, n, digest) and, with it, (r, grp, pos, n, node, sibs) of every leaf, ``depth`` times."""
    made = ""
    for k in range(depth):
        made += f"""
{prefix}s{k} AS (
  SELECT s.r, s.grp, s.pos // 16 AS pos, (s.n + 15) // 16 AS n,
    CASE WHEN s.n > 1 THEN sha256(coalesce(string_agg(d.digest, '' ORDER BY d.pos) FILTER (d.pos < s.pos), '') || s.node
      || coalesce(string_agg(d.digest, '' ORDER BY d.pos) FILTER (d.pos > s.pos), '')) ELSE s.node END AS node,
    s.sibs || coalesce(string_agg(d.digest, '' ORDER BY d.pos) FILTER (d.pos <> s.pos), '') AS sibs
  FROM {state} AS s JOIN {nodes} AS d ON s.grp = d.grp AND s.pos // 16 = d.pos // 16
  GROUP BY s.r, s.grp, s.pos, s.n, s.node, s.sibs
), {prefix}n{k} AS (
  SELECT grp, pos // 16 AS pos, (any_value(n) + 15) // 16 AS n,
    CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY pos)) ELSE any_value(digest) END AS digest
  FROM {nodes} GROUP BY grp, pos // 16
),"""
        nodes, state = f"{prefix}n{k}", f"{prefix}s{k}"
    return made


def counted(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


OP13_MERKLE_MANIFEST = f"""
WITH crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
    ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)
), checked AS (
  SELECT d.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 AS tampered FROM documents AS d, crc
), hashed AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp,
    sha256(head || {counted("text")}) AS leaf,
    sha256(head || {counted("CASE WHEN tampered THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END")}) AS found
  FROM (SELECT *, {" || ".join(counted(c) for c in ("doc_id", "source", "lang", "n_chars"))} AS head FROM checked)
), placed AS (
  SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY grp) AS n FROM hashed
), leaves AS (
  SELECT grp, pos, n, leaf AS digest FROM placed
), started AS (
  SELECT r, grp, pos, n, found AS node, '' AS sibs FROM placed
), {hash_tree("leaves", "started", "leaf_", 5)}
tops AS (
  SELECT 0 AS grp, grp AS pos, count(*) OVER () AS n, digest FROM leaf_n4
), risen AS (
  SELECT r, 0 AS grp, grp AS pos, (SELECT count(*) FROM tops) AS n, node, sibs FROM leaf_s4
), {hash_tree("tops", "risen", "top_", 3)}
root AS (SELECT digest AS root FROM top_n2)
SELECT doc_id, leaf, tops.digest AS subroot, root, sha256(s.sibs) AS proof_sha256, s.node AS folded_root, s.node = root AS verified
FROM placed JOIN tops ON tops.pos = placed.grp JOIN top_s2 AS s USING (r), root
"""
