"""SQL fragments shared by the expected results."""

from __future__ import annotations

import glob
import os
import zipfile

import pyspark

WORDS = r"[\p{L}\p{N}_]+"
CLEAN = (
    rf"list_filter(regexp_extract_all(lower(text), '{WORDS}'), "
    r"lambda x: regexp_full_match(x, '[a-z]{3,}'))"
)
SPACE = (
    r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
PUNCT_PATTERN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{SPACE}]"
PUNCT_TOKENS = f"regexp_extract_all(lower(text), '{PUNCT_PATTERN}')"
WORD_COUNT = f"len(list_filter(regexp_split_to_array(text, '[{SPACE}]+'), lambda w: w <> ''))"


def english_stop_words() -> list[str]:
    """The stop list that ships in Spark's own jar, read without a session."""
    homes = [os.path.dirname(pyspark.__file__), os.environ.get("SPARK_HOME", "")]
    jars = [jar for home in homes for jar in glob.glob(f"{home}/jars/spark-mllib_*.jar")]
    with zipfile.ZipFile(jars[0]) as jar:
        text = jar.read("org/apache/spark/ml/feature/stopwords/english.txt").decode()
    return text.split("\n")


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words if w)


STOP_LIST = _quoted(english_stop_words())
KEPT = f"list_filter({CLEAN}, lambda w: w NOT IN ({STOP_LIST}))"

# (doc_id, lang, pos, term): tokens without stop words, numbered per document
TERMS = f"""terms AS (
  SELECT doc_id, lang, unnest(toks) AS term, generate_subscripts(toks, 1) AS pos
  FROM (SELECT doc_id, lang, {KEPT} AS toks FROM documents))"""

# TF-IDF in steps: weights(doc_id, lang, term, weight)
TFIDF = f"""{TERMS},
totals AS (SELECT term, count(*) AS total, count(DISTINCT doc_id) AS df FROM terms GROUP BY term),
kept AS (
  SELECT term, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1.0 AS idf
  FROM totals ORDER BY total DESC, term LIMIT 5000),
raw AS (
  SELECT doc_id, lang, t.term, count(*) * max(k.idf) AS w
  FROM terms t JOIN kept k ON k.term = t.term GROUP BY doc_id, lang, t.term),
weights AS (SELECT doc_id, lang, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw),
sizes AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
means AS (
  SELECT w.lang, term, sum(weight) / max(n) AS mean_weight
  FROM weights w JOIN sizes s ON s.lang = w.lang GROUP BY w.lang, term)"""

# (token, id) of whole texts, or of their first characters
def vocab_sql(text: str = "text") -> str:
    return f"""firsts AS (
  SELECT token, min(row(doc_id, pos)) AS seen FROM (
    SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) AS pos
    FROM (SELECT doc_id, regexp_extract_all(lower({text}), '{PUNCT_PATTERN}') AS toks FROM documents))
  GROUP BY token),
vocab AS (
  SELECT token, row_number() OVER (ORDER BY seen) + 1 AS id FROM firsts
  UNION ALL SELECT '<pad>', 0 UNION ALL SELECT '<unk>', 1)"""


VOCAB = vocab_sql()
VOCAB_512 = vocab_sql("left(text, 512)")

WORD_VECTORS = f"""word_vectors AS (
  SELECT word, embedding AS vector FROM (
    SELECT word, row_number() OVER (ORDER BY word) - 1 AS vec_id
    FROM (SELECT DISTINCT unnest({PUNCT_TOKENS}) AS word FROM documents)) r
  JOIN embeddings e ON e.vec_id = r.vec_id)"""

RECORDS = """records AS (
  SELECT conv_id || '-' || turn AS msg_id, role,
    CASE WHEN role = 'system' THEN text
         WHEN turn = 1 THEN 'Title. Plot: intro Plot: ' || text || chr(10) || 'Note: end'
         ELSE 'Title. Plot: ' || text || chr(10) || 'Note: end' END AS content,
    CASE WHEN role = 'system' THEN NULL
         WHEN turn % 3 = 0 THEN string_split(text, ' ')[1] || ' , ' || coalesce(string_split(text, ' ')[2], '')
         WHEN turn % 3 = 1 THEN string_split(text, ' ')[1] || ', ' || coalesce(string_split(text, ' ')[2], '')
         ELSE string_split(text, ' ')[1] END AS answer
  FROM conversations),
strict AS (
  SELECT msg_id, role, content,
    CASE WHEN strpos(content, 'Plot: ') > 0 AND answer IS NOT NULL THEN
      regexp_replace(string_split(string_split(content, 'Plot: ')[2], chr(10) || 'Note')[1], '^\\s+|\\s+$', '', 'g')
    END AS plot,
    CASE WHEN strpos(content, 'Plot: ') > 0 THEN answer END AS answer
  FROM records)"""

# (o_orderkey, brand) and the full order x class grid with truth, logit and prediction
MEMBERS = """member AS (
  SELECT DISTINCT o_orderkey, p_brand AS brand
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
CELLS = f"""{MEMBERS},
classes AS (
  SELECT brand, CAST(substr(brand, 7) AS BIGINT) AS b, row_number() OVER (ORDER BY brand) - 1 AS pos
  FROM (SELECT DISTINCT brand FROM member)),
grid AS (
  SELECT o.o_orderkey, c.brand, c.b, c.pos, CASE WHEN m.brand IS NULL THEN 0 ELSE 1 END AS t
  FROM orders o CROSS JOIN classes c
  LEFT JOIN member m ON m.o_orderkey = o.o_orderkey AND m.brand = c.brand),
cells AS (
  SELECT *, CASE WHEN logit > 0 THEN 1 ELSE 0 END AS p FROM (
    SELECT *, ((o_orderkey * 7919 + b * 104729) % 2001 - 1000) / CAST(250.0 AS DOUBLE)
              + 3 * t - CAST(1.5 AS DOUBLE) AS logit FROM grid)),
class_cells AS (
  SELECT brand, sum(t * p) AS tp, sum((1 - t) * p) AS fp, sum(t * (1 - p)) AS fn FROM cells GROUP BY brand)"""

# (vec_id, label, pos, v) from 1, and class means
ENTRIES = """entries AS (
  SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS pos
  FROM embeddings)"""
PROTOTYPES = f"""{ENTRIES},
proto AS (SELECT label AS c, pos, avg(v) AS w FROM entries GROUP BY label, pos)"""


def cosine_scores(name: str, low: int, high: int) -> str:
    """CTE ``name(vec_id, label, c, s)``: 10 x cosine to each class mean over a range of dimensions."""
    return f"""{name} AS (
  SELECT vec_id, label, c,
    10.0 * sum(v * w) / (sqrt(sum(v * v)) * sqrt(sum(w * w))) AS s
  FROM entries JOIN proto USING (pos) WHERE pos BETWEEN {low} AND {high} GROUP BY vec_id, label, c)"""


SCORES = f"{PROTOTYPES}, {cosine_scores('scores', 1, 64)}"
NEAREST = f"""{SCORES},
nearest AS (
  SELECT vec_id, label AS y_true, c AS y_pred FROM scores
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) = 1)"""
ZERO_SHOT = f"""{PROTOTYPES}, {cosine_scores('image_s', 1, 32)}, {cosine_scores('text_s', 33, 64)},
probs AS (
  SELECT vec_id, label, c, exp(i.s) / sum(exp(i.s)) OVER w AS pi, exp(t.s) / sum(exp(t.s)) OVER w AS pt
  FROM image_s i JOIN text_s t USING (vec_id, label, c) WINDOW w AS (PARTITION BY vec_id)),
predicted AS (
  SELECT vec_id, label, mode, c, prob, CASE WHEN prob > 0.1 THEN 1 ELSE 0 END AS p,
         CASE WHEN c = label THEN 1 ELSE 0 END AS t FROM (
    SELECT vec_id, label, c, 'image_only' AS mode, pi AS prob FROM probs
    UNION ALL SELECT vec_id, label, c, 'text_only', pt FROM probs
    UNION ALL SELECT vec_id, label, c, 'multimodal', (pi + pt) / 2 FROM probs))"""
# what a mode is compared by
SCORES4 = ["micro_f1", "macro_f1", "subset_acc", "hamming_acc"]
MODE_SCORES = """mode_class AS (
  SELECT mode, c, sum(t * p) AS tp, sum((1 - t) * p) AS fp, sum(t * (1 - p)) AS fn FROM predicted GROUP BY mode, c),
mode_f1 AS (
  SELECT mode, 2.0 * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0) AS micro_f1,
         avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)) AS macro_f1 FROM mode_class GROUP BY mode),
mode_rows AS (SELECT mode, vec_id, min(CASE WHEN t = p THEN 1 ELSE 0 END) AS same FROM predicted GROUP BY mode, vec_id),
mode_subset AS (SELECT mode, avg(same) AS subset_acc FROM mode_rows GROUP BY mode),
mode_hamming AS (SELECT mode, avg(CASE WHEN t = p THEN 1.0 ELSE 0.0 END) AS hamming_acc FROM predicted GROUP BY mode),
comparison AS (
  SELECT mode, coalesce(micro_f1, 0) AS micro_f1, macro_f1, subset_acc, hamming_acc
  FROM mode_f1 JOIN mode_subset USING (mode) JOIN mode_hamming USING (mode))"""
COMPARISON = f"{ZERO_SHOT},\n{MODE_SCORES}"

# gray images: (vec_id, label, width, x, y, v)
GRAY = f"""{ENTRIES},
gray AS (
  SELECT vec_id, label, width, 64 // width AS height, (pos - 1) % width AS x, (pos - 1) // width AS y,
         CAST(floor((v + 1.0) * 127.5) AS INTEGER) AS v
  FROM (SELECT *, CAST(4 << (label % 3) AS INTEGER) AS width FROM entries)),
lap AS (
  SELECT g.vec_id, g.label, g.width, g.v, l.v + r.v + u.v + d.v - 4 * g.v AS edge
  FROM gray g
  JOIN gray l ON l.vec_id = g.vec_id AND l.y = g.y AND l.x = CASE WHEN g.x = 0 THEN 1 ELSE g.x - 1 END
  JOIN gray r ON r.vec_id = g.vec_id AND r.y = g.y
    AND r.x = CASE WHEN g.x = g.width - 1 THEN g.width - 2 ELSE g.x + 1 END
  JOIN gray u ON u.vec_id = g.vec_id AND u.x = g.x AND u.y = CASE WHEN g.y = 0 THEN 1 ELSE g.y - 1 END
  JOIN gray d ON d.vec_id = g.vec_id AND d.x = g.x AND d.y = CASE WHEN g.y = g.height - 1 THEN g.height - 2 ELSE g.y + 1 END),
quality AS (
  SELECT vec_id, label, width, var_pop(edge) AS sharpness, stddev_pop(v) AS contrast, avg(v) AS gray_avg
  FROM lap GROUP BY vec_id, label, width)"""


def hash_order(column: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || CAST({column} AS VARCHAR)), {column}"


EPOCHS = """epochs AS (
  SELECT user_id AS run, CAST(day(ts) AS INTEGER) AS epoch,
         floor(sum(CAST(round(value * 100) AS BIGINT)) / (count(*) * 10)) / 10.0 AS score,
         count(*) AS seconds
  FROM events GROUP BY 1, 2)"""


def probe_sql(kind: str, classes: int = 10, passes: int = 5, reg: float = 0.001) -> str:
    """CTEs of the full-batch steps of three probes, from ``parts(vec_id, part)`` and ``truths(vec_id, c, t)``.

    ``part`` is ``fit``, ``val`` or null. The last is ``scored(mode, vec_id, c, t, z)`` for the val rows. Position 0 is the bias.
    """
    rate = {"softmax": 0.5, "sigmoid": 0.25}[kind]
    share = {
        "softmax": "e / sum(e) OVER (PARTITION BY mode, vec_id)",
        "sigmoid": "CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END",
    }[kind]
    odds = "ln(k + 0.5)" if kind == "softmax" else "ln(k + 0.5) - ln(n - k + 0.5)"
    sql = f"""x AS MATERIALIZED (
  SELECT mode, vec_id, pos, v, part FROM (
    SELECT 'image_only' AS mode, vec_id, pos, v FROM entries WHERE pos <= 32
    UNION ALL SELECT 'text_only', vec_id, pos, v FROM entries WHERE pos > 32
    UNION ALL SELECT 'multimodal', vec_id, pos, v FROM entries
    UNION ALL SELECT mode, vec_id, 0, 1.0 FROM embeddings, (SELECT unnest(['image_only', 'text_only', 'multimodal']) AS mode))
  JOIN parts USING (vec_id) WHERE part IS NOT NULL),
sizes AS MATERIALIZED (
  SELECT mode, count(DISTINCT vec_id) AS n, 1 / ({rate} * (sum(v * v) FILTER (pos > 0) / count(DISTINCT vec_id) + 1.0) + {reg}) AS step
  FROM x WHERE part = 'fit' GROUP BY mode),
w0 AS MATERIALIZED (
  SELECT mode, c, pos, CASE WHEN pos = 0 THEN {odds} ELSE 0 END AS w, CASE WHEN pos = 0 THEN {odds} ELSE 0 END AS y
  FROM (SELECT DISTINCT mode, pos FROM x) JOIN sizes USING (mode),
    (SELECT c, sum(t) AS k FROM truths JOIN parts USING (vec_id) WHERE part = 'fit' GROUP BY c))"""
    for k in range(passes):
        ahead = f"{k + 1} / {k + 4}.0::DOUBLE"
        sql += f""",
p{k} AS MATERIALIZED (
  SELECT mode, vec_id, c, {share} - t AS wrong FROM (
    SELECT *, exp(z - max(z) OVER (PARTITION BY mode, vec_id)) AS e FROM (
      SELECT mode, vec_id, c, sum(v * y) AS z FROM x JOIN w{k} USING (mode, pos) WHERE part = 'fit' GROUP BY mode, vec_id, c))
  JOIN truths USING (vec_id, c)),
g{k} AS (SELECT mode, c, pos, sum(wrong * v) AS g FROM x JOIN p{k} USING (mode, vec_id) WHERE part = 'fit' GROUP BY mode, c, pos),
w{k + 1} AS MATERIALIZED (
  SELECT mode, c, pos, new AS w, new + {ahead} * (new - w) AS y FROM (
    SELECT mode, c, pos, w, y - step * (g / n + CASE WHEN pos > 0 THEN {reg} * y ELSE 0 END) AS new
    FROM w{k} JOIN g{k} USING (mode, c, pos) JOIN sizes USING (mode)))"""
    return sql + f""",
scored AS (
  SELECT mode, vec_id, c, t, z FROM (
    SELECT mode, vec_id, c, sum(v * w) AS z FROM x JOIN w{passes} USING (mode, pos) WHERE part = 'val' GROUP BY mode, vec_id, c)
  JOIN truths USING (vec_id, c))"""


# the 80/20 split of the vectors; few is the order of the training rows
HELD_OUT = f"""held AS (
  SELECT vec_id, label, r, n - ceil(0.2 * n) AS train FROM (
    SELECT vec_id, label, row_number() OVER (ORDER BY {hash_order('vec_id')}) AS r, count(*) OVER () AS n FROM embeddings))"""
PROBE = f"""{ENTRIES}, {HELD_OUT},
parts AS (SELECT vec_id, CASE WHEN r <= train THEN 'fit' ELSE 'val' END AS part FROM held),
truths AS (SELECT vec_id, CAST(c AS INTEGER) AS c, CASE WHEN label = c THEN 1 ELSE 0 END AS t FROM embeddings, range(10) r(c)),
{probe_sql('softmax')}"""
FEW_SHOT = f"""{ENTRIES}, {HELD_OUT},
parts AS (SELECT vec_id, CASE WHEN r <= round_even(0.05 * train, 0) THEN 'fit' WHEN r > train THEN 'val' END AS part FROM held),
truths AS (
  SELECT vec_id, CAST(c AS INTEGER) AS c, CASE WHEN label = c OR vec_id % 10 = c THEN 1 ELSE 0 END AS t FROM embeddings, range(10) r(c)),
{probe_sql('sigmoid')},
predicted AS (SELECT *, CASE WHEN 1 / (1 + exp(-z)) > 0.3 THEN 1 ELSE 0 END AS p FROM scored)"""
