"""Chunkers and the classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import chunking, ml
from lodestone.sources.artifacts import few
from lodestone.sources.tables import table


def _spaced(s, d):
    """Documents with every line a paragraph."""
    return table(s, d, "documents").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


def paragraph_chunks(s, d):
    return chunking.paragraph_chunks(_spaced(s, d), "doc_id", "text").select("doc_id", "id", "start", "end", F.md5("text").alias("digest"))


def line_chunks(s, d):
    """Every word a line, every line a block."""
    words = _spaced(s, d).withColumn("text", F.replace("text", F.lit(" "), F.lit("\n")))
    return chunking.line_chunks(words, "doc_id", "text").select("doc_id", "id", "start", "end", F.md5("text").alias("digest"))


def bounded_chunks(s, d):
    """Documents, every word a line, as one chunk each, cut to what an embedding takes."""
    words = table(s, d, "documents").select("doc_id", F.col("source").alias("name"), F.lit(1).alias("start"), F.replace("text", F.lit(" "), F.lit("\n")).alias("text"))
    return chunking.bounded(words).select("doc_id", "name", "start", "end", F.md5("text").alias("digest"), "oversize")


def quality_classifier(s, d):
    labels = table(s, d, "labels").select("doc_id", "quality")
    labelled = table(s, d, "documents").join(few(labels, labels.count()), "doc_id").select("doc_id", "text", F.col("quality").alias("label"))
    return ml.train_and_predict(labelled, "doc_id", "text").select("doc_id", "label", "pred")


QUERIES = {f.__name__: f for f in (paragraph_chunks, line_chunks, bounded_chunks, quality_classifier)}

_WHITE = " || ".join(f"chr({ord(c)})" for c in chunking.WHITE)
ORACLES = {
    "paragraph_chunks": f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(x) AS raw, generate_subscripts(x, 1) AS k FROM
  (SELECT doc_id, string_split(replace(replace(replace(text, chr(10), chr(10) || chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10) || chr(10)) AS x FROM documents)),
o AS (SELECT *, sum(length(raw) + 2) OVER (PARTITION BY doc_id ORDER BY k) - length(raw) - 2 AS at_, sum(length(raw) + 2) OVER (PARTITION BY doc_id) - 2 AS whole FROM r),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i, count(*) OVER (PARTITION BY doc_id) AS parts, trim(raw, {_WHITE}) AS body,
  length(trim(raw, {_WHITE})) AS n, at_ + length(raw) - length(ltrim(raw, {_WHITE})) AS off, whole FROM o WHERE trim(raw, {_WHITE}) <> ''),
s AS (SELECT *, sum(n + 2) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM p),
ext AS (SELECT a.doc_id, a.i AS a, max(j.i) AS e FROM s a JOIN s j ON a.doc_id = j.doc_id AND j.i >= a.i AND j.upto - a.upto + a.n + 2 <= 1600 GROUP BY ALL),
nxt AS (SELECT b.doc_id, b.i AS b, coalesce(min(j.i), b.i + 1) AS a FROM s b LEFT JOIN s j ON b.doc_id = j.doc_id AND j.i BETWEEN b.i - 70 AND b.i
  AND j.n < 1600 AND (j.i = b.i OR b.upto - j.upto < 200) GROUP BY b.doc_id, b.i),
c AS (SELECT s.doc_id, 1 AS k, 1::BIGINT AS a, greatest(1, coalesce(e, 1)) AS b, parts FROM s LEFT JOIN ext ON ext.doc_id = s.doc_id AND ext.a = 1 WHERE i = 1
  UNION ALL SELECT c.doc_id, c.k + 1, nxt.a, greatest(c.b + 1, coalesce(e, 0)), parts FROM c JOIN nxt ON nxt.doc_id = c.doc_id AND nxt.b = c.b
  LEFT JOIN ext ON ext.doc_id = c.doc_id AND ext.a = nxt.a WHERE c.b < parts),
t AS (SELECT c.doc_id, c.k, min(off)::INT AS start, (CASE WHEN c.b = c.parts THEN max(whole) ELSE max(off + n) END)::INT AS "end", string_agg(body, chr(10) || chr(10) ORDER BY i) AS text
  FROM c JOIN s ON s.doc_id = c.doc_id AND s.i BETWEEN c.a AND c.b GROUP BY c.doc_id, c.k, c.b, c.parts)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS id, start, "end", md5(text) AS digest FROM t WHERE length(text) >= 100""",
    "line_chunks": f"""
WITH RECURSIVE r AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS no FROM
  (SELECT doc_id, string_split(replace(replace(text, chr(10), chr(10) || chr(10)), ' ', chr(10)), chr(10)) AS x FROM documents)),
p AS (SELECT doc_id, line, no, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS i FROM r WHERE trim(line, {_WHITE}) <> ''),
b AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS k, min(i) AS a, max(i) AS b, count(*) AS n FROM p GROUP BY doc_id, no - i),
h AS (SELECT doc_id, k, a AS from_, CASE WHEN n > 60 THEN 0 ELSE n END AS held, CAST(NULL AS BIGINT) AS out_a, CAST(NULL AS BIGINT) AS out_b FROM b WHERE k = 1
  UNION ALL SELECT b.doc_id, b.k, CASE WHEN b.n > 60 OR h.held = 0 THEN b.a WHEN h.held + b.n > 60 THEN b.a - least(15, h.held) ELSE h.from_ END,
  CASE WHEN b.n > 60 THEN 0 WHEN h.held + b.n > 60 AND h.held > 0 THEN least(15, h.held) + b.n ELSE h.held + b.n END,
  CASE WHEN h.held > 0 AND h.held + b.n > 60 THEN h.from_ END, CASE WHEN h.held > 0 AND h.held + b.n > 60 THEN h.from_ + h.held - 1 END
  FROM h JOIN b ON b.doc_id = h.doc_id AND b.k = h.k + 1),
last AS (SELECT doc_id, max(k) AS k FROM h GROUP BY doc_id),
c AS (SELECT doc_id, (2 * k - 1) * 10000 AS at_, out_a AS a, out_b AS b FROM h WHERE out_a IS NOT NULL
  UNION ALL SELECT h.doc_id, (2 * h.k + 1) * 10000, from_, from_ + held - 1 FROM h JOIN last USING (doc_id, k) WHERE held > 0
  UNION ALL SELECT doc_id, 2 * k * 10000 + w, a + 45 * w, least(b, a + 45 * w + 59) FROM b, generate_series(0, 1000) AS g(w) WHERE n > 60 AND w <= ceil((n - 60) / 45)),
t AS (SELECT c.doc_id, at_, min(no)::INT AS start, max(no)::INT AS "end", string_agg(line, chr(10) ORDER BY p.i) AS text FROM c JOIN p ON p.doc_id = c.doc_id AND p.i BETWEEN c.a AND c.b GROUP BY c.doc_id, at_, c.a)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY at_) - 1)::INT AS id, start, "end", md5(text) AS digest FROM t WHERE "end" - start >= 2""",
    "bounded_chunks": f"""WITH x AS (SELECT doc_id, source, string_split(replace(text, ' ', chr(10)), chr(10)) AS l FROM documents),
w AS (SELECT *, unnest(range((len(l) + {chunking.MOST_LINES - 1}) // {chunking.MOST_LINES})) AS k FROM x),
c AS (SELECT *, array_to_string(list_slice(l, k * {chunking.MOST_LINES} + 1, (k + 1) * {chunking.MOST_LINES}), chr(10)) AS body FROM w)
SELECT doc_id, source || CASE WHEN len(l) > {chunking.MOST_LINES} THEN ' (part ' || (k + 1) || ')' ELSE '' END AS name, (k * {chunking.MOST_LINES} + 1)::INT AS start,
  least((k + 1) * {chunking.MOST_LINES}, len(l))::INT AS "end", md5(body) AS digest, ceil(length(body) / 4) > {chunking.MOST_TOKENS} AS oversize FROM c""",
}
