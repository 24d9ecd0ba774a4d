"""Queries of document ingest, turn states, file rules and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions import text as fn
from lodestone.operators import history, ingest, ml, states, turns
from lodestone.plans import corpus, logs, models
from lodestone.sources.tables import spread, table


def _pairs(s, d):
    return turns.pairs(table(s, d, "conversations"), "conv_id", "turn").select("conv_id", "turn_no")


def _files(s, d):
    """Every document as a file in the folder of its source, named by its language."""
    mark = F.when(F.col("lang") == "fr", "tile_").when(F.col("lang") == "de", "build/").when(F.col("lang") == "es", "x_backup/").otherwise("")
    path = F.concat(F.col("source"), F.lit("/"), mark, F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(s, d, "documents").select("doc_id", "source", path.alias("path"), F.col("n_chars").alias("size"))


def turn_timeline(s, d):
    return states.timeline(_pairs(s, d), states.pruned(_pairs(s, d), "turn_no", "conv_id", 2), ["conv_id", "turn_no"])


def archive_orphans(s, d):
    """Archives of all turns that a ledger set back to turn 2 leaves behind."""
    ledger = states.back_to(_pairs(s, d), _pairs(s, d), "turn_no", 2)
    return states.orphans(_pairs(s, d), ledger, "conv_id", "turn_no").select("conv_id", "turn_no")


def archive_sizes(s, d):
    return states.archive_sizes(_files(s, d), "source")


def uploads_status(s, d):
    return states.listing(_files(s, d), table(s, d, "labels"), "doc_id")


def recent_events(s, d):
    return states.recent(table(s, d, "events"), F.col("ts"), "event_id").select("event_id", "event_type")


def event_ages(s, d):
    events = table(s, d, "events")
    last = events.agg(F.max("ts").alias("last"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    seconds = (micros("last") - micros("ts")) / 1_000_000
    return events.crossJoin(F.broadcast(last)).groupBy(rules.age(seconds).alias("age")).agg(F.count("*").alias("n"))


def previews(s, d):
    return table(s, d, "documents").select("doc_id", rules.preview(F.col("text")).alias("preview"))


def extraction_saving(s, d):
    text = F.col("text")
    return table(s, d, "documents").select("doc_id", F.round(rules.saving(F.length(text), F.length(fn.smart_truncate(text, 1000, 300))), 6).alias("saving"))


def message_tokens(s, d):
    """Token totals of conversations, a word counted as a token."""
    n = lambda c: F.regexp_count(c, F.lit("[^ \n]+"))
    return table(s, d, "conversations").groupBy("conv_id").agg(F.sum(rules.token_total(n("text"), n("role"), F.lit(0))).alias("tokens"), F.count("*").alias("messages"))


def orders_in_years(s, d):
    rows = table(s, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year"))
    return rows.where(rules.in_years(F.col("year"), "1996-1998")).groupBy("year").agg(F.count("*").alias("n"))


def ingest_plan(s, d):
    docs = corpus.docs(s, d)
    return ingest.plan(docs, corpus._registry(s, d), "doc_id", "text").select("doc_id", "action")


def doc_search(s, d):
    """The best chunks for every document whose id 50 divides."""
    docs = spread(models._spaced(s, d).select("doc_id", "text"))
    queries = docs.where(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("query_id"), ingest.hashed_words(F.col("text")).alias("vector"))
    return ingest.search(ingest.embedded_chunks(docs, "doc_id", "text"), queries, "doc_id")


def history_search(s, d):
    """The best turns of all conversations for every benchmark item; Spanish questions have no vectors and are found by words."""
    pairs = turns.pairs(table(s, d, "conversations"), "conv_id", "turn").select("conv_id", "turn_no", "user_text", "assistant_text")
    spanish = F.contains("user_text", F.lit(" el ")) | F.contains("user_text", F.lit(" los "))
    rows = pairs.withColumn("vector", ingest.hashed_words(F.when(~spanish, F.concat_ws(" ", "user_text", "assistant_text"))))
    queries = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", ingest.hashed_words(F.col("text")).alias("vector"))
    rounded = lambda query, passage: F.round(history.shared_words(query, passage), 6)
    return history.search(rows, queries, ["conv_id", "turn_no"], rounded)


def label_report(s, d):
    pred = corpus.docs(s, d).select("doc_id", (fn.occurrences(F.col("text"), "&&&") == 0).cast("int").alias("pred"))
    return ml.report(table(s, d, "labels").select("doc_id", F.col("quality").alias("label")).join(pred, "doc_id"))


QUERIES = {f.__name__: f for f in (turn_timeline, archive_orphans, archive_sizes, uploads_status, recent_events, event_ages, previews, extraction_saving, message_tokens, orders_in_years, ingest_plan, doc_search, history_search, label_report)}

_FILES = """f AS (SELECT doc_id, source, n_chars AS size, coalesce(lang, '') IN ('fr', 'de', 'es') AS out FROM documents)"""
_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_CHUNKS = models.ORACLES["paragraph_chunks"].replace("md5(text) AS digest", "text")


def _vector(text: str) -> str:
    return f"""(SELECT CASE WHEN len(x) > 0 THEN list_transform(string_split('0 1 2 3 4 5 6 7 8 9 a b c d e f', ' '), lambda h: len(list_filter(x, lambda y: y = h))::DOUBLE) END
  FROM (SELECT list_transform(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: left(md5(w), 1)) AS x))"""


ORACLES = {
    "turn_timeline": f"WITH {logs._PAIRS} SELECT conv_id, turn_no, turn_no > max(turn_no) OVER (PARTITION BY conv_id) - 2 AS archived FROM p",
    "archive_orphans": f"WITH {logs._PAIRS} SELECT conv_id, turn_no FROM p WHERE turn_no > 2",
    "archive_sizes": f"WITH {_FILES} SELECT source, count(*) AS files, round(sum(size) / (1024 * 1024), 6) AS mb FROM f WHERE NOT out GROUP BY source",
    "uploads_status": "SELECT doc_id, n_chars // 1024 AS kb, CASE WHEN n_chars < 1024 THEN n_chars || 'B' ELSE printf('%.1f', n_chars / 1024.0) || 'KB' END AS size_text, doc_id IN (SELECT doc_id FROM labels) AS ingested FROM documents",
    "recent_events": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 5",
    "event_ages": """WITH a AS (SELECT (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 1000000 AS s FROM events)
SELECT CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN floor(s / 60)::BIGINT || 'm ago' WHEN s < 86400 THEN floor(s / 3600)::BIGINT || 'h ago'
  ELSE floor(s / 86400)::BIGINT || 'd ago' END AS age, count(*) AS n FROM a GROUP BY age""",
    "previews": f"""SELECT doc_id, CASE WHEN text IS NOT NULL THEN left(coalesce(array_to_string(list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {_TRIM})),
  lambda x: x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '\"\"\"')), 1, 3), ' | '), ''), 200) END AS preview FROM documents""",
    "extraction_saving": f"""WITH t AS (SELECT doc_id, length(text) // 4 AS old, (CASE WHEN length(text) <= 1000 THEN length(text)
  ELSE length(left(text, 300) || chr(10) || '... [' || (length(text) - 1000) || ' characters omitted] ...' || chr(10) || right(text, 700)) END) // 4 AS new FROM documents)
SELECT doc_id, round(CASE WHEN old > 0 THEN (old - new) / old * 100 ELSE 0 END, 6) AS saving FROM t""",
    "message_tokens": """SELECT conv_id, sum(4 + len(regexp_extract_all(role, '[^ \\n]+')) + floor(len(regexp_extract_all(text, '[^ \\n]+')) * 1.05::DOUBLE))::BIGINT AS tokens, count(*) AS messages
FROM conversations GROUP BY conv_id""",
    "orders_in_years": "SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY ALL",
    "ingest_plan": f"""SELECT coalesce(d.doc_id, r.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'remove' WHEN d.digest = r.digest THEN 'skip'
  WHEN NOT coalesce(trim(text, {_TRIM}) <> '' AND NOT starts_with(trim(text, {_TRIM}), '[OCR ERROR'), false) THEN 'reject' ELSE 'build' END AS action
FROM (SELECT doc_id, text, md5(text) AS digest FROM documents) d FULL JOIN ({corpus._REGISTRY}) r ON r.doc_id = d.doc_id""",
    "doc_search": f"""WITH c AS MATERIALIZED (SELECT doc_id || ':' || id AS chunk, {_vector('text')} AS v FROM ({_CHUNKS})),
q AS MATERIALIZED (SELECT doc_id AS query_id, {_vector("replace(text, chr(10), chr(10) || chr(10))")} AS v FROM documents WHERE doc_id % 50 = 0),
s AS (SELECT query_id, chunk, round(list_dot_product(q.v, c.v) / ((sqrt(list_dot_product(q.v, q.v)) + 1e-10) * (sqrt(list_dot_product(c.v, c.v)) + 1e-10)), 6) AS score FROM q, c)
SELECT query_id, chunk, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk)::INT AS rank FROM s WHERE score >= 0.15 QUALIFY rank <= 5""",
    "label_report": """WITH x AS (SELECT quality AS label, (NOT contains(text, '&&&'))::INT AS pred FROM labels JOIN documents USING (doc_id)),
c AS (SELECT l.label, (SELECT count(*) FROM x WHERE x.label = l.label) AS rows, (SELECT count(*) FROM x WHERE x.pred = l.label) AS told,
  (SELECT count(*) FROM x WHERE x.label = l.label AND x.pred = l.label) AS hit FROM (SELECT DISTINCT label FROM x) l),
r AS (SELECT label, rows, CASE WHEN told > 0 THEN hit / told ELSE 0 END AS p, CASE WHEN rows > 0 THEN hit / rows ELSE 0 END AS r FROM c)
SELECT label, rows, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM r""",
    "history_search": f"""WITH p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS turn_no, u AS user_text, text AS assistant_text
  FROM (SELECT *, lag(role) OVER w AS r, lag(text) OVER w AS u FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND r = 'user'),
t AS MATERIALIZED (SELECT *, conv_id || ':' || turn_no AS hit, CASE WHEN NOT (contains(user_text, ' el ') OR contains(user_text, ' los ')) THEN {_vector("user_text || ' ' || assistant_text")} END AS v FROM p),
q AS MATERIALIZED (SELECT item_id AS query_id, lower(text) AS text, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS words, {_vector('text')} AS v FROM benchmark),
s AS MATERIALIZED (SELECT query_id, words, conv_id, turn_no, hit, user_text, assistant_text, CASE WHEN q.v IS NULL OR t.v IS NULL THEN 'words' ELSE 'vectors' END AS method,
  round(CASE WHEN q.v IS NULL OR t.v IS NULL THEN len(list_filter(words, lambda w: length(w) > 2 AND contains(lower(user_text || ' ' || assistant_text), w))) / (len(words) + 1)
    ELSE list_dot_product(q.v, t.v) / ((sqrt(list_dot_product(q.v, q.v)) + 1e-10) * (sqrt(list_dot_product(t.v, t.v)) + 1e-10)) END, 6) AS score FROM q, t),
b AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, hit) <= 15),
r AS (SELECT *, round(len(list_filter(words, lambda w: length(w) > 2 AND contains(lower('USER: ' || left(user_text, 800) || chr(10) || 'ASSISTANT: ' || left(assistant_text, 800)), w))) / (len(words) + 1), 6) AS again FROM b)
SELECT query_id, conv_id, turn_no, score, method, row_number() OVER (PARTITION BY query_id ORDER BY again DESC, score DESC, hit)::INT AS rank FROM r QUALIFY rank <= 5""",
}
