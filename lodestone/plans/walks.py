"""Queries of as-of joins, walks through ordered groups, nested tags, and states that logs of changes lead to."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.operators import ordered, paths, tags
from lodestone.sources.artifacts import shared_dir
from lodestone.sources.tables import table
from lodestone.streaming import turn_index

NAMES = ("nav", "ul", "li", "article", "div", "p", "b", "br")
SPACING = 6 * 3600 * 1_000_000


def event_asof(s, d):
    """Every event with the value that its user's last purchase had by then: the state as of each point of a log."""
    events = table(s, d, "events")
    bought = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"), "value")
    found = ordered.as_of(events.select("event_id", "user_id", "ts"), bought, "user_id", "ts", ("purchase_id",))
    return found.select("event_id", "user_id", F.col("found.purchase_id").alias("purchase_id"), F.col("found.value").alias("value"))


def embed_batches(s, d):
    """The batches in which the documents of each source go to an embedding: 64 texts and 6000 tokens (a quarter of the characters) at most."""
    sized = table(s, d, "documents").select("source", "doc_id", F.floor(F.col("n_chars") / 4).alias("size"))
    return ordered.greedy_batches(sized, "source", ["doc_id"], "size")


def event_spacing(s, d):
    """Events of a user and type that a cache of six hours lets through: one goes if the last that stayed is younger."""
    events = table(s, d, "events").select("event_id", F.concat_ws("|", F.col("user_id").cast("string"), "event_type").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return ordered.spaced(events, "key", "at", ["event_id"], SPACING).select("event_id", "key")


def page_blocks(s, d):
    """The outermost blocks of each of some tags in every page; paragraphs are left open here and there."""
    pages = table(s, d, "pages")
    found = tags.blocks(pages, "page_id", "html", NAMES).join(pages, "page_id")
    inner = F.expr("substring(html, inner_start + 1, inner_stop - inner_start)")
    return found.select("page_id", "name", "start", "stop", "single", F.md5(inner).alias("digest"))


def path_state(s, d):
    """Files and folders that exist after a log in which users write, remove and clear away the pages of their numbers."""
    where = F.rtrim(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1), F.lit("/"))
    pages = table(s, d, "pages").select(F.col("page_id").alias("user_id"), where.alias("page"))
    kind = F.col("event_type")
    op = F.when(kind == "error", paths.REMOVE).when(kind == "view", paths.CLEAR).when(kind == "signup", paths.MAKE).otherwise(paths.WRITE)
    folder = F.regexp_extract("page", "^([^/]*/[^/]*)", 1)
    path = F.when(kind.isin("signup", "view"), folder).when(kind == "click", F.concat("page", F.lit("/notes/"), F.floor("value").cast("string"))).otherwise(F.col("page"))
    log = table(s, d, "events").join(pages, "user_id").select(F.col("event_id").alias("seq"), op.alias("op"), path.alias("path"))
    return paths.state(log)


def turn_index_batches(s, d):
    """Conversations that reach an index in batches: first with questions cut short, then all of them in full, that batch
    twice, then without their last turns, and at last with these again."""
    root = f"{shared_dir(s)}/turns-{uuid.uuid4().hex}"
    talk = table(s, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), "role", F.col("text").alias("content"))
    short = talk.withColumn("content", F.when(F.col("role") == "user", F.substring("content", 1, 200)).otherwise(F.col("content")))
    cuts = talk.groupBy("session").agg(F.max("pos").alias("pos")).where("pos >= 4").select("session", "pos", F.lit(turn_index.CUT).alias("role"), F.lit("").alias("content"))
    for number, batch in ((0, short.where("pos < 4")), (1, talk), (1, talk), (2, cuts), (3, talk.where("pos >= 3"))):
        turn_index.index_batch(batch, number, root)
    found = turn_index.current(s, root)
    return found.select(F.col("session").alias("conv_id"), "turn_no", F.md5("user_text").alias("u"), F.md5("assistant_text").alias("a"))


QUERIES = {f.__name__: f for f in (event_asof, embed_batches, event_spacing, page_blocks, path_state, turn_index_batches)}
_TAG = tags._pattern(NAMES)
ORACLES = {
    "event_asof": """WITH b AS (SELECT user_id, ts, max(event_id) AS purchase_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
SELECT e.event_id, e.user_id, p.event_id AS purchase_id, p.value FROM events e ASOF LEFT JOIN b ON e.user_id = b.user_id AND e.ts >= b.ts LEFT JOIN events p ON p.event_id = b.purchase_id""",
    "embed_batches": """WITH RECURSIVE o AS MATERIALIZED (SELECT source, doc_id, n_chars // 4 AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM documents),
f AS (SELECT *, 0::BIGINT AS batch, 1 AS items, size AS total FROM o WHERE nth = 1
  UNION ALL SELECT o.source, o.doc_id, o.size, o.nth, f.batch + (f.items >= 64 OR f.total + o.size > 6000)::BIGINT,
    CASE WHEN f.items >= 64 OR f.total + o.size > 6000 THEN 1 ELSE f.items + 1 END, CASE WHEN f.items >= 64 OR f.total + o.size > 6000 THEN o.size ELSE f.total + o.size END
  FROM f JOIN o ON o.source = f.source AND o.nth = f.nth + 1)
SELECT source, doc_id, size, batch FROM f""",
    "event_spacing": f"""WITH RECURSIVE e AS MATERIALIZED (SELECT event_id, user_id || '|' || event_type AS key, epoch_us(ts) AS at_ FROM events),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_, event_id) AS nth FROM e),
f AS (SELECT key, at_, nth FROM n WHERE nth = 1
  UNION ALL SELECT f.key, min(n.at_), min(n.nth) FROM f JOIN n ON n.key = f.key AND n.at_ >= f.at_ + {SPACING} GROUP BY f.key, f.nth)
SELECT n.event_id, n.key FROM n JOIN f ON f.key = n.key AND f.nth = n.nth""",
    "page_blocks": rf"""WITH c AS (SELECT page_id, html, string_split_regex(html, '{_TAG}') AS gaps, regexp_extract_all(html, '{_TAG}') AS tags FROM pages WHERE contains(html, '<')),
t AS (SELECT page_id, generate_subscripts(tags, 1) AS i, unnest(tags) AS tag, unnest(list_slice(gaps, 1, len(tags))) AS gap FROM c),
p AS (SELECT page_id, i, tag, sum(length(gap) + length(tag)) OVER (PARTITION BY page_id ORDER BY i) AS stop, regexp_extract(tag, '^</?(\w+)', 1) AS name,
  CASE WHEN tag LIKE '</%' THEN -1 WHEN tag LIKE '%/>' THEN 0 ELSE 1 END AS step FROM t),
a AS (SELECT *, sum(step) OVER (PARTITION BY page_id, name ORDER BY i) AS s FROM p),
d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY page_id, name ORDER BY i)) AS depth FROM a),
e AS (SELECT *, lag(depth, 1, 0) OVER (PARTITION BY page_id, name ORDER BY i) AS was FROM d),
n AS (SELECT *, sum((step = 1 AND depth = 1)::INT) OVER (PARTITION BY page_id, name ORDER BY i) AS nth FROM e),
b AS (SELECT page_id, name, min(CASE WHEN step = 1 AND depth = 1 THEN stop - length(tag) END) AS start, max(CASE WHEN step = -1 AND depth = 0 AND was = 1 THEN stop END) AS stop,
  min(CASE WHEN step = 1 AND depth = 1 THEN stop END) AS x, max(CASE WHEN step = -1 AND depth = 0 AND was = 1 THEN stop - length(tag) END) AS y FROM n GROUP BY page_id, name, nth)
SELECT page_id, name, start::BIGINT AS start, stop::BIGINT AS stop, false AS single, md5(html[x + 1 : y]) AS digest FROM b JOIN pages USING (page_id) WHERE start IS NOT NULL AND stop IS NOT NULL
UNION ALL SELECT page_id, name, (stop - length(tag))::BIGINT, stop::BIGINT, true, NULL FROM p WHERE step = 0""",
    "path_state": """WITH u AS (SELECT page_id, rtrim(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/') AS page FROM pages),
g AS (SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'remove' WHEN 'view' THEN 'clear' WHEN 'signup' THEN 'make' ELSE 'write' END AS op,
  CASE WHEN event_type IN ('signup', 'view') THEN regexp_extract(page, '^([^/]*/[^/]*)', 1) WHEN event_type = 'click' THEN page || '/notes/' || floor(value)::BIGINT ELSE page END AS path
  FROM events JOIN u ON page_id = user_id),
h AS (SELECT *, string_split(path, '/') AS x FROM g WHERE path <> ''),
m AS (SELECT seq, CASE op WHEN 'write' THEN 'file' ELSE 'folder' END AS kind, path FROM h WHERE op IN ('write', 'make')
  UNION ALL SELECT seq, 'folder', array_to_string(list_slice(x, 1, n), '/') FROM (SELECT seq, x, unnest(range(1, len(x))) AS n FROM h WHERE op IN ('write', 'make'))),
l AS (SELECT kind, path, max(seq) AS since FROM m GROUP BY kind, path)
SELECT kind, path, since FROM l WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.seq > l.since AND (h.op = 'remove' AND l.kind = 'file' AND h.path = l.path
  OR h.op = 'clear' AND (starts_with(l.path, h.path || '/') OR l.kind = 'folder' AND l.path = h.path)))""",
    "turn_index_batches": """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS turn_no, md5(u) AS u, md5(text) AS a
FROM (SELECT *, lag(role) OVER w AS r, lag(text) OVER w AS u FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'assistant' AND r = 'user'""",
}
