"""Queries whose result has been written in versions, commits or logs before: what is read back is what they promise."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions import text as fn
from lodestone.operators import calls, manifests, ml, turns
from lodestone.sources import sessions, turnlog
from lodestone.sources.artifacts import shared_dir
from lodestone.sources.tables import table

TOOLS = ["bash", "view_lines"]


def _root(s, name):
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def restored_turns(s, d):
    """Pages as files of three turns: their heads, all of them in full, and without English ones; restored to the second."""
    root = _root(s, "restored")
    pages = table(s, d, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"), "url")
    states = (pages.withColumn("content", F.substring("content", 1, 100)), pages, pages.where(~F.contains("url", F.lit("/en/"))))
    for turn, files in enumerate(states, 1):
        entry = s.createDataFrame([(f"turn {turn}",)], "prompt string")
        said = s.createDataFrame([(2 * turn - 2, "user", "again"), (2 * turn - 1, "assistant", "done")], "pos int, role string, content string")
        turnlog.commit_turn(s, root, turn, entry, files.select("path", "content"), said, keep=3)
    turnlog.restore_turn(s, root, 2)
    log = turnlog.Log(s, root)
    return turnlog.files_at(log, log.last()[1]).select("path", "size", "digest")


def saved_versions(s, d):
    """The documents' digests saved as they are, once more without a change, and with toxic ones marked: the last version."""
    root = _root(s, "versions")
    rows = table(s, d, "documents").select("doc_id", F.md5("text").alias("digest"))
    toxic = table(s, d, "labels").select("doc_id", F.col("toxic"))
    written = [sessions.save(rows, root), sessions.save(rows, root), sessions.save(rows.join(toxic, "doc_id", "left").withColumn("digest", F.when(F.col("toxic") == 1, "toxic").otherwise(F.col("digest"))).drop("toxic"), root)]
    last = len([w for w in written if w])
    return sessions.latest(s, root).select("doc_id", "digest", F.lit(last).alias("version"))


def recovered_turns(s, d):
    """Turns of conversations after a cut at the second one that was not saved: the log of the cut brings the others back."""
    root = _root(s, "cut")
    ledger = turns.pairs(table(s, d, "conversations"), "conv_id", "turn").select("conv_id", "turn_no", F.md5("user_text").alias("digest"))
    left = sessions.cut(ledger, root, "turn_no", 2)
    return sessions.recovered(left, root, ["conv_id", "turn_no"])


def committed_chunks(s, d):
    """Chunks of an index after labelled documents were built again: of toxic ones a chunk failed, so they are left out until they succeed."""
    docs = table(s, d, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("id"), "n_chars")
    old = docs.select(F.col("doc_id").alias("file"), "id", F.lit("old").alias("state"), F.array(F.col("n_chars").cast("double")).alias("vector"))
    again = docs.join(table(s, d, "labels"), "doc_id").withColumn("failed", (F.col("toxic") == 1) & (F.col("id") == 1))
    vector = F.when(~F.col("failed"), F.array((F.col("n_chars") + 1).cast("double")))
    new = again.select(F.col("doc_id").alias("file"), "id", F.lit("new").alias("state"), vector.alias("vector"), F.lit(False).alias("oversize"))
    return manifests.index_commit(old, new, "file").select("file", "id", "state", F.col("vector")[0].alias("first"))


def call_union(s, d):
    """Calls that a log tags (clicks), and native ones (all events) that no tagged call of the same user equals, the first of equal ones."""
    events = table(s, d, "events")
    args = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"))
    told = events.select("user_id", F.col("event_id").alias("pos"), F.lit("view").alias("fn"), args.alias("args"))
    tagged = told.join(events.where("event_type = 'click'").select(F.col("event_id").alias("pos")), "pos", "left_semi").select(*told.columns)
    found = calls.union_calls(tagged, told, "user_id")
    return found.select("user_id", "pos", "fn", F.try_element_at("args", F.lit("k")).alias("k"))


def auto_labels(s, d):
    """Labels of answers that events stand for: own calls, foreign ones, supported ones, echoes, mere mentions, and none of a tool."""
    kind = F.col("event_type")
    said = (
        F.when(kind == "click", F.concat(F.lit("<bash>ls "), F.col("value").cast("string"), F.lit("</bash>"))).when(kind == "view", F.lit('<tool_call>{"name": "bash"}</tool_call>'))
        .when(kind == "error", F.lit("[SYSTEM: bash result] done")).when(kind == "signup", F.lit("<|tool_call_begin|> functions.bash:0 <|tool_call_argument_begin|>"))
        .when(F.col("value") > 20, F.lit("I would use bash")).otherwise(F.lit("no tool at all"))
    )
    return table(s, d, "events").select("event_id", ml.auto_label(said, TOOLS).alias("label"))


def oversampled_labels(s, d):
    """Labelled documents with every toxic one eight times more, counted."""
    rows = table(s, d, "labels").select("doc_id", "quality", "toxic")
    return ml.oversampled(rows, rows.where("toxic = 1")).groupBy("quality", "toxic").agg(F.count("*").alias("n"))


def cleaned_pages(s, d):
    """Pages with line ends for closed blocks, blanks at line ends off, and runs of empty lines shortened."""
    text = F.regexp_replace(F.regexp_replace("html", "</(?:p|li|h1|ul)>", " \n\n"), "<br/?>", "\t\n")
    return table(s, d, "pages").select("page_id", F.md5(fn.clean_page(text)).alias("digest"))


def noise_free_pages(s, d):
    """Pages whose navigation, lists and footers are written as the furniture that a reader would not want."""
    said = F.regexp_replace(F.regexp_replace("html", "<nav>", "\n[Skip to CONTENT](#x) "), "<footer>", "\nCopyright © ")
    said = F.regexp_replace(F.regexp_replace(said, "<ul>", "[Follow us on x](y) "), "</(?:p|li|ul)>", " \t\n\n\n")
    return table(s, d, "pages").select("page_id", F.md5(fn.without_noise(said)).alias("digest"))


def page_places(s, d):
    """Types and places of pages as a viewer would name them."""
    path = F.regexp_replace("url", "^[a-z]+://[^/]*", "/site")
    placed = rules.moved(path, {"/site/en": "/home/docs", "/site": "/srv/pages"})
    return table(s, d, "pages").select("page_id", placed.alias("place"), rules.image_type(F.regexp_replace("url", r"\.html", ".PNG")).alias("kind"))


QUERIES = {f.__name__: f for f in (restored_turns, saved_versions, recovered_turns, committed_chunks, call_union, auto_labels, oversampled_labels, cleaned_pages, noise_free_pages, page_places)}
ORACLES = {
    "restored_turns": "SELECT 'pages/' || page_id || '.html' AS path, octet_length(encode(html))::BIGINT AS size, sha256(html) AS digest FROM pages",
    "saved_versions": "SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE md5(text) END AS digest, 2 AS version FROM documents LEFT JOIN labels USING (doc_id)",
    "recovered_turns": """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS turn_no, md5(u) AS digest
FROM (SELECT *, lag(role) OVER w AS r, lag(text) OVER w AS u FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'assistant' AND r = 'user'""",
    "committed_chunks": """SELECT doc_id AS file, id::INT AS id, CASE WHEN toxic IS NULL THEN 'old' ELSE 'new' END AS state, n_chars + CASE WHEN toxic IS NULL THEN 0.0 ELSE 1.0 END AS first
FROM documents LEFT JOIN labels USING (doc_id), (VALUES (0), (1)) AS v(id) WHERE coalesce(toxic, 0) = 0""",
    "call_union": """WITH c AS (SELECT user_id, event_id AS pos, event_type, json_extract_string(props, '$.k') AS k FROM events)
SELECT user_id, pos, 'view' AS fn, k FROM c WHERE event_type = 'click'
UNION ALL SELECT user_id, min(pos), 'view', k FROM c WHERE NOT EXISTS (SELECT 1 FROM c t WHERE t.event_type = 'click' AND t.user_id = c.user_id AND t.k IS NOT DISTINCT FROM c.k) GROUP BY user_id, k""",
    "auto_labels": """SELECT event_id, CASE event_type WHEN 'click' THEN 'own' WHEN 'view' THEN 'foreign' WHEN 'error' THEN 'own' WHEN 'signup' THEN 'excluded'
  ELSE CASE WHEN value > 20 THEN 'review' END END AS label FROM events""",
    "oversampled_labels": "SELECT quality, toxic, count(*) * CASE WHEN toxic = 1 THEN 9 ELSE 1 END AS n FROM labels GROUP BY quality, toxic",
    "cleaned_pages": r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '</(?:p|li|h1|ul)>', ' ' || chr(10) || chr(10), 'g'), '<br/?>', chr(9) || chr(10), 'g'),
  '(?m)[ \t]+$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'))) AS digest FROM pages""",
    "noise_free_pages": r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<nav>', chr(10) || '[Skip to CONTENT](#x) ', 'g'),
  '<footer>', chr(10) || 'Copyright © ', 'g'), '<ul>', '[Follow us on x](y) ', 'g'), '</(?:p|li|ul)>', ' ' || chr(9) || chr(10) || chr(10) || chr(10), 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?im)\[Skip to content\].*?(\n|$)', '', 'g'), '(?im)\[Follow.*?on.*?\]\(.*?\)', '', 'g'), '(?im)Copyright ©.*?(\n|$)', '', 'g') AS t FROM a)
SELECT page_id, md5(trim(regexp_replace(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), '(?m)[ \t]+$', '', 'g'), ' ' || chr(9) || chr(10))) AS digest FROM b""",
    "page_places": r"""WITH p AS (SELECT page_id, url, regexp_replace(url, '^[a-z]+://[^/]*', '/site') AS path, regexp_replace(regexp_replace(url, '\.html', '.PNG'), '[?#].*$', '') AS bare FROM pages)
SELECT page_id, CASE WHEN starts_with(path, '/site/en/') THEN '/home/docs/' || path[10:] WHEN path = '/site/en' THEN '/home/docs' ELSE '/srv/pages/' || ltrim(path[7:], '/') END AS place,
  CASE WHEN ends_with(bare, '.PNG') THEN 'image/png' ELSE 'image/jpeg' END AS kind FROM p""",
}
