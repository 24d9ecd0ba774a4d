"""Queries over ``conversations``, ``pages`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import events, manifests, pages, turns
from lodestone.sources.tables import table

QUERY = "une éai que thion"


def _talk(s, d):
    return table(s, d, "conversations")


def _pairs(s, d):
    return turns.pairs(_talk(s, d), "conv_id", "turn")


def turn_pairs(s, d):
    return _pairs(s, d).select("conv_id", "turn_no", "start_line", "end_line", F.md5("user_text").alias("u"), F.md5("assistant_text").alias("a"))


def tail_slice(s, d):
    return turns.tail(_talk(s, d), "conv_id", "turn", 3).select("conv_id", "turn", "role")


def role_filter(s, d):
    return _talk(s, d).where(F.col("role").isin("user", "assistant")).groupBy("role").agg(F.count("*").alias("n"))


def history_rank(s, d):
    return turns.keyword_rank(_pairs(s, d), QUERY, 15, 5, ["conv_id", "turn_no"])


def prefix_valid(s, d):
    # an index of the time when every question had 80 characters at most
    index = _pairs(s, d).withColumn("user_text", F.substring("user_text", 1, 80))
    return turns.valid_prefix(index.select("conv_id", "turn_no", "user_text", "assistant_text"), _pairs(s, d), "conv_id").select("conv_id", "turn_no")


def retention_last_n(s, d):
    return manifests.retained(_pairs(s, d), "turn_no", "conv_id", 2).select("conv_id", "turn_no")


def renumber_after_delete(s, d):
    ledger = _pairs(s, d).select("conv_id", "turn_no", F.when(F.col("turn_no") > 1, F.col("turn_no") - 1).alias("rerun_of"))
    return manifests.renumbered(ledger, "turn_no", "rerun_of", 2)


def docs_pages(s, d):
    """Pages that would be documentation if English ones lay under ``docs``, Spanish ones in a guide, and lists were fenced."""
    url = F.regexp_replace(F.regexp_replace("url", "/en/", "/docs/"), "/es/", "/guide/")
    text = F.replace("html", F.lit("</ul>"), F.lit("```"))
    return table(s, d, "pages").select("page_id", url.alias("url"), text.alias("html")).where(pages.is_documentation(F.col("url"), F.col("html"))).select("page_id", "url")


def url_parts(s, d):
    url = F.col("url")
    return table(s, d, "pages").select("page_id", F.regexp_extract(url, "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract(url, "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract(url, "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"))


def page_headings(s, d):
    return pages.headings(table(s, d, "pages"), "page_id", "html")


def heading_priority(s, d):
    found = page_headings(s, d)
    return found.select("page_id", "pos", pages.section_priority(F.col("heading"), F.length("heading")).alias("priority"))


def event_counts(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def event_signature(s, d):
    return events.signature(table(s, d, "events"), "user_id", "ts")


def ttl_filter(s, d):
    return events.alive(table(s, d, "events"), "ts", "2024-01-20 00:00:00", 7).select("event_id")


def session_windows(s, d):
    return events.sessions(table(s, d, "events"), "user_id", "ts", "30 minutes")


QUERIES = {f.__name__: f for f in (turn_pairs, tail_slice, role_filter, history_rank, prefix_valid, retention_last_n, renumber_after_delete, docs_pages, url_parts, page_headings, heading_priority, event_counts, event_signature, ttl_filter, session_windows)}
QUERIES["history_rank_passages"] = history_rank  # the name that it had beside a rerank by questions alone

_PAIRS = """p AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS turn_no, u AS user_text, text AS assistant_text, start_line, turn + 1 AS end_line
FROM (SELECT *, lag(role) OVER w AS r, lag(text) OVER w AS u, lag(turn) OVER w + 1 AS start_line FROM conversations
  WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND r = 'user')"""


def _score(text: str) -> str:
    return f"round((contains(lower({text}), 'une')::INT + contains(lower({text}), 'éai')::INT + contains(lower({text}), 'que')::INT + contains(lower({text}), 'thion')::INT) / 5, 6)"


_HEADINGS = r"""h AS (SELECT page_id, generate_subscripts(x, 1)::INT AS pos, unnest(x) AS tag FROM (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS x FROM pages)),
g AS (SELECT page_id, pos, regexp_extract(tag, '(?i)<h([1-6])', 1)::INT AS level, trim(regexp_replace(tag, '<[^>]+>', '', 'g')) AS heading FROM h)"""
ORACLES = {
    "turn_pairs": f"WITH {_PAIRS} SELECT conv_id, turn_no, start_line, end_line, md5(user_text) AS u, md5(assistant_text) AS a FROM p",
    "tail_slice": """WITH s AS (SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant')
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)
SELECT conv_id, turn, role FROM s QUALIFY max((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) = 1""",
    "role_filter": "SELECT role, count(*) AS n FROM conversations WHERE role IN ('user', 'assistant') GROUP BY role",
    "history_rank": f"""WITH {_PAIRS}, s AS (SELECT conv_id, turn_no, {_score("user_text || ' ' || assistant_text")} AS score,
{_score("left(user_text, 800) || chr(10) || left(assistant_text, 800)")} AS rerank FROM p)
SELECT * FROM (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, conv_id, turn_no LIMIT 15) ORDER BY rerank DESC, score DESC, conv_id, turn_no LIMIT 5""",
    "prefix_valid": f"""WITH {_PAIRS} SELECT conv_id, turn_no FROM p
QUALIFY coalesce(max(CASE WHEN length(user_text) > 80 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn_no), 0) = 0""",
    "retention_last_n": f"WITH {_PAIRS} SELECT conv_id, turn_no FROM p QUALIFY turn_no > max(turn_no) OVER (PARTITION BY conv_id) - 2",
    "renumber_after_delete": f"""WITH {_PAIRS}, l AS (SELECT conv_id, turn_no, CASE WHEN turn_no > 1 THEN turn_no - 1 END AS rerun_of FROM p)
SELECT conv_id, turn_no - (turn_no > 2)::INT AS turn_no, CASE WHEN rerun_of = 2 THEN NULL ELSE rerun_of - (rerun_of > 2)::INT END AS rerun_of FROM l WHERE turn_no <> 2""",
    "docs_pages": r"""SELECT page_id, url FROM (SELECT page_id, replace(replace(url, '/en/', '/docs/'), '/es/', '/guide/') AS url, replace(html, '</ul>', '```') AS html FROM pages) WHERE regexp_matches(lower(url), '(?:^|[./])docs?\.') OR regexp_matches(lower(url), '/docs?(?:/|$)')
OR regexp_matches(lower(url), 'documentation|/api/|/reference/|/guide/|readme|/tutorial/|/manual/|/sdk/') OR len(regexp_extract_all(left(html, 8000), '```')) >= 4""",
    "url_parts": """SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages""",
    "page_headings": f"WITH {_HEADINGS} SELECT * FROM g",
    "heading_priority": f"""WITH {_HEADINGS} SELECT page_id, pos, greatest(1, 5 - CASE WHEN regexp_matches(lower(heading),
'table of contents|navigation|footer|copyright|license|sidebar|breadcrumb|cookie') THEN 3 ELSE 0 END
+ CASE WHEN length(heading) > 500 THEN 2 WHEN length(heading) < 50 THEN -1 ELSE 0 END)::INT AS priority FROM g""",
    "event_counts": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type",
    "event_signature": "SELECT user_id, max(ts) AS latest, count(*) AS n FROM events GROUP BY user_id",
    "ttl_filter": "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-13 00:00:00'",
    "session_windows": """WITH s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM
(SELECT *, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE)::INT AS new FROM events))
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, coalesce(session, 0)""",
}
ORACLES["history_rank_passages"] = ORACLES["history_rank"]
