"""Queries of joined texts, joins by position, reranking, maps, encodings and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import edits, maps
from lodestone.operators import ordered
from lodestone.sources.tables import table

CONVERSATION_PIECE, SOURCE_PIECE = 4000, 100_000


def conversation_texts(s, d):
    """Every conversation as one text, in pieces."""
    said = table(s, d, "conversations")
    text = F.concat(F.col("role"), F.lit(": "), F.col("text"))
    return ordered.joined_texts(said, "conv_id", ["turn"], text, piece=CONVERSATION_PIECE).select("conv_id", "piece", F.length("text").alias("size"), F.md5("text").alias("digest"))


def source_texts(s, d):
    """The documents of every source behind one another, each under its number."""
    text = F.concat(F.lit("--- Page "), F.col("doc_id").cast("string"), F.lit(" ---\n"), F.col("text"))
    joined = ordered.joined_texts(table(s, d, "documents"), "source", ["doc_id"], text, piece=SOURCE_PIECE)
    return joined.select("source", "piece", F.length("text").alias("size"), F.md5("text").alias("digest"))


def _said(s, d, role, name):
    rows = table(s, d, "conversations").where(F.col("role") == role)
    return ordered.numbered(rows, "conv_id", "turn").select("conv_id", "ordinal", F.col("turn").alias(f"{name}_turn"), F.md5("text").alias(name))


def ordinal_join(s, d):
    return ordered.by_ordinal(_said(s, d, "user", "question"), _said(s, d, "assistant", "answer"), ["conv_id", "ordinal"])


def labelled_blocks(s, d):
    """Every answer with the question at its position, or its own turn as a label."""
    label = F.concat(F.lit("turn "), F.col("answer_turn").cast("string"))
    return ordered.labelled_blocks(_said(s, d, "assistant", "answer"), _said(s, d, "user", "question"), ["conv_id", "ordinal"], "question", label).drop("question_turn")


def rerank_logits(s, d):
    return ordered.reranked(table(s, d, "events").select("event_id", "value"), "value", "event_id", 10)


def props_maps(s, d):
    props = F.from_json("props", "map<string,string>")
    both = maps.merged(props, F.create_map(F.lit("k"), F.lit("0"), F.lit("type"), F.col("event_type")))
    return table(s, d, "events").select(
        "event_id", maps.value_or(props, "k", F.lit("none")).alias("k"), maps.value_or(props, "absent", F.lit("none")).alias("absent"),
        F.array_join(F.array_sort(F.map_keys(both)), ",").alias("keys"), both["k"].alias("merged_k"), F.size(maps.without(both, "k")).alias("left"),
    )


def data_uris(s, d):
    uri = maps.data_uri("text/plain", F.encode("text", "UTF-8"))
    rows = table(s, d, "documents").select("doc_id", "text", uri.alias("uri"))
    same = F.decode(maps.payload(F.col("uri")), "UTF-8") == F.col("text")
    return rows.select("doc_id", F.md5("uri").alias("digest"), maps.media_type(F.col("uri")).alias("media_type"), same.alias("same"))


def exact_edit(s, d):
    edit = edits.edited(F.col("text"), "&&&", "&\n&")
    return table(s, d, "documents").select("doc_id", edit.alias("e")).select("doc_id", "e.status", F.md5("e.text").alias("digest"), "e.replaced", "e.lines")


def occurrence_lines(s, d):
    return edits.occurrence_lines(table(s, d, "documents"), "doc_id", "text", "***")


QUERIES = {f.__name__: f for f in (conversation_texts, source_texts, ordinal_join, labelled_blocks, rerank_logits, props_maps, data_uris, exact_edit, occurrence_lines)}


def _joined(table_: str, group: str, order: str, text: str, piece: int) -> str:
    return f"""WITH t AS (SELECT {group}, {order}, {text} AS x FROM {table_} WHERE text IS NOT NULL),
p AS (SELECT *, ((sum(length(x)) OVER (PARTITION BY {group} ORDER BY {order}) - length(x)) // {piece})::INT AS piece FROM t),
j AS (SELECT {group}, piece, string_agg(x, chr(10) || chr(10) ORDER BY {order}) AS x FROM p GROUP BY ALL)
SELECT {group}, piece, length(x)::INT AS size, md5(x) AS digest FROM j"""


def _turns(role: str, name: str) -> str:
    return f"""(SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS ordinal, turn AS {name}_turn, md5(text) AS {name}
  FROM conversations WHERE role = '{role}')"""


ORACLES = {
    "conversation_texts": _joined("conversations", "conv_id", "turn", "role || ': ' || text", CONVERSATION_PIECE),
    "source_texts": _joined("documents", "source", "doc_id", "'--- Page ' || doc_id || ' ---' || chr(10) || text", SOURCE_PIECE),
    "ordinal_join": f"SELECT * FROM {_turns('user', 'question')} JOIN {_turns('assistant', 'answer')} USING (conv_id, ordinal)",
    "labelled_blocks": f"""SELECT conv_id, ordinal, answer_turn, answer, coalesce(question, 'turn ' || answer_turn) AS question
FROM {_turns('assistant', 'answer')} LEFT JOIN {_turns('user', 'question')} USING (conv_id, ordinal)""",
    "rerank_logits": "SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 10",
    "props_maps": """WITH m AS (SELECT event_id, props, json_keys(props) AS keys FROM events)
SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.absent'), 'none') AS absent,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(keys, []), ['k', 'type']))), ',') AS keys, '0' AS merged_k,
  (len(list_distinct(list_concat(coalesce(keys, []), ['k', 'type']))) - 1)::INT AS left FROM m""",
    "data_uris": """SELECT doc_id, md5('data:text/plain;base64,' || base64(encode(text))) AS digest, CASE WHEN text IS NOT NULL THEN 'text/plain' END AS media_type,
  text = text AS same FROM documents""",
    "exact_edit": """WITH c AS (SELECT doc_id, text, coalesce((length(text) - length(replace(text, '&&&', ''))) // 3, 0) AS n FROM documents)
SELECT doc_id, CASE WHEN n = 0 THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS status,
  md5(CASE WHEN n = 1 THEN replace(text, '&&&', '&' || chr(10) || '&') ELSE text END) AS digest, (n = 1)::INT AS replaced, (n = 1)::INT AS lines FROM c""",
    "occurrence_lines": """WITH p AS (SELECT doc_id, string_split(text, '***') AS x FROM documents), u AS (SELECT doc_id, x, unnest(generate_series(1, len(x) - 1)) AS i FROM p)
SELECT doc_id, (i - 1)::INT AS nth, (1 + len(string_split(array_to_string(list_slice(x, 1, i), ''), chr(10))) - 1)::INT AS line_no FROM u""",
}
