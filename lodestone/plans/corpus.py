"""Queries over ``documents``: search, tokens, ranking, registries, budgets."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions import text as fn
from lodestone.operators import bm25, manifests, ordered, search
from lodestone.sources.artifacts import folder, shared_dir
from lodestone.sources.files import write_partitions
from lodestone.sources.tables import table

QUERY = "the onen thion"
TERMS = ["the", "onen", "erth", "the"]


def docs(s, d):
    return table(s, d, "documents")


def _ranked(df, score, k):
    return df.where("score > 0").orderBy(F.desc(score), "doc_id").limit(k)


def token_counts(s, d):
    return bm25.tokens(docs(s, d), "doc_id", "text").select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"))


def _index(s, d):
    return bm25.current(docs(s, d), "doc_id", "text", "documents")


def bm25_idf(s, d):
    """How many terms stand in n documents, and their idf."""
    return _index(s, d).idf().groupBy("n", F.round("idf", 6).alias("idf")).agg(F.count("*").alias("terms"))


def bm25_topk(s, d):
    return bm25.search(_index(s, d), "doc_id", TERMS, 10)


def bm25_topk_filtered(s, d):
    """Only documents of an id that ends in 7 are ranked: a file pattern before the limit."""
    return bm25.search(_index(s, d), "doc_id", TERMS, 10, only=F.col("doc_id").cast("string").like("%7"))


def bm25_each(s, d):
    """The best documents for the words of every benchmark item."""
    queries = table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), fn.code_tokens(F.col("text")).alias("terms"))
    return bm25.search_each(_index(s, d), "doc_id", queries, 5)


def bm25_followed(s, d):
    """An index of an older state of the documents, brought up to the present: since then French texts have changed,
    German ones are new, and a file is gone."""
    root = f"{shared_dir(s)}/followed-{uuid.uuid4().hex}"
    now = docs(s, d).select("doc_id", "text", F.coalesce("lang", F.lit("none")).alias("part"))
    french = F.col("part") == "fr"
    then = now.where("part != 'de'").withColumn("text", F.when(french, F.concat(F.lit("obsolete words "), "text")).otherwise(F.col("text")))
    gone = now.where("part = 'en'").select((-F.col("doc_id") - 1).alias("doc_id"), F.lit("texts that are gone").alias("text"), F.lit("gone").alias("part"))
    then.unionByName(gone).write.partitionBy("part").parquet(f"{root}/documents")
    bm25.refreshed(s.read.parquet(f"{root}/documents"), "doc_id", "text", f"{root}/index")
    write_partitions(now.where(french | (F.col("part") == "de")), f"{root}/documents", "part")
    folder(s, f"{root}/documents/part=gone").delete()
    return bm25.search(bm25.refreshed(s.read.parquet(f"{root}/documents"), "doc_id", "text", f"{root}/index"), "doc_id", TERMS, 10)


def bm25_doclen(s, d):
    return _index(s, d).stats.select("docs", "tokens", F.round("avgdl", 6).alias("avgdl"))


def keyword_rank(s, d):
    return _ranked(docs(s, d).select("doc_id", F.round(fn.keyword_score(F.col("text"), QUERY), 6).alias("score")), "score", 20)


def keyword_counts(s, d):
    return docs(s, d).select("doc_id", F.size(fn.keywords(F.col("text"))).cast("bigint").alias("n_keywords"))


def grep_lines(s, d):
    return search.grep(docs(s, d), "doc_id", "text", "License")


def grep_first50(s, d):
    return search.grep(docs(s, d), "doc_id", "text", "the").orderBy("doc_id", "line_no").limit(50)


def grep_regex(s, d):
    return search.grep_regex(docs(s, d), "doc_id", "text", "token = [^ ]+", 2)


def grep_context(s, d):
    return search.with_context(docs(s, d), "doc_id", "text", "license", 1)


def view_window(s, d):
    return docs(s, d).select("doc_id", search.view_window(F.col("text"), 3, 4, 1).alias("view"))


def occurrence_count(s, d):
    return docs(s, d).select("doc_id", fn.occurrences(F.col("text"), "the").alias("n"))


def replace_first_n(s, d):
    return docs(s, d).select("doc_id", F.md5(fn.replace_first(F.col("text"), "the", "THE", 2)).alias("digest"))


def char_to_line(s, d):
    return docs(s, d).select("doc_id", fn.char_to_line(F.col("text"), F.lit(400)).alias("line_no"))


def smart_truncate(s, d):
    return docs(s, d).select("doc_id", F.md5(fn.smart_truncate(F.col("text"), 1000, 300)).alias("digest"))


def fixed_line_split(s, d):
    return search.split_lines(docs(s, d), "doc_id", "text", 3).select("doc_id", "part", "start_line", "end_line", F.length("text").alias("n_chars"))


def content_dedup_md5(s, d):
    return search.first_of_each(docs(s, d), F.md5("text"), "doc_id", ["doc_id", "source"])


def prefix_dedup_100(s, d):
    return search.first_of_each(docs(s, d), F.trim(F.substring("text", 1, 100)), "doc_id", ["doc_id"])


def _registry(s, d):
    """What a registry of the labelled documents holds: all of them, as they were before their labels came."""
    toxic = F.col("toxic") == 1
    rows = docs(s, d).join(table(s, d, "labels"), "doc_id")
    return rows.select("doc_id", F.col("doc_id").cast("double").alias("mtime"), (F.col("n_chars") - F.when(toxic, 1).otherwise(0)).alias("size"), F.md5(F.concat("text", F.when(F.col("quality") == 0, "~").otherwise(""))).alias("digest"))


def _on_disk(s, d):
    """All documents as they are now; a French one is newer than the registry can know."""
    return docs(s, d).select("doc_id", (F.col("doc_id") + F.when(F.col("lang") == "fr", 1.0).otherwise(0.0)).alias("mtime"), F.col("n_chars").alias("size"), F.md5("text").alias("digest"))


def registry_diff(s, d):
    return manifests.registry_diff(_registry(s, d), _on_disk(s, d), "doc_id")


def registry_status_counts(s, d):
    return registry_diff(s, d).groupBy("status").agg(F.count("*").alias("n"))


def manifest_diff(s, d):
    return manifests.manifest_diff(_registry(s, d), _on_disk(s, d), "doc_id", "digest")


def ledger_upsert(s, d):
    """All documents, with the rows of the labels in the place of theirs."""
    base = docs(s, d).select("doc_id", "n_chars")
    return manifests.upsert(base, table(s, d, "labels").select("doc_id", (-F.col("quality") - 10 * F.col("toxic")).cast("bigint").alias("n_chars")), "doc_id")


def budget_take(s, d):
    rows = docs(s, d).select("source", "doc_id", "n_chars")
    return manifests.within_budget(ordered.running_total(rows, "source", ["doc_id"], "n_chars", "upto"), "n_chars", 21000, 200)


def label_confusion(s, d):
    pred = docs(s, d).select("doc_id", (fn.occurrences(F.col("text"), "&&&") > 0).cast("int").alias("pred"))
    return table(s, d, "labels").join(pred, "doc_id").groupBy("quality", "pred").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (token_counts, bm25_idf, bm25_topk, bm25_topk_filtered, bm25_each, bm25_followed, bm25_doclen, keyword_rank, keyword_counts, grep_lines, grep_first50, grep_regex, grep_context, view_window, occurrence_count, replace_first_n, char_to_line, smart_truncate, fixed_line_split, content_dedup_md5, prefix_dedup_100, registry_diff, registry_status_counts, manifest_diff, ledger_upsert, budget_take, label_confusion)}


def _tokens_of(key: str, table_: str) -> str:
    return rf"""(SELECT {key}, list_transform(list_filter(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(text,
  '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '[_.\-/]', ' ', 'g'), '[\p{{L}}\p{{N}}_]+'),
  lambda x: regexp_full_match(x, '[a-zA-Z][a-zA-Z0-9]+')), lambda x: lower(x)) AS tokens FROM {table_})"""


_TOKENS = f"t AS MATERIALIZED {_tokens_of('doc_id', 'documents')}"
_IDF = """f AS MATERIALIZED (SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct(tokens)) AS term FROM t) GROUP BY term),
r AS MATERIALIZED (SELECT term, n, ln(docs - n + 0.5) - ln(n + 0.5) AS raw FROM f, (SELECT count(*) AS docs FROM t)),
i AS (SELECT term, n, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM r, (SELECT avg(raw) AS mean FROM r))"""
_LINES = "l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::INT AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"


_REGISTRY = """SELECT doc_id, doc_id::DOUBLE AS mtime, n_chars - CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS size,
  md5(text || CASE WHEN quality = 0 THEN '~' ELSE '' END) AS digest FROM documents JOIN labels USING (doc_id)"""
_ON_DISK = "SELECT doc_id, doc_id + CASE WHEN lang = 'fr' THEN 1.0 ELSE 0.0 END AS mtime, n_chars AS size, md5(text) AS digest FROM documents"
_DIFF = f"""SELECT coalesce(r.doc_id, d.doc_id) AS doc_id, CASE WHEN r.doc_id IS NULL THEN 'added' WHEN d.doc_id IS NULL THEN 'removed'
  WHEN d.mtime > r.mtime + 0.5 OR d.size <> r.size THEN 'modified' ELSE 'unchanged' END AS status
  FROM ({_REGISTRY}) r FULL JOIN ({_ON_DISK}) d ON r.doc_id = d.doc_id"""
ORACLES = {
    "token_counts": f"WITH {_TOKENS} SELECT doc_id, len(tokens)::BIGINT AS n_tokens FROM t",
    "bm25_idf": f"WITH {_TOKENS}, {_IDF} SELECT n, round(idf, 6) AS idf, count(*) AS terms FROM i GROUP BY ALL",
    **{name: f"""WITH {_TOKENS}, {_IDF}, a AS (SELECT avg(len(tokens)) AS avgdl FROM t),
q AS (SELECT * FROM (VALUES ('the', 2), ('onen', 1), ('erth', 1)) AS v(term, times)),
p AS (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM t), c AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL)
SELECT doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score
FROM c JOIN q USING (term) JOIN i USING (term), a {where} GROUP BY doc_id HAVING score >= 0.01 ORDER BY score DESC, doc_id LIMIT 10""" for name, where in (("bm25_topk", ""), ("bm25_followed", ""), ("bm25_topk_filtered", "WHERE doc_id::VARCHAR LIKE '%7'"))},
    "bm25_each": f"""WITH {_TOKENS}, {_IDF}, a AS (SELECT avg(len(tokens)) AS avgdl FROM t),
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest(tokens) AS term FROM {_tokens_of("item_id", "benchmark")}) GROUP BY ALL),
p AS (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM t), c AS (SELECT doc_id, dl, term, count(*) AS tf FROM p GROUP BY ALL)
SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) DESC, doc_id)::INT AS rank
FROM c JOIN q USING (term) JOIN i USING (term), a GROUP BY query_id, doc_id HAVING score >= 0.01 QUALIFY rank <= 5""",
    "bm25_doclen": f"WITH {_TOKENS} SELECT count(*) AS docs, sum(len(tokens))::BIGINT AS tokens, round(avg(len(tokens)), 6) AS avgdl FROM t",
    "keyword_rank": """SELECT doc_id, round((contains(lower(text), 'the')::INT + contains(lower(text), 'onen')::INT + contains(lower(text), 'thion')::INT) / 4, 6) AS score
FROM documents WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""",
    "keyword_counts": f"""SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{4,}}')),
  lambda x: NOT list_contains(string_split('{" ".join(fn.STOP_WORDS)}', ' '), x)))::BIGINT AS n_keywords FROM documents""",
    "grep_lines": f"WITH {_LINES} SELECT doc_id, line_no, substring(trim(line), 1, 200) AS line FROM l WHERE contains(lower(line), 'license')",
    "grep_first50": f"WITH {_LINES} SELECT doc_id, line_no, substring(trim(line), 1, 200) AS line FROM l WHERE contains(lower(line), 'the') ORDER BY doc_id, line_no LIMIT 50",
    "grep_regex": f"""WITH {_LINES} SELECT doc_id, line_no, line FROM l WHERE regexp_matches(line, 'token = [^ ]+')
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) <= 2""",
    "grep_context": f"""WITH {_LINES} SELECT doc_id, line_no, context FROM (SELECT doc_id, line_no, line,
  string_agg(line, chr(10)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM l)
WHERE contains(lower(line), 'license')""",
    "view_window": "SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 5), chr(10)) AS view FROM documents",
    "occurrence_count": "SELECT doc_id, ((length(text) - length(replace(text, 'the', ''))) // 3)::BIGINT AS n FROM documents",
    "replace_first_n": "SELECT doc_id, md5(regexp_replace(regexp_replace(text, 'the', 'THE'), 'the', 'THE')) AS digest FROM documents",
    "char_to_line": "SELECT doc_id, (length(left(text, 400)) - length(replace(left(text, 400), chr(10), '')) + 1)::BIGINT AS line_no FROM documents",
    "smart_truncate": """SELECT doc_id, md5(CASE WHEN length(text) <= 1000 THEN text ELSE left(text, 300) || chr(10) || '... [' || (length(text) - 1000)
  || ' characters omitted] ...' || chr(10) || right(text, 700) END) AS digest FROM documents""",
    "fixed_line_split": f"""WITH {_LINES} SELECT doc_id, ((line_no - 1) // 3 + 1)::INT AS part, min(line_no) AS start_line, max(line_no) AS end_line,
  length(string_agg(line, chr(10) ORDER BY line_no))::INT AS n_chars FROM l GROUP BY doc_id, (line_no - 1) // 3""",
    "content_dedup_md5": "SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1",
    "prefix_dedup_100": "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY trim(left(text, 100)) ORDER BY doc_id) = 1",
    "registry_diff": _DIFF,
    "registry_status_counts": f"SELECT status, count(*) AS n FROM ({_DIFF}) GROUP BY status",
    "manifest_diff": f"""SELECT r.doc_id, 'delete' AS action FROM ({_REGISTRY}) r ANTI JOIN ({_ON_DISK}) d ON r.doc_id = d.doc_id
UNION ALL SELECT d.doc_id, 'build' FROM ({_ON_DISK}) d LEFT JOIN ({_REGISTRY}) r ON r.doc_id = d.doc_id WHERE d.digest IS DISTINCT FROM r.digest""",
    "ledger_upsert": """SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, -(quality + 10 * toxic)::BIGINT FROM labels""",
    "budget_take": """WITH s AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM documents)
SELECT source, doc_id, n_chars, CASE WHEN upto <= 21000 THEN n_chars ELSE 21000 - (upto - n_chars) END::BIGINT AS taken FROM s
WHERE upto <= 21000 OR 21000 - (upto - n_chars) > 200""",
    "label_confusion": "SELECT quality, contains(text, '&&&')::INT AS pred, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL",
}
