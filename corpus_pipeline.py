"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and reads it back as the next stage's docs.
All stages but the last return the columns of ``documents``, whatever they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, jaccard, language, packing, secrets
from lodestone.llm._shared import discard, fresh_name, row_key, small, table, written

#: Near copies of the pipeline: five-word shingles, a Jaccard similarity of 80/100 or more (op9's own numbers are its contract).
SHINGLE, NUM, DEN = 5, 80, 100
#: Texts of which less than this share of grams is known to any language are rejected.
LEAST_LANGUAGE = 0.2
#: Shorter texts have too few grams to be rejected for that.
LEAST_CHARS = 20


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no known language; the model learns from the rows' own labels.

    Null texts, empty texts and texts without a letter go; rows without an id
    are judged like others; equal rows are judged alike; an empty table stays
    empty. Columns may have any name.
    """
    lang, score = fresh_name(docs, "_lang"), fresh_name(docs, "_score")
    told = language.predict(docs, language.corpus_model(docs), lang_out=lang, score_out=score)
    sure = (F.col(score) >= LEAST_LANGUAGE) | (F.length("text") < LEAST_CHARS)
    return told.where((F.col(lang) != language.UNKNOWN) & sure).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group.

    Rows without an id, null texts and texts without words stay. Rows that
    share an id are one document: its texts stay or go together, and of equal
    rows (id and text) one stays.
    """
    groups = jaccard.linked_components(docs, k=SHINGLE, num=NUM, den=DEN)
    gone = written(groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "gone")
    again = written(docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "again")
    kept = docs.join(small(gone), "doc_id", "left_anti")
    if not again.isEmpty():
        again = small(again)
        kept = kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage.

    Null and empty texts stay, as do all texts where the benchmark is empty;
    rows without an id and equal rows are judged like others. Rows are told by
    128 hash bits of id and text. Columns may have any name.
    """
    key = fresh_name(docs, "_key")
    keyed = docs.withColumn(key, row_key("doc_id", "text"))
    hits = decontaminate.benchmark_hits(keyed, table(spark, sf_dir, "benchmark"), id_col=key)
    gone = written(hits.where("n_hit > 0").select(key).distinct(), "contaminated")
    return keyed.join(small(gone), key, "left_anti").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark; documents stay, with ``n_chars`` of the new text.

    Null texts stay null and empty ones empty; rows without an id and equal rows
    are cleaned like others. Rows are told by 128 hash bits of id and text.
    Columns may have any name.
    """
    key = fresh_name(docs, "_key")
    keyed = docs.withColumn(key, row_key("doc_id", "text"))
    spans = secrets.secret_spans(keyed, id_col=key).where(F.size("spans") > 0).select(key, "spans").dropDuplicates([key])
    clean = secrets.redacted(keyed, small(written(spans, "secrets"), "sum(size(spans))"), id_col=key)
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents; null and empty texts are one end id, and equal rows are packed each."""
    return packing.packed_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if at:
            discard(before)
    return docs


#: Tokenisation and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None
