"""Searches whose time, memory and disk grow with their tables: what they do in Arrow batches, against plain loops."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import bm25, chunking, history, ingest, ml, vectors


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunks_and_their_vectors_are_no_interpreted_lambdas(spark):
    texts = {1: "One two.\n\nThree é 3, K x2\r\n\r\n" + "word " * 500, 2: "日本 語", 3: None, 4: "x" * 2000 + "\n\nafter it " * 40}
    df = spark.createDataFrame(list(texts.items()), "k int, t string")
    chunks = chunking.paragraph_chunks(df, "k", "t").withColumn("v", ingest.hashed_words(F.col("text")))
    assert "aggregate(" not in plan(chunks) and "transform(" not in plan(chunks)
    rows = chunks.collect()
    assert {r.k for r in rows} == {1, 4}
    for r in rows:
        digits = [int(hashlib.md5(w.encode()).hexdigest()[0], 16) for w in re.findall("[a-z0-9]+", r.text.lower())]
        assert r.v == [float(digits.count(d)) for d in range(16)]
    assert [r.v for r in df.select("k", ingest.hashed_words(F.col("t")).alias("v")).where("k in (2, 3)").collect()] == [None, None]


@pytest.mark.parametrize("least", [None, 0.2])
def test_nearest_rows_equal_all_products(monkeypatch, least):
    monkeypatch.setattr(vectors, "ROW_CELL", 16)
    monkeypatch.setattr(vectors, "QUERY_CELL", 3)
    x = np.random.default_rng(4).integers(-3, 4, size=(150, 5)).astype(np.float64)
    x[40:90] = x[3] * np.arange(1, 51)[:, None]  # ties by the score of 1
    x[100:120] = x[5]
    x[7], x[8] = 0, np.nan
    q = np.concatenate([x[::9], np.full((1, 5), np.nan)])
    i, j, score = vectors._nearest(x, q, 4, least)
    size = lambda v: np.sqrt((v * v).sum()) + vectors.EPSILON
    for at, v in enumerate(q):
        all_ = sorted((-round(float(v @ w / (size(v) * size(w))), 6), n) for n, w in enumerate(x) if not np.isnan(v @ w))
        assert [(-s, n) for s, n in zip(score[i == at], j[i == at], strict=True)] == [p for p in all_ if least is None or -p[0] >= least][:4]


def test_blocks_do_not_multiply_rows(spark):
    rows = spark.range(20_000).select("id", F.array(F.rand(1), F.rand(2)).alias("vector"))
    asked = rows.limit(9000).select(F.col("id").alias("query_id"), "vector")
    # 9000 queries were three blocks, so each of the rows was sent three times
    found = vectors.cosine_topk_each(rows, asked, "id", "vector", 2)
    assert vectors._blocks(asked, vectors.QUERY_BLOCK, vectors.QUERY_BLOCK) == 1
    assert found.where("rank = 1").count() == 9000


def test_terms_of_texts_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(ml, "HELD_GRAMS", 7)
    texts = ["Ab  ab\nc", "", None, " x\t", "日本 ab"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string")
    rows = ml.with_features(df, "t")
    # n-grams were arrays of rows, thousands of strings a text, and their vectors objects in Python workers
    assert dict(rows.dtypes)["grams"] == "string"
    counts = [Counter(p[i : i + n] for w in re.split(r"\s+", t.strip(" ").lower()) for p in [f" {w} "] for n in range(2, 6) for i in range(len(p) - n + 1)) if t is not None else Counter() for t in texts]
    whole = sum(counts, Counter())
    terms = ml.vocabulary(rows, 9)
    assert terms == sorted(whole, key=lambda g: (-whole[g], g))[:9]
    idf = ml.inverse_frequencies(rows, terms)
    assert np.allclose(idf, [np.log(6 / (sum(g in c for c in counts) + 1)) for g in terms])
    for r in ml.vectors(rows, terms, idf, ml.FEATURES).collect():
        weights = np.array([(1 + np.log(counts[r.k][g])) * (1 + w) if g in counts[r.k] else 0 for g, w in zip(terms, idf, strict=True)])
        assert np.allclose(r.features.toArray(), [*(weights / (np.linalg.norm(weights) or 1)), *(r[f] for f in ml.FEATURES)])


@pytest.mark.parametrize("least", [0.01, -9.0])
def test_documents_are_scored_without_their_postings(spark, monkeypatch, tmp_path, least):
    monkeypatch.setattr(bm25, "ASKED", 5)  # several passes
    monkeypatch.setattr(bm25, "DOCUMENTS", 4)
    monkeypatch.setattr(bm25, "QUERIES", 2)
    words = ["aa", "bb", "cc", "dd", "ee", "ff"]
    rng = np.random.default_rng(8)
    texts = [(i, " ".join(rng.choice(words[: 2 + i % 5], size=i % 7))) for i in range(60)] + [(60, None), (61, "aa aa bb")]
    spark.createDataFrame(texts, "k int, t string").coalesce(1).write.parquet(str(tmp_path / "d"))
    index = bm25.refreshed(spark.read.parquet(str(tmp_path / "d")), "k", "t", str(tmp_path / "i"))
    asked = {n: [words[(n + j * j) % 6] for j in range(1 + n % 4)] for n in range(9)} | {20: [], 21: ["none"]}
    queries = spark.createDataFrame(list(asked.items()), "query_id int, terms array<string>")
    found = bm25.search_each(index, "k", queries, 3, least)
    # rows were shuffled for each document, query and term that met
    assert "Join" not in plan(found)
    got = {(r.query_id, r["rank"]): (r.k, r.score) for r in found.collect()}
    want = {(q, n): (r.k, r.score) for q, terms in asked.items() for n, r in enumerate(bm25.search(index, "k", terms, 3, least).collect(), 1)}
    assert got == want and len(want) > 20


def test_turns_meet_the_words_of_all_queries_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(history, "ASKED", 3)  # several passes
    monkeypatch.setattr(history, "TURNS", 4)
    words = ["pear", "apple", "fig", "of", "Plum", "ÉCLAIR"]
    rng = np.random.default_rng(9)
    turns = [("s", n, " ".join(rng.choice(words, size=n % 5)), None if n % 6 == 0 else "ends", None) for n in range(30)]
    df = spark.createDataFrame(turns, "s string, n int, user_text string, assistant_text string, vector array<double>")
    texts = {1: "apple apple pie", 2: "plum\tof\nit", 3: "  éclair", 4: "", 5: None, 6: "fig pear ends", 7: "lum"}
    asked = spark.createDataFrame([(i, t, None) for i, t in texts.items()], "query_id int, text string, vector array<double>")
    found = history.search(df, asked, ["s", "n"], None, pool=6, k=4)
    # every turn was joined with every query, and lower-cased for each of its words
    assert "NestedLoop" not in plan(found)
    got = [(r.query_id, r.n, r.score, r["rank"]) for r in found.orderBy("query_id", "rank").collect()]
    want = []
    for i, text in texts.items():
        own = (text or "").lower().split()
        scored = sorted((-round(sum(len(w) > 2 and w in f"{u} {a or ''}".lower() for w in own) / (len(own) + 1), 6), f"s:{n}", n) for _, n, u, a, _ in turns)
        want += [(i, n, -score, rank) for rank, (score, _, n) in enumerate([r for r in scored if r[0] < 0][:4], 1)]
    assert got == want and len(want) > 12
