"""Long runs, filters of all grams, clashing names, and rows without ids."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import catalog, decontaminate, jaccard, language, secrets
from lodestone.llm._shared import discard, written


def test_long_runs_take_linear_time():
    for text in (b"a" * 1_000_000, b"host" + b" " * 1_000_000, b"user: bob k1J8sd7Hs8Fj2Kd9Fk3 " * 20_000):
        began = time.thread_time()
        secrets.find(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert time.thread_time() - began < 15


def test_endpoints():
    text = b"1http://a.b/c x3.+y://z ://n host = q.w:80 http://server=5"
    assert [text[a:b] for a, b in secrets._endpoints(text)] == [b"http://a.b/c", b"x3.+y://z", b"host = q.w:80", b"http://server=5"]


def test_filters_tell_all_languages_of_a_gram(spark):
    rows = [(1, "alpha beta gamma", "aa"), (2, "beta delta", "bb"), (3, "zeta eta theta iota kappa", "cc"), (4, None, "aa"), (5, "x", None)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    seen = {}
    for _, text, lang in rows[:3]:
        data = np.frombuffer(text.encode(), np.uint8)
        for code in language.text_grams(data, np.array([0, len(data)]))[1].tolist():
            seen.setdefault(code, set()).add(lang)
    codes = np.array(sorted(seen), np.uint32)
    held_by = model.filter(0)
    mask = held_by.slots[0][language.slots_of(codes, 0, held_by.size)]
    for k in range(1, language.HASHES):
        mask &= held_by.slots[0][language.slots_of(codes, k, held_by.size)]
    for i, lang in enumerate(model.languages):
        held = {c for c, m in zip(codes.tolist(), mask.tolist(), strict=True) if m >> (language.PLANES * i) & 1}
        assert held >= {c for c in seen if lang in seen[c]}
        assert len(held) <= len({c for c in seen if lang in seen[c]}) + 1
    share = language.shares(language.hits(held_by, np.zeros(len(codes), np.int64), codes, 1), np.array([len(codes)]))[:, 0]
    for i, lang in enumerate(model.languages):
        assert abs(share[i] - sum(lang in s for s in seen.values()) / len(seen)) < 0.05


def test_answers_do_not_depend_on_the_cap_of_the_filters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").limit(150)
    docs = docs.unionByName(spark.createDataFrame([(5000, None, None), (5001, "", "en"), (5002, "12 34", None), (None, "the end", "en"), (5003, "a", None)], docs.schema)).withColumn("score", F.lit("x"))
    told = {}
    for cap in (language.MODEL_BYTES, 1 << 15, 2 << 10):
        model = language.train(docs, model_bytes=cap)
        told[cap] = model.parts, {r.doc_id: (r.lang_pred, r.score) for r in language.predict(docs, model).collect()}
    (one, whole), (some, parts), (many, tiny) = told.values()
    assert (one, some, many) == (1, 2, 16) and len(whole) == 155
    for other in (parts, tiny):
        assert {k: v[0] for k, v in other.items()} == {k: v[0] for k, v in whole.items()}
        assert all(abs(v[1] - whole[k][1]) < 0.02 for k, v in other.items())
    assert [whole[k] for k in (5000, 5001, 5002)] == [("und", 0.0)] * 3


@pytest.mark.parametrize("bits", [64, 256, 1024])
def test_long_sketches_are_contractions(bits):
    rng = np.random.default_rng(bits)
    sets = [np.unique(rng.integers(0, 3 * bits, n).astype(np.uint64)) for n in (bits // 2, bits // 2, bits // 4, 1)]
    sets.append(np.union1d(sets[0], np.arange(10**6, 10**6 + 3, dtype=np.uint64)))
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    column = jaccard.long_sketches(np.concatenate(sets), first)
    for i in range(len(sets)):
        far = jaccard.sketch_distances(column.take([i] * len(sets)), column)
        assert all(far[j] <= len(np.setxor1d(sets[i], sets[j])) for j in range(len(sets)))
    assert 0 < jaccard.sketch_distances(column.slice(0, 1), column.slice(4, 1))[0] <= 3


def test_stages_take_any_columns_and_rows_without_ids(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en"), (1, text, "en"), (2, text + " x", "en"), (None, text, "en"), (None, None, None), (3, "", "en"), (4, "password = abcdef99", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clash = ["_letter", "_key", "_id", "_cuts", "_lang", "_score", "_told", "score", "n_chars", "row"]
    for c in clash:
        docs = docs.withColumn(c, F.lit(7).cast("bigint"))
    spark.createDataFrame([(None, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        got = out.collect()
        counts[name] = len(got)
        if name != "secret_scan":
            assert all(r[c] == 7 for r in got for c in clash)
    # one of the two equal rows with id 1 stays, and its near copy goes
    assert counts == {"language_id": 5, "near_duplicates": 5, "decontamination": 3, "secret_scan": 7}


def test_item_without_an_id_counts(spark):
    text = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(None, text)], "item_id long, text string")
    assert [(r.n_hit, r["items"]) for r in decontaminate.benchmark_hits(docs, items).collect()] == [(12, ["null"])]


def test_written_tables_can_be_discarded(spark):
    import os

    df = written(spark.range(3), "some")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path)
    discard(df)
    assert not os.path.exists(path)


def test_all_operators_take_null_and_repeated_ids_long_texts_and_any_columns(spark, tmp_path):
    rng = np.random.default_rng(6)
    long = " ".join(f"word{i}" for i in rng.integers(0, 5000, 45_000)) + " MIT License password = 'abcdef12'"
    rows = [(None, "the same text of two rows without an id", "en"), (None, "the same text of two rows without an id", "en"), (5, "one text", "en"), (5, "ein anderer Text und noch etwas", "de"), (5, "one text", None), (7, long, "en"), (8, None, None), (9, "", "de"), (10, long[:200_000], "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("source", "n_words", "score", "labels", "spans", "piece", "n_base", "row", "id", "kept", "lang_pred", "items", "key")})
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, " ".join(long.split()[100:115])), (1, "one text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = sorted((r[0] for r in rows), key=repr)
    for name, query in catalog.QUERIES.items():
        if name.startswith(("op11", "op12", "op13")):
            continue
        found = query(spark, str(tmp_path)).collect()
        if name.startswith("op2_"):
            ends = {(r.doc_id, r.piece) for r in found if r.piece == 0}
            assert len([r for r in found if r.piece == 0]) == len(rows) and len(ends) == 6, name
            used = sorted((r.sequence_id, r.offset, r.length) for r in found)
            assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(used, used[1:], strict=False))
        elif name.startswith("op5_"):  # a histogram
            assert sum(r.n_docs for r in found) == len(rows)
        else:
            assert sorted((r.doc_id for r in found), key=repr) == ids, name
