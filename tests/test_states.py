"""Rules, turn states, ingest and labels on small frames."""

from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.operators import bm25, ingest, ml, states


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_paths(spark):
    paths = ["/a/b/x.py", "/a/b/../c.py", "/a/b/../../b", "/a/b/", "/a/bc", "b\\..\\..\\..\\a\\b\\y", None]
    assert [r[0] for r in values(spark, [(p,) for p in paths], "p string", rules.inside(F.col("p"), "/a/b"))] == [True, False, False, True, False, True, False]
    names = ["d/task_0a1b2c3d.py", "task_0a1b2c3.py", "x/tile_1.png", "venv/a.py", "s_backup/a", "src/a.py"]
    got = values(spark, [(n,) for n in names], "p string", rules.is_project_file(F.col("p")), rules.archivable(F.col("p"), F.lit(10)))
    assert got == [(False, True), (True, True), (True, False), (True, False), (True, False), (True, True)]


def test_texts_and_dates(spark):
    rows = [("\n [OCR ERROR: x]", "2024-02-30"), (" \t", "2024-02-03 "), ("a", "03.02.2024"), (None, None)]
    got = values(spark, rows, "t string, d string", rules.usable_text(F.col("t")), rules.valid_date(F.col("d")).cast("string"))
    assert got == [(False, None), (False, "2024-02-03"), (True, None), (False, None)]
    held = {w: [r[0] for r in values(spark, [(y,) for y in (2019, 2022, 2024)], "y int", rules.in_years(F.col("y"), w))] for w in ("2024", "2022-", "-2020", "2020-2023", " ")}
    assert held == {"2024": [False, False, True], "2022-": [False, True, True], "-2020": [True, False, False], "2020-2023": [False, True, False], " ": [True] * 3}
    assert [r[0] for r in values(spark, [(s,) for s in (200, 400, 413, 429, 503, 404)], "s int", rules.retry_class(F.col("s")))] == ["ok", "client_error", "client_error", "wait", "retry", "fail"]
    assert [r[0] for r in values(spark, [(s,) for s in (59.9, 60.0, 7199.0, 86400.0)], "s double", rules.age(F.col("s")))] == ["just now", "1m ago", "1h ago", "1d ago"]


def test_turn_states(spark):
    ledger = spark.createDataFrame([(1, None, ["a"], None), (2, None, [], ["b", "c"]), (3, 2, None, ["d"])], "turn int, rerun int, ups array<string>, outs array<string>")
    archives = spark.createDataFrame([(1,), (3,), (4,)], "turn int")
    assert [r.turn for r in states.back_to(ledger, archives, "turn", 1).collect()] == [1]
    assert states.back_to(ledger, archives, "turn", 2).count() == 3
    left, kept = states.without_turn(ledger, archives, "turn", "rerun", 2)
    assert sorted((r.turn, r.rerun) for r in left.collect()) == [(1, None), (2, None)] and sorted(r.turn for r in kept.collect()) == [1, 2, 3]
    assert sorted(tuple(r) for r in states.flattened(ledger.select("turn", "ups", "outs"), "ups", "outs").collect()) == [(1, "ups", "a"), (2, "outs", "b"), (2, "outs", "c"), (3, "outs", "d")]
    new = spark.createDataFrame([(2, 1, None, None)], ledger.schema)
    assert sorted((r.turn, r.rerun) for r in states.committed(ledger, new, "turn").collect()) == [(1, None), (2, 1), (3, 2)]


def test_ingest_is_all_or_nothing(spark):
    long = lambda w: " ".join([w] * 60)
    old = spark.createDataFrame([(1, long("one")), (2, long("two")), (3, long("three")), (4, long("four"))], "k int, t string")
    chunks = ingest.embedded_chunks(old, "k", "t")
    manifest = old.select("k", F.md5("t").alias("digest"))
    # 1 stays, 2 changes, 3 changes to what cannot be embedded, 4 is gone, 5 is new, 6 is unusable
    source = spark.createDataFrame([(1, long("one")), (2, long("deux")), (3, long("§§§")), (5, long("five")), (6, "[OCR ERROR]"), (7, None)], "k int, t string")
    assert {r.k: r.action for r in ingest.plan(source, manifest, "k", "t").collect()} == {1: "skip", 2: "build", 3: "build", 4: "remove", 5: "build", 6: "reject", 7: "reject"}
    got = {r.k: r.text[:4].strip() for r in ingest.ingested(source, manifest, chunks, "k", "t").collect()}
    assert got == {1: "one", 2: "deux", 3: "thre", 5: "five"}


def test_index_is_rebuilt_only_when_files_change(spark, tmp_path):
    path = str(tmp_path / "d")
    write = lambda rows, mode: spark.createDataFrame(rows, "k int, t string").coalesce(1).write.mode(mode).parquet(path)
    read = lambda: spark.read.parquet(path)
    write([(1, "alpha beta"), (2, "gamma"), (3, None)], "overwrite")
    first = bm25.current(read(), "k", "t", "test").stats.inputFiles()
    assert bm25.current(read(), "k", "t", "test").stats.inputFiles() == first
    write([(4, "alpha alpha"), (5, "delta")], "append")
    again = bm25.current(read(), "k", "t", "test")
    assert again.stats.inputFiles() != first and again.stats.first().docs == 5
    assert [r.k for r in bm25.search(again, "k", ["alpha"], 5).collect()] == [4, 1]
    assert [r.k for r in bm25.search(again, "k", ["alpha"], 5, only=F.col("k") < 4).collect()] == [1]
    assert bm25.search(again, "k", [], 5).count() == 0


def test_labels(spark):
    texts = ["hello", "read_file it", "<read_file>a</read_file>", "read_file [SYSTEM: the result]", "<tool_call>read_file", "<|tool_call_begin|>functions.read_file:0<|tool_call_argument_begin|>", None]
    assert [r[0] for r in values(spark, [(t,) for t in texts], "t string", ml.auto_label(F.col("t"), ["read_file"]))] == [None, "review", "own", "own", "foreign", "excluded", None]


def test_split_is_stratified(spark):
    df = spark.range(20000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"))
    train, test = ml.split(df, "id", "label")
    n = {r.label: r["count"] for r in test.groupBy("label").count().collect()}
    assert train.count() + test.count() == 20000 and 380 <= n[1] <= 400 and 3560 <= n[0] <= 3600
    assert ml.oversampled(df.limit(10), df.limit(2)).count() == 26
