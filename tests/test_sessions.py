"""Sessions, versions, logs and ordered operators on small frames."""

import json
import random

from pyspark.sql import functions as F

from lodestone.functions import edits, maps
from lodestone.operators import ordered
from lodestone.sources import sessions


def test_session_files_and_indexes(spark, tmp_path):
    for name in ("a.jsonl", "b.jsonl", "c.txt"):
        (tmp_path / name).write_text("{}\n")
    (tmp_path / "a.jsonl.idx.json").write_text(json.dumps([{"turn": 1, "user_text": "x{"}, 3, "{", None, [1], {"turn": 2}]))
    (tmp_path / "b.jsonl.idx.json").write_text("[{")
    assert [r.session for r in sessions.session_files(spark, str(tmp_path)).collect()] == ["b.jsonl", "a.jsonl"]
    got = sessions.turn_index(spark, str(tmp_path), "turn int, user_text string").orderBy("pos").collect()
    assert [tuple(r) for r in got] == [("a.jsonl", 0, 1, "x{"), ("a.jsonl", 5, 2, None)]


def test_tolerant_and_strict_json(spark, tmp_path):
    default = spark.createDataFrame([(0,)], "a int")
    read = lambda name: [r.a for r in sessions.json_or(spark, str(tmp_path / name), "a int", default).collect()]
    (tmp_path / "good.json").write_text('{"a":\n 7}')
    (tmp_path / "bad.json").write_text('{"a": 7')
    (tmp_path / "empty.json").write_text("")
    assert read("good.json") == [7] and read("bad.json") == read("empty.json") == read("none.json") == [0]
    (tmp_path / "l.jsonl").write_text('{"text": "x", "label": 1}\n\n{"text": "y", "label": 0}\n')
    assert sorted(tuple(r) for r in sessions.labelled_lines(spark, str(tmp_path / "l.jsonl")).collect()) == [("x", 1), ("y", 0)]


def test_imported_chats(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "talk.txt").write_bytes(b"Hi \xff there")
    (tmp_path / "x/talk.txt").write_text("Other")
    (tmp_path / "blank.md").write_text(" \n")
    (tmp_path / "c.pdf").write_text("no")
    got = sessions.imported_chats(spark, str(tmp_path))
    rows = sorted(tuple(r) for r in got.collect())
    assert len(rows) == 4 and {r[3] for r in rows if r[2] == "assistant"} == {"Hi  there", "Other"}
    assert {r[3] for r in rows if r[2] == "user"} == {"[SYSTEM: imported chat — talk.txt]"} and len({r[0] for r in rows}) == 2
    assert sessions.imported_chats(spark, str(tmp_path), got).isEmpty()


def test_history_replaces_only_its_sessions(spark, tmp_path):
    root, mirror = str(tmp_path / "h"), str(tmp_path / "m")
    schema = "session string, pos int, role string, content string"
    sessions.save_history(spark.createDataFrame([("a", 0, "user", "1"), ("b", 0, "user", "2")], schema), root, mirror)
    sessions.save_history(spark.createDataFrame([("b", i, "user", str(i)) for i in range(3)], schema), root, mirror)
    assert sorted((r.session, r.pos, r.content) for r in sessions.history(spark, root).collect()) == [("a", 0, "1"), ("b", 0, "0"), ("b", 1, "1"), ("b", 2, "2")]
    assert sorted((r.session, r.pos) for r in spark.read.json(mirror).collect()) == [("a", 0), ("b", 0), ("b", 1), ("b", 2)]


def test_a_cut_is_logged_before(spark, tmp_path):
    ledger = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d")], "turn int, x string")
    log = str(tmp_path / "log")
    assert sessions.recovered(ledger, log, ["turn"]).count() == 4
    left = sessions.cut(ledger, log, "turn", 1)
    assert sorted(r.x for r in left.collect()) == ["a", "d"]
    redone = left.unionByName(spark.createDataFrame([(2, "new")], ledger.schema))
    assert sorted(r.x for r in sessions.recovered(redone, log, ["turn"]).collect()) == ["a", "c", "d", "new"]


def test_versions_are_whole_and_only_written_when_changed(spark, tmp_path):
    root = str(tmp_path / "v")
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, x string")
    assert sessions.latest(spark, root) is None
    assert sessions.save(df, root) and not sessions.save(df.orderBy(F.desc("k")), root)
    assert sessions.save(df.dropDuplicates(), root) and sessions.versions(spark, root) == [1, 2]
    (tmp_path / "v/version=3").mkdir()
    assert sessions.latest(spark, root).count() == 2 and sessions.save(df, root) and sessions.latest(spark, root).count() == 3


def test_snapshot(spark, tmp_path):
    source = tmp_path / "s"
    (source / "venv").mkdir(parents=True)
    for name in ("a.txt", "tile_1.png", "venv/b.txt"):
        (source / name).write_text(name)
    assert sessions.snapshot(spark, str(source), str(tmp_path / "o"))
    assert [bytes(r.content) for r in sessions.latest(spark, str(tmp_path / "o")).collect()] == [b"a.txt"]


def test_cache_stream(spark, tmp_path):
    new = tmp_path / "in"
    new.mkdir()
    root, check = str(tmp_path / "c"), str(tmp_path / "k")
    for i, rows in enumerate(([("x", 1, "a"), ("x", 2, "b"), ("y", 1, "c")], [("y", 5, "d")])):
        spark.createDataFrame(rows, "url string, at int, body string").coalesce(1).write.parquet(str(new / f"d={i}"))
        stream = spark.readStream.schema("url string, at int, body string").parquet(str(new / "*"))
        sessions.cache_stream(stream, root, "url", "at", check, None).awaitTermination(120)
    assert sorted((r.url, r.body) for r in sessions.latest(spark, root).collect()) == [("x", "b"), ("y", "d")]


def test_running_totals_of_one_large_group(spark):
    rnd = random.Random(5)
    rows = [(None if i % 9 == 0 else "hot" if i % 3 else "g%d" % (i % 4), i, rnd.randrange(50)) for i in range(3000)]
    want, sums = {}, {}
    for g, i, n in rows:
        sums[g] = want[i] = sums.get(g, 0) + n
    df = spark.createDataFrame(rows, "g string, i int, n int").repartition(7)
    got = ordered.running_total(df, "g", ["i"], "n", "upto")
    assert {r.i: r.upto for r in got.collect()} == want and got.columns == ["g", "i", "n", "upto"]


def test_joined_texts_in_pieces(spark):
    rows = [("a", i, f"t{i}" * (1 + i % 3)) for i in range(40)] + [("b", 0, None), ("c", 0, "only"), ("c", 1, None)]
    got = ordered.joined_texts(spark.createDataFrame(rows, "g string, i int, t string").repartition(5), "g", ["i"], F.col("t"), "|", 20).collect()
    pieces = {g: [r.text for r in sorted(got, key=lambda r: r.piece) if r.g == g] for g in "abc"}
    assert "|".join(pieces["a"]) == "|".join(t for g, _, t in rows if g == "a") and len(pieces["a"]) > 5
    assert pieces["b"] == [] and pieces["c"] == ["only"]
    assert ordered.joined_texts(spark.createDataFrame([], "g string, i int, t string"), "g", ["i"], F.col("t")).isEmpty()


def test_positions_and_rerank(spark):
    left = spark.createDataFrame([("f", 0, "x[ls]"), ("f", 1, "y")], "f string, n int, block string")
    right = spark.createDataFrame([("f", 0, "t")], "f string, n int, tag string")
    got = ordered.labelled_blocks(left, right, ["f", "n"], "tag", F.substring_index("block", "[", 1)).orderBy("n").collect()
    assert [r.tag for r in got] == ["t", "y"]
    best = ordered.reranked(spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0), (3, 1.0)], "i int, s double"), "s", "i", 3).collect()
    assert [r.i for r in best] == [2, 0, 3]


def test_maps_and_encodings(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS x, map('b', 3) AS y, CAST(NULL AS map<string,int>) AS z, 'plain' AS p")
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    got = df.select(maps.merged(x, y), maps.merged(z, y), maps.merged(x, z), maps.without(x, "a"), maps.value_or(x, "c", F.lit(9)), maps.value_or(z, "a", F.lit(9)), maps.media_type(F.col("p")), maps.payload(F.col("p"))).first()
    assert tuple(got) == ({"a": 1, "b": 3}, {"b": 3}, {"a": 1, "b": 2}, {"b": 2}, 9, 9, None, None)


def test_edits(spark):
    df = spark.createDataFrame([("one\nx.y\nx.y",), ("x.y",), ("xay",), (None,)], "t string")
    one = [tuple(r.e) for r in df.select(edits.edited(F.col("t"), "x.y", "p\nq").alias("e")).collect()]
    assert one == [("ambiguous", "one\nx.y\nx.y", 0, 0), ("ok", "p\nq", 1, 1), ("missing", "xay", 0, 0), ("missing", None, 0, 0)]
    assert tuple(df.select(edits.edited(F.col("t"), "x.y", "z", 0).alias("e")).first().e) == ("ok", "one\nz\nz", 2, 0)
    assert sorted((r.t, r.nth, r.line_no) for r in edits.occurrence_lines(df, "t", "t", "x.y").collect()) == [("one\nx.y\nx.y", 0, 2), ("one\nx.y\nx.y", 1, 3), ("x.y", 0, 1)]
