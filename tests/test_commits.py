"""Tables that become visible in one commit: logs, turns, the index of turns and the postings index."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import bm25, turns
from lodestone.sources import turnlog
from lodestone.sources.artifacts import folder
from lodestone.sources.commits import Conflict, Log
from lodestone.streaming import turn_index


def test_only_one_of_two_writers_commits(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    assert log.last() == (0, {})
    first = log.put(spark.range(3), "t")
    assert log.commit(0, {"t": first}) == 1
    one, two = log.put(spark.range(4), "t"), log.put(spark.range(5), "t")
    assert log.commit(1, {"t": one}) == 2
    with pytest.raises(Conflict):
        log.commit(1, {"t": two})
    version, content = log.last()
    assert version == 2 and log.table(content["t"]).count() == 4
    assert not [n for n in folder(spark, f"{log.root}/commits").names() if n.startswith("_")]
    assert sorted(log.vacuum()) == sorted([first, two]) and log.versions() == [2] and log.table(content["t"]).count() == 4


def files(spark, **content):
    return spark.createDataFrame([(p.replace("_", "."), c.encode()) for p, c in content.items()] or [("", b"")], "path string, content binary").where("path != ''")


def entry(spark, text, rerun=None):
    return spark.createDataFrame([(text, rerun)], "prompt string, rerun_of int")


def said(spark, turn, text):
    return spark.createDataFrame([(2 * turn - 2, "user", text), (2 * turn - 1, "assistant", f"re {text}")], "pos int, role string, content string")


def put(spark, root, turn, text, keep=3, **content):
    return turnlog.commit_turn(spark, root, turn, entry(spark, text), files(spark, **content), said(spark, turn, text), keep)


def state(spark, root):
    log = Log(spark, root)
    _, c = log.last()
    held = {r.path: bytes(r.content).decode() for r in turnlog.files_at(log, c).collect()}
    return held, sorted((r.turn, r.prompt) for r in turnlog.ledger(log, c).collect()), sorted(r.pos for r in turnlog.history(log, c).collect()), c["oldest"]


def test_turns_are_committed_pruned_and_restored(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "turns")
    monkeypatch.setattr(turnlog, "PARTS", 3)
    put(spark, root, 1, "one", a_py="1", b_py="1")
    put(spark, root, 2, "two", a_py="2", b_py="1", c_py="2")
    put(spark, root, 3, "three", a_py="2", c_py="2")
    put(spark, root, 4, "four", c_py="4")
    assert state(spark, root) == ({"c.py": "4"}, [(1, "one"), (2, "two"), (3, "three"), (4, "four")], list(range(8)), 2)
    log = Log(spark, root)
    at = lambda n: {r.path: bytes(r.content).decode() for r in turnlog.files_at(log, log.last()[1], n).collect()}
    assert at(2) == {"a.py": "2", "b.py": "1", "c.py": "2"} and at(3) == {"a.py": "2", "c.py": "2"}
    with pytest.raises(ValueError, match="turns 2 to 4"):
        turnlog.restore_turn(spark, root, 1)
    before = log.versions()
    turnlog.restore_turn(spark, root, 3)
    assert state(spark, root) == ({"a.py": "2", "c.py": "2"}, [(1, "one"), (2, "two"), (3, "three")], list(range(6)), 2)
    with pytest.raises(ValueError):
        turnlog.restore_turn(spark, root, 4)
    turnlog.restore_turn(spark, root, 2)
    assert state(spark, root)[0] == {"a.py": "2", "b.py": "1", "c.py": "2"}
    put(spark, root, 3, "three again", d_py="3")
    assert state(spark, root)[:2] == ({"d.py": "3"}, [(1, "one"), (2, "two"), (3, "three again")]) and len(log.versions()) == len(before) + 3


def test_a_turn_is_run_again_or_edited_in_place(spark, tmp_path):
    root = str(tmp_path / "turns")
    for n, w in enumerate(("one", "two", "three"), 1):
        put(spark, root, n, w, **{f"f{i}_py": w for i in range(n)})
    turnlog.replace_turn(spark, root, 2, entry(spark, "two, edited"), said(spark, 2, "edited"), keep_tail=True)
    held, told, places, _ = state(spark, root)
    assert (held, told, places) == ({f"f{i}.py": "three" for i in range(3)}, [(1, "one"), (2, "two, edited"), (3, "three")], list(range(6)))
    log = Log(spark, root)
    assert {r.pos: r.content for r in turnlog.history(log, log.last()[1]).collect()}[3] == "re edited"
    turnlog.replace_turn(spark, root, 2, entry(spark, "two again", 2), said(spark, 2, "again"))
    assert state(spark, root)[:3] == ({"f0.py": "two", "f1.py": "two"}, [(1, "one"), (2, "two again")], list(range(4)))
    assert {r.pos: r.content for r in turnlog.history(log, log.last()[1]).collect()}[2] == "again"
    with pytest.raises(ValueError):
        turnlog.replace_turn(spark, root, 3, entry(spark, "x"), said(spark, 3, "x"))


def test_a_failed_turn_leaves_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "turns")
    put(spark, root, 1, "one", a_py="1")
    was = state(spark, root)
    bad = said(spark, 2, "two").withColumn("content", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        turnlog.commit_turn(spark, root, 2, entry(spark, "two"), files(spark, a_py="2"), bad, 3)
    assert state(spark, root) == was
    # a writer that began before another one has committed
    last = Log.last
    monkeypatch.setattr(Log, "last", lambda self: (1, last(self)[1]) if last(self)[0] == 2 else last(self))
    put(spark, root, 2, "first", a_py="2")
    with pytest.raises(Conflict):
        put(spark, root, 2, "second", a_py="3")
    monkeypatch.setattr(Log, "last", last)
    assert state(spark, root)[:2] == ({"a.py": "2"}, [(1, "one"), (2, "first")])


MESSAGE = "session string, pos int, role string, content string"


def pairs_of(spark, rows):
    df = spark.createDataFrame(rows, MESSAGE).withColumnRenamed("content", "text")
    return sorted((r.session, r.turn_no, r.user_text, r.assistant_text) for r in turns.pairs(df, "session", "pos").collect())


def test_index_of_turns_follows_edits_cuts_and_repeated_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(turn_index, "PARTS", 4)
    root, log = str(tmp_path / "index"), Log(spark, str(tmp_path / "index"))
    held = {}

    def take(number, *rows):
        done = turn_index.index_batch(spark.createDataFrame(list(rows), MESSAGE), number, root, lambda t: t.withColumn("vector", F.length("user_text")))
        if done:
            for s, p, role, _ in rows:
                if role == "cut":
                    for k in [k for k in held if k[0] == s and k[1] >= p]:
                        del held[k]
            held.update({(s, p): (s, p, role, c) for s, p, role, c in rows if role != "cut"})
        got = sorted((r.session, r.turn_no, r.user_text, r.assistant_text) for r in turn_index.current(spark, root).collect())
        assert got == (pairs_of(spark, list(held.values())) if held else []), number
        return done, log.last()[1]["added"]

    talk = lambda s, n, w="": [(s, p, ("user", "assistant")[p % 2], f"{s}{p}{w}") for p in range(n)]
    assert take(0, *talk("a", 6), *talk("b", 3)) == (True, 4)
    assert take(1, ("b", 3, "assistant", "late"), ("a", 6, "user", "q")) == (True, 1)
    assert take(1, ("b", 3, "assistant", "late"), ("a", 6, "user", "q")) == (False, 1)
    assert take(0, ("a", 0, "user", "old")) == (False, 1)
    assert take(2, *talk("a", 6)) == (True, 0)  # said before
    assert take(3, ("a", 2, "user", "edited"), ("a", 7, "assistant", "r")) == (True, 3)
    assert take(4, ("a", 4, "cut", ""), ("a", 4, "user", "new"), ("b", 9, "cut", "")) == (True, 0)
    assert take(5, ("a", 5, "assistant", "newer"), ("c", 0, "system", "s"), ("c", 1, "user", "u"), ("c", 2, "assistant", "v")) == (True, 2)
    assert take(6, ("b", 0, "cut", ""), ("a", 0, "cut", "")) == (True, 0)
    assert take(7, *talk("b", 2), ("b", 2, "user", "z")) == (True, 1)
    assert take(8, ("c", 3, "assistant", "no question"), ("c", 1, "user", "other")) == (True, 1)


def test_index_of_turns_from_a_stream(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "index")
    rows = [("s", p, ("user", "assistant")[p % 2], f"m{p}") for p in range(8)] + [("t", 0, "user", "x"), ("t", 1, "assistant", "y")]

    def arrive(some):
        spark.createDataFrame(some, MESSAGE).coalesce(1).write.mode("append").json(source)
        turn_index.turn_index_stream(spark.readStream.schema(MESSAGE).json(source), root, str(tmp_path / "checkpoint")).awaitTermination()

    arrive(rows[:3])
    arrive(rows[3:])
    batch = Log(spark, root).last()[1]["batch"]
    assert not turn_index.index_batch(spark.createDataFrame(rows[3:], MESSAGE), batch, root)  # the batch comes again
    arrive([("s", 4, "cut", ""), ("s", 4, "user", "again")])
    want = pairs_of(spark, [r for r in rows if r[0] == "t" or r[1] < 4] + [("s", 4, "user", "again")])
    assert sorted((r.session, r.turn_no, r.user_text, r.assistant_text) for r in turn_index.current(spark, root).collect()) == want


def test_postings_follow_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bm25, "SEGMENTS", 3)
    path, root = str(tmp_path / "docs"), str(tmp_path / "index")
    held = {i: f"alpha w{i % 7} common{' beta' * (i % 3)}" for i in range(200)}

    def write(part):
        rows = [(i, t, part) for i, t in held.items() if i % 10 == part]
        frame = spark.createDataFrame(rows, "k int, t string, part int").coalesce(1)
        frame.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)

    def same(index):
        fresh = bm25.refreshed(spark.read.parquet(path), "k", "t", f"{root}-{len(log.versions())}-{sorted(held)[0]}-{hash(tuple(held.items()))}")
        for a, b in ((index.idf(), fresh.idf()), (index.stats, fresh.stats), (bm25.search(index, "k", ["beta", "w3", "alpha"], 50), bm25.search(fresh, "k", ["beta", "w3", "alpha"], 50))):
            assert sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in a.collect()) == sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in b.collect())

    log = Log(spark, root)
    for part in range(10):
        write(part)
    assert bm25.refreshed(spark.read.parquet(path), "k", "t", root).commit["tokenised"] == 200
    assert bm25.refreshed(spark.read.parquet(path), "k", "t", root).commit["tokenised"] == 200 and log.versions() == [1]  # nothing has changed
    # one text in a hundred changes, in two files
    held[13], held[27] = "alpha changed", None
    write(3), write(7)
    index = bm25.refreshed(spark.read.parquet(path), "k", "t", root)
    assert index.commit["tokenised"] == 2 and log.table(index.commit["segments"][-1]["tokens"]).count() == 2
    same(index)
    # one goes, one comes, one moves to another file with the same text, one changes again
    del held[43]
    held[1003], held[13] = "gamma alpha", "alpha beta"
    write(3)
    index = bm25.refreshed(spark.read.parquet(path), "k", "t", root)
    assert index.commit["tokenised"] == 2
    same(index)
    rows = [(53, held[53], 4)] + [(i, t, 4) for i, t in held.items() if i % 10 == 4]
    spark.createDataFrame(rows, "k int, t string, part int").coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    spark.createDataFrame([(i, t, 3) for i, t in held.items() if i % 10 == 3 and i != 53], "k int, t string, part int").coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    index = bm25.refreshed(spark.read.parquet(path), "k", "t", root)
    assert index.commit["tokenised"] == 0 and len(index.commit["segments"]) == 1  # merged
    same(index)
    # a file goes
    folder(spark, f"{path}/part=9").delete()
    for i in [i for i in held if i % 10 == 9]:
        del held[i]
    held[0] = "alpha"
    write(0)
    index = bm25.refreshed(spark.read.parquet(path), "k", "t", root)
    assert index.commit["tokenised"] == 1
    same(index)


def test_an_index_answers_for_its_own_table_only(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(1, "alpha", "beta"), (2, "beta", "beta"), (3, "alpha", None)], "k int, t string, u string").write.parquet(path)
    docs = spark.read.parquet(path)
    assert bm25.current(docs, "k", "t", "own").stats.first().tokens == 3
    assert bm25.current(docs, "k", "u", "own").stats.first().tokens == 2
    for other in (docs.where("k % 2 = 0"), docs.select("k", F.col("u").alias("t")), docs.limit(1)):
        with pytest.raises(ValueError, match="as it is read"):
            bm25.current(other, "k", "t", "own")


def test_writers_of_an_index_that_meet_start_again(spark, tmp_path, monkeypatch):
    path, root = str(tmp_path / "docs"), str(tmp_path / "index")
    spark.createDataFrame([(1, "alpha")], "k int, t string").write.parquet(path)
    commit, met = Log.commit, []

    def first_come(self, expected, content):
        if not met:
            met.append(json.dumps(content))
            commit(self, expected, content)  # another writer
        return commit(self, expected, content)

    monkeypatch.setattr(Log, "commit", first_come)
    index = bm25.refreshed(spark.read.parquet(path), "k", "t", root)
    assert met and Log(spark, root).versions() == [1] and index.stats.first().docs == 1
