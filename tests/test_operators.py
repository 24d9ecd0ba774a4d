import json

from pyspark.sql import functions as F

from lodestone.functions import text as fn
from lodestone.operators import chunking, manifests, search, turns
from lodestone.sources import files
from lodestone.streaming import logs


def chunks(spark, cut, text, **how):
    df = spark.createDataFrame([(1, text)], "k int, t string")
    return [(r.start, r.end, r.text) for r in cut(df, "k", "t", **how).orderBy("id").collect()]


def test_paragraph_overlap_is_whole_paragraphs(spark):
    text = "\r\n\r\n".join(c * 500 for c in "abcdef")
    got = chunks(spark, chunking.paragraph_chunks, text)
    assert [(a, b, sorted(set(t.replace("\n", "")))) for a, b, t in got] == [(0, 1504, ["a", "b", "c"]), (1004, 2508, ["c", "d", "e"]), (2008, 3010, ["e", "f"])]
    assert chunks(spark, chunking.paragraph_chunks, "short") == [] and chunks(spark, chunking.paragraph_chunks, None) == []


def test_oversize_paragraph_is_not_carried(spark):
    text = "\n\n".join(["s" * 150, "  " + "x" * 2000 + " ", "e" * 120])
    got = chunks(spark, chunking.paragraph_chunks, text)
    assert [(a, b, len(t)) for a, b, t in got] == [(0, 150, 150), (0, 2154, 2152), (2157, 2277, 120)]


def test_line_blocks(spark):
    lines = lambda *sizes: "\n\n".join("\n".join("x" for _ in range(n)) for n in sizes)
    bounds = lambda text: [(a, b) for a, b, _ in chunks(spark, chunking.line_chunks, text)]
    assert bounds(lines(130)) == [(1, 60), (46, 105), (91, 130)]
    assert bounds("\n\n") == [] and bounds(None) == []
    assert bounds(lines(50, 20)) == [(1, 50), (36, 71)]
    assert bounds(lines(10, 55)) == [(1, 10), (1, 66)]
    assert bounds(lines(5, 70, 4)) == [(1, 5), (7, 66), (52, 76), (78, 81)]


def test_replace_and_window(spark):
    df = spark.createDataFrame([("a-a-a\nb\nc",)], "t string")
    row = df.select(
        *[fn.replace_first(F.col("t"), "a", "xx", n).alias(f"r{n}") for n in (0, 1, 2, 5)], search.view_window(F.col("t"), 2, 2, 1).alias("v"), fn.occurrences(F.col("t"), "a").alias("n"),
        fn.language_of(F.lit("d.x/A.PY")).alias("lang"),
    ).first()
    assert (row.r0, row.r1, row.r2, row.r5) == ("xx-xx-xx\nb\nc", "xx-a-a\nb\nc", "xx-xx-a\nb\nc", "xx-xx-xx\nb\nc")
    assert row.v == "a-a-a\nb\nc" and row.n == 3 and row.lang == "python"
    thought, rest = fn.without_thinking(F.lit("a<think>one</think>b<Reasoning>two</Reasoning>"))
    assert df.select(thought, rest).first()[:] == ("one\n\n---\n\ntwo", "ab")


def test_invalid_regex_is_a_literal(spark):
    df = spark.createDataFrame([(1, "A(b\na(b")], "k int, t string")
    assert [r.line_no for r in search.grep_regex(df, "k", "t", "a(b", 10).collect()] == [2]


def test_pairs_and_prefix(spark):
    rows = [("s", 0, "assistant", "x"), ("s", 1, "user", "a"), ("s", 2, "user", "b"), ("s", 3, "system", "z"), ("s", 4, "assistant", "c"), ("s", 5, "user", "d")]
    found = turns.pairs(spark.createDataFrame(rows, "s string, n int, role string, text string"), "s", "n")
    assert [(r.user_text, r.assistant_text, r.turn_no) for r in found.collect()] == [("b", "c", 1)]


def test_index_commit_is_all_or_nothing(spark):
    old = spark.createDataFrame([("a", 1, [1.0]), ("b", 1, [1.0])], "file string, n int, vector array<double>")
    new = spark.createDataFrame([("a", 2, None, False), ("b", 2, [2.0], False), ("b", 3, None, True)], "file string, n int, vector array<double>, oversize boolean")
    assert sorted((r.file, r.n) for r in manifests.index_commit(old, new, "file").collect()) == [("b", 2)]


def test_files(spark, tmp_path):
    for name, text in (("a.py", "x"), ("b.py", "x"), ("c.txt", "y\nz")):
        (tmp_path / name).write_text(text)
    assert [r.path.rsplit("/")[-1] for r in files.walk(spark, [str(tmp_path)], "*.py").collect()] == ["a.py"]
    assert files.text_lines(spark, str(tmp_path / "c.txt")).count() == 2
    chat = tmp_path / "s.jsonl"
    chat.write_text("\n".join([json.dumps({"role": "user", "content": "q"}), "", "{bad", json.dumps({"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "image"}]})]))
    assert [(r.role, r.content) for r in files.chat_lines(spark, str(chat)).orderBy("pos").collect()] == [("user", "q"), ("assistant", "a")]
    df = spark.range(3)
    assert files.commit_version(df, str(tmp_path / "v"), 1).count() == files.read_version(spark, str(tmp_path / "v"), 1).count() == 3


def test_pair_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "session string, pos int, role string, content string"
    for batch in ([("s", 0, "user", "q1"), ("s", 1, "user", "q2")], [("s", 2, "assistant", "a")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(src)
        stream = logs.pair_stream(spark.readStream.schema(schema).json(src))
        stream.writeStream.foreachBatch(lambda b, i: logs.append_index(b, i, out)).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert [(r.user_text, r.assistant_text) for r in spark.read.parquet(out).collect()] == [("q2", "a")]


def test_summaries(spark):
    from lodestone.operators import calls

    rows = [
        (1, 1, "bash", {"command": "ls " + "x" * 70}, "[exit 0]\na\n\nlast \n"), (1, 2, "search_history", {"query": "q"}, "[SYSTEM: search_history] none"), (1, 3, "str_replace", {"file": "f"}, '{"success": true, "changes": {"removed": 2, "added": 3}}'),
        (1, 4, "new", {"a": "1"}, '{"success": false}'), (1, 5, "workspace_search", {"query": "z"}, "a\nb"), (1, 6, "search_in_file", {"file": "f", "pattern": "p"}, '{"total_matches": 4}'),
    ]
    got = calls.summarised(spark.createDataFrame(rows, "turn int, i int, fn string, args map<string,string>, result string"), "turn", "i").first().summary.split("\n")
    assert got[0] == "[POWERS USED — 6 call(s)]" and got[1] == "  1. bash(ls " + "x" * 57 + "…) → ✓ | last"
    assert got[2].endswith("→ ✗ ([SYSTEM: search_history] none)") and got[3] == "  3. str_replace(f) → ✓ (2 lines → 3 lines)"
    assert got[4] == "  4. new(a) → ✗" and got[5] == "  5. workspace_search('z') → 2 line(s)" and got[6] == "  6. search_in_file(f, 'p') → 4 match(es)"


def test_union_of_calls(spark):
    from lodestone.operators import calls

    schema = "k int, pos int, fn string, args map<string,string>"
    tagged = spark.createDataFrame([(1, 0, "a", {"x": "1", "y": "2"})], schema)
    native = spark.createDataFrame([(1, 1, "a", {"y": "2", "x": "1"}), (1, 2, "b", {}), (1, 3, "b", {})], schema)
    assert sorted((r.fn, r.pos) for r in calls.union_calls(tagged, native, "k").collect()) == [("a", 0), ("b", 2)]


def test_page_parts(spark):
    from lodestone.operators import pages

    text = "start of it\n# One\nbody one\n```py\nx = 1\n```\n## Footer\n- item number one\n- item number two\n\n| a | b |\n|---|---|\n| 1 | 2 |\n"
    rows = pages.parts(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").collect()
    assert sorted((r.kind, r.header, r.priority) for r in rows) == [("code", "py", 5), ("list", "", 6), ("section", "Footer", 2), ("section", "Introduction", 4), ("section", "One", 4), ("table", "", 7)]
    got = pages.extracted(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t", [], 60).collect()
    assert sum(r.taken for r in got) <= 60


def test_eligible(spark):
    paths = ["/a/x.py", "/a/.env", "/a/k.key", "/venv/y.py", "/a/t.txt", "/a/t.chunks.json", "/a/u.txt", "/a/v.bin", "/p.egg-info/z.py"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert sorted(r.path for r in files.eligible(df, (".py", ".txt", ".json")).collect()) == ["/a/u.txt", "/a/x.py"]
