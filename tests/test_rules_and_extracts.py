"""Walks, globs, extracts, attribution, classifier, streams and saved vectors on small inputs."""

import fnmatch
import os
import re

import pytest
from pyspark.sql import functions as F

from lodestone.functions import edits, rules
from lodestone.operators import bm25, calls, chunking, ingest, manifests, ml, pages, states, turns
from lodestone.sources import files, sessions, vector_index, walk
from lodestone.streaming import logs


def made(root, *names):
    for n in names:
        os.makedirs(os.path.dirname(f"{root}/{n}") or root, exist_ok=True)
        if not n.endswith("/"):
            with open(f"{root}/{n}", "w") as f:
                f.write(n if "same" not in n else "same")


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_walk_lists_no_excluded_folder(spark, tmp_path, scheme):
    root = str(tmp_path / "ws")
    made(root, "a.py", "b b.md", "sub/deep/c.py", "sub/same1.py", "sub/same2.py", "node_modules/x/y.py", "sub/lib.egg-info/z.py", ".hid/h.py", "empty/", "sub/task_0a1b2c3d.py", "sub/n.chunks.json", "sub/n.txt", "sub/.env", "k.key", "no_ext", "build/o.py")
    os.makedirs(f"{root}/empty", exist_ok=True)
    os.symlink(root, f"{root}/sub/loop")
    listed = []
    enters = lambda n: ~rules.any_glob(n, ("node_modules", "*.egg-info", ".*"))
    found = walk.walk(spark, [scheme + root], enters, lambda level: listed.extend(r.folder for r in level.collect()))
    inner = lambda p: p.removeprefix(scheme + root).strip("/")
    assert sorted(map(inner, listed)) == ["", "build", "empty", "sub", "sub/deep"]
    assert {inner(r.path) for r in found.where("is_folder").collect()} == {"build", "empty", "sub", "sub/deep"}
    files, folders = walk.registry(spark, scheme + root, (".py", ".md", ".txt", ".json"), ("node_modules", "*.egg-info"))
    assert sorted(r.path for r in files.collect()) == ["a.py", "b b.md", "build/o.py", "sub/deep/c.py", "sub/n.txt", "sub/same1.py", "sub/same2.py"]
    assert sorted(r.path for r in folders.collect()) == ["build", "empty", "sub", "sub/deep"]
    sources = walk.source_files(spark, [scheme + f"{root}/sub", scheme + root], (".py", ".txt", ".md"))
    assert sorted(inner(r.path) for r in sources.collect()) == [".hid/h.py", "a.py", "b b.md", "sub/deep/c.py", "sub/same1.py", "sub/task_0a1b2c3d.py"]
    assert walk.walk(spark, [f"{root}/none"], enters).count() == 0


def test_globs(spark):
    globs = ["*.py", "a?c", "[ab]*", "[!a]x", "x[", "[]]", "*", "", "a.b", "[a-c]\\x", "ü*", "[^a]"]
    names = ["x.py", "abc", "ac", "b", "ax", "bx", "x[", "]", "", "a.b", "aXb", "b\\x", "über", "x.pyc", "A.PY", "l\nx.py", "^", "z", None]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for g in globs:
        assert [r[0] for r in df.select(rules.glob_matches(F.col("n"), g)).collect()] == [n is not None and fnmatch.fnmatchcase(n, g) for n in names], g


def test_occurrence_lines(spark):
    texts = {1: "a**b\n**\n\n****x", 2: None, 3: "", 4: "**" * 3000 + "\n**"}
    df = spark.createDataFrame(list(texts.items()), "k int, t string")
    got = sorted(map(tuple, edits.occurrence_lines(df, "k", "t", "**").collect()))
    assert got == sorted((k, i, (t or "")[: m.start()].count("\n") + 1) for k, t in texts.items() for i, m in enumerate(re.finditer(r"\*\*", t or "")))


PAGE = """# Guide
Intro text of the guide which is rather long and tells a lot about how to call it.

```python
client.get()
```

- GET /v1/items
- POST /v1/items/{id}
- limit: how many
* `page`: which one

| a | b |
|---|---|
| 1 | 2 |

## License
Error 404: not there
HTTP 500 broken
"""


def test_api_facts_and_extracts(spark):
    plain = "one two\n\n" + "x" * 150 + "\n\nlast"
    df = spark.createDataFrame([(1, PAGE), (2, plain), (3, None), (4, "")], "k int, t string")
    facts = df.select(pages.api_facts(F.col("t")).alias("f")).first().f
    assert facts.endpoints == ["/v1/items", "/v1/items/{id}"]
    assert [tuple(p) for p in facts.parameters] == re.findall(r"(?:^|\n)[\s]*[-*]?\s*`?(\w+)`?\s*:\s*(.+?)(?=\n|$)", PAGE)
    assert [tuple(e) for e in facts.errors] == [("404", "not there"), ("500", "broken")]
    cut = df.select(*[pages.paragraphs_within(F.col("t"), F.lit(n)).alias(f"c{n}") for n in (10, 120, 157, 500)]).collect()[1]
    assert (cut.c10, cut.c120, cut.c157, cut.c500) == ("one two", "one two\n\n" + "x" * 113 + "...", "one two\n\n" + "x" * 150, plain)
    best = {r.k: r.extract for r in pages.extract(df, "k", "t", ["items"], 100000).collect()}
    assert best[1].startswith("**KEY POINTS:**\n- GET /v1/items") and "**CODE (PYTHON):**\n```python\nclient.get()\n```" in best[1] and "**DATA:**\n| a | b |" in best[1]
    # a plain text is one section
    assert best[2] == "Introduction\n" + plain and best[3] in (None, "") and best[4] == ""
    told = {r.k: r.extract for r in pages.for_developer(df, "k", "t", ["items"], 400).collect()}
    assert told[1].startswith("## CODE EXAMPLES\n\n\n```python\nclient.get()\n```\n\n## API ENDPOINTS\n/v1/items\n/v1/items/{id}\n\n## PARAMETERS\n- `")
    small = {r.k: r.extract for r in pages.for_developer(df, "k", "t", ["items"], 40).collect()}
    # what is left of the budget is too small for a part or a paragraph
    assert small[1] == "## CODE EXAMPLES\n\n\n```python\nclient.get()\n```\n\n"


def test_attribution_of_calls(spark):
    rows = [
        (1, 0, "str_replace", {"file": "/ws/outputs/r.md"}), (1, 1, "str_replace", {"file": "/ws/scratch/b.py"}), (1, 2, "str_replace", {"file": "a.py"}), (1, 3, "str_replace", {}),
        (1, 4, "str_replace", {"file": "/ws/scratch/b.py"}), (1, 5, "bash", {"command": "  "}), *[(1, 6 + i, "bash", {"command": f"run {i} " + "x" * 100}) for i in range(7)], (2, 0, "view", {}),
    ]
    got = {r.turn: r for r in calls.attributed(spark.createDataFrame(rows, "turn int, pos int, fn string, args map<string,string>"), "turn", "pos", "/ws/outputs").collect()}
    assert (got[1].modified, got[1].outputs_created) == (["a.py", "b.py"], ["r.md"])
    assert got[1].commands == [f"run {i} " + "x" * 74 for i in range(5)]
    assert (got[2].modified, got[2].outputs_created, got[2].commands) == ([], [], [])


def test_line_ranges_fall_back(spark):
    known = spark.createDataFrame([("s", 1, 3, 4)], "s string, turn_no int, start_line int, end_line int")
    found = spark.createDataFrame([("s", 1), ("s", 2), ("t", 1)], "s string, turn_no int")
    assert sorted(map(tuple, turns.line_ranges(found, known, ["s", "turn_no"]).collect())) == [("s", 1, 3, 4), ("s", 2, 1, 2), ("t", 1, 1, 2)]


def test_sidecars(spark):
    files = spark.createDataFrame([(p,) for p in ("a.txt", "a.chunks.json", "b.chunks.json", "c.chunks.json", "n.md", "d.chunks.json", "e.txt", "e.chunks.json")], "path string")
    sources = spark.createDataFrame([("a.chunks.json", "a.txt"), ("b.chunks.json", "gone.md"), ("c.chunks.json", "n.md"), ("e.chunks.json", None)], "path string, source string")
    got = {r.path: r.state for r in manifests.sidecars(files, sources, ".chunks.json").collect()}
    assert got == {"a.chunks.json": "found", "b.chunks.json": "orphan", "c.chunks.json": "found", "d.chunks.json": "unknown", "e.chunks.json": "found"}


def test_snapshots_keep_empty_folders(spark, tmp_path):
    source = tmp_path / "ws"
    made(str(source), "a.py", "sub/b.py", "node_modules/c.py")
    os.makedirs(source / "empty" / "inner")
    root = str(tmp_path / "snap")
    assert sessions.snapshot(spark, str(source), root) and not sessions.snapshot(spark, str(source), root)
    rows = {r.path.split("/ws/")[1]: r.size for r in sessions.latest(spark, root).collect()}
    assert rows == {"a.py": 4, "sub/b.py": 8, "empty/inner/": None}
    os.rmdir(source / "empty" / "inner")
    assert sessions.snapshot(spark, str(source), root) and len(sessions.versions(spark, root)) == 2


def test_lines_of_allowed_roots_only(spark, tmp_path):
    made(str(tmp_path), "in/a.txt", "in/deep/b.txt", "input/c.txt", "d.txt")
    path = [f"{tmp_path}/in/*.txt", f"{tmp_path}/in/deep/b.txt", f"{tmp_path}/input/c.txt", f"{tmp_path}/d.txt"]
    got = {r.line for p in path for r in files.text_lines(spark, p, [f"{tmp_path}/in"]).collect()}
    assert got == {"in/a.txt", "in/deep/b.txt"}
    assert {r.line for r in files.text_lines(spark, path[2], [f"file://{tmp_path}/input/", "/none"]).collect()} == {"input/c.txt"}
    assert files.text_lines(spark, path[2]).count() == 1 and files.text_lines(spark, path[2], []).count() == 0


def test_listing_of_uploads(spark):
    rows = [("a.pdf", 10), ("b.PDF", 1024), ("c.exe", 5), ("d.txt", 1587)]
    found = states.listing(spark.createDataFrame(rows, "f string, size long"), spark.createDataFrame([("b.PDF",)], "f string"), "f", (".pdf", ".txt"))
    assert sorted(map(tuple, found.collect())) == [("a.pdf", 0, "10B", False), ("b.PDF", 1, "1.0KB", True), ("d.txt", 1, "1.5KB", False)]
    ranks = spark.createDataFrame([(0, 2), (3, 0), (1, 1)], "i int, r int")
    assert [r.f for r in states.gathered(spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, f string"), ranks, "i", "r").collect()] == ["d.txt", "b.PDF", "a.pdf"]


def test_bounded_chunks(spark):
    rows = [("f", "big", 10, "\n".join(f"l{i}" for i in range(250))), ("f", "small", 1, "one"), ("f", "wide", 5, "w" * 30004), ("f", "edge", 1, "\n".join("x" * 120)), ("f", "none", 1, None)]
    got = sorted(tuple(r) for r in chunking.bounded(spark.createDataFrame(rows, "file string, name string, start int, text string")).select("name", "start", "end", "oversize").collect())
    assert got == [("big (part 1)", 10, 129, False), ("big (part 2)", 130, 249, False), ("big (part 3)", 250, 259, False), ("edge", 1, 120, False), ("small", 1, 1, False), ("wide", 5, 5, True)]


def test_call_features_and_a_saved_detector(spark, tmp_path):
    texts = ["call bash now <bash>ls</bash>", '<tool_call>{"tool": 1}</tool_call>', "[SYSTEM: x] ```a``` bash bash bash bash bash bash", "", None]
    marks = ml.call_features(F.col("t"), ["bash", "view"])
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(*marks.values()).collect()]
    assert got[:4] == [(0.6, 0.0, 1.0, 0.0, 0.0, 0.029), (0.0, 0.4, 0.0, 0.0, 0.0, 0.034), (1.0, 0.0, 0.0, 1.0, 1.0, 0.049), (0.0,) * 6]
    rows = [(i, f"{'good plain words' if i % 2 else '### $$$ junk %%'} {i}", i % 2) for i in range(60)]
    spark.createDataFrame(rows, "k int, t string, label int").write.parquet(str(tmp_path / "rows"))
    df = ml.with_features(spark.read.parquet(str(tmp_path / "rows")), "t")
    told = ml.train(df)
    told.save(str(tmp_path / "m"))
    again = ml.load(str(tmp_path / "m"))
    first, second = (sorted((r.k, round(r.p, 9), r.pred) for r in m.predict(df, "k").collect()) for m in (told, again))
    assert first == second and [p for _, _, p in first] == [i % 2 for i in range(60)]


def test_streams_of_repeated_rows(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, ts timestamp"
    later = [("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:10:00"), ("a", "2024-01-01 00:20:00")], [("a", "2024-01-01 00:30:00"), ("c", "2024-01-01 03:00:00")], [("b", "2024-01-01 00:00:01"), ("a", "2024-01-01 03:10:00"), ("a", "2024-01-01 03:20:00")]
    for n, rows in enumerate(later):
        spark.createDataFrame(rows, "k string, t string").select("k", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").json(source)
        stream = logs.first_seen(spark.readStream.schema(schema).json(source), ["k"], "ts", "1 hour")
        stream.writeStream.foreachBatch(lambda b, i: logs.append_index(b, i, sink)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.k, str(r.ts)[11:16]) for r in spark.read.parquet(sink).collect())
    # within the hour once; the late b is left out, a comes again once its state is gone
    assert got == [("a", "00:00"), ("a", "03:10"), ("b", "00:10"), ("c", "03:00")]
    before = spark.read.parquet(sink).count()
    logs.append_index(spark.createDataFrame([("z", None)], schema), 99, sink)
    logs.append_index(spark.createDataFrame([("z", None)], schema), 99, sink)
    assert spark.read.parquet(sink).count() == before + 1


def test_saved_vectors_tell_their_model(spark, tmp_path):
    root = str(tmp_path / "v")
    chunks = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "k int, vector array<double>")
    assert vector_index.load(spark, root, "m", 2) is None
    vector_index.save(chunks, root, "m", 2)
    assert vector_index.load(spark, root, "m", 2).count() == 2
    assert vector_index.load(spark, root, "other", 2) is None and vector_index.load(spark, root, "m", 3) is None
    with pytest.raises(Exception, match="3 elements"):
        vector_index.save(chunks, root, "m", 3)
    assert vector_index.load(spark, root, "m", 2).count() == 2
    vector_index.invalidate(spark, root)
    assert vector_index.load(spark, root, "m", 2) is None


def test_words_answer_where_vectors_do_not(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([(1, "alpha beta alpha"), (2, "beta gamma"), (3, "delta")], "k int, t string").write.parquet(path)
    index = bm25.current(spark.read.parquet(path), "k", "t", "hybrid")
    queries = spark.createDataFrame([(10, [1.0, 0.0], ["alpha"]), (11, [0.0, 1.0], ["beta", "beta"]), (12, None, ["delta", "none"]), (13, None, [])], "query_id int, vector array<double>, terms array<string>")
    one = {r.k: r.score for r in bm25.search(index, "k", ["beta", "beta"], 5).collect()}
    each = bm25.search_each(index, "k", queries, 5).collect()
    assert {r.k: r.score for r in each if r.query_id == 11} == one and [r.rank for r in each if r.query_id == 12] == [1]
    chunks = spark.createDataFrame([(1, 0, [1.0, 0.0])], "k int, id int, vector array<double>")
    got = sorted((r.query_id, r.hit, r.rank, r.method) for r in ingest.search_or_words(chunks, index, queries, "k").collect())
    by_words = [(11, str(k), n, "words") for n, k in enumerate(sorted(one, key=lambda k: (-one[k], k)), 1)]
    assert got == sorted([(10, "1:0", 1, "vectors"), *by_words, (12, "3", 1, "words")])
    assert {r.method for r in ingest.search_or_words(None, index, queries, "k").collect()} == {"words"}
