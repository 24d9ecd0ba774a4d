"""As-of joins, walks, nested tags and logs of changes against plain folds."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import ordered, paths, tags


def test_as_of_in_groups_of_any_size(spark):
    rng = random.Random(1)
    # one group holds most rows; ties on both sides, rows before any match, null groups and places
    right = [("hot" if rng.random() < 0.8 else f"g{rng.randrange(4)}", rng.randrange(300), i, f"v{i}") for i in range(600)]
    right += [(None, 5, 600, "x"), ("hot", None, 601, "x"), ("only right", 1, 602, "x")]
    left = [(i, "hot" if rng.random() < 0.8 else f"g{rng.randrange(5)}", rng.randrange(-5, 320)) for i in range(600)] + [(600, None, 9), (601, "hot", None), (602, "only left", 9)]
    l, r = spark.createDataFrame(left, "id int, g string, at int"), spark.createDataFrame(right, "g string, at int, n int, v string")
    got = {x.id: x.found.v if x.found else None for x in ordered.as_of(l, r, "g", "at", ("n",)).collect()}

    def want(g, at):
        fits = [(b, n, v) for h, b, n, v in right if g is not None and at is not None and h == g and b is not None and b <= at]
        return max(fits)[2] if fits else None

    assert got == {i: want(g, at) for i, g, at in left}


def batched(sizes, most_items, most_size):
    out, batch, items, total = [], 0, 0, 0
    for n in sizes:
        n = max(0, n or 0)
        if items and (items >= most_items or total + n > most_size):
            batch, items, total = batch + 1, 0, 0
        out.append(batch)
        items, total = items + 1, total + n
    return out


def test_greedy_batches_equal_a_loop(spark):
    rng = random.Random(2)
    groups = {"hot": [rng.choice((0, 0, 1, 5, 40, 99, 100, 101, 250, None, -3)) for _ in range(500)], "none": [0] * 40, "large": [500] * 9, "one": [7], None: [60, 60, 1], "last": [101, 0, 0, 100, 0, 1]}
    rows = [(g, i, n) for g, sizes in groups.items() for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "g string, i int, n int")
    got = {(r.g, r.i): r.batch for r in ordered.greedy_batches(df, "g", ["i"], "n", 7, 100).collect()}
    assert got == {(g, i): b for g, sizes in groups.items() for i, b in enumerate(batched(sizes, 7, 100))}


def test_spaced_rows_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.8 else f"g{rng.randrange(5)}", rng.randrange(2000)) for i in range(500)] + [(500, "null", None), (501, None, 4), (502, None, 5), (503, None, 40)]
    got = {r.id for r in ordered.spaced(spark.createDataFrame(rows, "id int, g string, at int"), "g", "at", ["id"], 10).collect()}
    last, want = {}, set()
    for i, g, at in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        if g not in last or at - last[g] >= 10:
            last[g] = at
            want.add(i)
    assert got == want


def stacked(text, name):
    """Outermost blocks by a stack, and tags without a body."""
    found, stack = [], []
    for m in re.finditer(rf"<{name}(?:\s[^>]*)?/?>|</{name}>", text):
        if m[0].startswith("</"):
            if stack:
                begin = stack.pop()
                if not stack:
                    found.append((name, begin.start(), m.end(), text[begin.end() : m.start()]))
        elif m[0].endswith("/>"):
            found.append((name, m.start(), m.end(), None))
        else:
            stack.append(m)
    return found


def test_blocks_equal_a_stack(spark):
    rng = random.Random(4)
    pieces = ["<a>", "</a>", "<b x='1'>", "</b>", "<a y=\"2\"/>", "<b/>", "é語", "text ", "<ab>", "</ab>", "<", "\n", "</a >"]
    texts = {i: "".join(rng.choices(pieces, k=rng.randrange(40))) for i in range(120)} | {500: "<a>" * 200 + "x" + "</a>" * 200, 501: "no tags", 502: None, 503: ""}
    df = spark.createDataFrame(list(texts.items()), "k int, t string")
    found = tags.blocks(df, "k", "t", ["a", "b"]).collect()
    got = sorted(((r.k, r.name, r.start, r.stop, None if r.single else texts[r.k][r.inner_start : r.inner_stop]) for r in found), key=repr)
    assert got == sorted(((k, *b) for k, t in texts.items() for name in "ab" for b in stacked(t or "", name)), key=repr)


def test_calls_in_tags(spark):
    tools, primary = {"search": (), "edit": ("file", "old"), "run": ()}, {"run": "command"}
    text = "x <search>a <search>b</search></search> <edit file='f' n=\"1\" n='2'><old>\nq\n</old></edit> <search query=\"z\"/> <other>1</other> <run> ls\n </run><run></run><search>a <search>b</search></search>"
    df = spark.createDataFrame([(1, text), (2, "<search>open"), (3, None), (4, "<edit><old a='b'>x</old ><file></file></edit>")], "k int, t string")
    calls = tags.parsed_calls(df, "k", "t", tools, primary).orderBy("k", "pos").collect()
    assert [(r.k, r.fn, r.args) for r in calls] == [
        (1, "search", {"query": "a <search>b</search>"}), (1, "edit", {"file": "f", "n": "2", "old": "q"}), (1, "search", {"query": "z"}), (1, "run", {"command": "ls"}), (1, "run", {"command": ""}),
        (4, "edit", {"file": "", "old": "x"}),
    ]
    assert [r.pos for r in calls][:2] == [2, text.index("<edit")]
    assert tags.parsed_calls(df, "k", "t", tools, primary, most=2).count() == 3
    plan = tags.parsed_calls(df, "k", "t", tools)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    left = df.select(tags.without_tags(F.col("t"), list(tools)).alias("x")).collect()
    assert [r.x for r in left] == ["x    <other>1</other> ", "open", None, ""]


def test_state_of_paths_equals_a_fold(spark):
    rng = random.Random(5)
    names = ["a", "b", "c"]
    log = [(i, rng.choice((paths.WRITE, paths.WRITE, paths.WRITE, paths.REMOVE, paths.MAKE, paths.CLEAR)), "/".join(rng.choices(names, k=rng.randrange(1, 5)))) for i in range(400)]
    log += [(400, paths.WRITE, None), (401, paths.WRITE, "")]
    state = {}
    for i, op, path in log:
        if not path:
            continue
        above = [path[:n] for n, c in enumerate(path) if c == "/"]
        if op in (paths.WRITE, paths.MAKE):
            state["file" if op == paths.WRITE else "folder", path] = i
            state.update({("folder", f): i for f in above})
        elif op == paths.REMOVE:
            state.pop(("file", path), None)
        else:
            state = {k: v for k, v in state.items() if not k[1].startswith(path + "/") and k != ("folder", path)}
    rng.shuffle(log)
    got = {(r.kind, r.path): r.since for r in paths.state(spark.createDataFrame(log, "seq int, op string, path string")).collect()}
    assert got == state and len(state) > 20


@pytest.mark.parametrize("count", [0, 1])
def test_walks_of_small_tables(spark, count):
    df = spark.createDataFrame([("g", 1, 5)] * count, "g string, i int, n int")
    assert [r.batch for r in ordered.greedy_batches(df, "g", ["i"], "n").collect()] == [0] * count
    assert ordered.spaced(df, "g", "n", ["i"], 3).count() == count
    assert ordered.as_of(df, df, "g", "n").where("found is null").count() == 0


def test_walks_broadcast_no_table_of_their_rows(spark):
    # the files of these rows are small, their rows in a driver's memory are not
    rows = spark.range(40_000).selectExpr("concat('g', id div 4) as g", "cast(id % 4 as int) as at", "id")
    kept = ordered.spaced(rows, "g", "at", ["id"], 2)
    joins = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in joins and "BroadcastHashJoin" not in joins
    assert kept.count() == 20_000
