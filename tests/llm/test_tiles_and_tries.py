"""Vector links, hard negatives and the prefix trie against brute force."""

import hashlib
import math
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import embeddings, negatives, prefix_trie


def parts(ids, links):
    root = {i: i for i in ids}

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = up(a), up(b)
        root[max(a, b)] = min(a, b)
    return {i: up(i) for i in ids}


def vectors():
    """Clusters of different tightness, a large one, exact copies, and every defined edge case."""
    rng = np.random.default_rng(5)
    rows = []
    for label in (0, 1, None, 2):
        for spread in (0.02, 0.2, 0.3, 0.35, 0.4):
            centre = rng.normal(size=16)
            rows += [(list(map(float, centre + spread * rng.normal(size=16) * np.linalg.norm(centre) / 4)), label) for _ in range(30)]
    rows += [(rows[3][0], 0)] * 4 + [(rows[3][0], 1)]  # copies, and one of another label
    nan, inf = math.nan, math.inf
    rows += [(None, 1), ([], 1), ([0.0] * 16, 1), ([None] + [1.0] * 15, 1), ([nan] + [1.0] * 15, 1), ([inf] + [1.0] * 15, 1)]
    rows += [([1e300] * 16, 2), ([1e-300] * 16, 2), ([2.0] * 16, 2), ([2.0] * 15, 2), ([3.0] * 15, 2), ([-2.0] * 16, 2)]
    return [(i, v, label) for i, (v, label) in enumerate(rows)]


def usable(v, zero=False):
    return v is not None and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))


def cosine(a, b):
    x, y = ([Fraction(v) for v in w] for w in (a, b))
    big, small = max(map(abs, x)), max(map(abs, y))
    p, q = ([float(v / m) for v in w] for w, m in ((x, big), (y, small)))
    return sum(s * t for s, t in zip(p, q, strict=True)) / (math.sqrt(sum(s * s for s in p)) * math.sqrt(sum(t * t for t in q)))


@pytest.mark.parametrize("kind,elements", [("float", 1 << 21), ("double", 256)])
def test_links_equal_brute_force(spark, kind, elements, monkeypatch):
    rows = vectors()
    if kind == "float":
        rows = [r for r in rows if not r[1] or max((abs(x) for x in r[1] if x), default=0) < 1e30 and all(x is None or x == 0 or not abs(x) < 1e-30 for x in r[1])]
        rows = [(i, v and [x if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumn("n_links", F.lit("clash"))
    got = {r.vec_id: r for r in embeddings.linked_vectors(df, elements=elements).collect()}
    fit = [r for r in rows if r[2] is not None and usable(r[1])]
    links = [(a[0], b[0]) for k, a in enumerate(fit) for b in fit[k + 1 :] if a[2] == b[2] and len(a[1]) == len(b[1]) and cosine(a[1], b[1]) >= embeddings.THRESHOLD]
    count = defaultdict(int)
    for a, b in links:
        count[a] += 1
        count[b] += 1
    part = parts([r[0] for r in rows], links)
    assert len(links) > 1000 and len(got) == len(rows)
    for i, _, _ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (count[i], part[i], part[i] == i), i


def test_links_of_null_and_repeated_ids(spark):
    v = [[1.0, 0.0], [1.0, 0.01], [0.0, 1.0], [1.0, 0.0], [-1.0, 0.0], [-1.0, 0.02]]
    ids = [None, 7, 7, 7, None, None]
    df = spark.createDataFrame([(i, x, "a") for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>, label string")
    got = sorted(map(tuple, embeddings.linked_vectors(df).collect()), key=repr)
    want = [(None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (7, 0, 7, True), (None, 1, None, True), (None, 1, None, True)]
    assert got == sorted(want, key=repr)
    assert embeddings.linked_vectors(df.limit(0)).count() == 0


def test_quantisation_bound_holds():
    rng = np.random.default_rng(1)
    for scale in (1, 1e6):
        x = rng.normal(size=(300, 24)) * np.exp(rng.normal(size=(300, 1)) * 3) * scale
        x[:, 0] *= 40
        codes, s, length, error = embeddings.quantised(x)
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        coded = (codes.astype(np.int64) @ codes.T.astype(np.int64)) * s[:, None] * s
        bound = length[:, None] * error + error[:, None] * length + error[:, None] * error
        assert (np.abs(u @ u.T - coded) <= bound + embeddings.SLACK).all()


def brute_negatives(rows, anchors):
    rows = sorted((i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if i is not None and label is not None and usable(v, zero=True))
    found = []
    for n, (i, label, v) in enumerate(rows):
        if not anchors(i):
            continue
        score = [(-sum(x * y for x, y in zip(v, w, strict=True)), j, other) for m, (j, other, w) in enumerate(rows) if m != n and len(w) == len(v)]
        for s, j, _ in sorted(x for x in score if x[2] == label)[:5]:
            fits = sorted((t, k) for t, k, other in score if other != label and 80 * -s <= 100 * -t <= 100 * -s)[:5]
            found += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(fits, 1)]
    return sorted(found)


@pytest.mark.parametrize("elements", [(1 << 20, 1 << 18), (160, 64)])
def test_negatives_equal_brute_force(spark, elements, monkeypatch):
    monkeypatch.setattr(negatives.tiles, "TILE_ROWS", 16)
    rng = np.random.default_rng(3)
    rows = [(i, list(map(float, np.round(rng.normal(size=8) * 0.2 + 0.1, 2))), int(rng.integers(3))) for i in range(400)]
    rows += [(i, rows[i % 50][1], i % 3) for i in range(400, 460)]  # ties
    nan = math.nan
    rows += [(460, None, 1), (470, [nan] * 8, 1), (480, [None] * 8, 1), (490, [1.0] * 8, None), (None, [1.0] * 8, 1), (500, [1.0] * 3, 1), (510, [0.9] * 3, 2), (520, [], 1), (530, [], 2), (540, [], 1), (550, [1.0] * 3, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rank", F.lit("clash"))
    got = negatives.mined_negatives(df, F.col("id") % 10 == 0, tile_elements=elements[0], block_elements=elements[1])
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 500 and sorted(map(tuple, got.collect())) == want
    assert negatives.mined_negatives(df.limit(0), F.col("id") % 10 == 0).count() == 0


@pytest.mark.parametrize("low,high", [(-3, 3), (-146, 150), (0, 1 << 20), (-(1 << 28), 1 << 28), ((1 << 29), (1 << 29) + 5), (7, 8), (-(1 << 31), 1 << 30)])
def test_packed_products_are_exact(low, high):
    rng = np.random.default_rng(2)
    a, r = (rng.integers(low, high, size=(n, 5)) for n in (7, 33))
    assert [s.tolist() for s in negatives.scores(a, r)] == [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in r] for p in a]
    if high == 1 << 30:
        with pytest.raises(OverflowError):
            list(negatives.scores(np.full((2, 5), 1 << 40), np.full((3, 5), 1 << 40)))


def conversations():
    rows = []

    def talk(conv, *texts):
        rows.extend((conv, n, "user" if n % 2 else "assistant", t) for n, t in enumerate(texts))

    for c in range(0, 60):
        talk(c, *(f"{w} words here {w}" for w in ("hello", "how", "fine", str(c % 4), str(c % 7))[: c % 6]))
    talk(100, "a", "b", "c")  # the root of 101 to 119
    for c in range(101, 110):
        talk(c, "a", "b", "c", "d")
    talk(200, *("x",) * 40)
    talk(201, *("x",) * 40, "y")
    talk(202, *("x",) * 21, "z", *("x",) * 9)
    for c in (301, 302, 303, 304):  # no root of theirs: some are left without turns
        talk(c, "only")
    talk(-25, "minus", "below", "zero", "tail")
    rows.extend([(400, None, None, None), (400, 2, "user", ""), (400, 2, "user", ""), (401, None, "", None), (None, 1, "user", "lost"), (500, 1, "user", "long text " * 3000), (500, 0, "user", "first")])
    return rows


def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    path = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        root = c - int(math.fmod(c, 20))
        path[c] = tuple(own.get(root, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, p in path.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    found, sums = {}, {}
    for p in sorted(members, key=len, reverse=True):
        kids = children[p]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved = (len(members[p]) - 1) * words + sum(sums[k][1] for k in kids)
        leaves = sum(sums[k][0] for k in kids) if kids else 1
        sums[p] = leaves, saved
        ends = ",".join(map(str, sorted(c for c in members[p] if path[c] == p)))
        found[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(found.values(), key=repr)


@pytest.mark.parametrize("band,shard", [(256, 1 << 14), (3, 8), (1, 64)])
def test_trie_equals_brute_force(spark, band, shard):
    df = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash"))
    got = prefix_trie.prefix_trie(df, band=band, shard_turns=shard)
    want = brute_trie(conversations())
    assert len(want) > 80 and sorted(map(tuple, got.collect()), key=repr) == want
    if band == 256:
        assert prefix_trie.prefix_trie(df.limit(0)).count() == 0


def test_hot_ends_are_hashed_in_pieces(spark):
    ends = spark.range(0, 5000).select(F.lit(2).cast("long").alias("depth"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(1).alias("p1"), F.lit(3).cast("long").alias("p2"), (F.col("id") * 7 % 5003).alias("conv"))
    rows = [tuple(r) for r in ends.collect()]
    want = defaultdict(list)
    for _, p, _, c in rows:
        want[p].append(c)
    got = {r.p1: r.ends_sha256 for r in prefix_trie.ends_hashes(ends, joined=100).collect()}
    assert got == {p: hashlib.sha256(",".join(map(str, sorted(c))).encode()).hexdigest() for p, c in want.items()}


def test_double_array_walks_what_was_added():
    rng = np.random.default_rng(4)
    paths = {tuple(rng.integers(1, 50, size=rng.integers(1, 6)).tolist()) for _ in range(2000)}
    trie, state = prefix_trie.DoubleArray(), {(): 0}
    for depth in range(1, 6):
        level = sorted({p[:depth] for p in paths if len(p) >= depth}, key=lambda p: (state[p[:-1]], p[-1]))
        parents, codes = np.array([state[p[:-1]] for p in level]), np.array([p[-1] for p in level])
        trie.add(parents, codes)
        state.update(zip(level, trie.step(parents, codes).tolist(), strict=True))
    assert len(set(state.values())) == len(state) and -1 not in state.values()
    for p in paths:
        for code in range(1, 50):
            assert (int(trie.step(np.array([state[p]]), np.array([code]))[0]) != -1) == (p + (code,) in state)
    assert isinstance(pa.array(trie.check), pa.Array) and trie.used < 3 * len(state)
