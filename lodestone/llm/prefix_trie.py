"""Conversation prefix tries, packed into double arrays a shard at a time.

A rebuilt conversation is a path of turns. Paths are cut into pieces of at
most ``band`` turns and dealt to shards by what they start with; a start that
holds more turns than a shard may is salted by conversation. A shard numbers
its distinct turns densely and packs its paths into BASE and CHECK arrays: the
child of state s by turn t is the place BASE[s] + t, if CHECK there is s. One
pass walks all pieces through the arrays and returns the shard's nodes with
their members and smallest conversation; nodes that several shards share
(upper ones of a salted start) are merged by their prefix's hash. Each node's
own saving, and a one for each childless node, then go to the node's smallest
conversation, and a second pass adds them up from the ends of the paths.

A prefix is told by 128 bits, the exclusive or of hashes of its turns and their
depths; equal hashes are taken as equal prefixes.

The members that end at a node are hashed as a stream over sorted pieces of
joined ids, so that a node where a third of all conversations end needs no
memory.

Defined edge cases: rows with a null conv_id belong to no conversation; a null
role or text is empty; turns of equal number are ordered by their hash, null
numbers first; repeated rows are turns each; an empty table gives no rows; a
text or a conversation may have any length; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm._shared import bounded_batches, small, table, written
from lodestone.llm._text import trimmed
from lodestone.operators.ordered import running_total

#: Turns of a piece, and of a shard, at most; characters of joined ids in a row.
BAND, SHARD_TURNS, JOINED = 256, 1 << 14, 1 << 16
#: Places tried for a node of several children before the array is lengthened.
TRIES = 64
_KEY = ["depth", "p1", "p2"]
_NODE = "depth bigint, p1 bigint, p2 bigint, q1 bigint, q2 bigint, n bigint, least bigint, words bigint"
_SUM = "depth bigint, p1 bigint, p2 bigint, saved bigint, leaves bigint"


class DoubleArray:
    """A trie of paths of codes from 1 on; states are places in BASE and CHECK, the root is 0."""

    def __init__(self) -> None:
        self.base, self.check = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        self.used, self.low = 1, 1  # beyond the last used place; no place below is free

    def _room(self, n: int) -> None:
        if n > len(self.check):
            more = max(n, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.append(self.base, np.zeros(more, dtype=np.int64)), np.append(self.check, np.full(more, -1))

    def _free(self, n: int) -> np.ndarray:
        """The first n free places."""
        found = self.low + np.flatnonzero(self.check[self.low : self.used] < 0)[:n]
        self.low = int(found[0]) if len(found) else self.used
        return np.append(found, np.arange(self.used, self.used + n - len(found)))

    def _take(self, places: np.ndarray, parents: np.ndarray) -> None:
        self._room(int(places.max()) + 1)
        self.check[places] = parents
        self.used = max(self.used, int(places.max()) + 1)

    def add(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """Children of states that have none yet: distinct pairs, ordered by parent and code."""
        first = np.flatnonzero(np.diff(parents, prepend=-1))
        count = np.diff(np.append(first, len(parents)))
        for at, n in zip(first[count > 1].tolist(), count[count > 1].tolist(), strict=True):
            apart = codes[at : at + n] - codes[at]
            tried = self._free(TRIES)
            self._room(int(tried[-1] + apart[-1]) + 1)
            fits = (self.check[tried[:, None] + apart] < 0).all(axis=1)
            place = int(tried[fits.argmax()]) if fits.any() else self.used
            self.base[parents[at]] = place - codes[at]
            self._take(place + apart, parents[at : at + n])
        one = first[count == 1]
        if len(one):
            places = self._free(len(one))
            self.base[parents[one]] = places - codes[one]
            self._take(places, parents[one])

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states' children by the codes; -1 where there is none."""
        to = self.base[states] + codes
        inside = (to > 0) & (to < self.used)
        return np.where(inside & (self.check[np.where(inside, to, 0)] == states), to, -1)


def dense(*columns: np.ndarray) -> np.ndarray:
    """Numbers from 0 that tell the rows of the columns apart."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), dtype=bool)
    for c in columns:
        new[1:] |= np.diff(c[order]) != 0
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new)
    return number


class Shard:
    """The pieces of a shard, their trie, and for each turn the node it leads to."""

    def __init__(self, rows: pa.Table):
        def flat(name: str) -> np.ndarray:
            return rows.column(name).combine_chunks().to_numpy()

        lists = rows.column("turns").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        self.conv, self.band, p1, p2 = flat("conv"), flat("band"), flat("s1").copy(), flat("s2").copy()
        self.length = lists.value_lengths().to_numpy().astype(np.int64)
        self.end = np.cumsum(self.length)
        turns = lists.flatten()
        self.piece = np.repeat(np.arange(len(self.length)), self.length)
        ka, kb, m1, m2, self.depth, self.words = (turns.field(c).to_numpy() for c in ("ka", "kb", "m1", "m2", "d", "words"))
        code = dense(ka, kb) + 1
        start = dense(self.band, p1, p2) + int(code.max()) + 1
        trie = DoubleArray()
        state = np.zeros(len(self.conv), dtype=np.int64)
        # each piece's start is a child of the root, its turns follow
        self.node, self.p, self.q = (np.empty((2, len(code)), dtype=np.int64) for _ in range(3))
        for level in range(int(self.length.max()) + 1):
            on = np.flatnonzero(self.length >= level)
            at = self.end[on] - self.length[on] + level - 1
            codes = code[at] if level else start[on]
            order = np.lexsort((codes, state[on]))
            pairs = np.stack([state[on][order], codes[order]])
            new = np.append(True, (np.diff(pairs) != 0).any(axis=0))
            trie.add(*pairs[:, new])
            state[on] = trie.step(state[on], codes)
            if level:
                self.node[0, at] = state[on]
                self.q[:, at] = p1[on], p2[on]
                p1[on] ^= m1[at]
                p2[on] ^= m2[at]
                self.p[:, at] = p1[on], p2[on]
        self.node = self.node[0]

    def by_node(self) -> tuple[np.ndarray, np.ndarray]:
        """A turn that leads to each node, and for each turn the number of its node."""
        _, first, number = np.unique(self.node, return_index=True, return_inverse=True)
        return first, number


def _table(ddl: str, *columns: np.ndarray) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=[x.split()[0] for x in ddl.split(", ")])


def _nodes(rows: pa.Table) -> pa.Table:
    s = Shard(rows)
    first, number = s.by_node()
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, number, s.conv[s.piece])
    return _table(_NODE, s.depth[first], *s.p[:, first], *s.q[:, first], np.bincount(number), least, s.words[first])


def _sums(rows: pa.Table) -> pa.Table:
    """What the own values of nodes add up to at all nodes above them, and themselves."""
    s = Shard(rows)
    first, number = s.by_node()
    values = rows.column("own").combine_chunks()
    values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
    of = np.repeat(np.arange(len(s.conv)), values.fill_null([]).value_lengths().to_numpy())
    own = values.fill_null([]).flatten()
    at = s.end[of] - s.length[of] + own.field("depth").to_numpy() - s.depth[s.end[of] - s.length[of]]
    added = []
    for name in ("saved", "leaves"):
        each = np.zeros(len(s.piece), dtype=np.int64)
        each[at] = own.field(name).to_numpy()
        upto = np.cumsum(each)
        below = upto[s.end[s.piece] - 1] - upto + each + rows.column(f"later_{name}").to_numpy()[s.piece]
        total = np.zeros(len(first), dtype=np.int64)
        np.add.at(total, number, below)
        added.append(total)
    return _table(_SUM, s.depth[first], *s.p[:, first], *added)


def _joined_ids(piece: int):
    """Runs of a node's ids, as joined text, of rows sorted by node and id."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy() for i in range(3)])
            conv = batch.column(3).to_numpy()
            edges = np.append(np.flatnonzero(np.append(True, (np.diff(key) != 0).any(axis=0))), len(conv))
            cuts = np.concatenate([np.arange(a, b, piece) for a, b in zip(edges[:-1], edges[1:], strict=True)])
            texts = [",".join(map(str, conv[a:b].tolist())) for a, b in zip(cuts, np.append(cuts[1:], len(conv)), strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(k[cuts]) for k in key), pa.array(conv[cuts]), pa.array(texts)], names=[*_KEY, "conv", "ids"])

    return trimmed(join)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's texts, of rows sorted by node and first id; one hash is open at a time."""
    key, state = None, None

    def told(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([r[0][i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[1] for r in rows], pa.string())], names=[*_KEY, "ends_sha256"])

    for batch in batches:
        done = []
        for *now, ids in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids")), strict=True):
            if now == key:
                state.update(b",")
            else:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state = now, hashlib.sha256()
            state.update(ids.encode())
        yield told(done)
    if key is not None:
        yield told([(key, state.hexdigest())])


def ends_hashes(ends: DataFrame, joined: int = JOINED) -> DataFrame:
    """depth, p1, p2, ends_sha256 of every node at which a path (depth, p1, p2, conv) ends."""
    dealt = ends.select(*_KEY, "conv").repartitionByRange(*_KEY, "conv").sortWithinPartitions(*_KEY, "conv")
    texts = dealt.mapInArrow(_joined_ids(max(1, joined // 20)), "depth bigint, p1 bigint, p2 bigint, conv bigint, ids string")
    return texts.repartition(*_KEY).sortWithinPartitions(*_KEY, "conv").mapInArrow(trimmed(_hashed), "depth bigint, p1 bigint, p2 bigint, ends_sha256 string")


def rebuilt_turns(turns: DataFrame, group: int, head: int) -> tuple[DataFrame, DataFrame]:
    """(conv, d, ka, kb, words) of the rebuilt conversations, from numbered original turns (conv, at, ka, kb, words), and (conv) of all."""
    kept = F.crc32(F.col("conv").cast("string").cast("binary")) % (head + 1)
    root = F.col("conv") - F.col("conv") % group
    heads = turns.where((F.col("conv") % group == 0) & (F.col("at") <= head)).groupBy(F.col("conv").alias("root"))
    heads = heads.agg(F.array_sort(F.collect_list(F.struct("at", "ka", "kb", "words"))).alias("first"))  # at most ``head`` turns each
    convs = turns.select("conv").distinct().select("conv", kept.cast("int").alias("h"), root.alias("root")).join(heads, "root", "left")
    convs = written(convs.select("conv", "h", F.coalesce(F.slice("first", 1, F.col("h")), F.array()).alias("first")), "conversations")
    lent = convs.select("conv", F.explode("first").alias("t")).select("conv", F.col("t.at").alias("d"), "t.ka", "t.kb", "t.words")
    own = turns.join(convs.select("conv", "h", F.size("first").alias("lent")), "conv").where("at > h").select("conv", (F.col("at") - F.col("h") + F.col("lent")).alias("d"), "ka", "kb", "words")
    return lent.unionByName(own), convs.select("conv")


def prefix_trie(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", group: int = 20, head: int = 3, band: int = BAND, shard_turns: int = SHARD_TURNS
) -> DataFrame:
    """The nodes of the rebuilt conversations' prefix trie.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node.
    A conversation c starts with the first h = crc32(c) mod (``head`` + 1) turns of c - c mod ``group`` in the place of its own.
    ``band`` and ``shard_turns`` bound pieces and shards; they change the tasks, not the result.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turns = rows.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("ka"), F.xxhash64(F.lit(1), text, role).alias("kb"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"), F.lit(1).cast("bigint").alias("one"),
    )
    turns = written(running_total(turns, "conv", ["turn", "ka", "kb"], "one", "at").drop("turn", "one"), "turns")
    path, convs = rebuilt_turns(turns, group, head)
    marked = path.select("*", F.xxhash64("d", "ka", "kb").alias("m1"), F.xxhash64("kb", "ka", "d").alias("m2"), F.floor((F.col("d") - 1) / band).alias("band"))
    cut = marked.groupBy("conv", "band").agg(F.array_sort(F.collect_list(F.struct("d", "ka", "kb", "m1", "m2", "words"))).alias("turns"), F.bit_xor("m1").alias("x1"), F.bit_xor("m2").alias("x2"))
    cut = written(cut, "cut")
    ends = cut.groupBy("conv").agg(F.sum(F.size("turns")).alias("depth"), F.bit_xor("x1").alias("p1"), F.bit_xor("x2").alias("p2"), F.max("band").alias("last"))
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in (*_KEY, "last")]
    ends = written(convs.join(ends, "conv", "left").select("conv", *zero), "ends")

    # where pieces start: only conversations of several pieces need a look back
    several = small(written(ends.where("last > 0").select("conv"), "several"))
    before = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.join(several, "conv", "left_semi").select("conv", "band", F.bit_xor("x1").over(before).alias("s1"), F.bit_xor("x2").over(before).alias("s2"))
    started = cut.drop("x1", "x2").join(small(written(starts, "starts")), ["conv", "band"], "left")
    begin = F.struct("band", "s1", "s2", F.col("turns")[0]["ka"], F.col("turns")[0]["kb"])
    started = started.withColumns({"s1": F.coalesce("s1", F.lit(0)), "s2": F.coalesce("s2", F.lit(0))}).withColumn("begin", F.xxhash64(begin))
    started = written(started, "started")
    total = started.agg(F.sum(F.size("turns"))).first()[0] or 0
    large = written(started.groupBy("begin").agg(F.sum(F.size("turns")).alias("n")).where(F.col("n") > shard_turns // 4).select("begin", F.ceil(F.col("n") * 4 / shard_turns).alias("salts")), "large")
    salt = F.pmod(F.xxhash64("conv", "band"), F.coalesce("salts", F.lit(1)))
    pieces = started.join(small(large), "begin", "left").withColumn("shard", F.pmod(F.xxhash64("begin", salt), F.lit(-(-total // shard_turns) or 1))).drop("begin", "salts")
    pieces = written(pieces, "pieces")

    merged = pieces.groupBy("shard").applyInArrow(_nodes, _NODE).groupBy(*_KEY).agg(*(F.first(c).alias(c) for c in ("q1", "q2", "words")), F.sum("n").alias("n"), F.min("least").alias("least"))
    merged = written(merged, "nodes")
    whole = ends.agg(F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("p1"), F.lit(0).cast("bigint").alias("p2"), F.lit(None).cast("bigint").alias("q1"), F.lit(None).cast("bigint").alias("q2"), F.lit(0).cast("bigint").alias("words"), F.count("*").alias("n"), F.min("conv").alias("least"))
    children = merged.groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    tree = merged.unionByName(whole.where("n > 0")).join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = {"saved": (F.col("n") - 1) * F.col("words"), "leaves": (F.col("n_children") == 0).cast("bigint")}
    tree = written(tree.withColumns(own), "tree")

    values = tree.where("depth > 0 and (saved > 0 or leaves > 0)").groupBy(F.col("least").alias("conv"), F.floor((F.col("depth") - 1) / band).alias("band"))
    values = values.agg(F.collect_list(F.struct("depth", "saved", "leaves")).alias("own"), F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))  # at most a piece's turns each
    valued = pieces.join(values, ["conv", "band"], "left")
    after = Window.partitionBy("conv").orderBy("band").rowsBetween(1, Window.unboundedFollowing)
    later = valued.join(several, "conv", "left_semi").select("conv", "band", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"later_{c}") for c in ("saved", "leaves")))
    valued = valued.join(small(written(later, "later")), ["conv", "band"], "left").withColumns({f"later_{c}": F.coalesce(f"later_{c}", F.lit(0)) for c in ("saved", "leaves")})
    valued = valued.where("own is not null or later_saved > 0 or later_leaves > 0").drop("saved", "leaves")
    below = valued.groupBy("shard").applyInArrow(_sums, _SUM).groupBy(*_KEY).agg(F.sum("saved").alias("n_saved"), F.sum("leaves").alias("n_leaves"))
    every = tree.agg(*(F.lit(0).cast("bigint").alias(c) for c in _KEY), F.sum("saved").alias("n_saved"), F.sum("leaves").alias("n_leaves"))  # the root has them all

    parents = tree.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("least").alias("parent_conv_id")).where("depth > 1")
    top = tree.where("depth = 0").select(F.col("least").alias("top"))  # one row
    told = tree.join(below.unionByName(every), _KEY, "left").join(ends_hashes(ends), _KEY, "left").join(parents, ["depth", "q1", "q2"], "left").crossJoin(F.broadcast(top))
    return told.select(
        F.col("least").alias("conv_id"), "depth", F.when(F.col("depth") == 1, F.col("top")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        "n_leaves", F.col("n_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op13_double_array_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op13_double_array_trie": op13_double_array_trie}
ORACLES = {
    "op13_double_array_trie": r"""
WITH g AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT unnest(range(256)) AS i))),
t AS MATERIALIZED (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS at_, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
h AS MATERIALIZED (SELECT c, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda a, b: xor(a >> 8, crc[xor(a & 255, b) + 1]))) % 4 AS h FROM (SELECT DISTINCT c FROM t), g),
o AS (SELECT h.c, t.at_ AS place, role, text FROM h JOIN t ON t.c = h.c - h.c % 20 AND t.at_ <= h.h UNION ALL SELECT h.c, t.at_ + 3, role, text FROM h JOIN t ON t.c = h.c AND t.at_ > h.h),
p AS (SELECT c, list({'role': role, 'text': text} ORDER BY place) AS path FROM o GROUP BY c),
r AS (SELECT h.c, coalesce(path, []) AS path FROM h LEFT JOIN p ON p.c = h.c),
m AS MATERIALIZED (SELECT c, d, list_slice(path, 1, d) AS node, list_slice(path, 1, d - 1) AS up, len(path) = d AS ends, coalesce(len(regexp_extract_all(path[d].text, '[^\x20\x09-\x0D]+')), 0) AS words
  FROM (SELECT c, path, unnest(range(len(path) + 1)) AS d FROM r)),
n AS MATERIALIZED (SELECT node, d, first(up) AS up, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS own,
  sha256(coalesce(string_agg(CASE WHEN ends THEN c::VARCHAR END, ',' ORDER BY c), '')) AS ends_sha256 FROM m GROUP BY node, d),
k AS (SELECT up AS node, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY up, d),
w AS MATERIALIZED (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.node = n.node AND k.d = n.d),
s AS (SELECT m.node, m.d, sum(w.own) AS saved, sum(CASE WHEN w.n_children = 0 THEN 1 ELSE 0 END) AS leaves FROM w JOIN m ON m.c = w.conv_id AND m.d <= w.d GROUP BY m.node, m.d)
SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN s ON s.node = w.node AND s.d = w.d LEFT JOIN n u ON w.d > 0 AND u.node = w.up AND u.d = w.d - 1
""",
}
