"""Language-model scoring by context-tree weighting.

Bytes are coded bit by bit: the node of a bit is the bits of its byte so far
under the last d bytes, for every depth d from 0 to ``DEPTH``. Each node holds a
Krichevsky-Trofimov estimate from all training texts; a node's weighted
probability is half its own estimate and half the product of its children's.
The posterior weights of the nodes on a context's path mix their predictions,
and the mixed predictions of a text's bits, and of an end byte, multiply to its
probability. All that training needs is how often each gram of DEPTH + 1 bytes
occurs, so counting is a Spark aggregation over all training texts, the tree is
built subtree by subtree, and only depths 0 and 1 (at most 2^16 nodes each)
reach the driver.

Each chunk of documents asks hash shards for its own words and grams, so no
vocabulary or model is broadcast.

Defined edge cases: null and empty texts consist of the end alone; rows with a
null id are training rows; repeated rows count and are scored each; with no
training rows every bit has probability 1/2. Texts are A-Z lower-cased.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import _chunks as C
from lodestone.llm import _text as T
from lodestone.llm._shared import table, written

DEPTH = 4
FOLDS = 5
WORDS, GRAMS = 0, 1
_MUL = 0x9E3779B97F4A7C15  # odd, so keys and grams are one to one
_INVERSE = np.uint64(pow(_MUL, -1, 1 << 64))
_ASKED = "kind int, shard bigint, chunk bigint, keys binary, counts binary"
LN2, LN10 = np.log(2.0), np.log(10.0)


def held_out(ids: pa.Array, folds: int = FOLDS) -> np.ndarray:
    return np.array([x is not None and zlib.crc32(str(x).encode()) % folds == 1 for x in ids.to_pylist()], dtype=bool)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the gram that ends at each byte and at each text's end, first of each text)."""
    docs = len(offsets) - 1
    first = offsets + np.arange(docs + 1)
    x = np.zeros(int(first[-1]), dtype=np.uint64)
    x[np.arange(len(data)) + np.repeat(np.arange(docs), np.diff(offsets))] = T.LOWER[data]
    code = x.copy()
    for d in range(1, DEPTH + 1):
        code[d:] |= x[:-d] << np.uint64(8 * d)
    for j in range(DEPTH - 1, -1, -1):  # no context before a text's beginning
        at = first[:-1] + j
        code[at[at < first[1:]]] &= np.uint64((1 << (8 * (j + 1))) - 1)
    return code * np.uint64(_MUL), first


def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the words, each text followed by the end, which is key 0; first of each text)."""
    words = T.cut(data, offsets, T.SPACED)
    docs = len(offsets) - 1
    first = words.first + np.arange(docs + 1)
    keys = np.zeros(int(first[-1]), dtype=np.uint64)
    keys[np.arange(len(words.starts)) + words.doc] = T.word_hashes(data, words, lower=True)
    return keys, first


_KEYS = {WORDS: word_keys, GRAMS: grams}


class _Counter:
    """Distinct keys with summed counts."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray, weight: np.ndarray) -> None:
        """weight: per key 1 if it counts, 0 if it is only asked for."""
        codes, found = pd.factorize(keys)
        counts = np.bincount(codes, weight, len(found)).astype(np.int64)
        self.keys, inverse = np.unique(np.concatenate([self.keys, found]), return_inverse=True)
        self.counts = np.bincount(inverse, np.concatenate([self.counts, counts]), len(self.keys)).astype(np.int64)


def _ask(kinds: tuple[int, ...], bits: int, folds: int):
    def ask(key, texts):
        ids, column = C.opened(texts)
        train = ~held_out(ids, folds)
        found = {kind: _Counter() for kind in kinds}
        for lo, hi, data, offsets in T.slices(column):
            for kind in kinds:
                keys, first = _KEYS[kind](data, offsets)
                found[kind].add(keys, np.repeat(train[lo:hi], np.diff(first)).astype(np.float64))
        rows = [(kind, i, k, n) for kind, c in found.items() for i, k, n in C.split(C.shard_edges(c.keys, bits), c.keys, c.counts)]
        names = (("kind", pa.int32()), ("shard", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()))
        out = {n: pa.array([r[j] for r in rows], t) for j, (n, t) in enumerate(names)}
        return pa.table({"kind": out["kind"], "shard": out["shard"], "chunk": pa.array([key[0].as_py()] * len(rows), pa.int64()), "keys": out["keys"], "counts": out["counts"]})

    return ask


def _merge(key, asked):
    """Words: each chunk's row answered with total counts. Grams: the shard's distinct grams and total counts."""
    keys, sizes = C.joined(asked, "keys", np.uint64)
    counts, _ = C.joined(asked, "counts", np.int64)
    found, inverse = np.unique(keys, return_inverse=True)
    totals = np.bincount(inverse, counts, len(found)).astype(np.int64)
    kind, shard = key[0].as_py(), key[1].as_py()
    if kind == WORDS:
        values, chunks = [x.tobytes() for x in C.parts(totals[inverse], sizes)], asked.column("chunk").to_pylist()
        names = [None] * len(chunks)
    else:
        values, chunks, names = [totals.tobytes()], [None], [found.tobytes()]
    fresh = [int(np.count_nonzero(totals))] + [0] * (len(chunks) - 1)
    seen = [int(totals.sum())] + [0] * (len(chunks) - 1)
    return pa.table(
        {
            "kind": pa.array([kind] * len(chunks), pa.int32()), "shard": pa.array([shard] * len(chunks), pa.int64()), "chunk": pa.array(chunks, pa.int64()),
            "keys": pa.array(names, pa.binary()), "values": pa.array(values, pa.binary()), "fresh": pa.array(fresh, pa.int64()), "seen": pa.array(seen, pa.int64()),
        }
    )


def _flat(batches):
    """(gram, n) of packed rows."""
    for batch in batches:
        for keys, counts in zip(batch.column(0), batch.column(1), strict=True):
            code = np.frombuffer(keys.as_buffer(), np.uint64) * _INVERSE
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(np.frombuffer(counts.as_buffer(), np.int64))], names=["gram", "n"])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 8, brought back by the recurrence."""
    shift = np.zeros_like(x)
    for i in range(8):
        shift += np.log(x + i)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - np.log(np.pi)


class _Nodes:
    """The nodes of one depth: log KT, prediction of a one, and, once known, log weighted probability."""

    def __init__(self, ids: np.ndarray, bit: np.ndarray, n: np.ndarray):
        self.ids, self.at = np.unique(ids, return_inverse=True)
        size = len(self.ids)
        ones, zeros = np.bincount(self.at, n * bit, size), np.bincount(self.at, n * (1 - bit), size)
        self.kt, self.one = log_kt(zeros, ones), (ones + 0.5) / (zeros + ones + 1)
        self.weighted = self.kt

    def mix_children(self, below: np.ndarray) -> None:
        self.weighted = np.logaddexp(self.kt, below) - LN2

    @property
    def stop(self) -> np.ndarray:
        return np.exp(self.kt - self.weighted - LN2)


def _bits(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(gram, 8) bits of the last byte, and the nodes they are decided at: 1 and the bits before."""
    byte = (gram & 0xFF)[:, None]
    k = np.arange(8)[None, :]
    return ((byte >> (7 - k)) & 1).astype(np.float64), (1 << k) | (byte >> (8 - k))


def _deep(gram: np.ndarray, n: np.ndarray) -> tuple[list[_Nodes], np.ndarray]:
    """Nodes of depths 2 to DEPTH of grams that share their last two context bytes, weighted from below."""
    bit, node = _bits(gram)
    each = np.repeat(n.astype(np.float64), 8)
    levels = []
    for d in range(2, DEPTH + 1):
        context = (gram >> 8) & ((1 << (8 * d)) - 1)
        levels.append(_Nodes(((context[:, None] << 8) | node).ravel(), bit.ravel(), each))
    for upper, lower in zip(levels[-2::-1], levels[:0:-1], strict=True):
        depth = 2 + levels.index(upper)
        parent = np.searchsorted(upper.ids, lower.ids & ((1 << (8 * depth + 8)) - 1))
        upper.mix_children(np.bincount(parent, lower.weighted, len(upper.ids)))
    return levels, bit


def _roots(key, table):
    """Sums that depths 0 and 1 need: counts of byte pairs (kind 0), log weighted probabilities of depth-2 nodes (kind 1)."""
    gram, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
    levels, _ = _deep(gram, n)
    top = levels[0]
    pair, at = np.unique(gram & 0xFFFF, return_inverse=True)
    ids = np.concatenate([pair, top.ids & 0xFFFF])
    values = np.concatenate([np.bincount(at, n.astype(np.float64), len(pair)), top.weighted])
    return pa.table({"kind": pa.array(np.repeat([0, 1], [len(pair), len(top.ids)]).astype(np.int32)), "id": pa.array(ids), "value": pa.array(values)})


def _shallow(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(weight, prediction) of the 256 nodes of depth 0 and the 2^16 of depth 1."""
    pairs, below = np.zeros(1 << 16), np.zeros(1 << 16)
    for r in rows:
        (pairs if r.kind == 0 else below)[r.id] = r.value
    every = np.arange(1 << 16)
    bit, node = _bits(every)
    one = _Nodes((((every >> 8)[:, None] << 8) | node).ravel(), bit.ravel(), np.repeat(pairs, 8))
    one.mix_children(below[one.ids])
    zero = _Nodes(node.ravel(), bit.ravel(), np.repeat(pairs, 8))
    zero.mix_children(np.bincount(np.searchsorted(zero.ids, one.ids & 0xFF), one.weighted, len(zero.ids)))
    out = []
    for nodes, size in ((zero, 1 << 8), (one, 1 << 16)):
        stop, guess = np.ones(size), np.full(size, 0.5)
        stop[nodes.ids], guess[nodes.ids] = nodes.stop, nodes.one
        out += [stop, guess]
    return tuple(out)


def _predict(shallow, bits: int):
    def predict(key, table):
        """(shard, key, log10 probability of the gram's last byte after the others)."""
        gram, n = table.column("gram").to_numpy(), table.column("n").to_numpy()
        stop0, one0, stop1, one1 = shallow.value
        levels, bit = _deep(gram, n)
        _, node = _bits(gram)
        near = (((gram >> 8) & 0xFF)[:, None] << 8) | node
        rest = 1 - stop0[node]
        guess = stop0[node] * one0[node] + rest * stop1[near] * one1[near]
        rest = rest * (1 - stop1[near])
        for depth, level in enumerate(levels, 2):
            at = level.at.reshape(bit.shape)
            stop = level.stop[at] if depth < DEPTH else np.ones(bit.shape)
            guess += rest * stop * level.one[at]
            rest = rest * (1 - stop)
        value = np.log(np.where(bit == 1, guess, 1 - guess)).sum(axis=1) / LN10
        keys = gram.astype(np.uint64) * np.uint64(_MUL)
        shard = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        return pa.table({"shard": pa.array(shard), "key": pa.array(keys.view(np.int64)), "value": pa.array(value)})

    return predict


def _look_up(key, asked, model):
    known, value = model.column("key").to_numpy().view(np.uint64), model.column("value").to_numpy()
    order = np.argsort(known)
    keys, sizes = C.joined(asked, "keys", np.uint64)
    found = value[order][np.searchsorted(known[order], keys)] if len(keys) else np.zeros(0)
    values = [x.astype(np.float32).tobytes() for x in C.parts(found, sizes)]
    return pa.table({"kind": pa.array([GRAMS] * len(values), pa.int32()), "shard": asked.column("shard"), "chunk": asked.column("chunk"), "values": pa.array(values, pa.binary())})


def _score(folds: int):
    def score(key, texts, answers):
        ids, column = C.opened(texts)
        pieces, sizes = [], []
        for _, _, data, offsets in T.slices(column):
            piece = {}
            for kind, keys_of in _KEYS.items():
                keys, first = keys_of(data, offsets)
                codes, found = pd.factorize(keys)
                piece[kind] = codes.astype(np.int32), found, first[:-1], np.diff(first)
            pieces.append(piece)
            sizes.append(np.diff(offsets))
        answers = answers.sort_by("shard")

        def values(kind: int, dtype) -> list[np.ndarray]:
            """The answers to the keys of each piece."""
            keys = np.unique(np.concatenate([p[kind][1] for p in pieces])) if pieces else np.zeros(0, np.uint64)
            value, _ = C.joined(answers.filter(pa.compute.equal(answers.column("kind"), kind)), "values", dtype)
            return [value[np.searchsorted(keys, p[kind][1])] for p in pieces]

        n_tokens, n_known, base, score = [], [], [], []
        for p, value in zip(pieces, values(WORDS, np.int64), strict=True):
            codes, _, first, sizes_of = p[WORDS]
            n_tokens.append(sizes_of)
            n_known.append(np.add.reduceat((value > 0).astype(np.int64)[codes], first))
            base.append(np.add.reduceat(np.log10(value + 0.5)[codes], first))
        for p, value in zip(pieces, values(GRAMS, np.float32), strict=True):
            codes, _, first, _ = p[GRAMS]
            score.append(np.add.reduceat(value.astype(np.float64)[codes], first))
        whole = lambda x, kind: pa.array(np.concatenate(x).astype(kind) if x else np.zeros(0, kind))
        return pa.table(
            {
                "id": ids, "held_out": pa.array(held_out(ids, folds)), "n_tokens": whole(n_tokens, np.int64), "n_known": whole(n_known, np.int64),
                "counted": whole(base, np.float64), "score": whole(score, np.float64), "n_bytes": whole(sizes, np.int64),
            }
        )

    return score


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte; learns from the other folds."""
    spark = docs.sparkSession
    chunks = C.count_for(C.text_bytes(docs, text_col), chunk_bytes)
    bits = max(2, (chunks - 1).bit_length())
    texts = C.chunked(docs, id_col, text_col, chunks)
    asked = texts.groupBy("chunk").applyInArrow(_ask((WORDS, GRAMS), bits, folds), _ASKED)
    merged = written(
        asked.groupBy("kind", "shard").applyInArrow(_merge, "kind int, shard bigint, chunk bigint, keys binary, values binary, fresh bigint, seen bigint"), "counts"
    )
    words = merged.where(F.col("kind") == WORDS).agg(F.sum("fresh").alias("fresh"), F.sum("seen").alias("seen")).first()
    model = merged.where(F.col("kind") == GRAMS).select("keys", "values").mapInArrow(_flat, "gram bigint, n bigint")
    trees = model.groupBy(F.expr("(gram >> 8) & 65535").alias("context"))
    rows = trees.applyInArrow(_roots, "kind int, id bigint, value double").groupBy("kind", "id").agg(F.sum("value").alias("value")).collect()  # 2 x 2^16 rows at most
    shallow = spark.sparkContext.broadcast(_shallow(rows))
    predicted = trees.applyInArrow(_predict(shallow, bits), "shard bigint, key bigint, value double")
    wanted = texts.groupBy("chunk").applyInArrow(_ask((GRAMS,), bits, folds), _ASKED).select("kind", "shard", "chunk", "keys")
    answer = "kind int, shard bigint, chunk bigint, values binary"
    grams_answer = wanted.groupBy("shard").cogroup(predicted.groupBy("shard")).applyInArrow(_look_up, answer)
    answers = merged.where(F.col("kind") == WORDS).select("kind", "shard", "chunk", "values").unionByName(grams_answer)
    found = texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _score(folds), "id bigint, held_out boolean, n_tokens bigint, n_known bigint, counted double, score double, n_bytes bigint"
    )
    seen, fresh = words.seen or 0, words.fresh or 0
    base = F.col("counted") - F.col("n_tokens") * float(np.log10(seen + 0.5 * (fresh + 1)))
    return found.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(seen).cast("bigint").alias("train_tokens"), base.alias("base_score"), "score",
        (-F.col("score") * float(LN10 / LN2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )


def op1_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))


QUERIES = {"op1_context_tree_weighting": op1_context_tree_weighting}
ORACLES: dict[str, str] = {}
