"""A small text-format classifier: character n-grams and engineered features into logistic regression."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from lodestone.sources.artifacts import bounded_batches, few_rows_a_batch, written

VOCABULARY, THRESHOLD = 20_000, 0.65
#: N-grams that a task counts before it passes them on, words (and their length) whose terms it holds, vectors it makes at a time.
HELD_GRAMS, HELD_WORDS, LONG_WORD, VECTOR_ROWS = 200_000, 100_000, 40, 256
#: Blocks that the solver keeps: larger ones have arrays for which a heap of small regions leaves as much unused as it holds.
BLOCK_MB = 0.125
_SPACE = re.compile("[ \\t\\n\\x0b\\f\\r]+").split


def _words(text: str | None) -> list[str]:
    """The lower-case words, padded by blanks."""
    return [] if text is None else [f" {w} " for w in _SPACE(text.strip(" ").lower())]


def _grams(word: str, low: int = 2, high: int = 5) -> Iterator[str]:
    """Character n-grams within a padded word."""
    return (word[i : i + n] for n in range(low, high + 1) for i in range(len(word) - n + 1))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, n of the texts: each word of a batch is cut once, and what is held is bounded."""

    def told(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["gram", "n"])

    counts: defaultdict[str, int] = defaultdict(int)
    for batch in batches:
        words = Counter(w for t in batch.column(0).to_pylist() for w in _words(t))
        for word, times in words.items():
            for gram in _grams(word):
                counts[gram] += times
                if len(counts) >= HELD_GRAMS:
                    yield told(counts)
                    counts.clear()
    yield told(counts)


class _Terms:
    """Counts of a text's terms as (positions, counts) of a vocabulary; the terms of the words met are held."""

    def __init__(self, vocabulary: list[str]):
        self.size, self.at, self.met = len(vocabulary), {g: i for i, g in enumerate(vocabulary)}, {}

    def of(self, word: str) -> np.ndarray:
        found = self.met.get(word)
        if found is None:
            found = np.array([i for i in map(self.at.get, _grams(word)) if i is not None], dtype=np.int32)
            if len(word) <= LONG_WORD:
                if len(self.met) >= HELD_WORDS:
                    self.met.clear()
                self.met[word] = found
        return found

    def count(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = Counter(_words(text))
        parts = [self.of(w) for w in words]
        if not parts or not self.size:
            return np.empty(0, dtype=np.int64), np.empty(0)
        times = np.repeat(np.fromiter(words.values(), dtype=np.float64, count=len(parts)), [len(p) for p in parts])
        counts = np.bincount(np.concatenate(parts), weights=times, minlength=self.size)
        at = np.flatnonzero(counts)
        return at, counts[at]


def with_features(df: DataFrame, text: str) -> DataFrame:
    """The rows with ``grams``, the text whose character n-grams are counted, and the features."""
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: F.least(F.lit(1.0), F.regexp_count(text, F.lit(pattern)) / size)
    return df.select(
        "*", F.col(text).alias("grams"), share(r"[<>]").alias("f_angle"), share(r"[{}\[\]]").alias("f_brace"), share(r"[!?]").alias("f_shout"),
        share(r"[#*$%&|]").alias("f_symbol"), share("\n").alias("f_line"), F.least(F.lit(1.0), F.log1p(size) / 12).alias("f_size"),
    )


def call_features(text: Column, tools: list[str]) -> dict[str, Column]:
    """Six marks of calls in a text: tool names and foreign marks (five or more are 1), an own tag, a system mark, a pair of fences, thousands of characters."""
    names = "|".join(tools)
    count = lambda pattern: F.least(F.regexp_count(text, F.lit(pattern)), F.lit(5)) / 5.0
    mark = lambda held: held.cast("double")
    return {
        "f_tools": count(rf"\b({names})\b"), "f_foreign": count(FOREIGN), "f_own": mark(text.rlike(rf"</?({names})(\s|>|/>)")), "f_system": mark(text.rlike(SYSTEM)),
        "f_fences": mark(F.regexp_count(text, F.lit("```")) >= 2), "f_thousands": F.length(text) / 1000.0,
    }


def split(df: DataFrame, key: str, label: str, share: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(train, test): of each label the same share is held out, in the order of a hash of the key.

    The hash cuts each label into 1000 cells, which are counted and added up, so
    no label is ordered in one task; whole cells are held out until the share is
    reached, so the share is met to a thousandth of a label or a row.
    """
    placed = df.withColumn("_cell", F.pmod(F.xxhash64(key, F.lit(42)), F.lit(1000)))
    within = Window.partitionBy(label).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = placed.groupBy(label, "_cell").agg(F.count("*").alias("_n"))
    marks = cells.select(label, "_cell", (F.sum("_n").over(within) <= F.round(F.sum("_n").over(Window.partitionBy(label)) * share)).alias("_held"))
    out = placed.join(F.broadcast(marks), [label, "_cell"])  # a thousand rows a label at most
    return out.where("not _held").select(*df.columns), out.where("_held").select(*df.columns)


def oversampled(rows: DataFrame, real: DataFrame, times: int = 8) -> DataFrame:
    """The rows and each real one ``times`` times."""
    again = real.select(*rows.columns, F.explode(F.sequence(F.lit(1), F.lit(times))).alias("_i")).drop("_i")
    return rows.unionByName(again)


def balanced(df: DataFrame) -> DataFrame:
    """A weight that makes both labels count the same."""
    counts = df.groupBy("label").agg(F.count("*").alias("of"))
    whole = counts.agg(F.sum("of").alias("n"), F.count("*").alias("kinds"))
    weights = counts.crossJoin(whole).select("label", (F.col("n") / (F.col("kinds") * F.col("of"))).alias("weight"))
    return df.join(F.broadcast(weights), "label")


def confusion(predicted: DataFrame) -> DataFrame:
    return predicted.groupBy("label", "pred").agg(F.count("*").alias("n"))


def report(predicted: DataFrame) -> DataFrame:
    """label, rows, precision, recall, f1 of each label; 0 where a share has no rows."""
    of = lambda n, d: F.when(d > 0, n / d).otherwise(0.0)
    counts = confusion(predicted)
    own = counts.groupBy("label").agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("right"))
    told = counts.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("told"))
    both = own.join(told, "label", "left").withColumn("told", F.coalesce("told", F.lit(0)))
    p, r = of(F.col("right"), F.col("told")), of(F.col("right"), F.col("rows"))
    return both.select("label", "rows", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(of(2 * p * r, p + r), 6).alias("f1"))


# Marks of call formats that are not one's own, of a supported one, of an echoed result, and of fences.
FOREIGN = (
    r'<\|tool[▁_]|tool_call_begin|<\|DSML\||<｜DSML｜|<tool_call>|✿FUNCTION✿|<minimax:tool_call>|\[TOOL_CALL\]|<invoke\s+name=|function_calls>|<start_function_call>'
    r'|<\|tool_call>|call:[a-z_]+\{|<\|python_tag\|>|<toolcall>|<extra_id_|<function=|\|tool\||"tool"\s*:|"function_name"\s*:'
)
SUPPORTED = r"<\|tool_call_begin\|>\s*functions\.\w+(?::\d+)?\s*<\|tool_call_argument_begin\|>"
ECHO = r"(?i)\[SYSTEM[:\s—\-].*?result"
SYSTEM = r"\[SYSTEM[:\s—-]"


def auto_label(visible: Column, tools: list[str]) -> Column:
    """``foreign`` (1), ``own`` (0), ``review`` or ``excluded`` of an answer without its thinking; null if it names no tool."""
    names = "|".join(tools)
    return (
        F.when(visible.isNull() | ~visible.rlike(rf"\b({names})\b"), None).when(visible.rlike(SUPPORTED), "excluded").when(visible.rlike(FOREIGN), "foreign")
        .when(visible.rlike(rf"<({names})(\s[^>]*)?(>|/>)") | visible.rlike(ECHO), "own").otherwise("review")
    )


FEATURES = ("f_angle", "f_brace", "f_shout", "f_symbol", "f_line", "f_size")


@dataclass(frozen=True)
class Detector:
    """A fitted classifier: vocabulary, idf of its terms, names of the features, and the model over term weights and features."""

    vocabulary: list[str]
    idf: np.ndarray
    features: tuple[str, ...]
    model: LogisticRegressionModel

    def predict(self, df: DataFrame, *columns: str, threshold: float = THRESHOLD) -> DataFrame:
        """The columns, p and pred (p >= threshold) of rows with ``grams`` and features."""
        p = vector_to_array("probability")[1]
        told = self.model.transform(vectors(df, self.vocabulary, self.idf, self.features))
        return told.select(*columns, p.alias("p"), (p >= threshold).cast("int").alias("pred"))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        terms = [(i, g, float(w)) for i, (g, w) in enumerate(zip(self.vocabulary, self.idf, strict=True))]
        spark.createDataFrame(terms, "i int, gram string, idf double").coalesce(1).write.mode("overwrite").parquet(f"{path}/terms")
        spark.createDataFrame(list(enumerate(self.features)), "i int, name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/features")
        self.model.write().overwrite().save(f"{path}/model")


def load(path: str) -> Detector:
    spark = SparkSession.active()
    terms = spark.read.parquet(f"{path}/terms").orderBy("i").collect()
    features = tuple(r.name for r in spark.read.parquet(f"{path}/features").orderBy("i").collect())
    return Detector([r.gram for r in terms], np.array([r.idf for r in terms]), features, LogisticRegressionModel.load(f"{path}/model"))


def vocabulary(rows: DataFrame, most: int = VOCABULARY) -> list[str]:
    """The ``most`` frequent n-grams of ``grams``; of equal ones the smaller."""
    bounded_batches(rows.sparkSession)
    counts = rows.select("grams").mapInArrow(_gram_counts, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    return [r.gram for r in counts.orderBy(F.desc("n"), "gram").limit(most).collect()]


def inverse_frequencies(rows: DataFrame, terms: list[str]) -> np.ndarray:
    """ln((rows + 1) / (rows with the term + 1)) of each term."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, n, among = _Terms(terms), np.zeros(len(terms), dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n[of.count(text)[0]] += 1
                among += 1
        # the last row is the number of texts
        yield pa.RecordBatch.from_arrays([pa.array(range(len(n) + 1), pa.int32()), pa.array([*n.tolist(), among], pa.int64())], names=["i", "n"])

    bounded_batches(rows.sparkSession)
    found = np.zeros(len(terms) + 1)
    for r in rows.select("grams").mapInArrow(held, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():
        found[r.i] = r.n
    return np.log((found[-1] + 1) / (found[:-1] + 1))


def vectors(df: DataFrame, terms: list[str], idf: np.ndarray, features: tuple[str, ...]) -> DataFrame:
    """The rows without ``grams``, with ``features``: term weights (1 + ln tf)(1 + idf) of length 1, then the features.

    Vectors are made in Arrow batches as the columns that a sparse vector is
    stored in, and written, so no object stands for an element.
    """
    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c != "grams"]
    stored = StructType([*(df.schema[c] for c in kept), StructField("features", VectorUDT.sqlType())])
    kinds = to_arrow_schema(stored)
    size = len(terms) + len(features)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, own = _Terms(terms), np.arange(len(terms), size)
        for whole in batches:
            for start in range(0, whole.num_rows, VECTOR_ROWS):
                batch = whole.slice(start, VECTOR_ROWS)
                marks = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in features] or [np.empty((batch.num_rows, 0))])
                at, values = [], []
                for text, mark in zip(batch.column("grams").to_pylist(), marks, strict=True):
                    i, tf = of.count(text)
                    weight = (1.0 + np.log(tf)) * (1.0 + idf[i])
                    norm = np.sqrt((weight * weight).sum())
                    at.append(np.concatenate([i, own]))
                    values.append(np.concatenate([weight / norm if norm else weight, mark]))
                ends = pa.array(np.concatenate([[0], np.cumsum([len(i) for i in at])]), pa.int32())
                kind = kinds.field("features").type
                parts = [pa.array(np.zeros(len(at)), pa.int8()), pa.array(np.full(len(at), size), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(at), pa.int32())), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(values), pa.float64()))]
                vector = pa.StructArray.from_arrays([p.cast(f.type) for p, f in zip(parts, kind, strict=True)], fields=list(kind))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), vector], schema=kinds)

    read = StructType([*(df.schema[c] for c in kept), StructField("features", VectorUDT())])
    return written(df.select(*kept, "grams").mapInArrow(weigh, stored), "vectors", read)


def train(rows: DataFrame, features: tuple[str, ...] = FEATURES, c: float = 2.0) -> Detector:
    """A detector from rows with ``label`` (0 or 1), ``grams`` and the features."""
    terms = vocabulary(rows)
    idf = inverse_frequencies(rows, terms)
    told = vectors(rows.select("label", "grams", *features), terms, idf, features)
    labelled = balanced(told).withColumn("y", F.col("label").cast("double"))
    model = LogisticRegression(labelCol="y", weightCol="weight", regParam=1 / (c * max(told.count(), 1)), maxIter=50, standardization=False, probabilityCol="probability", maxBlockSizeInMB=BLOCK_MB)
    with few_rows_a_batch(rows.sparkSession):
        return Detector(terms, idf, features, model.fit(labelled))


def train_and_predict(labelled: DataFrame, key: str, text: str, c: float = 2.0) -> DataFrame:
    """key, label, p, pred (p >= THRESHOLD) of the held-out rows."""
    # written: it is read once for the terms, once for their frequencies and once for the vectors
    told = written(with_features(labelled, text).drop(text), "labelled")
    rows, test = split(told, key, "label")
    return train(rows, c=c).predict(test, key, "label")
