"""Language identification with language-bitmask n-gram filters.

Training counts the 4-byte grams of each language in Spark; every gram that
occurs enters a bit-sliced Bloom filter: slot -> one bit per language and plane.
Plane 0 holds all grams of a language, plane 1 those that make up at least
``COMMON_RATE`` of its grams. ANDing the slots of a gram gives the bitmask of
all languages that contain it (none is ever missed), and of those in which it
is common. The popcounts of a text in each plane, corrected for the plane's
false-positive rate, are averaged and decide.

The filter has ``SLOTS_A_GRAM`` slots for each gram of the language with most
(so a false-positive rate of about 3 %). One above ``MODEL_BYTES`` is cut into
parts by a hash of the gram, which are made, broadcast and asked one after the
other; a text's counts are added up over the parts, so its rate and its answers
do not depend on the cap.

Defined edge cases: null texts and texts without a letter are ``und`` with
score 0; texts too short for a gram get the language with most training grams;
with no training rows everything is ``und``; ties go to the language with more
training grams, then by name. Repeated rows are predicted each; other columns
pass through, and one called like a result column is replaced. Texts are worked
on in slices of rows, so a very long text is one slice. Rows with a null id are
predicted, and learnt from, like others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import _text as T
from lodestone.llm._shared import bounded_batches, discard, fresh_name, held, table, written

HASHES = 3
SLOTS_A_GRAM = 8
LEAST_SLOTS = 1 << 16
#: A part of the filters is broadcast: its greatest size.
MODEL_BYTES = 32 << 20
BLOCK = 1 << 12
PLANES = 2
COMMON_RATE = 2e-5
FOLDS = 3
UNKNOWN = "und"
SPACE = 0x20
#: Letters lower-cased, bytes of other characters kept, all else a space.
FOLD = np.array([b | 0x20 if chr(b).isalpha() and b < 0x80 else b if b >= 0x80 else SPACE for b in range(256)], dtype=np.uint8)


@dataclass
class Filter:
    slots: np.ndarray  # bits of each slot, PLANES a language; one row for every 64 bits
    false_positive: np.ndarray  # of each bit
    part: int = 0  # holds the grams of this part
    parts: int = 1

    @property
    def size(self) -> int:
        return self.slots.shape[1]


@dataclass
class LanguageModel:
    languages: list[str]  # by training grams, most first
    parts: int
    filter: Callable[[int], Filter]  # makes a part


def text_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, code) of each 4-byte gram; texts stand between spaces, runs of spaces make no grams."""
    n, docs = len(data), len(offsets) - 1
    doc = np.repeat(np.arange(docs, dtype=np.int32), np.diff(offsets))
    at = np.arange(1, n + 1) + doc
    spaced = np.full(n + docs + 1, SPACE, dtype=np.uint8)
    spaced[at] = FOLD[data]
    if len(spaced) < 4:
        return np.zeros(0, np.int32), np.zeros(0, np.uint32)
    border = np.zeros(len(spaced), dtype=bool)
    border[offsets + np.arange(docs + 1)] = True
    blank = spaced == SPACE
    pair = blank[:-1] & blank[1:]
    wide = spaced.astype(np.uint32)
    code = (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]
    ok = ~(pair[:-2] | pair[1:-1] | pair[2:] | border[1:-2] | border[2:-1])
    whose = np.zeros(len(spaced), dtype=np.int32)
    whose[at] = doc
    return whose[1:-2][ok], code[ok]


def slots_of(codes: np.ndarray, k: int, size: int) -> np.ndarray:
    h = T.mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return ((h & np.uint64(0xFFFFFFFF)) + np.uint64(k) * ((h >> np.uint64(32)) | np.uint64(1))) & np.uint64(size - 1)


def part_of(codes: np.ndarray, parts: int) -> np.ndarray:
    return T.mix(codes.astype(np.uint64) + np.uint64(0xC2B2AE3D27D4EB4F)) & np.uint64(parts - 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of each batch of (text, lang)."""
    for batch in batches:
        langs = batch.column(1).dictionary_encode()
        names, index = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        found: list[list] = [[] for _ in names]
        for lo, _, data, offsets in T.slices(batch.column(0)):
            doc, code = text_grams(data, offsets)
            whose = index[lo + doc]
            for i in range(len(names)):
                found[i].append(np.unique(code[whose == i], return_counts=True))
        for name, parts in zip(names, found, strict=True):
            if not parts:
                continue
            codes, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            counts = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])


def _slots(size: int, part: int, parts: int):
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, slot, bits) of the part's (gram, word, bits)."""
        for batch in batches:
            batch = batch.filter(pa.array(part_of(batch.column(0).to_numpy(), parts) == part)) if parts > 1 else batch
            codes = batch.column(0).to_numpy()
            for k in range(HASHES):
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(slots_of(codes, k, size).astype(np.int64)), batch.column(2)], names=["word", "slot", "bits"])

    return slots


def _dense(kind: str):
    def dense(key, rows):
        block = np.zeros(BLOCK, dtype=kind)
        block[rows.column("slot").to_numpy() % BLOCK] = rows.column("bits").to_numpy().view(np.uint64).astype(kind)
        return pa.table({"word": [key[0].as_py()], "block": [key[1].as_py()], "filled": pa.array([block.tobytes()], pa.binary())}, schema=pa.schema([("word", pa.int32()), ("block", pa.int64()), ("filled", pa.binary())]))

    return dense


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", common_rate: float = COMMON_RATE, model_bytes: int = MODEL_BYTES) -> LanguageModel:
    """Counts all grams of all labelled rows; a part of the filters, ``model_bytes`` at most, reaches the driver at a time."""
    spark = labelled.sparkSession
    bounded_batches(spark)
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = written(rows.mapInArrow(_count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    known = counts.groupBy("lang").agg(F.sum("n").alias("total"), F.count("*").alias("grams")).collect()  # one row a language
    known.sort(key=lambda r: (-r.total, r.lang))
    bits = PLANES * len(known)
    words = max(1, -(-bits // 64))
    kind = next(f"uint{n}" for n in (8, 16, 32, 64) if n >= min(bits, 64))
    whole = max(LEAST_SLOTS, 1 << (SLOTS_A_GRAM * max([r.grams for r in known], default=1) - 1).bit_length())
    size = whole
    while size > BLOCK and size * words * np.dtype(kind).itemsize > model_bytes:
        size //= 2
    parts = whole // size

    def made(part: int) -> Filter:
        slots = np.zeros((words, size), dtype=kind)
        if known:
            at = spark.createDataFrame([(r.lang, PLANES * i, float(r.total * common_rate)) for i, r in enumerate(known)], "lang string, bit int, least double")
            own = F.expr(f"shiftleft(if(n >= least, {(1 << PLANES) - 1}L, 1L), bit % 64)")
            masks = counts.join(F.broadcast(at), "lang").select("gram", F.expr("bit div 64").cast("int").alias("word"), own.alias("bits"))
            filled = masks.mapInArrow(_slots(size, part, parts), "word int, slot bigint, bits bigint").groupBy("word", "slot").agg(F.bit_or("bits").alias("bits"))
            blocks = filled.groupBy("word", F.expr(f"slot div {BLOCK}").alias("block")).applyInArrow(_dense(kind), "word int, block bigint, filled binary")
            for r in blocks.toLocalIterator():
                slots[r.word, r.block * BLOCK : (r.block + 1) * BLOCK] = np.frombuffer(r.filled, dtype=kind)
        if part == parts - 1:
            discard(counts)
        one = slots.dtype.type(1)
        fill = [float(np.count_nonzero(slots[i // 64] & (one << slots.dtype.type(i % 64)))) / size for i in range(bits)]
        return Filter(slots, np.array(fill, dtype=np.float64) ** HASHES, part, parts)

    return LanguageModel([r.lang for r in known], parts, made)


def hits(held_by: Filter, doc: np.ndarray, code: np.ndarray, docs: int) -> np.ndarray:
    """(bits, docs): how many of a text's grams in the filter's part it holds, less what false positives add."""
    if held_by.parts > 1:
        mine = part_of(code, held_by.parts) == held_by.part
        doc, code = doc[mine], code[mine]
    n = np.bincount(doc, minlength=docs).astype(np.float64)
    out = np.zeros((len(held_by.false_positive), docs))
    at = [slots_of(code, k, held_by.size) for k in range(HASHES)]
    for word, slots in enumerate(held_by.slots):
        mask = slots[at[0]]
        for k in range(1, HASHES):
            mask &= slots[at[k]]
        for i in range(64 * word, min(len(out), 64 * word + 64)):
            found = np.bincount(doc[mask & mask.dtype.type(1 << (i % 64)) != 0], minlength=docs)
            false = held_by.false_positive[i]
            out[i] = (found - false * n) / max(1e-9, 1 - false)
    return out


def shares(counted: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(languages, docs): the average over the planes of the share of a text's n grams that it holds."""
    each = np.clip(counted, 0, None) / np.maximum(n, 1) / PLANES
    return each.reshape(-1, PLANES, len(n)).sum(axis=1)


def _decide(languages: list[str], counted: np.ndarray, n: np.ndarray, letter: np.ndarray) -> tuple[list, np.ndarray]:
    if not languages:
        return [UNKNOWN] * len(n), np.zeros(len(n))
    share = shares(counted, n)
    best = np.argmax(share, axis=0)
    langs = [languages[b] if o else UNKNOWN for b, o in zip(best, letter, strict=True)]
    return langs, np.where(letter, np.minimum(share[best, np.arange(len(n))], 1.0), 0.0)


def _answers(langs: list, scores: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], names=["lang", "score"])


def _adder(shared: Broadcast, bits: int):
    @F.arrow_udf("array<double>")
    def add(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        def told():
            for text, before in columns:
                found = [np.zeros((0, bits + 1))]
                for lo, hi, data, offsets in T.slices(text):
                    doc, code = text_grams(data, offsets)
                    found.append(np.vstack([hits(shared.value, doc, code, hi - lo), np.bincount(doc, minlength=hi - lo)]).T)
                total = np.concatenate(found)
                if shared.value.part:
                    total[:, :bits] += before.flatten().to_numpy(zero_copy_only=False).reshape(total.shape)[:, :bits]
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * (bits + 1)), pa.array(total.ravel()))

        yield from T.released(told())

    return add.asNondeterministic()


def _summed(docs: DataFrame, model: LanguageModel, text_col: str, sums: str) -> DataFrame:
    """The rows with ``sums``: counts of every bit over all parts, and the number of grams; a pass and a table a part."""
    bits = PLANES * len(model.languages)
    rows = docs.withColumn(sums, F.lit(None).cast("array<double>"))
    for part in range(model.parts):
        shared = docs.sparkSession.sparkContext.broadcast(model.filter(part))
        before, rows = rows, written(rows.withColumn(sums, _adder(shared, bits)(F.col(text_col), F.col(sums))), "sums")
        shared.unpersist()
        if part:
            discard(before)
    return rows


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """The rows of ``docs`` with two more columns; what is broadcast of the model is bounded. Only texts go to Python."""
    bounded_batches(docs.sparkSession)
    languages, whole = model.languages, model.parts == 1
    sums = fresh_name(docs, "_sums")
    rows = docs if whole else _summed(docs, model, text_col, sums)
    shared = docs.sparkSession.sparkContext.broadcast(model.filter(0)) if whole else None

    @F.arrow_udf("struct<lang:string,score:double>")
    def decide(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        def told():
            for told_by, letter in columns:
                letter, langs, scores = letter.to_numpy(zero_copy_only=False), [], [np.zeros(0)]
                if whole:
                    for lo, hi, data, offsets in T.slices(told_by):
                        doc, code = text_grams(data, offsets)
                        some = _decide(languages, hits(shared.value, doc, code, hi - lo), np.bincount(doc, minlength=hi - lo), letter[lo:hi])
                        langs += some[0]
                        scores.append(some[1])
                elif len(told_by):
                    counted = told_by.flatten().to_numpy(zero_copy_only=False).reshape(len(told_by), -1).T
                    langs, one = _decide(languages, counted[:-1], counted[-1], letter)
                    scores.append(one)
                yield _answers(langs, np.concatenate(scores))

        yield from T.released(told())

    name = fresh_name(docs, "_told")
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    # not deterministic in name only: a filter on the result would else evaluate it once more
    rows = rows.withColumn(name, decide.asNondeterministic()(F.col(text_col) if whole else F.col(sums), letter))
    return rows.withColumns({lang_out: F.col(f"{name}.lang"), score_out: F.col(f"{name}.score")}).drop(name, sums)


def corpus_model(docs: DataFrame) -> LanguageModel:
    return train(docs.where(~held("doc_id", FOLDS)))


def op10_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", held("doc_id", FOLDS).alias("held_out"))
    return predict(rows, corpus_model(docs)).drop("text")


QUERIES = {"op10_language_bitmask": op10_language_bitmask}
ORACLES: dict[str, str] = {}
