r"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a built-in SQL expression over the text, so the whole table is
evaluated in one projection without user functions or shuffles.

Defined edge cases: null and empty texts have no words and fail the base rule;
texts without words or lines have ratios of 0; repeated rows are judged each;
other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm._shared import table
from lodestone.sources.tables import spread

GRAM = 5
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\f\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for on was with as by at be this have from or an are not a "
    "de la le et les des en un une du est que qui dans pour sur au par pas ce "
    "der die das und von zu den mit sich des auf für nicht ein eine dem ist im es "
    "el los las del y se con su al lo una por para como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A text of ``min_words`` words or more passes when low <= metric <= high."""

    metric: str
    low: float
    high: float
    min_words: int = 0


RULES = (
    Rule("n_words", 10, 1e12),
    Rule("mean_word_chars", 1.5, 20),
    Rule("symbol_ratio", 0, 0.04, 10),
    Rule("shout_ratio", 0, 0.5, 10),
    Rule("capital_ratio", 0, 0.5, 10),
    Rule("stop_ratio", 0.03, 1, 60),
    Rule("dup_line_ratio", 0, 0.5, 10),
    Rule("stutter_ratio", 0, 0.2, 10),
    Rule("repeat_ratio", 0, 0.2),
)


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def with_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and the counts that the metrics are made of."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(
        F.col(id_col).alias("id"),
        F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != "").alias("lines"),
        F.length(F.translate(text, WHITE, "")).cast("bigint").alias("word_chars"),
        _removed(text, SYMBOLS).cast("bigint").alias("n_symbols"),
        _removed(text, "!").cast("bigint").alias("n_shouts"),
        _removed(text, CAPITALS).cast("bigint").alias("n_capitals"),
    )
    scalars = ("id", "word_chars", "n_symbols", "n_shouts", "n_capitals")
    hashed = cut.select(
        *scalars,
        F.size("words").cast("bigint").alias("n_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("bigint").alias("n_stop"),
        F.size(F.expr("filter(words, (w, i) -> w = get(words, i - 1))")).cast("bigint").alias("n_stutter"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    scalars = (*scalars, "n_words", "n_lines", "n_dup_lines", "n_stop", "n_stutter")
    # each word is hashed once; a window is the hash of its words' hashes
    window = ", ".join(f"hashes[i + {j}]" for j in range(GRAM))
    grams = F.when(F.size("hashes") >= GRAM, F.expr(f"transform(sequence(0, size(hashes) - {GRAM}), i -> xxhash64({window}))"))
    hashed = hashed.select(*scalars, grams.alias("grams"))
    # only texts with a repeated window are sorted
    repeated = hashed.select(
        *scalars,
        F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.expr("sort_array(transform(grams, (h, i) -> struct(h as h, i as i)))")).alias("s"),
    )
    places = repeated.select(
        *scalars,
        F.when(F.col("s").isNotNull(), F.expr("sort_array(transform(filter(s, (x, j) -> x.h <=> get(s, j - 1).h or x.h <=> get(s, j + 1).h), x -> x.i))")).alias("p"),
    )
    covered = F.expr(f"aggregate(transform(p, (x, j) -> least({GRAM}, coalesce(get(p, j + 1) - x, {GRAM}))), 0L, (a, n) -> a + n)")
    # a generator: Catalyst would copy all of the above into every filter on a count
    return places.select(F.inline(F.array(F.struct(*scalars, F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words")))))


def metric(name: str) -> Column:
    def ratio(n: str, of: str) -> Column:
        return F.when(F.col(of) > 0, F.col(n) / F.col(of)).otherwise(0.0)

    return {
        "n_words": F.col("n_words"),
        "mean_word_chars": F.when(F.col("n_words") > 0, F.col("word_chars") / F.col("n_words")).otherwise(0.0),
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "shout_ratio": ratio("n_shouts", "n_words"),
        "capital_ratio": ratio("n_capitals", "word_chars"),
        "stop_ratio": ratio("n_stop", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "stutter_ratio": ratio("n_stutter", "n_words"),
        "repeat_ratio": ratio("n_repeat_words", "n_words"),
    }[name]


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """One boolean column: every rule holds."""
    verdict = F.lit(True)
    for r in rules:
        verdict &= (F.col("n_words") < r.min_words) | metric(r.metric).between(r.low, r.high)
    return verdict


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the counts, base_failed and kept."""
    counts = with_counts(docs, id_col, text_col)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counts.withColumn("base_failed", failed).withColumn("kept", ~failed & compiled(rules)).withColumnRenamed("id", id_col)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLES = {
    "op6_quality_rules": r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT rid, i, list_slice(words, i, i + 4) AS gram FROM w, unnest(generate_series(1, len(words) - 4)) AS u(i)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, generate_series(0, 4) AS s(k) GROUP BY rid),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  length(regexp_replace(text, '[^!]', '', 'g')) AS n_shouts, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
  len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(list_filter(words, lambda x, i: i > 1 AND x = words[i - 1])) AS n_stutter,
  len(list_filter(words, lambda x: list_contains(string_split('"""
    + " ".join(STOP_WORDS)
    + r"""', ' '), lower(x)))) AS n_stop
  FROM w LEFT JOIN c USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 1.5 AND 20 AND n_symbols / word_chars <= 0.04 AND n_shouts / n_words <= 0.5
  AND n_capitals / word_chars <= 0.5 AND (n_words < 60 OR n_stop / n_words >= 0.03) AND n_dup_lines / n_lines <= 0.5
  AND n_stutter / n_words <= 0.2 AND n_repeat_words / n_words <= 0.2 AS kept FROM f
""",
}
