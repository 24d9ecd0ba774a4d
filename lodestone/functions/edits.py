"""Exact edits of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import occurrences, replace_first


def edited(text: Column, old: str, new: str, n: int = 1) -> Column:
    """status, text, replaced and lines (gained or lost) of an edit.

    With n = 1 the old text must stand once: it is ``ambiguous`` otherwise; n = 0
    replaces all, a larger n the first n. Where it is ``missing`` or ambiguous
    the text stays. A null text is missing.
    """
    found = F.coalesce(occurrences(text, old), F.lit(0))
    status = F.when(found == 0, "missing").when((found > 1) & F.lit(n == 1), "ambiguous").otherwise("ok")
    replaced = F.when(status != "ok", 0).otherwise(found if n == 0 else F.least(found, F.lit(n))).cast("int")
    gained = new.count("\n") - old.count("\n")
    return F.struct(
        status.alias("status"), F.when(status == "ok", replace_first(text, old, new, n)).otherwise(text).alias("text"),
        replaced.alias("replaced"), (replaced * gained).alias("lines"),
    )


def occurrence_lines(df: DataFrame, key: str, text: str, needle: str) -> DataFrame:
    """key, nth (from 0) and line_no (from 1) of the non-overlapping occurrences: the text is cut at them once, and line breaks are summed over the pieces."""
    pieces = F.split(text, "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    breaks = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.regexp_count(p, F.lit("\n")))
    # the row's number comes before the rows of its pieces
    counted = df.select(F.monotonically_increasing_id().alias("_row"), *dict.fromkeys((key, text))).select("_row", key, F.posexplode(breaks).alias("nth", "_n"))
    upto = F.sum("_n").over(Window.partitionBy("_row").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0))
    return counted.select(key, "nth", (1 + upto + F.col("nth") * needle.count("\n")).cast("int").alias("line_no"))
