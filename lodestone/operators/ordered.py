"""Running totals, as-of joins, walks, joined texts and joins by position within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.artifacts import written


def _merged(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join of tables that grow with the rows, by sorting: Spark would broadcast a written one if its files are small,
    and millions of rows of repeated groups and near numbers are a few megabytes on disk."""
    return left.join(right.hint("merge"), keys, how)


def running_totals(rows: DataFrame, group: str, order: list[str], totals: dict[str, str]) -> DataFrame:
    """The rows with, for each name in ``totals``, the sum of its column over the group's rows up to this one.

    Rows are dealt by ranges of (group, order), so a group that holds most rows
    spans many tasks; each adds what earlier ranges of the group sum up to, a
    row a range. The order must tell the rows of a group apart.
    """
    ranged = written(rows.repartitionByRange(group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(group, "_range").agg(*(F.sum(size).alias(f"_sum_{out}") for out, size in totals.items()))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = [F.coalesce(F.sum(f"_sum_{out}").over(earlier), F.lit(0)).alias(f"_before_{out}") for out in totals]
    starts = sums.select(F.col(group).alias("_group"), F.col("_range").alias("_from"), *before)
    own = Window.partitionBy(group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    told = ranged.select("*", *(F.sum(size).over(own).alias(out) for out, size in totals.items()))
    told = told.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_from")))
    return told.select(*rows.columns, *((F.col(out) + F.col(f"_before_{out}")).alias(out) for out in totals))


def running_total(rows: DataFrame, group: str, order: list[str], size: str, out: str) -> DataFrame:
    """``running_totals`` of one column."""
    return running_totals(rows, group, order, {out: size})


def as_of(left: DataFrame, right: DataFrame, group: str, at: str, order: tuple[str, ...] = (), out: str = "found") -> DataFrame:
    """The left rows with ``out``: the group's last right row at or before them, as a struct; null where there is none.

    Of right rows at the same place the last by ``order`` counts. Both sides are
    dealt together by ranges of (group, at); within a range the last right row is
    carried on, and a range begins with the last one of the group's earlier
    ranges, a row a range, so that no group has to fit into a task. Rows with a
    null group or place have no match and match nothing.
    """
    tie = F.struct(*order) if order else F.lit(0)
    mine, theirs = F.struct(*left.columns), F.struct(*right.columns)
    shape = right.select(theirs.alias("r"), tie.alias("t")).schema
    held = right.where(F.col(group).isNotNull() & F.col(at).isNotNull())
    held = held.select(F.col(group).alias("_g"), F.col(at).alias("_at"), F.lit(0).alias("_kind"), tie.alias("_tie"), theirs.alias("_r"), F.lit(None).cast(left.select(mine.alias("l")).schema["l"].dataType).alias("_l"))
    asking = left.select(F.col(group).alias("_g"), F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(shape["t"].dataType).alias("_tie"), F.lit(None).cast(shape["r"].dataType).alias("_r"), mine.alias("_l"))
    by = ["_at", "_kind", "_tie"]
    ranged = written(held.unionByName(asking).repartitionByRange("_g", *by).withColumn("_range", F.spark_partition_id()), "ranges")
    lasts = ranged.groupBy("_g", "_range").agg(F.max_by("_r", F.when(F.col("_kind") == 0, F.struct("_at", "_tie"))).alias("_last"))
    carried = F.last("_last", ignorenulls=True).over(Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = lasts.select(F.col("_g").alias("_group"), F.col("_range").alias("_from"), carried.alias("_carried"))
    own = F.last("_r", ignorenulls=True).over(Window.partitionBy("_g", "_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    told = ranged.withColumn("_own", own).where("_kind = 1").join(starts, F.col("_g").eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_from")))
    return told.select("_l.*", F.when(F.col("_g").isNotNull() & F.col("_at").isNotNull(), F.coalesce("_own", "_carried")).alias(out))


def chained(rows: DataFrame, group: str, at: str, following: str, out: str = "link") -> DataFrame:
    """group, at and ``out`` (from 0) of the rows that a walk along ``following`` meets, from each group's row 1.

    ``following`` is the next row's ``at``, larger than the own one; a walk ends
    where there is no such row. By pointer jumping: after k rounds the first 2^k
    rows are known, and every pointer leads 2^k rows on, so a group of any size
    takes as many rounds as its walk's length has bits. Each round is written.
    """
    rows = written(rows.select(F.struct(group).alias("g"), F.col(at).alias("at"), F.col(following).alias("to")), "steps")
    jumps = written(_merged(rows, rows.select("g", F.col("at").alias("to")), ["g", "to"], "left_semi").select("g", "at", "to"), "jumps")
    met = written(rows.where("at = 1").select("g", "at", F.lit(0).cast("bigint").alias(out)), "met")
    step = 1
    while True:
        ahead = written(_merged(met, jumps, ["g", "at"]).select("g", F.col("to").alias("at"), (F.col(out) + step).alias(out)), "ahead")
        if ahead.isEmpty():
            return met.select(f"g.{group}", F.col("at").alias(at), out)
        met = written(met.unionByName(ahead), "met")
        jumps = written(_merged(jumps, jumps.select("g", F.col("at").alias("to"), F.col("to").alias("beyond")), ["g", "to"]).select("g", "at", F.col("beyond").alias("to")), "jumps")
        step *= 2


def _parts(placed: DataFrame, group: str, nth: str, following: str, out: str) -> DataFrame:
    """Numbered rows with the number (from 0) of the part that they fall into, where a part ends before its first row's ``following``."""
    starts = chained(placed, group, nth, following, out)
    return as_of(placed, starts, group, nth, out="_part").withColumn(out, F.col(f"_part.{out}")).drop("_part")


def greedy_batches(rows: DataFrame, group: str, order: list[str], size: str, most_items: int = 64, most_size: int = 6000, out: str = "batch") -> DataFrame:
    """The rows with ``out``: the batch (from 0) that takes them when batches are filled in order, each until an item would not fit.

    A batch holds ``most_items`` rows and a total size of ``most_size``; a larger
    item stands alone. Sizes are whole numbers, null or negative ones count as 0.
    The batch that would begin at a row ends where the running total passes its
    own by ``most_size`` (an as-of join), and the batches that do begin are
    those that a walk over these ends meets.
    """
    sized = rows.withColumns({"_size": F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("bigint"), "_one": F.lit(1).cast("bigint")})
    placed = written(running_totals(sized, group, order, {"_upto": "_size", "_nth": "_one"}).drop("_one"), "placed")
    marks = placed.select(F.struct(group).alias("g"), F.col("_upto").alias("at"), F.col("_nth").alias("nth"))
    asked = placed.select(F.struct(group).alias("g"), (F.col("_upto") - F.col("_size") + most_size).alias("at"), F.col("_nth").alias("nth"))
    ends = as_of(asked, marks, "g", "at", ("nth",)).select("g", "nth", F.greatest(F.col("nth"), F.least(F.coalesce("found.nth", "nth"), F.col("nth") + most_items - 1)).alias("last"))
    ends = ends.select(F.col("g").alias("_g"), F.col("nth").alias("_nth"), (F.col("last") + 1).alias("_next"))
    return _parts(_merged(placed.withColumn("_g", F.struct(group)), ends, ["_g", "_nth"]), "_g", "_nth", "_next", out).select(*rows.columns, out)


def spaced(rows: DataFrame, group: str, at: str, order: list[str], least: int) -> DataFrame:
    """The rows of each group that stay when one goes if the last that stayed is less than ``least`` before it.

    ``at`` is a whole number; equal ones are ordered by ``order``. The first row
    of a group stays, and the next that stays is the first at ``at`` + ``least`` or
    later, so the rows that stay are a walk, in groups of any size. Rows with a
    null ``at`` are left out.
    """
    placed = rows.where(F.col(at).isNotNull()).withColumn("_one", F.lit(1).cast("bigint"))
    placed = written(running_totals(placed, group, [at, *order], {"_nth": "_one"}).drop("_one"), "placed")
    marks = placed.select(F.struct(group).alias("g"), F.col(at).cast("bigint").alias("at"), F.col("_nth").alias("nth"))
    asked = marks.withColumn("at", F.col("at") + least - 1)
    ends = as_of(asked, marks, "g", "at", ("nth",)).select("g", "nth", (F.greatest(F.col("nth"), F.col("found.nth")) + 1).alias("_next"))
    stay = chained(ends, "g", "nth", "_next").select(F.col("g").alias("_g"), F.col("nth").alias("_nth"))
    return _merged(placed.withColumn("_g", F.struct(group)), stay, ["_g", "_nth"], "left_semi").select(*rows.columns)


def joined_texts(rows: DataFrame, group: str, order: list[str], text: Column, separator: str = "\n\n", piece: int = 1 << 20) -> DataFrame:
    """group, piece, text: the group's texts in order, the separator between them.

    A piece holds whole texts and ends with the one that fills it, so that no
    task holds a large group; a group below ``piece`` characters is one row
    (piece 0). Null texts are left out, groups without a text have no row.
    """
    told = rows.select(group, *order, text.alias("_text")).where("_text is not null").withColumn("_size", F.length("_text").cast("bigint"))
    placed = running_total(told, group, order, "_size", "_upto").withColumn("piece", F.floor((F.col("_upto") - F.col("_size")) / piece).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct(*order, "_text")))
    return placed.groupBy(group, "piece").agg(F.array_join(F.transform(parts, lambda p: p["_text"]), separator).alias("text"))


def numbered(rows: DataFrame, group: str, order: str, out: str = "ordinal") -> DataFrame:
    """The rows with their position in the group, from 0; the order must tell them apart."""
    ones = running_total(rows.withColumn("_one", F.lit(1)), group, [order], "_one", out)
    return ones.withColumn(out, (F.col(out) - 1).cast("int")).drop("_one")


def by_ordinal(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows at the same position of the same group, told by the position's number and never by the order of the frames."""
    return left.join(right, keys, how)


def labelled_blocks(blocks: DataFrame, tags: DataFrame, keys: list[str], tag: str, label: Column) -> DataFrame:
    """Each block with the tag at its position; where there is none, with its own label."""
    return by_ordinal(blocks, tags, keys, "left").withColumn(tag, F.coalesce(F.col(tag), label))


def reranked(candidates: DataFrame, logit: str, position: str, k: int) -> DataFrame:
    """The k best by logit; of equal ones the earlier candidate. Null logits come last."""
    return candidates.orderBy(F.desc_nulls_last(logit), position).limit(k)
