"""Tags in texts on the JVM: outermost blocks by nesting depth, and tool calls with their arguments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.maps import merged
from lodestone.operators.chunking import WHITE


def _pattern(names: Sequence[str]) -> str:
    one = "|".join(names)
    return rf"<(?:{one})(?:\s[^>]*)?/?>|</(?:{one})>"


def blocks(texts: DataFrame, key: str, text: str, names: Sequence[str]) -> DataFrame:
    """key, name, start, stop, inner_start, inner_stop, tag and single of tags without a body and of outermost blocks of each name.

    Places are code points from 0, stops exclusive; the key tells texts apart. A
    text is cut once at all tags of the names; a tag's place is the running sum
    of what stands before it, and its depth the running sum of opening minus
    closing tags of its name, less the sum's lowest value below zero, as a
    closing tag without an opening one counts for nothing. A block begins where
    the depth rises from 0 and ends where it falls back; one that does not end is none.
    """
    cut = texts.where(F.contains(text, F.lit("<"))).select(key, F.split(text, _pattern(names), -1).alias("gaps"), F.regexp_extract_all(text, F.lit(_pattern(names)), F.lit(0)).alias("tags"))
    sized = cut.select(key, F.inline(F.transform("tags", lambda t, i: F.struct(i.alias("i"), t.alias("tag"), F.length(F.get("gaps", i)).alias("gap")))))
    by_text = Window.partitionBy(key).orderBy("i")
    placed = sized.withColumn("stop", F.sum(F.col("gap") + F.length("tag")).over(by_text)).withColumn("start", F.col("stop") - F.length("tag"))
    named = placed.withColumns({"name": F.regexp_extract("tag", r"^</?(\w+)", 1), "step": F.when(F.col("tag").startswith("</"), -1).when(F.col("tag").endswith("/>"), 0).otherwise(1)})
    by_name = Window.partitionBy(key, "name").orderBy("i")
    summed = named.withColumn("sum", F.sum("step").over(by_name))
    deep = summed.withColumn("depth", F.col("sum") - F.least(F.lit(0), F.min("sum").over(by_name)))
    before = F.lag("depth", 1, 0).over(by_name)
    begins, ends = (F.col("step") == 1) & (F.col("depth") == 1), (F.col("step") == -1) & (F.col("depth") == 0) & (before == 1)
    marked = deep.withColumns({"begins": begins, "ends": ends}).withColumn("nth", F.count_if("begins").over(by_name))
    whole = marked.where("begins or ends").groupBy(key, "name", "nth").agg(
        F.min(F.when(F.col("begins"), F.col("start"))).alias("start"), F.max(F.when(F.col("ends"), F.col("stop"))).alias("stop"),
        F.min(F.when(F.col("begins"), F.col("stop"))).alias("inner_start"), F.max(F.when(F.col("ends"), F.col("start"))).alias("inner_stop"), F.max(F.when(F.col("begins"), F.col("tag"))).alias("tag"),
    )
    none = F.lit(None).cast("bigint")
    single = named.where("step = 0").select(key, "name", "start", "stop", none.alias("inner_start"), none.alias("inner_stop"), "tag", F.lit(True).alias("single"))
    return whole.where("stop is not null and start is not null").select(key, "name", "start", "stop", "inner_start", "inner_stop", "tag", F.lit(False).alias("single")).unionByName(single)


def attributes(tag: Column) -> Column:
    """name = "value" or 'value' pairs of a tag as a map; of equal names the last counts."""
    pattern = r"(?s)(\w+)\s*=\s*(['\"])(.*?)\2"
    names, values = (F.regexp_extract_all(tag, F.lit(pattern), F.lit(g)) for g in (1, 3))
    pairs = F.zip_with(names, values, lambda n, v: F.struct(n.alias("name"), v.alias("value")))
    return F.map_from_entries(F.filter(pairs, lambda p, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), p["name"])))


def _child(inner: Column, name: str) -> Column:
    pattern = rf"(?s)<{name}(?:\s+[^>]*)?>(.*?)</{name}\s*>"
    return F.when(inner.rlike(pattern), F.regexp_replace(F.regexp_extract(inner, pattern, 1), r"\A\n|\n\z", ""))


def parsed_calls(messages: DataFrame, key: str, text: str, children: Mapping[str, Sequence[str]], primary: Mapping[str, str] | None = None, most: int = 100) -> DataFrame:
    """key, pos, fn, args of each call, the first of equal ones only, ``most`` a message.

    ``children`` names each tool's child tags, of which the call's arguments are
    the bodies; a tool without children takes its whole body as the argument
    that ``primary`` names, or as ``query`` if there is any. Arguments in the
    body win over attributes.
    """
    primary = primary or {}
    told = blocks(messages, key, text, list(children)).join(messages.select(key, F.col(text).alias("_text")), key)
    inner = F.coalesce(F.substring("_text", F.col("inner_start") + 1, F.col("inner_stop") - F.col("inner_start")), F.lit(""))
    body = F.expr("cast(map() as map<string,string>)")
    for fn, names in children.items():
        if names:
            found = F.create_map(*[x for n in names for x in (F.lit(n), _child(inner, n))])
        else:
            bare = F.btrim(inner, F.lit(WHITE))
            found = F.create_map(F.lit(primary.get(fn, "query")), bare if fn in primary else F.nullif(bare, F.lit("")))
        body = F.when(F.col("name") == fn, F.map_filter(found, lambda _, v: v.isNotNull())).otherwise(body)
    given = F.when(F.col("single"), F.expr("cast(map() as map<string,string>)")).otherwise(body)
    calls = told.select(key, F.col("start").cast("int").alias("pos"), F.col("name").alias("fn"), merged(attributes(F.col("tag")), given).alias("args"))
    same = calls.withColumn("_args", F.to_json(F.array_sort(F.map_entries("args"))))
    first = same.withColumn("_r", F.row_number().over(Window.partitionBy(key, "fn", "_args").orderBy("pos"))).where("_r = 1")
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("_n") <= most).select(key, "pos", "fn", "args")


def without_tags(text: Column, names: Sequence[str]) -> Column:
    """The text without bodies and tags of the names: blocks first (the shortest that closes), then tags left alone."""
    one = "|".join(names)
    return F.regexp_replace(F.regexp_replace(text, rf"(?s)<({one})(?:\s[^>]*)?(?<!/)>.*?</\1>", ""), rf"</?(?:{one})(?:\s[^>]*)?/?>", "")
