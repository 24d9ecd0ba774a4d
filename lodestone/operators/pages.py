"""Web pages: documentation test, url parts, headings, section priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.rules import WHITE
from lodestone.operators.manifests import greedy_budget

# Url parts of documentation, and headers of sections without substance.
DOC_MARKS = ("documentation", "/api/", "/reference/", "/guide/", "readme", "/tutorial/", "/manual/", "/sdk/")
LOW_VALUE = ("table of contents", "navigation", "footer", "copyright", "license", "sidebar", "breadcrumb", "cookie")


def is_documentation(url: Column, content: Column) -> Column:
    low = F.lower(url)
    by_url = low.rlike(r"(?:^|[./])docs?\.") | low.rlike(r"/docs?(?:/|$)")
    for mark in DOC_MARKS:
        by_url |= F.contains(low, F.lit(mark))
    return by_url | (F.regexp_count(F.substring(content, 1, 8000), F.lit("```")) >= 4)


def headings(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, pos, level, heading."""
    level = F.regexp_extract_all(html, F.lit(r"(?is)<h([1-6])[^>]*>(.*?)</h\1>"), F.lit(1))
    text = F.regexp_extract_all(html, F.lit(r"(?is)<h([1-6])[^>]*>(.*?)</h\1>"), F.lit(2))
    found = pages.select(key, F.posexplode(F.arrays_zip(level.alias("l"), text.alias("t"))).alias("p", "x"))
    return found.select(key, (F.col("p") + 1).alias("pos"), F.col("x.l").cast("int").alias("level"), F.trim(F.regexp_replace("x.t", "<[^>]+>", "")).alias("heading"))


def section_priority(header: Column, size: Column) -> Column:
    """5; -3 for boilerplate headers; +2 above 500 characters, else -1 below 50; at least 1."""
    low = F.lower(header)
    poor = F.lit(False)
    for word in LOW_VALUE:
        poor |= F.contains(low, F.lit(word))
    return F.greatest(F.lit(1), 5 - F.when(poor, 3).otherwise(0) + F.when(size > 500, 2).when(size < 50, -1).otherwise(0))


def parts(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, kind, pos, header, content, priority of a markdown page's fences, sections, lists and tables; ``pos`` counts within a kind."""
    # Fixed value: how a fence is written.
    fence = r"(?s)```(\w+)?[ \t\r]*\n(.*?)```"
    fences = pages.select(key, F.posexplode(F.arrays_zip(F.regexp_extract_all(text, F.lit(fence), F.lit(1)).alias("h"), F.regexp_extract_all(text, F.lit(fence), F.lit(2)).alias("c"))).alias("pos", "x"))
    code = fences.select(key, F.lit("code").alias("kind"), "pos", F.when(F.col("x.h") == "", "text").otherwise(F.col("x.h")).alias("header"), F.btrim("x.c", F.lit(WHITE)).alias("content"), F.lit(5).alias("priority"))
    # a mark before every header line cuts the page into sections
    cut = pages.select(key, F.posexplode(F.split(F.regexp_replace(text, r"(?m)^(#{1,6}\s+.+)$", "\u0001$1"), "\u0001")).alias("pos", "s"))
    header = F.regexp_extract("s", r"^(#{1,6}\s+.+)", 1)
    body = F.regexp_replace("s", r"^#{1,6}\s+.+\n?", "")
    named = cut.select(key, "pos", F.when(header == "", "Introduction").otherwise(F.btrim(header, F.lit(WHITE))).alias("header"), F.btrim(body, F.lit(WHITE)).alias("content"), F.length(body).alias("n")).where("content != ''")
    sections = named.select(key, F.lit("section").alias("kind"), "pos", "header", "content", section_priority(F.col("header"), F.col("n")).alias("priority"))

    def blocks(kind: str, pattern: str, priority: int, least: int) -> DataFrame:
        found = pages.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("pos", "c"))
        found = found.withColumn("c", F.btrim("c", F.lit(WHITE)))
        return found.where(F.length("c") > least).select(key, F.lit(kind).alias("kind"), "pos", F.lit("").alias("header"), F.col("c").alias("content"), F.lit(priority).alias("priority"))

    # How lists and tables are written.
    lists = blocks("list", r"(?dm)(?:^[\s]*[-*+]\s+.+$\n?)+|(?:^\d+\.\s+.+$\n?)+", 6, 20)
    tables = blocks("table", r"(?dm)\|.+\|\n\|[\s:|-]+\|\n(?:\|.+\|\n?)+", 7, 0)
    return code.unionByName(sections).unionByName(lists).unionByName(tables)


def relevance(content: Column, words: list[str]) -> Column:
    """min(10, int(share of the words found * 10) + 3); 5 without words."""
    if not words:
        return F.lit(5)
    hits = sum((F.contains(F.lower(content), F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    return F.least(F.lit(10), F.floor(hits / len(words) * 10) + 3)


def extracted(pages: DataFrame, key: str, text: str, words: list[str], max_chars: int | str) -> DataFrame:
    """Parts by priority until the budget is full; of parts with the same first 100 characters the best stays, of equal ones the first.

    The budget is a number of characters or a column of the pages.
    """
    kinds = F.array_position(F.array(*map(F.lit, ("code", "section", "list", "table"))), F.col("kind"))
    scored = parts(pages, key, text).withColumn("priority", F.col("priority") + (relevance(F.col("content"), words) if words else F.lit(0))).withColumn("kind_rank", kinds)
    order = [F.desc("priority"), "kind_rank", "pos"]
    first = F.row_number().over(Window.partitionBy(key, F.trim(F.substring("content", 1, 100))).orderBy(*order))
    unique = scored.withColumn("_r", first).where("_r = 1").drop("_r").withColumn("size", F.length("content"))
    if isinstance(max_chars, str):
        unique = unique.join(pages.select(key, F.col(max_chars).alias("_most")), key)
    most = F.col("_most") if isinstance(max_chars, str) else max_chars
    return greedy_budget(unique, key, order, "size", most, 200).withColumn("content", F.substring(F.col("content"), F.lit(1), F.col("taken").cast("int")))


def formatted(kind: Column, header: Column, content: Column) -> Column:
    """A part as text, under a title of its kind."""
    # The titles.
    fenced = F.concat(F.lit("**CODE ("), F.upper(header), F.lit("):**\n```"), header, F.lit("\n"), content, F.lit("\n```"))
    return (
        F.when(kind == "code", fenced).when(kind == "section", F.concat(header, F.lit("\n"), content)).when(kind == "list", F.concat(F.lit("**KEY POINTS:**\n"), content))
        .when(kind == "table", F.concat(F.lit("**DATA:**\n"), content)).otherwise(content)
    )


def paragraphs_within(text: Column, most: Column, least: int = 100) -> Column:
    """Paragraphs in order while they fit into ``most`` characters; the one that overflows is cut if over ``least`` are left, and ends it."""
    whole = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.btrim(p, F.lit(WHITE))), lambda p: p != "")
    none = F.struct(F.lit(0).alias("total"), F.lit(False).alias("done"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(state: Column, p: Column) -> Column:
        room = most - state["total"]
        cut = F.when(room > least, F.concat(state["out"], F.array(F.concat(F.substring(p, F.lit(1), room), F.lit("..."))))).otherwise(state["out"])
        over = F.struct(state["total"].alias("total"), F.lit(True).alias("done"), cut.alias("out"))
        fits = F.struct((state["total"] + F.length(p)).alias("total"), F.lit(False).alias("done"), F.concat(state["out"], F.array(p)).alias("out"))
        return F.when(state["done"], state).when(F.length(p) > room, over).otherwise(fits)

    return F.array_join(F.aggregate(whole, none, step, lambda s: s["out"]), "\n\n")


def extract(pages: DataFrame, key: str, text: str, words: list[str], max_chars: int | str) -> DataFrame:
    """key, extract: the best parts as one text; a page without parts gives its first paragraphs. The budget as in ``extracted``."""
    best = extracted(pages, key, text, words, max_chars)
    body = F.when(F.col("taken") < F.col("size"), F.concat("content", F.lit("\n[...]"))).otherwise(F.col("content"))
    rows = best.select(key, F.struct((-F.col("priority")).alias("p"), "kind_rank", "pos", formatted(F.col("kind"), F.col("header"), body).alias("t")).alias("x"))
    joined = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n\n").alias("_best"))  # a budget's worth
    most = F.col(max_chars) if isinstance(max_chars, str) else F.lit(max_chars)
    told = pages.select(key, text, most.cast("int").alias("_most")).join(joined, key, "left")
    return told.select(key, F.when(F.btrim("_best", F.lit(WHITE)) != "", F.col("_best")).otherwise(paragraphs_within(F.col(text), F.col("_most"))).alias("extract"))


def api_facts(text: Column) -> Column:
    """endpoints, parameters (name, text) and errors (code, text) that a documentation names."""
    # How endpoints, parameters and errors are written.
    endpoint = r"(?dU)(?:GET|POST|PUT|DELETE|PATCH)\s+(/[\w/\-{}]+)"
    parameter = r"(?dU)(?:^|\n)[\s]*[-*]?\s*`?(\w+)`?\s*:\s*(.+?)(?=\n|$)"
    error = r"(?dU)(?:Error|Exception|HTTP)\s*(\d{3,4})[:\s]+(.+?)(?=\n|$)"

    def pairs(pattern: str, first: str) -> Column:
        groups = [F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2)]
        return F.zip_with(*groups, lambda a, b: F.struct(a.alias(first), b.alias("text")))

    return F.struct(F.regexp_extract_all(text, F.lit(endpoint), F.lit(1)).alias("endpoints"), pairs(parameter, "name").alias("parameters"), pairs(error, "code").alias("errors"))


def for_developer(pages: DataFrame, key: str, text: str, words: list[str], max_chars: int) -> DataFrame:
    """key, extract: up to three code examples, endpoints and parameters as far as they fit, then what the query finds in the room left.

    Each of these is taken whole or left out; the query's part comes only if less
    than seven tenths of the budget are used.
    """
    fence = r"(?s)```(\w+)?[ \t\r]*\n(.*?)```"
    langs, bodies = (F.regexp_extract_all(text, F.lit(fence), F.lit(g)) for g in (1, 2))
    block = F.zip_with(langs, bodies, lambda a, b: F.concat(F.lit("```"), F.when(a == "", "text").otherwise(a), F.lit("\n"), F.btrim(b, F.lit(WHITE)), F.lit("\n```")))
    facts = pages.select(key, text, F.slice(block, 1, 3).alias("_blocks"), api_facts(F.col(text)).alias("_facts"))
    lists = {
        "## API ENDPOINTS\n": F.col("_facts.endpoints"),
        "## PARAMETERS\n": F.transform("_facts.parameters", lambda p: F.concat(F.lit("- `"), p["name"], F.lit("`: "), p["text"])),
    }
    offered = F.concat(F.col("_blocks"), *[F.when(F.size(rows) > 0, F.array(F.concat(F.lit(title), F.array_join(rows, "\n")))).otherwise(F.expr("cast(array() as array<string>)")) for title, rows in lists.items()])
    none = F.struct(F.lit(0).alias("used"), F.expr("cast(array() as array<string>)").alias("out"))

    def take(state: Column, part: Column) -> Column:
        fits = state["used"] + F.length(part) < max_chars
        return F.when(fits, F.struct((state["used"] + F.length(part)).alias("used"), F.concat(state["out"], F.array(part)).alias("out"))).otherwise(state)

    taken = facts.select(key, text, F.when(F.size("_blocks") > 0, F.array(F.lit("## CODE EXAMPLES\n"))).otherwise(F.expr("cast(array() as array<string>)")).alias("_title"), F.aggregate(offered, none, take).alias("_t"))
    room = F.when(F.col("_t.used") < max_chars * 0.7, (F.floor((max_chars - F.col("_t.used")) / 4) * 4).cast("int"))
    taken = taken.withColumn("_room", room)
    rest = extract(taken.where("_room is not null"), key, text, words, "_room").select(key, F.col("extract").alias("_rest"))
    extra = F.when(F.col("_rest").isNotNull(), F.array("_rest")).otherwise(F.expr("cast(array() as array<string>)"))
    return taken.join(rest, key, "left").select(key, F.array_join(F.concat("_title", "_t.out", extra), "\n\n").alias("extract"))
