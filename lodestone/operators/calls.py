"""Tool-call logs: union of call lists, attribution, and one-line summaries as one CASE over the tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.rules import file_name, inside

# Marks and the header of a summary; result markers and lengths stand in the cases below.
YES, NO = "✓", "✗"
HEADER = ("[POWERS USED — ", " call(s)]\n")


def union_calls(tagged: DataFrame, native: DataFrame, key: str) -> DataFrame:
    """Tagged calls (key, pos, fn, args map), and the native ones that no tagged call equals in tool and arguments."""

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("_args", F.to_json(F.array_sort(F.map_entries("args"))))

    rest = marked(native).join(marked(tagged).select(key, "fn", "_args"), [key, "fn", "_args"], "left_anti")
    first = F.row_number().over(Window.partitionBy(key, "fn", "_args").orderBy("pos"))
    return tagged.unionByName(rest.withColumn("_r", first).where("_r = 1").select(*tagged.columns))


def same_tools(advertised: DataFrame, known: DataFrame) -> bool:
    """Both tables hold the same tools."""
    return advertised.exceptAll(known).isEmpty() and known.exceptAll(advertised).isEmpty()


def _arg(name: str, default: str = "", size: int | None = None) -> Column:
    value = F.coalesce(F.try_element_at("args", F.lit(name)), F.lit(default))
    return F.substring(value, 1, size) if size else value


def _mark(ok: Column) -> Column:
    return F.when(ok, YES).otherwise(NO)


def _has(text: str) -> Column:
    return F.contains(F.lower("result"), F.lit(text))


def summary() -> Column:
    """The summary of a row (fn, args map<string,string>, result)."""
    result = F.col("result")
    ok = _has('"success": true') | _has('"success":true')
    failed = _has('"success": false') | _has('"success":false') | F.lower(F.trim("result")).rlike(r"^(\[error\]|error:)")
    last = F.element_at(F.filter(F.transform(F.slice(F.split(result, "\n"), 2, 1 << 30), lambda x: F.trim(x)), lambda x: x != ""), -1)
    missed = result.startswith("[SYSTEM: search_history]") | result.startswith("[search_history]") | result.startswith("[ERROR]")
    nothing = (result == "") | result.rlike(r"^(No matches|No semantically related|Semantic search is disabled)") | F.contains(result, F.lit("no indexed code chunks available"))

    def quoted(tool: str, size: int, arg: str = "query") -> Column:
        return F.concat(F.lit(f"{tool}('"), _arg(arg, "", size), F.lit("') → "))

    def count(pattern: str) -> Column:
        return F.regexp_count(result, F.lit(pattern)).cast("string")

    context = F.when(_arg("context") != "", F.concat(F.lit(", ctx='"), _arg("context", "", 30), F.lit("'"))).otherwise("")
    changes = F.concat(F.lit(" ("), F.get_json_object(result, "$.changes.removed"), F.lit(" lines → "), F.get_json_object(result, "$.changes.added"), F.lit(" lines)"))
    command = F.concat(_arg("command", "", 60), F.when(F.length(_arg("command")) > 60, "…").otherwise(""))

    def ingested(tool: str, done: str, skip: str) -> Column:
        skipped = F.contains(result, F.lit(skip))
        return F.concat(F.lit(f"{tool}("), _arg("filename", "?"), F.lit(") → "), _mark(skipped | F.trim(result).startswith(done)), F.when(skipped, " (unchanged, skipped)").otherwise(""))

    year = F.when(_arg("year") != "", F.concat(F.lit(" ["), _arg("year"), F.lit("]"))).otherwise("")
    cases = {
        "url_search": F.concat(F.lit("url_search("), _arg("url", "", 70), context, F.lit(") → "), _mark(F.ltrim(result).startswith("[SOURCE:"))),
        "quick_search": F.concat(quoted("quick_search", 70), _mark(F.contains(result, F.lit("[CONTENT]:")))),
        "search_history": F.concat(quoted("search_history", 60), F.when(missed, F.concat(F.lit(NO + " ("), F.substring(F.trim(result), 1, 80), F.lit(")"))).otherwise(F.concat(F.lit(YES + " "), count(r"\n\[\d+\]"), F.lit(" result(s)")))),
        "str_replace": F.concat(F.lit("str_replace("), _arg("file", "?"), F.lit(") → "), _mark(ok), F.when(ok, F.coalesce(changes, F.lit(""))).otherwise("")),
        "view_lines": F.concat(F.lit("view_lines("), _arg("file", "?"), F.lit(", "), _arg("start", "?"), F.lit("–"), _arg("end", "?"), F.lit(") → "), F.when(ok, YES).when(failed, NO).otherwise("?")),
        "search_in_file": F.concat(F.lit("search_in_file("), _arg("file", "?"), F.lit(", '"), _arg("pattern", "", 40), F.lit("') → "), F.coalesce(F.get_json_object(result, "$.total_matches"), F.lit("?")), F.lit(" match(es)")),
        "workspace_search": F.concat(quoted("workspace_search", 50), F.when(nothing, "0").otherwise((F.regexp_count(result, F.lit("\n")) + 1).cast("string")), F.lit(" line(s)")),
        "doc_search": F.concat(quoted("doc_search", 60), F.when(F.contains(result, F.lit("No embedded documents")) | F.contains(result, F.lit("No chunks")) | F.contains(F.substring(result, 1, 30), F.lit("ERROR")), "no results").otherwise(F.concat(count("📄 \\["), F.lit(" passage(s) found")))),
        "bash": F.concat(F.lit("bash("), command, F.lit(") → "), _mark(result.startswith("[exit 0]")), F.coalesce(F.concat(F.lit(" | "), F.substring(last, 1, 80)), F.lit(""))),
        "show_image": F.concat(F.lit("show_image("), _arg("file", "?"), F.lit(") → "), _mark(ok)),
        "ingest_pdf": ingested("ingest_pdf", "✅ PDF ingested:", "already ingested and unchanged"),
        "ingest_chat": ingested("ingest_chat", "✅ Imported", "already imported"),
        "ingest_text": ingested("ingest_text", "✅ Text ingested:", "already ingested"),
        "search_semantic_scholar": F.concat(quoted("search_semantic_scholar", 50), year, _mark(F.regexp_count(result, F.lit(r"(?m)^\d+\.\s+")) > 0), F.lit(" "), count(r"(?m)^\d+\.\s+"), F.lit(" results")),
    }
    generic = F.concat(F.col("fn"), F.lit("("), F.array_join(F.slice(F.map_keys("args"), 1, 3), ", "), F.lit(") → "), F.when(failed, NO).when(ok, YES).otherwise("?"))
    out = F
    for fn, text in cases.items():
        out = out.when(F.col("fn") == fn, text)
    return out.otherwise(generic)


def summarised(log: DataFrame, turn: str, order: str) -> DataFrame:
    """turn, summary: a header with the number of calls, then a numbered line for each."""
    one = log.select(turn, F.row_number().over(Window.partitionBy(turn).orderBy(order)).alias("i"), summary().alias("line"))
    listed = one.groupBy(turn).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("i", "line"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("  "), x["i"].cast("string"), F.lit(". "), x["line"])), "\n")
    return listed.select(turn, F.concat(F.lit(HEADER[0]), F.col("n").cast("string"), F.lit(HEADER[1]), body).alias("summary"))


def attributed(log: DataFrame, turn: str, order: str, outputs: str, commands: int = 5, size: int = 80) -> DataFrame:
    """turn, modified, outputs_created (sorted names of edited files) and commands (the first ones, cut) of calls (fn, args).

    An edit of a file under ``outputs`` creates an output; one without a file tells nothing.
    """
    target = F.nullif(_arg("file"), F.lit(""))
    edit = (F.col("fn") == "str_replace") & target.isNotNull()
    command = F.trim(F.substring(_arg("command"), 1, size))
    shell = (F.col("fn") == "bash") & (command != "")
    out = inside(target, outputs)
    rows = log.select(turn, order, F.when(edit & ~out, file_name(target)).alias("m"), F.when(edit & out, file_name(target)).alias("o"), F.when(shell, command).alias("c"))
    nth = F.row_number().over(Window.partitionBy(turn, F.col("c").isNull()).orderBy(order))
    told = rows.withColumn("_n", nth)
    first = F.collect_list(F.when(F.col("c").isNotNull() & (F.col("_n") <= commands), F.struct("_n", "c")))
    return told.groupBy(turn).agg(
        F.array_sort(F.collect_set("m")).alias("modified"), F.array_sort(F.collect_set("o")).alias("outputs_created"),
        F.transform(F.array_sort(first), lambda x: x["c"]).alias("commands"),
    )
