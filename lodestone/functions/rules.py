"""Decisions about paths, texts, dates and answers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What archives leave out, and the most an archive may hold.
ARCHIVE_PREFIXES = ("enhanced_", "overview_", "tile_", "master_")
ARCHIVE_SUFFIXES = ("_backup",)
ARCHIVE_FOLDERS = ("__pycache__", "node_modules", "venv", "env", ".venv", ".git", "target", "build", "dist")
ARCHIVE_BYTES = 150 * 1024 * 1024
# Temporary scripts, texts of a failed recognition, the margin and surcharges of token totals.
TEMPORARY = r"^task_[a-f0-9]{8}\.(py|sh)$"
FAILED_TEXT = "[OCR ERROR"
WHITE = " \t\n\x0b\x0c\r"
TOKEN_MARGIN, IMAGE_TOKENS, MESSAGE_TOKENS = 1.05, 85, 4


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def glob_pattern(glob: str) -> str:
    """The anchored pattern of a glob: ``*`` any characters, ``?`` one, ``[...]`` and ``[!...]`` one of a set; an open ``[`` is itself."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2 + (glob[i + 1 : i + 2] == "!")) if c == "[" else -1
        if end > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("]", "\\]").replace("&&", "&\\&")
            out += "[^" + inner[1:] + "]" if inner.startswith("!") else "[" + ("\\^" + inner[1:] if inner.startswith("^") else inner) + "]"
            i = end + 1
            continue
        out += ".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c == "_" else "\\" + c if c.isascii() else c
        i += 1
    return rf"(?s)\A{out}\z"


def glob_matches(name: Column, glob: str) -> Column:
    """The whole name matches the glob, case and all; false for null."""
    return F.coalesce(name.rlike(glob_pattern(glob)), F.lit(False))


def any_glob(name: Column, globs: tuple[str, ...]) -> Column:
    held = F.lit(False)
    for glob in globs:
        held |= glob_matches(name, glob)
    return held


def is_project_file(path: Column) -> Column:
    """Not a temporary script."""
    return ~file_name(path).rlike(TEMPORARY)


# Image types of file extensions.
IMAGES = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".webp": "image/webp", ".gif": "image/gif", ".bmp": "image/bmp",
    ".avif": "image/avif", ".tiff": "image/tiff", ".tif": "image/tiff",
}


def image_type(url: Column, default: str = "image/jpeg") -> Column:
    """The image type that a URL's path ends in, whatever query or fragment follow."""
    path = F.regexp_replace(F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "[?#].*$", "")
    known = F.create_map(*[F.lit(x) for pair in IMAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))), F.lit(default))


def moved(path: Column, places: dict[str, str]) -> Column:
    """The path under another prefix: of the first of ``places`` at or above it; unchanged where there is none."""
    out = F
    for old, new in places.items():
        rest = F.ltrim(F.substring(path, F.lit(len(old) + 1), F.length(path)), F.lit("/"))
        at = F.when(rest == "", F.lit(new)).otherwise(F.concat(F.lit(new.rstrip("/") + "/"), rest))
        out = out.when((path == old) | path.startswith(old + "/"), at)
    return out.otherwise(path) if places else path


def inside(path: Column, root: str) -> Column:
    """The path, with ``.`` and ``..`` resolved, lies at or under the root; false for null paths.

    A fold over the parts keeps the depth below the root's own; a path that
    climbs above the file system's root never is inside.
    """
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    step = lambda kept, p: F.when((p == "..") & (F.size(kept) > 0), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.concat(kept, F.array(p)))
    resolved = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.expr("cast(array() as array<string>)"), step), "/"))
    base = "/" + root.strip("/")
    return F.coalesce((resolved == base) | resolved.startswith(base.rstrip("/") + "/"), F.lit(False))


def archivable(path: Column, size: Column) -> Column:
    """Not above the size limit, and no part of its path is left out of archives."""
    name, folders = file_name(path), F.split(path, "/")

    def left_out(d: Column) -> Column:
        out = d.isin(*ARCHIVE_FOLDERS)
        for s in ARCHIVE_SUFFIXES:
            out |= d.endswith(s)
        return out

    out = F.exists(folders, left_out)
    for p in ARCHIVE_PREFIXES:
        out |= name.startswith(p)
    return ~out & (size <= ARCHIVE_BYTES)


def enters_archive(name: Column) -> Column:
    """A folder of this name goes into an archive."""
    out = name.isin(*ARCHIVE_FOLDERS)
    for s in ARCHIVE_SUFFIXES:
        out |= name.endswith(s)
    return ~out


def size_text(size: Column) -> Column:
    """Bytes below a kilobyte, else kilobytes with one digit."""
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit("B"))).otherwise(F.concat(F.call_function("format_number", size / 1024, F.lit("0.0")), F.lit("KB")))


def usable_text(text: Column) -> Column:
    """Not blank and not the message of a failed recognition; false for null."""
    return F.coalesce((F.btrim(text, F.lit(WHITE)) != "") & ~F.btrim(text, F.lit(WHITE)).startswith(FAILED_TEXT), F.lit(False))


def valid_date(text: Column) -> Column:
    """The date of an ISO text, null (that is, no filter) where it is none."""
    return F.when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.trim(text), "yyyy-MM-dd"))


def in_years(year: Column, wanted: str | None) -> Column:
    """The year is in ``2024``, ``2022-``, ``-2020`` or ``2020-2024``; no or blank text holds for all."""
    wanted = (wanted or "").strip()
    if not wanted:
        return F.lit(True)
    low, dash, high = wanted.partition("-")
    if not dash:
        return year == int(low)
    held = F.lit(True)
    if low:
        held &= year >= int(low)
    if high:
        held &= year <= int(high)
    return held


def retry_class(status: Column) -> Column:
    """What a caller does after an HTTP status."""
    return (
        F.when(status == 429, "wait").when(status >= 500, "retry").when(status.isin(400, 413, 422), "client_error")
        .when(status == 200, "ok").otherwise("fail")
    )


def age(seconds: Column) -> Column:
    """Seconds as ``just now``, minutes, hours or days ago."""
    whole = lambda n: F.floor(seconds / n).cast("string")
    return (
        F.when(seconds < 60, "just now").when(seconds < 3600, F.concat(whole(60), F.lit("m ago")))
        .when(seconds < 86400, F.concat(whole(3600), F.lit("h ago"))).otherwise(F.concat(whole(86400), F.lit("d ago")))
    )


def preview(text: Column, lines: int = 3, size: int = 200) -> Column:
    """The first lines that are neither blank nor comments."""
    told = F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE))), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith('"""'))
    return F.substring(F.array_join(F.slice(told, 1, lines), " | "), 1, size)


def token_total(text_tokens: Column, role_tokens: Column, images: Column) -> Column:
    """Tokens of a message: text and images with the margin, cut to a whole number, its role and a surcharge."""
    content = F.floor((text_tokens + IMAGE_TOKENS * images) * TOKEN_MARGIN)
    return (F.lit(MESSAGE_TOKENS) + role_tokens + content).cast("bigint")


def saving(before: Column, after: Column) -> Column:
    """Percent of tokens (four characters each) that an extract saves."""
    old, new = F.floor(before / 4), F.floor(after / 4)
    return F.when(old > 0, (old - new) / old * 100).otherwise(0.0)
