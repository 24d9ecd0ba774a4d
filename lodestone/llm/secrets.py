"""Secret scans with multipart credential linking.

Plain patterns find password-like assignments, access keys and long hexadecimal
runs. Weaker candidates (identifiers, high-entropy values, endpoints) say little
alone: a Spark interval join links identifiers, secrets and endpoints that lie
within ``SCOPE`` code points of each other in one text, and a weak candidate is
reported only when a complementary part stands within its scope: a weak secret
needs an identifier, a weak identifier needs a secret, an endpoint needs both.
Every place of a text has one role: what lies in a base span is no candidate,
what lies in an endpoint is no identifier, what lies in either is no secret,
so nothing complements itself; runs of words between slashes are paths.

Spans are code points, end exclusive. Defined edge cases: null and empty texts
have no spans; repeated rows and null ids are scanned each; spans may overlap
between kinds; other columns are ignored, whatever they are called. Patterns
take time in proportion to a text's length, and links are made by blocks of
``SCOPE`` code points, so long texts and long values need no special case.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import _text as T
from lodestone.llm._shared import bounded_batches, fresh_name, table, written

KINDS = ("assign", "access", "hex")
WEAK = ("identifier", "secret", "endpoint")
SCOPE = 500

# The base patterns and the least lengths of what they match.
ASSIGN = re.compile(rb"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: Weak candidates: an identifier assigned by name, a URL or host assignment.
IDENTIFIER = re.compile(rb"""(?i:client_?id|account_?id|access_?id|key_?id|user_?name|login|user)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{3,})""")
IDENTIFIER_WORDS = (b"client", b"account", b"access", b"key", b"user", b"login")
HOST = re.compile(rb"""(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(?::[0-9]+)?""")
AFTER_SCHEME = re.compile(rb"""[A-Za-z0-9._~:/?\[\]@!$&()*+;=%-]+""")
SCHEME = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
LEAST_WEAK, LEAST_ENTROPY = 16, 3.2
#: A path: words and numbers between slashes.
PATH = re.compile(rb"(?:[A-Za-z_-]*[0-9]*/)+[A-Za-z_-]*[0-9]*")

_HEX = T._lookup(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x66)
_VALUE = T._lookup(lambda b: chr(b).isalnum() and b < 0x80 or chr(b) in "+/_-")
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def _runs(flags: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, end) of maximal runs of flagged bytes of ``least`` or more."""
    runs = T.cut(flags.view(np.uint8), offsets, np.arange(256) == 1)
    keep = runs.ends - runs.starts >= least
    return runs.doc[keep], runs.starts[keep], runs.ends[keep]


def _texts_with(raw: bytes, needles, offsets: np.ndarray) -> np.ndarray:
    """Texts in which any of the needles occurs."""
    found = set()
    for needle in needles:
        at = raw.find(needle)
        while at >= 0:
            text = int(np.searchsorted(offsets, at, side="right")) - 1
            found.add(text)
            at = raw.find(needle, int(offsets[text + 1]))
    return np.array(sorted(found), dtype=np.int64)


def _entropy(value: bytes) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _urls(text: bytes) -> Iterator[tuple[int, int]]:
    """Spans scheme://rest. From each "://" back to the first letter of the scheme, so a long run of letters is read once."""
    end = 0
    mark = text.find(b"://")
    while mark >= 0:
        begin = mark
        while begin > end and text[begin - 1] in SCHEME:
            begin -= 1
        while begin < mark and not text[begin : begin + 1].isalpha():
            begin += 1
        rest = AFTER_SCHEME.match(text, mark + 3)
        if begin < mark and rest:
            yield begin, rest.end()
        end = rest.end() if rest and begin < mark else mark + 3
        mark = text.find(b"://", end)


def _endpoints(text: bytes) -> Iterator[tuple[int, int]]:
    """URLs and host assignments outside of them."""
    end = 0
    for a, b in sorted([*_urls(text), *(m.span() for m in HOST.finditer(text))]):
        if a >= end:
            yield a, b
            end = b


def _clear_of(spans: list, taken: list) -> list:
    """The spans (text, kind, begin, end) that overlap none of the taken ones."""
    merged: dict[int, tuple[list, list]] = {}
    for d, _, s, e in sorted(taken, key=lambda x: (x[0], x[2])):
        starts, ends = merged.setdefault(d, ([], []))
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    out = []
    for span in spans:
        starts, ends = merged.get(span[0], ((), ()))
        at = bisect_left(starts, span[3])  # those before begin before the span's end
        if not at or ends[at - 1] <= span[2]:
            out.append(span)
    return out


def find(data: np.ndarray, offsets: np.ndarray) -> tuple[list, list]:
    """Base and weak spans, (text, kind, begin, end) in bytes."""
    raw = data.tobytes()
    lower = raw.lower()
    base = []

    def each(pattern: re.Pattern, needles, source: bytes):
        for text in _texts_with(source, needles, offsets).tolist():
            a, b = int(offsets[text]), int(offsets[text + 1])
            for m in pattern.finditer(raw[a:b]):
                yield text, m, a

    for text, m, a in each(ASSIGN, KEYWORDS, lower):
        if len(m[1]) >= LEAST_VALUE:
            base.append((text, "assign", a + m.start(), a + m.end()))
    for text, m, a in each(ACCESS, (b"AKIA",), raw):
        if m.end() - m.start() >= LEAST_ACCESS:
            base.append((text, "access", a + m.start(), a + m.end()))
    base += [(d, "hex", s, e) for d, s, e in zip(*(x.tolist() for x in _runs(_HEX[data], offsets, LEAST_HEX)), strict=True)]
    endpoints, identifiers, values = [], [], []
    named = lower if any(c in raw for c in (b":", b"=")) else b""
    for text in _texts_with(named, (b"://", b"host", b"endpoint", b"server"), offsets).tolist():
        a = int(offsets[text])
        endpoints += [(text, "endpoint", a + s, a + e) for s, e in _endpoints(raw[a : int(offsets[text + 1])])]
    for text, m, a in each(IDENTIFIER, IDENTIFIER_WORDS, named):
        identifiers.append((text, "identifier", a + m.start(), a + m.end()))
    for d, s, e in zip(*(x.tolist() for x in _runs(_VALUE[data], offsets, LEAST_WEAK)), strict=True):
        value = raw[s:e]
        if re.search(rb"[0-9]", value) and re.search(rb"[A-Za-z]", value) and not PATH.fullmatch(value) and _entropy(value) >= LEAST_ENTROPY:
            values.append((d, "secret", s, e))
    # a place has the role of the first kind that holds it
    weak = []
    for kind in (endpoints, identifiers, values):
        weak += _clear_of(kind, base + weak)
    return base, weak


def _column(spans: list, n: int, before: np.ndarray) -> pa.Array:
    spans = sorted(spans, key=lambda x: (x[0], x[2], (KINDS + WEAK).index(x[1])))
    doc = np.array([x[0] for x in spans], dtype=np.int64)
    values = pa.StructArray.from_arrays(
        [pa.array([x[1] for x in spans], pa.string()), pa.array(before[[x[2] for x in spans]] if spans else [], pa.int64()), pa.array(before[[x[3] for x in spans]] if spans else [], pa.int64())],
        fields=list(_SPAN),
    )
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), values)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in T.slices(batch.column(1)):
            base, weak = find(data, offsets)
            # code points before each byte of its own text
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            shift = points[offsets]

            def local(spans: list) -> pa.Array:
                column = _column(spans, hi - lo, points)
                doc = np.repeat(np.arange(hi - lo), np.diff(column.offsets.to_numpy()))
                kind, start, end = (column.values.field(i) for i in range(3))
                start, end = (pa.array(x.to_numpy() - shift[doc]) for x in (start, end))
                return pa.ListArray.from_arrays(column.offsets, pa.StructArray.from_arrays([kind, start, end], fields=list(_SPAN)))

            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), local(base), local(weak)], names=["id", "base", "weak"])


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id, base and weak spans of each text."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(T.trimmed(_scan), f"id {kind}, base {_SPANS}, weak {_SPANS}")
    return found.withColumn("row", F.monotonically_increasing_id())


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(row, kind, start, end) of the weak candidates that a complementary part stands by.

    The join is on (row, block of ``scope`` code points): a part stands in every
    block that it covers, a weak candidate looks into every block within scope
    of it, so every pair within scope meets, however long the two are. Parts
    that overlap a candidate do not complement it.
    """
    role = F.when(F.col("s.kind").isin("access", "identifier"), "identifier").when(F.col("s.kind") == "endpoint", "endpoint").otherwise("secret")
    parts = found.select("row", F.explode(F.concat("base", "weak")).alias("s")).select("row", role.alias("role"), F.col("s.start").alias("p_start"), F.col("s.end").alias("p_end"))
    blocks = lambda first, last: F.explode(F.sequence(F.floor(first / scope), F.floor(last / scope)))
    offered = (
        parts.where(F.col("role") != "endpoint").withColumn("block", blocks(F.col("p_start"), F.col("p_end")))
        .groupBy("row", "block", "role").agg(F.array_sort(F.collect_set(F.struct("p_start", "p_end"))).alias("parts"))
    )
    weak = found.select("row", F.explode("weak").alias("s")).select("row", "s.kind", "s.start", "s.end", blocks(F.col("s.start") - scope, F.col("s.end") + scope).alias("block"))
    near = F.expr(f"exists(parts, p -> p.p_start - `end` <= {scope} and start - p.p_end <= {scope} and (p.p_start >= `end` or p.p_end <= start))")
    met = weak.join(offered, ["row", "block"]).where(near)
    needed = F.when(F.col("kind") == "secret", F.array_contains("roles", "identifier")).when(F.col("kind") == "identifier", F.array_contains("roles", "secret")).otherwise(F.size("roles") == 2)
    return met.groupBy("row", "kind", "start", "end").agg(F.collect_set("role").alias("roles")).where(needed).drop("roles")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """id, base and all: spans sorted by start, then kind (base kinds first)."""
    found = written(candidates(docs, id_col, text_col), "spans")
    links = linked(found, scope).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))
    order = ", ".join(f"'{k}'" for k in KINDS + WEAK)
    spans = F.expr(
        f"transform(array_sort(transform(concat(base, coalesce(linked, cast(array() as {_SPANS}))), "
        f"x -> struct(x.start as start, array_position(array({order}), x.kind) as k, x.kind as kind, x.`end` as `end`))), x -> struct(x.kind as kind, x.start as start, x.`end` as `end`))"
    )
    return found.join(links, "row", "left").select(F.col("id").alias(id_col), "base", spans.alias("spans"))


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; ``spans`` has one row an id and only ids with spans."""
    # overlapping spans merge; what lies between them is kept
    merged = F.expr(
        "aggregate(spans, cast(array() as array<struct<a:bigint,b:bigint>>), (m, x) -> if(size(m) > 0 and element_at(m, -1).b >= x.start, "
        "concat(slice(m, 1, size(m) - 1), array(struct(element_at(m, -1).a as a, greatest(element_at(m, -1).b, x.`end`) as b))), concat(m, array(struct(x.start as a, x.`end` as b)))))"
    )
    key, cuts = fresh_name(docs, "_id"), fresh_name(docs, "_cuts")
    found = spans.select(F.col(id_col).alias(key), merged.alias(cuts))
    text = F.expr(
        f"concat(array_join(transform(`{cuts}`, (c, i) -> substring(`{text_col}`, cast(if(i = 0, 0, `{cuts}`[i - 1].b) + 1 as int), cast(c.a - if(i = 0, 0, `{cuts}`[i - 1].b) as int))), '{mark}'), "
        f"'{mark}', substring(`{text_col}`, cast(element_at(`{cuts}`, -1).b + 1 as int)))"
    )
    joined = docs.join(found, docs[id_col] == F.col(key), "left")
    return joined.withColumn(text_col, F.when(F.col(cuts).isNull(), F.col(text_col)).otherwise(text)).drop(key, cuts)


def op4_multipart_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


QUERIES = {"op4_multipart_secrets": op4_multipart_secrets}
ORACLES: dict[str, str] = {}
