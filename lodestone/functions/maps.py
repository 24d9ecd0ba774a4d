"""Maps and encodings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def value_or(m: Column, key: Column | str, default: Column) -> Column:
    """The value of the key, the default where the map is null, lacks the key or holds null for it."""
    return F.coalesce(F.try_element_at(m, F.lit(key)), default)


def merged(a: Column, b: Column) -> Column:
    """Entries of both; of a key in both, the value of ``b``. A null map counts as empty."""
    rest = F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.map_concat(rest, b))


def without(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def data_uri(media_type: str, content: Column) -> Column:
    # Spark may break lines after 76 characters
    return F.concat(F.lit(f"data:{media_type};base64,"), F.translate(F.base64(content), "\r\n", ""))


def media_type(uri: Column) -> Column:
    """The media type of a data URI, null for other texts."""
    return F.nullif(F.regexp_extract(uri, "^data:([^;,]+)", 1), F.lit(""))


def payload(uri: Column) -> Column:
    """The bytes of a base64 data URI, null for other texts and for what does not decode."""
    return F.when(uri.startswith("data:") & F.contains(uri, F.lit(";base64,")), F.try_to_binary(F.substring_index(uri, ",", -1), F.lit("base64")))
