"""License scans by diagonal voting.

Rolling word k-gram hashes of every text are joined with the positions of the
same k-grams in license templates. A match votes for its diagonal (position in
the text minus position in the template); diagonals a few words apart merge, so
inserted or dropped words do not split a copy, and a merged band is verified by
the share of template words it covers and by how tightly it lies in the text.
Notices that share their wording compete: of two bands of which one covers half
of the shorter one or more, the one with more matched words stays, then the one
with the larger share, then the first by label and place.

Phrases and k-grams are told by 64-bit hashes, which are taken as exact.

Defined edge cases: null and empty texts have no words and no labels; repeated
rows and rows with a null id are scanned each; an empty table gives no rows;
texts are worked on in slices and bands compete within blocks of the text, so a
text may be very long; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import _text as T
from lodestone.llm._shared import bounded_batches, table, written

K = 4
SLACK = 3
LEAST_COVER = 0.75
FILTER_BITS = 1 << 20
#: Templates with up to this many k-grams in all are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 500_000

# Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Words of a block in which bands compete.
BLOCK = 256

# Wording of common license notices and of the main clauses of license texts.
TEMPLATES = (
    ("mit-notice", "released under the mit license"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0"),
    ("gpl-3.0-notice", "this work is licensed under the gnu general public license version 3"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
        "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    ),
    (
        "apache-2.0-text",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses "
        "license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as "
        "is basis without warranties or conditions of any kind either express or implied",
    ),
    (
        "gpl-text",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
        "by the free software foundation either version 3 of the license or at your option any later version",
    ),
    (
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
        "are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ),
    (
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the "
        "above copyright notice and this permission notice appear in all copies",
    ),
    (
        "mit-disclaimer",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the "
        "software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for "
        "any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the "
        "software or the use or other dealings in the software",
    ),
    (
        "bsd-binary-clause",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution",
    ),
    (
        "bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission",
    ),
    (
        "bsd-disclaimer",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not "
        "limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright "
        "holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages",
    ),
    (
        "gpl-warranty",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    (
        "lgpl-text",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as "
        "published by the free software foundation either version 2 1 of the license or at your option any later version",
    ),
    (
        "agpl-text",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as "
        "published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    (
        "mpl-2.0-notice",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this "
        "file you can obtain one at",
    ),
    ("epl-2.0-notice", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at"),
    (
        "unlicense-text",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
        "distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    ("cc0-notice", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    (
        "zlib-text",
        "in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use "
        "this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ),
    (
        "bsl-1.0-text",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation "
        "covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works",
    ),
)


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return T.word_hashes(data, T.cut(data, np.array([0, len(data)]), T.ALNUM), lower=True)


def _slot_set(grams: np.ndarray) -> np.ndarray:
    bits = np.zeros(FILTER_BITS, dtype=bool)
    bits[grams & np.uint64(FILTER_BITS - 1)] = True
    return bits


def _scanner(phrases, k: int, bits):
    kinds = [(i, _hashes(p)) for i, (p, _) in enumerate(phrases)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in T.slices(batch.column(1)):
                words = T.cut(data, offsets, T.ALNUM)
                hashes = T.word_hashes(data, words, lower=True)
                at, grams = T.windows(hashes, words, k)
                near = bits.value[grams & np.uint64(FILTER_BITS - 1)]
                at, grams = at[near], grams[near]
                places, which = [], []
                for i, phrase in kinds:
                    begin = np.flatnonzero(hashes == phrase[0])
                    begin = begin[begin + len(phrase) <= len(hashes)]
                    for j in range(1, len(phrase)):
                        begin = begin[hashes[begin + j] == phrase[j]]
                    begin = begin[words.doc[begin] == words.doc[begin + len(phrase) - 1]]
                    places.append(begin)
                    which.append(np.full(len(begin), i, np.int32))
                place, what = np.concatenate(places), np.concatenate(which)
                order = np.argsort(place, kind="stable")
                place, what = place[order], what[order]

                def nested(pos: np.ndarray, values: np.ndarray, names: tuple[str, str]) -> pa.Array:
                    doc = words.doc[pos]
                    rows = pa.StructArray.from_arrays([pa.array(values), pa.array((pos - words.first[doc]).astype(np.int64))], names=list(names))
                    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)), rows)

                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(words.counts.astype(np.int64)), nested(place, what, ("phrase", "pos")), nested(at, grams.view(np.int64), ("gram", "pos"))],
                    names=["id", "n_words", "places", "grams"],
                )

    return T.trimmed(scan)


def template_grams(spark: SparkSession, templates=TEMPLATES, k: int = K) -> tuple[DataFrame, np.ndarray]:
    """(label, size, gram, t_pos) of every template position, and the filter bits of their hashes."""
    rows, found = [], [np.zeros(0, np.uint64)]
    for label, text in templates:
        h = _hashes(text)
        if len(h) < k:
            raise ValueError(f"template {label} has fewer than {k} words")
        grams = T.ranges_hash(h, np.arange(len(h) - k + 1), np.arange(len(h) - k + 1) + k, 2)
        rows += [(label, len(h), g, i) for i, g in enumerate(grams.view(np.int64).tolist())]
        found.append(grams)
    frame = spark.createDataFrame(rows, "label string, size bigint, gram bigint, t_pos bigint")
    return (F.broadcast(frame) if len(rows) <= BROADCAST_ROWS else frame), _slot_set(np.concatenate(found))


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts: row, id, n_words, places, grams; spans: row, label, first, last, cover)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    frame, bits = template_grams(spark, templates, k)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words bigint, places array<struct<phrase:int,pos:bigint>>, grams array<struct<gram:bigint,pos:bigint>>"
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_scanner(phrases, k, spark.sparkContext.broadcast(bits)), schema)
    texts = written(texts.withColumn("row", F.monotonically_increasing_id()), "licenses")
    votes = texts.select("row", F.explode("grams").alias("g")).select("row", "g.gram", "g.pos").join(frame, "gram")
    diagonals = votes.groupBy("row", "label", "size", (F.col("pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("t_pos").alias("t")
    )
    by = Window.partitionBy("row", "label").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(by) > SLACK
    bands = diagonals.withColumn("band", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(by))
    merged = bands.groupBy("row", "label", "size", "band").agg(F.min("first").alias("first"), (F.max("last") + k - 1).alias("last"), F.array_distinct(F.flatten(F.collect_list("t"))).alias("t"))
    # template words under at least one matched k-gram
    matched = F.size(F.array_distinct(F.flatten(F.transform("t", lambda p: F.sequence(p, p + k - 1)))))
    tight = (F.col("last") - F.col("first") + 1) <= 1.5 * F.col("size") + SLACK
    told = merged.withColumn("matched", matched).withColumn("cover", F.col("matched") / F.col("size")).where((F.col("cover") >= LEAST_COVER) & tight)
    return texts, _winners(told.select("row", "label", "first", "last", "matched", "cover"))


def _winners(spans: DataFrame) -> DataFrame:
    """row, label, first, last, cover of the bands that no other one beats; two meet in the blocks of words that both touch.

    A block holds few bands, as each covers most of a template; so the bands of
    a block are compared in one list.
    """
    blocks = F.sequence(F.floor(F.col("first") / BLOCK), F.floor(F.col("last") / BLOCK))
    lists = spans.withColumn("block", F.explode(blocks)).groupBy("row", "block").agg(F.collect_list(F.struct("label", "first", "last", "matched", "cover")).alias("bands"))

    def beats(b: Column, a: Column) -> Column:
        common = F.least(a["last"], b["last"]) - F.greatest(a["first"], b["first"]) + 1
        shorter = F.least(a["last"] - a["first"], b["last"] - b["first"]) + 1
        more = F.struct(b["matched"], b["cover"]) > F.struct(a["matched"], a["cover"])
        tie = (b["matched"] == a["matched"]) & (b["cover"] == a["cover"]) & (F.struct(b["label"], b["first"]) < F.struct(a["label"], a["first"]))
        return (2 * common >= shorter) & (more | tie)

    told = F.transform("bands", lambda a: F.struct(*[a[c].alias(c) for c in ("label", "first", "last", "cover")], F.exists("bands", lambda b: beats(b, a)).alias("beaten")))
    each = lists.select("row", F.inline(told))
    return each.groupBy("row", "label", "first", "last", "cover").agg(F.bool_or("beaten").alias("beaten")).where("not beaten").drop("beaten")


def op8_diagonal_voting_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, spans = scan(table(spark, sf_dir, "documents"))
    found = spans.groupBy("row").agg(F.collect_set("label").alias("own"), F.max("cover").alias("score"))
    names = F.array(*[F.lit(label) for _, label in PHRASES])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: F.get(names, p["phrase"]))))
    none = F.array().cast("array<string>")
    return texts.join(found, "row", "left").select(
        F.col("id").alias("doc_id"), "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places.pos").alias("first_word"), F.array_max("places.pos").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, F.coalesce("own", none))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


QUERIES = {"op8_diagonal_voting_licenses": op8_diagonal_voting_licenses}
ORACLES: dict[str, str] = {}
