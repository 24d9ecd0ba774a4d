"""Exact Jaccard self-join of word-shingle sets by metric-space regions.

Sets live in the symmetric-difference metric D. With the threshold num/den,
linked sets of sizes p and q have D <= (p + q)(den - num)/(den + num).

1. The empty set is the first pivot. Its Voronoi rings hold sets of similar
   size; by the triangle inequality a linked set's size is near, so documents
   close to a ring's lower border are replicated into it.
2. A ring's universe is split into one sub-universe more than D can reach, so
   two linked sets are at distance 0 in at least one: their projections there
   are equal. Equal projections make the regions of the second level. (Pivot
   documents would not separate anything here: unrelated texts are all at
   distance 1 from each other.)
3. A first round joins only the regions of ``CLOSE`` sub-universes: a spanning
   forest of near pairs in each, or in regions above ``LEAF`` members an edge
   from each member to the nearest of ``PIVOTS`` pivots. Edges are verified on
   the sets, and give first components.
4. The second round takes every region in which two components still meet;
   keys are computed anew for it, as all of them together outweigh the texts.
   Of regions with the same members one is enough. Regions above ``LEAF`` members are split again and again by pivots drawn
   from them: a member goes to the Voronoi region of its nearest pivot, and to
   every region whose pivot is nearer than that plus twice the greatest D of a
   link. Distances are Hamming distances of parity sketches, a contraction of
   D, so no link is lost. What pivots cannot split is joined block by block.
5. In a leaf, pairs across components whose sketches are near enough are
   candidates; in the second round a sketch of a bit an element, of ``FOLD``
   bits at most, must be near too. A spanning forest of them is verified, so a
   leaf makes fewer edges than it has members; regions with a failed edge are
   gone through again, with the new components and without the failed edges,
   until no edge of a forest fails. So components are exact. Each time
   ``WIDER`` times as many of the nearest other candidates come along, so a leaf
   takes few rounds even where most of its pairs fail. Verifying means a parity
   sketch of a bit an element first, which hardly any unlinked pair passes, and
   then the sets themselves.

Equal sets are one class from the start and one member of the join; classes
are told in two steps, by shares of a class and then by class, so that a class
of any size is never one group.

Defined edge cases: texts without words and null texts have the empty set and
link with nothing; rows that share an id are one node; null ids stand alone
with a null component; ids are whole numbers (others fail to cast); other
columns are ignored. A text is hashed whole, so a task needs about 100 bytes of
memory a byte of its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import _chunks as C
from lodestone.llm import _text as T
from lodestone.llm._shared import bounded_batches, discard, small, table, written
from lodestone.llm.components import components

SHINGLE = 3
NUM, DEN = 90, 100
GROWTH = 1.6
SKETCH_BITS, SKETCH_WORDS = 256, 4
LEAF = 512
#: Bits of the sketches that go into leaves, at most; longer sets have a bit for several elements there.
FOLD = 8192
#: How much more candidates a leaf gives each time that its forest has failed.
WIDER = 4
#: Candidates of a bundle of leaves whose sketches are compared at once.
PAIRS = 1 << 17
#: Sub-universes of the first round.
CLOSE = 1
#: Shares in which a class of equal sets is told first.
SHARES = 1024
PIVOTS, LEVELS = 8, 3
#: Regions are split by pivots while a member goes to so many of the new regions on average.
WORTH = 2.0
#: Bits of the filters of region keys; they only let rows through that cannot matter.
FILTER_BITS = 1 << 25
REGION_ROWS, REGION_BYTES = 50_000, 8 << 20
LEAST_BUNDLES = 256
_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
_SKETCHES = ", ".join(f"{s} bigint" for s in _SKETCH)
_ROWS = f"id bigint, n bigint, f1 bigint, f2 bigint, lead bigint, {_SKETCHES}, long binary, fold binary, keys array<bigint>"
_MEMBER = f"key bigint, id bigint, n bigint, component bigint, {_SKETCHES}"
_COLUMNS = ("key", "id", "n", "component", *_SKETCH, "fold")
_EDGE = "key bigint, a bigint, b bigint"


def reach(sizes, num: int = NUM, den: int = DEN):
    """The greatest D of linked sets whose sizes sum to ``sizes``."""
    return sizes * (den - num) // (den + num)


def rings(num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(smallest size, sub-universes, those of them that may be empty, smallest size of guests) of each ring.

    With ``spare`` sub-universes more, two linked sets agree in more than
    ``spare`` of them, so also in a non-empty one if one set has at most
    ``spare`` empty projections. The smallest sets of a ring have so many and a
    standard deviation less than that on average.
    """
    low, high = [1], []
    while low[-1] < 1 << 40:
        high.append(max(low[-1], int(low[-1] * GROWTH)))
        low.append(high[-1] + 1)
    low, high = np.array(low[:-1]), np.array(high)
    least = reach(2 * high, num, den) + 1
    guests = -(-num * low // den)
    spare = np.zeros(len(low), np.int64)
    for _ in range(60):
        m = (least + spare).astype(np.float64)
        with np.errstate(divide="ignore"):
            empty = m * np.exp(guests * np.log1p(-1 / m))
        spare = np.minimum(least, (empty + np.sqrt(empty)).astype(np.int64))
    return low, least + spare, spare, guests


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sorted within each text; first of each text) of the distinct k-word shingles; a shorter text is one shingle."""
    words = T.cut(data, offsets, T.SPACED)
    h = T.word_hashes(data, words, lower=True)
    at, grams = T.windows(h, words, k)
    doc = words.doc[at]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        grams = np.concatenate([grams, T.ranges_hash(h, words.first[short], words.first[short + 1], 2)])
        doc = np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    if len(grams):
        new = np.append(True, (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1]))
        grams, doc = grams[new], doc[new]
    return grams, np.searchsorted(doc, np.arange(len(offsets)))


def _sum(values: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 by slot."""
    low = np.bincount(slot, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    return low + (np.bincount(slot, (values >> np.uint64(32)).astype(np.float64), n).astype(np.uint64) << np.uint64(32))


def region_keys(grams: np.ndarray, first: np.ndarray, docs: np.ndarray, parents: np.ndarray, classes: np.ndarray, spare: np.ndarray, level: int = 0):
    """(document, key, number of the sub-universe) of each document's projections on ``classes`` sub-universes of its parent region.

    Empty projections say nothing; a document with more than ``spare`` of them
    is split again, as a whole, by fresh sub-universes. So of two linked sets
    either one has a level of its own where they meet, or both go on together.
    """
    sizes = first[docs + 1] - first[docs]
    owner = np.repeat(np.arange(len(docs)), sizes)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[docs], sizes)
    h = T.mix(grams[at] + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF))
    base = np.cumsum(classes) - classes
    total = int(classes.sum())
    slot = base[owner] + (h % classes[owner].astype(np.uint64)).astype(np.int64)
    whose = np.repeat(np.arange(len(docs)), classes)
    number = np.arange(total) - base[whose]
    filled = np.bincount(slot, minlength=total) > 0
    place = T.mix(parents[whose] + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    keys = T.mix(_sum(T.mix(grams[at]), slot, total) ^ place)
    yield docs[whose[filled]], keys[filled], number[filled]
    poor = np.bincount(whose[~filled], minlength=len(docs)) > spare
    if poor.any():
        yield from region_keys(grams, first, docs[poor], T.mix(parents[poor] + np.uint64(level + 1)), classes[poor], spare[poor], level + 1)


def long_sketches(grams: np.ndarray, first: np.ndarray, most: int = 1 << 40) -> pa.Array:
    """A parity sketch of each set, of a power of two of bits, 64 or at least one an element, but not over ``most``."""
    n = np.diff(first)
    size = np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), 64, most)
    ends = np.cumsum(size)
    bit = (T.mix(grams + np.uint64(0x8EBC6AF09C88C6E3)) & np.repeat(size - 1, n).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(np.repeat(ends - size, n) + bit, minlength=int(ends[-1]) if len(ends) else 0) & 1
    offsets = np.concatenate([[0], ends // 8]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.packbits(odd.astype(np.uint8), bitorder="little"))])


def sketch_distances(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Hamming distances of long sketches, the longer one folded to the shorter one's size."""
    out = np.zeros(len(x), np.int64)
    for i, (a, b) in enumerate(zip(x, y, strict=True)):
        a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
        short = min(len(a), len(b))
        if len(a) != len(b):
            a, b = (np.bitwise_xor.reduce(v.reshape(-1, short), axis=0) for v in (a, b))
        out[i] = np.bitwise_count(a ^ b).sum(dtype=np.int64)
    return out


def fold_distances(column: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Hamming distances of the pairs (i, j) of a column's sketches, the longer one folded to the shorter one's size."""
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 8
    words, length = np.frombuffer(data, np.uint64, len(data) // 8), np.diff(starts)

    def folded(rows: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((len(rows), size), np.uint64)
        for own in np.unique(length[rows]).tolist():
            at = np.flatnonzero(length[rows] == own)
            out[at] = np.bitwise_xor.reduce(words[starts[rows[at], None] + np.arange(own)].reshape(-1, own // size, size), axis=1)
        return out

    out, short = np.zeros(len(i), np.int64), np.minimum(length[i], length[j])
    for size in np.unique(short).tolist():
        at = np.flatnonzero(short == size)
        for lo in range(0, len(at), 1 << 14):
            e = at[lo : lo + (1 << 14)]
            out[e] = np.bitwise_count(folded(i[e], size) ^ folded(j[e], size)).sum(axis=1, dtype=np.int64)
    return out


class _Rings:
    def __init__(self, num: int, den: int):
        self.low, self.classes, self.spare, self.guests = rings(num, den)

    def keys(self, grams: np.ndarray, first: np.ndarray, native: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, key, number of the sub-universe) of the given documents in their own ring and, near its border, in the next."""
        n = np.diff(first)
        home = np.searchsorted(self.low, n, side="right") - 1
        guest = native[n[native] >= self.guests[home[native] + 1]]
        members = np.concatenate([native, guest])
        ring = np.concatenate([home[native], home[guest] + 1])
        found = list(region_keys(grams, first, members, T.mix(ring.astype(np.uint64)), self.classes[ring], self.spare[ring])) if len(members) else []
        return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, (np.int64, np.uint64, np.int64)[i]) for i in range(3))


def parity_sketch(grams: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """(docs, SKETCH_WORDS): bit b tells whether an odd number of elements hash to b."""
    bit = (T.mix(grams + np.uint64(0xE7037ED1A0B428DB)) & np.uint64(SKETCH_BITS - 1)).astype(np.int64)
    odd = np.bincount(doc * SKETCH_BITS + bit, minlength=docs * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(docs, SKETCH_WORDS)


def _leaders(ids: np.ndarray, live: np.ndarray, *mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smallest id of the live rows with the same mark, whether a row is the first with that id) of each row."""
    lead, first = np.zeros(len(ids), np.int64), np.zeros(len(ids), dtype=bool)
    at = np.flatnonzero(live)
    if len(at):
        order = at[np.lexsort((ids[at], *(m[at] for m in mark)))]
        new = np.append(True, np.any([m[order][1:] != m[order][:-1] for m in mark], axis=0))
        lead[order] = ids[order][new][np.cumsum(new) - 1]
        first[order[new]] = True
    return lead, first


def _sketched(k: int, num: int, den: int):
    ringed = _Rings(num, den)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in T.slices(batch.column(1)):
                ids = batch.column(0).slice(lo, hi - lo)
                grams, first = shingle_sets(data, offsets, k)
                n, docs = np.diff(first), hi - lo
                doc = np.repeat(np.arange(docs), n)
                f1, f2 = _sum(T.mix(grams), doc, docs), _sum(T.mix(grams ^ np.uint64(0xA0761D6478BD642F)), doc, docs)
                sketches = parity_sketch(grams, doc, docs)
                # of equal sets in a slice only the one with the smallest id carries keys
                live = (n > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
                lead, lone = _leaders(ids.fill_null(0).to_numpy(), live, f1, f2, n)
                owner, keys, number = ringed.keys(grams, first, np.flatnonzero(lone))
                close = number < CLOSE
                owner, keys = owner[close], keys[close]
                by = np.argsort(owner, kind="stable")
                listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[by], np.arange(docs + 1)).astype(np.int32)), pa.array(keys[by].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(n.astype(np.int64)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(lead, mask=~live),
                        *[pa.array(sketches[:, i]) for i in range(SKETCH_WORDS)], long_sketches(grams, first), long_sketches(grams, first, FOLD), pa.ListArray.from_arrays(listed.offsets, listed.values, mask=pa.array(~lone)),
                    ],
                    names=["id", "n", "f1", "f2", "lead", *_SKETCH, "long", "fold", "keys"],
                )

    return T.trimmed(sketch)


def _regions(k: int, num: int, den: int, bits: int, filter_):
    """Of (id, component, text): all region keys as halves by shard or, with a filter, the members of regions in it."""
    ringed = _Rings(num, den)

    def halves(keys: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(keys)
        keys, part = keys[order], part[order]
        if len(part) and 0 <= part.min() and part.max() < 1 << 32:
            part = part.astype(np.uint32)  # told by its length
        rows = list(C.split(C.shard_edges(keys, bits), ((keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32), part))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2)]], names=["shard", "halves", "parts"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in T.slices(batch.column(2)):
                ids, part = (batch.column(i).slice(lo, hi - lo).to_numpy() for i in (0, 1))
                grams, first = shingle_sets(data, offsets, k)
                owner, keys, _ = ringed.keys(grams, first, np.flatnonzero(np.diff(first)))
                if filter_ is None:
                    yield halves(keys, part[owner])
                    continue
                ok = _in_filter(filter_.value, _key_slots(keys, bits))
                owner, keys = owner[ok], keys[ok]
                sketches = parity_sketch(grams, np.repeat(np.arange(hi - lo), np.diff(first)), hi - lo)[owner]
                columns = [keys.view(np.int64), ids[owner], np.diff(first)[owner].astype(np.int64), part[owner], *[sketches[:, i] for i in range(SKETCH_WORDS)]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(_COLUMNS[:-1]))

    return T.trimmed(cut)


def _filter_slot(shard: np.ndarray, half: np.ndarray) -> np.ndarray:
    return T.mix(half.astype(np.uint64) + (np.uint64(1) << np.uint64(32)) * shard.astype(np.uint64)) & np.uint64(FILTER_BITS - 1)


def _key_slots(keys: np.ndarray, bits: int) -> np.ndarray:
    shard = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    return _filter_slot(shard, (keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF))


def _slot_rows(slots: np.ndarray) -> pa.Table:
    slots = np.unique(slots)
    word, at = np.unique(slots >> np.uint64(6), return_inverse=True)
    bits = np.zeros(len(word), np.uint64)
    np.bitwise_or.at(bits, at, np.uint64(1) << (slots & np.uint64(63)))
    return pa.table({"word": pa.array(word.astype(np.int64)), "bits": pa.array(bits.view(np.int64))})


def _mixed(key, table):
    """Filter bits of the halves in a shard that two components or more have."""
    halves, sizes = C.joined(table, "halves", np.uint32)
    part = np.concatenate([np.frombuffer(x.as_buffer(), f"u{len(x.as_buffer()) // n}").astype(np.uint64) for x, n in zip(table.column("parts").combine_chunks(), sizes.tolist(), strict=True)])
    order = np.argsort(halves)
    halves, part = halves[order], part[order]
    begin = np.flatnonzero(np.append(True, halves[1:] != halves[:-1]))
    found = halves[begin][np.minimum.reduceat(part, begin) != np.maximum.reduceat(part, begin)]
    return _slot_rows(_filter_slot(np.full(len(found), key[0].as_py()), found))


def _filter(rows: DataFrame, bits: int) -> np.ndarray:
    """The filter (word, bits) as an array; it has ``bits`` bits whatever the input."""
    found = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def _in_filter(filter_: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (filter_[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _first_members(kept: DataFrame) -> DataFrame:
    return kept.select(F.explode("keys").alias("key"), "id", "n", F.col("id").alias("component"), *_SKETCH)


def _distance(p: Column) -> Column:
    return sum((F.bit_count(F.col(s).bitwiseXOR(p[s])) for s in _SKETCH), F.lit(0))


def _pivots(rows: DataFrame, level: int) -> DataFrame:
    """(key, pivots): PIVOTS members at most of each region."""
    order = F.xxhash64("id", F.lit(level))
    one = rows.groupBy("key", F.pmod(order, F.lit(PIVOTS)).alias("salt")).agg(F.min(F.struct(order.alias("o"), "id", "n", *_SKETCH)).alias("pivot"))
    return one.groupBy("key").agg(F.array_sort(F.collect_list("pivot")).alias("pivots"))


def _close_edges(members: DataFrame, num: int, den: int, bundles: int) -> DataFrame:
    """(a, b) of the first round: forests of small regions, and the nearest pivot of each member of a large one."""
    large = written(members.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > LEAF).select("key"), "large")
    found = _forests(members.join(small(large), "key", "left_anti"), num, den, bundles).select("a", "b")
    if not large.isEmpty():
        rest = members.join(small(large), "key")
        pivots = small(written(_pivots(rest, 0), "pivots"))
        near = F.array_min(F.transform("pivots", lambda p: F.struct(_distance(p).alias("far"), p["id"].alias("id"), p["n"].alias("n"))))
        stars = rest.join(pivots, "key").select("id", "n", near.alias("p")).where((F.col("id") != F.col("p.id")) & (F.col("p.far") <= F.floor((F.col("n") + F.col("p.n")) * (den - num) / (den + num))))
        found = found.union(stars.select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")))
    return found.distinct()


def _distinct_regions(members: DataFrame, kept: DataFrame) -> DataFrame:
    """The members of regions in which components meet, one region of those with the same members, with the sketches for leaves.

    Members are told by four sums of 32 hash bits each.
    """
    row = ["id", "n", *_SKETCH]
    hashes = [F.xxhash64(*row), F.xxhash64(F.lit(1), *reversed(row))]
    sums = [F.sum(half) for h in hashes for half in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    names = ["size", *[f"h{i}" for i in range(len(sums))]]
    sets = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), *[x.alias(name) for x, name in zip([F.count("*"), *sums], names, strict=True)])
    one = written(sets.where("low != high").groupBy(*names).agg(F.min("key").alias("key")).select("key"), "regions")
    # a row without a sketch is a copy of another member's set
    return written(members.join(small(one), "key", "left_semi").join(kept.select(*row, "fold").distinct(), row).select(*_COLUMNS), "members")


def _split_large(members: DataFrame, num: int, den: int) -> DataFrame:
    """Members of regions of LEAF or fewer; larger regions are split by pivots, and by blocks where pivots don't help."""
    # the greatest D of a link: the other set has at most n * den / num elements
    link = F.floor((F.col("n") + F.floor(F.col("n") * den / num)) * (den - num) / (den + num))
    done = None

    def add(rows: DataFrame) -> None:
        nonlocal done
        rows = rows.select(*_COLUMNS)
        done = rows if done is None else done.unionByName(rows)

    for level in range(LEVELS + 1):
        large = written(members.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > LEAF), "large")
        narrow = small(large)
        add(members.join(narrow, "key", "left_anti"))
        if large.isEmpty():
            break
        rest = members.join(narrow, "key")
        if level < LEVELS:
            far = rest.join(small(written(_pivots(rest, level), "pivots")), "key").withColumn("far", F.transform("pivots", _distance))
            inside = F.filter(F.sequence(F.lit(0), F.size("far") - 1), lambda j: F.get(F.col("far"), j) <= F.array_min("far") + 2 * link)
            far = far.withColumn("inside", inside)
            useful = written(far.groupBy("key").agg(F.avg(F.size("inside")).alias("copies")).where(F.col("copies") <= WORTH).select("key"), "useful")
            regions = far.join(useful, "key", "left_semi").withColumn("region", F.explode("inside"))
            members = written(regions.select(F.xxhash64("key", "region", F.lit(level)).alias("key"), *_COLUMNS[1:]), "regions")
            rest = rest.join(useful, "key", "left_anti")
        # what pivots cannot split: every two blocks of half a leaf meet
        blocks = F.ceil(F.col("size") / (LEAF // 2))
        pairs = rest.withColumn("mine", F.pmod(F.xxhash64("id"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
        add(pairs.withColumn("key", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))))
    return done


def _near(n: np.ndarray, sketch: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of the pairs i < j of a leaf that can be linked."""
    found = []
    for a in range(0, len(n), 256):  # bounds the memory of a leaf
        rows = slice(a, a + 256)
        far = np.bitwise_count(sketch[rows, None, :] ^ sketch[None, a:, :]).sum(axis=2, dtype=np.int64)
        low, high = np.minimum(n[rows, None], n[None, a:]), np.maximum(n[rows, None], n[None, a:])
        i, j = np.nonzero((far <= reach(low + high, num, den)) & (den * low >= num * high))
        up = j > i
        i, j = i[up], j[up]
        found.append((a + i, a + j, far[i, j]))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


def _forest(i: np.ndarray, j: np.ndarray, far: np.ndarray, part: np.ndarray, wider: int = 1) -> list[int]:
    """Indexes of the edges of a spanning forest of the parts, nearest pairs first, then of ``wider`` - 1 times as many other edges as there are rows."""
    ends = np.unique(np.concatenate([i, j]))
    root = {p: p for p in part[ends].tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out, rest = [], []
    for e in np.lexsort((j, i, far)).tolist():
        a, b = find(int(part[i[e]])), find(int(part[j[e]]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append(e)
        else:
            rest.append(e)
    return out + rest[: (wider - 1) * len(ends)]


def _leaves(num: int, den: int, wider: int):
    """Candidate edges of a bundle of leaves, across components: a forest of each and, if ``wider`` is over 1, more; ``tried`` ones are left out."""

    def edges(rows: pa.Table, tried: pa.Table | None = None) -> pa.Table:
        rows = rows.sort_by([("key", "ascending"), ("id", "ascending")])
        keys, ids, n, part = (rows.column(c).to_numpy() for c in ("key", "id", "n", "component"))
        sketch = np.stack([rows.column(s).to_numpy() for s in _SKETCH], axis=1).view(np.uint64)  # bit counts need unsigned
        fold = rows.column("fold").combine_chunks() if "fold" in rows.column_names and len(keys) else None
        seen = set(zip(*(tried.column(c).to_pylist() for c in ("key", "a", "b")), strict=True)) if tried is not None else set()
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(keys)))
        found, waiting, held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))], [], 0

        def settle() -> None:
            """Forests of the candidates (first row of the leaf, i, j, distance) that wait."""
            nonlocal waiting, held
            leaf, i, j, far = (np.concatenate([w[k] for w in waiting]).astype(np.int64) for k in range(4))
            waiting, held = [], 0
            ok = np.ones(len(i), dtype=bool)
            if fold is not None and len(i):
                far = fold_distances(fold, i, j)
                ok = far <= reach(n[i] + n[j], num, den)
            if seen:
                at = np.flatnonzero(ok)
                ends = zip(keys[i[at]].tolist(), np.minimum(ids[i[at]], ids[j[at]]).tolist(), np.maximum(ids[i[at]], ids[j[at]]).tolist(), strict=True)
                ok[at] = [e not in seen for e in ends]
            leaf, i, j, far = leaf[ok], i[ok], j[ok], far[ok]
            first = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1])) if len(leaf) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(leaf)))
            found.append((i[first[count == 1]], j[first[count == 1]]))
            for s, c in zip(first[count > 1].tolist(), count[count > 1].tolist(), strict=True):
                own = slice(s, s + c)
                tree = _forest(i[own], j[own], far[own], part, wider)
                found.append((i[own][tree], j[own][tree]))

        def add(leaf: np.ndarray, i: np.ndarray, j: np.ndarray, far: np.ndarray) -> None:
            nonlocal held
            differ = part[i] != part[j]
            waiting.append((leaf[differ], i[differ], j[differ], far[differ]))
            held += int(differ.sum())
            if held > PAIRS:
                settle()

        # regions of two in one go
        a = begin[size == 2]
        b = a + 1
        far = np.bitwise_count(sketch[a] ^ sketch[b]).sum(axis=1, dtype=np.int64)
        near = (den * np.minimum(n[a], n[b]) >= num * np.maximum(n[a], n[b])) & (far <= reach(n[a] + n[b], num, den))
        add(a[near], a[near], b[near], far[near])
        for s, c in zip(begin[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            own = slice(s, s + c)
            if not (part[own] == part[s]).all():
                i, j, far = _near(n[own], sketch[own], num, den)
                add(np.full(len(i), s), s + i, s + j, far)
        if waiting:
            settle()
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        return pa.table({"key": pa.array(keys[a]), "a": pa.array(np.minimum(ids[a], ids[b])), "b": pa.array(np.maximum(ids[a], ids[b]))})

    return edges


def _forests(members: DataFrame, num: int, den: int, bundles: int, tried: DataFrame | None = None, wider: int = 1) -> DataFrame:
    edges, bundle = _leaves(num, den, wider), F.pmod(F.col("key"), F.lit(bundles)).alias("bundle")
    if tried is None:
        return members.groupBy(bundle).applyInArrow(lambda rows: edges(rows), _EDGE)
    return members.groupBy(bundle).cogroup(tried.groupBy(bundle)).applyInArrow(lambda rows, tried: edges(rows, tried), _EDGE)


def _id_slots(ids: np.ndarray, bits: int) -> np.ndarray:
    return T.mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(bits - 1)


def _packed_texts(bits: int, filter_):
    """(id, size, compressed text) of the texts whose id is in the filter."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_in_filter(filter_.value, _id_slots(batch.column(0).to_numpy(), bits))))
            texts = [(x.as_py() or "").encode() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([pa.compress(x, "zstd", asbytes=True) for x in texts], pa.binary())], names=["id", "size", "text"])

    return T.trimmed(pack)


def _id_filter_rows(bits: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _slot_rows(_id_slots(batch.column(0).to_numpy(), bits)).to_batches()

    return rows


def _unpacked(sizes: pa.Array, texts: pa.Array) -> pa.Array:
    found = [pa.decompress(x.as_buffer(), n, "zstd").to_pybytes() if n else b"" for n, x in zip(sizes.to_pylist(), texts, strict=True)]
    return pa.array(found, pa.large_binary()).cast(pa.large_string())


def common(x: pa.Array, y: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(elements of both sets, of x's, of y's) of each pair of texts."""
    docs = len(x)
    grams, owner, sizes = [], [], []
    for column in (x, y):
        size = []
        for lo, hi, data, offsets in T.slices(column):
            g, first = shingle_sets(data, offsets, k)
            grams.append(g)
            owner.append(lo + np.repeat(np.arange(hi - lo), np.diff(first)))
            size.append(np.diff(first))
        sizes.append(np.concatenate(size) if size else np.zeros(0, np.int64))
    g, o = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (grams, owner))
    order = np.lexsort((g, o))
    g, o = g[order], o[order]
    both = np.bincount(o[1:][(g[1:] == g[:-1]) & (o[1:] == o[:-1])], minlength=docs) if len(g) else np.zeros(docs, np.int64)
    return both, *sizes


def _linked(k: int, num: int, den: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, lo = [], 0
            size, other = (batch.column(i).to_numpy() for i in (2, 4))
            ends = np.cumsum(size + other)
            while lo < batch.num_rows:  # a few MB of texts at a time
                hi = min(batch.num_rows, max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 2 * T.SLICE_BYTES))))
                part = batch.slice(lo, hi - lo)
                both, p, q = common(_unpacked(part.column(2), part.column(3)), _unpacked(part.column(4), part.column(5)), k)
                ok.append(den * both >= num * (p + q - both))
                lo = hi
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(ok) if ok else np.zeros(0, bool))], names=["a", "b", "linked"])

    return T.trimmed(verify)


def _possible(num: int, den: int):
    """(a, b, possible) of pairs with sizes and long sketches."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy() + batch.column(4).to_numpy()
            near = sketch_distances(batch.column(3), batch.column(5)) <= reach(sizes, num, den)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near)], names=["a", "b", "possible"])

    return T.trimmed(told)


def _verified(edges: DataFrame, docs: DataFrame, kept: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b, linked) of distinct candidate edges (written), decided on long sketches and then on the sets of their documents.

    A bit filter of the ids, of a size checked here, keeps other texts from being shuffled;
    texts go compressed, as they are smaller than sets of hashes. Rows that share an id are
    one node, linked if any of them is.
    """
    spark = docs.sparkSession
    left, right = (kept.select(F.col("id").alias(i), F.col("n").alias(f"{i}_n"), F.col("long").alias(f"{i}_long")) for i in "ab")
    pairs = edges.join(left, "a").join(right, "b").select("a", "b", "a_n", "a_long", "b_n", "b_long")
    told = pairs.mapInArrow(_possible(num, den), "a bigint, b bigint, possible boolean").groupBy("a", "b").agg(F.bool_or("possible").alias("possible"))
    told = written(told, "possible")
    edges = told.where("possible").select("a", "b")
    ends = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    bits = min(8 * FILTER_BITS, max(1 << 16, 1 << (32 * edges.count()).bit_length()))
    filter_ = spark.sparkContext.broadcast(_filter(ends.mapInArrow(_id_filter_rows(bits), "word bigint, bits bigint"), bits))
    texts = written(docs.where("id is not null").select("id", "text").mapInArrow(_packed_texts(bits, filter_), "id bigint, size bigint, text binary"), "texts")
    left, right = (texts.select(F.col("id").alias(i), F.col("size").alias(f"{i}_size"), F.col("text").alias(f"{i}_text")) for i in "ab")
    pairs = edges.join(left, "a").join(right, "b").select("a", "b", "a_size", "a_text", "b_size", "b_text").mapInArrow(_linked(k, num, den), "a bigint, b bigint, linked boolean")
    linked = pairs.groupBy("a", "b").agg(F.bool_or("linked").alias("linked"))
    out = written(linked.unionByName(told.where("not possible").select("a", "b", F.lit(False).alias("linked"))), "verified")
    filter_.unpersist()
    discard(texts, told)
    return out


def _copies(heads: DataFrame) -> DataFrame:
    """(a, b, n, f1, f2): sets equal to that of a smaller id, told by shares of a class and then by class."""
    share = Window.partitionBy("n", "f1", "f2", F.pmod(F.xxhash64("id"), F.lit(SHARES)))
    told = written(heads.select("id", "n", "f1", "f2", F.min("id").over(share).alias("first")), "classes")
    firsts = told.where("id = first").distinct().select("id", "n", "f1", "f2", F.min("id").over(Window.partitionBy("n", "f1", "f2")).alias("first"))
    pairs = told.where("id != first").unionByName(firsts.where("id != first"))
    found = written(pairs.select(F.col("id").alias("a"), F.col("first").alias("b"), "n", "f1", "f2").distinct(), "copies")
    discard(told)
    return found


def _extended(part: DataFrame, told: DataFrame) -> DataFrame:
    """(id, component) with the links of a verified table added."""
    links = told.where("linked").select("a", "b")
    if links.isEmpty():
        return part
    return written(components(links.union(part.where("id != component").select("id", "component"))), "components")


def linked_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, num: int = NUM, den: int = DEN
) -> DataFrame:
    """id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = written(docs.mapInArrow(_sketched(k, num, den), _ROWS), "shingles")
    heads = rows.where(F.col("keys").isNotNull())
    copies = _copies(heads.select("id", "n", "f1", "f2"))
    equal = rows.where("lead != id").select(F.col("id").alias("a"), F.col("lead").alias("b")).union(copies.select("a", "b"))
    # by row: another text of the same id stays
    kept = heads.join(small(copies.select(F.col("a").alias("id"), "n", "f1", "f2")), ["id", "n", "f1", "f2"], "left_anti")
    close, shingles = (x or 0 for x in heads.agg(F.sum(F.size("keys")), F.sum("n")).first())
    edges = written(_close_edges(_first_members(kept), num, den, max(LEAST_BUNDLES, close // REGION_ROWS)), "close")
    checked = _verified(edges, docs, kept, k, num, den)
    links = checked.where("linked").select("a", "b").union(equal)
    part = written(components(links), "components")

    # regions in which components still meet
    label = part.join(kept.select("id", F.lit(True).alias("kept")).distinct(), "id", "left").select("id", F.col("component").alias("label"), F.coalesce("kept", F.lit(False)).alias("kept"))
    label = small(written(label, "labels"))
    open_docs = docs.where("id is not null").join(label, "id", "left").where("kept is null or kept").select("id", F.coalesce("label", "id").alias("component"), "text")
    bits = max(2, int(shingles * (den - num) / num // 500_000).bit_length())
    shards = open_docs.mapInArrow(_regions(k, num, den, bits, None), "shard bigint, halves binary, parts binary").groupBy("shard")
    mixed = spark.sparkContext.broadcast(_filter(shards.applyInArrow(_mixed, "word bigint, bits bigint"), FILTER_BITS))
    members = written(open_docs.mapInArrow(_regions(k, num, den, bits, mixed), _MEMBER), "members")
    mixed.unpersist()
    every, members = members, _distinct_regions(members, kept)
    discard(every)
    count, size = members.agg(F.count("*"), F.sum(F.octet_length("fold"))).first()
    bundles = max(LEAST_BUNDLES, count // REGION_ROWS, (size or 0) // REGION_BYTES)
    members, tried, wider = _split_large(members, num, den), None, 1
    while True:
        found = written(_forests(members, num, den, bundles, tried, wider), "forest")
        if found.isEmpty():
            break
        fresh = written(found.select("a", "b").distinct().join(checked.select("a", "b"), ["a", "b"], "left_anti"), "fresh")
        if not fresh.isEmpty():
            told = _verified(fresh, docs, kept, k, num, den)
            part = _extended(part, told)
            checked = checked.unionByName(told)
        failed = written(found.join(checked.where("not linked"), ["a", "b"], "left_semi").select("key", "a", "b"), "failed")
        if failed.isEmpty():
            break
        tried = failed if tried is None else tried.unionByName(failed)
        label = small(part.withColumnRenamed("component", "label"))
        again = small(written(failed.select("key").distinct(), "again"))
        again = members.join(again, "key", "left_semi").join(label, "id", "left")
        members = written(again.withColumn("component", F.coalesce("label", "id")).select(*_COLUMNS), "open")
        wider *= WIDER
    return rows.select("id", "n").join(small(part), "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def op9_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"))


QUERIES = {"op9_jaccard_regions": op9_jaccard_regions}
ORACLES = {
    "op9_jaccard_regions": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + {SHINGLE - 1}), ' ') AS g FROM w, unnest(generate_series(1, greatest(1, len(words) - {SHINGLE - 1}))) AS u(i) WHERE len(words) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING {DEN} * count(*) >= {NUM} * (p.n + q.n - count(*))),
r(id, at_) AS (SELECT DISTINCT a, a FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.at_)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.least, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT id, min(at_) AS least FROM r GROUP BY id) c ON c.id = w.doc_id
""",
}
