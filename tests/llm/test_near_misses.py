"""A group of texts that are nearly, but not quite, near copies makes edges with its members, not with its pairs."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.llm import jaccard
from test_pipeline_duplicates import kept_by_force


def near_misses(group: int = 60, size: int = 300) -> dict[int, str]:
    """Texts of which two share about 0.72 of their five-word shingles, and a link of the last to a copy of it with one edit."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 10_000, size)]
    docs = {}
    for k in range(group):
        words = list(base)
        for at in rng.choice(size, 5, replace=False):
            words[at] = f"n{k}x{at}"
        docs[k] = words
    docs[group] = [*docs[group - 1][:-40], *docs[0][-40:], "end"]
    return {k: " ".join(w) for k, w in docs.items()}


def test_near_misses_make_few_edges(spark, monkeypatch):
    made, forests = [], jaccard._forests

    def counted(members, *args, **kwargs):
        out = forests(members, *args, **kwargs)
        made.append((out.count(), members.count(), out.groupBy("key").count().join(members.groupBy("key").agg(F.count("*").alias("size")), "key").where("count >= 4 * size").count()))
        return out

    monkeypatch.setattr(jaccard, "_forests", counted)
    docs = near_misses()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id for r in jaccard.linked_components(df, k=5, num=80, den=100).where("doc_id = component_id").collect()}
    assert got == kept_by_force(docs)
    assert len(got) > len(docs) / 2 and len(made) >= 2
    assert sum(edges for edges, _, _ in made) <= 2 * max(members for _, members, _ in made), made
    assert all(not wide for _, _, wide in made), made


def test_forests_leave_out_what_failed_and_widen():
    n = 40
    i, j = np.triu_indices(n, 1)
    far, part = np.arange(len(i)), np.arange(n)
    tree = jaccard._forest(i, j, far, part)
    assert len(tree) == n - 1 and len(set(jaccard._forest(i, j, far, part, 4))) == n - 1 + 3 * n
    assert sorted(jaccard._forest(i, j, far, part, 64)) == list(range(len(i)))
    # a leaf of equal sketches: every pair is a candidate
    rows = pa.table({"key": [7] * n, "id": range(n), "n": [100] * n, "component": range(n), **{s: [0] * n for s in jaccard._SKETCH}, "fold": pa.array([bytes(16)] * n, pa.binary())})
    tried, seen = None, set()
    for wider in (1, 4, 16, 64):
        got = jaccard._leaves(80, 100, wider)(rows, tried)
        pairs = set(zip(got["a"].to_pylist(), got["b"].to_pylist(), strict=True))
        assert len(pairs) == got.num_rows and not pairs & seen
        seen |= pairs
        tried = got if tried is None else pa.concat_tables([tried, got])
    assert len(seen) == n * (n - 1) // 2 and jaccard._leaves(80, 100, 256)(rows, tried).num_rows == 0


def test_fold_distances_are_those_of_single_pairs():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64)) for size in (1, 3, 64, 65, 500, 5000, 20_000)]
    column = jaccard.long_sketches(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), jaccard.FOLD)
    assert max(len(x.as_py()) for x in column) == jaccard.FOLD // 8
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    assert jaccard.fold_distances(column, i, j).tolist() == jaccard.sketch_distances(column.take(pa.array(i)), column.take(pa.array(j))).tolist()
    part = column.slice(2)
    assert jaccard.fold_distances(part, np.array([0]), np.array([3])).tolist() == jaccard.sketch_distances(part.slice(0, 1), part.slice(3, 1)).tolist()
