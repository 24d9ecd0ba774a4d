"""Search of many query vectors against every pair."""

import numpy as np
import pytest

from lodestone.operators import vectors


@pytest.mark.parametrize("least", [None, 0.1])
def test_each_query_gets_its_own_best_rows(spark, monkeypatch, least):
    monkeypatch.setattr(vectors, "ROW_BLOCK", 50)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 3)
    x = np.random.default_rng(2).normal(size=(300, 8))
    x[200:240] = x[7]  # ties across blocks
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, []), (302, [1.0, 2.0]), (303, [None] * 8)]
    df = spark.createDataFrame(rows, "k long, v array<double>")
    got = vectors.cosine_topk_each(df, df.where("k % 25 = 0 or k = 7 or k = 302").withColumnRenamed("k", "query_id"), "k", "v", 6, least)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {302: [(302, 1.0)]}
    for q in [7, *range(0, 300, 25)]:
        scored = sorted((-round(float(unit[q] @ u), 6), i) for i, u in enumerate(unit))
        want[q] = [(i, -s) for s, i in scored if least is None or -s >= least][:6]
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, -r.score, r.k)):
        found.setdefault(r.query_id, []).append((r.k, r.score))
    assert found.keys() == want.keys()
    assert all([k for k, _ in found[q]] == [k for k, _ in want[q]] and np.allclose([s for _, s in found[q]], [s for _, s in want[q]], atol=2e-6) for q in want)
