"""The pipeline's near-duplicate stage against brute force with five words and 0.8."""

import numpy as np

import corpus_pipeline
from test_contracts import LOW, SPACED, texts


def grams(text, k=5):
    w = SPACED.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def kept_by_force(docs):
    sets, root = {k: grams(t) for k, t in docs.items()}, {k: k for k in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            both = len(sets[a] & sets[b]) if a < b else 0
            if both and 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k for k in docs if find(k) == k}


def test_near_duplicates_are_five_words_at_four_fifths(spark):
    docs = {r[0]: r[1] for r in texts()}
    words = [f"w{i}" for i in np.random.default_rng(1).integers(0, 10_000, 200)]
    edited = list(words)
    for at in (30, 70, 110, 150):
        edited[at] = f"new{at}"
    more = {2000: words, 2001: edited, 2002: words + [f"end{i}" for i in range(30)], 2003: words + [f"other{i}" for i in range(60)]}
    docs |= {k: " ".join(w) for k, w in more.items()}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert got == kept_by_force(docs)
    assert got & set(more) == {2000, 2003}
