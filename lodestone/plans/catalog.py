"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from lodestone.plans import corpus, logs, models, ordered, saved, states, vectors, walks

MODULES = (vectors, corpus, logs, models, states, ordered, walks, saved)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
