"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from lodestone.llm import decontaminate, embeddings, jaccard, language, licenses, negatives, packing, prefix_trie, quality, scoring, secrets, substrings, token_counts

MODULES = (scoring, packing, substrings, secrets, token_counts, quality, decontaminate, licenses, jaccard, language, embeddings, negatives, prefix_trie)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
