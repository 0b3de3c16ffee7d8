"""All queries and their SQL."""

from __future__ import annotations

from strandloom.plans import block_queries, file_queries, genealogy_queries, genotype_queries, interval_queries, model_queries, score_queries, site_queries, source_queries

MODULES = (model_queries, block_queries, interval_queries, site_queries, score_queries, source_queries, file_queries, genealogy_queries, genotype_queries, genealogy_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.oracles().items()}
