"""All named queries and their SQL twins."""

from __future__ import annotations

from functools import lru_cache

from semdrift.plans.catalog import base


@lru_cache(maxsize=1)
def load() -> tuple[dict[str, base.Query], dict[str, str]]:
    """Every query, registered once; needs no session."""
    from semdrift.plans import flagship
    from semdrift.plans.catalog import analysis_queries, spectrum_queries, text_queries, vector_queries

    for module in (text_queries, vector_queries, analysis_queries, spectrum_queries, flagship):
        module.register()
    return base.QUERIES, base.ORACLES
