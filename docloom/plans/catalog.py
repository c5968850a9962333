"""Registered queries: one per inventory operator, each with its DuckDB oracle.

Every query reads the driver's tables (or data Spark derives from them) in
full; nothing is sampled, capped or filtered to a subset.  The queries live
in the ``queries_*`` modules by area; importing them fills the registry.
"""

from __future__ import annotations

from . import (queries_qa, queries_text, queries_corpus, queries_features,  # noqa: F401
               queries_spans, queries_splits, queries_collect, queries_trials, queries_hooks, queries_sources,
               queries_delivery, queries_groups)
from .registry import ORACLE, QUERIES, QueryFn, register  # noqa: F401
