"""All registered queries of the package (importing the modules fills the registry)."""

from __future__ import annotations

from . import (queries_bytepairs, queries_decontaminate, queries_divergence, queries_fim, queries_jaccard, queries_lattice, queries_licenses,  # noqa: F401
               queries_neighbours, queries_pii, queries_quality,
               queries_sentencepiece, queries_tokencount, queries_toxicity)
from .registry import ORACLE, QUERIES  # noqa: F401
