"""Queries of this subpackage and their reference SQL."""

from __future__ import annotations

import corpus_pipeline
from busweave.llm import (
    decontaminate, hilbert, html, merkle, minhash, packing, pii, quality, ranking, reference_sql, secrets,
    substrings, tokencount, warc,
)

_MODULES = (decontaminate, hilbert, html, minhash, packing, pii, quality, secrets, substrings, warc, merkle, tokencount, ranking)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
QUERIES["pipeline"] = corpus_pipeline.run

ORACLE_SQL = dict(reference_sql.ORACLE_SQL)
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
