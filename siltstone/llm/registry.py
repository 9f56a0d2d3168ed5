"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from siltstone.llm import chat, decontaminate, divergence, langid, mixing, periodic, pii, quality, sharding, simhash, substring, topk, warc

MODULES = (topk, mixing, warc, simhash, substring, quality, langid, decontaminate, chat, sharding, divergence, pii, periodic)


def queries() -> dict:
    """Every query of the operators by name."""
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
