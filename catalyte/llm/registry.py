"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from . import chat, decontaminate, divergence, fim, html_text, packing, quality, sharding, simhash, suffix, token_orc, topk, warc

MODULES = (topk, suffix, token_orc, packing, chat, warc, quality, decontaminate, sharding, simhash, fim, html_text, divergence)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
