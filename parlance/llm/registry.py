"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from parlance.llm import byte_bpe, decontaminate, divergence, exact_dedup, extract, fim, language, ppm, quality, shard, simhash, toxicity, warc

MODULES = [ppm, shard, warc, language, quality, extract, exact_dedup, simhash, byte_bpe, decontaminate, divergence, fim, toxicity]


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
