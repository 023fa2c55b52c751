"""All queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from dialex.llm import alignment, exact_dedup, line_dedup, mixing, packing, quality, simhash, suffix_dedup, tokens, topk, vector_dedup, warc, whitening

MODULES = (suffix_dedup, warc, simhash, tokens, packing, mixing, line_dedup, topk, vector_dedup, quality, alignment, exact_dedup, whitening)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
