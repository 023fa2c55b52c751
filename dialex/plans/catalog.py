"""Registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from dialex.plans.corpus import BASE_SQL, Corpus

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: bool = True, recursive: bool = False) -> Callable:
    """Registers a function of a Corpus as query `name`. `sql` follows the corpus's tables as common table expressions
    (further ones start with a comma) unless base is False."""

    def register(f: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Corpus.of(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = f"WITH {'RECURSIVE ' if recursive else ''}{BASE_SQL}\n{sql}" if base else sql
        return f

    return register
