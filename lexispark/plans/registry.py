"""Registry of named queries and their SQL oracles.

A query is a function (spark, sf_dir) -> DataFrame; its oracle (when the semantics are
SQL-expressible) is an independent DuckDB statement over the same tables.  Output
columns are scalars with matching names; doubles are rounded to 6 places in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from lexispark.plans import (  # noqa: F401
        q_retrieval, q_lexicon, q_sampling, q_pairs, q_senses, q_dating, q_tagging,
        q_vectors,
    )
