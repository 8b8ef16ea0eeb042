"""Registry of named queries: a Spark plan and (where SQL can say it) a
DuckDB oracle statement for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    # Importing registers the queries.
    from qaspark.plans import (q_eval, q_text, q_generate, q_vocab, q_vectors,  # noqa: F401
                               q_coverage, q_cca, q_expand, q_holographic, q_models, q_io)
