"""Registry of runnable queries: key -> (Spark builder, DuckDB oracle SQL).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the whole
driver tables (through the bindings in ``tixpark.sources.bindings``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return deco


def load_all() -> None:
    # importing the modules fills the registry
    from . import q_workload, q_text, q_profile, q_routing, q_features, q_models, q_io, q_jobs, q_chain  # noqa: F401
