"""Registry of named queries over the driver tables and their DuckDB oracles.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs an operator over whole
driver tables; ``ORACLE[name]`` is an independently written SQL definition
of the same result (DuckDB dialect, views named after the driver tables).
Floating outputs are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from protea.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so its queries register."""
    import importlib
    for m in PLAN_MODULES:
        importlib.import_module(f"protea.plans.{m}")


PLAN_MODULES = ["homology", "metrics_q", "sequences_q", "labels_q", "embed_q", "training_q", "sources_q"]
