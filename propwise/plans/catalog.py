"""Registry of named queries: Spark job + DuckDB twin (or none for rows-only checks).

Every query reads the driver tables (or data Spark derives from them) in full.
Computed doubles are rounded the same way on both sides so the value hash
does not depend on summation order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    fn: QueryFn
    sql: str | None
    ids: str  # SURVEY §2 ids covered


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, ids: str = ""):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = Entry(fn, sql, ids)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    # importing the modules fills REGISTRY
    from . import q_batch, q_features, q_models, q_stream, q_text  # noqa: F401
    return REGISTRY
