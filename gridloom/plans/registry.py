"""Name -> (Spark query, optional SQL check)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = 4  # slabs the placement and brick queries cut a volume into
TASKS_PER_SLAB = 4  # partitions that hold one slab, whatever its size


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, fn, sql)
        return fn

    return add


def micros_text(values: Column) -> Column:
    """An array of doubles as text in millionths, so that both engines print it alike."""

    def one(v: Column) -> Column:
        return F.coalesce(F.round(v.cast("double") * 1000000).cast("bigint").cast("string"), F.lit("-"))

    return F.array_join(F.transform(values, one), ",")


def ints_text(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: v.cast("string")), ",")
