"""Owners by a free list of intervals: which interval ``[lo, hi)`` holds a value.

A list that is known small goes to the tasks as sorted arrays and every value is found by binary search. A longer one is cut
into buckets at starts of its own intervals. As intervals don't overlap, each lies in one bucket; values find their
bucket by binary search among the cuts. In a bucket, values and intervals are merged in one sorted pass (a running window),
so nothing is held in memory and no pair is formed that does not belong together. Buckets with many values are split by a
hash, and their intervals go to each part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import materialize

#: Longest list that is sent to the tasks (24 bytes a row).
LIST_ROWS = 1 << 20
#: Most buckets of a longer list, and most rows of a part of a bucket.
BUCKETS = 4096
PART_ROWS = 1 << 20


def _check(lo: np.ndarray, hi: np.ndarray) -> None:
    if (lo[1:] < hi[:-1]).any():
        raise ValueError("intervals overlap")


def owner_by_list(
    rows: DataFrame, key: str, intervals: DataFrame, list_rows: int = LIST_ROWS, buckets: int = BUCKETS, part_rows: int = PART_ROWS
) -> DataFrame:
    """The rows whose ``key`` lies in an interval, with its ``pid``, ``lo`` and ``hi``.

    ``intervals`` has ``pid, lo, hi`` (bigint); they may have gaps but not overlap, which is checked and is an error. Empty ones
    (``lo >= hi``) and those with a null bound own nothing. A row with a null ``key`` has no owner.
    """
    if {"pid", "lo", "hi"} & set(rows.columns):
        raise ValueError("rows can't have columns named pid, lo or hi")
    intervals = intervals.select(*[F.col(c).cast("bigint").alias(c) for c in ("pid", "lo", "hi")]).where("lo < hi")
    if intervals.count() <= list_rows:
        return _by_search(rows, key, intervals)
    return _by_merge(rows, key, intervals, buckets, part_rows)


def _by_search(rows: DataFrame, key: str, intervals: DataFrame) -> DataFrame:
    table = intervals.orderBy("lo").toArrow()
    pid, lo, hi = (table.column(c).to_numpy() for c in ("pid", "lo", "hi"))
    _check(lo, hi)
    sent = rows.sparkSession.sparkContext.broadcast((pid, lo, hi))

    @F.pandas_udf("pid bigint, lo bigint, hi bigint")
    def owner(values: pd.Series) -> pd.DataFrame:
        pid, lo, hi = sent.value
        v = values.to_numpy()
        at = np.searchsorted(lo, v, side="right") - 1
        found = (at >= 0) & (v < hi[np.maximum(at, 0)]) if len(lo) else np.zeros(len(v), bool)
        out = {name: pd.array(np.zeros(len(v), np.int64), "Int64") for name in ("pid", "lo", "hi")}
        for name, column in zip(out, (pid, lo, hi)):
            out[name][found] = column[at[found]]
            out[name][~found] = pd.NA
        return pd.DataFrame(out)

    owned = rows.where(F.col(key).isNotNull()).withColumn("_owner", owner(F.col(key).cast("bigint")))
    return owned.where("_owner.pid is not null").select(*rows.columns, "_owner.pid", "_owner.lo", "_owner.hi")


def _by_merge(rows: DataFrame, key: str, intervals: DataFrame, buckets: int, part_rows: int) -> DataFrame:
    # The driver gets at most ``buckets`` starts; where the estimate puts them only decides how even buckets are.
    shares = [k / buckets for k in range(1, buckets)]
    cuts = sorted(set(intervals.approxQuantile("lo", shares, 1 / (4 * buckets)))) if shares else []
    bounds = rows.sparkSession.sparkContext.broadcast(_exact_cuts(intervals, cuts))

    @F.pandas_udf("int")
    def bucket(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, values.to_numpy(), side="right").astype(np.int32))

    value = F.col(key).cast("bigint")
    body = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    values = rows.where(value.isNotNull()).select(body, value.alias("v")).withColumn("bucket", bucket("v"))
    values = materialize(values, "values")
    sizes = values.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).collect()  # a row a bucket
    split = {r["bucket"]: -(-r["size"] // part_rows) for r in sizes if r["size"] > part_rows}
    parts = F.coalesce(F.create_map(*[F.lit(x) for kv in split.items() for x in kv])[F.col("bucket")], F.lit(1)) if split else F.lit(1)
    values = values.withColumn("part", F.pmod(F.xxhash64("v", F.monotonically_increasing_id()), parts).cast("int"))
    clash = F.raise_error(F.lit("intervals overlap"))
    # Every cut is the start of an interval, so one that goes beyond a cut overlaps with that.
    placed = intervals.withColumn("bucket", bucket("lo")).withColumn("end", bucket(F.col("hi") - 1))
    placed = placed.withColumn("bucket", F.when(F.col("end") == F.col("bucket"), F.col("bucket")).otherwise(clash.cast("int"))).drop("end")
    lists = placed.withColumn("part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
    none = F.lit(None)
    merged = values.select("bucket", "part", "v", F.lit(1).alias("kind"), "row", none.cast("struct<pid:bigint,lo:bigint,hi:bigint>").alias("i"))
    merged = merged.unionByName(
        lists.select("bucket", "part", F.col("lo").alias("v"), F.lit(0).alias("kind"), none.cast(values.schema["row"].dataType).alias("row"), F.struct("pid", "lo", "hi").alias("i"))
    )
    order = Window.partitionBy("bucket", "part").orderBy("v", "kind")
    last = F.last("i", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = merged.withColumn("before", last)
    inside = (F.col("kind") == 1) & (F.col("v") < F.col("before.hi"))
    owned = merged.where(F.when((F.col("kind") == 0) & (F.col("before.hi") > F.col("v")), clash.cast("boolean")).otherwise(inside))
    return owned.select("row.*", "before.pid", "before.lo", "before.hi")


def _exact_cuts(intervals: DataFrame, near: list[float]) -> np.ndarray:
    """For each estimate the smallest start that is not below it: a bigint may have no double of its own."""
    if not near:
        return np.zeros(0, np.int64)
    step = intervals.sparkSession.sparkContext.broadcast(np.array(near))

    @F.pandas_udf("int")
    def group(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(step.value, values.to_numpy().astype(float), side="right").astype(np.int32))

    first = intervals.groupBy(group("lo").alias("g")).agg(F.min("lo").alias("lo")).where("g > 0")
    return np.array(sorted(r["lo"] for r in first.collect()), np.int64)
