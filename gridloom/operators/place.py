"""Placement: which slab owns a row, and moving rows to their slab."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.index import axis_of, idiv
from gridloom.functions.slabs import Slabs
from gridloom.model import GridDims

def with_owner(df: DataFrame, dims: GridDims, axis: str, slabs: Slabs, out: str = "pid") -> DataFrame:
    """Add the owning slab of each voxel: an expression of the index, no join."""
    return df.withColumn(out, slabs.owner(axis_of(F.col("index"), axis, dims)))


def with_owner_by_index(df: DataFrame, dims: GridDims, parts: int, out: str = "pid") -> DataFrame:
    """``floor(floor(P*index / plane) / (nz+1))``: cuts inside a plane when P does not divide it."""
    scaled = idiv(F.col("index") * parts, dims.plane)
    return df.withColumn(out, idiv(scaled, dims.nz + 1).cast("int"))


def place(df: DataFrame, parts: int, pid: str = "pid", splits: int = 1, spread_on: Column | None = None) -> DataFrame:
    """Send each row to the partition of its slab: slab p fills partitions ``p*splits .. p*splits+splits-1``.

    The number of slabs is a property of the result, not of the cluster: ``splits``, which the caller
    states, spreads each slab over several neighbouring tasks, by a hash of ``spread_on`` (default: the whole row).
    """
    if splits == 1:
        return df.repartitionById(parts, F.col(pid).cast("int"))
    salt = F.pmod(F.xxhash64(*([spread_on] if spread_on is not None else df.columns)), F.lit(splits))
    target = (F.col(pid) * splits + salt).cast("int")
    return df.withColumn("_target", target).repartitionById(parts * splits, "_target").drop("_target")


def keyed(df: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Hash placement on ``keys``: all rows of a key are in one partition, however many there are."""
    return df.repartition(parts, *keys)


def keyed_split(df: DataFrame, keys: list[str], parts: int, splits: int, spread_on: list[str]) -> DataFrame:
    """Hash placement on ``keys`` and one of ``splits`` salts (a hash of ``spread_on``): a key is spread over at most
    ``splits`` partitions, at every size. For callers that can join or add up the parts of a key."""
    salt = F.pmod(F.xxhash64(*spread_on), F.lit(splits))
    return df.withColumn("_salt", salt).repartition(parts, *keys, "_salt").drop("_salt")


def slab_table(spark: SparkSession, slabs: Slabs) -> DataFrame:
    """``pid, lo, hi, width``: one row per slab."""
    p = F.col("id")
    return spark.range(slabs.parts).select(
        p.cast("int").alias("pid"),
        slabs.start(p).alias("lo"),
        slabs.end(p).alias("hi"),
        (slabs.end(p) - slabs.start(p)).alias("width"),
    )


def running_offsets(sizes: DataFrame, size: str = "size", out: str = "lo") -> DataFrame:
    """Offsets and ends from slab sizes. ``sizes`` has one row per slab, so its one window is small."""
    before = W.orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn(out, F.coalesce(F.sum(size).over(before), F.lit(0)).cast("bigint")).withColumn(
        "hi", F.col(out) + F.col(size)
    )


def manifest(df: DataFrame, parts: int) -> DataFrame:
    """Rows and index range per slab, with the number of slabs."""
    return df.groupBy("pid").agg(
        F.lit(parts).alias("n_partitions"),
        F.count(F.lit(1)).alias("n_rows"),
        F.min("index").alias("min_index"),
        F.max("index").alias("max_index"),
    )
