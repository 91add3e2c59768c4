"""Voxel, tilt, band, observation and stream tables derived from the given parquet tables.

Sizes (grid extents, number of slices, detector size) come from row counts, so every
operator's work grows with its input. FIXTURES.md gives the same tables as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.index import idiv
from gridloom.model import GridDims, TiltGeometry, fourth_root
from gridloom.operators.grid import rank_in_group
from gridloom.session import broadcast_if_small, scratch_path
from gridloom.sources import archive

BAND_SIDE = 8
FIRST_YEAR = 2006
STREAM_FILES = 10

SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "embeddings": "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan with the declared schema: no inference job, columns pruned by the query."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


# --- voxels -----------------------------------------------------------------------------


def vox_dims(spark: SparkSession, sf_dir: str) -> GridDims:
    """Grid extent: a square of side ``floor(n^(1/4))``, and as many planes as the table fills (one counted row).

    All three extents grow, so every coordinate stays within INT for any BIGINT index.
    """
    n = table(spark, sf_dir, "events").count()
    side = fourth_root(n)
    return GridDims(side, side, -(-n // (side * side)))


def vox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("index"), F.floor("value").cast("int").alias("value")
    )


def vox_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A volume with holes and strays: every cell but those of the ``error`` events, whose rows lie outside the
    grid instead, half of them before its first cell and half behind its last."""
    index, error = F.col("event_id"), F.col("event_type") == "error"
    stray = F.when(index % 2 == 0, -1 - index).otherwise(index + vox_dims(spark, sf_dir).cells)
    return table(spark, sf_dir, "events").select(
        F.when(error, stray).otherwise(index).alias("index"), F.floor("value").cast("int").alias("value")
    )


# --- tilt series ------------------------------------------------------------------------


def tilt_geometry(spark: SparkSession, sf_dir: str) -> tuple[TiltGeometry, int]:
    """Detector of ``2m`` rays, ``m`` projections, ``m = floor(n^(1/4))``; slices fill up the rest."""
    n = table(spark, sf_dir, "events").count()
    m = fourth_root(n)
    geometry = TiltGeometry(n_side=2 * m, n_proj=m, n_ray=2 * m)
    return geometry, -(-n // geometry.rays)


def tilt_dims(geometry: TiltGeometry, slices: int) -> GridDims:
    return GridDims(slices, geometry.n_ray, geometry.n_proj)


def tilt_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tilt series in index form: x = slice, y = ray, z = projection."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("index"), "value")


def tilt_with_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without the ``error`` events: measurements that are missing."""
    kept = table(spark, sf_dir, "events").where(F.col("event_type") != "error")
    return kept.select(F.col("event_id").alias("index"), "value")


# --- bands ------------------------------------------------------------------------------


def band_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``year, vec_id, pixels``: one 8 x 8 band per embedding, for operators that need no band order."""
    return table(spark, sf_dir, "embeddings").select(
        (F.col("label") + FIRST_YEAR).alias("year"), "vec_id", F.col("embedding").alias("pixels")
    )


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``year, band, vec_id, pixels``: the same with the ordinal of each band in its year."""
    ranked = band_ids(spark, sf_dir).select("vec_id", "band")
    return band_arrays(spark, sf_dir).join(ranked, "vec_id").select("year", "band", "vec_id", "pixels")


def band_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``year, vec_id, band``: the ordinals alone, ranked without the pixels."""
    return rank_in_group(band_arrays(spark, sf_dir), "year", "vec_id", "band")


def picked_bands(spark: SparkSession, sf_dir: str, picked: DataFrame, rows: int) -> DataFrame:
    """The bands whose ids are in ``picked`` (rows of ``band_ids``, at most ``rows``). A short list is broadcast, so that
    the pixels of other bands are never shuffled."""
    ids = broadcast_if_small(picked.select("vec_id", "band"), rows, 24)
    return band_arrays(spark, sf_dir).join(ids, "vec_id").select("year", "band", "vec_id", "pixels")


def common_bands(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """The number of bands that every year has (the smallest count of any year), and the number of years."""
    counts = band_arrays(spark, sf_dir).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    row = counts.agg(F.min("n"), F.count(F.lit(1))).first()
    return row[0] or 0, row[1]


#: Days of a day list at most: a leap day goes.
DAYS = 365


def day_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``year, days``: the length of each file's own day list, its bands but no more than ``DAYS``."""
    counts = band_arrays(spark, sf_dir).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("year", F.least("n", F.lit(DAYS)).cast("int").alias("days"))


def archived_bands(spark: SparkSession, sf_dir: str) -> str:
    """All bands as an archive in a scratch folder; its path."""
    path = scratch_path(spark, "bands")
    archive.save(bands(spark, sf_dir), path)
    return path


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``year, day, x, y, value``: one row per pixel observation."""
    return table(spark, sf_dir, "lineitem").select(
        F.year("l_shipdate").alias("year"),
        F.dayofyear("l_shipdate").alias("day"),
        (F.col("l_partkey") % 16).cast("int").alias("x"),
        (F.col("l_suppkey") % 8).cast("int").alias("y"),
        F.col("l_quantity").alias("value"),
    )


# --- streams ----------------------------------------------------------------------------


def stream_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``f, ts, value``: number lines, one in 97 unparsable, one in 89 with a type letter behind it, split over ten
    replay folders."""
    events = table(spark, sf_dir, "events")
    per_file = -(-events.count() // STREAM_FILES)
    return events.select(
        idiv(F.col("event_id"), per_file).cast("int").alias("f"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_id") % 97 == 0, F.lit("bad"))
        .when(F.col("event_id") % 89 == 0, F.concat(F.col("event_id").cast("string"), F.lit("d")))
        .otherwise(F.col("value").cast("string"))
        .alias("value"),
    )


# --- parameter rows ---------------------------------------------------------------------


def param_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, center, resolution``: one sphere per supplier, resolutions 6, 12, 18 and 24."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("id"),
        F.array(key.cast("double"), F.lit(0.0), F.lit(0.0)).alias("center"),
        ((key % 4 + 1) * 6).cast("int").alias("resolution"),
    )

