"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.slabs import Slabs
from gridloom.operators import bricks, grid, raster, tomo
from gridloom.plans import sqltext as Q
from gridloom.plans.expressions import EVT_HI, OBS_HI, capped_bands
from gridloom.plans.registry import PARTS, micros_text, query
from gridloom.plans.scans import MASK, NX
from gridloom.sources import fixtures as fx


def annual_image(spark, sf):
    """Masked annual means; whole bands are added as arrays."""
    return raster.mean_image(raster.band_sums(fx.band_arrays(spark, sf), *MASK))


def _masked(spark, sf):
    return raster.with_mask(raster.bands_long(fx.band_arrays(spark, sf), NX), *MASK)


@query("max_coord", f"WITH {Q.VOX} SELECT max(z) AS max_z FROM ijk")
def max_coord(spark, sf):
    return grid.to_ijk(fx.vox(spark, sf), fx.vox_dims(spark, sf)).agg(F.max("z").alias("max_z"))


MEANS = f"""WITH {Q.OBS} SELECT year, round(sum(value), 4) AS total, count(*) AS n, round(sum(value) / count(*), 6) AS mean
FROM obs WHERE value < {OBS_HI} GROUP BY year"""


def _rounded(stats):
    return stats.select("year", F.round("total", 4).alias("total"), "n", F.round("mean", 6).alias("mean"))


@query("mean_by_key", MEANS)
def mean_by_key(spark, sf):
    return _rounded(raster.mean_by(fx.observations(spark, sf), ["year"], OBS_HI))


@query("mean_per_file", MEANS)
def mean_per_file(spark, sf):
    return _rounded(raster.mean_by_inline(fx.observations(spark, sf), ["year"], OBS_HI))


@query("sum_count_global", f"SELECT round(sum(value), 4) AS s, count(*) AS n FROM events WHERE value < {EVT_HI}")
def sum_count_global(spark, sf):
    valid = fx.table(spark, sf, "events").where(F.col("value") < EVT_HI)
    return valid.agg(F.round(F.sum("value"), 4).alias("s"), F.count(F.lit(1)).alias("n"))


CELL_SUMS = f"WITH {Q.MASKED} SELECT year, cell, round(total, 6) AS total, n_bands FROM cell_sums"


@query(
    "array_sum_by_key",
    f"""WITH {Q.MASKED} SELECT year, CAST(cell // {grid.PACK_CELLS} AS INTEGER) AS tile, {Q.micros('total', 'cell')} AS totals
FROM cell_sums GROUP BY year, cell // {grid.PACK_CELLS}""",
)
def array_sum_by_key(spark, sf):
    sums = raster.band_sums(fx.band_arrays(spark, sf), *MASK)
    packed = raster.pack(sums.withColumnRenamed("total", "value"))
    return packed.select("year", "tile", micros_text(F.col("values")).alias("totals"))


@query("cell_sum_masked", CELL_SUMS)
def cell_sum_masked(spark, sf):
    return raster.cell_sum(_masked(spark, sf)).withColumn("total", F.round("total", 6))


@query("cell_mean_bands", f"WITH {Q.MASKED} SELECT year, cell, round(value, 6) AS value FROM image")
def cell_mean_bands(spark, sf):
    return annual_image(spark, sf).withColumn("value", F.round("value", 6))


FIXED = f"""WITH {Q.MASKED}, {Q.CAP}, fixed AS (SELECT year, cell,
CASE WHEN count(value) = count(*) THEN sum(value) END / any_value(days) AS value FROM masked, cap WHERE band < days GROUP BY year, cell)"""


def _fixed(spark, sf):
    capped, days = capped_bands(spark, sf)
    return raster.mean_image(raster.band_sums(capped, *MASK), divisor=days)


@query("cell_mean_fixed", f"{FIXED} SELECT year, cell, round(value, 6) AS value FROM fixed")
def cell_mean_fixed(spark, sf):
    return _fixed(spark, sf).withColumn("value", F.round("value", 6))


@query(
    "raster_stats",
    f"""WITH {Q.MASKED} SELECT year, round(sum(value), 6) AS total, count(value) AS n_valid, round(min(value), 6) AS min_cell,
round(max(value), 6) AS max_cell, round(avg(value), 6) AS mean_cell FROM image GROUP BY year""",
)
def raster_stats(spark, sf):
    stats = raster.raster_stats(annual_image(spark, sf))
    rounded = [F.round(c, 6).alias(c) for c in ("total", "min_cell", "max_cell", "mean_cell")]
    return stats.select("year", "n_valid", *rounded)


@query(
    "partition_stats",
    f"""WITH {Q.VOX}, {Q.slabs('nx', 'dims', PARTS, 'balanced')}
SELECT pid, min(l) AS min_local, max(l) AS max_local, count(*) AS n FROM (
  SELECT s.pid, (x - lo) + y * (hi - lo) + CAST(z AS BIGINT) * (hi - lo) * ny AS l
  FROM ijk i JOIN slabs s ON i.x >= s.lo AND i.x < s.hi) GROUP BY pid""",
)
def partition_stats(spark, sf):
    dims = fx.vox_dims(spark, sf)
    layout = bricks.BrickLayout(dims, Slabs(dims.nx, PARTS, "balanced"), axis="x")
    local = bricks.with_local_index(bricks.owned_cells(fx.vox(spark, sf), layout), layout)
    return local.groupBy("pid").agg(
        F.min("local_index").alias("min_local"), F.max("local_index").alias("max_local"), F.count(F.lit(1)).alias("n")
    )


@query("value_range", f"WITH {Q.VOX} SELECT min(value) AS lo, max(value) AS hi, count(*) AS n FROM vox")
def value_range(spark, sf):
    return fx.vox(spark, sf).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count(F.lit(1)).alias("n"))


@query("row_inner_product", f"WITH {Q.MATRIX} SELECT ray, round(sum(len * len), 6) AS norm FROM matrix GROUP BY ray")
def row_inner_product(spark, sf):
    geometry, slices = fx.tilt_geometry(spark, sf)
    ids = tomo.ray_ids(tomo.measurements(fx.tilt_voxels(spark, sf), fx.tilt_dims(geometry, slices)))
    return tomo.row_norms(tomo.ray_matrix(ids, geometry)).withColumn("norm", F.round("norm", 6))


@query("sum_of_averages", f"{FIXED} SELECT year, round(sum(value), 6) AS total FROM fixed GROUP BY year")
def sum_of_averages(spark, sf):
    return _fixed(spark, sf).groupBy("year").agg(F.round(F.sum("value"), 6).alias("total"))
