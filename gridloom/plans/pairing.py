"""Pairing, ordering, windows and stacking."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.slabs import Slabs
from gridloom.operators import bricks, grid, intervals, place, raster, tomo
from gridloom.plans import sqltext as Q
from gridloom.plans.registry import PARTS, query
from gridloom.plans.scans import MASK, NX
from gridloom.sources import fixtures as fx


def _years(spark, sf):
    """Distinct years; the scan is pruned to the label column."""
    return raster.years_of(fx.band_arrays(spark, sf))


@query(
    "zip_positional",
    """WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS index FROM orders),
b AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS index FROM orders)
SELECT a.index, a.o_orderkey, b.o_totalprice FROM a JOIN b USING (index)""",
)
def zip_positional(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_totalprice", "o_orderkey")
    left = grid.positional_index(orders, ["o_totalprice", "o_orderkey"]).select("index", "o_orderkey")
    right = grid.positional_index(orders, ["o_orderkey"]).select("index", "o_totalprice")
    return grid.zip_positional(left, right)


@query(
    "positional_index",
    "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS index FROM orders",
)
def positional_index(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_totalprice", "o_orderkey")
    return grid.positional_index(orders, ["o_totalprice", "o_orderkey"]).select("o_orderkey", "index")


@query("densify", f"WITH {Q.SPARSE} SELECT index, coalesce(value, 0) AS value FROM full_grid")
def densify(spark, sf):
    dims = fx.vox_dims(spark, sf)
    return grid.densify(fx.vox_sparse(spark, sf), dims.cells, {"value": F.lit(0)})


@query(
    "ghost_mask",
    f"""WITH {Q.SPARSE}, {Q.slabs('nz', 'dims', PARTS, 'threshold')}
SELECT s.pid, f.index, CAST(CASE WHEN f.value IS NOT NULL AND f.z >= s.lo AND f.z < s.hi THEN 1 ELSE 32 END AS TINYINT) AS mask
FROM full_grid f CROSS JOIN slabs s""",
)
def ghost_mask(spark, sf):
    dims = fx.vox_dims(spark, sf)
    return grid.ghost_mask(fx.vox_sparse(spark, sf), dims, Slabs(dims.nz, PARTS, "threshold"))


HALO = f"""WITH {Q.VOX}, {Q.slabs('nx', 'dims', PARTS, 'balanced')},
own AS (SELECT i.index, i.value, i.x, s.pid, s.lo, s.hi FROM ijk i JOIN slabs s ON i.x >= s.lo AND i.x < s.hi)
SELECT index, value, pid, false AS ghost FROM own
UNION ALL SELECT index, value, pid - 1, true FROM own WHERE x = lo AND pid > 0
UNION ALL SELECT index, value, pid + 1, true FROM own WHERE x = hi - 1 AND pid < {PARTS - 1}"""


def _halo(spark, sf):
    dims = fx.vox_dims(spark, sf)
    layout = bricks.BrickLayout(dims, Slabs(dims.nx, PARTS, "balanced"), axis="x", halo=True)
    return bricks.halo(fx.vox(spark, sf), layout)


@query("halo_exchange", HALO)
def halo_exchange(spark, sf):
    return _halo(spark, sf).select("index", "value", "pid", "ghost")


@query("slice_lookup", f"WITH {Q.MASKED} SELECT i.year, i.cell, o.z FROM image i JOIN ordinals o USING (year)")
def slice_lookup(spark, sf):
    years = _years(spark, sf)
    image = raster.mean_image(raster.band_sums(fx.band_arrays(spark, sf)))
    return raster.with_slice(image, years, years.count()).select("year", "cell", "z")


@query(
    "files_x_days",
    f"""WITH {Q.BANDS}, {Q.DAY_LIST} SELECT year, concat('tasmax_day_', year, '.tif') AS name, CAST(unnest(range(days)) AS INTEGER) AS band
FROM day_list""",
)
def files_x_days(spark, sf):
    return raster.worklist(raster.file_names(fx.day_lists(spark, sf)))


@query(
    "owner_join",
    f"""WITH {Q.VOX}, {Q.slabs('nz', 'dims', PARTS, 'threshold')}
SELECT i.index, s.pid, s.lo, s.hi FROM ijk i JOIN slabs s ON i.index >= s.lo * i.plane AND i.index < s.hi * i.plane""",
)
def owner_join(spark, sf):
    # cumulative thresholds from the slab widths, as a list like any other
    dims = fx.vox_dims(spark, sf)
    widths = place.slab_table(spark, Slabs(dims.nz, PARTS, "threshold")).select("pid", F.col("width").alias("size"))
    listed = place.running_offsets(widths)
    cells = listed.select("pid", (F.col("lo") * dims.plane).alias("lo"), (F.col("hi") * dims.plane).alias("hi"))
    owned = intervals.owner_by_list(fx.vox(spark, sf).select("index"), "index", cells)
    slab = lambda c: (F.col(c) / dims.plane).cast("bigint").alias(c)
    return owned.select("index", F.col("pid").cast("int").alias("pid"), slab("lo"), slab("hi"))


@query(
    "owner_join_list",
    f"""WITH {Q.VOX}, listed AS (SELECT CAST(s_suppkey AS BIGINT) AS pid, CAST(s_suppkey * 10 AS BIGINT) AS lo,
  CAST(s_suppkey * 10 + s_suppkey % 7 + 1 AS BIGINT) AS hi FROM supplier)
SELECT i.index, s.pid, s.lo, s.hi FROM vox i JOIN listed s ON i.index >= s.lo AND i.index < s.hi""",
)
def owner_join_list(spark, sf):
    # a list with gaps and uneven widths, which no closed form describes
    key = F.col("s_suppkey").cast("bigint")
    listed = fx.table(spark, sf, "supplier").select(key.alias("pid"), (key * 10).alias("lo"), (key * 10 + key % 7 + 1).alias("hi"))
    return intervals.owner_by_list(fx.vox(spark, sf).select("index"), "index", listed)


def _ray_table(spark, sf):
    geometry, slices = fx.tilt_geometry(spark, sf)
    return geometry, tomo.ray_ids(tomo.measurements(fx.tilt_voxels(spark, sf), fx.tilt_dims(geometry, slices)))


# --- ordering and windows -----------------------------------------------------------------


@query("sort_by_year", f"WITH {Q.MASKED} SELECT year, cell, round(value, 6) AS value FROM image")
def sort_by_year(spark, sf):
    # the cell breaks ties, so range partitions can cut inside a year that holds most rows
    image = raster.mean_image(raster.band_sums(fx.band_arrays(spark, sf), *MASK))
    return image.withColumn("value", F.round("value", 6)).orderBy("year", "cell")


@query(
    "ray_order",
    f"""WITH {Q.MATRIX} SELECT ray, CAST(row_number() OVER (PARTITION BY ray ORDER BY s) AS INTEGER) AS pos,
round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y FROM once""",
)
def ray_order(spark, sf):
    geometry, ids = _ray_table(spark, sf)
    points = tomo.crossings(tomo.rays(ids, geometry), geometry)
    pos = F.row_number().over(W.partitionBy("ray").orderBy("s"))
    return points.select("ray", pos.alias("pos"), (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


@query(
    "band_order",
    f"WITH {Q.CELLS} SELECT year, band, round(sum(value), 6) AS total FROM cells GROUP BY year, band",
)
def band_order(spark, sf):
    cells = raster.bands_long(fx.bands(spark, sf), NX)
    return (
        cells.groupBy("year", "band").agg(F.round(F.sum("value"), 6).alias("total")).orderBy("year", "band")
    )


@query(
    "slab_offsets",
    f"""WITH {Q.VOX}, {Q.slabs('nz', 'dims', PARTS, 'threshold')}
SELECT pid, count(*) AS size, min(first) AS lo, min(first) + count(*) AS hi FROM (
  SELECT s.pid, s.lo * i.plane AS first FROM ijk i JOIN slabs s ON i.z >= s.lo AND i.z < s.hi) GROUP BY pid""",
)
def slab_offsets(spark, sf):
    dims = fx.vox_dims(spark, sf)
    owned = place.with_owner(fx.vox(spark, sf), dims, "z", Slabs(dims.nz, PARTS, "threshold"))
    return place.running_offsets(owned.groupBy("pid").agg(F.count(F.lit(1)).alias("size"))).select("pid", "size", "lo", "hi")


@query(
    "segment_lengths",
    f"WITH {Q.MATRIX} SELECT ray, round(mx, 6) + 0.0 AS mx, round(my, 6) + 0.0 AS my, round(len, 6) AS len FROM cuts",
)
def segment_lengths(spark, sf):
    geometry, ids = _ray_table(spark, sf)
    cuts = tomo.segments(tomo.crossings(tomo.rays(ids, geometry), geometry))
    return cuts.select(
        "ray", (F.round("mx", 6) + 0.0).alias("mx"), (F.round("my", 6) + 0.0).alias("my"), F.round("len", 6).alias("len")
    )


@query("stack_years", f"WITH {Q.STACK} SELECT year, index, z, round(value, 6) AS value FROM stacked")
def stack_years(spark, sf):
    years = _years(spark, sf)
    image = raster.mean_image(raster.band_sums(fx.band_arrays(spark, sf), *MASK))
    volume = raster.stack(image, years, years.count(), NX, NX)
    return volume.select("year", "index", "z", F.round("value", 6).alias("value"))


@query(
    "merge_planes",
    f"""SELECT pid, count(*) FILTER (WHERE NOT ghost) AS own_rows, count(*) FILTER (WHERE ghost) AS ghost_rows,
CAST(sum(value) AS BIGINT) AS total, min(index) AS min_index, max(index) AS max_index FROM ({HALO}) GROUP BY pid""",
)
def merge_planes(spark, sf):
    merged = _halo(spark, sf)
    return merged.groupBy("pid").agg(
        F.count(F.when(~F.col("ghost"), 1)).alias("own_rows"),
        F.count(F.when(F.col("ghost"), 1)).alias("ghost_rows"),
        F.sum("value").alias("total"),
        F.min("index").alias("min_index"),
        F.max("index").alias("max_index"),
    )
