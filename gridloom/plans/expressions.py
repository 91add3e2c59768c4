"""Projections, scalar rules and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import scalars as S
from gridloom.functions.slabs import Slabs
from gridloom.operators import bricks, grid, place, raster
from gridloom.plans import sqltext as Q
from gridloom.plans.registry import PARTS, micros_text, query
from gridloom.plans.scans import CHUNK, MASK, NX, PICKED
from gridloom.sources import archive, etl
from gridloom.sources import fixtures as fx

OBS_HI = 45.0    # observations from here on are invalid
EVT_HI = 100.0   # events from here on are invalid


@query("idx_to_ijk", f"WITH {Q.VOX} SELECT index, x, y, z FROM ijk")
def idx_to_ijk(spark, sf):
    return grid.to_ijk(fx.vox(spark, sf), fx.vox_dims(spark, sf)).select("index", "x", "y", "z")


@query("ijk_to_idx", f"WITH {Q.VOX} SELECT x, y, z, CAST(x + y * nx + z * plane AS BIGINT) AS index, index + 3 AS shifted FROM ijk")
def ijk_to_idx(spark, sf):
    dims = fx.vox_dims(spark, sf)
    ijk = grid.to_ijk(fx.vox(spark, sf), dims).drop("index")
    shifted = grid.to_index(ijk, dims, i_offset=3).withColumnRenamed("index", "shifted")
    return grid.to_index(shifted, dims).select("x", "y", "z", "index", "shifted")


@query(
    "slab_local_index",
    f"""WITH {Q.VOX}, {Q.slabs('nz', 'dims', PARTS, 'threshold')}
SELECT i.index, s.pid, i.index - s.lo * i.plane AS local_index FROM ijk i JOIN slabs s ON i.z >= s.lo AND i.z < s.hi""",
)
def slab_local_index(spark, sf):
    dims = fx.vox_dims(spark, sf)
    layout = bricks.BrickLayout(dims, Slabs(dims.nz, PARTS, "threshold"), axis="z")
    owned = bricks.owned_cells(fx.vox(spark, sf), layout)
    return bricks.with_local_index(owned, layout).select("index", "pid", "local_index")


@query(
    "brick_local_index",
    f"""WITH {Q.VOX}, {Q.slabs('nx', 'dims', PARTS, 'balanced')}
SELECT i.index, s.pid, (x - lo) + y * (hi - lo) + CAST(z AS BIGINT) * (hi - lo) * ny AS local_index
FROM ijk i JOIN slabs s ON i.x >= s.lo AND i.x < s.hi""",
)
def brick_local_index(spark, sf):
    dims = fx.vox_dims(spark, sf)
    layout = bricks.BrickLayout(dims, Slabs(dims.nx, PARTS, "balanced"), axis="x")
    owned = bricks.owned_cells(fx.vox(spark, sf), layout)
    return bricks.with_local_index(owned, layout).select("index", "pid", "local_index")


@query(
    "center_coords",
    f"WITH {Q.VOX} SELECT index, CAST(x - 0.5 * nx AS DOUBLE) AS x, CAST(y - 0.5 * ny AS DOUBLE) AS y, z FROM ijk",
)
def center_coords(spark, sf):
    dims = fx.vox_dims(spark, sf)
    return grid.center(grid.to_ijk(fx.vox(spark, sf), dims), dims).select("index", "x", "y", "z")


ANGLE = "2.0 * proj / 180.0 * 3.141592654"


@query(
    "tilt_rotate_points",
    f"""WITH {Q.TILT}
SELECT index, round((ray_in_proj - 0.5 * nray) * cos(CAST({ANGLE} AS DOUBLE)), 6) AS px,
       CAST(slice - 0.5 * sx AS DOUBLE) AS py, round((ray_in_proj - 0.5 * nray) * sin(CAST({ANGLE} AS DOUBLE)), 6) AS pz
FROM tilt, geo""",
)
def tilt_rotate_points(spark, sf):
    geometry, slices = fx.tilt_geometry(spark, sf)
    dims = fx.tilt_dims(geometry, slices)
    pixels = grid.center(grid.to_ijk(fx.vox(spark, sf), dims), dims).withColumnRenamed("z", "angle")
    points = grid.tilt_rotate_points(pixels)
    return points.select("index", F.round("px", 6).alias("px"), "py", F.round("pz", 6).alias("pz"))


@query(
    "tilt_rotate_index",
    f"""WITH {Q.TILT}
SELECT index, round((slice - sx // 2) * cos(CAST({ANGLE} AS DOUBLE)), 6) AS px, CAST(ray_in_proj AS DOUBLE) AS py,
       round((slice - sx // 2) * sin(CAST({ANGLE} AS DOUBLE)), 6) AS pz
FROM tilt, geo""",
)
def tilt_rotate_index(spark, sf):
    geometry, slices = fx.tilt_geometry(spark, sf)
    points = grid.tilt_rotate_index(fx.vox(spark, sf), fx.tilt_dims(geometry, slices))
    return points.select("index", F.round("px", 6).alias("px"), "py", F.round("pz", 6).alias("pz"))


@query(
    "cast_int",
    "SELECT event_id AS index, CAST(trunc(value) AS INTEGER) AS up, CAST(trunc(-value) AS INTEGER) AS down FROM events",
)
def cast_int(spark, sf):
    events = fx.table(spark, sf, "events")
    return events.select(
        F.col("event_id").alias("index"),
        S.truncate_int(F.col("value")).alias("up"),
        S.truncate_int(-F.col("value")).alias("down"),
    )


@query("threshold", "SELECT event_id AS index, CASE WHEN value < 2.0 THEN 0.0 ELSE value END AS value FROM events")
def threshold(spark, sf):
    return fx.tilt_voxels(spark, sf).withColumn("value", S.threshold(F.col("value")))


@query("swap_kv", f"WITH {Q.VOX} SELECT value AS k, index AS v FROM vox")
def swap_kv(spark, sf):
    return fx.vox(spark, sf).select(F.col("value").alias("k"), F.col("index").alias("v"))


@query(
    "year_from_name",
    f"""WITH {Q.OBS}, named AS (SELECT concat('tasmax_day_', year, '.tif') AS name FROM obs)
SELECT name, CAST(regexp_extract(name, '_(\\d{{4}})\\.tif$', 1) AS INTEGER) AS year,
       CAST(substring(name, length(name) - 7, 4) AS INTEGER) AS year_tail, count(*) AS n FROM named GROUP BY name""",
)
def year_from_name(spark, sf):
    named = raster.file_names(fx.observations(spark, sf)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    name = F.col("name")
    return named.select("name", S.year_from_name(name).alias("year"), S.year_from_tail(name).alias("year_tail"), "n")


@query(
    "kelvin_to_f",
    "SELECT event_id AS index, round((value - 273.15) * 9 / 5 + 32, 6) AS fahrenheit FROM events",
)
def kelvin_to_f(spark, sf):
    return fx.tilt_voxels(spark, sf).select("index", F.round(S.kelvin_to_f(F.col("value")), 6).alias("fahrenheit"))


@query("flip_rows", f"WITH {Q.CELLS} SELECT year, band, CAST(7 - y AS INTEGER) AS y, x, value FROM cells")
def flip_rows(spark, sf):
    cells = raster.bands_long(fx.bands(spark, sf), NX)
    return raster.flip_rows(cells, NX).select("year", "band", "y", "x", "value")


@query("parse_number", f"WITH {Q.EVT} SELECT f, value, number FROM parsed")
def parse_number(spark, sf):
    lines = fx.stream_lines(spark, sf)
    return lines.select("f", "value", S.parse_number(F.col("value")).alias("number"))


@query("pair_with_one", f"WITH {Q.OBS} SELECT year, value AS first, CAST(1 AS INTEGER) AS second FROM obs")
def pair_with_one(spark, sf):
    pairs = fx.observations(spark, sf).select("year", F.struct("value", F.lit(1).alias("one")).alias("pair"))
    return pairs.select("year", F.col("pair.value").alias("first"), F.col("pair.one").alias("second"))


@query(
    "tilt_angles",
    f"""WITH {Q.TILT}
SELECT index, proj, CAST(2 * proj - (nproj - 1) AS INTEGER) AS angle, CAST(proj % nproj AS INTEGER) AS ordinal,
       CAST(10 AS INTEGER) AS pixelsize FROM tilt, geo""",
)
def tilt_angles(spark, sf):
    geometry, slices = fx.tilt_geometry(spark, sf)
    pixels = grid.to_ijk(fx.tilt_voxels(spark, sf), fx.tilt_dims(geometry, slices))
    proj = F.col("z")
    return pixels.select(
        "index",
        proj.alias("proj"),
        S.tilt_angle_deg(proj, geometry.n_proj).alias("angle"),
        (proj % geometry.n_proj).alias("ordinal"),
        F.lit(S.PIXEL_SIZE).alias("pixelsize"),
    )


@query(
    "tag_owner",
    f"""WITH {Q.VOX}, {Q.slabs('nz', 'dims', PARTS, 'balanced')}
SELECT i.index, i.value, s.pid, i.z AS slice FROM ijk i JOIN slabs s ON i.z >= s.lo AND i.z < s.hi""",
)
def tag_owner(spark, sf):
    dims = fx.vox_dims(spark, sf)
    tagged = place.with_owner(fx.vox(spark, sf), dims, "z", Slabs(dims.nz, PARTS, "balanced"))
    return grid.to_ijk(tagged, dims).select("index", "value", "pid", F.col("z").alias("slice"))


@query("select_fields", f"WITH {Q.VOX} SELECT index, value FROM vox")
def select_fields(spark, sf):
    return grid.to_ijk(fx.vox(spark, sf), fx.vox_dims(spark, sf)).select("index", "value")


@query(
    "zbin",
    f"""WITH {Q.VOX}
SELECT x, y, z, value, CAST(16 * z // ((SELECT max(z) FROM ijk) + 1) AS INTEGER) AS bin FROM ijk""",
)
def zbin(spark, sf):
    points = etl.xyzv(fx.vox(spark, sf), fx.vox_dims(spark, sf))
    max_z = points.agg(F.max("z")).scalar()
    return points.withColumn("bin", S.z_bin(F.col("z"), max_z, PARTS))


@query(
    "param_points",
    """WITH p AS (SELECT s_suppkey AS id, (s_suppkey % 4 + 1) * 6 AS res FROM supplier),
inner_ AS (SELECT id, CAST((r - 1) * res + t + 2 AS INTEGER) AS point, 2 * pi() * t / res AS theta, pi() * r / (res - 1) AS phi
           FROM (SELECT id, res, r, unnest(range(res)) AS t FROM (SELECT id, res, unnest(range(1, res - 1)) AS r FROM p))),
poles AS (SELECT id, 0 AS point, 0.0 AS theta, 0.0 AS phi FROM p UNION ALL SELECT id, 1, 0.0, pi() FROM p),
pts AS (SELECT * FROM inner_ UNION ALL SELECT id, CAST(point AS INTEGER), theta, phi FROM poles)
SELECT id, point, round(id + 0.5 * sin(phi) * cos(theta), 6) AS px, round(0.5 * sin(phi) * sin(theta), 6) AS py,
       round(0.5 * cos(phi), 6) AS pz FROM pts""",
)
def param_points(spark, sf):
    points = etl.sphere_points(fx.param_rows(spark, sf))
    return points.select("id", "point", *[F.round(c, 6).alias(c) for c in ("px", "py", "pz")])


# --- filters ----------------------------------------------------------------------------


@query("valid_upper", f"WITH {Q.OBS} SELECT year, day, x, y, value FROM obs WHERE value < {OBS_HI}")
def valid_upper(spark, sf):
    return fx.observations(spark, sf).where(F.col("value") < OBS_HI)


@query(
    "valid_upper_inline",
    f"""WITH {Q.OBS} SELECT year, round(sum(value) FILTER (WHERE value < {OBS_HI}), 4) AS total,
count(*) FILTER (WHERE value < {OBS_HI}) AS n FROM obs GROUP BY year""",
)
def valid_upper_inline(spark, sf):
    stats = raster.mean_by_inline(fx.observations(spark, sf), ["year"], OBS_HI)
    return stats.select("year", F.round("total", 4).alias("total"), "n")


@query("mask_range", f"WITH {Q.MASKED} SELECT year, band, cell, value FROM masked")
def mask_range(spark, sf):
    cells = raster.bands_long(fx.bands(spark, sf), NX)
    return raster.with_mask(cells, *MASK).select("year", "band", "cell", "value")


@query("band_subset", f"WITH {Q.CELLS} SELECT year, band, cell, value FROM cells WHERE band IN (0, 9, 19, 29)")
def band_subset(spark, sf):
    ids = fx.band_ids(spark, sf).where(F.col("band").isin(PICKED))
    picked = fx.picked_bands(spark, sf, ids, len(PICKED) * fx.common_bands(spark, sf)[1])
    return raster.bands_long(picked, NX).select("year", "band", "cell", "value")


def capped_bands(spark, sf):
    """Bands up to the number that every year has, and that number: only surplus bands of longer years go."""
    days, years = fx.common_bands(spark, sf)
    ids = fx.band_ids(spark, sf).where(F.col("band") < days)
    return fx.picked_bands(spark, sf, ids, days * years), days


@query("band_cap", f"WITH {Q.CELLS} SELECT year, band, cell, value FROM cells WHERE band < 365")
def band_cap(spark, sf):
    # the leap day goes; the filter reaches the index of the archive
    kept = archive.read(spark, fx.archived_bands(spark, sf)).where(F.col("band") < fx.DAYS)
    return raster.bands_long(kept, NX).select("year", "band", "cell", "value")


LOOKUP_KEY = "2006-3"


@query(
    "chunk_lookup",
    f"""WITH {Q.CELLS}
SELECT '{LOOKUP_KEY}' AS key, band, CAST(count(*) AS INTEGER) AS n, {Q.micros('value', 'cell')} AS head
FROM cells WHERE concat(year, '-', cell // {CHUNK}) = '{LOOKUP_KEY}' GROUP BY band""",
)
def chunk_lookup(spark, sf):
    found = raster.chunk_lookup(fx.bands(spark, sf), CHUNK, LOOKUP_KEY)
    return found.select("key", "band", "n", micros_text(F.col("head")).alias("head"))


@query(
    "reject_out_of_brick",
    f"""WITH {Q.VOX}, {Q.slabs('nx', 'dims', PARTS, 'balanced')},
owned AS (SELECT i.index, CAST(4 * i.x // i.nx AS INTEGER) AS pid, i.x, i.y, i.z, i.ny, i.nz FROM ijk i),
local_ AS (SELECT o.index, o.pid, (x - lo) + y * (hi - lo) + CAST(z AS BIGINT) * (hi - lo) * ny AS local_index,
                  CAST(hi - lo AS BIGINT) * ny * nz AS cells FROM owned o JOIN slabs s USING (pid))
SELECT index, pid, local_index, NOT (local_index >= 0 AND local_index < cells) AS rejected FROM local_""",
)
def reject_out_of_brick(spark, sf):
    # rows placed by the even rule, bricks cut by the balanced rule: some fall outside
    dims = fx.vox_dims(spark, sf)
    placed = place.with_owner(fx.vox(spark, sf), dims, "x", Slabs(dims.nx, PARTS, "even"))
    layout = bricks.BrickLayout(dims, Slabs(dims.nx, PARTS, "balanced"), axis="x")
    kept, rejected = bricks.split_rejects(placed, layout)
    flagged = kept.withColumn("rejected", F.lit(False)).unionByName(rejected.withColumn("rejected", F.lit(True)))
    return flagged.select("index", "pid", "local_index", "rejected")
