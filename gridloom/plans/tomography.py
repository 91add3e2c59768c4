"""Tomographic reconstruction."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.model import TiltGeometry
from gridloom.operators import tomo
from gridloom.plans import sqltext as Q
from gridloom.plans.brickwork import _ghost_sql, _shown
from gridloom.plans.registry import PARTS, query
from gridloom.sources import fixtures as fx


def _setup(spark, sf):
    geometry, slices = fx.tilt_geometry(spark, sf)
    dims = fx.tilt_dims(geometry, slices)
    measured = tomo.measurements(fx.tilt_voxels(spark, sf), dims)
    return geometry, slices, measured


def ray_table(spark, sf):
    """Geometry and the distinct rays of the tilt table."""
    geometry, _, measured = _setup(spark, sf)
    return geometry, tomo.ray_ids(measured)


def _recon(spark, sf):
    geometry, slices, measured = _setup(spark, sf)
    return geometry, slices, tomo.art(measured, geometry, slices)


@query("ray_matrix", f"WITH {Q.MATRIX} SELECT ray, pix, round(len, 6) AS len FROM matrix")
def ray_matrix(spark, sf):
    geometry, ids = ray_table(spark, sf)
    return tomo.ray_matrix(ids, geometry).withColumn("len", F.round("len", 6))


@query(
    "ray_pixel_sum",
    f"WITH {Q.MATRIX} SELECT ray, pix, round(sum(len), 6) AS len, count(*) AS n FROM triples GROUP BY ray, pix",
)
def ray_pixel_sum(spark, sf):
    geometry, ids = ray_table(spark, sf)
    triples = tomo.ray_triples(ids, geometry)
    return triples.groupBy("ray", "pix").agg(F.round(F.sum("len"), 6).alias("len"), F.count(F.lit(1)).alias("n"))


@query(
    "epsilon_zero",
    f"""WITH {Q.MATRIX} SELECT ray, round(ox, 6) + 0.0 AS ox, round(oy, 6) + 0.0 AS oy, round(a, 6) + 0.0 AS a,
round(b, 6) + 0.0 AS b, ox = 0 OR oy = 0 OR a = 0 OR b = 0 AS snapped FROM rays""",
)
def epsilon_zero(spark, sf):
    geometry, ids = ray_table(spark, sf)
    zero = (F.col("ox") == 0) | (F.col("oy") == 0) | (F.col("a") == 0) | (F.col("b") == 0)
    cols = [(F.round(c, 6) + 0.0).alias(c) for c in ("ox", "oy", "a", "b")]
    return tomo.rays(ids, geometry).select("ray", zero.alias("snapped"), *cols)


def wide_geometry(spark, sf) -> TiltGeometry:
    """A detector twice as wide as the grid with an odd number of projections, so that rays miss
    the grid and, at angle 0, one runs along its right edge."""
    base, _ = fx.tilt_geometry(spark, sf)
    return TiltGeometry(n_side=base.n_side, n_proj=base.n_proj | 1, n_ray=2 * base.n_side + 1)


@query(
    "boundary_rays",
    f"""WITH {Q.GEO},
matrix_geo AS (SELECT nside, nproj + 1 - nproj % 2 AS nproj, 2 * nside + 1 AS nray FROM geo),
wide AS (SELECT nray, (n + nproj * nray - 1) // (nproj * nray) AS sx FROM matrix_geo, (SELECT count(*) AS n FROM events)),
ray_ids AS (SELECT DISTINCT event_id // (sx * nray) AS p, (event_id // sx) % nray AS j FROM events, wide),
{Q.RAY_MATRIX}
SELECT ray, proj, j AS ray_in_proj,
       CASE WHEN (b = 0 AND abs(oy - n / 2.0) < 1e-15) OR (a = 0 AND abs(ox - n / 2.0) < 1e-15) THEN 'boundary' ELSE 'outside' END AS reason
FROM rays r WHERE NOT EXISTS (SELECT 1 FROM matrix m WHERE m.ray = r.ray)""",
)
def boundary_rays(spark, sf):
    # the tilt rows read as a series of the wide detector
    geometry = wide_geometry(spark, sf)
    tilt = fx.tilt_voxels(spark, sf)
    slices = -(-tilt.count() // geometry.rays)
    ids = tomo.ray_ids(tomo.measurements(tilt, fx.tilt_dims(geometry, slices)))
    ray = F.col("ray")
    return tomo.missed_rays(ids, geometry).select(
        "ray",
        F.call_function("div", ray, F.lit(geometry.n_ray)).cast("int").alias("proj"),
        (ray % geometry.n_ray).alias("ray_in_proj"),
        "reason",
    )


@query(
    "midpoint_pixel",
    f"""WITH {Q.MATRIX}
SELECT ray, round(mx, 6) + 0.0 AS mx, round(my, 6) + 0.0 AS my,
       CAST(floor(n / 2.0 - my) * n + floor(mx + n / 2.0) AS INTEGER) AS pix FROM cuts""",
)
def midpoint_pixel(spark, sf):
    geometry, ids = ray_table(spark, sf)
    cuts = tomo.segments(tomo.crossings(tomo.rays(ids, geometry), geometry))
    return cuts.select(
        "ray",
        (F.round("mx", 6) + 0.0).alias("mx"),
        (F.round("my", 6) + 0.0).alias("my"),
        tomo.midpoint_pixel(geometry).alias("pix"),
    )


@query("tilt_gather", f"WITH {Q.TILT} SELECT slice, ray_in_proj, proj, value FROM tilt")
def tilt_gather(spark, sf):
    geometry, slices, measured = _setup(spark, sf)
    ray = F.col("ray")
    return measured.select(
        "slice",
        (ray % geometry.n_ray).alias("ray_in_proj"),
        F.call_function("div", ray, F.lit(geometry.n_ray)).cast("int").alias("proj"),
        "value",
    )


@query("measurement_vector", f"WITH {Q.TILT} SELECT slice, ray, value FROM measured")
def measurement_vector(spark, sf):
    return _setup(spark, sf)[2]


IMAGE = """image AS (SELECT CAST(event_id % sx AS INTEGER) AS slice, CAST(event_id // sx AS INTEGER) AS pix, value
FROM events, geo)"""


@query(
    "forward_project",
    f"""WITH {Q.MATRIX}, {IMAGE}
SELECT slice, ray, round(sum(len * value), 6) AS projected FROM image JOIN matrix USING (pix) GROUP BY slice, ray""",
)
def forward_project(spark, sf):
    # the tilt rows of a slice, read as pixels of an image of that slice (half of its pixels have a value)
    geometry, slices, measured = _setup(spark, sf)
    index = F.col("index")
    pix = F.call_function("div", index, F.lit(slices)).cast("int")
    image = fx.tilt_voxels(spark, sf).select((index % slices).cast("int").alias("slice"), pix.alias("pix"), "value")
    images = tomo.pack_pixels(image)
    projected = tomo.forward_project(tomo.ray_ids(measured), images, geometry, slices)
    return projected.withColumn("projected", F.round("projected", 6))


@query("art_reconstruct", f"WITH RECURSIVE {Q.ART} SELECT slice, pix, round(value, 6) + 0.0 AS value FROM recon")
def art_reconstruct(spark, sf):
    pixels = tomo.recon_pixels(_recon(spark, sf)[-1])
    return pixels.withColumn("value", F.round("value", 6) + 0.0)


@query(
    "recon_to_voxels",
    f"""WITH RECURSIVE {Q.ART}
SELECT slice + (pix // nside) * sx + (pix % nside) * sx * nside AS index, round(value, 6) + 0.0 AS value FROM recon, geo""",
)
def recon_to_voxels(spark, sf):
    geometry, slices, recon = _recon(spark, sf)
    voxels = tomo.to_voxels(tomo.recon_pixels(recon), geometry, tomo.volume_dims(geometry, slices))
    return voxels.withColumn("value", F.round("value", 6) + 0.0)


@query(
    "tomo_pipeline",
    f"""WITH RECURSIVE {Q.ART},
volume AS (SELECT slice AS x, pix // nside AS y, pix % nside AS z, CASE WHEN value < 2.0 THEN 0.0 ELSE value END AS value FROM recon, geo),
{_ghost_sql('volume', 'sx', 'geo', 'geo.nside', 'geo.nside')}""",
)
def tomo_pipeline(spark, sf):
    geometry, slices = fx.tilt_geometry(spark, sf)
    return _shown(tomo.tilt_to_bricks(fx.tilt_voxels(spark, sf), geometry, slices, PARTS))


@query(
    "residual_norm",
    f"""WITH RECURSIVE {Q.ART.replace(Q.TILT, Q.HOLED)},
projected AS (SELECT slice, ray, sum(len * value) AS p FROM recon JOIN matrix USING (pix) GROUP BY slice, ray),
every AS (SELECT slice, ray FROM (SELECT DISTINCT slice FROM recon), (SELECT DISTINCT ray FROM measured))
SELECT e.slice, round(sum((coalesce(m.value, 0) - coalesce(p.p, 0)) * (coalesce(m.value, 0) - coalesce(p.p, 0))), 4) AS residual
FROM every e LEFT JOIN measured m ON m.slice = e.slice AND m.ray = e.ray
LEFT JOIN projected p ON p.slice = e.slice AND p.ray = e.ray GROUP BY e.slice""",
)
def residual_norm(spark, sf):
    # a series with holes: missing measurements count as 0 in the reconstruction and in the residual
    geometry, slices = fx.tilt_geometry(spark, sf)
    measured = tomo.measurements(fx.tilt_with_holes(spark, sf), fx.tilt_dims(geometry, slices))
    recon = tomo.art(measured, geometry, slices)
    return tomo.residual_norm(measured, recon, geometry, slices).withColumn("residual", F.round("residual", 4))
