"""Placement rules (R1-R10): the owner column, and the rows moved to that partition."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.slabs import Slabs
from gridloom.operators import place, raster
from gridloom.plans import sqltext as Q
from gridloom.plans.expressions import zbin
from gridloom.plans.pairing import _years
from gridloom.plans.registry import PARTS, TASKS_PER_SLAB, query
from gridloom.plans.scans import MASK, NX
from gridloom.sources import fixtures as fx


@query("place_round_robin", f"WITH {Q.VOX} SELECT index, value FROM vox")
def place_round_robin(spark, sf):
    return fx.vox(spark, sf).repartition(PARTS * TASKS_PER_SLAB)


@query(
    "place_hash_bin",
    f"""WITH {Q.VOX}
SELECT x, y, z, value, CAST(16 * z // ((SELECT max(z) FROM ijk) + 1) AS INTEGER) AS bin FROM ijk""",
)
def place_hash_bin(spark, sf):
    return place.keyed(zbin(spark, sf), ["bin"], PARTS)


@query(
    "place_z_closed",
    f"WITH {Q.VOX} SELECT index, value, CAST({PARTS} * index // plane // (nz + 1) AS INTEGER) AS pid FROM ijk",
)
def place_z_closed(spark, sf):
    dims = fx.vox_dims(spark, sf)
    return _move(place.with_owner_by_index(fx.vox(spark, sf), dims, PARTS))


def _move(owned):
    """Rows to their slab: slab p is the partitions ``p * TASKS_PER_SLAB`` and the next ones."""
    return place.place(owned, PARTS, splits=TASKS_PER_SLAB, spread_on=F.col("index"))


def _slab_sql(axis: str, n: str, rule: str) -> str:
    return f"""WITH {Q.VOX}, {Q.slabs(n, 'dims', PARTS, rule)}
SELECT i.index, i.value, s.pid FROM ijk i JOIN slabs s ON i.{axis} >= s.lo AND i.{axis} < s.hi"""


def _placed(spark, sf, axis: str, rule: str):
    dims = fx.vox_dims(spark, sf)
    return _move(place.with_owner(fx.vox(spark, sf), dims, axis, Slabs(dims.along(axis), PARTS, rule)))


@query("place_z_threshold", _slab_sql("z", "nz", "threshold"))
def place_z_threshold(spark, sf):
    return _placed(spark, sf, "z", "threshold")


@query("place_y", f"WITH {Q.VOX} SELECT index, value, CAST({PARTS} * y // (ny + 1) AS INTEGER) AS pid FROM ijk")
def place_y(spark, sf):
    return _placed(spark, sf, "y", "closed")


@query("place_x_even", _slab_sql("x", "nx", "even"))
def place_x_even(spark, sf):
    return _placed(spark, sf, "x", "even")


@query("place_x_balanced", _slab_sql("x", "nx", "balanced"))
def place_x_balanced(spark, sf):
    return _placed(spark, sf, "x", "balanced")


def _volume(spark, sf):
    years = _years(spark, sf)
    n_years = years.count()
    image = raster.mean_image(raster.band_sums(fx.band_arrays(spark, sf), *MASK))
    return raster.stack(image, years, n_years, NX, NX), n_years


STACKED = f"""WITH {Q.STACK}, {Q.slabs('ny_', 'nyears', PARTS, 'balanced')}
SELECT v.year, v.index, round(v.value, 6) AS value, s.pid FROM stacked v JOIN slabs s ON v.z >= s.lo AND v.z < s.hi"""


@query("place_z_balanced", STACKED)
def place_z_balanced(spark, sf):
    volume, n_years = _volume(spark, sf)
    owned = volume.withColumn("pid", Slabs(n_years, PARTS, "balanced").owner(F.col("z")))
    return _move(owned.select("year", "index", F.round("value", 6).alias("value"), "pid"))


@query("place_contiguous", STACKED)
def place_contiguous(spark, sf):
    # neighbouring years stay together; the index splits a year over several tasks
    volume, n_years = _volume(spark, sf)
    owned = volume.withColumn("pid", Slabs(n_years, PARTS, "balanced").owner(F.col("z")))
    rows = owned.select("year", "index", F.round("value", 6).alias("value"), "pid")
    return rows.repartitionByRange(PARTS * TASKS_PER_SLAB, "year", "index")


@query("place_per_key", f"WITH {Q.OBS} SELECT year, day, x, y, value FROM obs")
def place_per_key(spark, sf):
    obs = fx.observations(spark, sf)
    years = obs.select("year").distinct()
    n_years = years.count()
    # a partition of its own for each year: a hash of n years into n partitions would collide
    placed = raster.with_slice(obs, years, n_years)
    return place.place(placed, n_years, pid="z").drop("z")
