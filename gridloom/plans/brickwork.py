"""Bricks and clouds (B1-B5), brick sink and manifest."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.slabs import Slabs
from gridloom.model import GridDims
from gridloom.operators import bricks, grid, place
from gridloom.plans import sqltext as Q
from gridloom.plans.placement import _volume
from gridloom.plans.registry import PARTS, ints_text, micros_text, query
from gridloom.session import scratch_path
from gridloom.sources import published
from gridloom.sources import fixtures as fx

EXTENT = ["min_x", "max_x", "min_y", "max_y", "min_z", "max_z"]


@query(
    "point_cloud",
    f"""WITH {Q.VOX} SELECT CAST(x AS DOUBLE) AS px, CAST(y AS DOUBLE) AS py, CAST(z AS DOUBLE) AS pz, value,
CAST({PARTS} * index // plane // (nz + 1) AS INTEGER) AS pid FROM ijk""",
)
def point_cloud(spark, sf):
    dims = fx.vox_dims(spark, sf)
    # packing a cloud is a projection: the owner is a column, no row has to move for it
    points = grid.to_ijk(place.with_owner_by_index(fx.vox(spark, sf), dims, PARTS), dims)
    return points.select(*[F.col(a).cast("double").alias(f"p{a}") for a in "xyz"], "value", "pid")


def _z_layout(spark, sf):
    dims = fx.vox_dims(spark, sf)
    return bricks.BrickLayout(dims, Slabs(dims.nz, PARTS, "threshold"), axis="z")


def _x_layout(spark, sf):
    dims = fx.vox_dims(spark, sf)
    return bricks.BrickLayout(dims, Slabs(dims.nx, PARTS, "balanced"), axis="x", halo=True)


def _shown(table):
    """Bricks with the array as text."""
    return table.select("pid", "block", "n_cells", *EXTENT, micros_text(F.col("data")).alias("data"))


BLOCK = grid.PACK_CELLS

Z_BRICKS = f"""WITH {Q.SPARSE}, {Q.slabs('nz', 'dims', PARTS, 'threshold')},
placed AS (SELECT s.pid, f.index - s.lo * f.plane AS l, coalesce(f.value, 0) AS value, s.lo, s.hi, f.nx, f.plane
           FROM full_grid f JOIN slabs s ON f.z >= s.lo AND f.z < s.hi)
SELECT pid, l // {BLOCK} AS block, (any_value(hi) - any_value(lo)) * any_value(plane) AS n_cells, CAST(0 AS INTEGER) AS min_x, CAST(any_value(nx) - 1 AS INTEGER) AS max_x,
       CAST(0 AS INTEGER) AS min_y, CAST(any_value(nx) - 1 AS INTEGER) AS max_y, CAST(any_value(lo) AS INTEGER) AS min_z, CAST(any_value(hi) - 1 AS INTEGER) AS max_z,
       {Q.micros('value', 'l')} AS data
FROM placed GROUP BY pid, l // {BLOCK}"""


@query("dense_brick", Z_BRICKS)
def dense_brick(spark, sf):
    return _shown(bricks.brick(fx.vox_sparse(spark, sf), _z_layout(spark, sf)))


def _ghost_sql(cells: str, n: str, source: str, ny: str, nz: str) -> str:
    """Ghost bricks along x of a table ``x, y, z, value``: every slab looked up with its widened range."""
    return f"""{Q.slabs(n, source, PARTS, 'balanced')},
wide AS (SELECT pid, lo - CASE WHEN pid > 0 THEN 1 ELSE 0 END AS lo, hi + CASE WHEN pid < {PARTS - 1} THEN 1 ELSE 0 END AS hi FROM slabs),
placed AS (SELECT w.pid, w.lo, w.hi, (c.x - w.lo) + c.y * (w.hi - w.lo) + CAST(c.z AS BIGINT) * (w.hi - w.lo) * {ny} AS l,
                  c.value, {ny} AS ny, {nz} AS nz
           FROM {cells} c, wide w, {source} WHERE c.x >= w.lo AND c.x < w.hi)
SELECT pid, l // {BLOCK} AS block, (any_value(hi) - any_value(lo)) * any_value(ny) * any_value(nz) AS n_cells,
       CAST(any_value(lo) AS INTEGER) AS min_x, CAST(any_value(hi) - 1 AS INTEGER) AS max_x,
       CAST(0 AS INTEGER) AS min_y, CAST(any_value(ny) - 1 AS INTEGER) AS max_y, CAST(0 AS INTEGER) AS min_z, CAST(any_value(nz) - 1 AS INTEGER) AS max_z,
       {Q.micros('value', 'l')} AS data
FROM placed GROUP BY pid, l // {BLOCK}"""


@query(
    "ghost_brick",
    f"WITH {Q.SPARSE}, filled AS (SELECT x, y, z, coalesce(value, 0) AS value FROM full_grid), "
    + _ghost_sql("filled", "nx", "dims", "dims.ny", "dims.nz"),
)
def ghost_brick(spark, sf):
    return _shown(bricks.brick(fx.vox_sparse(spark, sf), _x_layout(spark, sf)))


@query(
    "annotated_brick",
    f"""WITH {Q.STACK}, {Q.slabs('ny_', 'nyears', PARTS, 'balanced')},
placed AS (SELECT s.pid, v.index - s.lo * 64 AS l, v.value, v.z, s.lo, s.hi FROM stacked v JOIN slabs s ON v.z >= s.lo AND v.z < s.hi)
SELECT pid, l // {BLOCK} AS block, (any_value(hi) - any_value(lo)) * 64 AS n_cells, CAST(0 AS INTEGER) AS min_x, CAST(8 AS INTEGER) AS max_x,
       CAST(0 AS INTEGER) AS min_y, CAST(8 AS INTEGER) AS max_y, CAST(any_value(lo) AS INTEGER) AS min_z, CAST(any_value(hi) AS INTEGER) AS max_z,
       {Q.micros('value', 'l')} AS data, {Q.ints('pid', 'l')} AS owner, {Q.ints('z', 'l')} AS slice
FROM placed GROUP BY pid, l // {BLOCK}""",
)
def annotated_brick(spark, sf):
    volume, n_years = _volume(spark, sf)
    layout = bricks.BrickLayout(GridDims(8, 8, n_years), Slabs(n_years, PARTS, "balanced"), axis="z")
    # masked cells stay null: there is no filler that could be mistaken for a value
    table = bricks.annotate(bricks.cell_extent(bricks.brick(volume, layout, fill=None)), layout)
    return table.select(
        "pid",
        "block",
        "n_cells",
        *EXTENT,
        micros_text(F.col("data")).alias("data"),
        ints_text(F.col("owner")).alias("owner"),
        ints_text(F.col("slice")).alias("slice"),
    )


@query(
    "whole_extent",
    f"""WITH {Q.VOX} SELECT min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM ijk""",
)
def whole_extent(spark, sf):
    return bricks.whole_extent(fx.vox(spark, sf), fx.vox_dims(spark, sf))


@query("brick_sink", Z_BRICKS)
def brick_sink(spark, sf):
    table = bricks.brick(fx.vox_sparse(spark, sf), _z_layout(spark, sf))
    path = scratch_path(spark, "bricks")
    published.publish(table.repartitionByRange("pid", "block"), path)
    return _shown(published.read(spark, path))


@query(
    "manifest",
    f"""WITH {Q.VOX}, {Q.slabs('nz', 'dims', PARTS, 'threshold')}
SELECT s.pid, CAST({PARTS} AS INTEGER) AS n_partitions, count(*) AS n_rows, min(i.index) AS min_index, max(i.index) AS max_index
FROM ijk i JOIN slabs s ON i.z >= s.lo AND i.z < s.hi GROUP BY s.pid""",
)
def manifest(spark, sf):
    dims = fx.vox_dims(spark, sf)
    owned = place.with_owner(fx.vox(spark, sf), dims, "z", Slabs(dims.nz, PARTS, "threshold"))
    return place.manifest(owned, PARTS)
