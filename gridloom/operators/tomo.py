"""Tomography: ray/pixel matrix, projection, row-action reconstruction, volume assembly.

Volumes are ``(nx, ny, nz)`` = (slices, rays, projections) before reconstruction and
(slices, N, N) after it. Slices are independent; rays act on a slice in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.index import flat_index, i_of, idiv, j_of, k_of
from gridloom.functions.scalars import (
    EPS_BOUNDARY,
    EPS_DIRECTION,
    EPS_ORIGIN,
    EPS_SAME_POINT,
    radians,
    snap_zero,
    threshold,
    tilt_angle_deg,
)
from gridloom.functions.slabs import Slabs
from gridloom.model import GridDims, TiltGeometry
from gridloom.operators.bricks import BrickLayout, brick
from gridloom.operators.grid import PACK_CELLS
from gridloom.session import BROADCAST_LIMIT

#: Memory for the images one task reconstructs side by side.
BATCH_BYTES = 64 * 1024 * 1024
#: Rows of a projection that a task collects before it hands them on.
OUT_ROWS = 100_000
#: Slices that share the cost of walking the rays, even if fewer would keep all cores busy.
MIN_BATCH = 8
#: Tasks of one reconstruction; beyond that a task walks several batches in turn.
MAX_ART_TASKS = 50_000


def tilt_angles(spark: SparkSession, n_proj: int) -> DataFrame:
    """``proj, angle``: one row per projection."""
    return spark.range(n_proj).select(
        F.col("id").cast("int").alias("proj"), tilt_angle_deg(F.col("id"), n_proj).alias("angle")
    )


def ray_ids(measured: DataFrame) -> DataFrame:
    """``ray``: the rays that the tilt table has a row of. A projection that was not taken has none."""
    return measured.select("ray").distinct()


def rays(ids: DataFrame, geo: TiltGeometry) -> DataFrame:
    """``ray, ox, oy, a, b``: origin and direction of each ray in ``ids``, tiny components set to 0."""
    proj = idiv(F.col("ray"), geo.n_ray)
    offset = (F.col("ray") % geo.n_ray - (geo.n_ray - 1) / 2.0) * geo.ray_width
    t = radians(tilt_angle_deg(proj, geo.n_proj))
    return (
        ids.select("ray", offset.alias("o"), t.alias("t"))
        .select(
            "ray",
            snap_zero(F.cos("t") * F.col("o"), EPS_ORIGIN).alias("ox"),
            snap_zero(F.sin("t") * F.col("o"), EPS_ORIGIN).alias("oy"),
            snap_zero(-F.sin("t"), EPS_DIRECTION).alias("a"),
            snap_zero(F.cos("t"), EPS_DIRECTION).alias("b"),
        )
    )


def crossings(ray_table: DataFrame, geo: TiltGeometry) -> DataFrame:
    """``ray, s, x, y``: where rays cross the grid lines, inside the grid, each point once.

    The two crossings of every line are generated from the ray row. A ray parallel to a line
    never meets it: the division gives null and the box test drops it.
    """
    line = F.explode(F.sequence(F.lit(0), F.lit(geo.n_side))).alias("k")
    g = (F.col("k") - geo.n_side / 2.0) * geo.pixel_width
    at_x = F.try_divide(F.col("g") - F.col("ox"), F.col("a"))
    at_y = F.try_divide(F.col("g") - F.col("oy"), F.col("b"))
    both = F.array(
        F.struct(at_x.alias("s"), F.col("g").alias("x"), (F.col("b") * at_x + F.col("oy")).alias("y")),
        F.struct(at_y.alias("s"), (F.col("a") * at_y + F.col("ox")).alias("x"), F.col("g").alias("y")),
    )
    points = (
        ray_table.select("*", line)
        .select("ray", "ox", "oy", "a", "b", g.alias("g"))
        .select("ray", F.inline(both))
        .where((F.abs("x") <= geo.half) & (F.abs("y") <= geo.half) & F.col("s").isNotNull())
        .select("ray", "s", "x", "y")
    )
    w = W.partitionBy("ray").orderBy("s")
    twin = (F.abs(F.lead("x").over(w) - F.col("x")) <= EPS_SAME_POINT) & (
        F.abs(F.lead("y").over(w) - F.col("y")) <= EPS_SAME_POINT
    )
    return (
        points.withColumn("_twin", F.coalesce(twin, F.lit(False))).where(~F.col("_twin")).select("ray", "s", "x", "y")
    )


def segments(points: DataFrame) -> DataFrame:
    """Length and midpoint between neighbouring crossings (same ordering, so no new shuffle)."""
    w = W.partitionBy("ray").orderBy("s")
    nx, ny = F.lead("x").over(w), F.lead("y").over(w)
    dx, dy = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    return (
        points.withColumns({"nx": nx, "ny": ny})
        .where(F.col("nx").isNotNull())
        .withColumns(
            {
                "len": F.sqrt(dx * dx + dy * dy),
                "mx": snap_zero(0.5 * (F.col("x") + F.col("nx")), EPS_DIRECTION),
                "my": snap_zero(0.5 * (F.col("y") + F.col("ny")), EPS_DIRECTION),
            }
        )
        .drop("nx", "ny")
    )


def on_boundary(geo: TiltGeometry) -> Column:
    """Rays along the top or right edge of the grid belong to no pixel."""
    top = (F.col("b") == 0) & (F.abs(F.col("oy") - geo.half) < EPS_BOUNDARY)
    right = (F.col("a") == 0) & (F.abs(F.col("ox") - geo.half) < EPS_BOUNDARY)
    return top | right


def midpoint_pixel(geo: TiltGeometry) -> Column:
    n, w = geo.n_side, geo.pixel_width
    row = F.floor(F.lit(n / 2.0) - F.col("my") / w)
    col = F.floor(F.col("mx") / w + n / 2.0)
    return (row * n + col).cast("int")


def ray_triples(ids: DataFrame, geo: TiltGeometry) -> DataFrame:
    """``ray, pix, len`` before equal (ray, pixel) pairs are added up."""
    cut = segments(crossings(rays(ids, geo).where(~on_boundary(geo)), geo))
    return cut.select("ray", midpoint_pixel(geo).alias("pix"), "len").where(
        F.col("pix").between(0, geo.pixels - 1)
    )


def ray_matrix(ids: DataFrame, geo: TiltGeometry) -> DataFrame:
    """``ray, pix, len``: sparse system matrix. All steps are keyed by ray, so one shuffle."""
    return ray_triples(ids, geo).groupBy("ray", "pix").agg(F.sum("len").alias("len"))


def missed_rays(ids: DataFrame, geo: TiltGeometry) -> DataFrame:
    """``ray, reason``: rays without any matrix entry, off the grid or along its top or right edge."""
    reason = F.when(on_boundary(geo), F.lit("boundary")).otherwise(F.lit("outside"))
    return (
        rays(ids, geo)
        .select("ray", reason.alias("reason"))
        .join(ray_triples(ids, geo).select("ray"), "ray", "left_anti")
    )


def ray_entries(geo: TiltGeometry, ray: int) -> tuple[np.ndarray, np.ndarray]:
    """Pixels and lengths of one ray, in pixel order: the row of ``ray_matrix``, as arrays.

    For kernels that need a ray at a time. A column of pixels is a stretch of the ray, and so is a row; a pixel's length
    is what its two stretches share. Each column meets only the rows between its two ends, so the work is
    linear in the side of the image and nothing is sorted but the result.
    """
    none = np.zeros(0, np.int64), np.zeros(0)
    n, width, half = geo.n_side, geo.pixel_width, geo.half
    angle = geo.angle(ray // geo.n_ray) * np.pi / 180.0
    offset = (ray % geo.n_ray - (geo.n_ray - 1) / 2.0) * geo.ray_width
    ox, oy = (0.0 if abs(v) < EPS_ORIGIN else v for v in (np.cos(angle) * offset, np.sin(angle) * offset))
    dx, dy = (0.0 if abs(v) < EPS_DIRECTION else v for v in (-np.sin(angle), np.cos(angle)))
    if dx == 0 or dy == 0:  # along the pixels of one column or row; a ray on a line belongs to the pixels right of it or below
        at, steps = (ox, np.arange(n) * n) if dx == 0 else (oy, np.arange(n))
        line = int(np.floor(at / width + n / 2.0)) if dx == 0 else int(np.floor(n / 2.0 - at / width))
        if abs(at - half) < EPS_BOUNDARY or abs(at) > half or not 0 <= line < n:
            return none
        return steps + (line if dx == 0 else line * n), np.full(n, float(width))

    lines = (np.arange(n + 1) - n / 2.0) * width
    by_column, by_row = (lines - ox) / dx, (lines - oy) / dy  # where on the ray the lines are met
    column_in, column_out = np.minimum(by_column[:-1], by_column[1:]), np.maximum(by_column[:-1], by_column[1:])
    row_in, row_out = np.minimum(by_row[:-1], by_row[1:]), np.maximum(by_row[:-1], by_row[1:])
    column_in, column_out = np.maximum(column_in, row_in.min()), np.minimum(column_out, row_out.max())
    columns = np.flatnonzero(column_out > column_in)
    if not len(columns):
        return none
    ends = (np.stack([column_in[columns], column_out[columns]]) * dy + oy) / width + n / 2.0
    low, high = (np.clip(np.floor(e).astype(np.int64), 0, n - 1) for e in (ends.min(axis=0), ends.max(axis=0)))
    met = high - low + 1
    first = np.repeat(np.cumsum(met) - met, met)
    column, row = np.repeat(columns, met), np.repeat(low, met) + np.arange(met.sum()) - first
    shared = np.minimum(column_out[column], row_out[row]) - np.maximum(column_in[column], row_in[row])
    real = shared * max(abs(dx), abs(dy)) > EPS_SAME_POINT  # less is one point met twice, at a corner
    pixels, length = ((n - 1 - row) * n + column)[real], shared[real] * np.hypot(dx, dy)
    order = np.argsort(pixels)
    return pixels[order], length[order]


def row_norms(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("ray").agg(F.sum(F.col("len") * F.col("len")).alias("norm"))


def measurements(tilt: DataFrame, dims: GridDims) -> DataFrame:
    """Index-form tilt series to ``slice, ray, value`` with ``ray = proj*Nray + ray_in_proj``."""
    index = F.col("index")
    ray = k_of(index, dims) * dims.ny + j_of(index, dims)
    return tilt.select(i_of(index, dims).alias("slice"), ray.cast("int").alias("ray"), "value")


@dataclass(frozen=True)
class BatchPlan:
    """How slices are cut into batches that one task handles side by side: bounded by memory, and small enough to keep
    all cores busy. ``acting`` marks the rays of the tilt table, a byte per ray of the geometry."""

    geo: TiltGeometry
    slices: int
    size: int
    acting: np.ndarray

    @classmethod
    def of(cls, spark: SparkSession, ids: DataFrame, geo: TiltGeometry, slices: int) -> BatchPlan:
        by_memory = max(1, BATCH_BYTES // (8 * geo.pixels))
        # shuffle partitions stand for the cluster's size where executors are still being added
        cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        by_cores = max(MIN_BATCH, -(-slices // cores))
        if geo.rays > BROADCAST_LIMIT:
            raise ValueError("the list of rays is too large to send to every task")
        acting = np.zeros(geo.rays, bool)  # rays grow with the square root of the measurements
        acting[ids.select("ray").toArrow().column(0).to_numpy()] = True
        return cls(geo, slices, min(by_memory, by_cores), acting)

    @property
    def batches(self) -> int:
        return -(-self.slices // self.size)

    @property
    def tasks(self) -> int:
        return min(self.batches, MAX_ART_TASKS)

    def batch(self) -> Column:
        return idiv(F.col("slice"), self.size).cast("int").alias("batch")

    def place(self, df: DataFrame) -> DataFrame:
        """Rows to the task of their batch; ``task`` stays as a column so that later steps see it."""
        return df.withColumn("task", F.col("batch") % self.tasks).repartitionById(self.tasks, "task")

    def walk(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The acting rays that meet pixels, in order, with their entries."""
        for ray in np.flatnonzero(self.acting).tolist():
            pix, length = ray_entries(self.geo, ray)
            if len(pix):
                yield ray, pix, length


def _lists(batch: pa.RecordBatch, names: list[str]):
    """Per row, the numpy slices of the list columns ``names``."""
    columns = [batch.column(n) for n in names]
    ends = [c.offsets.to_numpy() for c in columns]
    flat = [c.values.to_numpy(zero_copy_only=False) for c in columns]
    for r in range(batch.num_rows):
        yield tuple(v[e[r] : e[r + 1]] for v, e in zip(flat, ends))


def _art_kernel(plan: BatchPlan, beta: float):
    """Streams rows ``batch, sweep, ray, at[], b[]`` (ray -1 opens a sweep) and keeps one (pixels x slices) block of
    images. Between the measured rays of a batch it walks the other acting rays, whose measurements count as 0."""
    n_pix = plan.geo.pixels

    def emit(batch_id: int, f: np.ndarray) -> pa.RecordBatch:
        first = batch_id * plan.size
        count = min(plan.size, plan.slices - first)
        offsets = pa.array(np.arange(0, (count + 1) * n_pix, n_pix, dtype=np.int32))
        images = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(f[:, :count].T).reshape(-1)))
        ids = pa.array(np.arange(first, first + count, dtype=np.int32))
        return pa.RecordBatch.from_arrays([ids, images], names=["slice", "image"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, f, ahead = None, None, iter(())
        waiting = None  # the next ray to act

        def act(until: int | None, at: np.ndarray | None, b: np.ndarray | None) -> None:
            """Let all rays before ``until`` act without measurements, and that one with ``b``."""
            nonlocal waiting
            while waiting is not None and (until is None or waiting[0] <= until):
                ray, pix, length = waiting
                measured = np.zeros(plan.size)
                if ray == until:
                    measured[at] = b
                f[pix] += np.outer(length, (measured - length @ f[pix]) * (beta / (length @ length)))
                waiting = next(ahead, None)

        for rb in batches:
            heads = zip(rb.column("batch").to_pylist(), rb.column("ray").to_pylist())
            for (batch_id, ray), (at, b) in zip(heads, _lists(rb, ["at", "b"])):
                if ray < 0:
                    if f is not None:
                        act(None, None, None)
                    if batch_id != current:
                        if f is not None:
                            yield emit(current, f)
                        current, f = batch_id, np.zeros((n_pix, plan.size))
                    ahead = plan.walk()
                    waiting = next(ahead, None)
                else:
                    act(ray, at, b)
        if f is not None:
            act(None, None, None)
            yield emit(current, f)

    return kernel


def art(measured: DataFrame, geo: TiltGeometry, slices: int, n_iter: int = 1, beta: float = 1.0) -> DataFrame:
    """Row-action reconstruction of every slice: ``slice, image`` (row-major N x N array).

    Slices are cut into batches, and a task walks the rays in order for the batches it holds. Only
    measurements are shuffled, once: the entries of a ray follow from the geometry, so each task makes them. Rays
    without pixels do not act; missing measurements count as 0; rays of which the table has no row do not act.
    """
    spark = measured.sparkSession
    plan = BatchPlan.of(spark, ray_ids(measured), geo, slices)
    entry = F.struct(
        (F.col("slice") % plan.size).cast("int").alias("at"),
        F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("b"),
    )
    # one empty row per batch opens its sweeps, so that batches without measurements exist
    opening = spark.range(plan.batches).select(
        F.col("id").cast("int").alias("batch"), F.lit(-1).alias("ray"), F.lit(None).cast("struct<at: int, b: double>").alias("m")
    )
    entries = measured.select(plan.batch(), "ray", entry.alias("m")).unionByName(opening)
    grouped = plan.place(entries).groupBy("task", "batch", "ray").agg(F.collect_list("m").alias("m"))
    sweeps = F.explode(F.sequence(F.lit(1), F.lit(n_iter))) if n_iter > 1 else F.lit(1)
    ordered = (
        grouped.withColumn("sweep", sweeps)
        .sortWithinPartitions("batch", "sweep", "ray")
        .select("batch", "ray", F.col("m.at").alias("at"), F.col("m.b").alias("b"))
    )
    return ordered.mapInArrow(_art_kernel(plan, beta), "slice INT, image ARRAY<DOUBLE>")


def _project_kernel(plan: BatchPlan):
    """Streams packed images ``batch, slice, pix[], val[]``; after a batch, emits the product of each acting ray with
    each image it meets."""
    n_pix = plan.geo.pixels

    def project(batch_id: int, f: np.ndarray, present: np.ndarray) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for ray, pix, length in plan.walk():
            met = np.flatnonzero(present[pix].any(axis=0))
            out.append((met + batch_id * plan.size, np.full(met.size, ray), (length @ f[pix])[met]))
            held += met.size
            if held > OUT_ROWS:
                yield pack(out)
                out, held = [], 0
        if out:
            yield pack(out)

    def pack(out: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        slices, rays_, products = (np.concatenate(part) for part in zip(*out))
        columns = [pa.array(slices.astype(np.int32)), pa.array(rays_.astype(np.int32)), pa.array(products)]
        return pa.RecordBatch.from_arrays(columns, names=["slice", "ray", "projected"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, f, present = None, None, None
        for rb in batches:
            heads = zip(rb.column("batch").to_pylist(), rb.column("slice").to_pylist())
            for (batch_id, slice_id), (pix, val) in zip(heads, _lists(rb, ["pix", "val"])):
                if batch_id != current:
                    if current is not None:
                        yield from project(current, f, present)
                    current = batch_id
                    f, present = np.zeros((n_pix, plan.size)), np.zeros((n_pix, plan.size), dtype=bool)
                f[pix, slice_id - batch_id * plan.size] = val
                present[pix, slice_id - batch_id * plan.size] = True
        if current is not None:
            yield from project(current, f, present)

    return kernel


def pack_pixels(pixels: DataFrame, tile: int = PACK_CELLS) -> DataFrame:
    """``slice, pix, value`` rows to ``slice, pix[], val[]``, in tiles of bounded size."""
    return (
        pixels.groupBy("slice", idiv(F.col("pix"), tile).alias("_tile"))
        .agg(F.collect_list(F.struct("pix", F.col("value").cast("double").alias("val"))).alias("p"))
        .select("slice", F.col("p.pix").alias("pix"), F.col("p.val").alias("val"))
    )


def forward_project(ids: DataFrame, images: DataFrame, geo: TiltGeometry, slices: int) -> DataFrame:
    """``A f``: ``slice, ray, projected`` for packed images ``slice, pix[], val[]`` and the rays in ``ids``.

    The plain form, a join of the matrix on the pixel and a sum per (slice, ray), makes one row per matrix entry and
    slice. Here only the images are shuffled, and each task makes the entries of a ray from the geometry.
    """
    plan = BatchPlan.of(images.sparkSession, ids, geo, slices)
    placed = plan.place(images.select(plan.batch(), "slice", "pix", "val"))
    ordered = placed.sortWithinPartitions("batch").select("batch", "slice", "pix", "val")
    return ordered.mapInArrow(_project_kernel(plan), "slice INT, ray INT, projected DOUBLE")


def recon_pixels(recon: DataFrame) -> DataFrame:
    """``slice, pix, value``: one row per reconstructed pixel."""
    return recon.select("slice", F.posexplode("image").alias("pix", "value"))


def to_voxels(pixels: DataFrame, geo: TiltGeometry, dims: GridDims) -> DataFrame:
    """Reconstructed pixels to ``index, value`` of the (slices, N, N) volume."""
    j, k = idiv(F.col("pix"), geo.n_side), F.col("pix") % geo.n_side
    return pixels.select(flat_index(F.col("slice"), j, k, dims).alias("index"), "value")


def threshold_voxels(voxels: DataFrame) -> DataFrame:
    return voxels.withColumn("value", threshold(F.col("value")))


def residual_norm(measured: DataFrame, recon: DataFrame, geo: TiltGeometry, slices: int) -> DataFrame:
    """``sum((b - A f)^2)`` per slice of ``art``'s output, over every ray of the tilt table: a missing measurement counts
    as 0, as it does in ``art``, and a ray that projects to nothing counts with its full ``b``."""
    every_pixel = F.sequence(F.lit(0), F.lit(geo.pixels - 1)).alias("pix")
    images = recon.select("slice", every_pixel, F.col("image").alias("val"))
    projected = forward_project(ray_ids(measured), images, geo, slices)
    off = F.coalesce(F.col("value"), F.lit(0.0)) - F.coalesce("projected", F.lit(0.0))
    # each (slice, ray) is in one of the two tables at least, or both its terms are 0
    return measured.join(projected, ["slice", "ray"], "full").groupBy("slice").agg(F.sum(off * off).alias("residual"))


def volume_dims(geo: TiltGeometry, slices: int) -> GridDims:
    return GridDims(slices, geo.n_side, geo.n_side)


def tilt_to_bricks(tilt: DataFrame, geo: TiltGeometry, slices: int, parts: int) -> DataFrame:
    """Tilt series to thresholded ghost bricks along x: gather, reconstruct, threshold, assemble."""
    dims = GridDims(slices, geo.n_ray, geo.n_proj)
    recon = art(measurements(tilt, dims), geo, slices)
    volume = volume_dims(geo, slices)
    voxels = threshold_voxels(to_voxels(recon_pixels(recon), geo, volume))
    return brick(voxels, BrickLayout(volume, Slabs(slices, parts, "balanced"), axis="x", halo=True))
