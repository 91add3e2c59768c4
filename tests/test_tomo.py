"""Ray matrix and reconstruction against direct numpy computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.model import GridDims, TiltGeometry
from gridloom.operators import tomo


def numpy_matrix(geo):
    """Length of every ray in every pixel by clipping the ray against each pixel box."""
    a = np.zeros((geo.rays, geo.pixels))
    n, w = geo.n_side, geo.pixel_width
    for p in range(geo.n_proj):
        t = np.deg2rad(geo.angle(p))
        direction = np.array([-np.sin(t), np.cos(t)])
        for j in range(geo.n_ray):
            o = (j - (geo.n_ray - 1) / 2) * geo.ray_width
            origin = np.array([np.cos(t) * o, np.sin(t) * o])
            for row in range(n):
                for col in range(n):
                    lo = np.array([(col - n / 2) * w, (n / 2 - row - 1) * w])
                    enter, leave = -1e9, 1e9
                    for k in range(2):
                        if abs(direction[k]) < 1e-10:
                            if not lo[k] <= origin[k] < lo[k] + w:
                                enter, leave = 1, 0
                            continue
                        s = sorted(((lo[k] - origin[k]) / direction[k], (lo[k] + w - origin[k]) / direction[k]))
                        enter, leave = max(enter, s[0]), min(leave, s[1])
                    if leave - enter > 1e-8:
                        a[p * geo.n_ray + j, row * n + col] = leave - enter
    return a


def as_dense(rows, geo):
    a = np.zeros((geo.rays, geo.pixels))
    for r in rows:
        a[r.ray, r.pix] = r.len
    return a


def all_rays(spark, geo):
    return spark.range(geo.rays).select(F.col("id").cast("int").alias("ray"))


GEOMETRIES = [
    TiltGeometry(6, 5, 6),  # odd: angle 0
    TiltGeometry(7, 4, 7),  # odd grid
    TiltGeometry(6, 46, 6),  # up to 45 degrees: rays through cell corners
    TiltGeometry(4, 91, 4),  # reaches 90 degrees
    TiltGeometry(6, 3, 13, ray_width=0.7),
    TiltGeometry(5, 4, 6, pixel_width=0.5, ray_width=0.4),
]


@pytest.mark.parametrize("geo", GEOMETRIES, ids=str)
def test_ray_matrix(spark, geo):
    got = as_dense(tomo.ray_matrix(all_rays(spark, geo), geo).collect(), geo)
    np.testing.assert_allclose(got, numpy_matrix(geo), atol=1e-7)


def test_tilt_angles(spark):
    def angles(n):
        return [r.angle for r in tomo.tilt_angles(spark, n).orderBy("proj").collect()]

    assert angles(4) == [-3, -1, 1, 3] and angles(5) == [-4, -2, 0, 2, 4]
    assert angles(74)[0] == -73 and angles(74)[-1] == 73


def test_batches_follow_memory_and_cores(spark):
    def plan(geo, slices):
        return tomo.BatchPlan.of(spark, all_rays(spark, geo), geo, slices)

    big = plan(TiltGeometry(256, 74, 256), 10_000)
    assert big.size == tomo.BATCH_BYTES // (8 * 256 * 256) and big.batches == -(-10_000 // big.size)
    assert plan(TiltGeometry(10, 5, 10), 20).size == tomo.MIN_BATCH
    assert plan(TiltGeometry(1024, 100, 1024), 100_000).size * 8 * 1024 * 1024 <= tomo.BATCH_BYTES


@pytest.mark.parametrize("geo", GEOMETRIES, ids=str)
def test_entries_of_the_kernel_equal_the_relational_matrix(spark, geo):
    want = as_dense(tomo.ray_matrix(all_rays(spark, geo), geo).collect(), geo)
    got = np.zeros_like(want)
    for ray in range(geo.rays):
        pix, length = tomo.ray_entries(geo, ray)
        got[ray, pix] = length
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_a_missing_projection_does_not_act(spark):
    geo, slices = TiltGeometry(4, 3, 4), 3
    df, dims, cube = tilt_series(spark, geo, slices)
    taken = df.where(F.col("index") >= dims.nx * dims.ny)  # without projection 0
    ids = tomo.ray_ids(tomo.measurements(taken, dims))
    assert sorted(r.ray for r in ids.collect()) == list(range(4, 12))
    a = as_dense(tomo.ray_matrix(ids, geo).collect(), geo)
    for r in tomo.art(tomo.measurements(taken, dims), geo, slices).collect():
        np.testing.assert_allclose(r.image, numpy_art(a, cube[:, :, r.slice].flatten()), atol=1e-9)


def test_residual_counts_missing_measurements_as_zero(spark):
    geo, slices = TiltGeometry(4, 3, 4), 2
    df, dims, cube = tilt_series(spark, geo, slices)
    measured = tomo.measurements(df.where("index % 5 <> 2"), dims)
    a = as_dense(tomo.ray_matrix(all_rays(spark, geo), geo).collect(), geo)
    norms = {r.slice: r.residual for r in tomo.residual_norm(measured, tomo.art(measured, geo, slices), geo, slices).collect()}
    flat = cube.flatten()
    flat[np.arange(flat.size) % 5 == 2] = 0
    for s in range(slices):
        b = flat.reshape(cube.shape)[:, :, s].flatten()
        assert norms[s] == pytest.approx(np.sum((b - a @ numpy_art(a, b)) ** 2), rel=1e-9)


def test_missed_and_boundary_rays(spark):
    geo = TiltGeometry(6, 5, 13)  # offsets -6..6 over a grid of half width 3
    missed = {(r.ray // 13 - 2, r.ray % 13 - 6): r.reason for r in tomo.missed_rays(all_rays(spark, geo), geo).collect()}
    straight = {o: reason for (p, o), reason in missed.items() if p == 0}
    # at angle 0 the ray at +3 runs along the right edge, the one at -3 counts for the first column
    assert straight == {-6: "outside", -5: "outside", -4: "outside", 3: "boundary", 4: "outside", 5: "outside", 6: "outside"}
    present = {r.ray for r in tomo.ray_matrix(all_rays(spark, geo), geo).select("ray").distinct().collect()}
    assert len(present) + len(missed) == geo.rays


def numpy_art(a, b, n_iter=1, beta=1.0):
    f = np.zeros(a.shape[1])
    for _ in range(n_iter):
        for row, value in zip(a, b):
            norm = row @ row
            if norm > 0:
                f = f + row * beta * (value - row @ f) / norm
    return f


def tilt_series(spark, geo, slices, seed=1):
    dims = GridDims(slices, geo.n_ray, geo.n_proj)
    values = np.random.default_rng(seed).uniform(0, 10, dims.cells)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "index BIGINT, value DOUBLE")
    return df, dims, values.reshape(geo.n_proj, geo.n_ray, slices)


@pytest.mark.parametrize("n_iter, beta", [(1, 1.0), (3, 0.5)])
def test_art(spark, n_iter, beta):
    geo, slices = TiltGeometry(6, 5, 6), 11
    df, dims, cube = tilt_series(spark, geo, slices)
    matrix = tomo.ray_matrix(all_rays(spark, geo), geo)
    recon = tomo.art(tomo.measurements(df, dims), geo, slices, n_iter=n_iter, beta=beta)
    got = {r.slice: np.array(r.image) for r in recon.collect()}
    a = as_dense(matrix.collect(), geo)
    assert sorted(got) == list(range(slices))
    for s in range(slices):
        np.testing.assert_allclose(got[s], numpy_art(a, cube[:, :, s].flatten(), n_iter, beta), atol=1e-9)


def test_art_batches_do_not_change_the_result(spark, monkeypatch):
    geo, slices = TiltGeometry(4, 3, 4), 9
    df, dims, _ = tilt_series(spark, geo, slices)
    matrix = tomo.ray_matrix(all_rays(spark, geo), geo)

    def images():
        return sorted((r.slice, tuple(np.round(r.image, 9))) for r in tomo.art(tomo.measurements(df, dims), geo, slices).collect())

    usual = images()
    monkeypatch.setattr(tomo, "BATCH_BYTES", 8 * geo.pixels * 2)
    monkeypatch.setattr(tomo, "MAX_ART_TASKS", 2)
    assert images() == usual


def test_missing_measurements_count_as_zero(spark):
    geo, slices = TiltGeometry(4, 3, 4), 2
    df, dims, cube = tilt_series(spark, geo, slices)
    matrix = tomo.ray_matrix(all_rays(spark, geo), geo)
    holes = df.where("index % 5 <> 2")
    zeroed = df.withColumn("value", F.when(F.col("index") % 5 == 2, 0.0).otherwise(F.col("value")))
    a, b = (
        {r.slice: r.image for r in tomo.art(tomo.measurements(x, dims), geo, slices).collect()} for x in (holes, zeroed)
    )
    for s in range(slices):
        np.testing.assert_allclose(a[s], b[s], atol=1e-12)


def test_last_ray_has_no_residual_and_residual_norm_matches(spark):
    geo, slices = TiltGeometry(6, 5, 6), 4
    df, dims, cube = tilt_series(spark, geo, slices)
    measured = tomo.measurements(df, dims)
    matrix = tomo.ray_matrix(all_rays(spark, geo), geo)
    recon = tomo.art(measured, geo, slices)
    images = tomo.pack_pixels(tomo.recon_pixels(recon), tile=7)
    last = geo.rays - 1
    projected = {r.slice: r.projected for r in tomo.forward_project(all_rays(spark, geo), images, geo, slices).where(f"ray = {last}").collect()}
    a = as_dense(matrix.collect(), geo)
    norms = {r.slice: r.residual for r in tomo.residual_norm(measured, recon, geo, slices).collect()}
    for s in range(slices):
        assert projected[s] == pytest.approx(cube[-1, -1, s], abs=1e-9)
        b = cube[:, :, s].flatten()
        assert norms[s] == pytest.approx(np.sum((b - a @ numpy_art(a, b)) ** 2), rel=1e-9)


def test_forward_project_of_sparse_images(spark):
    geo, slices = TiltGeometry(6, 4, 6), 5
    rng = np.random.default_rng(4)
    cells = [(s, p, float(rng.uniform(-1, 1))) for s in (0, 1, 4) for p in range(geo.pixels) if rng.uniform() < 0.2]
    pixels = spark.createDataFrame(cells, "slice INT, pix INT, value DOUBLE")
    matrix = tomo.ray_matrix(all_rays(spark, geo), geo)
    entries = [(r.ray, r.pix, r.len) for r in matrix.collect()]
    want = {}
    for s, p, v in cells:
        for ray, pix, length in entries:
            if pix == p:
                want[s, ray] = want.get((s, ray), 0.0) + v * length
    got = {(r.slice, r.ray): r.projected for r in tomo.forward_project(all_rays(spark, geo), tomo.pack_pixels(pixels), geo, slices).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_pipeline_with_one_slab_is_the_whole_volume(spark):
    geo, slices = TiltGeometry(4, 3, 4), 5
    df, dims, cube = tilt_series(spark, geo, slices)
    a = as_dense(tomo.ray_matrix(all_rays(spark, geo), geo).collect(), geo)
    volume = np.zeros((4, 4, slices))  # z, y, x
    for s in range(slices):
        image = numpy_art(a, cube[:, :, s].flatten()).reshape(4, 4)  # (j, k)
        volume[:, :, s] = image.T
    volume[volume < 2.0] = 0.0
    whole = tomo.tilt_to_bricks(df, geo, slices, 1).collect()
    assert len(whole) == 1 and whole[0].n_cells == volume.size
    np.testing.assert_allclose(whole[0].data, volume.flatten(), atol=1e-9)
    halves = {r.pid: r for r in tomo.tilt_to_bricks(df, geo, slices, 2).collect()}
    np.testing.assert_allclose(halves[0].data, volume[:, :, 0:4].flatten(), atol=1e-9)
    np.testing.assert_allclose(halves[1].data, volume[:, :, 2:5].flatten(), atol=1e-9)
