"""Halo exchange and dense bricks against a numpy volume."""

import numpy as np
import pytest

from gridloom.functions.slabs import Slabs
from gridloom.model import GridDims
from gridloom.operators.bricks import BrickLayout, annotate, brick, cell_extent, halo, split_rejects, whole_extent
from gridloom.operators.grid import split_grid
from gridloom.operators.place import with_owner


def voxels(spark, dims, keep=lambda i: True):
    rows = [(i, float(i * i % 101)) for i in range(dims.cells) if keep(i)]
    volume = np.zeros(dims.cells)
    for i, v in rows:
        volume[i] = v
    return spark.createDataFrame(rows, "index BIGINT, value DOUBLE"), volume.reshape(dims.nz, dims.ny, dims.nx)


def arrays(table):
    """pid -> concatenated blocks."""
    out = {}
    for r in table.orderBy("pid", "block").collect():
        assert r.start == len(out.get(r.pid, []))
        out.setdefault(r.pid, []).extend(r.data)
    return out


@pytest.mark.parametrize("axis", ["x", "y", "z"])
@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("with_halo", [False, True])
@pytest.mark.parametrize("block", [4, 8192])
def test_brick_equals_numpy_slice(spark, axis, parts, with_halo, block):
    dims = GridDims(5, 4, 7)
    df, volume = voxels(spark, dims, keep=lambda i: i % 3 != 1 and not 40 <= i < 75)
    n = dims.along(axis)
    layout = BrickLayout(dims, Slabs(n, parts, "balanced"), axis, with_halo)
    table = brick(df, layout, block_cells=block)
    got = arrays(table)
    extents = {r.pid: r for r in table.collect()}
    assert sorted(got) == list(range(parts))
    widths = [n // parts + (p < n % parts) for p in range(parts)]
    for pid in range(parts):
        lo = sum(widths[:pid]) - (1 if with_halo and pid > 0 else 0)
        hi = sum(widths[: pid + 1]) + (1 if with_halo and pid < parts - 1 else 0)
        cut = {"x": volume[:, :, lo:hi], "y": volume[:, lo:hi, :], "z": volume[lo:hi]}[axis]
        assert got[pid] == cut.flatten().tolist()
        assert (extents[pid][f"min_{axis}"], extents[pid][f"max_{axis}"]) == (lo, hi - 1)
        assert extents[pid].n_cells == cut.size
    extent = whole_extent(df, dims).first()
    assert tuple(extent) == (0, 0, 0, 4, 3, 6)


def test_width_one_slab_sends_its_plane_both_ways(spark):
    dims = GridDims(3, 2, 2)
    df, _ = voxels(spark, dims)
    rows = halo(df, BrickLayout(dims, Slabs(3, 3, "balanced"), "x", halo=True)).collect()
    middle = [r for r in rows if r["index"] % 3 == 1]
    assert sorted({(r.pid, r.ghost) for r in middle}) == [(0, True), (1, False), (2, True)]
    # two planes cross each of the two inner boundaries
    assert sum(r.ghost for r in rows) == 2 * 2 * (dims.ny * dims.nz)


def test_single_slab_has_no_ghosts(spark):
    dims = GridDims(3, 2, 2)
    df, _ = voxels(spark, dims)
    rows = halo(df, BrickLayout(dims, Slabs(3, 1, "balanced"), "x", halo=True)).collect()
    assert len(rows) == dims.cells and not any(r.ghost for r in rows)


def test_empty_brick_is_all_fill(spark):
    dims = GridDims(2, 2, 3)
    empty = spark.createDataFrame([], "index BIGINT, value DOUBLE")
    layout = BrickLayout(dims, Slabs(3, 3, "threshold"), "z")
    assert arrays(brick(empty, layout, fill=7.0)) == {p: [7.0] * 4 for p in range(3)}
    assert arrays(brick(empty, layout, fill=None)) == {p: [None] * 4 for p in range(3)}


@pytest.mark.parametrize("axis", ["x", "z"])
@pytest.mark.parametrize("with_halo", [False, True])
def test_rows_outside_the_grid_make_no_bricks(spark, axis, with_halo):
    dims = GridDims(4, 2, 2)
    df, _ = voxels(spark, dims)
    strays = spark.createDataFrame([(-1, 5.0), (-7, 5.0), (16, 5.0), (17, 5.0), (900, 5.0), (None, 5.0)], "index BIGINT, value DOUBLE")
    layout = BrickLayout(dims, Slabs(dims.along(axis), 2, "balanced"), axis, with_halo)
    table = brick(df.unionByName(strays), layout, block_cells=3)
    assert arrays(table) == arrays(brick(df, layout, block_cells=3))
    assert all(len(arrays(table)[r.pid]) == r.n_cells for r in table.collect())
    assert split_grid(df.unionByName(strays), dims.cells)[1].count() == 6


def test_missing_and_null_cells_stay_null_without_fill(spark):
    dims = GridDims(2, 1, 2)
    df = spark.createDataFrame([(0, 1.0), (1, None), (3, 4.0)], "index BIGINT, value DOUBLE")
    layout = BrickLayout(dims, Slabs(2, 1, "balanced"), "z")
    assert arrays(brick(df, layout, fill=None)) == {0: [1.0, None, None, 4.0]}


def test_annotated_brick_over_several_blocks(spark):
    dims = GridDims(2, 2, 5)
    df, volume = voxels(spark, dims)
    layout = BrickLayout(dims, Slabs(5, 2, "balanced"), "z")
    rows = annotate(cell_extent(brick(df, layout, fill=None, block_cells=3)), layout).orderBy("pid", "block").collect()
    slices = {0: [], 1: []}
    for r in rows:
        slices[r.pid] += r.slice
        assert set(r.owner) == {r.pid} and len(r.owner) == len(r.data)
        assert (r.min_x, r.max_x, r.min_z, r.max_z) == (0, 2, [0, 3][r.pid], [3, 5][r.pid])
    assert slices == {0: [0] * 4 + [1] * 4 + [2] * 4, 1: [3] * 4 + [4] * 4}


def test_rejects_are_empty_when_rule_and_brick_agree(spark):
    dims = GridDims(10, 3, 2)
    df, _ = voxels(spark, dims)
    for rule, n_rejected in (("balanced", 0), ("even", 1)):
        placed = with_owner(df, dims, "x", Slabs(10, 4, rule))
        kept, rejected = split_rejects(placed, BrickLayout(dims, Slabs(10, 4, "balanced"), "x"))
        assert kept.count() + rejected.count() == dims.cells
        assert rejected.count() == n_rejected
