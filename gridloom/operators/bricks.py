"""Halo exchange and assembly of dense bricks.

A brick is the dense sub-volume of one slab. It is stored as blocks of consecutive local
cells (``pid, block, data``), so the largest group in one task is a block, whatever the size
of the slab. Concatenating the blocks of a ``pid`` in order gives the brick's array.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.index import axis_of, idiv
from gridloom.functions.slabs import Slabs
from gridloom.model import GridDims
from gridloom.operators.grid import PACK_CELLS, dense_rows, split_grid, to_ijk


@dataclass(frozen=True)
class BrickLayout:
    """How a grid is cut into bricks: axis, slab rule and whether inner sides carry a halo plane."""

    dims: GridDims
    slabs: Slabs
    axis: str = "z"
    halo: bool = False

    def lo(self, pid: Column) -> Column:
        first = self.slabs.start(pid)
        return first - (pid > 0).cast("int") if self.halo else first

    def hi(self, pid: Column) -> Column:
        """One past the last cell along the split axis."""
        end = self.slabs.end(pid)
        return end + (pid < self.slabs.parts - 1).cast("int") if self.halo else end

    def width(self, pid: Column) -> Column:
        return self.hi(pid) - self.lo(pid)

    def cells(self, pid: Column) -> Column:
        across = self.dims.cells // self.dims.along(self.axis)
        return self.width(pid).cast("bigint") * across

    def max_cells(self) -> int:
        across = self.dims.cells // self.dims.along(self.axis)
        return (self.slabs.widest() + (2 if self.halo else 0)) * across

    def local_index(self, x: Column, y: Column, z: Column, pid: Column) -> Column:
        """Index inside the brick, x fastest."""
        i, j, k = x.cast("bigint"), y.cast("bigint"), z.cast("bigint")
        nx, ny = F.lit(self.dims.nx), F.lit(self.dims.ny)
        if self.axis == "x":
            i, nx = i - self.lo(pid), self.width(pid)
        elif self.axis == "y":
            j, ny = j - self.lo(pid), self.width(pid)
        else:
            k = k - self.lo(pid)
        return i + j * nx + k * nx.cast("bigint") * ny

    def extent(self, pid: Column) -> dict[str, Column]:
        """Inclusive point extent of the brick."""
        out = {}
        for axis in "xyz":
            last = self.dims.along(axis) - 1
            own = axis == self.axis
            out[f"min_{axis}"] = self.lo(pid) if own else F.lit(0)
            out[f"max_{axis}"] = self.hi(pid) - 1 if own else F.lit(last)
        return {name: col.cast("int") for name, col in out.items()}


def halo(df: DataFrame, layout: BrickLayout) -> DataFrame:
    """Copy each slab's boundary planes to its neighbours.

    ``pid`` is the slab that receives the row and ``ghost`` tells a copy from an own row. Every
    row is emitted to one to three slabs by an expression: no self join, nothing exchanged
    between tasks. A slab of width one sends its plane both ways.
    """
    slabs = layout.slabs
    cell = axis_of(F.col("index"), layout.axis, layout.dims)
    own = F.col("_own")
    at_lo = (F.col("_cell") == slabs.start(own)) & (own > 0)
    at_hi = (F.col("_cell") == slabs.end(own) - 1) & (own < slabs.parts - 1)
    targets = (
        F.when(at_lo & at_hi, F.array(own, own - 1, own + 1))
        .when(at_lo, F.array(own, own - 1))
        .when(at_hi, F.array(own, own + 1))
        .otherwise(F.array(own))
    )
    return (
        df.withColumn("_cell", cell)
        .withColumn("_own", slabs.owner(F.col("_cell")))
        .withColumn("pid", F.explode(targets))
        .withColumn("ghost", F.col("pid") != F.col("_own"))
        .drop("_cell", "_own")
    )


def owned_cells(df: DataFrame, layout: BrickLayout) -> DataFrame:
    """Rows with the slab (or, with a halo, slabs) they belong to."""
    if layout.halo:
        return halo(df, layout)
    owner = layout.slabs.owner(axis_of(F.col("index"), layout.axis, layout.dims))
    return df.withColumn("pid", owner)


def with_local_index(df: DataFrame, layout: BrickLayout, out: str = "local_index") -> DataFrame:
    placed = to_ijk(df, layout.dims)
    return placed.withColumn(out, layout.local_index(F.col("x"), F.col("y"), F.col("z"), F.col("pid")))


def split_rejects(df: DataFrame, layout: BrickLayout) -> tuple[DataFrame, DataFrame]:
    """Rows whose local index lies inside their brick, and the others."""
    placed = with_local_index(df, layout)
    inside = F.col("local_index").between(F.lit(0), layout.cells(F.col("pid")) - 1)
    return placed.where(inside), placed.where(~inside)


def brick(df: DataFrame, layout: BrickLayout, fill: float | None = 0.0, block_cells: int = PACK_CELLS) -> DataFrame:
    """Assemble ``index, value`` rows into dense bricks.

    Returns ``pid, block, start, n_cells, min_x .. max_z, data``; ``start`` is the local index of
    the block's first cell, missing cells hold ``fill``. One shuffle of the sparse rows, keyed on
    (pid, block), serves the fill and the packing; a group is one block. Rows outside the grid are left
    out; ``grid.split_grid`` gives them.
    """
    pid = F.col("pid")
    inside = split_grid(df.select("index", F.col("value").cast("double")), layout.dims.cells)[0]
    located = split_rejects(owned_cells(inside, layout), layout)[0]
    sparse = located.select(
        "pid",
        idiv(F.col("local_index"), block_cells).alias("block"),
        (F.col("local_index") % block_cells).cast("int").alias("pos"),
        "value",
    )
    per_slab = -(-layout.max_cells() // block_cells)
    length = F.least(layout.cells(pid) - F.col("block") * block_cells, F.lit(block_cells))
    markers = (
        df.sparkSession.range(layout.slabs.parts * per_slab)
        .select(idiv(F.col("id"), per_slab).cast("int").alias("pid"), (F.col("id") % per_slab).alias("block"))
        .where(length > 0)
    )
    dense = dense_rows(sparse, markers, ["pid", "block"], length, {"value": F.lit(fill)})
    return (
        dense.groupBy("pid", "block")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("_cells"))
        .select(
            "pid",
            "block",
            (F.col("block") * block_cells).alias("start"),
            layout.cells(pid).alias("n_cells"),
            *[c.alias(name) for name, c in layout.extent(pid).items()],
            F.col("_cells.value").alias("data"),
        )
    )


def cell_extent(bricks: DataFrame) -> DataFrame:
    """Point extent to cell extent: each axis ends one later (``0..nx, 0..ny, z0..z1``)."""
    return bricks.withColumns({f"max_{axis}": F.col(f"max_{axis}") + 1 for axis in "xyz"})


def annotate(bricks: DataFrame, layout: BrickLayout) -> DataFrame:
    """Add the owner id and the global slice number of every cell next to the data.

    Both follow from the position, so nothing is moved; only for slabs along z.
    """
    if layout.axis != "z":
        raise ValueError("slice numbers need slabs along z")
    first_slice = layout.lo(F.col("pid"))
    plane = layout.dims.plane
    size = F.size("data")
    return bricks.withColumns(
        {
            "owner": F.array_repeat(F.col("pid"), size),
            "slice": F.transform(
                F.sequence(F.lit(0), size - 1),
                lambda at: (first_slice + idiv(F.col("start") + at, plane)).cast("int"),
            ),
        }
    )


def whole_extent(df: DataFrame, dims: GridDims) -> DataFrame:
    """Point extent of the union of all bricks: that of the rows inside the grid, by one partial aggregation.

    Bricks cover the slabs that hold their rows, and slabs together the grid, so nothing has to be assembled for it.
    """
    points = to_ijk(split_grid(df, dims.cells)[0], dims)
    aggs = [F.min(a).alias(f"min_{a}") for a in "xyz"] + [F.max(a).alias(f"max_{a}") for a in "xyz"]
    return points.agg(*aggs)
