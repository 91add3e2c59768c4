"""Index algebra on columns: everything stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.model import GridDims


def idiv(a: Column, b: Column | int) -> Column:
    """Integer division (``a / b`` would go through DOUBLE and lose digits past 2^53)."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def i_of(index: Column, dims: GridDims) -> Column:
    return (index % dims.nx).cast("int")


def j_of(index: Column, dims: GridDims) -> Column:
    return (idiv(index, dims.nx) % dims.ny).cast("int")


def k_of(index: Column, dims: GridDims) -> Column:
    return idiv(index, dims.plane).cast("int")


def flat_index(i: Column, j: Column, k: Column, dims: GridDims, i_offset: int = 0) -> Column:
    """``(i, j, k)`` to the global index; ``i_offset`` is where a local x axis starts."""
    wide = [c.cast("bigint") for c in (i, j, k)]
    return wide[0] + i_offset + wide[1] * dims.nx + wide[2] * dims.plane


def axis_of(index: Column, axis: str, dims: GridDims) -> Column:
    return {"x": i_of, "y": j_of, "z": k_of}[axis](index, dims)
