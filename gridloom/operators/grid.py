"""Grid operators: coordinates, dense positions, densification, ghost masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.index import axis_of, flat_index, i_of, idiv, j_of, k_of
from gridloom.functions.scalars import MASK_HIDDEN, MASK_OWNED, tilt_radians
from gridloom.functions.slabs import Slabs
from gridloom.model import GridDims
from gridloom.session import broadcast_if_small, materialize

#: Cells per block when rows of a block are only sorted and filled.
BLOCK_CELLS = 1 << 16
#: Cells per block when a block becomes one array. An aggregation holds up to 128 groups before
#: it sorts, so this bounds a packing task to about 100 MB.
PACK_CELLS = 1 << 13


def to_ijk(df: DataFrame, dims: GridDims) -> DataFrame:
    """Add ``x, y, z`` computed from ``index``."""
    index = F.col("index")
    return df.withColumns({"x": i_of(index, dims), "y": j_of(index, dims), "z": k_of(index, dims)})


def to_index(df: DataFrame, dims: GridDims, i_offset: int = 0) -> DataFrame:
    """Add ``index`` computed from ``x, y, z``."""
    return df.withColumn("index", flat_index(F.col("x"), F.col("y"), F.col("z"), dims, i_offset))


def center(df: DataFrame, dims: GridDims) -> DataFrame:
    """Shift ``x`` and ``y`` so that the image centre is the origin."""
    return df.withColumns(
        {
            "x": F.col("x").cast("double") - 0.5 * dims.nx,
            "y": F.col("y").cast("double") - 0.5 * dims.ny,
        }
    )


def tilt_rotate_points(df: DataFrame) -> DataFrame:
    """Centred pixel ``(x, y, angle)`` to a point on its tilted plane."""
    t = tilt_radians(F.col("angle"))
    return df.withColumns({"px": F.col("y") * F.cos(t), "py": F.col("x"), "pz": F.col("y") * F.sin(t)})


def tilt_rotate_index(df: DataFrame, dims: GridDims) -> DataFrame:
    """The same from an index-form tilt series: x is centred on the integer half width."""
    index = F.col("index")
    offset = i_of(index, dims) - dims.nx // 2
    t = tilt_radians(k_of(index, dims))
    return df.withColumns({"px": offset * F.cos(t), "py": j_of(index, dims).cast("double"), "pz": offset * F.sin(t)})


def rank_in_group(df: DataFrame, group: str, id_col: str, out: str) -> DataFrame:
    """``group, id_col, out``: 0-based rank of a unique id within its group.

    A plain window over the group would sort a hot group in one task. Here rows are range-partitioned on
    (group, id), whatever the ids look like; a rank is the place in the partition plus what the group has in
    earlier partitions, one count per partition and group. Only these two columns are moved and written.
    """
    spark = df.sparkSession
    ranged = df.select(group, id_col).repartitionByRange(group, id_col).sortWithinPartitions(group, id_col)
    fixed = _with_places(materialize(ranged.withColumn("_mid", F.monotonically_increasing_id()), "rank"))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        fixed.groupBy(group, "_part")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
        .select(group, "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    groups = df.select(group).distinct().count()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))  # ranges cut at most so many groups
    rank = F.col("_offset") + F.col("_row") - F.col("_first")
    return fixed.join(broadcast_if_small(offsets, groups + partitions, 48), [group, "_part"]).select(
        group, id_col, rank.cast("int").alias(out)
    )


def _with_places(fixed: DataFrame) -> DataFrame:
    """Split ``_mid`` into partition and row: it is the partition number above 33 bits of row number."""
    return fixed.withColumns(
        {"_part": F.shiftright("_mid", 33), "_row": F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))}
    )


def positional_index(df: DataFrame, order_by: list[str], out: str = "index") -> DataFrame:
    """Attach the dense 0-based position of each row in a total order.

    One range shuffle and one sort; no window over the whole table. The partition layout
    is written once to shared storage because the position is assembled from two passes
    (rows per partition, then rows): if a lost executor's partition were sampled again, the
    two could disagree. ``order_by`` must be unique per row; a hot leading value is split
    by the later columns.
    """
    spark = df.sparkSession
    ranged = (
        df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn("_mid", F.monotonically_increasing_id())
    )
    fixed = _with_places(materialize(ranged, "position"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        fixed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))  # one offsets row each
    return (
        fixed.join(broadcast_if_small(offsets, partitions, 16), "_part")
        .withColumn(out, F.col("_offset") + F.col("_row"))
        .drop("_mid", "_part", "_row", "_offset")
    )


def zip_positional(left: DataFrame, right: DataFrame, index: str = "index") -> DataFrame:
    """Pair the n-th rows of two tables that carry a dense position. A position that only one table has fails the job."""
    own = [F.col(f"l.{c}") for c in left.columns if c != index]
    other = [F.col(f"r.{c}") for c in right.columns if c != index]
    paired = left.alias("l").join(right.alias("r"), F.col(f"l.{index}") == F.col(f"r.{index}"), "full")
    alone = F.col(f"l.{index}").isNull() | F.col(f"r.{index}").isNull()
    stop = F.raise_error(F.lit("zip_positional: the tables have different positions"))
    return paired.select(F.when(alone, stop.cast("bigint")).otherwise(F.col(f"l.{index}")).alias(index), *own, *other)


def dense_rows(
    sparse: DataFrame, markers: DataFrame, keys: list[str], length: Column, fill: dict[str, Column]
) -> DataFrame:
    """Fill every block to its full length: ``keys, pos`` and the columns of ``fill``.

    ``sparse`` has the entries (``keys``, ``pos``, values), ``markers`` one row per block with
    ``pos = -1``, so that empty blocks exist and every block starts with a run. An entry knows the
    position of the next one and generates the empty cells up to it. Only the sparse rows
    are shuffled, and the output stays partitioned by ``keys`` and ordered by ``pos`` within them.
    """
    values = list(fill)
    types = dict(sparse.select(*values).dtypes)
    blank = [F.lit(None).cast(types[c]).alias(c) for c in values]
    w = W.partitionBy(*keys).orderBy("pos")
    runs = (
        sparse.select(*keys, "pos", *values)
        .unionByName(markers.select(*keys, F.lit(-1).alias("pos"), *blank))
        .withColumn("_next", F.coalesce(F.lead("pos").over(w), length.cast("int")))
        .where(F.col("_next") > F.greatest("pos", F.lit(0)))
    )
    cell = F.explode(F.sequence(F.greatest("pos", F.lit(0)), F.col("_next") - 1)).alias("_cell")
    hit = F.col("_cell") == F.col("pos")
    return runs.select(*keys, "pos", cell, *values).select(
        *keys,
        F.col("_cell").alias("pos"),
        *[F.when(hit, F.col(c)).otherwise(fill[c]).cast(types[c]).alias(c) for c in values],
    )


def split_grid(df: DataFrame, cells: int, index: str = "index") -> tuple[DataFrame, DataFrame]:
    """Rows with an index in ``0 .. cells-1``, and the others (a null index among them)."""
    inside = F.coalesce(F.col(index).between(F.lit(0), F.lit(cells - 1)), F.lit(False))
    return df.where(inside), df.where(~inside)


def densify(
    df: DataFrame, cells: int, fill: dict[str, Column], index: str = "index", block_cells: int = BLOCK_CELLS
) -> DataFrame:
    """Scatter sparse rows into the full ``0 .. cells-1`` index range.

    ``fill`` maps each value column to what an empty cell holds. Works block by block; there is
    no join with the full grid. Rows outside the range are left out; ``split_grid`` gives them.
    """
    block = idiv(F.col(index), block_cells)
    inside = split_grid(df, cells, index)[0]
    sparse = inside.select(block.alias("block"), (F.col(index) % block_cells).cast("int").alias("pos"), *fill)
    markers = df.sparkSession.range(-(-cells // block_cells)).select(F.col("id").alias("block"))
    length = F.least(F.lit(cells) - F.col("block") * block_cells, F.lit(block_cells))
    dense = dense_rows(sparse, markers, ["block"], length, fill)
    return dense.select((F.col("block") * block_cells + F.col("pos")).alias(index), *fill)


def mask_runs(df: DataFrame, dims: GridDims, slabs: Slabs, axis: str = "z", block_cells: int = BLOCK_CELLS) -> DataFrame:
    """The cells that each slab owns, as runs ``pid, start, length, mask``; all other cells of the grid are hidden.

    This is the stored form: its size is that of the sparse volume, not slabs times cells. Runs end at blocks.
    """
    owner = slabs.owner(axis_of(F.col("index"), axis, dims))
    cells = split_grid(df, dims.cells)[0].select("index", owner.alias("pid"), idiv(F.col("index"), block_cells).alias("block"))
    order = W.partitionBy("pid", "block").orderBy("index")
    island = F.col("index") - F.row_number().over(order)
    runs = cells.withColumn("_island", island).groupBy("pid", "block", "_island")
    return runs.agg(F.min("index").alias("start"), F.count(F.lit(1)).alias("length")).select(
        "pid", "start", "length", F.lit(MASK_OWNED).cast("tinyint").alias("mask")
    )


def expand_mask(runs: DataFrame, dims: GridDims, parts: int, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """Runs to ``pid, index, mask`` over the whole grid for every slab: cells outside the runs are hidden."""
    at = F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("index")
    sparse = runs.where("length > 0").select("pid", "mask", at)
    sparse = sparse.select("pid", idiv(F.col("index"), block_cells).alias("block"), (F.col("index") % block_cells).cast("int").alias("pos"), "mask")
    blocks = -(-dims.cells // block_cells)
    markers = runs.sparkSession.range(parts * blocks).select(
        idiv(F.col("id"), blocks).cast("int").alias("pid"), (F.col("id") % blocks).alias("block")
    )
    length = F.least(F.lit(dims.cells) - F.col("block") * block_cells, F.lit(block_cells))
    dense = dense_rows(sparse, markers, ["pid", "block"], length, {"mask": F.lit(MASK_HIDDEN)})
    return dense.select("pid", (F.col("block") * block_cells + F.col("pos")).alias("index"), "mask")


def ghost_mask(df: DataFrame, dims: GridDims, slabs: Slabs, axis: str = "z") -> DataFrame:
    """For every slab, a mask over the whole grid: owned cells 1, all others 32."""
    return expand_mask(mask_runs(df, dims, slabs, axis), dims, slabs.parts)
