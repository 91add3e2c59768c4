"""Writers and readers of the stored table forms. Paths may be on any file system Spark knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.functions.index import idiv
from gridloom.functions.scalars import PIXEL_SIZE
from gridloom.model import GridDims
from gridloom.operators.grid import PACK_CELLS, center, to_ijk

VOXEL_SCHEMA = "index BIGINT, value INT"


def scan_voxels(
    spark: SparkSession, path: str, schema: str | StructType = VOXEL_SCHEMA, columns: dict[str, Column] | None = None
) -> DataFrame:
    """Scan of a stored volume with a declared schema; ``columns`` names the voxel columns of another layout."""
    stored = spark.read.schema(schema).parquet(path)
    return stored.select(*[c.alias(name) for name, c in columns.items()]) if columns else stored


def save(
    df: DataFrame, path: str, partition_by: list[str] | None = None, order_by: list[str] | None = None, compression: str = "gzip"
) -> DataFrame:
    """Write a table (all or nothing, by Spark's commit protocol) and read it back.

    The write is direct to ``path``: there is no local copy to upload or delete. A folder per ``partition_by`` value gets
    neighbouring ranges of ``order_by``, so the number of files is about that of folders plus tasks.
    """
    if partition_by:
        df = df.repartitionByRange(*partition_by, *(order_by or []))
    writer = df.write.option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def index_value(bands: DataFrame, plane: int, scale: float = 1.0) -> DataFrame:
    """Pages of an image stack to ``index, value``: page = z, x fastest, values cut to int32.

    ``scale`` widens the values first where they are fractions.
    """
    return stack_pages(bands, plane, scale).withColumn("value", F.col("value").cast("int"))


def stack_pages(bands: DataFrame, plane: int, scale: float = 1.0) -> DataFrame:
    """The float variant: ``year, index, value`` with one volume per year."""
    cells = bands.select("year", "band", F.posexplode("pixels").alias("cell", "value"))
    return cells.select(
        "year",
        (F.col("band").cast("bigint") * plane + F.col("cell")).alias("index"),
        (F.col("value").cast("double") * scale).alias("value"),
    )


def xyzv(voxels: DataFrame, dims: GridDims) -> DataFrame:
    return to_ijk(voxels, dims).select("x", "y", "z", "value")


def xyav(voxels: DataFrame, dims: GridDims) -> DataFrame:
    """Tilt series to centred coordinates: page = projection ordinal ``angle``."""
    return center(to_ijk(voxels, dims), dims).select("x", "y", F.col("z").alias("angle"), "value")


def tilt_wide(voxels: DataFrame, dims: GridDims, tile: int = PACK_CELLS) -> DataFrame:
    """One row per projection and tile of pixels, with the metadata columns.

    A projection up to ``tile`` pixels is one row (``tile`` = 0); a larger one is cut, so no row
    outgrows a task.
    """
    index = F.col("index")
    pos = index % dims.plane
    return (
        voxels.select(
            idiv(index, dims.plane).cast("int").alias("projection"),
            idiv(pos, tile).cast("int").alias("tile"),
            F.struct(pos.alias("pos"), "value").alias("pixel"),
        )
        .groupBy("projection", "tile")
        .agg(F.sort_array(F.collect_list("pixel")).alias("pixel"))
        .select(
            "projection",
            "tile",
            F.col("pixel.value").alias("pixels"),
            (F.col("projection") % dims.nz).alias("tiltangles"),
            F.array(F.lit(dims.nz), F.lit(dims.ny), F.lit(dims.nx)).alias("dimensions"),
            F.lit(PIXEL_SIZE).alias("pixelsize"),
        )
    )


def sphere_points(params: DataFrame, radius: float = 0.5) -> DataFrame:
    """Parameter rows to sphere points: two poles and rings of ``resolution`` points between them.

    Every row generates its own points; nothing is shuffled.
    """
    res = F.col("resolution")
    # below a resolution of 3 there is no ring between the poles
    rings = F.when(res >= 3, F.sequence(F.lit(1), res - 2)).otherwise(F.array().cast("array<int>"))
    inner = (
        params.select("id", "center", "resolution", F.explode(rings).alias("p"))
        .select("id", "center", "resolution", "p", F.explode(F.sequence(F.lit(0), res - 1)).alias("t"))
        .select(
            "id",
            "center",
            ((F.col("p") - 1) * res + F.col("t") + 2).cast("int").alias("point"),
            (2 * F.pi() * F.col("t") / res).alias("theta"),
            (F.pi() * F.col("p") / (res - 1)).alias("phi"),
        )
    )
    poles = params.select(
        "id", "center", F.posexplode(F.array(F.lit(0.0), F.pi())).alias("point", "phi")
    ).select("id", "center", "point", F.lit(0.0).alias("theta"), "phi")
    c = F.col("center")
    return inner.unionByName(poles).select(
        "id",
        "point",
        (c[0] + radius * F.sin("phi") * F.cos("theta")).alias("px"),
        (c[1] + radius * F.sin("phi") * F.sin("theta")).alias("py"),
        (c[2] + radius * F.cos("phi")).alias("pz"),
    )
