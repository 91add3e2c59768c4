"""User functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from gridloom.functions.slabs import Slabs
from gridloom.functions.index import k_of
from gridloom.operators import place, userfn
from gridloom.plans import sqltext as Q
from gridloom.plans.aggregates import MEANS
from gridloom.plans.expressions import OBS_HI
from gridloom.plans.registry import PARTS, TASKS_PER_SLAB, query
from gridloom.sources import etl
from gridloom.sources import fixtures as fx


@query(
    "udf_scalar",
    f"WITH {Q.VOX} SELECT x, y, z, value, CAST(16 * z // ((SELECT max(z) FROM ijk) + 1) AS INTEGER) AS bin FROM ijk",
)
def udf_scalar(spark, sf):
    points = etl.xyzv(fx.vox(spark, sf), fx.vox_dims(spark, sf))
    max_z = points.agg(F.max("z")).scalar()

    def bin_of(z: pd.Series, top: pd.Series) -> pd.Series:
        return (4 * PARTS * z.astype("int64") // (top + 1)).astype("int32")

    rule = userfn.column_udf(bin_of, "int")
    return points.withColumn("top", max_z).withColumn("bin", rule("z", "top")).drop("top")


@query("map_rows", "SELECT event_id AS index, round(value * 9 / 5 + 32, 6) AS value FROM events")
def map_rows(spark, sf):
    def to_f(batch: pa.RecordBatch) -> pa.RecordBatch:
        scaled = batch.column("value").to_numpy(zero_copy_only=False) * 9 / 5 + 32
        return pa.RecordBatch.from_arrays([batch.column("index"), pa.array(scaled)], names=["index", "value"])

    mapped = userfn.map_rows(fx.tilt_voxels(spark, sf), to_f, "index BIGINT, value DOUBLE")
    return mapped.withColumn("value", F.round("value", 6))


@query("flat_map_rows", f"WITH {Q.CELLS} SELECT year, value FROM cells")
def flat_map_rows(spark, sf):
    def pixels(batch: pa.RecordBatch):
        lists = batch.column("pixels")
        years = np.repeat(batch.column("year").to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy())
        values = lists.flatten().to_numpy(zero_copy_only=False).astype("float64")
        yield pa.RecordBatch.from_arrays([pa.array(years), pa.array(values)], names=["year", "value"])

    bands = fx.band_arrays(spark, sf).select("year", "pixels")
    return userfn.flat_map_rows(bands, pixels, "year INT, value DOUBLE")


@query("reduce_custom", MEANS)
def reduce_custom(spark, sf):
    pairs = (
        fx.observations(spark, sf)
        .where(F.col("value") < OBS_HI)
        .select("year", F.col("value").alias("s"), F.lit(1).cast("bigint").alias("n"))
    )

    def merge(values: dict[str, np.ndarray], starts: np.ndarray) -> dict[str, np.ndarray]:
        return {c: np.add.reduceat(values[c], starts) for c in ("s", "n")}

    sums = userfn.reduce_segments(pairs, ["year"], merge, "year INT, s DOUBLE, n BIGINT")
    return sums.select(
        "year", F.round("s", 4).alias("total"), "n", F.round(F.col("s") / F.col("n"), 6).alias("mean")
    )


@query(
    "partition_function",
    f"""WITH {Q.VOX}, {Q.slabs('nz', 'dims', PARTS, 'threshold')}
SELECT i.index, i.value, s.pid FROM ijk i JOIN slabs s ON i.z >= s.lo AND i.z < s.hi""",
)
def partition_function(spark, sf):
    dims = fx.vox_dims(spark, sf)
    rule = Slabs(dims.nz, PARTS, "threshold").owner(k_of(F.col("index"), dims))
    return userfn.partition_by(fx.vox(spark, sf), PARTS, rule, TASKS_PER_SLAB).select("index", "value", "pid")


@query(
    "map_partitions_indexed",
    f"""WITH {Q.VOX}, {Q.slabs('nz', 'dims', PARTS, 'threshold')}
SELECT s.pid, CAST(sum(i.value) AS BIGINT) AS total, count(*) AS n, max(i.index) AS max_index
FROM ijk i JOIN slabs s ON i.z >= s.lo AND i.z < s.hi GROUP BY s.pid""",
)
def map_partitions_indexed(spark, sf):
    def partial(pid: int, batches):
        total, n, top = 0, 0, -1
        for b in batches:  # one fold over the whole partition
            total += pc.sum(b.column("value")).as_py() or 0
            n += b.num_rows
            top = max(top, pc.max(b.column("index")).as_py())
        columns = {"pid": pa.array([pid], pa.int32())}
        columns |= {k: pa.array([v], pa.int64()) for k, v in (("total", total), ("n", n), ("max_index", top))}
        yield pa.RecordBatch.from_pydict(columns)

    dims = fx.vox_dims(spark, sf)
    owned = place.with_owner(fx.vox(spark, sf), dims, "z", Slabs(dims.nz, PARTS, "threshold"))
    placed = place.place(owned, PARTS, splits=TASKS_PER_SLAB, spread_on=F.col("index"))
    partials = userfn.map_partitions_indexed(placed, partial, "pid INT, total BIGINT, n BIGINT, max_index BIGINT")
    return partials.groupBy("pid").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.max("max_index").alias("max_index")
    )
