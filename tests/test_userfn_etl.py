"""User functions and stored forms."""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.model import GridDims
from gridloom.operators import userfn
from gridloom.session import scratch_path
from gridloom.sources import etl


def test_reduce_by_key_with_a_hot_key_and_bounded_state(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50).cast("int").alias("k"), F.lit(1).cast("bigint").alias("n"))

    def merge(rows: pd.DataFrame) -> dict:
        return {"n": rows["n"].sum()}

    want = {r.k: r["count"] for r in df.groupBy("k").count().collect()}
    for limit in (100_000, 3):
        got = userfn.reduce_by_key(df, ["k"], merge, "k INT, n BIGINT", max_keys=limit).collect()
        assert {r.k: r.n for r in got} == want


def test_partition_by_rule(spark):
    df = spark.range(100)
    placed = userfn.partition_by(df, 5, F.col("id") % 5).withColumn("at", F.spark_partition_id())
    assert placed.where("at <> pid").count() == 0


def test_map_partitions_gets_each_row_once(spark):
    placed = userfn.partition_by(spark.range(1000), 4, F.col("id") % 4)

    def tag(pid, batches):
        for b in batches:
            yield b.select(["id", "pid"])

    rows = userfn.map_partitions_indexed(placed, tag, "id BIGINT, pid INT").collect()
    assert sorted(r.id for r in rows) == list(range(1000)) and all(r.pid == r.id % 4 for r in rows)


def test_map_partitions_calls_once_per_partition(spark):
    # 50,000 rows are several Arrow batches; a running number per partition must not start again
    placed = userfn.partition_by(spark.range(50_000), 2, F.col("id") % 2)

    def numbered(pid, batches):
        seen = 0
        for b in batches:
            seen += b.num_rows
        yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "n": pa.array([seen], pa.int64())})

    rows = userfn.map_partitions_indexed(placed, numbered, "pid INT, n BIGINT").collect()
    assert sorted((r.pid, r.n) for r in rows) == [(0, 25_000), (1, 25_000)]


def test_reduce_by_key_merges_only_the_keys_of_a_batch(spark):
    df = spark.range(0, 60_000, 1, 1).select((F.col("id") / 20).cast("int").alias("k"), F.lit(1).cast("bigint").alias("n"))
    calls = spark.sparkContext.accumulator(0)

    def merge(rows: pd.DataFrame) -> dict:
        calls.add(1)
        return {"n": rows["n"].sum()}

    got = userfn.reduce_by_key(df, ["k"], merge, "k INT, n BIGINT").collect()
    assert len(got) == 3000 and all(r.n == 20 for r in got)
    assert calls.value <= 4 * 3000


def test_reduce_segments_merges_many_keys_in_one_call(spark):
    df = spark.range(0, 60_000, 1, 3).select((F.col("id") % 3000).cast("string").alias("k"), F.lit(1).cast("bigint").alias("n"), F.col("id").alias("top"))
    calls = spark.sparkContext.accumulator(0)

    def merge(values, starts):
        calls.add(1)
        return {"n": np.add.reduceat(values["n"], starts), "top": np.maximum.reduceat(values["top"], starts)}

    for held in (1 << 20, 10):
        got = userfn.reduce_segments(df, ["k"], merge, "k STRING, n BIGINT, top BIGINT", held_rows=held).collect()
        assert {r.k: (r.n, r.top) for r in got} == {str(i): (20, 57_000 + i) for i in range(3000)} and len(got) == 3000
    assert calls.value < 300


def test_reduce_segments_with_null_and_hot_keys_and_no_rows(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 7 == 0, F.col("id")).otherwise(-1)
    df = spark.range(30_000).select(key.alias("a"), (F.col("id") % 2).cast("int").alias("b"), F.encode(F.lit("x"), "utf-8").alias("state"))

    def merge(values, starts):
        return {"state": [b"".join(part) for part in np.split(values["state"], starts[1:])]}

    schema = "a BIGINT, b INT, state BINARY"
    got = {(r.a, r.b): len(r.state) for r in userfn.reduce_segments(df, ["a", "b"], merge, schema).collect()}
    assert got == {(r.a, r.b): r["count"] for r in df.groupBy("a", "b").count().collect()}
    assert userfn.reduce_segments(df.where("b = 5"), ["a", "b"], merge, schema).count() == 0


def test_round_trips(spark):
    dims = GridDims(3, 4, 2)
    vox = spark.range(dims.cells).select(F.col("id").alias("index"), (F.col("id") * 2).cast("int").alias("value"))
    stored = etl.save(vox, scratch_path(spark, "t-vox"))
    assert stored.exceptAll(vox).count() == 0 and stored.count() == dims.cells
    xyzv = etl.save(etl.xyzv(vox, dims), scratch_path(spark, "t-xyzv"))
    assert xyzv.where("value <> 2 * (x + 3 * y + 12 * z)").count() == 0
    xyav = etl.xyav(vox, dims).orderBy("angle", "y", "x").first()
    assert (xyav.x, xyav.y, xyav.angle) == (-1.5, -2.0, 0)


def test_tilt_wide_tiles_large_projections(spark):
    dims = GridDims(3, 4, 2)
    vox = spark.range(dims.cells).select(F.col("id").alias("index"), F.col("id").cast("int").alias("value"))
    one = etl.tilt_wide(vox, dims).orderBy("projection").collect()
    assert [r.pixels for r in one] == [list(range(12)), list(range(12, 24))]
    assert [(r.tiltangles, r.dimensions, r.pixelsize) for r in one] == [(0, [2, 4, 3], 10), (1, [2, 4, 3], 10)]
    cut = etl.tilt_wide(vox, dims, tile=5).orderBy("projection", "tile").collect()
    assert [len(r.pixels) for r in cut] == [5, 5, 2, 5, 5, 2]


def test_sphere_without_rings_has_two_poles(spark):
    params = spark.createDataFrame([(1, [0.0, 0.0, 0.0], 2), (2, [0.0, 0.0, 0.0], 1)], "id BIGINT, center ARRAY<DOUBLE>, resolution INT")
    assert sorted((r.id, r.point) for r in etl.sphere_points(params).collect()) == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_sphere_points_lie_on_the_sphere(spark):
    params = spark.createDataFrame([(3, [3.0, 0.0, 0.0], 6)], "id BIGINT, center ARRAY<DOUBLE>, resolution INT")
    points = etl.sphere_points(params).collect()
    assert len(points) == 2 + 4 * 6 and len({r.point for r in points}) == len(points)
    assert all(math.isclose((r.px - 3) ** 2 + r.py**2 + r.pz**2, 0.25) for r in points)
