"""Index algebra, slab rules, placement, positions and densification."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions.slabs import RULES, Slabs
from gridloom.model import GridDims
from gridloom.operators import grid, place


def owners_by_definition(n, parts, rule):
    """Cell -> slab from the textbook form of each rule, not the closed form under test."""
    if rule == "threshold":
        sizes = [(p + 1) * n // parts - p * n // parts for p in range(parts)]
    elif rule == "balanced":
        sizes = [n // parts + (1 if p < n % parts else 0) for p in range(parts)]
    else:
        top = n if rule == "even" else n + 1
        return [parts * i // top for i in range(n)]
    return [p for p, size in enumerate(sizes) for _ in range(size)]


CASES = [(n, p) for n in (1, 2, 5, 7, 10, 16, 23, 41) for p in (1, 2, 3, 4, 7, 16) if p <= n]


@pytest.mark.parametrize("rule", RULES)
def test_slab_rules(spark, rule):
    cols = [Slabs(n, p, rule).owner(F.col("id")).alias(f"o_{n}_{p}") for n, p in CASES]
    rows = spark.range(41).select("id", *cols).orderBy("id").collect()
    bounds = spark.range(17).select(
        "id", *[Slabs(n, p, rule).start(F.col("id")).alias(f"s_{n}_{p}") for n, p in CASES]
    ).orderBy("id").collect()
    for n, p in CASES:
        want = owners_by_definition(n, p, rule)
        assert [r[f"o_{n}_{p}"] for r in rows[:n]] == want
        starts = [b[f"s_{n}_{p}"] for b in bounds[: p + 1]]
        assert starts[0] == 0 and starts[p] == n
        for slab in range(p):
            assert want.count(slab) == starts[slab + 1] - starts[slab] <= Slabs(n, p, rule).widest()


def test_slab_rule_rejects_too_many_parts():
    with pytest.raises(ValueError):
        Slabs(3, 4, "balanced")
    with pytest.raises(ValueError):
        Slabs(3, 2, "other")


def test_known_slab_sizes(spark):
    def widths(n, parts, rule):
        return [r.width for r in place.slab_table(spark, Slabs(n, parts, rule)).orderBy("pid").collect()]

    assert widths(261, 4, "threshold") == [65, 65, 65, 66]
    assert widths(74, 4, "threshold") == [18, 19, 18, 19]
    assert widths(256, 4, "closed") == [65, 64, 64, 63]
    dims = GridDims(100, 216, 261)
    cells = spark.range(dims.cells).withColumnRenamed("id", "index")
    counts = place.with_owner_by_index(cells, dims, 4).groupBy("pid").count().orderBy("pid").collect()
    assert [r["count"] for r in counts] == [1_414_800] * 3 + [1_393_200]


def test_index_round_trip(spark):
    dims = GridDims(7, 5, 3)
    cells = spark.range(dims.cells).withColumnRenamed("id", "index")
    ijk = grid.to_ijk(cells, dims).withColumnRenamed("index", "was")
    assert grid.to_index(ijk, dims).where("index <> was").count() == 0
    assert ijk.select("x", "y", "z").distinct().count() == dims.cells


def test_large_index_keeps_all_digits(spark):
    dims = GridDims(1 << 20, 1 << 20, 1 << 20)
    big = (1 << 59) + 12345
    row = grid.to_ijk(spark.range(big, big + 1).withColumnRenamed("id", "index"), dims).first()
    assert (row.x, row.y, row.z) == (12345, 0, 1 << 19)


@pytest.mark.parametrize("splits", [1, 3])
def test_place_puts_rows_into_their_partition(spark, splits):
    dims = GridDims(10, 10, 13)
    cells = spark.range(dims.cells).withColumnRenamed("id", "index")
    owned = place.with_owner(cells, dims, "z", Slabs(13, 4, "threshold"))
    placed = place.place(owned, 4, splits=splits).withColumn("at", F.spark_partition_id())
    assert placed.rdd.getNumPartitions() == 4 * splits
    assert placed.where(F.col("at").between(F.col("pid") * splits, F.col("pid") * splits + splits - 1)).count() == dims.cells


def test_keyed_placement_keeps_every_key_whole_at_any_size(spark):
    # half of the rows have one key; no row count changes what the operator promises
    rows = spark.range(50_000).select((F.col("id") % 3 * F.when(F.col("id") < 25_000, 0).otherwise(1)).alias("k"), "id")
    whole = place.keyed(rows, ["k"], 3).withColumn("at", F.spark_partition_id())
    assert whole.groupBy("k").agg(F.countDistinct("at").alias("n")).where("n > 1").count() == 0


def test_keyed_split_spreads_a_key_over_its_splits(spark):
    rows = spark.range(3000).select(F.lit(1).alias("k"), "id")
    cut = place.keyed_split(rows, ["k"], 64, 8, ["id"]).withColumn("at", F.spark_partition_id())
    assert 1 < cut.select("at").distinct().count() <= 8
    assert cut.columns == ["k", "id", "at"] and cut.select("id").distinct().count() == 3000


def test_slab_offsets_accumulate(spark):
    sizes = spark.createDataFrame([(0, 5), (1, 2), (2, 9)], "pid INT, size BIGINT")
    rows = place.running_offsets(sizes).orderBy("pid").collect()
    assert [(r.lo, r.hi) for r in rows] == [(0, 5), (5, 7), (7, 16)]


def test_positional_index_with_a_hot_leading_value(spark):
    # a third of the rows share the leading key: later columns must split them
    rnd = random.Random(3)
    rows = [(7 if rnd.random() < 0.34 else rnd.randrange(50), i) for i in rnd.sample(range(5000), 5000)]
    df = spark.createDataFrame(rows, "k INT, id INT").repartition(5)
    got = {r.id: r["index"] for r in grid.positional_index(df, ["k", "id"]).collect()}
    assert got == {i: n for n, (_, i) in enumerate(sorted(rows))}


@pytest.mark.parametrize("spread", [1, 1 << 40])
def test_rank_in_group(spark, spread):
    # dense ids, and ids as sparse as hashes
    rnd = random.Random(5)
    rows = [(0 if rnd.random() < 0.5 else rnd.randrange(4), i * spread) for i in range(1000)]
    df = spark.createDataFrame(rows, "g INT, id BIGINT")
    got = {r.id: r["rank"] for r in grid.rank_in_group(df.repartition(5), "g", "id", "rank").collect()}
    seen, want = {}, {}
    for g, i in rows:
        want[i] = seen.get(g, 0)
        seen[g] = want[i] + 1
    assert got == want


@pytest.mark.parametrize("block", [1, 3, 8, 1000])
@pytest.mark.parametrize("present", [[], [0], [24], [3, 4, 5, 9, 17], list(range(25))])
def test_densify(spark, block, present):
    df = spark.createDataFrame([(i, i * 10) for i in present], "index BIGINT, value INT")
    rows = grid.densify(df, 25, {"value": F.lit(-1)}, block_cells=block).collect()
    assert sorted((r["index"], r.value) for r in rows) == [(i, i * 10 if i in present else -1) for i in range(25)]


def test_ghost_mask_partitions_the_present_cells(spark):
    dims = GridDims(3, 2, 5)
    present = [0, 1, 7, 12, 13, 29]
    df = spark.createDataFrame([(i, 1) for i in present], "index BIGINT, value INT")
    masks = grid.ghost_mask(df, dims, Slabs(5, 3, "threshold"))
    assert masks.count() == 3 * dims.cells
    owned = masks.where("mask = 1").collect()
    assert sorted(r["index"] for r in owned) == present
    assert {r.mask for r in masks.collect()} == {1, 32}


def test_densify_leaves_out_rows_outside_the_grid(spark):
    df = spark.createDataFrame([(3, 30), (15, 150), (18, 180), (-2, 20), (None, 1)], "index BIGINT, value INT")
    for block in (4, 1000):
        rows = grid.densify(df, 10, {"value": F.lit(-1)}, block_cells=block).collect()
        assert sorted((r["index"], r.value) for r in rows) == [(i, 30 if i == 3 else -1) for i in range(10)]
    inside, outside = grid.split_grid(df, 10)
    assert inside.count() == 1 and outside.count() == 4


def test_mask_runs_are_the_stored_form(spark):
    dims = GridDims(3, 2, 5)
    df = spark.createDataFrame([(i, 1) for i in [0, 1, 2, 7, 12, 13, 29, 99]], "index BIGINT, value INT")
    runs = grid.mask_runs(df, dims, Slabs(5, 3, "threshold"), block_cells=8)
    assert sorted(tuple(r) for r in runs.collect()) == [(0, 0, 3, 1), (1, 7, 1, 1), (1, 12, 2, 1), (2, 29, 1, 1)]
    masks = grid.expand_mask(runs, dims, 3, block_cells=8)
    assert masks.count() == 3 * dims.cells and masks.where("mask = 1").count() == 7


def test_zip_needs_equal_positions(spark):
    left = spark.range(4).select(F.col("id").alias("index"), (F.col("id") * 2).alias("a"))
    right = spark.range(4).select(F.col("id").alias("index"), (F.col("id") * 3).alias("b"))
    assert sorted(tuple(r) for r in grid.zip_positional(left, right).collect()) == [(i, 2 * i, 3 * i) for i in range(4)]
    for short in (right.where("index < 3"), right.where("index > 0")):
        with pytest.raises(Exception, match="different positions"):
            grid.zip_positional(left, short).collect()


def test_a_huge_index_has_coordinates(spark):
    dims = GridDims(740, 740, 548_000)
    row = grid.to_ijk(spark.createDataFrame([(300_000_000_000,)], "index BIGINT"), dims).first()
    assert row.x + row.y * 740 + row.z * 740 * 740 == 300_000_000_000
