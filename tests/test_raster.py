"""Masks, means and stacking of rasters."""

import random

import pytest
from pyspark.sql import functions as F

from gridloom.functions.scalars import kelvin_to_f, parse_number, truncate_int, year_from_name
from gridloom.operators import raster
from gridloom.plans import REGISTRY


def bands(spark, rows):
    return spark.createDataFrame(rows, "year INT, band INT, pixels ARRAY<FLOAT>")


def test_a_cell_masked_on_one_day_is_masked_for_the_year(spark):
    df = bands(spark, [(2006, 0, [1.0, 2.0]), (2006, 1, [3.0, 99.0]), (2007, 0, [-5.0, 4.0])])
    cells = raster.with_mask(raster.bands_long(df, 2), 0.0, 50.0)
    got = {(r.year, r.cell): (r.total, r.n_bands) for r in raster.cell_sum(cells).collect()}
    assert got == {(2006, 0): (4.0, 2), (2006, 1): (None, 2), (2007, 0): (None, 1), (2007, 1): (4.0, 1)}


def test_mask_bounds_are_inclusive(spark):
    df = bands(spark, [(2006, 0, [0.0, 50.0, -0.5, 50.5])])
    cells = raster.with_mask(raster.bands_long(df, 4), 0.0, 50.0).orderBy("cell").collect()
    assert [r.value for r in cells] == [0.0, 50.0, None, None]


def test_leap_year_means_differ(spark):
    df = bands(spark, [(2008, b, [1.0]) for b in range(366)] + [(2009, b, [1.0]) for b in range(365)])
    every = {r.year: r.value for r in raster.cell_mean(raster.bands_long(df, 1)).collect()}
    capped = raster.bands_long(df.where("band < 365"), 1)
    fixed = {r.year: r.value for r in raster.cell_mean(capped, divisor=365).collect()}
    uncut = {r.year: r.value for r in raster.cell_mean(raster.bands_long(df, 1), divisor=365).collect()}
    assert every == fixed == {2008: 1.0, 2009: 1.0}
    assert uncut[2008] == pytest.approx(366 / 365)


@pytest.mark.parametrize("state_bytes", [1, 1 << 20])
def test_band_sums_equal_cell_sums(spark, state_bytes):
    rnd = random.Random(2)
    rows = []
    for b in range(60):
        size = 5 if b % 7 else 3  # a short band now and then
        pixels = [None if rnd.random() < 0.05 else rnd.uniform(-1, 10) for _ in range(size)]
        rows.append((2006 + rnd.choice([0, 0, 1]), b, pixels))
    rows += [(2008, 0, []), (2006, 99, None)]
    df = bands(spark, rows).repartition(3)
    long = raster.cell_sum(raster.with_mask(raster.bands_long(df, 5), 0.0, 9.5))
    want = {(r.year, r.cell): (r.total, r.n_bands) for r in long.collect()}
    got = {(r.year, r.cell): (r.total, r.n_bands) for r in raster.band_sums(df, 0.0, 9.5, state_bytes).collect()}
    assert got.keys() == want.keys()
    for key, (total, n) in want.items():
        assert got[key][1] == n
        assert got[key][0] == (None if total is None else pytest.approx(total))


def test_all_masked_year_has_stats(spark):
    df = bands(spark, [(2006, 0, [99.0, 98.0])])
    stats = raster.raster_stats(raster.cell_mean(raster.with_mask(raster.bands_long(df, 2), 0, 50))).first()
    assert (stats.total, stats.n_valid, stats.mean_cell) == (None, 0, None)


def test_float_pixels_are_summed_in_double(spark):
    # 2^24 + 1 + 1 is lost in float32
    df = bands(spark, [(2006, b, [v]) for b, v in enumerate([16777216.0, 1.0, 1.0])])
    assert raster.cell_sum(raster.bands_long(df, 1)).first().total == 16777218.0


def test_mean_forms_agree(spark, sf_dir):
    a = REGISTRY["mean_by_key"].run(spark, sf_dir).orderBy("year").collect()
    b = REGISTRY["mean_per_file"].run(spark, sf_dir).orderBy("year").collect()
    assert a == b


def test_inline_mean_keeps_keys_without_valid_values(spark):
    df = spark.createDataFrame([(1, 10.0), (2, 99.0)], "year INT, value DOUBLE")
    assert [r.year for r in raster.mean_by(df, ["year"], 50).collect()] == [1]
    inline = {r.year: (r.n, r.mean) for r in raster.mean_by_inline(df, ["year"], 50).collect()}
    assert inline == {1: (1, 10.0), 2: (0, None)}


def test_chunks_of_an_exact_multiple_have_no_empty_tail(spark):
    df = bands(spark, [(2006, 0, [float(i) for i in range(6)]), (2006, 1, [float(i) for i in range(7)])])
    sizes = {(r.band, r.key): len(r.pixels) for r in raster.chunks(df, 3).collect()}
    assert sizes == {(0, "2006-0"): 3, (0, "2006-1"): 3, (1, "2006-0"): 3, (1, "2006-1"): 3, (1, "2006-2"): 1}
    found = raster.chunk_lookup(df, 3, "2006-2").collect()
    assert [(r.band, r.n, r["head"]) for r in found] == [(1, 1, [6.0])]


def test_frames_flip_and_truncate(spark):
    df = bands(spark, [(2006, 0, [1.9, -1.9, 3.5, 4.0, 5.0, 6.99])])
    assert raster.frames(df, 2).first().daily_max == [5, 6, 3, 4, 1, -1]


def test_stack_flips_rows_and_numbers_years(spark):
    image = spark.createDataFrame([(y, c, float(y * 10 + c)) for y in (3, 1) for c in range(4)], "year INT, cell INT, value DOUBLE")
    rows = raster.stack(image, raster.years_of(image), 2, nx=2, ny=2).orderBy("index").collect()
    assert [r.value for r in rows] == [12.0, 13.0, 10.0, 11.0, 32.0, 33.0, 30.0, 31.0]
    assert [r.z for r in rows] == [0] * 4 + [1] * 4


def test_pack_cuts_large_images(spark):
    image = spark.createDataFrame([(1, c, float(c)) for c in range(5)], "year INT, cell INT, value DOUBLE")
    rows = raster.pack(image, tile=2).orderBy("tile").collect()
    assert [r["values"] for r in rows] == [[0.0, 1.0], [2.0, 3.0], [4.0]]


def test_worklist_reads_only_listed_bands(spark):
    df = bands(spark, [(y, b, [1.0]) for y in (2006, 2007) for b in range(5)])
    files = spark.createDataFrame([(2007,)], "year INT")
    got = df.join(raster.worklist(files, 3), ["year", "band"]).select("year", "band").collect()
    assert sorted(map(tuple, got)) == [(2007, 0), (2007, 1), (2007, 2)]


@pytest.mark.parametrize("line, number", [("2d", None), ("1e3", 1000.0), ("-.5", -0.5), ("+7.", 7.0), ("", None), ("1_0", None), ("0x1", None)])
def test_parse_number_is_strict(spark, line, number):
    df = spark.createDataFrame([(line,)], "line STRING")
    assert df.select(parse_number(F.col("line"))).first()[0] == number


def test_empty_sequences(spark):
    files = spark.createDataFrame([(2007,)], "year INT")
    assert raster.worklist(files, 0).count() == 0
    empty = bands(spark, [(2006, 0, [])])
    assert [r.daily_max for r in raster.frames(empty, 2).collect()] == [[]]


def test_scalar_rules(spark):
    df = spark.createDataFrame([("a_b_2011.tif", -2.7, " 4.5 "), ("x_1999.tif", 2.7, "1.5f")], "name STRING, v DOUBLE, line STRING")
    rows = df.select(
        year_from_name(F.col("name")).alias("y"), truncate_int(F.col("v")).alias("i"),
        parse_number(F.col("line")).alias("n"), kelvin_to_f(F.lit(273.15)).alias("f"),
    ).collect()
    assert [tuple(r) for r in rows] == [(2011, -2, 4.5, 32.0), (1999, 2, None, 32.0)]
