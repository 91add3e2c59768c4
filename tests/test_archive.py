"""Band archives, published sets and interval owners: what is read, what failures leave, and brute force."""

import bisect
import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import intervals
from gridloom.session import qualified, scratch_path
from gridloom.sources import archive, published

# --- band archives ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stored(spark):
    """3 years of 40 bands of 50 pixels, year 2007 ten bands longer."""
    path = scratch_path(spark, "archive")
    bands = spark.range(130).select(
        F.when(F.col("id") < 80, 2006 + F.floor(F.col("id") / 40)).otherwise(F.when(F.col("id") < 90, 2007).otherwise(2008)).cast("int").alias("year"),
        F.when(F.col("id") < 80, F.col("id") % 40).otherwise(F.when(F.col("id") < 90, F.col("id") - 40).otherwise(F.col("id") - 90)).cast("int").alias("band"),
        F.transform(F.sequence(F.lit(1), F.lit(50)), lambda k: (F.col("id") + k / 100).cast("float")).alias("pixels"),
    )
    archive.save(bands, path)
    return path, {(r.year, r.band): r.pixels for r in bands.collect()}


def read_bytes(df):
    return df.agg(F.sum("nbytes")).first()[0] or 0


def test_archive_gives_back_every_band(spark, stored):
    path, want = stored
    rows = archive.read(spark, path).collect()
    assert {(r.year, r.band): r.pixels for r in rows} == want and len(rows) == 130
    assert all(r.nbytes == 200 for r in rows)


def test_filters_reach_the_index(spark, stored):
    path, want = stored
    for condition, number in (("year = 2007", 50), ("year = 2007 and band >= 40", 10), ("band in (0, 7, 99)", 6), ("year > 2007 and band < 3", 3), ("band = 200", 0), ("band <= 1 and year <> 2006", 4)):
        df = archive.read(spark, path).where(condition)
        assert {(r.year, r.band): r.pixels for r in df.collect()} == {r["key"]: want[r["key"]] for r in keys(spark, want, condition)}
        assert df.count() == number
    # The reader itself, without the filter that Spark puts on top: it hands out the listed bands only.
    reader = archive.ArchiveReader(published_uri(spark, path), None, None)
    left = list(reader.pushFilters([archive.EqualTo(("year",), 2007), archive.LessThan(("band",), 5), archive.In(("nbytes",), (200,))]))
    assert [type(f).__name__ for f in left] == ["In"]
    assert sum(len(p.rows) for p in reader.partitions()) == 5


def published_uri(spark, path):
    return qualified(spark, path)


def keys(spark, want, condition):
    df = spark.createDataFrame([(y, b) for y, b in want], "year INT, band INT").where(condition)
    return [{"key": (r.year, r.band)} for r in df.collect()]


def test_bytes_read_follow_the_work_list(spark, stored):
    path, want = stored
    whole = read_bytes(archive.read(spark, path))
    assert whole == 130 * 200
    for listed in ([(2006, 3)], [(2006, 3), (2006, 4), (2008, 39), (1999, 0)], list(want)):
        work = spark.createDataFrame([*listed, listed[0], (None, 1)], "year INT, band INT")
        for limit in (1 << 20, 0):  # the list travels with the scan, or is joined behind the extent of the list
            df = archive.read_listed(spark, path, work, limit)
            assert {(r.year, r.band) for r in df.collect()} == set(listed) & set(want)
        reader = archive.ArchiveReader(published_uri(spark, path), None, archive.json.dumps(listed))
        asked = sum(r[3] for p in reader.partitions() for r in p.rows)
        assert asked == 200 * len(set(listed) & set(want))
    empty = spark.createDataFrame([], "year INT, band INT")
    assert archive.read_listed(spark, path, empty).count() == 0


def test_archive_edge_cases(spark):
    path = scratch_path(spark, "odd")
    schema = "year INT, band INT, pixels ARRAY<FLOAT>, extra STRING"
    archive.save(spark.createDataFrame([], schema), path)
    assert archive.read(spark, path).count() == 0
    archive.save(spark.createDataFrame([(1, 0, [], "x"), (1, 1, [1.5, None], "y")], schema), path, replace=False)
    got = {r.band: r.pixels for r in archive.read(spark, path).collect()}
    assert got[0] == [] and got[1][0] == 1.5 and got[1][1] != got[1][1]
    with pytest.raises(Exception, match="a band needs a year"):
        archive.save(spark.createDataFrame([(None, 0, [1.0], "x")], schema), path)
    assert archive.read(spark, path).count() == 2
    with pytest.raises(Exception, match="nothing is published"):
        archive.read(spark, scratch_path(spark, "none")).count()


# --- published sets --------------------------------------------------------------------------------------


def test_a_set_appears_whole_and_old_versions_stay(spark):
    path = scratch_path(spark, "set")
    published.publish(spark.range(100).repartition(4), path)
    assert published.read(spark, path).count() == 100
    published.publish(spark.range(1000, 1010), path)
    published.publish(spark.range(2000, 2005), path, replace=False)
    assert sorted(r.id for r in published.read(spark, path).collect()) == [*range(1000, 1010), *range(2000, 2005)]
    assert published.read(spark, path, version=1).count() == 100
    published.publish(spark.range(0), path)
    assert published.read(spark, path).count() == 0 and published.read(spark, path).columns == ["id"]


def test_a_failed_write_leaves_the_old_version(spark):
    path = scratch_path(spark, "broken")
    published.publish(spark.range(50), path)
    folder = path.removeprefix("file://")
    before = set(os.listdir(folder))

    # One task fails after others have written their files.
    torn = spark.range(0, 4000, 1, 8).select(F.when(F.col("id") == 3999, F.raise_error(F.lit("torn")).cast("bigint")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="torn"):
        published.publish(torn, path)
    assert published.read(spark, path).count() == 50
    assert set(os.listdir(folder)) == before  # abort took the files of the tasks that had ended


def test_files_of_no_manifest_are_not_read(spark):
    path = scratch_path(spark, "orphans")
    published.publish(spark.range(50), path)
    found = published.manifest(published_uri(spark, path))["files"]
    folder = path.removeprefix("file://")
    with open(f"{folder}/{found[0]['name']}", "rb") as f:
        body = f.read()
    os.makedirs(f"{folder}/dead")
    for name in ("dead/part-x", os.path.dirname(found[0]["name"]) + "/part-of-a-lost-attempt"):
        with open(f"{folder}/{name}", "wb") as f:
            f.write(body)
    with open(f"{folder}/_versions/draft-y", "w") as f:
        f.write("{")
    assert published.read(spark, path).count() == 50


# --- interval owners -------------------------------------------------------------------------------------


def random_intervals(rnd, n, span):
    points = sorted(rnd.sample(range(-span, span), 2 * n))
    # Half of the intervals touch the next one.
    out = [(k, points[2 * k], points[2 * k + 1] if k % 2 or k == n - 1 else points[2 * k + 2]) for k in range(n)]
    rnd.shuffle(out)
    return out


@pytest.mark.parametrize("limits", [(1 << 20, 4096, 1 << 20), (0, 16, 500), (0, 1, 1 << 20)])
def test_owner_by_list_equals_a_between_join(spark, limits):
    rnd = random.Random(5)
    listed = random_intervals(rnd, 2000, 2**40)
    values = [rnd.randrange(-(2**40), 2**40) for _ in range(6000)] + [x for _, lo, hi in listed[:300] for x in (lo, lo - 1, hi, hi - 1)]
    values += [listed[0][1]] * 3000  # a value that many rows have
    order = sorted(listed, key=lambda i: i[1])
    starts = [i[1] for i in order]
    want = []
    for n, v in enumerate(values):
        k = bisect.bisect_right(starts, v) - 1
        if k >= 0 and v < order[k][2]:
            want.append((n, v, *order[k]))
    rows = spark.createDataFrame([*enumerate(values), (-1, None)], "n BIGINT, v BIGINT")
    table = spark.createDataFrame([*listed, (9999, 5, 5), (9999, None, 7), (9999, 7, None)], "pid BIGINT, lo BIGINT, hi BIGINT")
    got = intervals.owner_by_list(rows, "v", table, *limits)
    assert sorted((r.n, r.v, r.pid, r.lo, r.hi) for r in got.collect()) == sorted(want)


def test_owner_by_list_on_many_thresholds(spark):
    """10^5 random thresholds, by both ways, against bisection."""
    starts = spark.range(100_000).select((F.pmod(F.xxhash64("id"), F.lit(10**12))).alias("lo")).distinct()
    listed = starts.withColumn("hi", F.lead("lo").over(Window.orderBy("lo"))).where("hi is not null")
    listed = listed.withColumn("pid", F.col("lo") % 1000)
    rows = spark.range(20_000).select("id", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10**12)).alias("v"))
    facts = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("id", "v", "pid", "lo", "hi").cast("decimal(38,0)"))).first()
    small = facts(intervals.owner_by_list(rows, "v", listed))
    large = facts(intervals.owner_by_list(rows, "v", listed, 0, 256, 50))
    bounds = [(r.lo, r.hi, r.pid) for r in listed.orderBy("lo").collect()]
    lows = [b[0] for b in bounds]
    plain = []
    for r in rows.collect():
        k = bisect.bisect_right(lows, r.v) - 1
        if k >= 0 and r.v < bounds[k][1]:
            plain.append((r.id, r.v, bounds[k][2], bounds[k][0], bounds[k][1]))
    brute = facts(spark.createDataFrame(plain, "id BIGINT, v BIGINT, pid BIGINT, lo BIGINT, hi BIGINT"))
    assert small == large == brute and brute[0] > 19_000


@pytest.mark.parametrize("list_rows", [1 << 20, 0])
def test_owner_by_list_edge_cases(spark, list_rows):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "v INT")
    none = spark.createDataFrame([], "pid BIGINT, lo BIGINT, hi BIGINT")
    assert intervals.owner_by_list(rows, "v", none, list_rows).count() == 0
    one = spark.createDataFrame([(7, 2, 3)], "pid BIGINT, lo BIGINT, hi BIGINT")
    assert [tuple(r) for r in intervals.owner_by_list(rows, "v", one, list_rows).collect()] == [(2, 7, 2, 3)]
    assert intervals.owner_by_list(rows.where("v > 5"), "v", one, list_rows).count() == 0
    clash = spark.createDataFrame([(1, 0, 5), (2, 4, 9)], "pid BIGINT, lo BIGINT, hi BIGINT")
    for buckets in (1, 4096):
        with pytest.raises(Exception, match="intervals overlap"):
            intervals.owner_by_list(rows, "v", clash, list_rows, buckets).collect()
    with pytest.raises(ValueError, match="named pid"):
        intervals.owner_by_list(rows.withColumn("pid", F.lit(1)), "v", one, list_rows)
