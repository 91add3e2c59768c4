"""Streams: empty batches, restarts, repeated batches, rejects."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from gridloom import session
from gridloom.session import scratch_path
from gridloom.sources import archive
from gridloom.streaming import stats


def lines(spark, rows):
    return spark.createDataFrame(rows, "f INT, value STRING")


def feed(spark, rows, path=None):
    path = path or scratch_path(spark, "t-feed")
    return stats.replay(lines(spark, rows), path, ["value"])


def test_batch_stats_skip_invalid_and_empty(spark):
    path = feed(spark, [(0, "1.5"), (0, "2"), (1, "bad"), (1, "900"), (2, "4")])
    out, ck = scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")
    stats.batch_stats(stats.open_lines(spark, path, 1), 100.0, out, ck).awaitTermination()
    assert sorted(map(tuple, stats.batch_totals(spark, out).collect())) == [(0, 3.5, 2), (2, 4.0, 1)]


def test_feed_without_files_gives_an_empty_result(spark, tmp_path):
    out, ck = scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")
    stats.batch_stats(stats.open_lines(spark, str(tmp_path)), 100.0, out, ck).awaitTermination()
    assert stats.batch_totals(spark, out).count() == 0


def test_restart_counts_every_line_once(spark):
    path = feed(spark, [(0, "1"), (1, "2")])
    out, ck = scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")
    for more in ([], [(2, "4"), (3, "8")], []):
        if more:
            feed(spark, more, path)
        stats.batch_stats(stats.open_lines(spark, path, 1), 100.0, out, ck).awaitTermination()
    assert stats.batch_totals(spark, out).agg(F.sum("s"), F.sum("n")).first() == (15.0, 4)


def test_running_total_is_the_batch_total(spark):
    path = feed(spark, [(i % 3, str(i)) for i in range(20)] + [(0, "x")])
    out, ck = scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")
    stats.running_stats(stats.open_lines(spark, path, 1), 15.0, out, ck).awaitTermination()
    assert tuple(stats.latest_total(spark, out).first()) == (float(sum(range(15))), 15)


def test_tumbling_windows(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i // 10, start + dt.timedelta(hours=i), str(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "f INT, ts TIMESTAMP, value STRING")
    path = stats.replay_events(df, scratch_path(spark, "t-ev"))
    out, ck = scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")
    stats.finish(stats.tumbling_stats(stats.open_events(spark, path, 1), "1 day", "1 hour", 1e9, out, ck))
    got = {r.start.day: (r.s, r.n) for r in stats.latest_windows(spark, out).collect()}
    assert got == {1: (float(sum(range(24))), 24), 2: (float(sum(range(24, 48))), 24), 3: (float(sum(range(48, 60))), 12)}


def test_rows_behind_the_watermark_fail_the_stream(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(days=d), "1") for i, d in enumerate((9, 20, 0))]  # the last one is weeks late
    df = spark.createDataFrame(rows, "f INT, ts TIMESTAMP, value STRING")
    path = stats.replay_events(df, scratch_path(spark, "t-ev"))
    out, ck = scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")
    with pytest.raises(RuntimeError, match="behind the watermark"):
        stats.finish(stats.tumbling_stats(stats.open_events(spark, path, 1), "1 day", "1 hour", 1e9, out, ck))


def test_each_batch_reports(spark):
    out, ck, path = (scratch_path(spark, x) for x in ("t-out", "t-ck", "t-feed"))
    for more in ([(0, "1"), (1, "2")], [(2, "4")]):
        feed(spark, more, path)
        stats.batch_stats(stats.open_lines(spark, path), 100.0, out, ck).awaitTermination()
    assert sorted(map(tuple, stats.batch_table(spark, out).collect())) == [(0, 0, 1.0, 1), (0, 1, 2.0, 1), (1, 2, 4.0, 1)]


def test_live_trigger_starts_and_stops(spark):
    path = feed(spark, [(0, "1")])
    out, ck = scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")
    running = stats.batch_stats(stats.open_lines(spark, path), 10.0, out, ck, available_now=False)
    assert running.isActive
    running.processAllAvailable()
    running.stop()
    assert stats.batch_totals(spark, out).count() == 1


def test_rejects_keep_the_line(spark):
    parsed = stats.parse(lines(spark, [(0, "1"), (0, "one"), (1, "")]))
    assert sorted(r.value for r in stats.rejects(parsed).collect()) == ["", "one"]


class _Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default=None):
        return self.value or default


class _Session:
    """Just the parts of a session that say where scratch tables go."""

    def __init__(self, master, shared):
        self.conf = _Conf(shared)
        self.sparkContext = self
        self.master, self.applicationId = master, f"app-{master}-{shared}"

    def getCheckpointDir(self):
        return None


def test_scratch_is_shared_on_a_cluster():
    assert session.scratch_root(_Session("yarn", "hdfs://nn/ck/")).startswith("hdfs://nn/ck/gridloom-")
    assert session.scratch_root(_Session("local[2]", "/mnt/ck")).startswith("/mnt/ck/gridloom-")
    with pytest.raises(ValueError):
        session.scratch_root(_Session("spark://host:7077", None))


def many_bands(spark, first, n):
    pixels = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: (F.col("id") * 10 + k).cast("float"))
    return spark.range(first, first + n).select((2000 + F.floor(F.col("id") / 50)).cast("int").alias("year"), (F.col("id") % 50).cast("int").alias("band"), pixels.alias("pixels"))


def test_archive_stream_goes_band_by_band_and_follows_new_versions(spark):
    path, out, ck = (scratch_path(spark, x) for x in ("t-arch", "t-out", "t-ck"))
    archive.save(many_bands(spark, 0, 100), path)
    seen = []

    def sink(batch, batch_id):
        seen.append((batch_id, sorted((r.year, r.band) for r in batch.select("year", "band").collect())))

    def run():
        writer = archive.stream(spark, path, batch_bytes=40 * 30).writeStream.foreachBatch(sink)
        return writer.option("checkpointLocation", ck).trigger(processingTime="0 seconds").start()

    stats.drain(run())
    want = sorted((2000 + i // 50, i % 50) for i in range(100))
    assert [len(b) for _, b in seen] == [30, 30, 30, 10] and [x for _, b in seen for x in b] == want  # 40 bytes a band
    archive.save(many_bands(spark, 100, 7), path, replace=False)
    stats.drain(run())  # a new run goes on from the checkpoint
    assert seen[4:] == [(4, [(2002, i) for i in range(7)])]
    stats.drain(run())
    assert len(seen) == 5


def test_archive_stream_repeats_a_failed_batch(spark):
    path, out, ck = (scratch_path(spark, x) for x in ("t-arch", "t-out", "t-ck"))
    archive.save(many_bands(spark, 0, 40), path)
    tried = []

    def sink(batch, batch_id):
        tried.append((batch_id, [r.band for r in batch.orderBy("band").collect()]))
        if len(tried) == 2:
            raise RuntimeError("first try of the second batch")

    def run():
        writer = archive.stream(spark, path, batch_bytes=1).writeStream.foreachBatch(sink)  # one band at least
        return writer.option("checkpointLocation", ck).trigger(processingTime="0 seconds").start()

    with pytest.raises(StreamingQueryException):
        stats.drain(run())
    stats.drain(run())
    assert tried == [(0, [0]), (1, [1])] + [(i, [i]) for i in range(1, 40)]


def test_archive_stream_without_bands_and_with_a_replacing_version(spark):
    path, ck = scratch_path(spark, "t-arch"), scratch_path(spark, "t-ck")
    archive.save(many_bands(spark, 0, 0), path)
    out = scratch_path(spark, "t-out")

    def take():
        stats.drain(stats.append_sink(archive.stream(spark, path).select("year", "band"), out, ck, available_now=False))
        return spark.read.schema("year INT, band INT").parquet(out).count()

    archive.save(many_bands(spark, 0, 5), path)
    assert take() == 5
    archive.save(many_bands(spark, 0, 3), path)  # its own files are new
    assert take() == 8


def test_late_rows_are_set_aside(spark):
    start = dt.datetime(2024, 1, 1)
    path, out, ck = (scratch_path(spark, x) for x in ("t-ev", "t-out", "t-ck"))
    parts = [[(0, start + dt.timedelta(hours=i), "1") for i in range(50)], [(1, start, "5"), (1, start + dt.timedelta(days=1), "7"), (1, start + dt.timedelta(days=2, hours=1), "9"), (1, None, "3"), (1, start, "x")]]
    for rows in parts:
        stats.replay_events(spark.createDataFrame(rows, "f INT, ts TIMESTAMP, value STRING"), path)
        stats.tumbling_with_late(stats.open_events(spark, path, 1 << 40), "1 day", "1 hour", 1e9, out, ck).awaitTermination()
    got = {r.start.day: (r.s, r.n) for r in stats.windows_on_time(spark, out).collect()}
    assert got == {1: (24.0, 24), 2: (24.0, 24), 3: (11.0, 3)}
    # the newest time was hour 49: at hour 48 both first days are closed
    assert sorted(r.number for r in stats.late_rows(spark, out).collect()) == [3.0, 5.0, 7.0]


def test_restart_after_a_failed_batch_keeps_state_and_commits_once(spark):
    path = feed(spark, [(0, "1"), (0, "2"), (1, "3")])
    out, ck = scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")
    calls = []

    def drill(batch_id):
        calls.append(batch_id)
        if calls == [0, 1]:
            raise RuntimeError("drill")

    ledger = stats.CommitLedger()
    spark.streams.addListener(ledger)
    try:
        run = lambda: stats.line_counts(stats.open_lines(spark, path), out, ck, after_write=drill)
        assert stats.with_restarts(run, ledger) == 0
        feed(spark, [(0, "5"), (2, "6")], path)
        assert stats.with_restarts(run, ledger) == 1
    finally:
        spark.streams.removeListener(ledger)
    assert calls == [0, 1, 1] and [r[1] for r in ledger.rows] == [0, 1]
    ledger.check()
    assert {r.f: r.n for r in stats.latest_counts(spark, out).collect()} == {0: 3, 1: 1, 2: 1}
    ledger.rows.append(ledger.rows[-1])
    with pytest.raises(RuntimeError, match="the one before ended"):
        ledger.check()


def test_a_stream_that_keeps_failing_fails(spark):
    path = feed(spark, [(0, "1")])
    out, ck = scratch_path(spark, "t-out"), scratch_path(spark, "t-ck")

    def drill(batch_id):
        raise RuntimeError("always")

    with pytest.raises(StreamingQueryException):
        stats.with_restarts(lambda: stats.line_counts(stats.open_lines(spark, path), out, ck, after_write=drill), restarts=1)
