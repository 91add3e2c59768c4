"""Stream sources, sinks and statistics (S14-S16, ST1-ST5). Each query runs its stream to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.index import idiv
from gridloom.operators import raster
from gridloom.plans import sqltext as Q
from gridloom.plans.expressions import EVT_HI
from gridloom.plans.registry import query
from gridloom.plans.scans import NX
from gridloom.session import scratch_path
from gridloom.sources import archive
from gridloom.sources import fixtures as fx
from gridloom.streaming import stats

WINDOW = "1 day"
LATENESS = "1 hour"  # the replay is written in event order; rows behind the watermark fail the query


def _feed(spark, sf):
    path = stats.replay(fx.stream_lines(spark, sf), scratch_path(spark, "feed"), ["ts"])
    return stats.open_lines(spark, path)


def _dirs(spark, label):
    return scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")


@query("stream_source", f"WITH {Q.EVT} SELECT f, value FROM lines")
def stream_source(spark, sf):
    out, checkpoint = _dirs(spark, "source")
    stats.append_sink(_feed(spark, sf), out, checkpoint).awaitTermination()
    return spark.read.schema("value STRING, f INT").parquet(out)


@query(
    "stream_replay",
    f"WITH {Q.CELLS} SELECT year, count(*) AS n, round(sum(value), 4) AS total FROM cells GROUP BY year",
)
def stream_replay(spark, sf):
    # the archive itself is the source: band after band, in batches of a bounded size
    cells = raster.bands_long(archive.stream(spark, fx.archived_bands(spark, sf)), NX)
    out, checkpoint = _dirs(spark, "replay")
    stats.drain(stats.append_sink(cells.select("year", "band", "cell", "value"), out, checkpoint, available_now=False))
    stored = spark.read.schema("year INT, band INT, cell INT, value DOUBLE").parquet(out)
    return stored.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


PER_FILE = f"""WITH {Q.EVT} SELECT f, round(sum(number), 4) AS s, count(*) AS n FROM parsed WHERE number < {EVT_HI} GROUP BY f"""


@query("stream_sink", f"WITH {Q.EVT} SELECT f, value, number FROM parsed WHERE number < {EVT_HI}")
def stream_sink(spark, sf):
    # the valid numbers themselves, exactly once, in a Parquet table
    out, checkpoint = _dirs(spark, "sink")
    numbers = stats.valid(stats.parse(_feed(spark, sf)), EVT_HI)
    stats.append_sink(numbers, out, checkpoint).awaitTermination()
    return spark.read.schema("value STRING, f INT, number DOUBLE").parquet(out).select("f", "value", "number")


@query("stream_batch_stats", f"""{PER_FILE.replace("SELECT f, ", "SELECT CAST(f // 4 AS BIGINT) AS batch_id, f, ")}""")
def stream_batch_stats(spark, sf):
    # the feed arrives in three parts, and a batch reports each
    lines = fx.stream_lines(spark, sf)
    path = scratch_path(spark, "feed")
    out, checkpoint = _dirs(spark, "batch")
    for part in range(-(-fx.STREAM_FILES // 4)):
        stats.replay(lines.where(idiv(F.col("f"), 4) == part), path, ["ts"])
        stats.batch_stats(stats.open_lines(spark, path), EVT_HI, out, checkpoint).awaitTermination()
    return stats.batch_table(spark, out).withColumn("s", F.round("s", 4))


@query(
    "stream_running_stats",
    f"WITH {Q.EVT} SELECT round(sum(number), 4) AS s, count(*) AS n FROM parsed WHERE number < {EVT_HI}",
)
def stream_running_stats(spark, sf):
    out, checkpoint = _dirs(spark, "running")
    stats.running_stats(_feed(spark, sf), EVT_HI, out, checkpoint).awaitTermination()
    return stats.latest_total(spark, out).withColumn("s", F.round("s", 4))


@query(
    "stream_tumbling_stats",
    f"""WITH {Q.EVT} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, round(sum(number), 4) AS s, count(*) AS n
FROM parsed WHERE number < {EVT_HI} GROUP BY 1""",
)
def stream_tumbling_stats(spark, sf):
    path = stats.replay_events(fx.stream_lines(spark, sf), scratch_path(spark, "events"))
    out, checkpoint = _dirs(spark, "windows")
    events = stats.open_events(spark, path)
    stats.finish(stats.tumbling_stats(events, WINDOW, LATENESS, EVT_HI, out, checkpoint))
    return stats.latest_windows(spark, out).select(
        F.date_format("start", "yyyy-MM-dd").alias("day"), F.round("s", 4).alias("s"), "n"
    )


@query("stream_rejects", f"WITH {Q.EVT} SELECT f, value FROM parsed WHERE number IS NULL")
def stream_rejects(spark, sf):
    out, checkpoint = _dirs(spark, "rejects")
    bad = stats.rejects(stats.parse(_feed(spark, sf))).select("value", "f")
    stats.append_sink(bad, out, checkpoint).awaitTermination()
    return spark.read.schema("value STRING, f INT").parquet(out)


@query(
    "stream_late_rows",
    f"""WITH {Q.EVT}, mark AS (SELECT max(ts) - INTERVAL 1 HOUR AS closed FROM lines WHERE f <> 0)
SELECT f = 0 AND date_trunc('day', ts) + INTERVAL 1 DAY <= closed AS late, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day,
       round(sum(number), 4) AS s, count(*) AS n
FROM parsed, mark WHERE number < {EVT_HI} GROUP BY 1, 2""",
)
def stream_late_rows(spark, sf):
    # the first file comes after all others, as one batch: rows of closed windows are set aside
    lines = fx.stream_lines(spark, sf)
    path = scratch_path(spark, "disorder")
    out, checkpoint = _dirs(spark, "late")
    for part in (F.col("f") != 0, F.col("f") == 0):
        stats.replay_events(lines.where(part), path)
        events = stats.open_events(spark, path, batch_bytes=1 << 60)
        stats.tumbling_with_late(events, WINDOW, LATENESS, EVT_HI, out, checkpoint).awaitTermination()
    day = F.date_format("start", "yyyy-MM-dd").alias("day")
    windows = stats.windows_on_time(spark, out).select(F.lit(False).alias("late"), day, F.round("s", 4).alias("s"), "n")
    late = stats.late_rows(spark, out).groupBy(F.lit(True).alias("late"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return windows.unionByName(late.agg(F.round(F.sum("number"), 4).alias("s"), F.count(F.lit(1)).alias("n")))


@query("stream_lifecycle", f"WITH {Q.EVT} SELECT f, count(*) AS n FROM lines GROUP BY f")
def stream_lifecycle(spark, sf):
    # two halves with state between them. The batch of the second fails before its commit; the restart repeats it from the
    # checkpoint and the state store, and the ledger shows each offset committed once
    lines = fx.stream_lines(spark, sf)
    path = scratch_path(spark, "halves")
    out, checkpoint = _dirs(spark, "lifecycle")
    faults = iter(["first try of the second batch"])

    def drill(batch_id):
        if batch_id == 1 and (fault := next(faults, None)):
            raise RuntimeError(fault)

    ledger = stats.CommitLedger()
    spark.streams.addListener(ledger)
    try:
        for half in (F.col("f") < 5, F.col("f") >= 5):
            stats.replay(lines.where(half), path, ["ts"])
            feed = stats.open_lines(spark, path)
            stats.with_restarts(lambda: stats.line_counts(feed, out, checkpoint, after_write=drill), ledger)
    finally:
        spark.streams.removeListener(ledger)
    ledger.check()
    return stats.latest_counts(spark, out)
