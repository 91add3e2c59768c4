"""Number streams: replay, parse, per-batch, running and event-time statistics.

Sinks are idempotent: a batch writes into a folder named by its id and overwrites it when the
batch is run again after a failure, so restarts from the checkpoint do not count twice.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from gridloom.functions.scalars import VALID_UPPER, parse_number

LIVE_INTERVAL = "1 second"
#: Bytes of one micro-batch. A batch is as large as the cluster can take, whatever the number of files.
BATCH_BYTES = 16 << 30


# --- sources ----------------------------------------------------------------------------


def replay(lines: DataFrame, path: str, order_by: list[str]) -> str:
    """Write ``f, value`` lines as text files in one folder per ``f``.

    A range split on ``f`` and the order columns spreads a large ``f`` over several files.
    """
    ordered = lines.repartitionByRange("f", *order_by).sortWithinPartitions("f", *order_by)
    ordered.select("f", "value").write.partitionBy("f").mode("append").text(path)
    return path


def replay_events(lines: DataFrame, path: str) -> str:
    """The event-time form keeps ``ts`` next to the line, so it is written as Parquet.

    Folders are written one after the other: a file stream takes files by age, so event time moves on with them as
    long as ``f`` follows it.
    """
    for f in sorted(r["f"] for r in lines.select("f").distinct().toLocalIterator()):
        part = lines.where(F.col("f") == f)
        part.repartitionByRange("ts").sortWithinPartitions("ts").write.partitionBy("f").mode("append").parquet(path)
    return path


def open_lines(spark: SparkSession, path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """File stream of text lines: ``value, f``."""
    return spark.readStream.schema("value STRING, f INT").option("maxBytesPerTrigger", batch_bytes).text(path)


def open_socket(spark: SparkSession, host: str, port: int) -> DataFrame:
    """The same rows from a line socket. It cannot be replayed after a failure: for live viewing only."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return lines.withColumn("f", F.lit(0))


def open_events(spark: SparkSession, path: str, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    schema = "ts TIMESTAMP, value STRING, f INT"
    return spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(path)


# --- transformations (the same for static and streaming frames) ---------------------------


def parse(lines: DataFrame) -> DataFrame:
    """Keep the line, add ``number`` (null where it is not a number)."""
    return lines.withColumn("number", parse_number(F.col("value")))


def valid(parsed: DataFrame, hi: float = VALID_UPPER) -> DataFrame:
    return parsed.where(F.col("number") < hi)


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("number").isNull())


def sum_count(df: DataFrame, *keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("number").alias("s"), F.count(F.lit(1)).alias("n"))


# --- sinks ------------------------------------------------------------------------------


def _start(writer, available_now: bool) -> StreamingQuery:
    trigger = {"availableNow": True} if available_now else {"processingTime": LIVE_INTERVAL}
    return writer.trigger(**trigger).start()


def _prepare(spark: SparkSession, out: str, schema: StructType | str) -> None:
    """Create the result table with its schema, so that a feed without data reads as empty."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{out}/batch_id=-1")


def append_sink(df: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Rows as they come, exactly once, into a Parquet folder."""
    writer = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return _start(writer.outputMode("append"), available_now)


def batch_stats(
    lines: DataFrame, hi: float, out: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Per micro-batch ``(sum, count)`` of the valid numbers, per source folder. A batch without any writes no row."""

    _prepare(lines.sparkSession, out, "f INT, s DOUBLE, n BIGINT")

    def sink(batch: DataFrame, batch_id: int) -> None:
        stats = sum_count(valid(parse(batch), hi), "f")
        stats.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = lines.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return _start(writer, available_now)


def _table_per_batch(
    df: DataFrame, mode: str, out: str, checkpoint: str, available_now: bool, after_write: Callable[[int], None] | None = None
) -> StreamingQuery:
    _prepare(df.sparkSession, out, df.schema)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        if after_write is not None:
            after_write(batch_id)

    writer = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint)
    return _start(writer, available_now)


def running_stats(
    lines: DataFrame, hi: float, out: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Total over the whole stream so far; the state is one row per task."""
    total = sum_count(valid(parse(lines), hi))
    return _table_per_batch(total, "complete", out, checkpoint, available_now)


def tumbling_stats(
    events: DataFrame, width: str, lateness: str, hi: float, out: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """``(sum, count)`` per event-time window; windows are dropped from state after ``lateness``."""
    windows = valid(parse(events.withWatermark("ts", lateness)), hi)
    stats = sum_count(windows, F.window("ts", width)).select(F.col("window.start").alias("start"), "s", "n")
    return _table_per_batch(stats, "update", out, checkpoint, available_now)


def line_counts(
    lines: DataFrame, out: str, checkpoint: str, available_now: bool = True, after_write: Callable[[int], None] | None = None
) -> StreamingQuery:
    """Lines per source folder over the whole stream so far, kept in the state store.

    ``after_write(batch_id)`` is called when the result of a batch is written and before Spark commits the batch.
    """
    counts = lines.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    return _table_per_batch(counts, "complete", out, checkpoint, available_now, after_write)


def tumbling_with_late(
    events: DataFrame, width: str, lateness: str, hi: float, out: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """``(sum, count)`` per event-time window, and the rows that came too late in a table of their own.

    The watermark is the newest time of all earlier batches less ``lateness``. A valid row is late if its window had
    ended by then, or if it has no time. Per batch, partial sums go to ``windows``, late rows to ``late`` and the newest time
    to ``marks``, each overwritten when a batch is repeated, which then decides as before: it reads the mark of the batch before it.
    """
    spark = events.sparkSession
    _prepare(spark, f"{out}/windows", "start TIMESTAMP, s DOUBLE, n BIGINT")
    _prepare(spark, f"{out}/late", "ts TIMESTAMP, value STRING, f INT, number DOUBLE")

    def sink(batch: DataFrame, batch_id: int) -> None:
        def put(df: DataFrame, part: str) -> None:
            df.write.mode("overwrite").parquet(f"{out}/{part}/batch_id={batch_id}")

        def mark_before() -> int | None:
            if batch_id == 0:
                return None
            return spark.read.schema("newest BIGINT").parquet(f"{out}/marks/batch_id={batch_id - 1}").first()[0]

        before = mark_before()
        batch.persist()
        try:
            rows = valid(parse(batch), hi).select("ts", "value", "f", "number")
            placed = rows.select("*", F.window("ts", width).alias("w"))  # leaves out rows without a time
            limit = F.timestamp_micros(F.lit(before).cast("bigint")) - F.expr(f"INTERVAL '{lateness}'")
            late = F.coalesce(F.col("w.end") <= limit, F.lit(False))
            put(sum_count(placed.where(~late), F.col("w.start").alias("start")), "windows")
            put(placed.where(late).drop("w").unionByName(rows.where("ts is null")), "late")
            newest = batch.agg(F.unix_micros(F.max("ts"))).first()[0]
            known = [x for x in (before, newest) if x is not None]
            put(spark.createDataFrame([(max(known, default=None),)], "newest BIGINT"), "marks")
        finally:
            batch.unpersist()

    return _start(events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint), available_now)


# --- running ------------------------------------------------------------------------------


class CommitLedger(StreamingQueryListener):
    """What queries have committed, in order: ``(query id, batch id, start offsets, end offsets, rows)``.

    Spark reports a batch after its commit, so a batch that failed is in no row. A query keeps its id over restarts.
    """

    def __init__(self):
        self.rows: list[tuple[str, int, tuple, tuple, int]] = []
        self._ended: dict[str, threading.Event] = {}

    def _end(self, run_id) -> threading.Event:
        return self._ended.setdefault(str(run_id), threading.Event())

    def onQueryStarted(self, event) -> None:
        self._end(event.runId)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        starts, ends = tuple(s.startOffset for s in p.sources), tuple(s.endOffset for s in p.sources)
        if starts != ends:  # a trigger without data commits nothing
            self.rows.append((str(p.id), p.batchId, starts, ends, p.numInputRows))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._end(event.runId).set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until all reports of an ended run are in."""
        if not self._end(query.runId).wait(seconds):
            raise TimeoutError(f"no end of run {query.runId} was reported")

    def check(self) -> None:
        """Fail unless each query's batches follow one another: no offset left out, none committed twice."""
        last: dict[str, tuple[int, tuple]] = {}
        for query_id, batch_id, starts, ends, _ in self.rows:
            if query_id in last and (batch_id, starts) != (last[query_id][0] + 1, last[query_id][1]):
                raise RuntimeError(f"batch {batch_id} starts at {starts}, the one before ended at {last[query_id]}")
            last[query_id] = batch_id, ends


def with_restarts(start: Callable[[], StreamingQuery], ledger: CommitLedger | None = None, restarts: int = 3) -> int:
    """Run a bounded stream to its end; after a failure start it again from its checkpoint. The number of restarts."""
    for attempt in range(restarts + 1):
        query = start()
        try:
            query.awaitTermination()
            return attempt
        except StreamingQueryException:
            if attempt == restarts:
                raise
        finally:
            if ledger is not None:
                ledger.wait(query)
    raise ValueError("restarts is negative")


def drain(query: StreamingQuery) -> None:
    """Let a live stream take everything that its source has now, batch after batch, and stop it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def finish(query: StreamingQuery) -> None:
    """Wait for a bounded stream and fail if rows came later than its lateness allows: Spark drops those.

    Counted over the progress reports that the session keeps (``spark.sql.streaming.numRecentProgressUpdates``).
    """
    query.awaitTermination()
    late = sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    if late:
        raise RuntimeError(f"{late} rows lie behind the watermark: allow more lateness or replay in event order")


# --- reading results ----------------------------------------------------------------------


def batch_table(spark: SparkSession, out: str) -> DataFrame:
    """What each micro-batch reported: ``batch_id, f, s, n``."""
    stored = spark.read.schema("f INT, s DOUBLE, n BIGINT, batch_id BIGINT").parquet(out)
    return stored.where("batch_id >= 0").select("batch_id", "f", "s", "n")


def batch_totals(spark: SparkSession, out: str) -> DataFrame:
    """Per source folder, the sum of what its batches reported."""
    stored = spark.read.schema("f INT, s DOUBLE, n BIGINT, batch_id BIGINT").parquet(out)
    return stored.groupBy("f").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def latest_total(spark: SparkSession, out: str) -> DataFrame:
    stored = spark.read.schema("s DOUBLE, n BIGINT, batch_id BIGINT").parquet(out)
    last = F.max_by(F.struct("s", "n"), "batch_id").alias("t")
    return stored.agg(last).select("t.s", "t.n")


def latest_windows(spark: SparkSession, out: str) -> DataFrame:
    """Last reported value of each window."""
    stored = spark.read.schema("start TIMESTAMP, s DOUBLE, n BIGINT, batch_id BIGINT").parquet(out)
    last = F.max_by(F.struct("s", "n"), "batch_id").alias("t")
    return stored.groupBy("start").agg(last).select("start", "t.s", "t.n")


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    stored = spark.read.schema("f INT, n BIGINT, batch_id BIGINT").parquet(out)
    return stored.groupBy("f").agg(F.max_by("n", "batch_id").alias("n"))


def windows_on_time(spark: SparkSession, out: str) -> DataFrame:
    """``start, s, n`` of ``tumbling_with_late``, over all batches."""
    stored = spark.read.schema("start TIMESTAMP, s DOUBLE, n BIGINT, batch_id BIGINT").parquet(f"{out}/windows")
    return stored.groupBy("start").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("ts TIMESTAMP, value STRING, f INT, number DOUBLE, batch_id BIGINT").parquet(f"{out}/late")
