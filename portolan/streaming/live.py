"""Streaming forms of the event operators.

Aggregates run on Spark's own streaming state with a ten minute watermark; later rows
are dropped. Operators that look at the last rows of a series run per micro-batch on
the new rows and a small written tail, with the tested batch operator doing the work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.functions.chunking import line_chunks
from portolan.operators import rank
from portolan.session import scratch_root
from portolan.sources.files import read_repo_files, refreshed_index
from portolan.streaming import events as ev

WATERMARK = "10 minutes"


def with_event_time(df: DataFrame, ts: str = "ts", late: str = WATERMARK) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def task_status(updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The latest value of every column per task; write it in update or complete mode."""
    return ev.task_status(updates, key, order)


def endpoint_metrics(requests: DataFrame, window: str = "1 minute") -> DataFrame:
    """Requests, times and errors per endpoint and tumbling window."""
    return _windowed(requests, window, None, ["endpoint"]).agg(
        F.count("*").alias("count"),
        F.avg("seconds").alias("avg_time"),
        F.min("seconds").alias("min_time"),
        F.max("seconds").alias("max_time"),
        F.count_if(F.col("status") >= 400).alias("error_count"),
    )


def metric_summary(metrics: DataFrame, window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Count, min, max, mean and latest value per metric and sliding window."""
    return _windowed(metrics, window, slide, ["name"]).agg(
        F.count("*").alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.max_by("value", F.struct("ts", "event_id")).alias("latest"),
    )


def rate_violations(requests: DataFrame, limit: int = 100, window: str = "60 seconds", slide: str = "10 seconds", key: str = "client") -> DataFrame:
    """Clients over the limit in a sliding window."""
    counted = _windowed(requests, window, slide, [key]).agg(F.count("*").alias("request_count"))
    return counted.where(F.col("request_count") > limit)


def stage_counts(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """I4: executions and durations per stage and tumbling window, for events that carry a duration."""
    return _windowed(events, window, None, ["stage"]).agg(
        F.count("*").alias("total_executions"), F.sum("duration").alias("total_duration"), F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration")
    )


def error_counts(logs: DataFrame, window: str = "1 hour") -> DataFrame:
    """Errors per message and tumbling window."""
    return _windowed(logs.where(F.upper("level") == "ERROR"), window, None, ["message"]).agg(F.count("*").alias("errors"))


def _windowed(df: DataFrame, window: str, slide: str | None, keys: list[str]):
    timed = with_event_time(df)
    return timed.groupBy(F.window("ts", window, slide) if slide else F.window("ts", window), *keys)


class Tail:
    """The last rows of every series, written once per micro-batch.

    Micro-batch n reads the tail of n - 1 and writes its own, so a repeated batch reads and
    writes the same. By then n - 2 is committed and its tail goes.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{scratch_root(spark)}/{name}"

    def _at(self, epoch: int) -> str:
        return f"{self.path}/epoch{epoch:012d}"

    def before(self, epoch: int, like: DataFrame) -> DataFrame:
        if epoch == 0:
            return like.limit(0)
        return self.spark.read.schema(like.schema).parquet(self._at(epoch - 1))

    def put(self, epoch: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self._at(epoch))
        if epoch > 1:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(epoch - 2))
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)


def threshold_alerts(
    metrics: DataFrame, warning: float, critical: float, window: int, sink: Callable[[DataFrame, int], None], name: str,
    above: bool = True, keys: list[str] | None = None,
):
    """Alerts on the mean of the last values; ``sink(alerts, epoch)`` is the alert callback.

    Gives the stream writer, to be started by the caller. ``name`` must stay the same across
    restarts. Rows count in arrival order of their batches.
    """
    keys = keys or ["name"]
    cols = [*dict.fromkeys([*keys, "ts", "event_id", "value"])]
    tail = Tail(metrics.sparkSession, f"alerts-{name}")

    def batch(rows: DataFrame, epoch: int) -> None:
        new = rows.select(*cols)
        old = tail.before(epoch, new)
        series = old.withColumn("_old", F.lit(True)).unionByName(new.withColumn("_old", F.lit(False)))
        alerts = ev.threshold_alerts(series, warning, critical, window, above, keys)
        sink(alerts.where("not _old").drop("_old"), epoch)
        last = rank.first_n_per_group(series.drop("_old"), keys, [F.desc("ts"), F.desc("event_id")], max(window - 1, 1))
        tail.put(epoch, last)

    return metrics.writeStream.foreachBatch(batch)


def stage_sessions(events: DataFrame, sink: Callable[[DataFrame, int], None], name: str, key: str = "task_id"):
    """Closed stages per micro-batch; a task's open stage waits in the tail for its next event."""
    cols = [key, "event_id", "stage", "ts"]
    tail = Tail(events.sparkSession, f"sessions-{name}")

    def batch(rows: DataFrame, epoch: int) -> None:
        new = rows.select(*cols)
        series = tail.before(epoch, new).unionByName(new)
        sink(ev.stage_sessions(series, key).where("completed_at is not null"), epoch)
        tail.put(epoch, rank.best_per_group(series, [key], ["ts", "event_id"]).select(*cols))

    return events.writeStream.foreachBatch(batch)


def live_status(updates: DataFrame, sink: Callable[[DataFrame, int], None], name: str, key: str, order: list[str], ttl_seconds: int = 3600, ts: str = "ts"):
    """Current statuses after each micro-batch; one not touched for the time to live is dropped.

    "Now" is the newest event time seen.
    """
    cols = updates.columns
    tail = Tail(updates.sparkSession, f"status-{name}")

    def batch(rows: DataFrame, epoch: int) -> None:
        both = tail.before(epoch, rows.select(*cols)).unionByName(rows.select(*cols))
        merged = ev.task_status(both, key, order).select(*cols)
        now = both.agg(F.max(F.col(ts).cast("timestamp"))).scalar()
        alive = ev.expire_status(merged, ts, ttl_seconds, now)
        tail.put(epoch, alive)
        sink(tail.before(epoch + 1, rows.select(*cols)), epoch)

    return updates.writeStream.foreachBatch(batch)


def index_files(spark: SparkSession, root: str, sink: Callable[[DataFrame, DataFrame, int], None], name: str, **options):
    """I16: cut new and changed files as they appear; ``sink(index, chunks, epoch)`` gets the new state.

    Each micro-batch of the file stream triggers one listing of ``root``, so removals count too; only files that
    differ from the index by length or time are opened.
    """
    key = ["repository", "path"]
    files = Tail(spark, f"index-{name}")
    pieces = Tail(spark, f"chunks-{name}")
    none = spark.createDataFrame([], "repository string, path string, length long, modified timestamp, digest string")
    empty = line_chunks(spark.createDataFrame([], "repository string, path string, content string"), keep=key)

    def batch(rows: DataFrame, epoch: int) -> None:
        index, chunks = refreshed_index(spark, root, files.before(epoch, none), pieces.before(epoch, empty), **options)
        files.put(epoch, index)
        pieces.put(epoch, chunks)
        sink(files.before(epoch + 1, none), pieces.before(epoch + 1, empty), epoch)

    # names only: the stream itself opens no file
    return read_repo_files(spark, root, stream=True, **options).select(*key).writeStream.foreachBatch(batch)
