"""I6, I8, I15 on Spark's keyed state: values, lists and event-time timers.

Such a query needs the RocksDB state store (`state_store`). Each operator gives the rows of its batch
form in `events`; a restart from the checkpoint goes on where it stopped.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from portolan.operators import rank
from portolan.streaming import events as ev
from portolan.streaming.live import WATERMARK, Tail, with_event_time

#: Calls whose times an operation remembers.
RECENT = 100


def state_store(spark: SparkSession) -> None:
    """Chooses the state store that keyed state needs, for queries started from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _newest(call: tuple) -> tuple:
    """Sort key of a call: by time, then id; calls without either come first."""
    at, event_id, _ = call
    return at is not None, at or 0, event_id is not None, event_id or 0


class _Operation(StatefulProcessor):
    """Totals of an operation as a value, its latest calls as a list."""

    def __init__(self, recent: int):
        self.recent = recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "calls long, ok long, failed long, timed long, seconds double, least double, most double, last long")
        self.latest = handle.getListState("latest", "at long, event_id long, seconds double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        calls, ok, failed, timed, seconds, least, most, last = self.totals.get() or (0, 0, 0, 0, 0.0, None, None, None)
        latest = [tuple(x) for x in self.latest.get()]
        for r in rows:
            calls, ok, failed = calls + 1, ok + (r.ok is True), failed + (r.ok is False)
            if r.seconds is not None:
                timed, seconds = timed + 1, seconds + r.seconds
                least = r.seconds if least is None else min(least, r.seconds)
                most = r.seconds if most is None else max(most, r.seconds)
            if r.at is not None:
                last = r.at if last is None else max(last, r.at)
            latest.append((r.at, r.event_id, r.seconds))
            if len(latest) > 10 * self.recent:
                latest = heapq.nlargest(self.recent, latest, key=_newest)
        latest = heapq.nlargest(self.recent, latest, key=_newest)
        self.totals.update((calls, ok, failed, timed, seconds, least, most, last))
        self.latest.put(latest)
        times = [s for _, _, s in latest if s is not None]
        yield Row(
            operation=key[0], total_calls=calls, success_count=ok, error_count=failed, average_time=seconds / timed if timed else None, min_time=least, max_time=most,
            last=last, recent_average=sum(times) / len(times) if times else None, success_rate=ok / calls,
        )

    def close(self) -> None:
        pass


def operation_summary(timings: DataFrame, recent: int = RECENT) -> DataFrame:
    """I8: the summary of every operation that had calls in a micro-batch, over all its calls so far; write it in update mode.

    ``timings`` has ``operation, ts, event_id, seconds, ok``. State per operation is its totals and ``recent`` calls, in any order of arrival.
    Null times and results count as calls only, as in the batch form.
    """
    shape = (
        "operation string, total_calls long, success_count long, error_count long, average_time double, min_time double, max_time double, "
        "last long, recent_average double, success_rate double"
    )
    calls = timings.select("operation", _micros("ts").alias("at"), F.col("event_id").cast("long").alias("event_id"), F.col("seconds").cast("double").alias("seconds"), "ok")
    rows = calls.groupBy("operation").transformWithState(_Operation(recent), shape, "Update", "None")
    return rows.select(*[F.timestamp_micros("last").alias("last_execution") if c == "last" else c for c in rows.columns])


def performance_score(timings: DataFrame, resources: DataFrame, sink: Callable[[DataFrame, int], None], name: str, recent: int = RECENT):
    """Score and level after each micro-batch; ``sink(score, epoch)`` gets one row. Gives the stream writer.

    ``resources`` has ``resource`` (cpu, memory or overhead), ``ts, event_id, value``. Operations and resources are keys of one
    state; their current rows, one per operation, wait in a written table for the next batch. ``name`` must stay the same across restarts.
    """
    of = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c)).alias("operation")
    calls = timings.select(of("call", "operation"), "ts", "event_id", "seconds", "ok")
    used = resources.select(of("mean", "resource"), "ts", "event_id", F.col("value").alias("seconds"), F.lit(None).cast("boolean").alias("ok"))
    tail = Tail(timings.sparkSession, f"score-{name}")

    def batch(rows: DataFrame, epoch: int) -> None:
        both = tail.before(epoch, rows).unionByName(rows)
        tail.put(epoch, rank.best_per_group(both, ["operation"], ["total_calls"]).select(*rows.columns))
        now = tail.before(epoch + 1, rows)
        mean = lambda r: F.max(F.when(F.col("operation") == f"mean:{r}", F.col("average_time"))).alias(r)
        sink(ev.performance_score(now.agg(mean("cpu"), mean("memory"), mean("overhead")), now.where("operation LIKE 'call:%'")), epoch)

    return operation_summary(calls.unionByName(used), recent).writeStream.outputMode("update").foreachBatch(batch)


class _Stages(StatefulProcessor):
    """A task's events wait in a list until the watermark has passed them; its open stage is a value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "stage string, at long")
        self.waiting = handle.getListState("waiting", "at long, event_id long, stage string")

    def _wake(self, waiting: list[tuple]) -> None:
        """One timer, at the first event that waits."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if waiting:
            self.handle.registerTimer(min(at for at, _, _ in waiting) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        waiting = [tuple(x) for x in self.waiting.get()] + [(r.at, r.event_id, r.stage) for r in rows]
        self.waiting.put(waiting)
        self._wake(waiting)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(x) for x in self.waiting.get())
        ready, later = [x for x in waiting if x[0] < passed], [x for x in waiting if x[0] >= passed]
        stage = self.open.get()
        for at, _, name in ready:
            if stage is not None:
                yield Row(task_id=key[0], stage=stage[0], at=at, what="completed")
            yield Row(task_id=key[0], stage=name, at=at, what="started")
            stage = (name, at)
        if ready:
            self.open.update(stage)
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        self._wake(later)

    def close(self) -> None:
        pass


def task_log(events: DataFrame, errors: DataFrame, warnings: DataFrame, level: str = "INFO", late: str = WATERMARK) -> DataFrame:
    """Start, completion, error and warning rows of tasks as the watermark passes them; write it in append mode.

    ``events`` has ``task_id, event_id, stage, ts``; ``errors`` and ``warnings`` carry ``task_id, stage, ts, message``. A task's events wait for a timer
    at their own time, so they are read in order however they arrive; those later than ``late`` are dropped. State per
    task is its open stage and the events of the last ``late``.
    """
    timed = with_event_time(events.where("ts IS NOT NULL").select("task_id", "event_id", "stage", "ts"), late=late)
    rows = timed.select("task_id", F.col("event_id").cast("long").alias("event_id"), "stage", _micros("ts").alias("at"), "ts").groupBy("task_id")
    kind = events.schema["task_id"].dataType.simpleString()
    marks = rows.transformWithState(_Stages(), f"task_id {kind}, stage string, at long, what string", "Append", "EventTime")
    said = marks.select("task_id", "stage", F.timestamp_micros("at").alias("ts"), F.lit("INFO").alias("level"), F.concat(F.lit("Stage "), "stage", F.lit(" "), "what").alias("message"))
    for other, name in ((errors, "ERROR"), (warnings, "WARNING")):
        said = said.unionByName(other.select("task_id", "stage", F.col("ts").cast("timestamp").alias("ts"), F.lit(name).alias("level"), "message"))
    return ev.min_level(said, level)
