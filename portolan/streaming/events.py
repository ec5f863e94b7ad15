"""I: operators over task, metric, request and log events (batch form, the tested truth).

Times are compared as timestamps; ``as_of`` stands for "now" and is always an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.operators import rank

# fixed values: log levels in rising order; an unknown level counts as INFO
LEVELS = {"DEBUG": 0, "INFO": 1, "WARNING": 2, "ERROR": 3}


def seconds_between(start: str, end: str) -> Column:
    return (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 1_000_000


def age_seconds(ts: str, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1_000_000


def level_rank(level: Column) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    return F.coalesce(ranks[F.upper(level)], F.lit(LEVELS["INFO"]))


def task_status(updates: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per task, each column the latest non-null update."""
    when = F.struct(*order)
    return updates.groupBy(key).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), when)).alias(c) for c in updates.columns if c != key]
    )


def stage_sessions(events: DataFrame, key: str = "task_id", ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """A stage is open until the task's next event; the last one stays open."""
    led = rank.next_row(events.select(key, tie, "stage", ts), [key], [ts, tie], ts, {"completed_at": ts})
    return led.select(
        key, tie, "stage", F.col(ts).alias("started_at"), "completed_at", seconds_between(ts, "completed_at").alias("duration")
    )


def expire_status(status: DataFrame, ts: str, ttl_seconds: int, as_of: Column, running: Column | None = None) -> DataFrame:
    """Drop statuses older than the time to live, except running ones."""
    fresh = age_seconds(ts, as_of) <= ttl_seconds
    return status.where(fresh if running is None else fresh | running)


def stage_metrics(sessions: DataFrame, error: Column, window: str | None = None) -> DataFrame:
    """I4: executions, durations, successes, active and failed stages; tumbling when ``window`` is given."""
    keys = ["stage"] if window is None else [F.window("started_at", window).alias("window"), "stage"]
    closed = F.col("completed_at").isNotNull()
    zero = F.lit(0.0)
    return sessions.groupBy(*keys).agg(
        F.count("*").alias("total_executions"),
        F.coalesce(F.sum("duration"), zero).alias("total_duration"),
        F.coalesce(F.avg("duration"), zero).alias("average_duration"),
        F.coalesce(F.min("duration"), zero).alias("min_duration"),
        F.coalesce(F.max("duration"), zero).alias("max_duration"),
        F.count_if(closed).alias("success_count"),
        F.count_if(~closed).alias("current_active"),
        F.count_if(~closed & error).alias("error_count"),
    )


def embedding_metrics(status: DataFrame) -> DataFrame:
    """Totals over tasks that have chunks; the rate is the mean of the positive rates."""
    return status.where("total_chunks > 0").agg(
        F.coalesce(F.sum("embedded_chunks"), F.lit(0)).alias("total_chunks_embedded"),
        F.coalesce(F.avg(F.when(F.col("rate") > 0, F.col("rate"))), F.lit(0.0)).alias("average_embedding_rate"),
        F.count_if(F.col("stage") == "embedding").alias("active_embedding_tasks"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("embedding_errors"),
        F.count_distinct("repository").alias("repositories_with_embeddings"),
    )


def task_log(sessions: DataFrame, errors: DataFrame, warnings: DataFrame, level: str = "INFO") -> DataFrame:
    """Start, completion, error and warning rows of every task from the given level up.

    ``errors`` and ``warnings`` carry ``(task_id, stage, ts, message)``.
    """
    marks = F.array(
        F.struct(F.col("started_at").alias("ts"), F.lit(" started").alias("what")),
        F.struct(F.col("completed_at").alias("ts"), F.lit(" completed").alias("what")),
    )
    stages = sessions.select("task_id", "stage", F.explode(marks).alias("m")).where("m.ts is not null")
    said = stages.select(
        "task_id", "stage", F.col("m.ts").alias("ts"), F.lit("INFO").alias("level"),
        F.concat(F.lit("Stage "), "stage", "m.what").alias("message"),
    )
    cols = ["task_id", "stage", "ts", "level", "message"]
    rows = said.unionByName(errors.withColumn("level", F.lit("ERROR")).select(*cols)).unionByName(
        warnings.withColumn("level", F.lit("WARNING")).select(*cols)
    )
    return min_level(rows, level).orderBy("task_id", "ts", "message")


def min_level(logs: DataFrame, level: str) -> DataFrame:
    """Rows at or above a level."""
    return logs.where(level_rank(F.col("level")) >= LEVELS.get(level.upper(), LEVELS["INFO"]))


def exact_level(logs: DataFrame, level: str) -> DataFrame:
    """B11, exact form."""
    return logs.where(F.upper("level") == level.upper())


def threshold_alerts(
    metrics: DataFrame, warning: float, critical: float, window: int, above: bool = True, keys: list[str] | None = None
) -> DataFrame:
    """Rows where the mean of the last ``window`` values passes a threshold.

    ``metrics`` has ``name, ts, value`` and a tie-break ``event_id``. Nothing fires before
    ``window`` values are there.
    """
    keys = keys or ["name"]
    rolled = rank.rolling(
        metrics, keys, ["ts", "event_id"], "ts", window, {"mean_value": F.avg("value"), "_n": F.count("value")}
    )
    mean = F.col("mean_value")
    past = (lambda limit: mean > limit) if above else (lambda limit: mean < limit)
    return (
        rolled.where(F.col("_n") == window)
        .withColumn("level", F.when(past(critical), "critical").when(past(warning), "poor"))
        .where("level is not null")
        .drop("_n")
    )


def operation_summary(timings: DataFrame, recent: int = 100) -> DataFrame:
    """I8: calls, successes, rates and times per operation, with the mean of the latest calls.

    ``timings`` has ``operation, ts, event_id, seconds, ok``.
    """
    latest = rank.first_n_per_group(
        timings.select("operation", "ts", "event_id", "seconds"), ["operation"], [F.desc("ts"), F.desc("event_id")], recent
    )
    overall = timings.groupBy("operation").agg(
        F.count("*").alias("total_calls"),
        F.count_if("ok").alias("success_count"),
        F.count_if(~F.col("ok")).alias("error_count"),
        F.avg("seconds").alias("average_time"),
        F.min("seconds").alias("min_time"),
        F.max("seconds").alias("max_time"),
        F.max("ts").alias("last_execution"),
    )
    return overall.join(latest.groupBy("operation").agg(F.avg("seconds").alias("recent_average")), "operation").withColumn(
        "success_rate", F.col("success_count") / F.col("total_calls")
    )


def metric_summary(metrics: DataFrame, as_of: Column | None = None, seconds: float | None = None) -> DataFrame:
    """Count, min, max, mean, latest value, first and last time per metric, over a trailing window."""
    if seconds is not None:
        metrics = metrics.where(age_seconds("ts", as_of) <= seconds)
    return metrics.groupBy("name").agg(
        F.count("*").alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("mean"),
        F.max_by("value", F.struct("ts", "event_id")).alias("latest"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def rate_violations(requests: DataFrame, limit: int = 100, seconds: int = 60, key: str = "client") -> DataFrame:
    """Requests that exceed ``limit`` per client in the trailing window."""
    counted = rank.trailing_count(requests, [key], "ts", seconds, "request_count")
    return counted.where(F.col("request_count") > limit)


def endpoint_metrics(requests: DataFrame) -> DataFrame:
    """Requests, times and errors per endpoint."""
    return requests.groupBy("endpoint").agg(
        F.count("*").alias("count"),
        F.avg("seconds").alias("avg_time"),
        F.min("seconds").alias("min_time"),
        F.max("seconds").alias("max_time"),
        F.count_if(F.col("status") >= 400).alias("error_count"),
        F.avg(F.when(F.col("status") >= 400, 1.0).otherwise(0.0)).alias("error_rate"),
    )


def slow_requests(requests: DataFrame, seconds: float = 5.0) -> DataFrame:
    """Requests slower than the threshold."""
    return requests.where(F.col("seconds") > seconds)


def error_counts(logs: DataFrame, as_of: Column, hours: float = 24) -> DataFrame:
    """Errors of the last hours, counted per message, with the total."""
    recent = logs.where(F.upper("level") == "ERROR").where(age_seconds("ts", as_of) < hours * 3600)
    total = recent.agg(F.count("*")).scalar()
    return recent.groupBy("message").agg(F.count("*").alias("errors")).withColumn("total_errors", total)


def recent_errors(logs: DataFrame, as_of: Column, hours: float = 24, n: int = 10) -> DataFrame:
    """The newest errors in the window."""
    recent = logs.where(F.upper("level") == "ERROR").where(age_seconds("ts", as_of) < hours * 3600)
    return recent.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def live_tasks(status: DataFrame) -> DataFrame:
    """Unfinished tasks with the sizes of their error and warning lists."""
    return status.where(~F.col("status").isin("completed", "failed", "cancelled")).select(
        "task_id", "repository", "status", "stage", F.size("errors").alias("error_count"), F.size("warnings").alias("warning_count")
    )


def throughput(results: DataFrame) -> DataFrame:
    """Files and chunks per second; runs under a second count as one second."""
    took = F.greatest(F.col("seconds"), F.lit(1.0))
    return results.withColumn("files_per_second", F.col("files") / took).withColumn("chunks_per_second", F.col("chunks") / took)


def _steps(value: Column, steps: list[tuple[float, float]]) -> Column:
    """Penalty of the first limit the value passes; none for a missing value."""
    out = F.lit(0.0)
    for limit, penalty in reversed(steps):
        out = F.when(value > limit, F.lit(penalty)).otherwise(out)
    return out


# fixed values: (limit, penalty) per resource, and the lower bounds of the levels
CPU_STEPS = [(80, 30.0), (60, 15.0), (40, 5.0)]
MEMORY_STEPS = [(90, 25.0), (75, 15.0), (60, 8.0)]
OVERHEAD_STEPS = [(5, 20.0), (3, 10.0), (1, 5.0)]
SCORE_LEVELS = [(90, "excellent"), (75, "good"), (60, "acceptable"), (40, "poor")]


def performance_score(means: DataFrame, operations: DataFrame) -> DataFrame:
    """Score and level from one row ``cpu, memory, overhead`` and the I8 summary."""
    slow = F.col("recent_average") > F.col("average_time") * 1.5
    short = F.greatest(F.lit(0.95) - F.col("success_rate"), F.lit(0.0)) * 100
    per_op = operations.agg(F.avg(F.lit(100.0) - short - F.when(slow, 20.0).otherwise(0.0))).scalar()
    base = (
        F.lit(100.0)
        - _steps(F.col("cpu"), CPU_STEPS)
        - _steps(F.col("memory"), MEMORY_STEPS)
        - _steps(F.col("overhead"), OVERHEAD_STEPS)
    )
    scored = means.withColumn("_op", per_op).withColumn("_base", base)
    scored = scored.withColumn("_s", F.coalesce(F.col("_base") * 0.75 + F.col("_op") * 0.25, F.col("_base")))
    level = F.lit("critical")
    for bound, name in reversed(SCORE_LEVELS):
        level = F.when(F.col("_s") >= bound, name).otherwise(level)
    return scored.select(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("_s"))).alias("score"), level.alias("level"))


def service_score(service: DataFrame) -> DataFrame:
    """I15, service form: penalties for slow stores, failures and cold caches.

    One row per service with ``vector_seconds, graph_seconds, success_rate, cache_hit_rate``.
    """
    over = lambda c, base, rate: F.least(F.greatest(F.col(c) - base, F.lit(0.0)) * rate, F.lit(20.0))
    under = lambda c, base, rate: F.greatest(F.lit(base) - F.col(c), F.lit(0.0)) * rate
    score = (
        F.lit(100.0)
        - over("vector_seconds", 1.0, 10)
        - over("graph_seconds", 0.5, 20)
        - under("success_rate", 0.9, 100)
        - under("cache_hit_rate", 0.3, 50)
    )
    return service.withColumn("score", F.greatest(score, F.lit(0.0)))
