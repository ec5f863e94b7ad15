"""Operators on keyed state give what their batch forms give, also after a restart."""

import pytest
from pyspark.sql import functions as F

from portolan.queries import event_queries as eq
from portolan.streaming import events as ev
from portolan.streaming import keyed


@pytest.fixture(autouse=True)
def store(spark):
    keyed.state_store(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


class Replay:
    """A table dealt out as files; each run reads what has come since the one before."""

    def __init__(self, spark, df, folder, order, parts=4):
        self.spark, self.folder, self.schema, self.at, self.parts = spark, folder, df.schema, 0, parts
        self.rows = df.orderBy(*order).collect()

    def come(self, parts):
        size = -(-len(self.rows) // self.parts)
        for i in range(self.at, self.at + parts):
            self.spark.createDataFrame(self.rows[i * size : (i + 1) * size], self.schema).coalesce(1).write.parquet(f"{self.folder}/p{i}")
        self.at += parts

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(f"{self.folder}/*")


def run(writer, folder):
    q = writer.option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    q.awaitTermination(240)
    assert q.exception() is None and not q.isActive


def rounded(r):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in r)


# rows in no order of time: totals and latest calls do not depend on it
def test_operation_summary_after_a_restart(spark, tables, tmp_path):
    t = eq.timings(tables)
    odd = spark.createDataFrame([("none", None, None, None, None), ("none", None, 3, 2.0, True), ("none", None, 2, 1.0, None)], "operation string, ts string, event_id long, seconds double, ok boolean")
    t = t.select("operation", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), F.col("seconds").cast("double").alias("seconds"), "ok")
    t = t.unionByName(odd.withColumn("ts", F.col("ts").cast("timestamp")))
    replay, last = Replay(spark, t, str(tmp_path / "in"), [F.xxhash64("event_id")]), {}
    keep = lambda rows, epoch: last.update({r.operation: rounded(r) for r in rows.collect()})
    for parts in (2, 2):
        replay.come(parts)
        run(keyed.operation_summary(replay.stream(), 7).writeStream.outputMode("update").foreachBatch(keep), tmp_path / "cp")
    want = ev.operation_summary(t, 7)
    assert last == {r.operation: rounded(r) for r in want.select("operation", "total_calls", "success_count", "error_count", "average_time", "min_time", "max_time", "last_execution", "recent_average", "success_rate").collect()}
    assert len(last) > 2 and any(v[1] > 7 for v in last.values())


def test_score_after_a_restart(spark, tables, tmp_path):
    t = eq.timings(tables).select("operation", "ts", F.col("event_id").cast("long").alias("event_id"), F.col("seconds").cast("double").alias("seconds"), "ok")
    kinds = {"view": "cpu", "click": "memory", "purchase": "overhead"}
    name = F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), "event_type")
    used = tables.events.where(F.col("event_type").isin(*kinds)).select(name.alias("resource"), "ts", "event_id", F.col("value").cast("double").alias("value"))
    calls, loads, got = Replay(spark, t, str(tmp_path / "a"), ["event_id"]), Replay(spark, used, str(tmp_path / "b"), ["event_id"]), []
    for parts in (1, 3):
        calls.come(parts), loads.come(parts)
        sink = lambda score, epoch: got.append(rounded(score.first()))
        run(keyed.performance_score(calls.stream(), loads.stream(), sink, tmp_path.name), tmp_path / "cp")
    mean = lambda r: F.avg(F.when(F.col("resource") == r, F.col("value"))).alias(r)
    (want,) = ev.performance_score(used.agg(mean("cpu"), mean("memory"), mean("overhead")), ev.operation_summary(t)).collect()
    assert got[-1] == rounded(want) and len(got) >= 4


def test_task_log_after_a_restart(spark, tables, tmp_path):
    e = tables.task_events.select("task_id", F.col("event_id").cast("long").alias("event_id"), "stage", F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("message"))
    # far ahead: pushes the watermark over all that came before
    end = e.limit(1).select(F.lit(-1).cast(e.schema["task_id"].dataType).alias("task_id"), F.lit(-1).cast("long").alias("event_id"), F.lit("end").alias("stage"), F.lit("2999-01-01").cast("timestamp").alias("ts"), F.lit("").alias("message"))
    replay, got = Replay(spark, e, str(tmp_path / "in"), ["ts", F.xxhash64("event_id")]), []
    # within a file rows are in no order
    replay.rows = [r for i in range(0, len(replay.rows), 40) for r in sorted(replay.rows[i : i + 40], key=lambda r: hash((r.event_id, 7)))]

    def log():
        s = replay.stream()
        parts = s.where("stage = 'error'").select("task_id", "stage", "ts", "message"), s.where("stage = 'signup'").select("task_id", "stage", "ts", "message")
        return keyed.task_log(s, *parts, late="40 days").writeStream.outputMode("append").foreachBatch(lambda rows, epoch: got.extend(tuple(r) for r in rows.collect()))

    replay.come(2)
    run(log(), tmp_path / "cp")
    before = len(got)
    replay.come(2)
    end.coalesce(1).write.parquet(f"{replay.folder}/p9")
    run(log(), tmp_path / "cp")
    s = e.withColumn("ts", F.col("ts"))
    want = ev.task_log(ev.stage_sessions(s), s.where("stage = 'error'"), s.where("stage = 'signup'"), "INFO").collect()
    key = lambda r: (r[0], r[1], r[2], r[3], r[4])
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert 0 < before < len(got)
