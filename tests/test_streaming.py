"""Streaming forms give what the batch forms give."""

from pyspark.sql import functions as F

from portolan.streaming import events as ev
from portolan.streaming import live


def as_stream(spark, df, folder, parts=3):
    """The rows in time order as several files, one per micro-batch."""
    rows = df.orderBy("ts", "event_id").collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/p{i}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/*")


def run(writer, tmp_path):
    q = writer.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def metrics(t):
    return t.events.select("event_id", F.col("event_type").alias("name"), "ts", "value")


def test_example_alerts(spark):
    rows = [(i, "m", f"2024-01-01 00:00:0{i}", float(v)) for i, v in enumerate([4, 6, 8, 20])]
    m = spark.createDataFrame(rows, "event_id int, name string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [(r.event_id, round(r.mean_value, 2), r.level) for r in ev.threshold_alerts(m, 5, 10, 3).orderBy("event_id").collect()]
    assert got == [(2, 6.0, "poor"), (3, 11.33, "critical")]


def test_alerts(spark, tables, tmp_path):
    got = []
    stream = as_stream(spark, metrics(tables), str(tmp_path / "in"))
    run(live.threshold_alerts(stream, 60, 100, 5, lambda a, e: got.extend((r.event_id, r.level) for r in a.collect()), str(tmp_path.name)), tmp_path)
    want = {(r.event_id, r.level) for r in ev.threshold_alerts(metrics(tables), 60, 100, 5).collect()}
    assert set(got) == want and len(got) == len(want)


def test_sessions(spark, tables, tmp_path):
    got = []
    stream = as_stream(spark, tables.task_events, str(tmp_path / "in"))
    run(live.stage_sessions(stream, lambda s, e: got.extend((r.event_id, round(r.duration, 3)) for r in s.collect()), str(tmp_path.name)), tmp_path)
    want = {(r.event_id, round(r.duration, 3)) for r in ev.stage_sessions(tables.task_events).where("completed_at is not null").collect()}
    assert set(got) == want and len(got) == len(want)


def test_status_expires(spark, tables, tmp_path):
    last = {}
    u = tables.task_events.select("task_id", "ts", "event_id", "stage")
    stream = as_stream(spark, u, str(tmp_path / "in"))
    run(live.live_status(stream, lambda s, e: last.update(rows={(r.task_id, r.stage) for r in s.collect()}), str(tmp_path.name), "task_id", ["ts", "event_id"], 5 * 86400), tmp_path)
    now = u.agg(F.max(F.col("ts").cast("timestamp"))).scalar()
    want = ev.expire_status(ev.task_status(u, "task_id", ["ts", "event_id"]), "ts", 5 * 86400, now)
    assert last["rows"] == {(r.task_id, r.stage) for r in want.collect()}


def test_windowed_metrics(spark, tables, tmp_path):
    stream = as_stream(spark, tables.request_logs, str(tmp_path / "in"))
    out = live.endpoint_metrics(stream, "1 day")
    run(out.writeStream.format("memory").queryName("endpoint_days").outputMode("complete"), tmp_path)
    key = lambda df: sorted((r.window.start, r.endpoint, r["count"], r.error_count, round(r.avg_time, 6)) for r in df.collect())
    assert key(spark.table("endpoint_days")) == key(live.endpoint_metrics(tables.request_logs, "1 day"))


def test_streaming_task_status(spark, tables, tmp_path):
    u = tables.task_events.select("task_id", "ts", "event_id", "stage")
    stream = as_stream(spark, u, str(tmp_path / "in"))
    run(live.task_status(stream, "task_id", ["ts", "event_id"]).writeStream.format("memory").queryName("statuses").outputMode("complete"), tmp_path)
    want = {tuple(r) for r in ev.task_status(u, "task_id", ["ts", "event_id"]).collect()}
    assert {tuple(r) for r in spark.table("statuses").collect()} == want


def test_sliding_windows(spark, tables):
    m = live.metric_summary(metrics(tables), "2 days", "1 day")
    assert m.agg(F.sum("count")).first()[0] == 2 * tables.events.count()
    r = live.rate_violations(tables.request_logs, 3, "1 day", "1 day")
    assert r.where("request_count <= 3").isEmpty()
    assert live.stage_counts(tables.task_events, "1 day").agg(F.sum("total_executions")).first()[0] == tables.events.count()
    assert live.error_counts(tables.app_logs, "1 day").agg(F.sum("errors")).first()[0] == tables.app_logs.where("level = 'ERROR'").count()


def test_file_stream(spark, tmp_path):
    root = tmp_path / "repos"
    (root / "one").mkdir(parents=True)
    (root / "one" / "A.java").write_text("class A {}")
    (root / "one" / "B.java").write_text("class B {}")
    seen = {}

    def sink(index, chunks, epoch):
        seen["index"] = {r.path for r in index.collect()}
        seen["chunks"] = {(r.path, r.chunk) for r in chunks.collect()}

    go = lambda: run(live.index_files(spark, str(root), sink, tmp_path.name), tmp_path)
    go()
    assert seen["index"] == {"A.java", "B.java"}
    (root / "one" / "B.java").unlink()
    (root / "one" / "C.java").write_text("class C {}")
    go()
    assert seen["chunks"] == {("A.java", "class A {}"), ("C.java", "class C {}")}
