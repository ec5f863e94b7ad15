"""Event queries over the events table."""

from pyspark.sql import functions as F

from portolan.queries.registry import query
from portolan.streaming import events as ev

SESSIONS = """
    sessions AS (
        SELECT task_id, event_id, stage, ts AS started_at, lead(ts) OVER w AS completed_at,
               (epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1000000.0 AS duration
        FROM task_events WINDOW w AS (PARTITION BY task_id ORDER BY ts, event_id))"""


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def newest(t, minus_seconds=0):
    """The latest event time as a scalar."""
    return t.events.agg(F.max(F.col("ts").cast("timestamp"))).scalar()


def metrics(t):
    return t.events.select("event_id", F.col("event_type").alias("name"), "ts", "value")


def timings(t):
    return t.events.select(
        F.col("event_type").alias("operation"), "ts", "event_id", (F.col("value") / 50).alias("seconds"),
        (F.col("user_id") % 10 != 0).alias("ok"),
    )


@query("task_status", """
    WITH u AS (SELECT task_id, ts, event_id, stage, CASE WHEN stage IN ('click', 'view') THEN duration END AS files,
                      CASE WHEN stage = 'error' THEN props END AS last_error FROM task_events)
    SELECT task_id, max_by(stage, (ts, event_id)) AS stage, max_by(files, (ts, event_id)) FILTER (WHERE files IS NOT NULL) AS files,
           max_by(last_error, (ts, event_id)) FILTER (WHERE last_error IS NOT NULL) AS last_error
    FROM u GROUP BY task_id""")
def _(t):
    e = t.task_events
    u = e.select(
        "task_id", "ts", "event_id", "stage",
        F.when(F.col("stage").isin("click", "view"), F.col("duration")).alias("files"),
        F.when(F.col("stage") == "error", F.col("props")).alias("last_error"),
    )
    return ev.task_status(u, "task_id", ["ts", "event_id"]).select("task_id", "stage", "files", "last_error")


@query("stage_sessions", f"""
    WITH {SESSIONS} SELECT task_id, event_id, stage, completed_at IS NULL AS active, round(duration, 6) AS duration FROM sessions""")
def _(t):
    s = ev.stage_sessions(t.task_events)
    return s.select("task_id", "event_id", "stage", F.col("completed_at").isNull().alias("active"), *r6("duration"))


@query("expired_status", """
    WITH s AS (SELECT task_id, max(ts) AS ts, max_by(stage, (ts, event_id)) AS stage FROM task_events GROUP BY task_id),
    n AS (SELECT max(ts) AS now FROM task_events)
    SELECT task_id, stage FROM s, n WHERE epoch_us(now) - epoch_us(ts) <= 86400 * 1000000::BIGINT OR stage = 'view'""")
def _(t):
    s = ev.task_status(t.task_events.select("task_id", "ts", "event_id", "stage"), "task_id", ["ts", "event_id"])
    return ev.expire_status(s, "ts", 86400, newest(t), F.col("stage") == "view").select("task_id", "stage")


@query("stage_metrics", f"""
    WITH {SESSIONS}
    SELECT stage, count(*) AS total_executions, round(coalesce(sum(duration), 0), 3) AS total_duration,
           round(coalesce(avg(duration), 0), 5) AS average_duration, coalesce(min(duration), 0) AS min_duration,
           coalesce(max(duration), 0) AS max_duration, count(completed_at) AS success_count,
           count(*) FILTER (WHERE completed_at IS NULL) AS current_active,
           count(*) FILTER (WHERE completed_at IS NULL AND stage = 'error') AS error_count
    FROM sessions GROUP BY stage""")
def _(t):
    out = ev.stage_metrics(ev.stage_sessions(t.task_events), F.col("stage") == "error")
    return out.withColumn("total_duration", F.round("total_duration", 3)).withColumn(
        "average_duration", F.round("average_duration", 5)
    )


@query("stage_metrics_by_day", f"""
    WITH {SESSIONS}
    SELECT strftime(started_at, '%Y-%m-%d') AS day, stage, count(*) AS total_executions, count(completed_at) AS success_count
    FROM sessions GROUP BY 1, 2""")
def _(t):
    out = ev.stage_metrics(ev.stage_sessions(t.task_events), F.col("stage") == "error", "1 day")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "stage", "total_executions", "success_count")


@query("embedding_metrics", """
    WITH s AS (SELECT doc_id % 150 AS repository, n_chars // 1000 AS total_chunks, n_chars // 2000 AS embedded_chunks,
                      (doc_id % 7) / 2.0 AS rate, doc_id % 3 AS errors, CASE doc_id % 4 WHEN 0 THEN 'embedding' ELSE 'storing' END AS stage
               FROM documents)
    SELECT CAST(sum(embedded_chunks) AS BIGINT) AS total_chunks_embedded, round(avg(CASE WHEN rate > 0 THEN rate END), 6) AS average_embedding_rate,
           count(*) FILTER (WHERE stage = 'embedding') AS active_embedding_tasks, CAST(sum(errors) AS BIGINT) AS embedding_errors,
           count(DISTINCT repository) AS repositories_with_embeddings
    FROM s WHERE total_chunks > 0""")
def _(t):
    s = t.documents.selectExpr(
        "doc_id % 150 AS repository", "n_chars DIV 1000 AS total_chunks", "n_chars DIV 2000 AS embedded_chunks",
        "(doc_id % 7) / 2.0D AS rate", "doc_id % 3 AS errors", "CASE doc_id % 4 WHEN 0 THEN 'embedding' ELSE 'storing' END AS stage",
    )
    return ev.embedding_metrics(s).withColumn("average_embedding_rate", F.round("average_embedding_rate", 6))


@query("task_log", f"""
    WITH {SESSIONS}, logs AS (
        SELECT task_id, stage, started_at AS ts, 'INFO' AS level, concat('Stage ', stage, ' started') AS message FROM sessions
        UNION ALL SELECT task_id, stage, completed_at, 'INFO', concat('Stage ', stage, ' completed') FROM sessions
                  WHERE completed_at IS NOT NULL
        UNION ALL SELECT task_id, stage, ts, 'ERROR', props FROM task_events WHERE stage = 'error'
        UNION ALL SELECT task_id, stage, ts, 'WARNING', props FROM task_events WHERE stage = 'signup')
    SELECT task_id, stage, epoch_us(ts) AS at, level, message FROM logs""")
def _(t):
    e = t.task_events
    said = e.select("task_id", "stage", "ts", F.col("props").alias("message"))
    rows = ev.task_log(ev.stage_sessions(e), said.where("stage = 'error'"), said.where("stage = 'signup'"), "INFO")
    return rows.select("task_id", "stage", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "level", "message")


@query("threshold_alerts", """
    WITH r AS (SELECT event_id, event_type AS name, avg(value) OVER w AS m, count(value) OVER w AS n FROM events
               WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT event_id, name, round(m, 6) AS mean_value, CASE WHEN m > 100 THEN 'critical' ELSE 'poor' END AS level
    FROM r WHERE n = 5 AND m > 60""")
def _(t):
    return ev.threshold_alerts(metrics(t), 60, 100, 5).select("event_id", "name", *r6("mean_value"), "level")


@query("threshold_alerts_below", """
    WITH r AS (SELECT event_id, event_type AS name, avg(value) OVER w AS m, count(value) OVER w AS n FROM events
               WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT event_id, name, round(m, 6) AS mean_value, CASE WHEN m < 10 THEN 'critical' ELSE 'poor' END AS level
    FROM r WHERE n = 5 AND m < 20""")
def _(t):
    return ev.threshold_alerts(metrics(t), 20, 10, 5, above=False).select("event_id", "name", *r6("mean_value"), "level")


OPERATIONS = """
    ops AS (
        SELECT event_type AS operation, ts, event_id, value / 50 AS seconds, user_id % 10 <> 0 AS ok,
               row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events),
    summary AS (
        SELECT operation, count(*) AS total_calls, count(*) FILTER (WHERE ok) AS success_count,
               count(*) FILTER (WHERE NOT ok) AS error_count, avg(seconds) AS average_time, min(seconds) AS min_time,
               max(seconds) AS max_time, epoch_us(max(ts)) AS last_execution, avg(seconds) FILTER (WHERE rn <= 100) AS recent_average,
               count(*) FILTER (WHERE ok) / count(*) AS success_rate
        FROM ops GROUP BY operation)"""


@query("operation_summary", f"""
    WITH {OPERATIONS}
    SELECT operation, total_calls, success_count, error_count, round(average_time, 6) AS average_time, round(min_time, 6) AS min_time,
           round(max_time, 6) AS max_time, last_execution, round(recent_average, 6) AS recent_average, round(success_rate, 6) AS success_rate
    FROM summary""")
def _(t):
    out = ev.operation_summary(timings(t))
    return out.select(
        "operation", "total_calls", "success_count", "error_count", F.unix_micros(F.col("last_execution").cast("timestamp")).alias("last_execution"),
        *r6("average_time", "min_time", "max_time", "recent_average", "success_rate"),
    )


@query("metric_summary", """
    SELECT event_type AS name, count(*) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean,
           max_by(value, (ts, event_id)) AS latest, epoch_us(min(ts)) AS first_ts, epoch_us(max(ts)) AS last_ts
    FROM events WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) <= 604800 * 1000000::BIGINT GROUP BY event_type""")
def _(t):
    out = ev.metric_summary(metrics(t), newest(t), 604800)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return out.select("name", "count", "min", "max", *r6("mean"), "latest", us("first_ts"), us("last_ts"))


@query("rate_violations", """
    SELECT event_id, client, request_count FROM (
        SELECT *, count(*) OVER (PARTITION BY client ORDER BY epoch_us(ts)
                  RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS request_count FROM request_logs)
    WHERE request_count > 8""")
def _(t):
    return ev.rate_violations(t.request_logs, 8, 86400).select("event_id", "client", "request_count")


@query("endpoint_metrics", """
    SELECT endpoint, count(*) AS count, round(avg(seconds), 6) AS avg_time, round(min(seconds), 6) AS min_time, round(max(seconds), 6) AS max_time,
           count(*) FILTER (WHERE status >= 400) AS error_count,
           round(count(*) FILTER (WHERE status >= 400) / count(*), 6) AS error_rate
    FROM request_logs GROUP BY endpoint""")
def _(t):
    return ev.endpoint_metrics(t.request_logs).select("endpoint", "count", "error_count", *r6("avg_time", "min_time", "max_time", "error_rate"))


@query("slow_requests", "SELECT event_id, endpoint, round(seconds, 6) AS seconds FROM request_logs WHERE seconds > 5")
def _(t):
    return ev.slow_requests(t.request_logs).select("event_id", "endpoint", *r6("seconds"))


@query("error_counts", """
    WITH e AS (SELECT * FROM app_logs WHERE level = 'ERROR'
               AND epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) < 240 * 3600 * 1000000::BIGINT)
    SELECT message, count(*) AS errors, (SELECT count(*) FROM e) AS total_errors FROM e GROUP BY message""")
def _(t):
    return ev.error_counts(t.app_logs, newest(t), 240)


@query("recent_errors", """
    SELECT event_id, component, message FROM app_logs WHERE level = 'ERROR'
    AND epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) < 24 * 3600 * 1000000::BIGINT ORDER BY ts DESC, event_id DESC LIMIT 10""")
def _(t):
    return ev.recent_errors(t.app_logs, newest(t), 24).select("event_id", "component", "message")


@query("logs_from_warning", "SELECT event_id, level FROM app_logs WHERE level IN ('WARNING', 'ERROR')")
def _(t):
    return ev.min_level(t.app_logs, "warning").select("event_id", "level")


@query("logs_exact_level", "SELECT event_id, level FROM app_logs WHERE level = 'WARNING'")
def _(t):
    return ev.exact_level(t.app_logs, "warning").select("event_id", "level")


@query("live_tasks", """
    SELECT c_custkey AS task_id, c_name AS repository, CASE c_nationkey % 4 WHEN 0 THEN 'in_progress' ELSE 'pending' END AS status,
           c_mktsegment AS stage, c_custkey % 3 AS error_count, c_custkey % 2 AS warning_count
    FROM customer WHERE c_nationkey % 4 <> 1""")
def _(t):
    status = t.customer.selectExpr(
        "c_custkey AS task_id", "c_name AS repository", "c_mktsegment AS stage",
        "CASE c_nationkey % 4 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'completed' ELSE 'pending' END AS status",
        "slice(array(c_name, c_mktsegment), 1, CAST(c_custkey % 3 AS INT)) AS errors",
        "slice(array(c_name), 1, CAST(c_custkey % 2 AS INT)) AS warnings",
    )
    out = ev.live_tasks(status)
    return out.withColumn("error_count", F.col("error_count").cast("long")).withColumn("warning_count", F.col("warning_count").cast("long"))


@query("throughput", """
    SELECT o_orderkey AS run, round((o_custkey % 500) / greatest(o_totalprice / 100000, 1), 6) AS files_per_second,
           round(o_custkey / greatest(o_totalprice / 100000, 1), 6) AS chunks_per_second FROM orders""")
def _(t):
    runs = t.orders.selectExpr("o_orderkey AS run", "o_custkey % 500 AS files", "o_custkey AS chunks", "o_totalprice / 100000 AS seconds")
    return ev.throughput(runs).select("run", *r6("files_per_second", "chunks_per_second"))


@query("performance_score", f"""
    WITH {OPERATIONS},
    m AS (SELECT avg(value) FILTER (WHERE event_type = 'view') AS cpu, avg(value) FILTER (WHERE event_type = 'click') AS memory,
                 avg(value) FILTER (WHERE event_type = 'purchase') / 10 AS overhead FROM events),
    o AS (SELECT avg(100.0 - greatest(0.95 - success_rate, 0) * 100
                     - CASE WHEN recent_average > average_time * 1.5 THEN 20 ELSE 0 END) AS op FROM summary),
    s AS (SELECT (100.0 - CASE WHEN cpu > 80 THEN 30 WHEN cpu > 60 THEN 15 WHEN cpu > 40 THEN 5 ELSE 0 END
                  - CASE WHEN memory > 90 THEN 25 WHEN memory > 75 THEN 15 WHEN memory > 60 THEN 8 ELSE 0 END
                  - CASE WHEN overhead > 5 THEN 20 WHEN overhead > 3 THEN 10 WHEN overhead > 1 THEN 5 ELSE 0 END) * 0.75 + op * 0.25 AS s
          FROM m, o)
    SELECT round(greatest(0, least(100, s)), 6) AS score,
           CASE WHEN s >= 90 THEN 'excellent' WHEN s >= 75 THEN 'good' WHEN s >= 60 THEN 'acceptable' WHEN s >= 40 THEN 'poor'
                ELSE 'critical' END AS level FROM s""")
def _(t):
    of = lambda kind: F.avg(F.when(F.col("event_type") == kind, F.col("value")))
    means = t.events.agg(of("view").alias("cpu"), of("click").alias("memory"), (of("purchase") / 10).alias("overhead"))
    return ev.performance_score(means, ev.operation_summary(timings(t))).select(*r6("score"), "level")


@query("service_score", """
    SELECT s_suppkey AS service, round(greatest(100.0 - least(greatest(abs(s_acctbal) / 2000 - 1, 0) * 10, 20)
           - least(greatest(abs(s_acctbal) / 5000 - 0.5, 0) * 20, 20) - greatest(0.9 - (s_suppkey % 100) / 100.0, 0) * 100
           - greatest(0.3 - (s_suppkey % 10) / 10.0, 0) * 50, 0), 6) AS score FROM supplier""")
def _(t):
    s = t.supplier.selectExpr(
        "s_suppkey AS service", "abs(s_acctbal) / 2000 AS vector_seconds", "abs(s_acctbal) / 5000 AS graph_seconds",
        "(s_suppkey % 100) / 100.0D AS success_rate", "(s_suppkey % 10) / 10.0D AS cache_hit_rate",
    )
    return ev.service_score(s).select("service", *r6("score"))
