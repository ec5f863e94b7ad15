"""Ranking, window and set queries."""

from pyspark.sql import functions as F

from portolan.operators import rank, sets
from portolan.queries.registry import query


@query("best_version_per_artifact", """
    SELECT artifact_id, depth, version, repo, ord FROM (
        SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY depth, repo, ord, version) AS rn FROM repo_artifacts)
    WHERE rn = 1""")
def _(t):
    cols = ["depth", "repo", "ord", "version"]
    return rank.best_per_group(t.repo_artifacts.select("artifact_id", *cols), ["artifact_id"], cols, largest=False)


@query("keep_first_chunk_per_file", """
    SELECT file_path, id, size FROM (
        SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY size DESC, id) AS rn FROM chunks) WHERE rn = 1""")
def _(t):
    return rank.keep_first(t.chunks.select("file_path", "id", "size"), "file_path", [F.desc("size"), F.col("id")])


@query("top_k_repositories", """
    SELECT repo, name, complexity FROM repositories ORDER BY complexity DESC, repo LIMIT 10""")
def _(t):
    return rank.top_k(t.repositories.select("repo", "name", "complexity"), [F.desc("complexity"), F.col("repo")], 10)


@query("first_callers_per_chunk", """
    SELECT dst AS chunk, src AS caller, pos FROM (
        SELECT *, row_number() OVER (PARTITION BY dst ORDER BY src) AS pos
        FROM (SELECT DISTINCT src, dst FROM chunk_edges)) WHERE pos <= 5""")
def _(t):
    calls = t.chunk_edges.select(F.col("dst").alias("chunk"), F.col("src").alias("caller")).distinct()
    return rank.first_n_per_group(calls, ["chunk"], [F.col("caller")], 5, "pos")


@query("rolling_metric_mean", """
    SELECT event_id, event_type, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id
           ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 9) AS rolling_mean FROM events""")
def _(t):
    ev = t.events.select("event_id", "event_type", "ts", "value")
    return rank.rolling_mean(ev, ["event_type"], ["ts", "event_id"], "ts", "value", 100).select(
        "event_id", "event_type", F.round("rolling_mean", 9).alias("rolling_mean")
    )


@query("trailing_request_count", """
    SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts)
           RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS trailing_count FROM events""")
def _(t):
    return rank.trailing_count(t.events.select("event_id", "user_id", "ts"), ["user_id"], "ts", 86400).select(
        "event_id", "trailing_count"
    )


@query("latest_event_per_task", """
    SELECT task_id, event_id, stage, duration FROM (
        SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC, event_id DESC) AS rn FROM task_events)
    WHERE rn = 1""")
def _(t):
    return rank.latest_per_key(t.task_events, "task_id", ["ts", "event_id"]).select("task_id", "event_id", "stage", "duration")


@query("ordered_flows", "SELECT flow, name, business_value, migration_order FROM flows ORDER BY business_value DESC, flow")
def _(t):
    return rank.order_by(
        t.flows.select("flow", "name", "business_value", "migration_order"), [("business_value", "desc"), ("flow", "asc")]
    )


@query("repository_page", """
    SELECT repo, name, (SELECT count(*) FROM repositories) AS total,
           (SELECT count(*) FROM repositories) > 30 AS has_next
    FROM repositories ORDER BY name OFFSET 20 LIMIT 10""")
def _(t):
    return rank.page(t.repositories.select("repo", "name"), [F.col("name")], 20, 10)


@query("skip_limit_chunks", "SELECT id, file_path FROM chunks ORDER BY file_path, id OFFSET 50 LIMIT 25")
def _(t):
    return t.chunks.select("id", "file_path").orderBy("file_path", "id").offset(50).limit(25)


@query("ranked_parts", """
    SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS rank FROM part""")
def _(t):
    return rank.with_rank(t.part.select("p_partkey", "p_brand", "p_retailprice"), ["p_brand"], ["p_retailprice", "p_partkey"]).select(
        "p_partkey", "p_brand", "rank"
    )


@query("union_distinct_nodes", "SELECT src AS node FROM dep_edges UNION SELECT dst FROM dep_edges")
def _(t):
    e = t.dep_edges
    return sets.union_distinct(e.select(F.col("src").alias("node")), e.select(F.col("dst").alias("node")))


@query("union_all_objects", """
    SELECT repo, object FROM repo_db WHERE object_type = 'table' UNION ALL
    SELECT repo, object FROM repo_db WHERE rel_type = 'READS_FROM'""")
def _(t):
    d = t.repo_db
    return sets.union_all(
        d.where("object_type = 'table'").select("repo", "object"), d.where("rel_type = 'READS_FROM'").select("repo", "object")
    )


@query("unresolved_and_remaining", "SELECT src AS repo FROM repo_edges INTERSECT SELECT dst FROM repo_edges")
def _(t):
    e = t.repo_edges
    return sets.intersection(e.select(F.col("src").alias("repo")), e.select(F.col("dst").alias("repo")))


@query("repositories_without_dependents", "SELECT repo FROM repositories EXCEPT SELECT dst FROM repo_edges")
def _(t):
    return sets.difference(t.repositories.select("repo"), t.repo_edges.select(F.col("dst").alias("repo")))


@query("distinct_types_in_order", "SELECT p_name AS name, min(p_partkey) AS first_seen FROM part GROUP BY p_name")
def _(t):
    return sets.distinct_in_order(t.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("first_seen")), "name", "first_seen")
