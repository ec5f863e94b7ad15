"""Dependency queries over the artifacts, their edges and the repositories using them."""

from pyspark.sql import functions as F

from portolan.operators import dependencies as deps
from portolan.operators import graph
from portolan.queries.graphs import CLOSURE, PATHS
from portolan.queries.registry import query


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


SEVERITY = """CASE WHEN count(DISTINCT split_part(version, '.', 1)) > 1 THEN 'critical'
              WHEN count(DISTINCT split_part(version, '.', 2)) > 2 THEN 'high' ELSE 'medium' END"""
CONFLICTS = f"""conflicts AS (SELECT group_id, artifact_id, count(DISTINCT version) AS version_count, count(*) AS dependency_count, {SEVERITY} AS severity
                FROM repo_artifacts GROUP BY 1, 2 HAVING count(DISTINCT version) > 1)"""


@query("version_conflicts", f"WITH {CONFLICTS} SELECT * FROM conflicts")
def _(t):
    return deps.version_conflicts(t.repo_artifacts)


@query("version_conflicts_per_repository", f"""
    SELECT repo, group_id, count(DISTINCT version) AS version_count, count(*) AS dependency_count, {SEVERITY} AS severity
    FROM repo_artifacts GROUP BY 1, 2 HAVING count(DISTINCT version) > 1""")
def _(t):
    return deps.version_conflicts(t.repo_artifacts, ["repo", "group_id"], ignore_empty=True)


@query("conflicting_versions", f"""
    WITH {CONFLICTS} SELECT group_id, artifact_id, version, count(*) AS uses FROM repo_artifacts JOIN conflicts USING (group_id, artifact_id) GROUP BY 1, 2, 3""")
def _(t):
    return deps.conflicting_versions(t.repo_artifacts)


@query("conflict_impact", """
    SELECT group_id, artifact_id, count(*) AS affected_dependencies, min(depth) AS min_depth, max(depth) AS max_depth, count(DISTINCT scope) AS scope_count,
           min(CAST(split_part(version, '.', 1) AS INT)) <> max(CAST(split_part(version, '.', 1) AS INT)) AS breaking_changes_risk, false AS api_compatibility_risk
    FROM repo_artifacts GROUP BY 1, 2 HAVING count(DISTINCT version) > 1""")
def _(t):
    return deps.conflict_impact(t.repo_artifacts)


@query("included_dependencies", """
    SELECT repo, artifact, ord FROM repo_artifacts WHERE NOT optional AND scope <> 'test' AND artifact NOT IN (SELECT dst FROM dep_edges WHERE optional)
    AND group_id NOT IN ('Brand#3')""")
def _(t):
    out = t.dep_edges.where("optional").select(F.col("dst").alias("artifact")).distinct()
    kept = deps.include_dependencies(t.repo_artifacts, out)
    banned = t.part.where("p_brand = 'Brand#3'").select(F.col("p_brand").alias("group_id")).distinct()
    return deps.include_dependencies(kept, banned).select("repo", "artifact", "ord")


@query("managed_dependencies", """
    WITH m AS (SELECT p_brand AS group_id, concat('a', p_partkey) AS artifact_id, concat(p_size, '.0') AS mv FROM part WHERE p_size < 20)
    SELECT repo, artifact_id, ord, coalesce(mv, version) AS version, mv IS NOT NULL AS managed FROM repo_artifacts LEFT JOIN m USING (group_id, artifact_id)""")
def _(t):
    m = t.part.where("p_size < 20").selectExpr("p_brand AS group_id", "concat('a', p_partkey) AS artifact_id", "concat(p_size, '.0') AS version")
    return deps.apply_management(t.repo_artifacts, m).select("repo", "artifact_id", "ord", "version", "managed")


ORDER = ["ord", "repo", "depth", "version"]


def resolution(order):
    return f"""
    WITH s AS (SELECT *, count(*) OVER (PARTITION BY group_id, artifact_id) AS candidates,
                      min(version) OVER (PARTITION BY group_id, artifact_id) <> max(version) OVER (PARTITION BY group_id, artifact_id) AS c,
                      (CAST(split_part(version, '.', 1) AS INT), CAST(split_part(version, '.', 2) AS INT)) AS k FROM repo_artifacts),
    r AS (SELECT *, row_number() OVER (PARTITION BY group_id, artifact_id ORDER BY {order}, ord, repo, depth, version) AS rn FROM s)
    SELECT group_id, artifact_id, version, repo, ord, candidates FROM r WHERE rn = 1"""


@query("resolved_nearest", resolution("CASE WHEN c THEN depth END"))
def _(t):
    return deps.resolve_conflicts(t.repo_artifacts, "nearest", ORDER).select(*deps.GA, "version", "repo", "ord", "candidates")


@query("resolved_newest", resolution("CASE WHEN c THEN k END DESC"))
def _(t):
    return deps.resolve_conflicts(t.repo_artifacts, "newest", ORDER).select(*deps.GA, "version", "repo", "ord", "candidates")


@query("resolved_oldest", resolution("CASE WHEN c THEN k END"))
def _(t):
    return deps.resolve_conflicts(t.repo_artifacts, "oldest", ORDER).select(*deps.GA, "version", "repo", "ord", "candidates")


@query("resolved_managed", resolution("CASE WHEN c THEN NOT managed END, CASE WHEN c AND NOT managed THEN depth END"))
def _(t):
    return deps.resolve_conflicts(t.repo_artifacts, "managed", ORDER).select(*deps.GA, "version", "repo", "ord", "candidates")


@query("dropped_dependencies", resolution("CASE WHEN c THEN depth END").replace(
    "SELECT group_id, artifact_id, version, repo, ord, candidates FROM r WHERE rn = 1",
    """SELECT repo, ord, artifact_id, version FROM repo_artifacts a
       WHERE NOT EXISTS (SELECT 1 FROM r WHERE rn = 1 AND r.group_id = a.group_id AND r.artifact_id = a.artifact_id AND r.version = a.version)"""))
def _(t):
    from portolan.operators.sets import dropped_dependencies

    won = deps.resolve_conflicts(t.repo_artifacts, "nearest", ORDER)
    return dropped_dependencies(t.repo_artifacts, won, [*deps.GA, "version"]).select("repo", "ord", "artifact_id", "version")


@query("dependency_health", f"""
    WITH {CONFLICTS}, c AS (SELECT group_id, count(*) AS conflicts FROM conflicts GROUP BY 1),
    v AS (SELECT group_id, count(*) AS vulnerabilities FROM vulnerabilities JOIN artifacts ON artifact = id GROUP BY 1),
    l AS (SELECT l_orderkey * 16 + min(l_linenumber) * 2 + 1 AS id FROM lineitem WHERE l_orderkey % 5 = 0 GROUP BY l_orderkey HAVING min(l_linenumber) < max(l_linenumber)),
    y AS (SELECT group_id, count(*) AS cycles FROM l JOIN artifacts USING (id) GROUP BY 1),
    s AS (SELECT group_id, coalesce(conflicts, 0) AS conflicts, coalesce(cycles, 0) AS cycles, coalesce(vulnerabilities, 0) AS vulnerabilities
          FROM (SELECT DISTINCT group_id FROM artifacts) LEFT JOIN c USING (group_id) LEFT JOIN y USING (group_id) LEFT JOIN v USING (group_id)),
    h AS (SELECT *, greatest(100.0 - least(conflicts * 5, 50) - least(cycles * 10, 30) - least(vulnerabilities * 3, 20), 0) AS health FROM s)
    SELECT group_id, conflicts, cycles, vulnerabilities, CAST(health AS DOUBLE) AS health_score,
           CASE WHEN health >= 90 THEN 'A' WHEN health >= 80 THEN 'B' WHEN health >= 70 THEN 'C' WHEN health >= 60 THEN 'D' ELSE 'F' END AS grade FROM h""")
def _(t):
    of = lambda df, key: df.join(t.artifacts.select(F.col("id").alias(key), "group_id"), key).groupBy("group_id")
    c = deps.version_conflicts(t.repo_artifacts).groupBy("group_id").agg(F.count("*").alias("conflicts"))
    v = of(t.vulnerabilities, "artifact").agg(F.count("*").alias("vulnerabilities"))
    y = of(graph.cycles(t.dep_edges).select(F.get("cycle_path", F.lit(0)).alias("node")), "node").agg(F.count("*").alias("cycles"))
    counts = t.artifacts.select("group_id").distinct().join(c, "group_id", "left").join(y, "group_id", "left").join(v, "group_id", "left").na.fill(0)
    return deps.dependency_health(counts)


@query("graph_structure", f"""
    WITH RECURSIVE {PATHS},
    s AS (SELECT count(DISTINCT node) AS n, count(*) AS p, max(len(path) - 1) AS d, avg(len(path) - 1) AS a FROM trail)
    SELECT n AS total_nodes, p AS total_paths, d AS max_depth, round(a, 6) AS average_depth,
           round((least(d / 10.0, 1) + least(p / (n * 3), 1) + least(n / 100.0, 1)) / 3 * 100, 6) AS complexity_score FROM s""")
def _(t):
    s = deps.graph_structure(t.dep_edges)
    return s.select("total_nodes", "total_paths", F.col("max_depth").cast("long").alias("max_depth"), *r6("average_depth", "complexity_score"))


@query("scope_distribution", "SELECT scope, count(*) AS dependencies FROM repo_artifacts GROUP BY scope")
def _(t):
    return deps.scope_distribution(t.repo_artifacts)


@query("path_hubs", f"""
    WITH RECURSIVE {PATHS}, n AS (SELECT unnest(path) AS node FROM trail)
    SELECT node, count(*) AS paths FROM n GROUP BY node ORDER BY paths DESC, node LIMIT 10""")
def _(t):
    return deps.path_hubs(t.dep_edges)


@query("optimization_opportunities", f"""
    WITH RECURSIVE {PATHS}, c AS (SELECT repo, group_id, artifact_id FROM repo_artifacts GROUP BY 1, 2, 3 HAVING count(DISTINCT version) > 0)
    SELECT 'frequent_conflict' AS type, concat(group_id, ':', artifact_id) AS subject, count(*) AS value FROM c GROUP BY group_id, artifact_id HAVING count(*) > 2
    UNION ALL SELECT 'deep_chain', CAST(node AS VARCHAR), len(path) - 1 FROM trail WHERE len(path) - 1 > 8
    UNION ALL SELECT 'group_proliferation', group_id, count(*) FROM artifacts GROUP BY group_id HAVING count(*) > 5""")
def _(t):
    per_repo = t.repo_artifacts.select("repo", *deps.GA).distinct()
    return deps.optimization_opportunities(per_repo, graph.paths(t.dep_edges), t.artifacts)


@query("listed_conflicts", f"""
    WITH {CONFLICTS} SELECT group_id, artifact_id, severity FROM conflicts
    WHERE (group_id, artifact_id) IN (SELECT (group_id, artifact_id) FROM repo_artifacts WHERE repo = 7)""")
def _(t):
    return deps.list_conflicts(deps.version_conflicts(t.repo_artifacts), t.repo_artifacts, 7).select(*deps.GA, "severity")


@query("critical_conflict_count", f"""
    WITH {CONFLICTS} SELECT count(*) AS total_conflicts, count(*) FILTER (WHERE severity = 'critical') AS critical_conflicts FROM conflicts""")
def _(t):
    return deps.critical_count(deps.version_conflicts(t.repo_artifacts))


ROOTS = "roots AS (SELECT DISTINCT repo, artifact FROM repo_artifacts)"


@query("vulnerable_dependencies", f"""
    WITH RECURSIVE {CLOSURE}, {ROOTS}
    SELECT DISTINCT repo, v.artifact, cve_id, severity, score FROM roots JOIN closure ON roots.artifact = root AND root <> node JOIN vulnerabilities v ON v.artifact = node""")
def _(t):
    return deps.vulnerable_dependencies(t.repo_artifacts, t.dep_edges, t.vulnerabilities)


@query("critical_vulnerabilities", f"""
    WITH RECURSIVE {CLOSURE}, {ROOTS}
    SELECT DISTINCT repo, v.artifact, cve_id, score FROM roots JOIN closure ON roots.artifact = root AND root <> node JOIN vulnerabilities v ON v.artifact = node
    WHERE severity = 'CRITICAL'""")
def _(t):
    return deps.critical_vulnerabilities(t.repo_artifacts, t.dep_edges, t.vulnerabilities).select("repo", "artifact", "cve_id", "score")


@query("vulnerability_health", f"""
    WITH RECURSIVE {CLOSURE}, {ROOTS},
    b AS (SELECT repo, count(DISTINCT node) AS n FROM roots JOIN closure ON artifact = root AND root <> node WHERE node IN (SELECT artifact FROM vulnerabilities) GROUP BY repo),
    a AS (SELECT repo, count(*) AS total_deps FROM roots GROUP BY repo)
    SELECT repo, total_deps, coalesce(n, 0) AS vulnerable_deps, round((1.0 - coalesce(n, 0) / total_deps) * 100, 6) AS health_score FROM a LEFT JOIN b USING (repo)""")
def _(t):
    return deps.vulnerability_health(t.repo_artifacts, t.dep_edges, t.vulnerabilities).withColumn("health_score", F.round("health_score", 6))


INCOMPATIBLE = "inc(license, conflicting) AS (VALUES ('GPL-3.0', 'Apache-2.0'), ('GPL-3.0', 'MIT'))"


def incompatible(t):
    return t.licenses.select("license").distinct().where("license = 'GPL-3.0'").select(
        "license", F.explode(F.array(F.lit("Apache-2.0"), F.lit("MIT"))).alias("conflicting")
    )


@query("license_conflicts", f"""
    WITH RECURSIVE {CLOSURE}, {ROOTS}, {INCOMPATIBLE},
    h AS (SELECT repo, root, license, count(DISTINCT node) AS n FROM roots JOIN closure ON roots.artifact = root AND root <> node JOIN licenses l ON l.artifact = node GROUP BY 1, 2, 3)
    SELECT h.repo, h.root AS artifact, h.license, h.n AS dependencies, conflicting, o.n AS conflicting_dependencies
    FROM h JOIN inc ON h.license = inc.license JOIN h o ON o.repo = h.repo AND o.root = h.root AND o.license = conflicting""")
def _(t):
    return deps.license_conflicts(t.repo_artifacts, t.dep_edges, t.licenses, incompatible(t))


@query("licenses_by_repository", f"""
    WITH RECURSIVE {CLOSURE}, {ROOTS}
    SELECT DISTINCT repo, license FROM roots JOIN closure ON roots.artifact = root AND root <> node JOIN licenses l ON l.artifact = node""")
def _(t):
    return deps.licenses_by_repository(t.repo_artifacts, t.dep_edges, t.licenses)


@query("unused_dependencies", """
    WITH d AS (SELECT DISTINCT doc_id % 20 AS repo, split_part(p_name, ' ', 1) AS group_id, split_part(p_name, ' ', 2) AS artifact_id FROM documents JOIN part ON doc_id = p_partkey),
    x AS (SELECT doc_id % 20 AS repo, text FROM documents)
    SELECT repo, group_id, artifact_id FROM d WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.repo = d.repo AND (contains(text, group_id) OR contains(text, artifact_id)))""")
def _(t):
    d = t.documents.join(t.part, F.col("doc_id") == F.col("p_partkey")).selectExpr(
        "doc_id % 20 AS repo", "split_part(p_name, ' ', 1) AS group_id", "split_part(p_name, ' ', 2) AS artifact_id"
    )
    return deps.unused_dependencies(d, t.documents.selectExpr("doc_id % 20 AS repo", "text AS content"))


@query("duplicate_artifacts", """
    WITH d AS (SELECT p_brand AS group_id, p_partkey, CASE p_size % 3 WHEN 0 THEN split_part(p_name, ' ', 2) ELSE p_name END AS x FROM part),
    g AS (SELECT group_id, x, count(*) AS n FROM d GROUP BY 1, 2)
    SELECT a.group_id, a.x AS description, a.n AS artifacts, b.x AS contained, b.n AS contained_artifacts, a.n * b.n - CASE WHEN a.x = b.x THEN a.n ELSE 0 END AS pairs
    FROM g a JOIN g b ON a.group_id = b.group_id AND contains(a.x, b.x) WHERE a.x <> b.x OR a.n > 1""")
def _(t):
    d = t.part.selectExpr(
        "p_brand AS group_id", "p_partkey AS artifact_id", "CASE p_size % 3 WHEN 0 THEN split_part(p_name, ' ', 2) ELSE p_name END AS description"
    )
    return deps.duplicate_artifacts(d)


@query("closure_conflicts", f"""
    WITH RECURSIVE {CLOSURE}, c AS (SELECT root, p_brand AS group_id, p_type AS artifact_id, p_size FROM closure JOIN artifacts ON node = id JOIN part ON part = p_partkey)
    SELECT root, group_id, artifact_id, count(DISTINCT p_size) AS version_count FROM c GROUP BY 1, 2, 3 HAVING count(DISTINCT p_size) > 1""")
def _(t):
    c = t.sql("SELECT id AS node, p_brand AS group_id, p_type AS artifact_id, p_size AS version FROM artifacts JOIN part ON part = p_partkey")
    return deps.closure_conflicts(t.dep_edges, c)


@query("dependency_tree", f"""
    WITH RECURSIVE {PATHS} SELECT root, node, path[-2] AS parent, len(path) - 1 AS depth, array_to_string(path, '>') AS path FROM trail""")
def _(t):
    tree = deps.dependency_tree(graph.paths(t.dep_edges))
    return tree.select("root", "node", "parent", F.col("depth").cast("long").alias("depth"), F.array_join("path", ">").alias("path"))
