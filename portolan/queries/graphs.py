"""Graph queries: reachability, cycles, components, waves."""

from pyspark.sql import functions as F

from portolan.operators import graph
from portolan.queries.registry import query

# closure of the artifact graph, shortest depth per pair; used inside the checks
CLOSURE = """
    walk(root, node, depth) AS (
        SELECT src, dst, 1 FROM (SELECT DISTINCT src, dst FROM dep_edges)
        UNION
        SELECT root, e.dst, depth + 1 FROM walk JOIN (SELECT DISTINCT src, dst FROM dep_edges) e ON node = e.src
        WHERE depth < 9),
    closure AS (SELECT root, node, min(depth) AS depth FROM walk GROUP BY root, node)"""


def nodes(t):
    return t.artifacts.select(F.col("id").alias("node"))


@query("hubs", """
    SELECT id AS node, coalesce(o, 0) AS out_degree, coalesce(i, 0) AS in_degree,
           coalesce(o, 0) + coalesce(i, 0) AS total_degree
    FROM artifacts
    LEFT JOIN (SELECT src, count(DISTINCT dst) AS o FROM dep_edges GROUP BY src) ON id = src
    LEFT JOIN (SELECT dst, count(DISTINCT src) AS i FROM dep_edges GROUP BY dst) ON id = dst
    ORDER BY total_degree DESC, node LIMIT 10""")
def _(t):
    return graph.hubs(nodes(t), t.dep_edges, 10)


@query("transitive_dependencies", f"""
    WITH RECURSIVE {CLOSURE}
    SELECT root, node, depth FROM closure WHERE root <> node""")
def _(t):
    return graph.transitive(t.dep_edges)


@query("transitive_dependencies_bounded", f"""
    WITH RECURSIVE {CLOSURE}
    SELECT root, node, depth FROM closure JOIN vulnerabilities ON root = artifact
    WHERE root <> node AND depth <= 3""")
def _(t):
    return graph.transitive(t.dep_edges, t.vulnerabilities.select("artifact"), 3)


PATHS = """
    trail(root, node, path, labels) AS (
        SELECT src, dst, [src, dst], [scope] FROM dep_edges WHERE src <> dst
        UNION ALL
        SELECT root, e.dst, list_append(path, e.dst), list_append(labels, e.scope)
        FROM trail JOIN dep_edges e ON node = e.src WHERE NOT list_contains(path, e.dst))"""


@query("dependency_paths", f"""
    WITH RECURSIVE {PATHS}
    SELECT root, node, len(path) - 1 AS depth, array_to_string(path, '>') AS path,
           array_to_string(labels, '>') AS scopes
    FROM trail""")
def _(t):
    every = graph.paths(t.dep_edges, label="scope")
    return every.select(
        "root", "node", F.col("depth").cast("long"), F.array_join("path", ">").alias("path"), F.array_join("labels", ">").alias("scopes")
    )


@query("dependency_counts", f"""
    WITH RECURSIVE {CLOSURE}
    SELECT root AS node, count(*) FILTER (WHERE depth = 1) AS direct_deps, count(*) AS total_deps,
           count(*) FILTER (WHERE depth > 1) AS transitive_deps
    FROM closure WHERE root <> node GROUP BY root""")
def _(t):
    return graph.reach_counts(t.dep_edges)


@query("circular_pairs", f"""
    WITH RECURSIVE {CLOSURE}
    SELECT a.root AS node_a, a.node AS node_b FROM closure a JOIN closure b ON a.root = b.node AND a.node = b.root
    WHERE a.root < a.node""")
def _(t):
    return graph.circular_pairs(t.dep_edges)


@query("cycles", f"""
    WITH RECURSIVE {PATHS}
    SELECT array_to_string(list_append(path, root), '>') AS cycle_path, len(path) + 1 AS path_length,
           CASE WHEN len(path) + 1 > 5 THEN 'high' ELSE 'medium' END AS severity
    FROM trail JOIN dep_edges e ON node = e.src AND e.dst = root WHERE root = list_min(path)""")
def _(t):
    return graph.cycles(t.dep_edges).select(
        F.array_join("cycle_path", ">").alias("cycle_path"), F.col("path_length").cast("long"), "severity"
    )


@query("critical_paths", """
    WITH RECURSIVE hot AS (SELECT src, dst FROM repo_edges WHERE criticality IN ('high', 'critical')),
    trail(root, node, path) AS (
        SELECT src, dst, [src, dst] FROM hot
        UNION ALL
        SELECT root, e.dst, list_append(path, e.dst) FROM trail JOIN hot e ON node = e.src
        WHERE NOT list_contains(path, e.dst)),
    open AS (SELECT path FROM trail JOIN hot e ON node = e.src WHERE NOT list_contains(path, e.dst))
    SELECT array_to_string(path, '>') AS path, len(path) AS path_length
    FROM trail WHERE len(path) > 2 AND path NOT IN (SELECT path FROM open)
    ORDER BY len(path) DESC, trail.path LIMIT 10""")
def _(t):
    hot = t.repo_edges.where(F.col("criticality").isin("high", "critical"))
    return graph.critical_paths(hot, 10).select(
        F.array_join("path", ">").alias("path"), F.col("path_length").cast("long")
    )


@query("repository_components", """
    WITH RECURSIVE sides AS (SELECT src, dst FROM repo_edges UNION SELECT dst, src FROM repo_edges),
    walk(root, node) AS (
        SELECT repo, repo FROM repositories
        UNION
        SELECT root, dst FROM walk JOIN sides ON node = src)
    SELECT root AS node, min(node) AS component FROM walk GROUP BY root""")
def _(t):
    return graph.components(t.repositories.select("repo"), t.repo_edges)


@query("migration_waves", """
    WITH RECURSIVE walk(node, wave) AS (
        SELECT repo, 1 FROM repositories
        UNION
        SELECT src, wave + 1 FROM walk JOIN layered_edges ON node = dst)
    SELECT node AS repo, max(wave) AS wave FROM walk GROUP BY node""")
def _(t):
    return graph.waves(t.repositories.select("repo", "complexity"), t.layered_edges, "repo", "complexity").select("repo", "wave")


# in a block the first four repositories depend on each other, and the fifth on them: the lightest goes first,
# but the last of the four is free once the others are gone
@query("migration_waves_with_cycles", """
    WITH r AS (SELECT repo, row_number() OVER (PARTITION BY repo - repo % 5 ORDER BY complexity, repo) AS n,
                      row_number() OVER (PARTITION BY repo - repo % 5, repo % 5 = 4 ORDER BY complexity, repo) AS n_four FROM repositories),
    f AS (SELECT *, max(CASE WHEN repo % 5 = 4 THEN n END) OVER (PARTITION BY repo - repo % 5) AS fifth FROM r)
    SELECT repo, CAST(CASE WHEN fifth <= 3 THEN n WHEN repo % 5 = 4 THEN 5 ELSE n_four END AS INT) AS wave FROM f""")
def _(t):
    return graph.waves(t.repositories.select("repo", "complexity"), t.repo_edges, "repo", "complexity").select("repo", "wave")


@query("isolated_nodes", """
    SELECT id AS node FROM artifacts
    WHERE id NOT IN (SELECT src FROM dep_edges) AND id NOT IN (SELECT dst FROM dep_edges)""")
def _(t):
    return graph.isolated_nodes(nodes(t), t.dep_edges)
