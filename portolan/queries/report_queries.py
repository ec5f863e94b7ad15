"""Report and planning queries."""

from pyspark.sql import functions as F

from portolan.operators import graph
from portolan.operators.relations import shared_db_artifacts
from portolan.plans import migration, reports
from portolan.functions import rules
from portolan.queries.registry import query
from portolan.queries.relation_queries import LEGACY, legacy
from portolan.queries.text_queries import first_match


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


GRADE = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 80 THEN 'B' WHEN {0} >= 70 THEN 'C' WHEN {0} >= 60 THEN 'D' ELSE 'F' END"

HEALTH = f"""
    ch AS (SELECT repo, count(*) AS total_chunks, count(DISTINCT domain) AS domains_count, avg(complexity) AS avg_complexity, avg(complexity / 3) AS avg_importance FROM components GROUP BY repo),
    de AS (SELECT repo, count(DISTINCT artifact_id) AS dependencies_count FROM repo_artifacts GROUP BY repo),
    co AS (SELECT repo, count(DISTINCT group_id) AS conflicts_count FROM (SELECT repo, group_id FROM repo_artifacts GROUP BY 1, 2 HAVING count(DISTINCT version) > 3) GROUP BY repo),
    he AS (SELECT repo, coalesce(total_chunks, 0) AS total_chunks, coalesce(domains_count, 0) AS domains_count, coalesce(avg_complexity, 0) AS avg_complexity,
                  coalesce(avg_importance, 0) AS avg_importance, coalesce(dependencies_count, 0) AS dependencies_count, coalesce(conflicts_count, 0) AS conflicts_count
           FROM repositories LEFT JOIN ch USING (repo) LEFT JOIN de USING (repo) LEFT JOIN co USING (repo)),
    hs AS (SELECT *, greatest(100.0 - least(conflicts_count * 5, 30) - least(greatest(avg_complexity - 5, 0) * 5, 20), 0) AS health FROM he)"""


def health(t):
    chunks = t.components.select("repo", "id", "domain", "complexity", (F.col("complexity") / 3).alias("importance"))
    deps = t.repo_artifacts.select("repo", F.col("artifact_id").alias("dependency"))
    bad = t.repo_artifacts.groupBy("repo", "group_id").agg(F.count_distinct("version").alias("n")).where("n > 3").select("repo", F.col("group_id").alias("conflict"))
    return reports.repository_health(t.repositories, chunks, deps, bad)


@query("repository_health", f"""
    WITH {HEALTH} SELECT repo, total_chunks, domains_count, round(avg_complexity, 6) AS avg_complexity, round(avg_importance, 6) AS avg_importance, dependencies_count,
           conflicts_count, round(health, 6) AS health_score, {GRADE.format('health')} AS grade FROM hs""")
def _(t):
    return health(t).select(
        "repo", "total_chunks", "domains_count", "dependencies_count", "conflicts_count", "grade", *r6("avg_complexity", "avg_importance", "health_score")
    )


@query("health_recommendations", f"""
    WITH {HEALTH} SELECT repo, 0 AS position, 'Resolve dependency conflicts to improve stability' AS recommendation FROM hs WHERE conflicts_count > 5
    UNION ALL SELECT repo, 1, 'Refactor complex code to improve maintainability' FROM hs WHERE avg_complexity > 5
    UNION ALL SELECT repo, 2, 'Consider reducing number of dependencies' FROM hs WHERE dependencies_count > 50
    UNION ALL SELECT repo, 3, 'Repository health looks good!' FROM hs WHERE conflicts_count <= 5 AND avg_complexity <= 5 AND dependencies_count <= 50""")
def _(t):
    return migration.recommendations(health(t), migration.health_rules(), ["repo"])


@query("graph_statistics", """
    WITH n AS (SELECT unnest([kind, 'Component']) AS name FROM components), e AS (SELECT rel_type AS name FROM chunk_edges)
    SELECT 'label' AS element, name, count(*) AS count FROM n GROUP BY name UNION ALL SELECT 'relationship', name, count(*) FROM e GROUP BY name
    UNION ALL SELECT 'nodes', 'total', count(*) FROM n UNION ALL SELECT 'relationships', 'total', count(*) FROM e""")
def _(t):
    return reports.graph_statistics(t.components.select(F.array("kind", F.lit("Component")).alias("labels")), t.chunk_edges)


@query("db_object_counts", f"""
    WITH c AS (SELECT DISTINCT c_custkey % (SELECT count(*) FROM supplier) AS repo, concat('T', c_nationkey) AS object FROM customer)
    SELECT 'table' AS kind, count(DISTINCT object) AS total FROM (SELECT object FROM repo_db WHERE object_type = 'table' AND repo IN {LEGACY} UNION ALL SELECT object FROM c WHERE repo IN {LEGACY})
    UNION ALL SELECT 'view', count(DISTINCT object) FROM repo_db WHERE object_type = 'view' AND rel_type = 'READS_FROM' AND repo IN {LEGACY}""")
def _(t):
    n = t.supplier.agg(F.count("*")).scalar()
    held = t.customer.select((F.col("c_custkey") % n).alias("repo"), F.concat(F.lit("T"), F.col("c_nationkey").cast("string")).alias("object"), F.lit("table").alias("object_type")).distinct()
    one = lambda kind: reports.count_db_objects(t.repo_db, held, legacy(t), kind).select(F.lit(kind).alias("kind"), "total")
    return one("table").unionByName(one("view"))


KIND = """k AS (SELECT repo, count(*) FILTER (WHERE kind = 'rule') AS business_rules, count(*) FILTER (WHERE kind = 'action') AS struts_actions,
    count(*) FILTER (WHERE kind = 'corba') AS corba_interfaces, count(*) FILTER (WHERE kind = 'jsp') AS jsp_components, count(*) FILTER (WHERE kind = 'file') AS files FROM components GROUP BY repo)"""
PROFILE = f"""{KIND},
    rl AS (SELECT repo, count(*) AS relationships FROM part_edges JOIN components ON src = id GROUP BY repo),
    pr AS (SELECT repo, coalesce(business_rules, 0) AS business_rules, coalesce(struts_actions, 0) AS struts_actions, coalesce(corba_interfaces, 0) AS corba_interfaces,
                  coalesce(jsp_components, 0) AS jsp_components, coalesce(files, 0) AS files, coalesce(relationships, 0) AS relationships
           FROM repositories LEFT JOIN k USING (repo) LEFT JOIN rl USING (repo)),
    ps AS (SELECT *, business_rules * 2 + struts_actions * 1.5 + corba_interfaces * 3 + jsp_components + files * 0.1 + relationships * 0.5 AS s FROM pr)"""


def profiles(t):
    return reports.repository_profiles(t.repositories, t.components, t.part_edges)


@query("repository_profiles", f"""
    WITH {PROFILE} SELECT repo, business_rules, struts_actions, corba_interfaces, jsp_components, files, relationships, round(CAST(s AS DOUBLE), 6) AS complexity_score,
           CASE WHEN s > 100 THEN 'CRITICAL' WHEN s > 50 THEN 'HIGH' WHEN s > 20 THEN 'MEDIUM' ELSE 'LOW' END AS migration_priority, CAST(trunc(s * 0.5) AS INT) AS estimated_effort_days,
           struts_actions > 0 AS has_struts, corba_interfaces > 0 AS has_corba, jsp_components > 0 AS has_jsp,
           CAST(struts_actions > 0 AS INT) + CAST(corba_interfaces > 0 AS INT) + CAST(jsp_components > 0 AS INT) AS legacy_framework_count FROM ps""")
def _(t):
    return profiles(t).withColumn("complexity_score", F.round("complexity_score", 6))


@query("portfolio_average", f"WITH {PROFILE} SELECT count(*) AS profiles_found, round(avg(CAST(s AS DOUBLE)), 6) AS average_complexity FROM ps")
def _(t):
    return reports.portfolio_average(profiles(t)).select("profiles_found", *r6("average_complexity"))


MIGRATION = f"""{KIND},
    o AS (SELECT src AS repo, count(*) AS ext, count(DISTINCT dst) AS deps_on FROM repo_edges GROUP BY src),
    i AS (SELECT dst AS repo, count(*) AS int, count(DISTINCT src) AS dependents FROM repo_edges GROUP BY dst),
    mj AS (SELECT repo, coalesce(business_rules, 0) AS r, coalesce(struts_actions, 0) AS a, coalesce(corba_interfaces, 0) AS c, coalesce(jsp_components, 0) AS j,
                  coalesce(ext, 0) AS ext, coalesce(int, 0) AS int, coalesce(deps_on, 0) AS deps_on, coalesce(dependents, 0) AS dependents
           FROM repositories LEFT JOIN k USING (repo) LEFT JOIN o USING (repo) LEFT JOIN i USING (repo)),
    mp AS (SELECT *, r + a + c + j AS total, least((r + a + c + j) / 100, 1) * 30 + least(c / 20, 1) * 25 + least(a / 50, 1) * 20 + least(ext / 10, 1) * 15 + least(r / 30, 1) * 10 AS s,
                  CAST(trunc((r + a + c + j) * 0.5 + c * 3 + a * 1.5 + ext * 2) AS INT) AS effort FROM mj),
    mq AS (SELECT *, CASE WHEN s >= 80 THEN 'CRITICAL' WHEN s >= 60 THEN 'HIGH' WHEN s >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM mp)"""


def migration_profiles(t):
    rels = t.repo_edges.select(F.col("src").alias("source_repo"), F.col("dst").alias("target_repo"))
    return reports.migration_profiles(t.repositories, t.components, rels)


@query("migration_profiles", f"""
    WITH {MIGRATION} SELECT repo, total AS total_components, ext AS external_dependencies, int AS internal_dependencies, deps_on AS dependencies_on, dependents,
           round(s, 6) AS migration_complexity, priority AS migration_priority, effort AS estimated_effort_days,
           concat_ws('; ', CASE WHEN c > 10 THEN concat('High CORBA complexity (', c, ' interfaces)') END, CASE WHEN ext > 5 THEN concat('Many external dependencies (', ext, ')') END) AS blockers FROM mq""")
def _(t):
    return migration_profiles(t).select(
        "repo", "total_components", "external_dependencies", "internal_dependencies", "dependencies_on", "dependents", *r6("migration_complexity"), "migration_priority",
        "estimated_effort_days", F.array_join("blockers", "; ").alias("blockers"),
    )


@query("scored_relationships", """
    WITH r AS (SELECT src, dst, CASE src % 4 WHEN 0 THEN 'IMPLEMENTS_BUSINESS_RULE' WHEN 1 THEN 'CALLS_SERVICE' WHEN 2 THEN 'DEPENDS_ON_TYPE' ELSE 'DEPENDS_ON' END AS t,
                      CASE dst % 3 WHEN 0 THEN 'BusinessRule' WHEN 1 THEN 'CORBAInterface' ELSE 'StrutsAction' END AS k, CASE dst % 2 WHEN 0 THEN 'x' ELSE '' END AS b FROM dep_edges)
    SELECT src, dst, round(0.5 + CASE t WHEN 'IMPLEMENTS_BUSINESS_RULE' THEN 0.3 WHEN 'CALLS_SERVICE' THEN 0.2 WHEN 'DEPENDS_ON_TYPE' THEN 0.1 ELSE 0 END + CASE b WHEN 'x' THEN 0.1 ELSE 0 END, 6)::DOUBLE AS confidence_score,
           CASE WHEN k = 'BusinessRule' THEN 'HIGH' WHEN t = 'CALLS_SERVICE' THEN 'MEDIUM' WHEN k = 'CORBAInterface' THEN 'HIGH' ELSE 'LOW' END AS migration_impact FROM r""")
def _(t):
    r = t.dep_edges.selectExpr(
        "src", "dst", "CASE src % 4 WHEN 0 THEN 'IMPLEMENTS_BUSINESS_RULE' WHEN 1 THEN 'CALLS_SERVICE' WHEN 2 THEN 'DEPENDS_ON_TYPE' ELSE 'DEPENDS_ON' END AS relationship_type",
        "'StrutsAction' AS source_type", "CASE dst % 3 WHEN 0 THEN 'BusinessRule' WHEN 1 THEN 'CORBAInterface' ELSE 'StrutsAction' END AS target_type",
        "CASE dst % 2 WHEN 0 THEN 'x' ELSE '' END AS business_context",
    )
    return reports.score_relationships(r).select("src", "dst", *r6("confidence_score"), "migration_impact")


@query("domain_map", "SELECT domain, count(DISTINCT repo) AS repository_count, count(*) AS business_rule_count FROM components WHERE kind = 'rule' GROUP BY domain")
def _(t):
    return reports.domain_map(t.components)


@query("domain_repositories", "SELECT DISTINCT domain, repo FROM components WHERE kind = 'rule'")
def _(t):
    return reports.domain_repositories(t.components)


@query("orphan_repositories", "SELECT p_partkey AS repo FROM part WHERE p_partkey NOT IN (SELECT repo FROM components WHERE kind = 'rule')")
def _(t):
    return reports.orphan_repositories(t.part.select(F.col("p_partkey").alias("repo")), t.components)


@query("keyword_domain_map", f"""
    WITH c AS (SELECT p_partkey % (SELECT count(*) FROM supplier) * 3 AS repo, p_type, p_size, p_brand, CASE p_size % 5 WHEN 0 THEN 'Customer Order' WHEN 1 THEN 'Catalog view' ELSE p_name END AS n FROM part),
    d AS (SELECT DISTINCT repo, p_brand AS domain FROM c WHERE p_type = 'ECONOMY' UNION
          SELECT repo, {first_match('lower(n)', rules.ACTION_DOMAIN, 'NULL')} AS domain FROM c WHERE p_type = 'LARGE')
    SELECT domain, repo FROM d WHERE domain IS NOT NULL UNION ALL SELECT 'General', s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT repo FROM d WHERE domain IS NOT NULL)""")
def _(t):
    n = t.supplier.agg(F.count("*")).scalar()
    c = t.part.select(
        (F.col("p_partkey") % n * 3).alias("repo"), F.expr("CASE p_type WHEN 'ECONOMY' THEN 'rule' WHEN 'LARGE' THEN 'action' END AS kind"), F.col("p_brand").alias("domain"),
        F.expr("CASE p_size % 5 WHEN 0 THEN 'Customer Order' WHEN 1 THEN 'Catalog view' ELSE p_name END AS name"),
    )
    return reports.keyword_domain_map(t.repositories.select("repo"), c)


SHARED = f"""
    sd AS (SELECT group_id, artifact_id, count(DISTINCT repo) AS usage_count, count(DISTINCT version) AS version_count, max(version) AS latest_version,
                  count(DISTINCT split_part(version, '.', 1)) AS majors FROM sa GROUP BY 1, 2 HAVING count(DISTINCT repo) >= 2),
    sf AS (SELECT *, version_count > 1 AS version_conflicts, {first_match("lower(concat(group_id, ':', artifact_id))", rules.DEPENDENCY_FRAMEWORK, "'other'")} AS framework_type FROM sd),
    sh AS (SELECT *, CASE WHEN version_conflicts AND (framework_type IN ('struts', 'corba', 'jsp') OR usage_count >= 5) THEN 'HIGH'
                          WHEN framework_type IN ('struts', 'corba', 'jsp') OR usage_count >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS migration_priority FROM sf),
    sc AS (SELECT *, CASE WHEN framework_type IN ('struts', 'corba') AND version_count > 2 THEN 'CRITICAL' WHEN usage_count >= 5 AND majors > 1 THEN 'HIGH'
                          WHEN framework_type IN ('logging', 'apache') THEN 'HIGH' WHEN version_count > 2 OR usage_count >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
                  CASE WHEN framework_type IN ('struts', 'corba', 'jsp') THEN concat('Coordinate ', upper(framework_type), ' migration across all repositories to unified version')
                       WHEN version_count = 2 THEN concat('Upgrade all repositories to latest version (', latest_version, ')')
                       WHEN usage_count >= 5 THEN 'Create shared library service or parent POM with unified version'
                       ELSE 'Standardize on single version across affected repositories' END AS resolution_strategy FROM sh WHERE version_conflicts)"""
# group names that belong to known frameworks
GROUPS = "CASE l_linenumber WHEN 1 THEN 'org.apache.struts' WHEN 2 THEN 'log4j' WHEN 3 THEN 'org.springframework' WHEN 4 THEN 'commons-io' WHEN 5 THEN 'javax.servlet' ELSE 'acme' END"
SA = f"""sa AS (SELECT l_suppkey AS repo, {GROUPS} AS group_id, concat('a', l_partkey % 200) AS artifact_id, concat(CAST(round(l_discount * 100) AS INT) % 4, '.', l_linenumber) AS version
    FROM lineitem)"""


def shared(t):
    return reports.shared_dependencies(shared_base(t))


def shared_base(t):
    return t.sql(f"WITH {SA} SELECT * FROM sa")


@query("shared_dependencies", f"WITH {SA}, {SHARED} SELECT group_id, artifact_id, usage_count, version_count, latest_version, version_conflicts, framework_type, migration_priority FROM sh")
def _(t):
    return shared(t).drop("major_count")


@query("shared_members", f"WITH {SA}, {SHARED} SELECT DISTINCT group_id, artifact_id, repo, version FROM sa WHERE (group_id, artifact_id) IN (SELECT (group_id, artifact_id) FROM sh)")
def _(t):
    return reports.shared_members(shared_base(t), shared(t))


@query("shared_conflicts", f"WITH {SA}, {SHARED} SELECT group_id, artifact_id, severity, resolution_strategy FROM sc")
def _(t):
    return reports.shared_conflicts(shared(t)).select("group_id", "artifact_id", "severity", "resolution_strategy")


@query("framework_distribution", f"WITH {SA}, {SHARED} SELECT framework_type, CAST(sum(usage_count) AS BIGINT) AS usages FROM sh GROUP BY 1")
def _(t):
    return reports.framework_distribution(shared(t))


CONSOLIDATION = """
    cg AS (SELECT framework_type AS framework, count(*) AS n, CAST(sum(usage_count) AS BIGINT) AS u, count(*) FILTER (WHERE version_conflicts) AS c FROM sh GROUP BY 1),
    cs AS (SELECT 'framework_consolidation' AS type, framework, n AS dependencies_count, u AS total_usage, c AS conflicts_count, CASE WHEN c > 1 THEN 'HIGH' ELSE 'MEDIUM' END AS impact,
                  concat('Consider consolidating ', n, ' ', framework, ' dependencies') AS recommendation FROM cg WHERE n >= 3
           UNION ALL SELECT 'utility_consolidation', framework, n, u, NULL, 'MEDIUM', 'Review utility libraries for duplicate functionality' FROM cg WHERE framework = 'utility' AND n >= 5)"""


@query("consolidation", f"WITH {SA}, {SHARED}, {CONSOLIDATION} SELECT * FROM cs")
def _(t):
    return reports.consolidation(shared(t))


@query("shared_recommendations", f"""
    WITH {SA}, {SHARED}, {CONSOLIDATION},
    m AS (SELECT count(*) AS t, count(*) FILTER (WHERE version_conflicts) AS c, count(*) FILTER (WHERE framework_type IN ('struts', 'corba', 'jsp')) AS l,
                 count(*) FILTER (WHERE framework_type IN ('struts', 'corba', 'jsp') AND version_conflicts) AS lc, count(*) FILTER (WHERE usage_count >= 5) AS w,
                 count(*) FILTER (WHERE usage_count >= 5 AND version_conflicts) AS wc FROM sh),
    x AS (SELECT count(*) AS n, string_agg(DISTINCT framework_type, ', ' ORDER BY framework_type) AS f FROM sc WHERE severity = 'CRITICAL'), y AS (SELECT count(*) FILTER (WHERE impact = 'HIGH') AS h FROM cs)
    SELECT 0 AS position, concat('📊 Portfolio Overview: ', t, ' shared dependencies with ', c, ' version conflicts') AS recommendation FROM m
    UNION ALL SELECT 1, concat('🚨 Critical Priority: ', n, ' critical conflicts in ', f, ' frameworks') FROM x WHERE n > 0
    UNION ALL SELECT 2, concat('🏗️ Legacy Framework Alert: ', l, ' legacy dependencies, ', lc, ' with version conflicts') FROM m WHERE l > 0
    UNION ALL SELECT 3, concat('💡 Consolidation Opportunities: ', h, ' high-impact consolidation opportunities identified') FROM y WHERE h > 0
    UNION ALL SELECT 4, concat('📈 Widely Used Dependencies: ', w, ' dependencies used by 5+ repositories, ', wc, ' have conflicts') FROM m WHERE w > 0
    UNION ALL SELECT 5, '🎯 Recommended Strategy: Address critical conflicts first, then consolidate by framework type' FROM x WHERE n > 0
    UNION ALL SELECT 6, '🎯 Recommended Strategy: Standardize versions by framework, focusing on legacy components' FROM x, m WHERE n = 0 AND c > 0""")
def _(t):
    s = shared(t)
    m = migration.shared_metrics(s, reports.shared_conflicts(s), reports.consolidation(s))
    return migration.recommendations(m, migration.shared_rules())


CLASSES = """SELECT p_partkey % (SELECT count(*) FROM supplier) AS repo, p_partkey AS id,
    concat(replace(p_name, ' ', ''), CASE p_size % 8 WHEN 0 THEN 'Action' WHEN 1 THEN 'Form' WHEN 2 THEN 'Service' WHEN 3 THEN 'DTO' WHEN 4 THEN 'Helper' ELSE '' END) AS name,
    CASE p_size % 11 WHEN 0 THEN 'Model' WHEN 1 THEN 'Action' WHEN 2 THEN 'Service' WHEN 3 THEN 'Form' END AS stereotype,
    CASE p_size % 13 WHEN 0 THEN 'com.acme.model.x' WHEN 1 THEN 'com.acme.idl' WHEN 2 THEN 'com.corba' END AS package, p_size % 17 = 0 AS is_action, p_size % 19 = 0 AS is_formbean,
    CASE WHEN p_size % 23 = 0 THEN true END AS is_corba FROM part"""


@query("portfolio_totals", f"""
    WITH c AS ({CLASSES}), s AS (SELECT * FROM c WHERE repo IN {LEGACY})
    SELECT count(*) FILTER (WHERE is_action OR stereotype = 'Action' OR suffix(name, 'Action')) AS actions,
           count(*) FILTER (WHERE is_formbean OR stereotype = 'Form' OR suffix(name, 'Form') OR suffix(name, 'FormBean')) AS forms,
           count(*) FILTER (WHERE stereotype = 'Service' OR suffix(name, 'Service')) AS services,
           count(*) FILTER (WHERE stereotype IN ('Entity', 'DTO', 'Model') OR suffix(name, 'DTO') OR suffix(name, 'Entity') OR contains(package, '.model.')) AS data_models,
           count(*) FILTER (WHERE coalesce(is_corba, false) OR contains(package, '.idl') OR contains(package, '.corba') OR suffix(name, 'Operations') OR suffix(name, 'Helper')) AS corba_interfaces,
           (SELECT count(*) FROM source_files WHERE suffix(path, '.jsp') AND repository IN {LEGACY}) AS jsps FROM s""")
def _(t):
    files = t.source_files.select(F.col("repository").alias("repo"), "id", "path", F.lit(None).cast("string").alias("extension"))
    return reports.portfolio_totals(t.sql(CLASSES), files, legacy(t))


@query("coupling_index", "SELECT CAST(least(100, sum(weight)) AS DOUBLE) AS coupling_index FROM repo_edges")
def _(t):
    return reports.coupling(t.repo_edges)


SHARED_DB = f"""
    m AS (SELECT DISTINCT object, object_type, repo FROM repo_db WHERE repo IN {LEGACY} AND (object_type = 'table' OR rel_type = 'READS_FROM')),
    o AS (SELECT object AS artifact, object_type AS type, count(*) AS n FROM m GROUP BY 1, 2 HAVING count(*) > 1)"""


@query("hotspots", f"""
    WITH {SHARED_DB}
    SELECT * FROM (SELECT concat(src, '→', dst) AS subject, 'High cross-repo dependency weight' AS reason, CASE WHEN weight >= 5 THEN 'high' ELSE 'medium' END AS severity FROM repo_edges ORDER BY weight DESC, src, dst LIMIT 5)
    UNION ALL SELECT * FROM (SELECT artifact, concat('Shared ', type, ' ', artifact), 'medium' FROM o ORDER BY n DESC, artifact, type LIMIT 5)""")
def _(t):
    s = shared_db_artifacts(t.repo_db, legacy(t)).select(F.col("object").alias("artifact"), F.col("object_type").alias("type"), "repository_count").distinct()
    return reports.hotspots(t.repo_edges, s)


@query("graphql_suggestions", f"""
    WITH c AS ({CLASSES}), s AS (SELECT DISTINCT id, name FROM c WHERE repo IN {LEGACY} AND (stereotype IN ('Entity', 'DTO', 'Model') OR suffix(name, 'DTO') OR suffix(name, 'Entity')) ORDER BY name, id LIMIT 5)
    SELECT 'type' AS kind, name AS suggestion FROM s UNION SELECT 'query', concat('get', name) FROM s UNION SELECT 'query', concat('list', name, 's') FROM s
    UNION SELECT 'mutation', concat('create', name) FROM s UNION SELECT 'mutation', concat('update', name) FROM s""")
def _(t):
    return reports.graphql_suggestions(t.sql(CLASSES), legacy(t))


SLICES = f"""
    sides AS (SELECT src, dst FROM repo_edges UNION SELECT dst, src FROM repo_edges),
    walk(root, node) AS (SELECT repo, repo FROM repositories UNION SELECT root, dst FROM walk JOIN sides ON node = src),
    mem AS (SELECT root AS repo, min(node) AS component FROM walk GROUP BY root),
    {SHARED_DB}, den AS (SELECT repo, count(*) AS shared FROM m JOIN o ON object = artifact AND object_type = type GROUP BY repo),
    ow AS (SELECT src AS repo, sum(weight) AS w FROM repo_edges GROUP BY src),
    sl AS (SELECT component, count(*) AS size, CAST(coalesce(sum(w), 0) AS DOUBLE) AS weight, CAST(coalesce(sum(shared), 0) AS BIGINT) AS shared FROM mem LEFT JOIN ow USING (repo) LEFT JOIN den USING (repo) GROUP BY 1),
    ss AS (SELECT component, size, weight AS inbound_weight, weight AS outbound_weight, shared AS shared_artifacts,
                  CAST(least(5, greatest(1, round_even((size + weight / size) / 2, 0))) AS INT) AS effort, CAST(least(5, greatest(1, round_even((shared + weight / size) / 3, 0))) AS INT) AS risk FROM sl)"""


def slices(t):
    return migration.slices(t.repositories, t.repo_edges, shared_db_artifacts(t.repo_db, legacy(t)).select("repo"))


@query("migration_slices", f"WITH RECURSIVE {SLICES} SELECT * FROM ss")
def _(t):
    return slices(t)


@query("slice_sequence", f"WITH RECURSIVE {SLICES} SELECT component, risk, effort FROM ss")
def _(t):
    return migration.slice_sequence(slices(t))


@query("slice_dependencies", f"""
    WITH RECURSIVE sides AS (SELECT src, dst FROM repo_edges WHERE src IN {LEGACY} AND dst IN {LEGACY} UNION SELECT dst, src FROM repo_edges WHERE src IN {LEGACY} AND dst IN {LEGACY}),
    walk(root, node) AS (SELECT repo, repo FROM {LEGACY} UNION SELECT root, dst FROM walk JOIN sides ON node = src),
    mem AS (SELECT root AS repo, min(node) AS component FROM walk GROUP BY root)
    SELECT DISTINCT a.component, src AS repo FROM repo_edges JOIN mem a ON dst = a.repo LEFT JOIN mem b ON src = b.repo WHERE b.component IS DISTINCT FROM a.component""")
def _(t):
    members = graph.components(legacy(t), t.repo_edges).withColumnRenamed("node", "repo")
    return migration.slice_dependencies(members, t.repo_edges)


WAVES = f"""
    walk(node, wave) AS (SELECT repo, 1 FROM repositories UNION SELECT src, wave + 1 FROM walk JOIN layered_edges ON node = dst),
    wv AS (SELECT node AS repo, max(wave) AS wave FROM walk GROUP BY node), {MIGRATION},
    ph AS (SELECT wave AS phase, count(*) AS repositories, CAST(sum(effort) AS BIGINT) AS estimated_effort_days, greatest(1, CAST(floor(sum(effort) / 5) AS INT)) AS estimated_duration_weeks,
                  count(*) > 1 AS parallel_execution, CASE WHEN bool_or(priority = 'CRITICAL') THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level FROM wv JOIN mq USING (repo) GROUP BY wave)"""


@query("migration_phases", f"WITH RECURSIVE {WAVES} SELECT * FROM ph")
def _(t):
    return migration.migration_phases(migration_profiles(t), t.layered_edges)


@query("migration_order", f"WITH RECURSIVE {WAVES} SELECT repo, wave, round(s, 6) AS migration_complexity FROM wv JOIN mq USING (repo)")
def _(t):
    return migration.migration_order(migration_profiles(t), t.layered_edges).select("repo", "wave", *r6("migration_complexity"))


PATH_COUNT = """
    hot AS (SELECT src, dst FROM layered_edges WHERE criticality IN ('high', 'critical')),
    trail(root, node, path) AS (SELECT src, dst, [src, dst] FROM hot UNION ALL SELECT root, e.dst, list_append(path, e.dst) FROM trail JOIN hot e ON node = e.src WHERE NOT list_contains(path, e.dst)),
    opn AS (SELECT path FROM trail JOIN hot e ON node = e.src WHERE NOT list_contains(path, e.dst)),
    cp AS (SELECT path, len(path) AS n FROM trail WHERE len(path) > 2 AND path NOT IN (SELECT path FROM opn) ORDER BY len(path) DESC, trail.path LIMIT 10)"""


def hot_paths(t):
    return graph.critical_paths(t.layered_edges.where(F.col("criticality").isin("high", "critical")), 10)


@query("plan_metrics", f"""
    WITH RECURSIVE {WAVES}, {PATH_COUNT},
    q AS (SELECT (SELECT CAST(sum(estimated_effort_days) AS BIGINT) FROM ph) AS e, (SELECT CAST(sum(estimated_duration_weeks) AS BIGINT) FROM ph) AS w, (SELECT count(*) FROM cp) AS p,
                 (SELECT count(*) FROM mq) AS n, (SELECT avg(s) FROM mq) AS s, (SELECT count(*) FILTER (WHERE s > 70) FROM mq) AS h)
    SELECT e AS total_effort_days, w AS estimated_timeline_weeks, n AS total_repositories, round(s, 6) AS complexity_score, h AS high_complexity_repositories, p AS critical_path_count,
           greatest(1, CAST(floor(e / 240) AS INT)) AS estimated_team_size, CAST(h > 0 AS INT) + CAST(p > 3 AS INT) AS risk_factor_count, 'MEDIUM' AS overall_risk, w > 48 AS timeline_optimistic FROM q""")
def _(t):
    p = migration_profiles(t)
    out = reports.plan_metrics(migration.migration_phases(p, t.layered_edges), p, hot_paths(t), 12)
    return out.withColumn("complexity_score", F.round("complexity_score", 6))


@query("portfolio_recommendations", f"""
    WITH RECURSIVE {MIGRATION}, {PATH_COUNT},
    m AS (SELECT count(*) AS n, avg(s) AS s, count(*) FILTER (WHERE priority = 'CRITICAL') AS cr, count(*) FILTER (WHERE ext > 5) AS hi, count(*) FILTER (WHERE c > 10) AS co, sum(effort) AS e FROM mq),
    l AS (SELECT path, n FROM cp ORDER BY n DESC, path LIMIT 1)
    SELECT 0 AS position, concat('📊 Portfolio Overview: ', n, ' repositories with average complexity ', printf('%.1f', s), '/100') AS recommendation FROM m
    UNION ALL SELECT 3, concat('⚠️ Critical Path Alert: Longest dependency chain has ', n, ' repositories, starting with ', path[1]) FROM l
    UNION ALL SELECT 4, concat('🔧 CORBA Complexity: ', co, ' repositories have heavy CORBA usage, plan extra time for modernization') FROM m WHERE co > 0
    UNION ALL SELECT 5, concat('⏱️ Estimated Total Effort: ', CAST(e AS BIGINT), ' person-days (', printf('%.1f', e / 22), ' person-months)') FROM m""")
def _(t):
    return migration.recommendations(migration.portfolio_metrics(migration_profiles(t), hot_paths(t)), migration.portfolio_rules())


@query("dependency_graph_nodes", "SELECT src AS node FROM repo_edges UNION SELECT dst FROM repo_edges")
def _(t):
    return reports.dependency_graph_nodes(t.repo_edges)


@query("dependency_graph_edges", "SELECT src, dst, CASE WHEN weight > 1 THEN 'strong' ELSE 'medium' END AS strength, criticality FROM repo_edges")
def _(t):
    return reports.dependency_graph_edges(t.repo_edges.withColumn("strength", F.expr("CASE WHEN weight > 1 THEN 'strong' END")))


@query("flow_risk", """
    WITH f AS (SELECT count(*) AS n, count(*) FILTER (WHERE risk_level = 'high') AS h, count(*) FILTER (WHERE risk_level = 'medium') AS m, count(*) FILTER (WHERE risk_level = 'low') AS l FROM flows)
    SELECT n AS total_flows, h AS high_risk_flows, m AS medium_risk_flows, l AS low_risk_flows, CASE WHEN h > n * 0.3 THEN 'high' WHEN h + m > n * 0.5 THEN 'medium' ELSE 'low' END AS overall_risk FROM f""")
def _(t):
    return reports.flow_risk(t.flows)


@query("migration_sequence", "SELECT name, migration_order, effort_weeks, risk_level FROM flows")
def _(t):
    return reports.migration_sequence(t.flows)


@query("multi_repo_summary", """
    SELECT (SELECT count(*) FROM flows) AS total_business_flows, (SELECT count(*) FROM repo_edges) AS total_dependencies,
           (SELECT count(*) FROM repo_edges WHERE dependency_type = 'CALLS') AS total_integrations, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS shared_operations""")
def _(t):
    return reports.multi_repo_summary(t.flows, t.repo_edges, t.repo_edges.where("dependency_type = 'CALLS'"), t.customer.select("c_mktsegment").distinct())


@query("flow_recommendations", """
    SELECT 0 AS position, concat('Prioritize ', count(*), ' high-value business flows for migration') AS recommendation FROM flows WHERE business_value = 'high'
    UNION ALL SELECT 1, concat('Consider starting with ', count(*), ' low-risk flows') FROM flows WHERE risk_level = 'low'
    UNION ALL SELECT 2, concat('Address ', count(*), ' critical dependencies before migration') FROM repo_edges WHERE criticality = 'critical' HAVING count(*) > 0""")
def _(t):
    return migration.recommendations(migration.flow_metrics(t.flows, t.repo_edges), migration.flow_rules())


POINTS = "SELECT src, dst, CASE WHEN weight > 1 THEN NULL ELSE dependency_type END AS integration_type, criticality AS data_sensitivity FROM repo_edges"


@query("integration_summary", f"""
    WITH p AS ({POINTS}) SELECT 'type' AS aspect, coalesce(integration_type, 'unknown') AS name, count(*) AS count FROM p GROUP BY 2
    UNION ALL SELECT 'sensitivity', coalesce(data_sensitivity, 'unknown'), count(*) FROM p GROUP BY 2""")
def _(t):
    return reports.integration_summary(t.sql(POINTS))


@query("integration_headline", f"""
    WITH p AS ({POINTS}) SELECT count(*) FILTER (WHERE data_sensitivity = 'high') AS high_sensitivity, count(*) FILTER (WHERE data_sensitivity = 'medium') AS medium_sensitivity,
           (SELECT coalesce(integration_type, 'unknown') FROM p GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_common_type FROM p""")
def _(t):
    return reports.integration_headline(t.sql(POINTS))


FILES = """SELECT repository, path, CASE WHEN suffix(path, '.java') THEN 'java' WHEN suffix(path, '.py') THEN 'python' WHEN suffix(path, '.jsp') THEN 'jsp' WHEN suffix(path, '.js') THEN 'javascript' END AS language,
    length(content) - length(replace(content, chr(10), '')) + 1 AS lines FROM source_files"""


def files(t):
    return t.sql(FILES.replace("suffix(", "endswith("))


@query("language_stats", f"WITH f AS ({FILES}) SELECT repository, language, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines FROM f WHERE language IS NOT NULL GROUP BY 1, 2")
def _(t):
    return reports.language_stats(files(t))


@query("extension_counts", "SELECT repository, lower(regexp_extract(path, '[^/](\\.[^./]*)$', 1)) AS extension, count(*) AS files FROM source_files GROUP BY 1, 2")
def _(t):
    return reports.extension_counts(t.source_files)


@query("repository_analysis", f"""
    WITH f AS ({FILES}), l AS (SELECT repository, language, count(*) AS n FROM f WHERE language IS NOT NULL GROUP BY 1, 2),
    b AS (SELECT repository, language FROM (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY n DESC, language) AS rn FROM l) WHERE rn = 1)
    SELECT f.repository, count(*) AS file_count, CAST(sum(lines) AS BIGINT) AS lines_of_code, bool_or(path = 'pom.xml') AS has_maven, false AS has_gradle, false AS has_npm, any_value(b.language) AS main_language
    FROM f LEFT JOIN b USING (repository) GROUP BY f.repository""")
def _(t):
    return reports.repository_analysis(files(t))


@query("repository_stats", """
    SELECT repository, count(*) AS total_chunks, count(DISTINCT file_path) AS total_files, CAST(sum(size) AS BIGINT) AS total_size, count(DISTINCT language) AS languages FROM chunks GROUP BY 1""")
def _(t):
    return reports.repository_stats(t.chunks)


@query("language_counts", "SELECT repository, language, count(*) AS chunks FROM chunks GROUP BY 1, 2")
def _(t):
    return reports.language_counts(t.chunks)


@query("collection_stats", "SELECT count(*) AS total_chunks, count(DISTINCT repository) AS total_repositories FROM chunks")
def _(t):
    return reports.collection_stats(t.chunks)


@query("repository_list", "SELECT DISTINCT repository FROM chunks")
def _(t):
    return reports.repository_list(t.chunks)


RESULTS = """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'completed' WHEN 'F' THEN 'failed' ELSE 'skipped' END AS status, o_custkey AS files, o_custkey * 3 AS chunks, o_totalprice / 1000 AS seconds,
    CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 1000 END AS processing_time, o_custkey % 50 AS components, o_custkey % 7 AS business_rules, o_custkey % 11 AS relationships,
    o_custkey AS file_count, CASE o_orderstatus WHEN 'F' THEN concat(o_orderpriority, ': broke at ', o_orderkey) END AS error_message FROM orders"""


@query("processing_stats", f"""
    WITH r AS ({RESULTS}) SELECT count(*) AS total_repositories, count(*) FILTER (WHERE status = 'completed') AS completed_repositories, count(*) FILTER (WHERE status = 'failed') AS failed_repositories,
           CAST(sum(files) AS BIGINT) AS total_files_processed, CAST(sum(chunks) AS BIGINT) AS total_chunks_generated, round(sum(seconds), 3) AS total_processing_time,
           round(count(*) FILTER (WHERE status = 'completed') / count(*), 6) AS success_rate, round(sum(seconds) / count(*), 4) AS average_processing_time FROM r""")
def _(t):
    s = reports.processing_stats(t.sql(RESULTS))
    return s.withColumns(
        {"total_processing_time": F.round("total_processing_time", 3), "success_rate": F.round("success_rate", 6), "average_processing_time": F.round("average_processing_time", 4)}
    )


BATCH = f"""r AS ({RESULTS}),
    bs AS (SELECT count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS c, count(*) FILTER (WHERE status = 'failed') AS f, count(*) FILTER (WHERE status = 'skipped') AS k,
                  avg(processing_time) AS a, stddev_samp(processing_time) AS d, sum(components) AS co, sum(business_rules) AS br, sum(relationships) AS re, count(*) FILTER (WHERE file_count > 1000) AS l FROM r)"""


@query("batch_stats", f"""
    WITH {BATCH} SELECT n AS total_repositories, c AS completed_repositories, f AS failed_repositories, k AS skipped_repositories, 0 AS in_progress, round(a, 4) AS average_processing_time, round(d, 4) AS stdev_processing_time,
           CAST(co AS BIGINT) AS total_components, CAST(br AS BIGINT) AS total_business_rules, CAST(re AS BIGINT) AS total_relationships, l AS large_repositories,
           round(c / 2000.0, 6) AS throughput_repos_per_hour, round(f / n * 100, 6) AS error_rate, round(c / n * 100, 6) AS progress_percentage FROM bs""")
def _(t):
    s = reports.batch_stats(t.sql(RESULTS), 7_200_000)
    four = ("average_processing_time", "stdev_processing_time")
    six = ("throughput_repos_per_hour", "error_rate", "progress_percentage")
    return s.withColumns({c: F.round(c, 4) for c in four} | {c: F.round(c, 6) for c in six})


@query("batch_insights", f"""
    WITH {BATCH}, b AS (SELECT *, c / 2000.0 AS rate, f / n * 100 AS err FROM bs)
    SELECT 0 AS position, concat('🚀 Excellent throughput: ', printf('%.1f', rate), ' repos/hour') AS recommendation FROM b WHERE rate > 20
    UNION ALL SELECT 1, concat('✅ Good throughput: ', printf('%.1f', rate), ' repos/hour') FROM b WHERE rate > 10 AND rate <= 20
    UNION ALL SELECT 2, concat('⚠️ Low throughput: ', printf('%.1f', rate), ' repos/hour - consider optimization') FROM b WHERE rate <= 10
    UNION ALL SELECT 5, concat('🚨 High error rate: ', printf('%.1f', err), '% - investigate common failure patterns') FROM b WHERE err >= 15
    UNION ALL SELECT 6, '📊 High processing time variance - some repositories significantly more complex' FROM b WHERE d > a * 0.5
    UNION ALL SELECT 7, 'Consider increasing concurrent processing limit or optimizing parsing algorithms' FROM b WHERE rate < 10
    UNION ALL SELECT 8, 'Implement more robust error handling and pre-validation of repository paths' FROM b WHERE err > 10
    UNION ALL SELECT 9, concat('Consider pre-filtering or splitting ', l, ' large repositories for better performance') FROM b WHERE l > 0""")
def _(t):
    return migration.recommendations(reports.batch_stats(t.sql(RESULTS), 7_200_000), migration.batch_rules())


@query("common_error", f"""
    WITH r AS ({RESULTS}) SELECT split_part(error_message, ':', 1) AS error_type, count(*) AS occurrences FROM r WHERE error_message IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1""")
def _(t):
    return reports.common_error(t.sql(RESULTS))


QUALITY = """SELECT p_partkey, p_size % 3 > 0 AS has_readme, CASE WHEN p_size % 4 > 0 THEN true END AS has_docs, p_size / CAST(50 AS DOUBLE) AS test_coverage,
    CASE WHEN p_size % 7 > 0 THEN p_partkey % 11 / CAST(1 AS DOUBLE) END AS complexity_score, p_size % 2 = 0 AS has_maven, p_size % 5 = 0 AS has_gradle, p_size % 9 = 0 AS has_npm FROM part"""
QUALITY_SCORE = f"""q AS ({QUALITY}),
    s AS (SELECT *, coalesce(complexity_score, 10) AS cx, least(1.0::DOUBLE, CASE WHEN has_readme THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN has_docs THEN 0.2::DOUBLE ELSE 0 END + least(test_coverage * 0.3::DOUBLE, 0.3::DOUBLE)
                 + CASE WHEN coalesce(complexity_score, 10) < 5 THEN 0.2::DOUBLE WHEN coalesce(complexity_score, 10) < 8 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN has_maven OR has_gradle OR has_npm THEN 0.1::DOUBLE ELSE 0 END) AS quality FROM q)"""


@query("repository_quality", f"WITH {QUALITY_SCORE} SELECT p_partkey, round(quality, 6) AS quality_score, quality >= 0.7::DOUBLE AND test_coverage >= 0.6::DOUBLE AND cx <= 5 AS is_golden FROM s")
def _(t):
    return reports.repository_quality(t.sql(QUALITY)).select("p_partkey", *r6("quality_score"), "is_golden")


@query("quality_recommendations", f"""
    WITH {QUALITY_SCORE} SELECT p_partkey, 0 AS position, 'Improve documentation and README' AS recommendation FROM s WHERE quality < 0.7::DOUBLE
    UNION ALL SELECT p_partkey, 1, 'Increase test coverage' FROM s WHERE test_coverage < 0.6::DOUBLE UNION ALL SELECT p_partkey, 2, 'Reduce code complexity' FROM s WHERE complexity_score > 5
    UNION ALL SELECT p_partkey, 3, 'Add proper build configuration' FROM s WHERE NOT (has_maven OR has_gradle OR has_npm)""")
def _(t):
    return migration.recommendations(reports.repository_quality(t.sql(QUALITY)), migration.quality_rules(), ["p_partkey"])


@query("store_consistency", """
    SELECT (SELECT count(*) FROM chunks) AS first_count, (SELECT count(*) FROM vectors) AS second_count, abs((SELECT count(*) FROM chunks) - (SELECT count(*) FROM vectors)) AS difference,
           (SELECT count(*) FROM chunks) = (SELECT count(*) FROM vectors) AS consistent, (SELECT count(*) FROM chunks WHERE id NOT IN (SELECT id FROM vectors)) AS only_first,
           (SELECT count(*) FROM vectors WHERE id NOT IN (SELECT id FROM chunks)) AS only_second""")
def _(t):
    return reports.consistency(t.chunks, t.vectors, "id")


@query("migration_analysis", f"""
    WITH {KIND} SELECT repo, coalesce(business_rules, 0) AS business_rules, coalesce(struts_actions, 0) AS struts_actions, coalesce(corba_interfaces, 0) AS corba_interfaces,
    coalesce(jsp_components, 0) AS jsp_components, coalesce(files, 0) AS files FROM repositories LEFT JOIN k USING (repo)""")
def _(t):
    return reports.migration_analysis(t.repositories, t.components)


@query("migration_facets", """
    SELECT DISTINCT repo, 'complexity_level' AS facet, domain AS value FROM components WHERE kind = 'file' UNION SELECT repo, 'business_purpose', name FROM components WHERE kind = 'action'""")
def _(t):
    return reports.migration_facets(t.components.select("repo", "kind", F.col("domain").alias("level"), F.col("name").alias("purpose")))


@query("selection_summary", f"SELECT CAST(sum(repo * 100) AS BIGINT) AS total_lines, round(avg(complexity), 6) AS average_complexity FROM repositories WHERE repo IN {LEGACY}")
def _(t):
    r = t.repositories.join(legacy(t), "repo", "left_semi").select((F.col("repo") * 100).alias("lines"), "complexity")
    return reports.selection_summary(r).select("total_lines", *r6("average_complexity"))


@query("refreshed_counts", "SELECT repository, count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_size_bytes FROM chunks GROUP BY 1")
def _(t):
    return reports.refresh_counts(t.chunks)


@query("pom_staleness", """
    SELECT event_id AS path, round((epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 1000000.0, 3) AS seconds_since_parsed FROM events""")
def _(t):
    poms = t.events.select(F.col("event_id").alias("path"), F.col("ts").alias("last_parsed"))
    return reports.pom_staleness(poms, t.events.agg(F.max(F.col("ts").cast("timestamp"))).scalar()).select("path", F.round("seconds_since_parsed", 3).alias("seconds_since_parsed"))


@query("facets", """
    SELECT DISTINCT 'domain' AS facet, domain AS value FROM repositories UNION SELECT 'framework', framework FROM repositories UNION SELECT 'owner', team_owner FROM repositories""")
def _(t):
    return reports.facets(t.repositories.withColumn("domains", F.array("domain")))


@query("dependency_recommendations", """
    WITH c AS (SELECT p_brand AS group_id, count(*) % 11 AS conflicts, count(*) % 2 AS cycles, count(*) FILTER (WHERE p_size >= 48) AS vulnerabilities, 100 * (count(*) % 90) AS ms, count(*) % 3 AS critical FROM part GROUP BY 1)
    SELECT group_id, 0 AS position, 'Consider consolidating dependencies to reduce version conflicts' AS recommendation FROM c WHERE conflicts > 5
    UNION ALL SELECT group_id, 1, 'Refactor code to eliminate circular dependencies' FROM c WHERE cycles > 0
    UNION ALL SELECT group_id, 2, 'Update vulnerable dependencies to secure versions' FROM c WHERE vulnerabilities > 0
    UNION ALL SELECT group_id, 3, 'Consider caching dependency resolution results' FROM c WHERE ms > 5000
    UNION ALL SELECT group_id, 4, 'Address critical version conflicts immediately' FROM c WHERE critical > 0""")
def _(t):
    n = F.count("*")
    c = t.part.groupBy(F.col("p_brand").alias("group_id")).agg(
        (n % 11).alias("conflicts"), (n % 2).alias("cycles"), F.count_if(F.col("p_size") >= 48).alias("vulnerabilities"), (n % 90 * 100).alias("resolution_time_ms"), (n % 3).alias("critical_conflicts")
    )
    return migration.recommendations(c, migration.dependency_health_rules(), ["group_id"])
