"""Queries that join chunks, components, repositories, flows and database objects."""

from pyspark.sql import functions as F

from portolan.operators import relations as rel
from portolan.queries.registry import query
from portolan.queries.text_queries import first_match
from portolan.functions import rules


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


@query("code_relationships", """
    SELECT DISTINCT src AS id, CASE rel_type WHEN 'CALLS' THEN 'calls' WHEN 'INHERITS' THEN 'inherits' ELSE 'depends_on' END AS relation, CAST(dst AS VARCHAR) AS other FROM chunk_edges
    UNION SELECT dst, CASE rel_type WHEN 'CALLS' THEN 'called_by' ELSE 'inherited_by' END, CAST(src AS VARCHAR) FROM chunk_edges WHERE rel_type <> 'DEPENDS_ON'
    UNION SELECT id, 'domain', CAST(domain AS VARCHAR) FROM vectors WHERE id IN (SELECT id FROM chunks)""")
def _(t):
    return rel.code_relationships(t.chunks, t.chunk_edges, t.vectors)


@query("domain_dependencies", """
    SELECT a.domain AS source_domain, b.domain AS target_domain, count(*) AS dependency_count, count(DISTINCT src) AS source_chunks, count(DISTINCT dst) AS target_chunks
    FROM chunk_edges JOIN vectors a ON src = a.id JOIN vectors b ON dst = b.id WHERE a.domain <> b.domain GROUP BY 1, 2""")
def _(t):
    return rel.domain_dependencies(t.vectors, t.chunk_edges)


def numbered_chunks(t):
    return t.chunks.selectExpr(
        "id", "file_path", "CASE WHEN id % 10 = 3 THEN id - 1 END AS parent_id", "CAST(size % 400 AS INT) AS start_line", "CAST(size % 400 + size % 30 AS INT) AS end_line"
    )


@query("related_chunks", """
    WITH c AS (SELECT id, file_path, CASE WHEN id % 10 = 3 THEN id - 1 END AS parent_id, size % 400 AS s, size % 400 + size % 30 AS e FROM chunks)
    SELECT id, parent_id AS related, 'parent' AS reason FROM c WHERE parent_id IS NOT NULL
    UNION SELECT parent_id, id, 'child' FROM c WHERE parent_id IS NOT NULL
    UNION SELECT src, dst, 'edge' FROM chunk_edges UNION SELECT dst, src, 'edge' FROM chunk_edges
    UNION SELECT a.id, b.id, 'near' FROM c a JOIN c b ON a.file_path = b.file_path AND a.id <> b.id AND abs(b.s - a.e) <= 10""")
def _(t):
    return rel.related_chunks(numbered_chunks(t), t.chunk_edges)


@query("similar_names", """
    WITH n AS (SELECT p_brand AS file_path, p_name AS name, count(*) AS chunks FROM part GROUP BY 1, 2),
    p AS (SELECT a.file_path, a.name, a.chunks, b.name AS similar_name, b.chunks AS similar_chunks,
                 CASE WHEN a.name = b.name THEN 1.0 ELSE len(list_filter(range(1, least(length(a.name), length(b.name)) + 1), lambda i: substr(a.name, 1, i) = substr(b.name, 1, i)))
                 / greatest(length(a.name), length(b.name)) END AS similarity
          FROM n a JOIN n b ON a.file_path = b.file_path AND (a.name <> b.name OR a.chunks > 1))
    SELECT file_path, name, chunks, similar_name, similar_chunks, round(similarity, 6) AS similarity FROM p WHERE similarity > 0.5""")
def _(t):
    return rel.similar_names(t.part.selectExpr("p_brand AS file_path", "p_name AS name")).withColumn("similarity", F.round("similarity", 6))


def nodes(t):
    return t.components.selectExpr("id", "repo", "CASE kind WHEN 'file' THEN 'File' WHEN 'class' THEN 'Class' ELSE 'Rule' END AS label")


SUBGRAPH = """
    WITH RECURSIVE w(id, depth) AS (
        SELECT id, 0 FROM components WHERE repo = 7
        UNION SELECT dst, depth + 1 FROM w JOIN part_edges ON id = src WHERE depth < 2),
    m AS (SELECT id, min(depth) AS depth FROM w GROUP BY id),
    d AS (SELECT id, depth, CASE kind WHEN 'file' THEN 'File' WHEN 'class' THEN 'Class' ELSE 'Unknown' END AS label FROM m JOIN components USING (id) ORDER BY depth, id LIMIT 300)"""


@query("subgraph_nodes", f"{SUBGRAPH} SELECT id, depth, label FROM d")
def _(t):
    return rel.subgraph(nodes(t), t.part_edges, 7).select("id", "depth", "label")


@query("subgraph_edges", f"{SUBGRAPH} SELECT DISTINCT src, dst FROM part_edges WHERE src IN (SELECT id FROM d) AND dst IN (SELECT id FROM d) ORDER BY 1, 2 LIMIT 800")
def _(t):
    return rel.inner_edges(t.part_edges, rel.subgraph(nodes(t), t.part_edges, 7))


@query("incident_edges", """
    SELECT DISTINCT src, dst FROM part_edges WHERE src IN (SELECT id FROM components WHERE repo = 7) OR dst IN (SELECT id FROM components WHERE repo = 7) ORDER BY 1, 2 LIMIT 200""")
def _(t):
    return rel.incident_edges(nodes(t), t.part_edges, 7)


@query("member_nodes", "SELECT id, kind FROM components WHERE repo = 7 ORDER BY id LIMIT 100")
def _(t):
    return rel.member_nodes(t.components, 7).select("id", "kind")


@query("renamed_edges", "SELECT src, dst, CASE rel_type WHEN 'INHERITS' THEN 'DEPENDS_ON' ELSE rel_type END AS rel_type FROM chunk_edges")
def _(t):
    return rel.rename_edges(t.chunk_edges, "INHERITS", "DEPENDS_ON")


CALLERS = """
    CASE WHEN p_size % 3 = 0 THEN concat('x = ServiceLocator.get("', p_name, '")') WHEN p_size % 3 = 1 THEN concat('long ', p_name, '(in string s)') ELSE 'none' END"""


@query("cross_repo_references", f"""
    WITH c AS (SELECT repo, kind, name, {CALLERS} AS text FROM components JOIN part ON id = p_partkey),
    s AS (SELECT repo, kind, text, count(*) AS n FROM c WHERE kind = 'corba' OR (kind = 'action' AND contains(text, 'ServiceLocator.')) GROUP BY 1, 2, 3),
    g AS (SELECT repo, kind, name, count(*) AS n FROM c WHERE kind IN ('rule', 'action', 'corba', 'jsp') GROUP BY 1, 2, 3)
    SELECT s.repo AS source_repo, s.kind AS source_type, g.repo AS target_repo, g.kind AS target_type, g.name AS target_component,
           CASE s.kind WHEN 'action' THEN 'CALLS_SERVICE' ELSE 'DEPENDS_ON_TYPE' END AS relationship_type, CAST(sum(s.n * g.n) AS BIGINT) AS weight
    FROM s JOIN g ON contains(s.text, g.name) AND s.repo <> g.repo WHERE s.kind = 'action' OR g.kind = 'corba' GROUP BY ALL""")
def _(t):
    # parts pack so well in their file that Spark may take them for small enough to send to every task
    c = t.components.join(t.part.hint("merge"), F.col("id") == F.col("p_partkey")).selectExpr("repo", "kind", "name", f"{CALLERS} AS text")
    return rel.cross_repo_references(c)


@query("cross_repo_rule_edges", """
    SELECT src, dst, a.repo AS source_repo, b.repo AS target_repo, concat('Cross-domain: ', a.domain, ' -> ', b.domain) AS business_context
    FROM part_edges JOIN components a ON src = a.id JOIN components b ON dst = b.id WHERE a.kind = 'rule' AND b.kind = 'rule' AND a.repo <> b.repo""")
def _(t):
    return rel.cross_repo_rule_edges(t.components, t.part_edges).select("src", "dst", "source_repo", "target_repo", "business_context")


@query("cross_repo_calls", """
    SELECT src, dst, a.repo AS source_repo, b.repo AS target_repo, a.name AS action, b.name AS interface
    FROM part_edges JOIN components a ON src = a.id JOIN components b ON dst = b.id
    WHERE a.kind = 'action' AND b.kind = 'corba' AND a.repo <> b.repo AND a.repo IN (SELECT repo FROM repositories) AND b.repo IN (SELECT repo FROM repositories)""")
def _(t):
    return rel.cross_repo_calls(t.components, t.part_edges, t.repositories.select("repo"))


@query("multi_domain_rules", """
    SELECT a.id, a.name, count(DISTINCT b.domain) AS domain_count FROM components a JOIN part_edges ON a.id = src JOIN components b ON b.id = dst
    WHERE a.kind = 'rule' GROUP BY 1, 2 HAVING count(DISTINCT b.domain) > 1""")
def _(t):
    return rel.multi_domain_rules(t.components.where("kind = 'rule'"), t.part_edges, t.components)


@query("service_complexity", """
    SELECT team_owner AS service, domain, round(avg(c), 6) AS avg_complexity FROM repositories JOIN (SELECT repo, complexity AS c FROM components) USING (repo) GROUP BY 1, 2""")
def _(t):
    r = t.repositories
    s = r.select(F.col("team_owner").alias("service"), "domain").distinct()
    return rel.service_complexity(s, r.select("repo", F.col("team_owner").alias("service")), t.components).select("service", "domain", *r6("avg_complexity"))


@query("domain_members", "SELECT id, name FROM components WHERE domain = 'Brand#7'")
def _(t):
    return rel.domain_members(t.components, "Brand#7")


@query("repository_pairs", "SELECT a.name AS source, b.name AS target FROM (SELECT DISTINCT src, dst FROM repo_edges) JOIN repositories a ON src = a.repo JOIN repositories b ON dst = b.repo")
def _(t):
    return rel.repository_pairs(t.repo_edges, t.repositories)


def legacy(t):
    """The selection most portfolio questions start from: repositories on legacy frameworks."""
    return t.repositories.where("framework <> 'spring'").select("repo")


LEGACY = "(SELECT repo FROM repositories WHERE framework <> 'spring')"


@query("flows_for_selection", f"""
    WITH p AS (SELECT DISTINCT flow, repo FROM flow_repos WHERE repo IN {LEGACY})
    SELECT flow, name, business_value, migration_order, count(*) OVER (PARTITION BY flow) AS repository_count, repo FROM p JOIN flows USING (flow)""")
def _(t):
    return rel.flows_for(t.flows, t.flow_repos, legacy(t)).select("flow", "name", "business_value", "migration_order", "repository_count", "repo")


@query("repo_dependencies", f"""
    SELECT src, dst, CAST(weight AS DOUBLE) AS weight, criticality FROM repo_edges WHERE src IN {LEGACY} OR dst IN {LEGACY}""")
def _(t):
    return rel.repo_dependencies(t.repo_edges, legacy(t)).select("src", "dst", "weight", "criticality")


@query("shared_operations", f"""
    SELECT c_mktsegment AS operation, count(DISTINCT c_custkey % (SELECT count(*) FROM supplier)) AS repository_count FROM customer
    WHERE c_custkey % (SELECT count(*) FROM supplier) IN {LEGACY} GROUP BY 1 HAVING count(DISTINCT c_custkey % (SELECT count(*) FROM supplier)) > 1""")
def _(t):
    n = t.supplier.agg(F.count("*")).scalar()
    ops = t.customer.select(F.col("c_mktsegment").alias("operation"), (F.col("c_custkey") % n).alias("repo"))
    return rel.shared_operations(ops.select("operation").distinct(), ops, legacy(t))


@query("migration_impact", f"""
    WITH p AS (SELECT DISTINCT flow, repo FROM flow_repos WHERE repo IN {LEGACY}),
    c AS (SELECT repo, count(*) AS n FROM components GROUP BY repo)
    SELECT flow, name, effort_weeks, risk_level, count(*) AS affected_repositories, CAST(coalesce(sum(n), 0) AS BIGINT) AS component_rows
    FROM p JOIN flows USING (flow) LEFT JOIN c USING (repo) GROUP BY 1, 2, 3, 4""")
def _(t):
    out = rel.migration_impact(t.flows, t.flow_repos, t.components, legacy(t))
    return out.select("flow", "name", "effort_weeks", "risk_level", "affected_repositories", "component_rows")


@query("integration_points", f"SELECT src, dst, dependency_type, criticality AS data_sensitivity FROM repo_edges WHERE src IN {LEGACY}")
def _(t):
    return rel.integration_points(t.repo_edges.select("src", "dst", "dependency_type", F.col("criticality").alias("data_sensitivity")), legacy(t))


@query("code_table_edges", """
    WITH s AS (SELECT p_partkey, unnest([upper(p_type) || '_TABLE_' || p_size, upper(p_name)]) AS t FROM part),
    k AS (SELECT DISTINCT schema_name, lower(table_name) AS table_name FROM db_columns)
    SELECT p_partkey, schema_name, table_name FROM s JOIN k ON t = upper(table_name)""")
def _(t):
    s = t.part.selectExpr("p_partkey", "array(concat(upper(p_type), '_TABLE_', p_size), upper(p_name)) AS tables")
    k = t.db_columns.selectExpr("schema_name", "lower(table_name) AS table_name").distinct()
    return rel.code_table_edges(s, k)


@query("fk_edges", """
    WITH k AS (SELECT DISTINCT concat('S', c_nationkey % 5) AS s, concat('T', c_custkey % 97) AS n FROM customer WHERE c_custkey % 3 > 0)
    SELECT DISTINCT schema_name, table_name AS src, referenced_table AS dst, constraint_name FROM db_constraints
    WHERE constraint_type = 'R' AND (schema_name, table_name) IN (SELECT (s, n) FROM k) AND (schema_name, referenced_table) IN (SELECT (s, n) FROM k)""")
def _(t):
    k = t.customer.where("c_custkey % 3 > 0").selectExpr("concat('S', c_nationkey % 5) AS schema_name", "concat('T', c_custkey % 97) AS table_name")
    return rel.fk_edges(t.db_constraints, k)


@query("view_lineage", """
    WITH v AS (SELECT concat('V', src) AS view, CASE dst % 3 WHEN 0 THEN concat('V', dst) ELSE concat('a', dst) END AS base FROM part_edges)
    SELECT DISTINCT view AS src, base AS dst, 'table' AS dst_type FROM v WHERE base IN (SELECT artifact_id FROM artifacts)
    UNION SELECT view, base, 'view' FROM v WHERE base IN (SELECT view FROM v)""")
def _(t):
    v = t.part_edges.selectExpr("concat('V', src) AS view", "CASE dst % 3 WHEN 0 THEN concat('V', dst) ELSE concat('a', dst) END AS base")
    views = v.select("view", F.array("base").alias("derives_from"))
    return rel.view_lineage(views, t.artifacts.select(F.col("artifact_id").alias("table_name")))


@query("shared_db_artifacts", f"""
    WITH m AS (SELECT DISTINCT object, object_type, repo FROM repo_db WHERE repo IN {LEGACY} AND (object_type = 'table' OR rel_type = 'READS_FROM'))
    SELECT * FROM (SELECT object, object_type, repo, count(*) OVER (PARTITION BY object, object_type) AS repository_count FROM m) WHERE repository_count > 1""")
def _(t):
    return rel.shared_db_artifacts(t.repo_db, legacy(t))


FIELDS = "CASE p_size % 4 WHEN 0 THEN p_name WHEN 1 THEN 'customer name' WHEN 2 THEN 'status' ELSE lower(p_type) END"
SOURCES = f"""
    f AS (SELECT DISTINCT {FIELDS} AS field, CASE WHEN p_size % 3 = 0 THEN lower(p_type) ELSE '' END AS context FROM part),
    fp AS (SELECT field, context, unnest(CASE field WHEN 'customer name' THEN ['%CUSTOMER_NAME%', '%CUST_NAME%', '%NAME%'] WHEN 'status' THEN ['%STATUS%', '%STATUS_CODE%', '%STAT_CD%']
               ELSE list_concat([concat('%', upper(replace(field, ' ', '_')), '%'), concat('%', replace(field, ' ', ''), '%'), concat('%', replace(field, ' ', '_'), '%')],
                    CASE WHEN contains(field, ' ') THEN [concat('%', upper(concat(substr(split_part(field, ' ', 1), 1, 3), substr(split_part(field, ' ', 2), 1, 3))), '%')] ELSE [] END) END) AS pattern,
               unnest(range(0, CASE WHEN field IN ('customer name', 'status') THEN 3 WHEN contains(field, ' ') THEN 4 ELSE 3 END)) AS pattern_no FROM f),
    src AS (SELECT field, context, pattern_no, schema_name, table_name, column_name, column_id, coalesce(comments, {first_match('upper(column_name)', rules.COLUMN_PURPOSE, "'Business data field'")}) AS business_purpose,
                   {first_match('upper(table_name)', rules.TABLE_CONTEXT, "'business_data'")} AS table_context
            FROM fp JOIN db_columns ON column_name ILIKE pattern WHERE context = '' OR contains(lower(table_name), context)),
    conf AS (SELECT field, context, least(max(
        CASE WHEN replace(field, ' ', '_') = lower(column_name) THEN 0.4 WHEN contains(lower(column_name), replace(field, ' ', '')) THEN 0.3
             WHEN contains(lower(column_name), split_part(field, ' ', 1)) OR (contains(field, ' ') AND contains(lower(column_name), split_part(field, ' ', 2))) THEN 0.2 ELSE 0 END
        + CASE WHEN context <> '' THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(business_purpose), field) THEN 0.2 ELSE 0 END
        + CASE WHEN contains(field, 'account') AND table_context = 'account_management' THEN 0.1 ELSE 0 END), 1.0) AS confidence FROM src GROUP BY 1, 2),
    top AS (SELECT *, row_number() OVER (PARTITION BY field, context ORDER BY schema_name, pattern_no, table_name, column_name, column_id) AS rank FROM src)"""


def sources(t):
    f = t.part.selectExpr(f"{FIELDS} AS field", "CASE WHEN p_size % 3 = 0 THEN lower(p_type) ELSE '' END AS context")
    return rel.find_data_sources(f, t.db_columns)


@query("data_sources", f"WITH {SOURCES} SELECT field, context, rank, schema_name, table_name, column_name, business_purpose, table_context FROM top WHERE rank <= 5")
def _(t):
    return rel.top_sources(sources(t)).select("field", "context", "rank", "schema_name", "table_name", "column_name", "business_purpose", "table_context")


@query("source_confidence", f"WITH {SOURCES} SELECT field, context, CAST(round(confidence, 6) AS DOUBLE) AS confidence FROM conf")
def _(t):
    return rel.source_confidence(sources(t)).select("field", "context", *r6("confidence"))


@query("data_flow", f"""
    WITH {SOURCES} SELECT field, context, rank, 'database_source' AS step, 'oracle_table' AS type, concat(schema_name, '.', table_name) AS name, column_name AS column,
           business_purpose, CAST(round(confidence, 6) AS DOUBLE) AS confidence FROM top JOIN conf USING (field, context) WHERE rank <= 3""")
def _(t):
    return rel.trace_data_flow(sources(t)).withColumn("confidence", F.round("confidence", 6))


CHECKS = """SELECT concat('S', p_size % 5) AS schema_name, upper(concat(p_type, '_TABLE_', p_size)) AS table_name, CASE WHEN p_size % 2 = 0 THEN 'C' ELSE 'P' END AS constraint_type,
    concat(lower(upper(concat(replace(p_name, ' ', '_'), '_', p_partkey))), ' > ', p_size) AS condition FROM part"""


@query("related_rules", f"""
    WITH {SOURCES}, k AS ({CHECKS}),
    s AS (SELECT DISTINCT field, schema_name, table_name, column_name FROM src),
    r AS (SELECT DISTINCT field, 0 AS o, concat('Database constraint: ', condition) AS rule FROM s JOIN k USING (schema_name, table_name)
          WHERE constraint_type = 'C' AND contains(upper(condition), column_name)
          UNION ALL SELECT DISTINCT field, 1, 'Status must be valid code from lookup table' FROM s WHERE contains(field, 'status')
          UNION ALL SELECT DISTINCT field, 2, 'Status transitions must follow business rules' FROM s WHERE contains(field, 'status'))
    SELECT field, rule, rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY o, rule) AS rank FROM r) WHERE rank <= 5""")
def _(t):
    return rel.related_rules(sources(t), t.sql(CHECKS))


PROCEDURES = """SELECT concat('S', p_size % 5) AS schema_name, concat('PROC_', upper(replace(p_name, ' ', '_')), '_', p_partkey) AS object_name,
    concat('BEGIN update ', upper(concat(p_type, '_TABLE_', p_size)), ' set x = 1; END') AS source_code FROM part"""


@query("related_procedures", f"""
    WITH {SOURCES}, k AS ({PROCEDURES}),
    s AS (SELECT DISTINCT field, schema_name, table_name, column_name FROM src),
    r AS (SELECT DISTINCT field, concat(schema_name, '.', object_name) AS procedure FROM s JOIN k USING (schema_name)
          WHERE contains(lower(object_name), field) OR contains(lower(object_name), replace(field, '_', '')) OR contains(lower(object_name), replace(field, ' ', '_'))
             OR contains(lower(source_code), lower(column_name)) OR contains(lower(source_code), lower(table_name)))
    SELECT field, procedure, rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY procedure) AS rank FROM r) WHERE rank <= 5""")
def _(t):
    return rel.related_procedures(sources(t), t.sql(PROCEDURES))


@query("domain_tables", """
    WITH d AS (SELECT schema_name, replace(table_name, 'MACHINERY', 'ACCT_CUSTOMER_ACCOUNT') AS table_name, row_count FROM db_tables)
    SELECT schema_name, table_name, row_count, pattern, 'account' AS business_domain FROM d, (VALUES ('%ACCOUNT%'), ('%ACCT%')) p(pattern) WHERE table_name ILIKE pattern""")
def _(t):
    return rel.domain_tables(t.db_tables.withColumn("table_name", F.expr("replace(table_name, 'MACHINERY', 'ACCT_CUSTOMER_ACCOUNT')")), "account")
