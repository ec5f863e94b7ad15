"""Queries for catalogs, keyed writes and components."""

from pyspark.sql import functions as F

from portolan.functions import extract, text
from portolan.queries.registry import query
from portolan.queries.text_queries import line_cut_sql
from portolan.sources import builds, catalog, files, stores


@query("catalog_tables", """
    SELECT schema_name, table_name, 'TABLE' AS table_type, row_count FROM db_tables WHERE row_count % 3 > 0
    UNION ALL SELECT schema_name, table_name, 'VIEW', NULL FROM db_tables WHERE row_count % 3 = 0""")
def _(t):
    d = t.db_tables
    return catalog.catalog_tables(d.where("row_count % 3 > 0"), d.where("row_count % 3 = 0").drop("row_count"))


@query("catalog_columns", """
    SELECT schema_name, table_name, column_name, column_id, comments, CASE WHEN contains(column_name, 'TYPE') THEN 'Classification/category field' WHEN contains(column_name, 'DATE') THEN 'Date/timestamp field' END AS business_purpose
    FROM db_columns""")
def _(t):
    key = ["schema_name", "table_name", "column_name"]
    c = t.db_columns
    return catalog.catalog_columns(c.select(*key, "column_id"), c.where("comments is not null").select(*key, "comments"))


@query("catalog_procedures", """
    SELECT concat('S', o_custkey % 5) AS schema_name, concat('P', o_custkey) AS object_name, string_agg(concat(o_orderpriority, ';'), '' ORDER BY o_orderkey) AS source_code
    FROM orders GROUP BY 1, 2""")
def _(t):
    s = t.orders.selectExpr("concat('S', o_custkey % 5) AS schema_name", "concat('P', o_custkey) AS object_name", "o_orderkey AS line", "concat(o_orderpriority, ';') AS text")
    objects = s.select("schema_name", "object_name", F.lit("PROCEDURE").alias("object_type")).distinct()
    return catalog.catalog_procedures(objects, s).select("schema_name", "object_name", "source_code")


@query("catalog_constraints", """
    WITH c AS (SELECT o_orderkey, concat('S', o_orderkey % 5) AS s, concat('C', o_orderkey) AS n, concat('T', o_custkey) AS t, CASE o_orderstatus WHEN 'O' THEN o_orderkey - 5 END AS r FROM orders)
    SELECT a.n AS constraint_name, a.t AS table_name, b.t AS referenced_table FROM c a LEFT JOIN c b ON a.s = b.s AND a.r = b.o_orderkey""")
def _(t):
    c = t.orders.selectExpr(
        "concat('S', o_orderkey % 5) AS schema_name", "concat('C', o_orderkey) AS constraint_name", "concat('T', o_custkey) AS table_name",
        "concat('S', o_orderkey % 5) AS r_schema_name", "CASE o_orderstatus WHEN 'O' THEN concat('C', o_orderkey - 5) END AS r_constraint_name",
    )
    return catalog.catalog_constraints(c).select("constraint_name", "table_name", "referenced_table")


@query("db_objects", """
    WITH p AS (SELECT n_name AS d, n_regionkey AS r, n_nationkey AS k FROM nation)
    SELECT d AS database, 'CONTAINS' AS rel_type, d AS src, concat('S', r) AS dst FROM p UNION ALL SELECT d, 'CONTAINS', concat('S', r), concat('S', r, '.T', k) FROM p
    UNION ALL SELECT d, 'HAS_COLUMN', concat('S', r, '.T', k), concat('S', r, '.T', k, '.ID') FROM p UNION ALL SELECT d, 'CONTAINS', concat('S', r), concat('S', r, '.V', k) FROM p
    UNION ALL SELECT d, 'DERIVES_FROM', concat('S', r, '.V', k), concat('T', k) FROM p""")
def _(t):
    p = t.nation.selectExpr(
        """concat('{"database": {"name": "', n_name, '"}, "schemas": [{"name": "S', n_regionkey, '"}], "tables": [{"schema": "S', n_regionkey, '", "name": "T', n_nationkey,
           '", "columns": [{"name": "ID", "type": "NUMBER"}]}], "views": [{"schema": "S', n_regionkey, '", "name": "V', n_nationkey, '", "derives_from": ["T', n_nationkey, '"]}]}') AS payload"""
    )
    return catalog.load_db_objects(p)["edges"]


@query("upserted_chunks", """
    WITH a AS (SELECT doc_id AS id, 1 AS v, lang FROM documents UNION ALL SELECT doc_id, 2, source FROM documents WHERE n_chars % 3 = 0 UNION ALL SELECT doc_id + 1000000, 2, source FROM documents WHERE n_chars % 7 = 0)
    SELECT id, max(v) AS updated_at, max_by(lang, v) AS label FROM a GROUP BY id""")
def _(t):
    old = t.documents.selectExpr("doc_id AS id", "1 AS updated_at", "lang AS label")
    new = t.documents.where("n_chars % 3 = 0").selectExpr("doc_id AS id", "2 AS updated_at", "source AS label")
    more = t.documents.where("n_chars % 7 = 0").selectExpr("doc_id + 1000000 AS id", "2 AS updated_at", "source AS label")
    return stores.upsert_chunks(old, new.unionByName(more))


@query("upserted_nodes", """
    WITH o AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey AS team FROM supplier WHERE s_suppkey % 3 > 0), n AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'new' END AS name, s_acctbal AS balance FROM supplier WHERE s_suppkey % 5 > 0)
    SELECT id, coalesce(n.name, o.name) AS name, team, balance FROM o FULL JOIN n USING (id)""")
def _(t):
    old = t.supplier.where("s_suppkey % 3 > 0").selectExpr("s_suppkey AS id", "s_name AS name", "s_nationkey AS team")
    new = t.supplier.where("s_suppkey % 5 > 0").selectExpr("s_suppkey AS id", "CASE WHEN s_suppkey % 2 = 0 THEN 'new' END AS name", "s_acctbal AS balance")
    return stores.upsert_nodes(old, new)


@query("upserted_edges", """
    WITH n AS (SELECT src, dst, 'CALLS' AS rel_type, 9 AS weight FROM dep_edges WHERE scope = 'test' UNION ALL SELECT dst, src, 'CALLS', 9 FROM dep_edges WHERE scope = 'test'),
    o AS (SELECT src, dst, 'CALLS' AS rel_type, 1 AS weight FROM dep_edges), m AS (SELECT DISTINCT * FROM n)
    SELECT src, dst, rel_type, coalesce(m.weight, o.weight) AS weight FROM o FULL JOIN m USING (src, dst, rel_type)""")
def _(t):
    e = t.dep_edges
    old = e.selectExpr("src", "dst", "'CALLS' AS rel_type", "1 AS weight")
    some = e.where("scope = 'test'")
    new = some.selectExpr("src", "dst", "'CALLS' AS rel_type", "9 AS weight").unionByName(some.selectExpr("dst AS src", "src AS dst", "'CALLS' AS rel_type", "9 AS weight"))
    return stores.upsert_edges(old, new.distinct())


@query("deleted_repository", """
    SELECT 'chunks' AS kind, count(*) AS deleted FROM documents WHERE source = 'src4' UNION ALL SELECT 'files', count(DISTINCT concat(source, '/', doc_id % 20, '.txt')) FROM documents WHERE source = 'src4'""")
def _(t):
    c = t.chunks
    return stores.delete_repository({"chunks": c, "files": c.select("repository", "file_path").distinct()}, "src4")[1]


@query("kept_after_delete", "SELECT doc_id AS id FROM documents WHERE source <> 'src4'")
def _(t):
    return stores.delete_repository({"chunks": t.chunks}, "src4")[0]["chunks"].select("id")


@query("tracked_repositories", """
    WITH a AS (SELECT source AS name, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chunks FROM documents GROUP BY 1), b AS (SELECT source AS name, count(*) AS files, 9 * count(*) AS chunks FROM documents WHERE lang = 'en' GROUP BY 1)
    SELECT count(*) AS repositories, CAST(sum(files) AS BIGINT) AS files, CAST(sum(chunks) AS BIGINT) AS chunks FROM (SELECT * FROM a WHERE name NOT IN (SELECT name FROM b) UNION ALL SELECT * FROM b)""")
def _(t):
    a = t.documents.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("chunks"))
    b = t.documents.where("lang = 'en'").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("files"), (F.count("*") * 9).alias("chunks"))
    return stores.tracking_totals(stores.track_repository(a, b))


@query("built_components", """
    SELECT concat(repository, ':', path, ':rule:0') AS id, 'rule' AS kind, 'Validation: form.isEmpty' AS name, 'validation' AS domain FROM source_files WHERE contains(content, 'isEmpty')
    UNION ALL SELECT concat(repository, ':', path, ':rule:1'), 'rule', 'Validation: form.isEmpty', 'validation' FROM source_files WHERE false
    UNION ALL SELECT concat(repository, ':', path, ':action:', regexp_extract(content, 'class (\\w+)', 1)), 'action', regexp_extract(content, 'class (\\w+)', 1), NULL FROM source_files WHERE contains(content, 'extends Action')
    UNION ALL SELECT concat(repository, ':', path, ':jsp'), 'jsp', 'user_interface_form', NULL FROM source_files WHERE suffix(path, '.jsp')""")
def _(t):
    return stores.build_components(t.source_files).select("id", "kind", "name", "domain")


@query("parsed_poms", """
    SELECT concat('r', p_partkey, '/pom.xml') AS path, p_brand AS group_id, concat('a', p_partkey) AS artifact_id, concat(p_size, '.0') AS version, 'war' AS packaging FROM part""")
def _(t):
    return builds.parse_poms(poms(t)).select("path", "group_id", "artifact_id", "version", "packaging")


def poms(t):
    """A build file per part, written out of its columns."""
    return t.part.selectExpr(
        "concat('r', p_partkey, '/pom.xml') AS path",
        """concat('<project xmlns="http://maven.apache.org/POM/4.0.0"><parent><groupId>', p_brand, '</groupId><artifactId>p</artifactId><version>', p_size, '.0</version></parent><artifactId>a', p_partkey,
        '</artifactId><packaging>war</packaging><properties><dep.v>', p_size, '.1</dep.v></properties><dependencies><dependency><groupId>org.', p_type, '</groupId><artifactId>$', '{project.artifactId}-x</artifactId><version>$', '{dep.v}</version><optional>true</optional></dependency>',
        '<dependency><groupId>junit</groupId><artifactId>junit</artifactId><scope>test</scope><exclusions><exclusion><groupId>e</groupId><artifactId>f</artifactId></exclusion></exclusions></dependency></dependencies></project>') AS content""",
    )


@query("pom_dependencies", """
    SELECT concat('r', p_partkey, '/pom.xml') AS path, 0 AS ord, concat('org.', p_type) AS group_id, concat('a', p_partkey, '-x') AS artifact_id, concat(p_size, '.1') AS version, 'compile' AS scope, true AS optional, '' AS exclusions FROM part
    UNION ALL SELECT concat('r', p_partkey, '/pom.xml'), 1, 'junit', 'junit', '*', 'test', false, 'e:f' FROM part""")
def _(t):
    d = builds.pom_dependencies(builds.parse_poms(poms(t)))
    return d.select("path", "ord", "group_id", "artifact_id", "version", "scope", "optional", F.coalesce(F.array_join("exclusions", ","), F.lit("")).alias("exclusions"))


@query("struts_mappings", """
    SELECT p_partkey AS file, 0 AS ord, concat('/', p_type) AS path, concat('com.', p_partkey) AS type, 'request' AS scope, 'ok:/x.jsp:false' AS forwards FROM part""")
def _(t):
    c = t.part.selectExpr(
        "p_partkey AS path",
        """concat('<struts-config><action-mappings><action path="/', p_type, '" type="com.', p_partkey, '"><forward name="ok" path="/x.jsp"/></action></action-mappings></struts-config>') AS content""",
    )
    m = builds.action_mappings(builds.parse_struts_config(c))
    return m.select("file", "ord", "path", "type", "scope", F.array_join(F.transform("forwards", lambda f: F.concat_ws(":", f["name"], f["path"], f["redirect"])), ",").alias("forwards"))


@query("file_changes", """
    SELECT CAST(doc_id % 20 AS VARCHAR) AS repository, CAST(doc_id AS VARCHAR) AS path,
           CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'removed' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS change FROM documents WHERE NOT (doc_id % 5 = 0 AND doc_id % 7 = 0)""")
def _(t):
    d = t.documents.selectExpr("CAST(doc_id % 20 AS STRING) AS repository", "CAST(doc_id AS STRING) AS path", "doc_id", "text")
    now = d.where("doc_id % 7 > 0").withColumn("digest", F.sha2("text", 256))
    then = d.where("doc_id % 5 > 0").withColumn("digest", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.sha2("text", 256)))
    return files.file_changes(now, then)


@query("incremental_chunks", f"""
    WITH RECURSIVE d AS (SELECT doc_id AS id, text AS content, source FROM documents WHERE doc_id % 7 > 0), {line_cut_sql("d")}
    SELECT concat(source, ':', id, ':', chunk_index) AS id, start::INT AS start_line, stop::INT AS end_line, md5(chunk) AS digest FROM pieces JOIN d USING (id)""")
def _(t):
    d = t.documents.selectExpr("source AS repository", "CAST(doc_id AS STRING) AS path", "doc_id", "text AS content")
    now = d.where("doc_id % 7 > 0").withColumn("digest", F.sha2("content", 256))
    then = d.where("doc_id % 5 > 0").withColumn("digest", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.sha2("content", 256)))
    from portolan.functions.chunking import line_chunks

    chunks = files.incremental_index(now, then, line_chunks(then))[1]
    return chunks.select("id", "start_line", "end_line", F.md5("chunk").alias("digest"))


@query("migration_levels", """
    SELECT id, CASE WHEN x <= 3 THEN 'low' WHEN x <= 10 THEN 'medium' ELSE 'high' END AS level FROM (
        SELECT id, CASE WHEN suffix(path, '.jsp') THEN 2 * (2 + CASE WHEN contains(content, 'ResultSet') OR contains(content, 'session.') THEN 1 ELSE 0 END) + 5 ELSE 0 END
               + CASE WHEN contains(content, 'isEmpty') THEN 1 ELSE 0 END AS x FROM source_files)""")
def _(t):
    c = F.col("content")
    page = F.col("path").endswith(".jsp")
    patterns = F.when(page, F.size(extract.jsp_complexity_patterns(c))).otherwise(0)
    rules_found = F.size(extract.validation_rules(c))
    return t.source_files.select(
        "id", extract.file_migration_complexity(patterns, F.regexp_count(c, F.lit(extract.STRUTS_TAG_NAME)) > 0, F.lit(0), rules_found).alias("level")
    )


@query("included_paths", r"""
    SELECT id, path FROM source_files
    WHERE regexp_matches(path, '\.(java|py|js|ts|jsx|tsx|go|rs|cpp|c|h|hpp|cs|php|rb|scala|kt|swift)$')
      AND NOT regexp_matches(path, '(^|/)(target|build|dist|node_modules|\.git|bin|obj|\.vscode|\.idea|__pycache__|\.pytest_cache|coverage|htmlcov|logs|tmp|temp)/')""")
def _(t):
    path = F.col("path")
    return t.source_files.where(files.is_included(path, files.INCLUDE) & ~text.is_excluded(path, files.EXCLUDE)).select("id", "path")


# every other text is written in Latin-1, which has all letters of these texts
@query("decoded_texts", "SELECT doc_id, md5(text) AS digest, length(text) AS characters FROM documents")
def _(t):
    raw = t.documents.selectExpr("doc_id", "CASE WHEN doc_id % 2 = 0 THEN encode(text, 'UTF-8') ELSE encode(text, 'ISO-8859-1') END AS bytes")
    return files.decode_text(raw).select("doc_id", F.md5("content").alias("digest"), F.length("content").cast("long").alias("characters"))


@query("parsed_logs", """
    SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, level, concat(event_id, ' ', message) AS message, CAST(component AS VARCHAR) AS component
    FROM app_logs WHERE event_id % 10 > 0 ORDER BY ts DESC, concat(event_id, ' ', message) LIMIT 100""")
def _(t):
    entry = "to_json(struct(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS timestamp, level, concat(event_id, ' ', message) AS message, cast(component AS string) AS component))"
    lines = t.app_logs.selectExpr(f"CASE WHEN event_id % 10 > 0 THEN {entry} ELSE substr({entry}, 1, 30) END AS value")
    return stores.parse_app_logs(lines).select("timestamp", "level", "message", "component")
