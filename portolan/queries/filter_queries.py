"""Filter and data-quality queries."""

from pyspark.sql import functions as F

from portolan.functions import rules, text
from portolan.operators import filters
from portolan.queries.registry import query


def lit_list(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def repositories(t):
    return t.repositories.withColumn("domains", F.array("domain", "framework")).withColumn("services", F.array("team_owner"))


@query("excluded_paths", """
    SELECT path FROM source_files WHERE regexp_matches(path, '(^|/)(build|node_modules)/') OR path LIKE '%.min.js'""")
def _(t):
    return t.source_files.where(text.is_excluded(F.col("path"), ["**/build/**", "**/node_modules/**", "*.min.js"])).select("path")


@query("languages", """
    SELECT path, CASE WHEN suffix(path, '.py') THEN 'python' WHEN suffix(path, '.js') THEN 'javascript'
        WHEN suffix(path, '.java') THEN 'java' WHEN suffix(path, '.jsp') THEN 'jsp' WHEN suffix(path, '.xml') THEN 'xml'
        WHEN contains(content, 'def ') AND contains(content, 'import ') THEN 'python' END AS language FROM source_files""")
def _(t):
    return t.source_files.select("path", text.detect_language(F.col("path"), F.col("content")).alias("language"))


@query("filtered_repositories", """
    SELECT name FROM repositories WHERE name NOT IN ('Supplier#000000009') AND (contains(name, '00') OR contains(name, '9'))
    AND domain IN ('ASIA', 'EUROPE', 'AFRICA') AND priority IN ('high', 'medium', 'low') AND has_maven AND NOT is_golden""")
def _(t):
    return filters.filter_repositories(
        t.repositories, ["00", "9"], ["ASIA", "EUROPE", "AFRICA"], None, ["high", "medium", "low"], False, True, ["Supplier#000000009"]
    ).select("name")


@query("available_repositories", "SELECT name, framework, team_owner FROM repositories WHERE domain = 'ASIA' AND framework = 'struts' ORDER BY name")
def _(t):
    return filters.available_repositories(repositories(t), "ASIA", "struts").select("name", "framework", "team_owner")


@query("selected_repositories", """
    SELECT name FROM repositories WHERE priority <> 'critical' ORDER BY name LIMIT 20""")
def _(t):
    r = t.repositories
    return filters.select_repositories(r, r.where("priority = 'critical'"), ["name"], 20).select("name")


@query("searched_repositories", """
    SELECT name FROM repositories WHERE contains(lower(name), 'spring') OR contains(lower(domain), 'spring')
    OR contains(lower(framework), 'spring') OR contains(lower(team_owner), 'spring')""")
def _(t):
    return filters.search_repositories(repositories(t), "SPRING").select("name")


@query("repositories_by_priority", "SELECT name, priority FROM repositories")
def _(t):
    return filters.order_by_priority(t.repositories.select("name", "priority"))


@query("quality_chunks", """
    SELECT doc_id FROM documents WHERE length(text) >= 500 AND NOT (source = 'src3') AND regexp_matches(text, '\\S')""")
def _(t):
    c = t.documents.selectExpr("doc_id", "text AS content", "CASE source WHEN 'src3' THEN 'variable' ELSE 'file' END AS chunk_type", "CAST(NULL AS STRING) AS name")
    return filters.filter_chunks(c, 500).select("doc_id")


@query("chunks_by_metadata", "SELECT id, file_path FROM chunks WHERE repository = 'src7' AND language = 'en'")
def _(t):
    return filters.where_metadata(t.chunks, repository="src7", language="en", file_path=None).select("id", "file_path")


@query("found_tables", "SELECT table_name, row_count FROM db_tables WHERE schema_name = 'S2' AND table_name ILIKE '%mach%_1%'")
def _(t):
    return filters.find_tables(t.db_tables, "s2", "%mach%_1%").select("table_name", "row_count")


@query("found_columns", """
    SELECT schema_name, table_name, column_name, comments,
           CASE WHEN contains(column_name, 'AMOUNT') THEN 'Financial amount field' WHEN contains(column_name, 'TYPE') THEN 'Classification/category field'
                WHEN contains(column_name, 'STATUS') THEN 'Status indicator field' WHEN contains(column_name, 'DATE') THEN 'Date/timestamp field'
                WHEN suffix(column_name, 'ID') THEN 'Identifier field' END AS business_purpose
    FROM db_columns WHERE schema_name = 'S1' AND column_name ILIKE '%ring%'""")
def _(t):
    key = ["schema_name", "table_name", "column_name"]
    c = t.db_columns
    return filters.find_columns(c.select(*key), c.where("comments is not null").select(*key, "comments"), "s1", "%ring%")


@query("table_presence", """
    SELECT DISTINCT schema_name, table_name, (schema_name, table_name) IN (SELECT (schema_name, table_name) FROM db_tables WHERE row_count % 2 = 0) AS found
    FROM db_tables""")
def _(t):
    d = t.db_tables
    return filters.table_exists(d.select("schema_name", "table_name").distinct(), d.where("row_count % 2 = 0"))


@query("repository_violations", """
    SELECT s_name AS name, 'at least one domain is required' AS violation FROM supplier WHERE s_nationkey = 3
    UNION ALL SELECT s_name, 'complexity must be between 0 and 10' FROM supplier WHERE NOT s_acctbal / 800 BETWEEN 0 AND 10""")
def _(t):
    r = t.supplier.selectExpr("s_name AS name", "CASE s_nationkey WHEN 3 THEN array() ELSE array('a') END AS domains", "s_acctbal / 800 AS complexity")
    return filters.validate_repositories(r)


@query("flow_violations", """
    WITH f AS (SELECT n_name AS name, n_nationkey % 4 AS c, n_regionkey > 1 AS x, n_nationkey % 5 AS e FROM nation)
    SELECT name, 'at least one repository is required' AS violation FROM f WHERE c < 1
    UNION ALL SELECT name, 'a cross-repository flow needs two repositories' FROM f WHERE x AND c < 2
    UNION ALL SELECT name, 'effort must be positive' FROM f WHERE e <= 0""")
def _(t):
    f = t.nation.selectExpr("n_name AS name", "n_nationkey % 4 AS repository_count", "n_regionkey > 1 AS cross_repository", "n_nationkey % 5 AS effort_weeks")
    return filters.validate_flows(f)


@query("duplicate_keys", "SELECT group_id, description, count(*) AS occurrences FROM artifacts GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return filters.check_unique(t.artifacts, ["group_id", "description"])


@query("orphan_functions", """
    SELECT id FROM components WHERE kind = 'action' AND id NOT IN (SELECT dst FROM part_edges)""")
def _(t):
    return filters.orphan_functions(t.components.where("kind = 'action'").select("id"), t.part_edges)


@query("empty_classes", "SELECT id FROM components WHERE kind = 'class' AND id NOT IN (SELECT src FROM part_edges)")
def _(t):
    return filters.empty_classes(t.components.where("kind = 'class'").select("id"), t.part_edges)


@query("invalid_urls", "SELECT page_id FROM pages WHERE NOT regexp_matches(replace(url, 'http://m.', 'ftp://'), '^https?://')")
def _(t):
    return filters.invalid_urls(t.pages.withColumn("url", F.expr("replace(url, 'http://m.', 'ftp://')"))).select("page_id")


@query("suspicious_requests", f"""
    SELECT page_id, substr(html, 1, 100) AS value, pattern
    FROM pages, (SELECT unnest([{lit_list(rules.SUSPICIOUS)}]) AS pattern) p
    WHERE regexp_matches(html, pattern)""")
def _(t):
    return filters.suspicious_requests(t.pages, "page_id", "html")
