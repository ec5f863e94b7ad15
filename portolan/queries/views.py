"""Portfolio tables bound to the given test tables.

Every view is one SQL text both Spark and DuckDB run, so a query and its check read
the same rows. Every row of the tables a view names contributes; tests/test_views.py counts them. Graphs
are kept tame by their structure: closures and paths stay within an order, cycles of repositories
within a block of five.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

VIEWS = {
    # graph of artifacts: every order line leads to the next line of its order, the last one to its part, or back
    # to the first line in every fifth order; lines have odd ids, parts even ones
    "dep_edges": """
        SELECT DISTINCT src, dst,
               CASE (src + dst) % 4 WHEN 0 THEN 'runtime' WHEN 1 THEN 'test' ELSE 'compile' END AS scope,
               (src + dst) % 9 = 0 AS optional
        FROM (SELECT l_orderkey * 16 + l_linenumber * 2 + 1 AS src,
                     CASE WHEN next_line IS NOT NULL THEN l_orderkey * 16 + next_line * 2 + 1
                          WHEN l_orderkey % 5 = 0 AND first_line < l_linenumber THEN l_orderkey * 16 + first_line * 2 + 1
                          ELSE l_partkey * 2 END AS dst
              FROM (SELECT l_orderkey, l_linenumber, l_partkey, min(l_linenumber) OVER (PARTITION BY l_orderkey) AS first_line,
                           min(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber
                                                   RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_line
                    FROM lineitem) o) e""",
    # graph of parts: every order line links its part to another one; multiples of 7 have no way out, those that
    # leave 3 no way in
    "part_edges": """
        SELECT DISTINCT src, CASE WHEN src = dst THEN src - src % 7 ELSE dst END AS dst
        FROM (SELECT CASE WHEN a % 7 > 0 THEN a WHEN b % 7 > 0 THEN b WHEN b > 0 THEN b - 1 ELSE 1 END AS src,
                     CASE WHEN a % 7 = 0 THEN a WHEN b % 7 = 3 THEN b - 1 ELSE b END AS dst
              FROM (SELECT l_partkey AS a, (l_partkey * 7 + l_orderkey) % (SELECT count(*) FROM part) AS b FROM lineitem) p) e""",
    # graph of repositories: every order line links its supplier to one of the first four of its block of five
    "repo_edges": """
        SELECT src, dst, count(*) AS weight,
               CASE (src + dst) % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS criticality,
               CASE (src + dst) % 3 WHEN 0 THEN 'CALLS' WHEN 1 THEN 'IMPORTS' ELSE 'DEPENDS_ON' END AS dependency_type
        FROM (SELECT l_suppkey AS src, l_suppkey - l_suppkey % 5 + CASE WHEN l_suppkey % 5 = l_orderkey % 4 THEN (l_orderkey + 1) % 4 ELSE l_orderkey % 4 END AS dst
              FROM lineitem) e
        GROUP BY src, dst""",
    # the same links, all pointing from the higher to the lower repository: no cycles
    "layered_edges": """
        SELECT greatest(src, dst) AS src, least(src, dst) AS dst, sum(weight) AS weight, min(criticality) AS criticality
        FROM repo_edges GROUP BY greatest(src, dst), least(src, dst)""",
    "artifacts": """
        SELECT id, p_brand AS group_id, artifact_id, concat(p_brand, ':', artifact_id) AS coordinates, p_name AS description, p_partkey AS part
        FROM (SELECT p_partkey * 2 AS id, concat('a', p_partkey) AS artifact_id, p_partkey AS own FROM part
              UNION ALL
              SELECT l_orderkey * 16 + l_linenumber * 2 + 1, concat('o', l_orderkey, 'l', l_linenumber), min(l_partkey)
              FROM lineitem GROUP BY l_orderkey, l_linenumber) x JOIN part ON own = p_partkey""",
    "repositories": """
        SELECT s_suppkey AS repo, s_name AS name, concat('team', s_nationkey) AS team_owner, r_name AS domain,
               CASE s_suppkey % 4 WHEN 0 THEN 'struts' WHEN 1 THEN 'spring' WHEN 2 THEN 'jsp' ELSE 'corba' END AS framework,
               abs(s_acctbal) / 1000 AS complexity,
               CASE WHEN s_acctbal < 0 THEN 'critical' WHEN s_acctbal < 2500 THEN 'high'
                    WHEN s_acctbal < 6000 THEN 'medium' ELSE 'low' END AS priority,
               s_suppkey % 5 = 0 AS is_golden, s_suppkey % 3 <> 0 AS has_maven,
               s_nationkey AS nation, s_acctbal AS balance
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "repo_artifacts": """
        SELECT l_suppkey AS repo, p_brand AS group_id, concat('a', l_partkey) AS artifact_id,
               l_orderkey * 16 + l_linenumber * 2 + 1 AS artifact,
               concat(l_linenumber, '.', CAST(round(l_discount * 100) AS INT) % 3, '.0') AS version,
               CASE l_returnflag WHEN 'R' THEN 'test' WHEN 'N' THEN 'runtime' ELSE 'compile' END AS scope,
               l_linenumber AS depth, l_tax > 0.07 AS optional, l_linestatus = 'F' AS managed, l_orderkey AS ord
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "vulnerabilities": """
        SELECT id AS artifact, concat('CVE-', p_partkey) AS cve_id,
               CASE WHEN p_size >= 50 THEN 'CRITICAL' ELSE 'HIGH' END AS severity, p_size / CAST(5 AS DOUBLE) AS score
        FROM artifacts JOIN part ON part = p_partkey WHERE p_size >= 48""",
    "licenses": """
        SELECT id AS artifact,
               CASE CAST(replace(group_id, 'Brand#', '') AS INT) % 3
                    WHEN 0 THEN 'Apache-2.0' WHEN 1 THEN 'MIT' ELSE 'GPL-3.0' END AS license
        FROM artifacts""",
    "components": """
        SELECT p_partkey AS id, p_partkey % (SELECT count(*) FROM supplier) AS repo,
               CASE p_type WHEN 'ECONOMY' THEN 'rule' WHEN 'LARGE' THEN 'action' WHEN 'MEDIUM' THEN 'corba'
                    WHEN 'PROMO' THEN 'jsp' WHEN 'SMALL' THEN 'file' ELSE 'class' END AS kind,
               p_name AS name, p_brand AS domain, p_retailprice / 100 AS complexity
        FROM part""",
    "repo_db": """
        SELECT DISTINCT o_custkey % (SELECT count(*) FROM supplier) AS repo, concat('T', o_custkey % 97) AS object,
               CASE o_custkey % 4 WHEN 0 THEN 'view' ELSE 'table' END AS object_type,
               CASE WHEN o_orderstatus = 'O' THEN 'READS_FROM' ELSE 'WRITES_TO' END AS rel_type
        FROM orders""",
    "flows": """
        SELECT n_nationkey AS flow, n_name AS name,
               CASE n_regionkey WHEN 0 THEN 'high' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS business_value,
               CASE n_nationkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk_level,
               n_nationkey % 7 + 1 AS effort_weeks,
               CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey END AS migration_order
        FROM nation""",
    "flow_repos": "SELECT s_nationkey AS flow, s_suppkey AS repo FROM supplier",
    "chunks": """
        SELECT doc_id AS id, text AS content, lang AS language, source AS repository,
               concat(source, '/', doc_id % 20, '.txt') AS file_path, doc_id AS chunk_index, n_chars AS size
        FROM documents""",
    "chunk_edges": """
        SELECT DISTINCT src, CASE WHEN src = dst THEN (dst + 1) % (SELECT count(*) FROM documents) ELSE dst END AS dst, rel_type
        FROM (SELECT src % (SELECT count(*) FROM documents) AS src, dst % (SELECT count(*) FROM documents) AS dst,
                     CASE src % 3 WHEN 0 THEN 'CALLS' WHEN 1 THEN 'INHERITS' ELSE 'DEPENDS_ON' END AS rel_type
              FROM part_edges) e""",
    "vectors": "SELECT vec_id AS id, embedding AS vector, label AS domain FROM embeddings",
    "questions": "SELECT concat(conv_id, ':', turn) AS query_id, text FROM conversations WHERE role = 'user'",
    "task_events": """
        SELECT event_id, user_id AS task_id, event_type AS stage, ts, value AS duration, props FROM events""",
    "request_logs": """
        SELECT event_id, user_id AS client, event_type AS endpoint, ts, value / 50 AS seconds,
               CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status
        FROM events""",
    "app_logs": """
        SELECT event_id, ts, user_id AS component, concat('code ', props) AS message,
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' WHEN 'click' THEN 'DEBUG'
                    ELSE 'INFO' END AS level
        FROM events""",
    # source files of five kinds, written out of the parts
    "source_files": """
        SELECT p_partkey AS id, p_partkey % (SELECT count(*) FROM supplier) AS repository,
               concat(CASE p_size % 6 WHEN 0 THEN 'build/' WHEN 1 THEN 'lib/node_modules/' WHEN 2 THEN 'rebuild/' ELSE 'src/' END,
                      replace(p_name, ' ', '_'), p_partkey,
                      CASE p_type WHEN 'ECONOMY' THEN 'Action.java' WHEN 'LARGE' THEN '.jsp' WHEN 'MEDIUM' THEN '.py'
                           WHEN 'PROMO' THEN '.xml' WHEN 'SMALL' THEN '.min.js' ELSE '' END) AS path,
               CASE p_type
               WHEN 'ECONOMY' THEN concat('package com.acme.', replace(p_name, ' ', '.'), ';', chr(10), 'import java.sql.Connection;', chr(10),
                    'public class Part', p_partkey, 'Action extends Action {', chr(10),
                    '  public ActionForward execute(ActionMapping mapping) {', chr(10),
                    '    if (form.isEmpty()) { return mapping.findForward("', replace(p_name, ' ', '_'), '"); }', chr(10),
                    '    String sql = "SELECT size, price FROM ', upper(replace(p_name, ' ', '_')), ' WHERE size > ', p_size, '";', chr(10),
                    '    PartService.load(', p_partkey, ');', chr(10), '  }', chr(10), '}')
               WHEN 'LARGE' THEN concat('<%@ page import="com.acme.Part" %>', chr(10), '<html:form action="/save/', replace(p_name, ' ', '/'), '">',
                    chr(10), '<bean:write property="', replace(p_name, ' ', '.'), '"/>', chr(10),
                    CASE WHEN p_size > 25 THEN '<% session.getAttribute("x"); out.println(y); %>' ELSE '<% ResultSet rs = load(); %>' END,
                    chr(10), '</html:form>')
               WHEN 'MEDIUM' THEN concat('import os', chr(10), 'class Part', p_partkey, '(Base):', chr(10), '    def get_', replace(p_name, ' ', '_'), '(self):',
                    chr(10), '        if self.size > ', p_size, ':', chr(10), '            return load(self)', chr(10), '        return None')
               WHEN 'PROMO' THEN concat('<config><name>', p_name, '</name><size>', p_size, '</size></config>')
               WHEN 'SMALL' THEN concat('function ', replace(p_name, ' ', '_'), '() { var url = "/api/', replace(p_name, ' ', '/'), '"; }')
               ELSE concat('def ', p_name, chr(10), 'import ', p_brand) END AS content
        FROM part""",
    "db_tables": """
        SELECT concat('S', c_nationkey % 5) AS schema_name, concat(c_mktsegment, '_', c_custkey) AS table_name,
               c_custkey AS row_count
        FROM customer""",
    "db_columns": """
        SELECT concat('S', p_size % 5) AS schema_name, upper(concat(p_type, '_TABLE_', p_size)) AS table_name,
               upper(concat(replace(p_name, ' ', '_'), '_', p_partkey)) AS column_name, p_partkey AS column_id,
               CASE WHEN p_size % 2 = 0 THEN p_type END AS comments, p_brand AS data_type
        FROM part""",
    "db_constraints": """
        SELECT concat('C', o_orderkey) AS constraint_name, concat('S', o_custkey % 5) AS schema_name,
               concat('T', o_custkey % 97) AS table_name, concat('T', o_orderkey % 97) AS referenced_table,
               CASE o_orderstatus WHEN 'O' THEN 'R' WHEN 'F' THEN 'P' ELSE 'C' END AS constraint_type
        FROM orders""",
}


def _needs(text: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b(?:FROM|JOIN)\s+{v}\b", text)]


def with_views(body: str) -> str:
    """``body`` with the views it names put in front as common table expressions."""
    order: list[str] = []

    def visit(text: str) -> None:
        for v in _needs(text):
            if v not in order:
                visit(VIEWS[v])
                if v not in order:
                    order.append(v)

    visit(body)
    body = body.strip()
    if not order:
        return body
    ctes = ",\n".join(f"{v} AS ({VIEWS[v].strip()})" for v in order)
    found = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if found:
        return f"WITH {found.group(1) or ''}{ctes},\n{body[found.end():]}"
    return f"WITH {ctes}\n{body}"


class Tables:
    """The given tables and the views over them, read from one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def sql(self, text: str) -> DataFrame:
        files = re.sub(
            rf"\b(FROM|JOIN)\s+({'|'.join(BASE)})\b",
            lambda m: f"{m.group(1)} parquet.`{self.folder}/{m.group(2)}.parquet`",
            with_views(text),
        )
        return self.spark.sql(files)

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        raise AttributeError(name)
