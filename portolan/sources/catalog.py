"""Database catalogs, from dictionary tables or from a nested description."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.functions import rules
from portolan.functions.text import classify_first_match

_NAMES = "ARRAY<STRUCT<name: STRING>>"
PAYLOAD = f"""database STRUCT<name: STRING>, schemas {_NAMES},
    tables ARRAY<STRUCT<schema: STRING, name: STRING, columns: ARRAY<STRUCT<name: STRING, type: STRING, nullable: BOOLEAN>>>>,
    views ARRAY<STRUCT<schema: STRING, name: STRING, derives_from: ARRAY<STRING>>>,
    procedures ARRAY<STRUCT<schema: STRING, name: STRING>>, functions ARRAY<STRUCT<schema: STRING, name: STRING>>,
    packages ARRAY<STRUCT<schema: STRING, name: STRING>>, triggers ARRAY<STRUCT<schema: STRING, name: STRING, table: STRING>>,
    foreign_keys ARRAY<STRUCT<name: STRING, from_table: STRING, to_table: STRING>>"""


def read_dictionary(spark: SparkSession, name: str, folder: str | None = None, jdbc: dict | None = None) -> DataFrame:
    """A5: one dictionary table from a folder of Parquet files or over JDBC.

    Over JDBC pass ``partitionColumn, lowerBound, upperBound, numPartitions`` to read in parallel.
    """
    if folder is not None:
        return spark.read.parquet(f"{folder.rstrip('/')}/{name}")
    return spark.read.format("jdbc").options(**(jdbc or {}), dbtable=name).load()


def catalog_tables(tables: DataFrame, views: DataFrame) -> DataFrame:
    """A5: tables and views with their comments and sizes."""
    v = views.withColumn("table_type", F.lit("VIEW")).withColumn("row_count", F.lit(None).cast("bigint"))
    return tables.withColumn("table_type", F.lit("TABLE")).unionByName(v, allowMissingColumns=True).orderBy("schema_name", "table_name")


def catalog_columns(columns: DataFrame, comments: DataFrame) -> DataFrame:
    """A5: columns with comments and purpose."""
    key = ["schema_name", "table_name", "column_name"]
    purpose = classify_first_match(F.col("column_name"), rules.CATALOG_COLUMN_PURPOSE, None, "upper")
    return columns.join(comments, key, "left").withColumn("business_purpose", purpose).orderBy("schema_name", "table_name", "column_id")


def catalog_procedures(objects: DataFrame, source: DataFrame) -> DataFrame:
    """A5: procedures and functions with their source lines put together in order."""
    key = ["schema_name", "object_name"]
    # one program's lines make one text
    text = source.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "").alias("source_code"))
    return objects.where(F.col("object_type").isin("PROCEDURE", "FUNCTION", "PACKAGE")).join(text, key, "left").orderBy(*key)


def catalog_constraints(constraints: DataFrame) -> DataFrame:
    """A5: constraints with the table a reference points to."""
    other = constraints.select(
        F.col("schema_name").alias("r_schema_name"), F.col("constraint_name").alias("r_constraint_name"), F.col("table_name").alias("referenced_table")
    )
    return constraints.join(other, ["r_schema_name", "r_constraint_name"], "left")


def load_db_objects(payloads: DataFrame, col: str = "payload") -> dict[str, DataFrame]:
    """Nodes and edges of nested database descriptions, one JSON text per row.

    Gives ``nodes(database, kind, name)`` and ``edges(database, src, dst, rel_type)``. A description
    without a database name fails the job.
    """
    p = payloads.select(F.from_json(col, T.StructType.fromDDL(PAYLOAD)).alias("p")).select("p.*")
    name = F.col("database.name")
    p = p.withColumn("db", F.when(F.coalesce(name, F.lit("")) == "", F.raise_error(F.lit("database name is required")).cast("string")).otherwise(name))
    full = lambda x: F.concat_ws(".", x["schema"], x["name"])
    nodes = [p.select("db", F.lit("database").alias("kind"), F.col("db").alias("name"))]
    edges = []

    def edge(rows: DataFrame, src, dst, kind: str) -> None:
        edges.append(rows.select("db", src.alias("src"), dst.alias("dst"), F.lit(kind).alias("rel_type")))

    s = p.select("db", F.explode("schemas").alias("x"))
    nodes.append(s.select("db", F.lit("schema").alias("kind"), F.col("x.name").alias("name")))
    edge(s, F.col("db"), F.col("x.name"), "CONTAINS")
    for col_name, kind in (("tables", "table"), ("views", "view"), ("procedures", "procedure"), ("functions", "function"), ("packages", "package"), ("triggers", "trigger")):
        rows = p.select("db", F.explode(col_name).alias("x"))
        nodes.append(rows.select("db", F.lit(kind).alias("kind"), full(F.col("x")).alias("name")))
        edge(rows, F.col("x.schema"), full(F.col("x")), "CONTAINS")
        if kind == "table":
            cols = rows.select("db", full(F.col("x")).alias("t"), F.explode("x.columns").alias("c"))
            nodes.append(cols.select("db", F.lit("column").alias("kind"), F.concat_ws(".", "t", "c.name").alias("name")))
            edge(cols, F.col("t"), F.concat_ws(".", "t", "c.name"), "HAS_COLUMN")
        elif kind == "view":
            edge(rows.select("db", full(F.col("x")).alias("v"), F.explode("x.derives_from").alias("b")), F.col("v"), F.col("b"), "DERIVES_FROM")
        elif kind == "trigger":
            edge(rows.where("x.table is not null"), full(F.col("x")), F.col("x.table"), "TRIGGERS_ON")
    fk = p.select("db", F.explode("foreign_keys").alias("x"))
    edge(fk, F.col("x.from_table"), F.col("x.to_table"), "REFERENCES_TABLE")

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.withColumnRenamed("db", "database").distinct()

    return {"nodes": union(nodes), "edges": union(edges)}
