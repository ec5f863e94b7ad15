"""Keyed writes, deletes, tracking and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.functions import rules
from portolan.functions.text import classify_first_match
from portolan.session import written

LOG_SCHEMA = "timestamp string, level string, logger string, message string, component string, exception string"


def read_app_logs(spark: SparkSession, path: str, component: str | None = None, limit: int = 100, schema: str = LOG_SCHEMA) -> DataFrame:
    """The newest log entries of JSON-lines files; broken lines are skipped."""
    return parse_app_logs(spark.read.text(path), component, limit, schema)


def parse_app_logs(lines: DataFrame, component: str | None = None, limit: int = 100, schema: str = LOG_SCHEMA, line: str = "value") -> DataFrame:
    """The same from rows of text, one entry each."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    parsed = lines.where(F.trim(line) != "").select(F.from_json(line, f"{schema}, _broken string", options).alias("e")).select("e.*")
    logs = parsed.where("_broken IS NULL").drop("_broken")
    if component is not None:
        logs = logs.where(F.col("component") == component)
    return logs.orderBy(F.desc("timestamp"), "message").limit(limit)


def upsert_chunks(target: DataFrame, updates: DataFrame, key: str = "id", updated: str = "updated_at") -> DataFrame:
    """One row per key, the latest write; the larger row wins a tie in time."""
    rows = target.unionByName(updates, allowMissingColumns=True)
    rest = [c for c in rows.columns if c != key]
    first = [updated] + [c for c in rest if c != updated]
    latest = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in first if not rows.schema[c].dataType.typeName() == "map"]))
    return rows.groupBy(key).agg(latest.alias("r")).select(key, "r.*")


def vectors_or_none(chunks: DataFrame, vector: str = "vector") -> DataFrame:
    """Vectors are attached only if every chunk has one."""
    complete = chunks.agg(F.bool_and(F.col(vector).isNotNull())).scalar()
    return chunks.withColumn(vector, F.when(complete, F.col(vector)))


def upsert_rows(target: DataFrame, updates: DataFrame, keys: list[str], stamp: Column | None = None) -> DataFrame:
    """Merge by key; a new value wins unless it is null. ``stamp`` fills ``updated_at`` of touched rows."""
    props = [c for c in dict.fromkeys(target.columns + updates.columns) if c not in keys]
    old = target.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in target.columns if c not in keys], F.lit(True).alias("_old"))
    new = updates.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in updates.columns if c not in keys], F.lit(True).alias("_new"))
    both = old.join(new, keys, "full")

    def merged(c: str) -> Column:
        sides = [F.col(f"{p}{c}") for p, cols in (("_n_", updates.columns), ("_o_", target.columns)) if c in cols]
        return F.coalesce(*sides).alias(c)

    out = both.select(*keys, *[merged(c) for c in props if c != "updated_at"], *([merged("updated_at")] if "updated_at" in props else []), "_new")
    if stamp is not None:
        before = F.col("updated_at") if "updated_at" in props else F.lit(None).cast("timestamp")
        out = out.withColumn("updated_at", F.when(F.col("_new"), stamp).otherwise(before))
    return out.drop("_new")


def upsert_nodes(target: DataFrame, updates: DataFrame, key: str = "id", stamp: Column | None = None) -> DataFrame:
    """Nodes merged by one key."""
    return upsert_rows(target, updates, [key], stamp)


def upsert_edges(target: DataFrame, updates: DataFrame, stamp: Column | None = None) -> DataFrame:
    """Edges merged by both ends and type."""
    return upsert_rows(target, updates, ["src", "dst", "rel_type"], stamp)


def upsert_partitions(spark: SparkSession, path: str, updates: DataFrame, partition: str = "repository", key: str = "id") -> None:
    """A7 on a Parquet table partitioned by ``partition``: only partitions with updates are rewritten.

    A chunk stays in its partition. The new state is written aside first, so a failed run
    leaves the table as it was and can be repeated.
    """
    target = spark.read.schema(updates.schema).option("basePath", path).parquet(path)
    touched = target.join(updates.select(partition).distinct(), partition, "left_semi")
    merged = written(upsert_chunks(touched, updates, key).select(*updates.columns), "merged")
    # one large repository is split over several files
    merged.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def write_vectors(df: DataFrame, path: str, partition: str = "repository") -> None:
    """Chunks with vectors as Parquet, one folder per repository; failed batches keep their flag."""
    df.hint("rebalance", partition).write.mode("append").partitionBy(partition).parquet(path)


def delete_repository(tables: dict[str, DataFrame], name, col: str = "repository") -> tuple[dict[str, DataFrame], DataFrame]:
    """A10: the tables without the repository's rows, and the deleted rows counted per kind."""
    kept, counts = {}, None
    for kind, df in tables.items():
        hit = F.coalesce(F.col(col) == name, F.lit(False))
        kept[kind] = df.where(~hit)
        n = df.where(hit).agg(F.count("*").alias("deleted")).select(F.lit(kind).alias("kind"), "deleted")
        counts = n if counts is None else counts.unionByName(n)
    return kept, counts


def track_repository(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Tracked repositories by name, replaced as a whole."""
    return target.join(rows.select("name"), "name", "left_anti").unionByName(rows)


def tracking_totals(tracked: DataFrame) -> DataFrame:
    """Repositories, files and chunks tracked."""
    return tracked.agg(F.count("*").alias("repositories"), F.sum("files").alias("files"), F.sum("chunks").alias("chunks"))


def rule_components(facts: DataFrame) -> DataFrame:
    """Business rules of files as components with the id ``repository:path:rule:i``.

    ``facts`` has ``repository, path, business_rules[], migration_complexity``.
    """
    rows = facts.select("repository", "path", "migration_complexity", F.posexplode("business_rules").alias("i", "rule_text"))
    return rows.select(
        F.concat_ws(":", "repository", "path", F.lit("rule"), F.col("i").cast("string")).alias("id"), F.col("repository").cast("string").alias("repo"),
        F.lit("rule").alias("kind"), F.col("rule_text").alias("name"), classify_first_match(F.col("rule_text"), rules.RULE_DOMAIN, "general").alias("domain"),
        F.col("migration_complexity").alias("complexity"), F.lit("validation").alias("rule_type"), F.col("path").alias("file_path"),
        F.concat(F.col("path"), F.lit(":rule_"), F.col("i").cast("string")).alias("location"),
    )


def page_components(facts: DataFrame) -> DataFrame:
    """JSP pages with patterns as components. ``facts`` has ``repository, path, patterns[]`` (pattern types)."""
    purpose = classify_first_match(F.array_join("patterns", ","), [], None)
    for label, words in reversed(rules.JSP_PURPOSE):
        purpose = F.when(F.array_contains("patterns", words[0]), label).otherwise(F.coalesce(purpose, F.lit("web_presentation")))
    return facts.where(F.size("patterns") > 0).select(
        F.concat_ws(":", "repository", "path", F.lit("jsp")).alias("id"), F.col("repository").cast("string").alias("repo"), F.lit("jsp").alias("kind"),
        purpose.alias("business_purpose"), F.col("path").alias("file_path"), "patterns",
    )


def named_components(facts: DataFrame, kind: str, name: str) -> DataFrame:
    """Struts actions and CORBA interfaces as components, one per repository and name."""
    return facts.select(F.col("repository").cast("string").alias("repo"), F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col("path").alias("file_path")).dropDuplicates(
        ["repo", "kind", "name"]
    )


def build_components(files: DataFrame) -> DataFrame:
    """Every component of the given source files, ``(id, repo, kind, name, domain, file_path)``.

    ``files`` has ``repository, path, content``.
    """
    from portolan.functions import extract

    c = F.col("content")
    page = F.col("path").rlike(r"\.(jsp|tag|tagx)$")
    facts = files.withColumns(
        {
            "business_rules": extract.validation_rules(c),
            "patterns": F.when(page, F.transform(extract.jsp_complexity_patterns(c), lambda p: p["type"])).otherwise(F.array().cast("array<string>")),
            "migration_complexity": F.lit("medium"),
        }
    )
    actions = extract.find_all(c, r"class\s+(\w+)\s+extends\s+\w*Action\b")
    interfaces = extract.find_all(c, r"interface\s+(\w+)")
    text = lambda name: F.lit(None).cast("string").alias(name)
    ident = lambda kind: F.concat_ws(":", "repo", "file_path", F.lit(kind), "name").alias("id")
    found = rule_components(facts).select("id", "repo", "kind", "name", "domain", "file_path").unionByName(
        page_components(facts).select("id", "repo", "kind", F.col("business_purpose").alias("name"), text("domain"), "file_path")
    )
    for kind, hits, where in (("action", actions, ~page), ("corba", interfaces, F.col("path").endswith(".idl"))):
        named = named_components(files.where(where).select("repository", "path", F.explode(hits).alias("n")), kind, "n")
        found = found.unionByName(named.select(ident(kind), "repo", "kind", "name", text("domain"), "file_path"))
    return found
