"""B: filters, predicates and data-quality checks over portfolio tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.functions import rules


def filter_repositories(
    df: DataFrame,
    name_patterns: list[str] | None = None,
    domains: list[str] | None = None,
    teams: list[str] | None = None,
    priorities: list[str] | None = None,
    is_golden: bool | None = None,
    has_maven: bool | None = None,
    exclude: list[str] | None = None,
) -> DataFrame:
    """Repositories that pass every given criterion; an empty criterion passes all."""
    tests: list[Column] = []
    if exclude:
        tests.append(~F.col("name").isin(exclude))
    if name_patterns:
        tests.append(reduce(lambda a, b: a | b, [F.col("name").contains(p) for p in name_patterns]))
    for col, values in (("domain", domains), ("team_owner", teams), ("priority", priorities)):
        if values:
            tests.append(F.col(col).isin(values))
    for col, flag in (("is_golden", is_golden), ("has_maven", has_maven)):
        if flag is not None:
            tests.append(F.col(col) == flag)
    return reduce(lambda d, t: d.where(t), tests, df)


def available_repositories(df: DataFrame, domain: str | None = None, framework: str | None = None, team: str | None = None) -> DataFrame:
    """Repositories by one of their domains, framework and team, in name order."""
    if domain:
        df = df.where(F.array_contains("domains", domain))
    if framework:
        df = df.where(F.col("framework") == framework)
    if team:
        df = df.where(F.col("team_owner") == team)
    return df.orderBy("name")


def select_repositories(df: DataFrame, exclude: DataFrame, order: list[str], n: int, key: str = "name") -> DataFrame:
    """Without the excluded ones, the first ``n`` in order."""
    return df.join(exclude.select(key), key, "left_anti").orderBy(*order).limit(n)


def search_repositories(df: DataFrame, text: str) -> DataFrame:
    """Text found in the name, a domain or a service, in any case."""
    low = text.lower()
    within = lambda c: F.exists(F.col(c), lambda x: F.lower(x).contains(low))
    return df.where(F.lower("name").contains(low) | within("domains") | within("services"))


def priority_rank(col: Column) -> Column:
    names = ["critical", "high", "medium", "low"]
    return reduce(lambda acc, kv: F.when(col == kv[1], kv[0]).otherwise(acc), reversed(list(enumerate(names))), F.lit(len(names)))


def order_by_priority(df: DataFrame) -> DataFrame:
    """Critical first, low last, then by name."""
    return df.orderBy(priority_rank(F.col("priority")), "name")


def filter_chunks(df: DataFrame, min_size: int = 100) -> DataFrame:
    """Chunks long enough, not blank, and no nameless variables."""
    nameless = (F.col("chunk_type") == "variable") & (F.coalesce("name", F.lit("")) == "")
    return df.where((F.length("content") >= min_size) & ~nameless & F.col("content").rlike(r"\S"))


def where_metadata(df: DataFrame, **equal) -> DataFrame:
    """Equality on metadata columns; a value of None is no filter."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), [(k, v) for k, v in equal.items() if v is not None], df)


def find_tables(df: DataFrame, schema: str, pattern: str) -> DataFrame:
    """Tables of a schema by LIKE pattern, in any case."""
    return df.where(F.col("schema_name") == schema.upper()).where(F.col("table_name").ilike(pattern)).orderBy("table_name")


def find_columns(columns: DataFrame, comments: DataFrame, schema: str, pattern: str) -> DataFrame:
    """Columns by LIKE pattern with their comments and purpose."""
    from portolan.functions.text import classify_first_match

    key = ["schema_name", "table_name", "column_name"]
    found = columns.where(F.col("schema_name") == schema.upper()).where(F.col("column_name").ilike(pattern))
    purpose = classify_first_match(F.col("column_name"), rules.CATALOG_COLUMN_PURPOSE, None, case="upper")
    return found.join(comments, key, "left").withColumn("business_purpose", purpose).orderBy(*key)


def table_exists(wanted: DataFrame, tables: DataFrame) -> DataFrame:
    """Wanted tables with a flag that tells whether the catalog has them."""
    known = tables.select("schema_name", "table_name").distinct().withColumn("_k", F.lit(True))
    return wanted.join(known, ["schema_name", "table_name"], "left").withColumn("found", F.col("_k").isNotNull()).drop("_k")


def violations(df: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """Rows ``(key, violation)`` for every check a row fails."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for text, ok in checks.items()]))
    return df.select(key, F.explode(failed).alias("violation"))


def validate_repositories(df: DataFrame, key: str = "name") -> DataFrame:
    """A name, a domain, and a complexity from 0 to 10."""
    return violations(
        df,
        key,
        {
            "name is required": F.coalesce("name", F.lit("")) != "",
            "at least one domain is required": F.size("domains") >= 1,
            "complexity must be between 0 and 10": F.col("complexity").between(0, 10),
        },
    )


def validate_flows(df: DataFrame, key: str = "name") -> DataFrame:
    """Repositories, two for a flow across repositories, and a positive effort."""
    return violations(
        df,
        key,
        {
            "at least one repository is required": F.col("repository_count") >= 1,
            "a cross-repository flow needs two repositories": ~F.col("cross_repository") | (F.col("repository_count") >= 2),
            "effort must be positive": F.col("effort_weeks") > 0,
        },
    )


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def orphan_functions(functions: DataFrame, defines: DataFrame) -> DataFrame:
    """Functions no file defines."""
    return functions.join(defines.select(F.col("dst").alias("id")), "id", "left_anti")


def empty_classes(classes: DataFrame, contains: DataFrame) -> DataFrame:
    """Classes that contain neither a function nor a property."""
    return classes.join(contains.select(F.col("src").alias("id")), "id", "left_anti")


def invalid_urls(df: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose address does not start with http:// or https://."""
    return df.where(~F.coalesce(F.col(url).rlike("^https?://.*$"), F.lit(False)))


def suspicious_requests(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row per suspicious pattern found, with the first hundred characters."""
    hits = F.array_compact(F.array(*[F.when(F.col(value).rlike(p), F.lit(p)) for p in rules.SUSPICIOUS]))
    return df.select(key, F.substring(value, 1, 100).alias("value"), F.explode(hits).alias("pattern"))
