"""F: reports over repositories, files, chunks, dependencies and batches.

Every branch of a report is aggregated on its own before the branches are joined, so
no branch multiplies the rows of another. Weights, limits, levels and texts are fixed
values: they must equal what portfolio users see today.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.functions import rules
from portolan.functions.text import classify_first_match, severity_rank
from portolan.operators.dependencies import grade

KINDS = {"rule": "business_rules", "action": "struts_actions", "corba": "corba_interfaces", "jsp": "jsp_components", "file": "files"}


def join_branches(base: DataFrame, key: str, branches: list[DataFrame], fill=0) -> DataFrame:
    """Left joins of aggregated branches, missing numbers filled."""
    return reduce(lambda d, b: d.join(b, key, "left"), branches, base).na.fill(fill)


def kind_counts(components: DataFrame, kinds: dict[str, str] = KINDS) -> DataFrame:
    """Components per repository and kind, one column per kind."""
    return components.groupBy("repo").agg(*[F.count_if(F.col("kind") == k).alias(name) for k, name in kinds.items()])


# repositories ----------------------------------------------------------------------


def repository_health(repos: DataFrame, chunks: DataFrame, dependencies: DataFrame, conflicts: DataFrame) -> DataFrame:
    """chunk, domain, dependency and conflict counts with score and grade.

    ``chunks(repo, id, domain, complexity, importance)``, ``dependencies(repo, dependency)``,
    ``conflicts(repo, conflict)``.
    """
    per_chunk = chunks.groupBy("repo").agg(
        F.count("*").alias("total_chunks"),
        F.count_distinct("domain").alias("domains_count"),
        F.avg("complexity").alias("avg_complexity"),
        F.avg("importance").alias("avg_importance"),
    )
    deps = dependencies.groupBy("repo").agg(F.count_distinct("dependency").alias("dependencies_count"))
    bad = conflicts.groupBy("repo").agg(F.count_distinct("conflict").alias("conflicts_count"))
    out = join_branches(repos.select("repo"), "repo", [per_chunk, deps, bad])
    lost = F.least(F.col("conflicts_count") * 5, F.lit(30)) + F.least(
        F.greatest(F.col("avg_complexity") - 5, F.lit(0.0)) * 5, F.lit(20.0)
    )
    score = F.greatest(F.lit(100.0) - lost, F.lit(0.0))
    return out.withColumn("health_score", score).withColumn("grade", grade(F.col("health_score")))


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """rows ``(element, name, count)`` per node label and relationship type, and their totals."""
    labels = nodes.select(F.explode("labels").alias("name")).groupBy("name").agg(F.count("*").alias("count"))
    types = edges.groupBy(F.col("rel_type").alias("name")).agg(F.count("*").alias("count"))
    tag = lambda df, what: df.select(F.lit(what).alias("element"), "name", "count")
    total = lambda df, what: df.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("count")).select(
        F.lit(what).alias("element"), F.lit("total").alias("name"), "count"
    )
    return tag(labels, "label").unionByName(tag(types, "relationship")).unionByName(total(labels, "nodes")).unionByName(total(types, "relationships"))


def count_db_objects(direct: DataFrame, contained: DataFrame, repos: DataFrame, kind: str) -> DataFrame:
    """distinct objects of a kind the selected repositories touch or contain."""
    # fixed values: the edges that count for each kind
    touching = {"table": ["READS_FROM", "WRITES_TO"], "view": ["READS_FROM"], "procedure": ["CALLS_DB_PROC"], "trigger": []}[kind]
    picked = repos.toDF("repo")
    used = direct.where((F.col("object_type") == kind) & F.col("rel_type").isin(touching)).join(picked, "repo", "left_semi").select("object")
    held = contained.where(F.col("object_type") == kind).join(picked, "repo", "left_semi").select("object")
    return used.unionByName(held).agg(F.count_distinct("object").alias("total"))


def repository_profiles(repos: DataFrame, components: DataFrame, edges: DataFrame) -> DataFrame:
    """component counts, complexity, priority and effort per repository.

    ``edges(src, dst)`` join components; an edge counts for the repository of its source.
    """
    out = edges.join(components.select(F.col("id").alias("src"), "repo"), "src").groupBy("repo").agg(F.count("*").alias("relationships"))
    r = join_branches(repos.select("repo"), "repo", [kind_counts(components), out])
    c = F.col
    score = (
        c("business_rules") * 2 + c("struts_actions") * 1.5 + c("corba_interfaces") * 3 + c("jsp_components") * 1 + c("files") * 0.1 + c("relationships") * 0.5
    ).cast("double")
    r = r.withColumn("complexity_score", score)
    s = F.col("complexity_score")
    has = {"has_struts": c("struts_actions") > 0, "has_corba": c("corba_interfaces") > 0, "has_jsp": c("jsp_components") > 0}
    return r.withColumns(
        {
            "migration_priority": F.when(s > 100, "CRITICAL").when(s > 50, "HIGH").when(s > 20, "MEDIUM").otherwise("LOW"),
            "estimated_effort_days": (s * 0.5).cast("int"),
            **has,
            "legacy_framework_count": sum((h.cast("int") for h in has.values()), F.lit(0)),
        }
    )


def portfolio_average(profiles: DataFrame) -> DataFrame:
    """repositories and their mean complexity."""
    return profiles.agg(F.count("*").alias("profiles_found"), F.coalesce(F.avg("complexity_score"), F.lit(0.0)).alias("average_complexity"))


def migration_profiles(repos: DataFrame, components: DataFrame, rels: DataFrame) -> DataFrame:
    """complexity from 0 to 100, priority, effort, blockers and neighbour counts.

    ``rels(source_repo, target_repo)`` has one row per relationship across repositories.
    The neighbours themselves are the distinct pairs of ``rels``.
    """
    out = rels.groupBy(F.col("source_repo").alias("repo")).agg(
        F.count("*").alias("external_dependencies"), F.count_distinct("target_repo").alias("dependencies_on")
    )
    into = rels.groupBy(F.col("target_repo").alias("repo")).agg(
        F.count("*").alias("internal_dependencies"), F.count_distinct("source_repo").alias("dependents")
    )
    kinds = {k: v for k, v in KINDS.items() if k != "file"}
    r = join_branches(repos.select("repo"), "repo", [kind_counts(components, kinds), out, into])
    c = F.col
    total = c("business_rules") + c("struts_actions") + c("corba_interfaces") + c("jsp_components")
    share = lambda col, full, points: F.least(col / full, F.lit(1.0)) * points
    score = (
        share(total, 100, 30) + share(c("corba_interfaces"), 20, 25) + share(c("struts_actions"), 50, 20) + share(c("external_dependencies"), 10, 15) + share(c("business_rules"), 30, 10)
    )
    effort = total * 0.5 + c("corba_interfaces") * 3 + c("struts_actions") * 1.5 + c("external_dependencies") * 2
    r = r.withColumns({"total_components": total, "migration_complexity": score, "estimated_effort_days": effort.cast("int")})
    s = c("migration_complexity")
    blockers = F.array_compact(
        F.array(
            F.when(c("corba_interfaces") > 10, F.concat(F.lit("High CORBA complexity ("), c("corba_interfaces").cast("string"), F.lit(" interfaces)"))),
            F.when(c("external_dependencies") > 5, F.concat(F.lit("Many external dependencies ("), c("external_dependencies").cast("string"), F.lit(")"))),
        )
    )
    return r.withColumns(
        {"migration_priority": F.when(s >= 80, "CRITICAL").when(s >= 60, "HIGH").when(s >= 30, "MEDIUM").otherwise("LOW"), "blockers": blockers}
    )


def score_relationships(rels: DataFrame) -> DataFrame:
    """confidence and migration impact of a relationship across repositories."""
    t = F.col("relationship_type")
    base = F.when(t == "IMPLEMENTS_BUSINESS_RULE", 0.3).when(t == "CALLS_SERVICE", 0.2).when(t == "DEPENDS_ON_TYPE", 0.1).otherwise(0.0)
    known = F.when(F.coalesce("business_context", F.lit("")) != "", 0.1).otherwise(0.0)
    either = lambda kind: (F.col("source_type") == kind) | (F.col("target_type") == kind)
    impact = F.when(either("BusinessRule"), "HIGH").when(t == "CALLS_SERVICE", "MEDIUM").when(either("CORBAInterface"), "HIGH").otherwise("LOW")
    return rels.withColumns({"confidence_score": F.least(base + known + 0.5, F.lit(1.0)), "migration_impact": impact})


def domain_map(components: DataFrame) -> DataFrame:
    """F16: domains with their rules and repositories counted."""
    rule = components.where("kind = 'rule' and domain is not null")
    return rule.groupBy("domain").agg(F.count_distinct("repo").alias("repository_count"), F.count("*").alias("business_rule_count")).orderBy(
        F.desc("business_rule_count"), "domain"
    )


def domain_repositories(components: DataFrame) -> DataFrame:
    """F16: one row per domain and repository."""
    return components.where("kind = 'rule' and domain is not null").select("domain", "repo").distinct()


def orphan_repositories(repos: DataFrame, components: DataFrame) -> DataFrame:
    """F16: repositories without a rule that has a domain."""
    return repos.select("repo").join(components.where("kind = 'rule' and domain is not null"), "repo", "left_anti")


def keyword_domain_map(repos: DataFrame, components: DataFrame) -> DataFrame:
    """F16, keyword form: domains of rules and of action purposes, ``General`` where there is none."""
    named = components.where("kind = 'rule' and domain is not null").select("repo", "domain")
    purpose = components.where("kind = 'action'").select(
        "repo", classify_first_match(F.col("name"), rules.ACTION_DOMAIN, None).alias("domain")
    ).where("domain is not null")
    both = named.unionByName(purpose).distinct()
    rest = repos.select("repo").join(both, "repo", "left_anti").withColumn("domain", F.lit("General"))
    return both.unionByName(rest).select("domain", "repo")


# shared artifacts ------------------------------------------------------------------


def shared_dependencies(repo_artifacts: DataFrame, least: int = 2) -> DataFrame:
    """artifacts two or more repositories use. The latest version is the largest as text."""
    ga = ["group_id", "artifact_id"]
    users = repo_artifacts.select(*ga, "repo").distinct().groupBy(*ga).agg(F.count("repo").alias("usage_count"))
    head = F.split("version", r"\.")[0]
    # the heads of distinct versions, not of rows
    each = repo_artifacts.select(*ga, "version").distinct().withColumn("major", F.when(head.rlike(r"^\d+$"), head.cast("bigint")))
    seen = each.groupBy(*ga, "major").agg(F.count("version").alias("n"), F.max("version").alias("latest"))
    facts = seen.groupBy(*ga).agg(F.sum("n").alias("version_count"), F.max("latest").alias("latest_version"), F.count("major").alias("major_count"))
    facts = facts.withColumnsRenamed({c: f"_{c}" for c in ga})
    per = users.join(facts, F.col("group_id").eqNullSafe(F.col("_group_id")) & F.col("artifact_id").eqNullSafe(F.col("_artifact_id"))).drop("_group_id", "_artifact_id")
    kind = classify_first_match(F.concat_ws(":", "group_id", "artifact_id"), rules.DEPENDENCY_FRAMEWORK, "other")
    shared = per.where(F.col("usage_count") >= least).withColumns({"version_conflicts": F.col("version_count") > 1, "framework_type": kind})
    legacy, clash, n = F.col("framework_type").isin(rules.LEGACY_FRAMEWORKS), F.col("version_conflicts"), F.col("usage_count")
    priority = F.when(clash & (legacy | (n >= 5)), "HIGH").when(legacy | (n >= 3), "MEDIUM").otherwise("LOW")
    return shared.withColumn("migration_priority", priority).orderBy(F.desc("usage_count"), "group_id", "artifact_id")


def shared_members(repo_artifacts: DataFrame, shared: DataFrame) -> DataFrame:
    """one row per shared artifact, repository and version."""
    return repo_artifacts.select("group_id", "artifact_id", "repo", "version").distinct().join(shared, ["group_id", "artifact_id"], "left_semi")


def shared_conflicts(shared: DataFrame) -> DataFrame:
    """severity and way out of version conflicts among shared artifacts, the worst first."""
    f, v, n = F.col("framework_type"), F.col("version_count"), F.col("usage_count")
    severity = (
        F.when(f.isin("struts", "corba") & (v > 2), "CRITICAL")
        .when((n >= 5) & (F.col("major_count") > 1), "HIGH")
        .when(f.isin("logging", "apache"), "HIGH")
        .when((v > 2) | (n >= 3), "MEDIUM")
        .otherwise("LOW")
    )
    strategy = (
        F.when(f.isin(rules.LEGACY_FRAMEWORKS), F.concat(F.lit("Coordinate "), F.upper(f), F.lit(" migration across all repositories to unified version")))
        .when(v == 2, F.concat(F.lit("Upgrade all repositories to latest version ("), F.col("latest_version"), F.lit(")")))
        .when(n >= 5, "Create shared library service or parent POM with unified version")
        .otherwise("Standardize on single version across affected repositories")
    )
    out = shared.where("version_conflicts").withColumns({"severity": severity, "resolution_strategy": strategy})
    return out.orderBy(severity_rank(F.col("severity")), "group_id", "artifact_id")


def framework_distribution(shared: DataFrame) -> DataFrame:
    """usages per framework."""
    return shared.groupBy("framework_type").agg(F.sum("usage_count").alias("usages"))


def consolidation(shared: DataFrame) -> DataFrame:
    """frameworks with three or more shared artifacts, and utilities with five or more."""
    per = shared.groupBy(F.col("framework_type").alias("framework")).agg(
        F.count("*").alias("dependencies_count"),
        F.sum("usage_count").alias("total_usage"),
        F.count_if("version_conflicts").alias("conflicts_count"),
    )
    n = F.col("dependencies_count")
    frameworks = per.where(n >= 3).select(
        F.lit("framework_consolidation").alias("type"), "framework", n, "total_usage", "conflicts_count",
        F.when(F.col("conflicts_count") > 1, "HIGH").otherwise("MEDIUM").alias("impact"),
        F.concat(F.lit("Consider consolidating "), n.cast("string"), F.lit(" "), "framework", F.lit(" dependencies")).alias("recommendation"),
    )
    utility = per.where((F.col("framework") == "utility") & (n >= 5)).select(
        F.lit("utility_consolidation").alias("type"), "framework", n, "total_usage", F.lit(None).cast("bigint").alias("conflicts_count"),
        F.lit("MEDIUM").alias("impact"), F.lit("Review utility libraries for duplicate functionality").alias("recommendation"),
    )
    return frameworks.unionByName(utility)


# portfolio -------------------------------------------------------------------------


def portfolio_totals(classes: DataFrame, files: DataFrame, repos: DataFrame) -> DataFrame:
    """actions, forms, services, models, CORBA classes and JSP files of the selected repositories.

    ``classes(repo, id, name, stereotype, package, is_action, is_formbean, is_corba)``, ``files(repo, id, path, extension)``.
    """
    c = classes.join(repos.toDF("repo"), "repo", "left_semi")
    flag = lambda name: F.coalesce(F.col(name), F.lit(False))
    ends = lambda *words: reduce(lambda a, b: a | b, [F.col("name").endswith(w) for w in words])
    kind = lambda *names: F.coalesce(F.col("stereotype").isin(*names), F.lit(False))
    package = F.coalesce("package", F.lit(""))
    named = lambda test: F.count_distinct(F.when(test, F.col("id")))
    counts = c.agg(
        named(flag("is_action") | kind("Action") | ends("Action")).alias("actions"),
        named(flag("is_formbean") | kind("Form") | ends("Form", "FormBean")).alias("forms"),
        named(kind("Service") | ends("Service")).alias("services"),
        named(kind("Entity", "DTO", "Model") | ends("DTO", "Entity") | package.contains(".model.")).alias("data_models"),
        named(flag("is_corba") | package.contains(".idl") | package.contains(".corba") | ends("Operations", "Helper")).alias("corba_interfaces"),
    )
    jsp = files.join(repos.toDF("repo"), "repo", "left_semi").where((F.coalesce("extension", F.lit("")) == ".jsp") | F.lower("path").endswith(".jsp"))
    return counts.withColumn("jsps", jsp.agg(F.count_distinct("id")).scalar())


def coupling(edges: DataFrame) -> DataFrame:
    """the coupling index, 100 at most."""
    return edges.agg(F.least(F.lit(100.0), F.coalesce(F.sum("weight"), F.lit(0)).cast("double")).alias("coupling_index"))


def hotspots(edges: DataFrame, shared: DataFrame, n: int = 5) -> DataFrame:
    """the heaviest edges and the most shared artifacts. ``shared(artifact, type, repository_count)``."""
    heavy = edges.orderBy(F.desc("weight"), "src", "dst").limit(n).select(
        F.concat(F.col("src").cast("string"), F.lit("→"), F.col("dst").cast("string")).alias("subject"),
        F.lit("High cross-repo dependency weight").alias("reason"),
        F.when(F.col("weight") >= 5, "high").otherwise("medium").alias("severity"),
    )
    wide = shared.orderBy(F.desc("repository_count"), "artifact", "type").limit(n).select(
        F.col("artifact").alias("subject"), F.concat(F.lit("Shared "), "type", F.lit(" "), "artifact").alias("reason"), F.lit("medium").alias("severity")
    )
    return heavy.unionByName(wide)


def graphql_suggestions(classes: DataFrame, repos: DataFrame, n: int = 5) -> DataFrame:
    """types, queries and mutations named after the first ``n`` model classes, by name."""
    model = F.coalesce(F.col("stereotype").isin("Entity", "DTO", "Model"), F.lit(False)) | F.col("name").endswith("DTO") | F.col("name").endswith("Entity")
    some = classes.join(repos.toDF("repo"), "repo", "left_semi").where(model).select("id", "name").distinct().orderBy("name", "id").limit(n)
    made = lambda kind, before, after="": F.struct(F.lit(kind).alias("kind"), F.concat(F.lit(before), "name", F.lit(after)).alias("suggestion"))
    rows = F.array(made("type", ""), made("query", "get"), made("query", "list", "s"), made("mutation", "create"), made("mutation", "update"))
    return some.select(F.explode(rows).alias("r")).select("r.*").distinct().orderBy("kind", "suggestion")


def dependency_graph_nodes(edges: DataFrame) -> DataFrame:
    """the distinct ends of all edges."""
    e = edges.where("src is not null and dst is not null")
    return e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()


def dependency_graph_edges(edges: DataFrame) -> DataFrame:
    """edges with medium strength and criticality where none is given."""
    medium = F.lit("medium")
    return edges.where("src is not null and dst is not null").select(
        "src", "dst", F.coalesce("strength", medium).alias("strength"), F.coalesce("criticality", medium).alias("criticality")
    )


def flow_risk(flows: DataFrame) -> DataFrame:
    """flows per risk level and the overall risk."""
    at = lambda level: F.count_if(F.col("risk_level") == level)
    counted = flows.agg(F.count("*").alias("total_flows"), at("high").alias("high_risk_flows"), at("medium").alias("medium_risk_flows"), at("low").alias("low_risk_flows"))
    n, high, medium = F.col("total_flows"), F.col("high_risk_flows"), F.col("medium_risk_flows")
    risk = F.when((n > 0) & (high > n * 0.3), "high").when((n > 0) & (high + medium > n * 0.5), "medium").otherwise("low")
    return counted.withColumn("overall_risk", risk)


def migration_sequence(flows: DataFrame) -> DataFrame:
    """flows by order, those without one last; low-risk ones after the others."""
    return flows.orderBy(F.coalesce("migration_order", F.lit(999)), F.col("risk_level") == "low", "name").select(
        "name", "migration_order", "effort_weeks", "risk_level"
    )


def multi_repo_summary(flows: DataFrame, edges: DataFrame, points: DataFrame, operations: DataFrame) -> DataFrame:
    """one row of counts."""
    n = lambda df: df.agg(F.count("*")).scalar()
    return flows.agg(F.count("*").alias("total_business_flows")).select(
        "total_business_flows", n(edges).alias("total_dependencies"), n(points).alias("total_integrations"), n(operations).alias("shared_operations")
    )


def integration_summary(points: DataFrame) -> DataFrame:
    """F32: rows ``(aspect, name, count)`` per integration type and sensitivity; unknown where none is given."""
    per = lambda col, what: points.groupBy(F.coalesce(col, F.lit("unknown")).alias("name")).agg(F.count("*").alias("count")).select(
        F.lit(what).alias("aspect"), "name", "count"
    )
    return per("integration_type", "type").unionByName(per("data_sensitivity", "sensitivity"))


def integration_headline(points: DataFrame) -> DataFrame:
    """F32: the most common type and the counts of high and medium sensitivity."""
    kinds = points.groupBy(F.coalesce("integration_type", F.lit("unknown")).alias("name")).agg(F.count("*").alias("n"))
    common = kinds.agg(F.min_by("name", F.struct(-F.col("n"), "name"))).scalar()
    at = lambda level: F.count_if(F.col("data_sensitivity") == level)
    return points.agg(at("high").alias("high_sensitivity"), at("medium").alias("medium_sensitivity")).withColumn("most_common_type", common)


def plan_metrics(phases: DataFrame, profiles: DataFrame, critical_paths: DataFrame, months: int) -> DataFrame:
    """totals of a plan: effort, weeks, team, mean complexity and risk."""
    total = phases.agg(F.sum("estimated_effort_days").alias("total_effort_days"), F.sum("estimated_duration_weeks").alias("estimated_timeline_weeks"))
    high = F.col("high_complexity_repositories") > 0
    many = F.col("critical_path_count") > 3
    return (
        total.withColumns(
            {
                "total_repositories": profiles.agg(F.count("*")).scalar(),
                "complexity_score": profiles.agg(F.avg("migration_complexity")).scalar(),
                "high_complexity_repositories": profiles.agg(F.count_if(F.col("migration_complexity") > 70)).scalar(),
                "critical_path_count": critical_paths.agg(F.count("*")).scalar(),
            }
        )
        .withColumn("estimated_team_size", F.greatest(F.lit(1), F.floor(F.col("total_effort_days") / (months * 20))).cast("int"))
        .withColumn("risk_factor_count", high.cast("int") + many.cast("int"))
        .withColumn("overall_risk", F.when(F.col("risk_factor_count") > 2, "HIGH").otherwise("MEDIUM"))
        .withColumn("timeline_optimistic", F.col("estimated_timeline_weeks") > months * 4)
    )


# files, chunks, batches ------------------------------------------------------------


def language_stats(files: DataFrame) -> DataFrame:
    """files and lines per repository and language. ``files(repository, path, language, lines)``."""
    return files.where("language is not null").groupBy("repository", "language").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))


def extension_counts(files: DataFrame) -> DataFrame:
    """files per repository and lower-case extension."""
    ext = F.lower(F.regexp_extract("path", r"[^/](\.[^./]*)$", 1))
    return files.groupBy("repository", ext.alias("extension")).agg(F.count("*").alias("files"))


def repository_analysis(files: DataFrame) -> DataFrame:
    """file count, lines, main language (ties by name) and build systems at the root."""
    main = (
        language_stats(files).groupBy("repository").agg(F.min_by("language", F.struct(-F.col("files"), "language")).alias("main_language"))
    )
    has = lambda *names: F.bool_or(F.col("path").isin(*names))
    whole = files.groupBy("repository").agg(
        F.count("*").alias("file_count"),
        F.sum("lines").alias("lines_of_code"),
        has("pom.xml").alias("has_maven"),
        has("build.gradle", "build.gradle.kts").alias("has_gradle"),
        has("package.json").alias("has_npm"),
    )
    return whole.join(main, "repository", "left")


def repository_stats(chunks: DataFrame) -> DataFrame:
    """chunks, distinct files, size and languages per repository."""
    return chunks.groupBy("repository").agg(
        F.count("*").alias("total_chunks"), F.count_distinct("file_path").alias("total_files"), F.sum("size").alias("total_size"), F.count_distinct("language").alias("languages")
    )


def language_counts(chunks: DataFrame, keys: list[str] = ("repository",)) -> DataFrame:
    """chunks per language, by repository or overall; unknown where none is given."""
    return chunks.groupBy(*keys, F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("chunks"))


def collection_stats(chunks: DataFrame) -> DataFrame:
    """chunks and repositories overall."""
    return chunks.agg(F.count("*").alias("total_chunks"), F.count_distinct("repository").alias("total_repositories"))


def repository_list(chunks: DataFrame) -> DataFrame:
    """repositories in name order."""
    return chunks.where("repository is not null").select("repository").distinct().orderBy("repository")


def processing_stats(results: DataFrame) -> DataFrame:
    """totals, success rate and mean time of processing results."""
    n = F.count("*")
    done = F.count_if(F.col("status") == "completed")
    return results.agg(
        n.alias("total_repositories"),
        done.alias("completed_repositories"),
        F.count_if(F.col("status") == "failed").alias("failed_repositories"),
        F.sum("files").alias("total_files_processed"),
        F.sum("chunks").alias("total_chunks_generated"),
        F.sum("seconds").alias("total_processing_time"),
        (done / F.greatest(n, F.lit(1))).alias("success_rate"),
        (F.coalesce(F.sum("seconds"), F.lit(0.0)) / F.greatest(n, F.lit(1))).alias("average_processing_time"),
    )


def batch_stats(items: DataFrame, wall_seconds: float) -> DataFrame:
    """status counts, times, throughput per hour, error rate and progress of a batch.

    ``items(status, processing_time, components, business_rules, relationships, file_count, error_message)``.
    """
    at = lambda s: F.count_if(F.col("status") == s)
    out = items.agg(
        F.count("*").alias("total_repositories"),
        at("completed").alias("completed_repositories"),
        at("failed").alias("failed_repositories"),
        at("skipped").alias("skipped_repositories"),
        at("in_progress").alias("in_progress"),
        F.coalesce(F.avg("processing_time"), F.lit(0.0)).alias("average_processing_time"),
        F.stddev_samp("processing_time").alias("stdev_processing_time"),
        F.sum("components").alias("total_components"),
        F.sum("business_rules").alias("total_business_rules"),
        F.sum("relationships").alias("total_relationships"),
        F.count_if(F.col("file_count") > 1000).alias("large_repositories"),
    )
    n = F.col("total_repositories")
    percent = lambda c: F.when(n > 0, F.col(c) / n * 100).otherwise(0.0)
    rate = F.col("completed_repositories") / (wall_seconds / 3600) if wall_seconds > 0 else F.lit(0.0)
    return out.withColumns({"throughput_repos_per_hour": rate, "error_rate": percent("failed_repositories"), "progress_percentage": percent("completed_repositories")})


def common_error(items: DataFrame) -> DataFrame:
    """the most common start of an error message, ties by text."""
    kinds = items.where("status = 'failed' and error_message is not null and error_message <> ''").groupBy(
        F.split("error_message", ":")[0].alias("error_type")
    ).agg(F.count("*").alias("occurrences"))
    return kinds.orderBy(F.desc("occurrences"), "error_type").limit(1)


def repository_quality(df: DataFrame) -> DataFrame:
    """quality score and golden flag.

    ``has_readme, has_docs, test_coverage, complexity_score, has_maven, has_gradle, has_npm``;
    a missing complexity counts as 10.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    cover, cx = F.coalesce("test_coverage", F.lit(0.0)), F.coalesce("complexity_score", F.lit(10.0))
    part = lambda test, value: F.when(test, value).otherwise(0.0)
    score = (
        part(yes("has_readme"), 0.2)
        + part(yes("has_docs"), 0.2)
        + F.least(cover * 0.3, F.lit(0.3))
        + F.when(cx < 5, 0.2).when(cx < 8, 0.1).otherwise(0.0)
        + part(yes("has_maven") | yes("has_gradle") | yes("has_npm"), 0.1)
    )
    scored = df.withColumn("quality_score", F.least(score, F.lit(1.0)))
    return scored.withColumn("is_golden", (F.col("quality_score") >= 0.7) & (cover >= 0.6) & (cx <= 5))


def consistency(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """rows in two stores, their difference, and the keys only one of them has."""
    both = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full")
    gone = both.agg(F.count_if(F.col("_b").isNull()).alias("only_first"), F.count_if(F.col("_a").isNull()).alias("only_second"))
    n = lambda df: df.agg(F.count("*")).scalar()
    return gone.withColumns({"first_count": n(a), "second_count": n(b)}).withColumns(
        {"difference": F.abs(F.col("first_count") - F.col("second_count")), "consistent": F.col("first_count") == F.col("second_count")}
    )


def migration_analysis(repos: DataFrame, components: DataFrame) -> DataFrame:
    """distinct components per kind and repository."""
    return join_branches(repos.select("repo"), "repo", [kind_counts(components)])


def migration_facets(components: DataFrame) -> DataFrame:
    """the distinct complexity levels and purposes of a repository, one row each."""
    level = components.where("kind = 'file'").select("repo", F.lit("complexity_level").alias("facet"), F.col("level").alias("value"))
    purpose = components.where("kind = 'action'").select("repo", F.lit("business_purpose").alias("facet"), F.col("purpose").alias("value"))
    return level.unionByName(purpose).where("value is not null").distinct()


def selection_summary(repos: DataFrame) -> DataFrame:
    """lines and mean complexity of a selection."""
    return repos.agg(F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"), F.coalesce(F.avg("complexity"), F.lit(0.0)).alias("average_complexity"))


def refresh_counts(files: DataFrame) -> DataFrame:
    """files and bytes per repository."""
    return files.groupBy("repository").agg(F.count("*").alias("file_count"), F.sum("size").alias("total_size_bytes"))


def pom_staleness(poms: DataFrame, as_of: Column) -> DataFrame:
    """seconds since each build file was read, the oldest first."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return poms.withColumn("seconds_since_parsed", (us(as_of) - us(F.col("last_parsed"))) / 1_000_000).orderBy(F.desc("seconds_since_parsed"), "path")


def facets(repos: DataFrame) -> DataFrame:
    """distinct domains, frameworks and owners, one row each."""
    one = lambda name, col: repos.select(F.lit(name).alias("facet"), col.alias("value"))
    rows = one("domain", F.explode("domains")).unionByName(one("framework", F.col("framework"))).unionByName(one("owner", F.col("team_owner")))
    return rows.where("value is not null").distinct().orderBy("facet", "value")

