"""Slices and phases of a migration, and the recommendations of F17."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.functions.text import bucket_1_to_5, weeks
from portolan.operators import graph
from portolan.session import written


def slices(repos: DataFrame, edges: DataFrame, shared: DataFrame) -> DataFrame:
    """Connected groups of repositories with size, weights, effort and risk.

    ``edges(src, dst, weight)`` with both ends selected count; ``shared(repo)`` has one row
    per shared artifact a repository takes part in.
    """
    member = written(graph.components(repos.select("repo"), edges), "slices").withColumnRenamed("node", "repo")
    ids = member.select("repo")
    inside = edges.where("src <> dst").join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")
    out = inside.groupBy(F.col("src").alias("repo")).agg(F.sum("weight").alias("outbound"))
    density = shared.groupBy("repo").agg(F.count("*").alias("shared"))
    # a link never leaves its slice, so inbound and outbound weights of a slice agree
    per = member.join(out, "repo", "left").join(density, "repo", "left").na.fill(0).groupBy("component").agg(
        F.count("*").alias("size"), F.sum("outbound").cast("double").alias("inbound_weight"), F.sum("outbound").cast("double").alias("outbound_weight"), F.sum("shared").alias("shared_artifacts")
    )
    n = F.col("size")
    return per.withColumns(
        {
            "effort": bucket_1_to_5((n + F.col("inbound_weight") / n) / 2),
            "risk": bucket_1_to_5((F.col("shared_artifacts") + F.col("outbound_weight") / n) / 3),
        }
    )


def slice_dependencies(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Repositories outside a slice that depend on one inside. ``members(repo, component)``."""
    into = edges.select("src", "dst").distinct().join(members.select(F.col("repo").alias("dst"), "component"), "dst")
    own = members.select(F.col("repo").alias("src"), F.col("component").alias("_own"))
    return into.join(own, "src", "left").where(~F.col("component").eqNullSafe(F.col("_own"))).select("component", F.col("src").alias("repo")).distinct()


def slice_sequence(sliced: DataFrame) -> DataFrame:
    """Slices in order. Links never leave a slice, so risk, effort and name decide."""
    return sliced.select("component", "risk", "effort").orderBy("risk", "effort", "component")


def migration_phases(profiles: DataFrame, edges: DataFrame) -> DataFrame:
    """Phases with their repositories counted, effort, weeks, parallel flag and risk.

    ``profiles(repo, migration_complexity, estimated_effort_days, migration_priority)``.
    """
    waved = graph.waves(
        profiles.select("repo", "migration_complexity", "estimated_effort_days", "migration_priority"), edges, "repo", "migration_complexity"
    )
    effort = F.sum("estimated_effort_days")
    return waved.groupBy(F.col("wave").alias("phase")).agg(
        F.count("*").alias("repositories"),
        effort.alias("estimated_effort_days"),
        weeks(effort).alias("estimated_duration_weeks"),
        (F.count("*") > 1).alias("parallel_execution"),
        F.when(F.bool_or(F.col("migration_priority") == "CRITICAL"), "HIGH").otherwise("MEDIUM").alias("risk_level"),
    ).orderBy("phase")


def migration_order(profiles: DataFrame, edges: DataFrame) -> DataFrame:
    """Repositories by wave, within a wave the most complex first."""
    waved = graph.waves(profiles.select("repo", "migration_complexity"), edges, "repo", "migration_complexity")
    return waved.orderBy("wave", F.desc("migration_complexity"), "repo")


Rule = tuple[Column, Column]


def recommendations(metrics: DataFrame, rules: list[Rule], keys: list[str] = ()) -> DataFrame:
    """one row per rule that fires, with its place in the list."""
    said = F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(i).alias("position"), text.alias("recommendation"))) for i, (test, text) in enumerate(rules)])
    return metrics.select(*keys, F.explode(F.array_compact(said)).alias("r")).select(*keys, "r.*")


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _n(name: str) -> Column:
    return F.col(name).cast("string")


# fixed values: conditions and texts


def quality_rules() -> list[Rule]:
    built = F.coalesce("has_maven", F.lit(False)) | F.coalesce("has_gradle", F.lit(False)) | F.coalesce("has_npm", F.lit(False))
    return [
        (F.col("quality_score") < 0.7, F.lit("Improve documentation and README")),
        (F.coalesce("test_coverage", F.lit(0.0)) < 0.6, F.lit("Increase test coverage")),
        (F.coalesce("complexity_score", F.lit(0.0)) > 5, F.lit("Reduce code complexity")),
        (~built, F.lit("Add proper build configuration")),
    ]


def health_rules() -> list[Rule]:
    bad = (F.col("conflicts_count") > 5) | (F.col("avg_complexity") > 5) | (F.col("dependencies_count") > 50)
    return [
        (F.col("conflicts_count") > 5, F.lit("Resolve dependency conflicts to improve stability")),
        (F.col("avg_complexity") > 5, F.lit("Refactor complex code to improve maintainability")),
        (F.col("dependencies_count") > 50, F.lit("Consider reducing number of dependencies")),
        (~bad, F.lit("Repository health looks good!")),
    ]


def dependency_health_rules() -> list[Rule]:
    return [
        (F.col("conflicts") > 5, F.lit("Consider consolidating dependencies to reduce version conflicts")),
        (F.col("cycles") > 0, F.lit("Refactor code to eliminate circular dependencies")),
        (F.col("vulnerabilities") > 0, F.lit("Update vulnerable dependencies to secure versions")),
        (F.col("resolution_time_ms") > 5000, F.lit("Consider caching dependency resolution results")),
        (F.col("critical_conflicts") > 0, F.lit("Address critical version conflicts immediately")),
    ]


def portfolio_rules() -> list[Rule]:
    days = F.col("total_effort_days")
    return [
        (F.lit(True), _text("📊 Portfolio Overview: ", _n("total_repositories"), " repositories with average complexity ", F.format_string("%.1f", "average_complexity"), "/100")),
        (F.col("critical_repositories") > 0, _text("🚨 Critical Priority: ", _n("critical_repositories"), " repositories require immediate attention: ", F.col("critical_names"))),
        (F.col("high_dependency_repositories") > 0, _text("🔗 High Dependencies: Consider migrating dependencies first for: ", F.col("high_dependency_names"))),
        (F.col("longest_path") > 0, _text("⚠️ Critical Path Alert: Longest dependency chain has ", _n("longest_path"), " repositories, starting with ", _n("longest_path_start"))),
        (F.col("corba_heavy_repositories") > 0, _text("🔧 CORBA Complexity: ", _n("corba_heavy_repositories"), " repositories have heavy CORBA usage, plan extra time for modernization")),
        (F.lit(True), _text("⏱️ Estimated Total Effort: ", days.cast("string"), " person-days (", F.format_string("%.1f", days / 22), " person-months)")),
    ]


def portfolio_metrics(profiles: DataFrame, paths: DataFrame) -> DataFrame:
    """the one row ``portfolio_rules`` looks at. ``paths`` are the critical paths."""
    def names(test: Column) -> Column:
        some = profiles.where(test).orderBy("repo").limit(3).select(F.col("repo").cast("string").alias("_x"), "repo")
        return some.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("repo", "_x"))), lambda s: s["_x"]), ", ")).scalar()

    critical, tied = F.col("migration_priority") == "CRITICAL", F.col("external_dependencies") > 5
    longest = paths.agg(F.min_by(F.struct("path_length", F.col("path")[0].alias("start")), F.struct(-F.col("path_length"), "path")).alias("p"))
    return profiles.agg(
        F.count("*").alias("total_repositories"),
        F.avg("migration_complexity").alias("average_complexity"),
        F.count_if(critical).alias("critical_repositories"),
        F.count_if(tied).alias("high_dependency_repositories"),
        F.count_if(F.col("corba_interfaces") > 10).alias("corba_heavy_repositories"),
        F.sum("estimated_effort_days").alias("total_effort_days"),
    ).withColumns(
        {
            "critical_names": names(critical),
            "high_dependency_names": names(tied),
            "longest_path": F.coalesce(longest.select("p.path_length").scalar(), F.lit(0)),
            "longest_path_start": longest.select("p.start").scalar(),
        }
    )


def shared_rules() -> list[Rule]:
    total, clash, worst = F.col("total_shared"), F.col("total_conflicts"), F.col("critical_conflicts")
    return [
        (F.lit(True), _text("📊 Portfolio Overview: ", _n("total_shared"), " shared dependencies with ", _n("total_conflicts"), " version conflicts")),
        (worst > 0, _text("🚨 Critical Priority: ", _n("critical_conflicts"), " critical conflicts in ", F.col("critical_frameworks"), " frameworks")),
        (F.col("legacy") > 0, _text("🏗️ Legacy Framework Alert: ", _n("legacy"), " legacy dependencies, ", _n("legacy_conflicts"), " with version conflicts")),
        (F.col("high_impact") > 0, _text("💡 Consolidation Opportunities: ", _n("high_impact"), " high-impact consolidation opportunities identified")),
        (F.col("widely_used") > 0, _text("📈 Widely Used Dependencies: ", _n("widely_used"), " dependencies used by 5+ repositories, ", _n("widely_used_conflicts"), " have conflicts")),
        (worst > 0, F.lit("🎯 Recommended Strategy: Address critical conflicts first, then consolidate by framework type")),
        ((worst == 0) & (clash > 0), F.lit("🎯 Recommended Strategy: Standardize versions by framework, focusing on legacy components")),
        ((worst == 0) & (clash == 0) & total.isNotNull(), F.lit("✅ Recommended Strategy: Dependencies are well-aligned, focus on modernization planning")),
    ]


def shared_metrics(shared: DataFrame, conflicts: DataFrame, opportunities: DataFrame) -> DataFrame:
    """the one row ``shared_rules`` looks at."""
    legacy, wide, clash = F.col("framework_type").isin("struts", "corba", "jsp"), F.col("usage_count") >= 5, F.col("version_conflicts")
    worst = conflicts.where("severity = 'CRITICAL'")
    # at most ten framework names exist
    frameworks = worst.agg(F.array_join(F.array_sort(F.collect_set("framework_type")), ", ")).scalar()
    return shared.agg(
        F.count("*").alias("total_shared"),
        F.count_if(clash).alias("total_conflicts"),
        F.count_if(legacy).alias("legacy"),
        F.count_if(legacy & clash).alias("legacy_conflicts"),
        F.count_if(wide).alias("widely_used"),
        F.count_if(wide & clash).alias("widely_used_conflicts"),
    ).withColumns(
        {
            "critical_conflicts": worst.agg(F.count("*")).scalar(),
            "critical_frameworks": frameworks,
            "high_impact": opportunities.agg(F.count_if(F.col("impact") == "HIGH")).scalar(),
        }
    )


def flow_rules() -> list[Rule]:
    return [
        (F.col("high_value") > 0, _text("Prioritize ", _n("high_value"), " high-value business flows for migration")),
        (F.col("low_risk") > 0, _text("Consider starting with ", _n("low_risk"), " low-risk flows")),
        (F.col("critical_dependencies") > 0, _text("Address ", _n("critical_dependencies"), " critical dependencies before migration")),
    ]


def flow_metrics(flows: DataFrame, edges: DataFrame) -> DataFrame:
    """the one row ``flow_rules`` looks at."""
    return flows.agg(
        F.count_if(F.col("business_value") == "high").alias("high_value"), F.count_if(F.col("risk_level") == "low").alias("low_risk")
    ).withColumn("critical_dependencies", edges.agg(F.count_if(F.col("criticality") == "critical")).scalar())


def batch_rules() -> list[Rule]:
    rate, errors = F.col("throughput_repos_per_hour"), F.col("error_rate")
    one = lambda c: F.format_string("%.1f", c)
    spread = F.col("stdev_processing_time") > F.col("average_processing_time") * 0.5
    return [
        (rate > 20, _text("🚀 Excellent throughput: ", one(rate), " repos/hour")),
        ((rate > 10) & (rate <= 20), _text("✅ Good throughput: ", one(rate), " repos/hour")),
        (rate <= 10, _text("⚠️ Low throughput: ", one(rate), " repos/hour - consider optimization")),
        (errors < 5, _text("✅ Low error rate: ", one(errors), "%")),
        ((errors >= 5) & (errors < 15), _text("⚠️ Moderate error rate: ", one(errors), "% - review failed repositories")),
        (errors >= 15, _text("🚨 High error rate: ", one(errors), "% - investigate common failure patterns")),
        (spread, F.lit("📊 High processing time variance - some repositories significantly more complex")),
        (rate < 10, F.lit("Consider increasing concurrent processing limit or optimizing parsing algorithms")),
        (errors > 10, F.lit("Implement more robust error handling and pre-validation of repository paths")),
        (F.col("large_repositories") > 0, _text("Consider pre-filtering or splitting ", _n("large_repositories"), " large repositories for better performance")),
    ]

