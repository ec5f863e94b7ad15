"""Dependency resolution, conflicts, vulnerabilities and licenses.

``deps`` has ``group_id, artifact_id, version`` and, where used, ``scope, depth, optional,
managed``. Long groups stay rows: versions and paths are counted or listed as rows, not
gathered into one list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.functions import versions
from portolan.operators import condense, graph
from portolan.operators.rank import first_n_per_group, with_rank
from portolan.operators.textjoin import text_join
from portolan.session import RoundTable, written

GA = ["group_id", "artifact_id"]


def _known() -> Column:
    return F.col("version").isNotNull() & (F.col("version") != "") & (F.col("version") != "*")


#: A version dictionary of at most so many rows is sent to every task.
MAX_VERSIONS = 100_000


def version_dictionary(rows: DataFrame) -> DataFrame:
    """Every distinct non-null ``version`` of ``rows`` parsed once: ``version, valid, major, minor, pre, release, place``.

    ``place`` is the version's rank in version order, equal for versions that compare equal and null for invalid ones, so the
    grammar runs once per version and comparisons are between numbers.
    """
    v = F.col("version")
    seen = rows.where(v.isNotNull()).select("version").distinct()
    parsed = seen.select("version", versions.is_version(v).alias("valid"), versions.major(v).alias("major"), versions.minor(v).alias("minor"), versions.is_prerelease(v).alias("pre"), versions.version_key(v).alias("key"))
    parsed = written(parsed, "versions")
    order = with_rank(parsed.where("valid").select("key").distinct().withColumn("all", F.lit(0)), ["all"], ["key"], "place").select("key", F.col("place").cast("long").alias("place"))
    out = parsed.join(order, "key", "left").select("version", "valid", "major", "minor", "pre", F.col("key.release").alias("release"), "place")
    table = RoundTable(rows.sparkSession, "dictionary")
    known = table.add(out)
    return F.broadcast(known) if table.rows <= MAX_VERSIONS else known


def version_conflicts(deps: DataFrame, keys: list[str] = GA, ignore_empty: bool = False) -> DataFrame:
    """Artifacts asked for in more than one version, with severity; rows are counted per version before versions are looked at."""
    d = deps.where(_known()) if ignore_empty else deps
    per = written(d.groupBy(*keys, "version").agg(F.count("*").alias("n")), "per_version")
    v = _known()
    return (
        per.join(version_dictionary(per.where(v)), "version", "left")
        .groupBy(*keys)
        .agg(
            F.count("version").alias("version_count"),
            F.sum("n").alias("dependency_count"),
            F.count_if(v).alias("_given"),
            F.min("major").alias("_low"),
            F.max("major").alias("_high"),
            F.count_distinct("minor").alias("_minors"),
            F.bool_or("pre").alias("_pre"),
            F.bool_or(~F.col("valid")).alias("_bad"),
        )
        .where("version_count > 1")
        .withColumn(
            "severity",
            F.when(F.coalesce("_bad", F.lit(False)), "medium")
            .when(F.col("_given") == 0, "low")
            .when(F.col("_low") < F.col("_high"), "critical")
            .when(F.col("_minors") > 2, "high")
            .when(F.coalesce("_pre", F.lit(False)), "high")
            .otherwise("medium"),
        )
        .select(*keys, "version_count", "dependency_count", "severity")
    )


def conflicting_versions(deps: DataFrame) -> DataFrame:
    """one row per version of each conflicting artifact."""
    seen = deps.groupBy(*GA, "version").agg(F.count("*").alias("uses"))
    many = seen.groupBy(*GA).agg(F.count("*").alias("n")).where("n > 1")
    return seen.join(many.select(*GA), GA, "left_semi")


def conflict_impact(deps: DataFrame) -> DataFrame:
    """size, depths, scopes and risk of each conflict; rows are counted per version and scope first."""
    part = lambda s, i: F.coalesce(F.get(F.col(s), i), F.lit(0).cast("bigint"))
    fine = ~F.coalesce("_bad", F.lit(False)) & F.col("_low").isNotNull()
    per = deps.groupBy(*GA, "version", "scope").agg(F.count("*").alias("n"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth"))
    per = written(per, "per_version")
    ends = lambda pick: pick("release", "place")
    return (
        per.join(version_dictionary(per.where(_known())), "version", "left")
        .groupBy(*GA)
        .agg(
            F.count_distinct("version").alias("_n"),
            F.sum("n").alias("affected_dependencies"),
            F.min("min_depth").alias("min_depth"),
            F.max("max_depth").alias("max_depth"),
            F.count_distinct("scope").alias("scope_count"),
            ends(F.min_by).alias("_low"),
            ends(F.max_by).alias("_high"),
            F.bool_or(~F.col("valid")).alias("_bad"),
        )
        .where("_n > 1")
        .select(
            *GA,
            "affected_dependencies",
            "min_depth",
            "max_depth",
            "scope_count",
            F.coalesce(fine & (part("_low", 0) != part("_high", 0)), F.lit(False)).alias("breaking_changes_risk"),
            F.coalesce(fine & (part("_low", 0) == 0) & (part("_low", 1) != part("_high", 1)), F.lit(False)).alias("api_compatibility_risk"),
        )
    )


def include_dependencies(deps: DataFrame, exclusions: DataFrame | None = None, include_test: bool = False) -> DataFrame:
    """drop test (unless asked for), optional and excluded dependencies."""
    kept = deps.where(~F.coalesce("optional", F.lit(False)))
    if not include_test:
        kept = kept.where(F.col("scope") != "test")
    return kept if exclusions is None else kept.join(exclusions, exclusions.columns, "left_anti")


def apply_management(deps: DataFrame, managed: DataFrame) -> DataFrame:
    """managed versions win and are marked."""
    m = managed.select(*GA, F.col("version").alias("_m"))
    return (
        deps.join(m, GA, "left")
        .withColumn("managed", F.col("_m").isNotNull())
        .withColumn("version", F.coalesce("_m", "version"))
        .drop("_m")
    )


def resolve_conflicts(deps: DataFrame, strategy: str = "nearest", order: list[str] = ("ord",), keys: list[str] = GA) -> DataFrame:
    """the dependency that wins for each artifact.

    ``strategy`` is nearest, newest, oldest, managed or fail; ``order`` is the input order,
    which breaks ties. Versions compare as text where one of them is invalid. Artifacts
    with one version keep their first dependency.
    """
    first = [F.col(c) for c in order]
    compared = strategy in ("newest", "oldest")
    per = written(deps.groupBy(*keys, "version").agg(F.count("*").alias("n")), "per_version")
    known = version_dictionary(per).select("version", "valid", "place") if compared else None
    bad = F.bool_or(~F.col("valid")) if compared else F.lit(False)
    stats = (per.join(known, "version", "left") if compared else per).groupBy(*keys).agg(F.count("version").alias("_n"), F.sum("n").alias("candidates"), bad.alias("_bad"))
    d = deps.join(stats, keys)
    conflict = F.col("_n") > 1
    if strategy == "fail":
        coords = F.concat_ws(":", *keys)
        d = d.withColumn("candidates", F.when(conflict, F.raise_error(F.concat(F.lit("unresolved conflict: "), coords)).cast("bigint")).otherwise(F.col("candidates")))
        return first_n_per_group(d, keys, first, 1).drop("_n", "_bad")
    nearest = F.when(conflict, F.col("depth"))
    if strategy == "nearest":
        by = [nearest.asc()]
    elif compared:
        d = d.join(known.select("version", F.col("place").alias("_place")), "version", "left")
        parsed, plain = F.when(conflict & ~F.col("_bad"), F.col("_place")), F.when(conflict & F.col("_bad"), F.col("version"))
        by = [parsed.desc(), plain.desc()] if strategy == "newest" else [parsed.asc(), plain.asc()]
    elif strategy == "managed":
        by = [F.when(conflict, ~F.coalesce("managed", F.lit(False))).asc(), F.when(conflict & ~F.col("managed"), F.col("depth")).asc()]
    else:
        raise ValueError(f"unknown strategy {strategy}")
    won = first_n_per_group(d, keys, [*by, *first], 1)
    return won.select(*deps.columns, "candidates", F.when(conflict, strategy).alias("conflict_resolution"))


def grade(score: Column) -> Column:
    """A from 90, B from 80, C from 70, D from 60, else F."""
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def dependency_health(counts: DataFrame) -> DataFrame:
    """score and grade from ``conflicts, cycles, vulnerabilities``."""
    lost = lambda c, each, most: F.least(F.col(c) * each, F.lit(most))
    score = F.greatest(F.lit(100.0) - lost("conflicts", 5, 50) - lost("cycles", 10, 30) - lost("vulnerabilities", 3, 20), F.lit(0.0))
    return counts.withColumn("health_score", score).withColumn("grade", grade(F.col("health_score")))


def graph_structure(edges: DataFrame) -> DataFrame:
    """nodes that paths lead to, number and depths of the simple paths, and complexity; paths are counted, not listed."""
    nodes = edges.where("src <> dst").agg(F.count_distinct("dst").alias("total_nodes"))
    stats = condense.path_counts(edges).agg(
        F.coalesce(F.sum("paths"), F.lit(0)).cast("double").alias("p"),
        F.coalesce(F.sum("paths"), F.lit(0)).cast("long").alias("total_paths"),
        F.coalesce(F.max("deepest"), F.lit(0)).alias("max_depth"),
        F.coalesce(F.sum("depths"), F.lit(0)).cast("double").alias("depths"),
    )
    one = F.lit(1.0)
    n, p = F.col("total_nodes"), F.col("p")
    score = (F.least(F.col("max_depth") / 10.0, one) + F.least(F.try_divide(p, n * 3), one) + F.least(n / 100.0, one)) / 3.0 * 100
    both = nodes.unionByName(stats, allowMissingColumns=True)
    row = both.agg(*[F.max(c).alias(c) for c in both.columns])
    average = F.coalesce(F.try_divide("depths", "p"), F.lit(0.0)).alias("average_depth")
    return row.select("total_nodes", "total_paths", "max_depth", average, F.when(n > 0, score).otherwise(0.0).alias("complexity_score"))


def scope_distribution(deps: DataFrame) -> DataFrame:
    """dependencies per scope."""
    return deps.groupBy("scope").agg(F.count("*").alias("dependencies"))


def path_hubs(edges: DataFrame, n: int = 10) -> DataFrame:
    """the nodes most simple paths run through."""
    return condense.path_shares(edges).withColumn("paths", F.col("paths").cast("long")).orderBy(F.desc("paths"), "node").limit(n)


def optimization_opportunities(conflicts: DataFrame, paths: DataFrame, artifacts: DataFrame) -> DataFrame:
    """F8: artifacts in more than two conflicts, chains deeper than eight, groups of more than five artifacts."""
    row = lambda kind, subject, value: [F.lit(kind).alias("type"), subject.cast("string").alias("subject"), value.cast("bigint").alias("value")]
    frequent = conflicts.groupBy(*GA).agg(F.count("*").alias("n")).where("n > 2")
    groups = artifacts.groupBy("group_id").agg(F.count_distinct("artifact_id").alias("n")).where("n > 5")
    return (
        frequent.select(*row("frequent_conflict", F.concat_ws(":", *GA), F.col("n")))
        .unionByName(paths.where("depth > 8").select(*row("deep_chain", F.col("node"), F.col("depth"))))
        .unionByName(groups.select(*row("group_proliferation", F.col("group_id"), F.col("n"))))
    )


def list_conflicts(conflicts: DataFrame, links: DataFrame | None = None, repo=None) -> DataFrame:
    """conflicts by severity as text, descending; of one repository when ``links(repo, ga)`` and ``repo`` are given."""
    if repo is not None:
        conflicts = conflicts.join(links.where(F.col("repo") == repo).select(*GA), GA, "left_semi")
    return conflicts.orderBy(F.desc("severity"), *GA)


def critical_count(conflicts: DataFrame) -> DataFrame:
    """all conflicts and the critical ones."""
    return conflicts.agg(F.count("*").alias("total_conflicts"), F.count_if(F.col("severity") == "critical").alias("critical_conflicts"))


def dependents_of(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows ``(root, node)``: everything that depends on a target, found from the targets back."""
    back = graph.reach(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), targets)
    return back.where("root <> node").select(F.col("node").alias("root"), F.col("root").alias("node"))


def vulnerable_dependencies(repo_roots: DataFrame, edges: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """Vulnerabilities reachable from each repository's artifacts."""
    hit = dependents_of(edges, vulnerabilities.select("artifact"))
    return (
        hit.join(repo_roots.select("repo", F.col("artifact").alias("root")).distinct(), "root")
        .select("repo", F.col("node").alias("artifact"))
        .distinct()
        .join(vulnerabilities, "artifact")
    )


def critical_vulnerabilities(repo_roots: DataFrame, edges: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """The critical ones only; the search starts from them."""
    return vulnerable_dependencies(repo_roots, edges, vulnerabilities.where("severity = 'CRITICAL'"))


def vulnerability_health(repo_roots: DataFrame, edges: DataFrame, vulnerabilities: DataFrame) -> DataFrame:
    """share of a repository's artifacts over its vulnerable dependencies, the worst first."""
    bad = vulnerable_dependencies(repo_roots, edges, vulnerabilities).groupBy("repo").agg(
        F.count_distinct("artifact").alias("vulnerable_deps")
    )
    total = repo_roots.groupBy("repo").agg(F.count_distinct("artifact").alias("total_deps"))
    out = total.join(bad, "repo", "left").withColumn("vulnerable_deps", F.coalesce("vulnerable_deps", F.lit(0)))
    return out.withColumn("health_score", (1.0 - F.col("vulnerable_deps") / F.col("total_deps")) * 100).orderBy("health_score", "repo")


def reached_licenses(repo_roots: DataFrame, edges: DataFrame, licenses: DataFrame) -> DataFrame:
    """Licenses each repository artifact reaches, with the number of dependencies under each.

    What an artifact reaches is a set of bits, and a license one too; their overlap is counted.
    """
    marks = condense.bits_of(licenses.select(F.col("artifact").alias("node"), "license").distinct(), "node")
    roots = repo_roots.select("repo", F.col("artifact").alias("root")).distinct()
    reached = condense.others_bits(edges, marks.select("node", "word", "bit").distinct()).withColumnRenamed("node", "root")
    held = condense.counted_bits(reached.join(roots.select("root").distinct(), "root", "left_semi"), ["root"], marks, ["license"])
    return held.withColumnRenamed("n", "dependencies").join(roots, "root")


def license_conflicts(repo_roots: DataFrame, edges: DataFrame, licenses: DataFrame, incompatible: DataFrame) -> DataFrame:
    """Licenses that must not meet but are both reached from one artifact.

    One row per repository, artifact and license pair, with the dependencies on each
    side counted instead of paired.
    """
    held = written(reached_licenses(repo_roots, edges, licenses), "licenses")
    other = held.select("repo", "root", F.col("license").alias("conflicting"), F.col("dependencies").alias("conflicting_dependencies"))
    return (
        held.join(incompatible, "license")
        .join(other, ["repo", "root", "conflicting"])
        .select("repo", F.col("root").alias("artifact"), "license", "dependencies", "conflicting", "conflicting_dependencies")
    )


def licenses_by_repository(repo_roots: DataFrame, edges: DataFrame, licenses: DataFrame) -> DataFrame:
    """One row per repository and license it reaches. A repository's sets are joined before they meet the licenses."""
    marks = condense.bits_of(licenses.select(F.col("artifact").alias("node"), "license").distinct(), "node")
    reached = condense.others_bits(edges, marks.select("node", "word", "bit").distinct())
    roots = repo_roots.select("repo", F.col("artifact").alias("node")).distinct()
    per = reached.join(roots, "node").groupBy("repo", "word").agg(F.bit_or("bits").alias("bits"))
    return condense.counted_bits(per, ["repo"], marks, ["license"]).select("repo", "license")


def unused_dependencies(repo_deps: DataFrame, texts: DataFrame) -> DataFrame:
    """Direct dependencies no file of the repository mentions by group or artifact.

    ``repo_deps`` has ``repo, group_id, artifact_id``; ``texts`` has ``repo, content``.
    """
    deps = repo_deps.select("repo", *GA).distinct()
    names = deps.select("repo", F.explode(F.array(*GA)).alias("name")).distinct()
    used = text_join(texts, names, "content", "name", on=["repo"]).select("repo", "name").distinct()
    gone = deps
    for c in GA:
        gone = gone.join(used.withColumnRenamed("name", c), ["repo", c], "left_anti")
    return gone.select("repo", *GA)


def duplicate_artifacts(artifacts: DataFrame) -> DataFrame:
    """Descriptions of one group of which the first contains the second.

    One row per group and description pair with the artifacts on each side counted;
    ``pairs`` is the number of artifact pairs the row stands for.
    """
    many = artifacts.groupBy("group_id", "description").agg(F.count_distinct("artifact_id").alias("n"))
    other = many.select("group_id", F.col("description").alias("contained"), F.col("n").alias("contained_artifacts"))
    found = text_join(many, other, "description", "contained", on=["group_id"])
    same = F.col("description") == F.col("contained")
    return (
        found.join(many.withColumnRenamed("n", "artifacts"), ["group_id", "description"])
        .join(other, ["group_id", "contained"])
        .withColumn("pairs", F.col("artifacts") * F.col("contained_artifacts") - F.when(same, F.col("artifacts")).otherwise(0))
        .where("pairs > 0")
    )


def closure_conflicts(edges: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Artifacts a root reaches in more than one version. ``coordinates`` has ``node, group_id, artifact_id, version``.

    Every version of an artifact is a bit, those of one artifact next to each other; null versions do not count.
    """
    known = coordinates.where("version IS NOT NULL").select("node", *GA, "version").distinct()
    versions = condense.bits_of(written(known.select(F.struct(*GA, "version").alias("is")).distinct(), "versions"), "is").select("is", "word", "bit")
    versions = written(versions, "version_bits")
    own = known.withColumn("is", F.struct(*GA, "version")).join(versions, "is").groupBy("node", "word").agg(F.bit_or("bit").alias("bits"))
    marks = versions.select("word", "bit", *[F.col("is")[c].alias(c) for c in GA])
    held = condense.counted_bits(condense.reach_bits(edges, own), ["node"], marks, GA)
    return held.where("n > 1").select(F.col("node").alias("root"), *GA, F.col("n").alias("version_count"))


def dependency_tree(paths: DataFrame) -> DataFrame:
    """One row per tree position: its parent, depth and place among all paths."""
    parent = F.element_at("path", -2)
    return paths.select("root", "node", parent.alias("parent"), "depth", "path").orderBy("root", "path")
