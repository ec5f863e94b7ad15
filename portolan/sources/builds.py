"""Build descriptors and framework configuration read as XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portolan.functions.extract import resolve_properties

_GAV = "groupId string, artifactId string, version string"
_DEPENDENCY = (
    f"array<struct<{_GAV.replace(' string', ': string')}, scope: string, type: string, classifier: string, optional: string, systemPath: string, "
    "exclusions: struct<exclusion: array<struct<groupId: string, artifactId: string>>>>>"
)
POM = f"""{_GAV}, packaging string, name string, description string, url string, parent struct<{_GAV.replace(' string', ': string')}>,
    properties map<string,string>, dependencies struct<dependency: {_DEPENDENCY}>,
    dependencyManagement struct<dependencies: struct<dependency: {_DEPENDENCY}>>,
    build struct<plugins: struct<plugin: array<struct<groupId: string, artifactId: string, version: string>>>>,
    repositories struct<repository: array<struct<id: string, name: string, url: string>>>,
    profiles struct<profile: array<struct<id: string>>>, modules struct<module: array<string>>,
    licenses struct<license: array<struct<name: string, url: string>>>,
    developers struct<developer: array<struct<id: string, name: string, email: string>>>,
    scm struct<url: string>, issueManagement struct<url: string>"""
STRUTS = """`form-beans` struct<`form-bean`: array<struct<_name: string, _type: string, _dynamic: string>>>,
    `global-forwards` struct<forward: array<struct<_name: string, _path: string, _redirect: string>>>,
    `action-mappings` struct<action: array<struct<_path: string, _type: string, _name: string, _scope: string, _validate: string, _input: string,
        forward: array<struct<_name: string, _path: string, _redirect: string>>>>>"""
# fixed values: packaging types; any other counts as jar
PACKAGING = "jar war ear pom maven-plugin ejb rar par".split()


def read_poms(spark: SparkSession, path: str) -> DataFrame:
    """A3: build files below ``path``, parsed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "pom.xml").load(path)
    return parse_poms(files.select("path", F.decode("content", "UTF-8").alias("content")))


def _built_in(p: Column) -> Column:
    # fixed values: properties every build file has
    empty = lambda c: F.coalesce(c, F.lit(""))
    parent = p["parent"]
    pairs = {
        "project.groupId": p["group_id"],
        "project.artifactId": p["artifactId"],
        "project.version": p["own_version"],
        "project.packaging": p["kind"],
        "project.name": F.coalesce(p["name"], p["artifactId"]),
        "project.description": empty(p["description"]),
        "project.url": empty(p["url"]),
        "maven.build.timestamp": F.lit("2024-01-01T00:00:00Z"),
        "maven.build.timestamp.format": F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "basedir": F.lit("."),
        "project.basedir": F.lit("."),
        "project.build.directory": F.lit("target"),
        "project.build.outputDirectory": F.lit("target/classes"),
        "project.build.testOutputDirectory": F.lit("target/test-classes"),
        "project.build.sourceDirectory": F.lit("src/main/java"),
        "project.build.testSourceDirectory": F.lit("src/test/java"),
        "project.build.finalName": F.concat_ws("-", p["artifactId"], p["own_version"]),
        "project.parent.groupId": parent["groupId"],
        "project.parent.artifactId": parent["artifactId"],
        "project.parent.version": parent["version"],
    }
    return F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def _parsed(content: str) -> Column:
    return F.from_xml(content, POM, {"rowTag": "project", "ignoreNamespace": "true"})


def _has_coordinates(x: Column) -> Column:
    return F.coalesce(
        F.coalesce(x["groupId"], x["parent"]["groupId"]).isNotNull() & x["artifactId"].isNotNull() & F.coalesce(x["version"], x["parent"]["version"]).isNotNull(),
        F.lit(False),
    )


def rejected_poms(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """A3: the build files that `parse_poms` leaves out, ``(path, reason)``."""
    bad = F.filter(F.array(_parsed(content)), lambda x: ~_has_coordinates(x))
    p = files.select(path, F.explode(bad).alias("p"))
    empty = F.coalesce("p.groupId", "p.artifactId", "p.version", "p.parent.groupId", "p.parent.version").isNull()
    return p.select(F.col(path).alias("path"), F.when(empty, "not a readable project").otherwise("coordinates missing").alias("reason"))


def parse_poms(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """A3: one row per build file with coordinates, parent, properties and nested parts.

    Group and version come from the parent where missing. Files without all three
    coordinates are left out; `rejected_poms` lists them. ``effective`` holds own and built-in properties.
    """
    # tested inside the generator, so that no filter below it parses the text again
    p = files.select(path, F.explode(F.filter(F.array(_parsed(content)), _has_coordinates)).alias("p")).select(path, "p.*")
    p = p.withColumns(
        {
            "group_id": F.coalesce("groupId", "parent.groupId"),
            "own_version": F.coalesce("version", "parent.version"),
            "kind": F.when(F.col("packaging").isin(PACKAGING), F.col("packaging")).otherwise("jar"),
            "properties": F.coalesce("properties", F.create_map().cast("map<string,string>")),
        }
    )
    own = F.col("properties")
    built = F.map_filter(_built_in(F.struct(*[F.col(c) for c in p.columns if c != path])), lambda k, _: ~F.map_contains_key(own, k))
    return p.select(
        F.col(path).alias("path"), "group_id", F.col("artifactId").alias("artifact_id"), F.col("own_version").alias("version"), F.col("kind").alias("packaging"),
        "name", "description", "url", "parent", "properties", F.map_concat(built, own).alias("effective"),
        F.coalesce("dependencies.dependency", F.array().cast(p.schema["dependencies"].dataType["dependency"].dataType)).alias("dependencies"),
        F.col("dependencyManagement.dependencies.dependency").alias("managed"), F.col("build.plugins.plugin").alias("plugins"),
        F.col("repositories.repository").alias("repositories"), F.col("profiles.profile").alias("profiles"), F.col("modules.module").alias("modules"),
        F.col("licenses.license").alias("licenses"), F.col("developers.developer").alias("developers"), F.col("scm.url").alias("scm_url"),
        F.col("issueManagement.url").alias("issue_tracker_url"),
    )


def pom_dependencies(poms: DataFrame, col: str = "dependencies") -> DataFrame:
    """A3, C20: declared (or, with ``managed``, managed) dependencies, properties resolved.

    A missing version is ``*``, a missing scope compile, a missing type jar.
    """
    rows = poms.select("path", "effective", F.col("group_id").alias("_g"), F.posexplode(col).alias("ord", "d"))
    value = lambda name: resolve_properties(F.col(f"d.{name}"), F.col("effective"))
    return rows.select(
        "path", "ord", value("groupId").alias("group_id"), value("artifactId").alias("artifact_id"),
        F.coalesce(value("version"), F.lit("*")).alias("version"), F.coalesce("d.scope", F.lit("compile")).alias("scope"),
        F.coalesce("d.type", F.lit("jar")).alias("type"), "d.classifier", (F.lower(F.coalesce("d.optional", F.lit("false"))) == "true").alias("optional"),
        F.transform("d.exclusions.exclusion", lambda e: F.concat_ws(":", e["groupId"], e["artifactId"])).alias("exclusions"),
    )


def parse_struts_config(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """One row per configuration file with action mappings, form beans and global forwards."""
    parsed = F.from_xml(content, STRUTS, {"rowTag": "struts-config", "ignoreNamespace": "true"})
    s = files.select(path, F.explode(F.array(parsed)).alias("s")).select(path, "s.*")
    text = lambda c, default="": F.coalesce(c, F.lit(default))
    forward = lambda f: F.struct(text(f["_name"]).alias("name"), text(f["_path"]).alias("path"), text(f["_redirect"], "false").alias("redirect"))
    action = lambda a: F.struct(
        text(a["_path"]).alias("path"), text(a["_type"]).alias("type"), text(a["_name"]).alias("name"), text(a["_scope"], "request").alias("scope"),
        text(a["_validate"], "true").alias("validate"), text(a["_input"]).alias("input"), F.transform(a["forward"], forward).alias("forwards"),
    )
    bean = lambda b: F.struct(text(b["_name"]).alias("name"), text(b["_type"]).alias("type"), text(b["_dynamic"], "false").alias("dynamic"))
    return s.select(
        path, F.transform("`action-mappings`.action", action).alias("action_mappings"), F.transform("`form-beans`.`form-bean`", bean).alias("form_beans"),
        F.transform("`global-forwards`.forward", forward).alias("global_forwards"),
    )


def action_mappings(configs: DataFrame, path: str = "path") -> DataFrame:
    """One row per action mapping."""
    return configs.select(F.col(path).alias("file"), F.posexplode("action_mappings").alias("ord", "a")).select("file", "ord", "a.*")
