"""Resolution, management and build files on small inputs."""

import pytest
from pyspark.sql import functions as F

from portolan.operators import dependencies as deps
from portolan.plans import reports
from portolan.sources import builds


@pytest.fixture()
def three(spark):
    rows = [("g", "x", "1.0", 2, 1, False), ("g", "x", "2.0", 1, 2, False), ("g", "x", "1.5", 3, 3, True), ("g", "y", "1.0", 1, 4, False)]
    return spark.createDataFrame(rows, "group_id string, artifact_id string, version string, depth int, ord int, managed boolean")


@pytest.mark.parametrize("strategy, version", [("nearest", "2.0"), ("newest", "2.0"), ("oldest", "1.0"), ("managed", "1.5")])
def test_strategies(three, strategy, version):
    got = {r.artifact_id: r for r in deps.resolve_conflicts(three, strategy).collect()}
    assert got["x"].version == version and got["x"].conflict_resolution == strategy and got["x"].candidates == 3
    assert got["y"].version == "1.0" and got["y"].conflict_resolution is None


def test_fail_strategy(three):
    with pytest.raises(Exception, match="unresolved conflict: g:x"):
        deps.resolve_conflicts(three, "fail").collect()


def test_invalid_versions_compare_as_text(spark):
    rows = [("g", "x", "9.Final", 1, 1), ("g", "x", "10.0", 1, 2)]
    d = spark.createDataFrame(rows, "group_id string, artifact_id string, version string, depth int, ord int")
    assert deps.resolve_conflicts(d, "newest").first().version == "9.Final"


def test_conflict_and_impact(three):
    (c,) = deps.version_conflicts(three).collect()
    assert (c.version_count, c.dependency_count, c.severity) == (3, 3, "critical")
    (i,) = deps.conflict_impact(three.withColumn("scope", F.lit("compile"))).collect()
    assert i.breaking_changes_risk and not i.api_compatibility_risk and (i.min_depth, i.max_depth) == (1, 3)


def test_health(spark):
    row = deps.dependency_health(spark.createDataFrame([(3, 1, 2)], "conflicts int, cycles int, vulnerabilities int")).first()
    assert (row.health_score, row.grade) == (69.0, "D")


POM = """<?xml version="1.0"?><project xmlns="http://maven.apache.org/POM/4.0.0">
<parent><groupId>org.p</groupId><artifactId>parent</artifactId><version>7</version></parent>
<artifactId>app</artifactId><properties><dep.v>2.5</dep.v></properties>
<dependencyManagement><dependencies><dependency><groupId>m</groupId><artifactId>managed</artifactId><version>3.0</version></dependency></dependencies></dependencyManagement>
<dependencies>
<dependency><groupId>a</groupId><artifactId>prop</artifactId><version>${dep.v}</version></dependency>
<dependency><groupId>m</groupId><artifactId>managed</artifactId></dependency>
<dependency><groupId>b</groupId><artifactId>banned</artifactId><version>1</version></dependency>
<dependency><groupId>t</groupId><artifactId>only</artifactId><version>${no.such}</version><scope>test</scope></dependency>
</dependencies><licenses><license><name>MIT</name></license></licenses></project>"""


def test_pom(spark):
    poms = builds.parse_poms(spark.createDataFrame([("r/pom.xml", POM)], "path string, content string"))
    p = poms.first()
    assert (p.group_id, p.artifact_id, p.version, p.packaging) == ("org.p", "app", "7", "jar")
    assert p.licenses[0].name == "MIT" and p.effective["project.build.finalName"] == "app-7"
    declared = builds.pom_dependencies(poms)
    assert {r.artifact_id: r.version for r in declared.collect()} == {"prop": "2.5", "managed": "*", "banned": "1", "only": "${no.such}"}
    banned = spark.createDataFrame([("b", "banned")], "group_id string, artifact_id string")
    kept = deps.apply_management(deps.include_dependencies(declared, banned), builds.pom_dependencies(poms, "managed"))
    assert {r.artifact_id: (r.version, r.managed) for r in kept.collect()} == {"prop": ("2.5", False), "managed": ("3.0", True)}


def test_struts_config(spark):
    xml = """<struts-config><form-beans><form-bean name="f" type="F"/></form-beans>
    <global-forwards><forward name="home" path="/h.jsp"/></global-forwards>
    <action-mappings><action path="/a" type="A" name="f"><forward name="ok" path="/ok.jsp" redirect="true"/></action><action path="/b" type="B"/></action-mappings></struts-config>"""
    c = builds.parse_struts_config(spark.createDataFrame([("s.xml", xml)], "path string, content string"))
    rows = builds.action_mappings(c).collect()
    assert [(r.path, r.type, r.scope, r.validate) for r in rows] == [("/a", "A", "request", "true"), ("/b", "B", "request", "true")]
    assert rows[0].forwards[0].redirect == "true" and c.first().global_forwards[0].name == "home"


def test_versions_are_parsed_once_and_ranked(spark):
    seen = ["1.0", "1.0.0", "1.0rc1", "2.0", "10.1", "x", "", "*", "1.0.dev1", "1.0.post1"]
    df = spark.createDataFrame([(v,) for v in seen * 3 + [None]], "version string")
    got = {r.version: r for r in deps.version_dictionary(df).collect()}
    assert set(got) == set(seen)
    order = sorted((v for v in seen if got[v].valid), key=lambda v: (got[v].place, v))
    assert order == ["1.0.dev1", "1.0rc1", "1.0", "1.0.0", "1.0.post1", "2.0", "10.1"]
    assert got["1.0"].place == got["1.0.0"].place and got["x"].place is None and got["10.1"].major == 10 and got["2.0"].minor == 0


def test_conflicts_of_odd_versions(spark):
    rows = [("a", "1.0"), ("a", "1.1"), ("a", "1.2"), ("b", "1.0"), ("b", "2.0"), ("c", "1.0"), ("c", "bad"), ("d", None), ("d", "1"), ("e", ""), ("e", "*")]
    rows += [("f", "1.0"), ("f", "1.0rc1"), ("g", "1.0"), ("g", "1.0.1"), (None, "1"), (None, "2")]
    df = spark.createDataFrame([("x", a, v) for a, v in rows * 2], "group_id string, artifact_id string, version string")
    got = {r.artifact_id: (r.version_count, r.dependency_count, r.severity) for r in deps.version_conflicts(df).collect()}
    assert got == {"a": (3, 6, "high"), "b": (2, 4, "critical"), "c": (2, 4, "medium"), "e": (2, 4, "low"), "f": (2, 4, "high"), "g": (2, 4, "medium"), None: (2, 4, "critical")}


def test_shared_artifacts_with_null_coordinates(spark):
    rows = [("r1", "g", "x", "1.0"), ("r2", "g", "x", "2.0"), ("r1", None, "y", "a"), ("r2", None, "y", None), ("r1", "g", "z", "1")]
    df = spark.createDataFrame(rows, "repo string, group_id string, artifact_id string, version string")
    got = {r.artifact_id: (r.usage_count, r.version_count, r.latest_version, r.major_count) for r in reports.shared_dependencies(df).collect()}
    assert got == {"x": (2, 2, "2.0", 2), "y": (2, 1, "a", 0)}
