"""Files, logs, stores and the incremental index."""

import json

import pytest
from pyspark.sql import functions as F

from portolan.functions.chunking import line_chunks
from portolan.sources import builds, catalog, files, stores


@pytest.fixture()
def repo(tmp_path):
    def put(path, data):
        p = tmp_path / "repos" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode())

    put("one/src/Main.java", "class Main {}\n")
    put("one/build/Gone.java", "x")
    put("one/target.java", "kept")
    put("two/a b+c.py", "# caf\u00e9\nimport os")
    put("two/latin.py", b"# caf\xe9")
    put("two/notes.md", "no")
    put("two/big.py", "x" * 2000)
    return tmp_path / "repos", put


def test_read_files(spark, repo):
    root, _ = repo
    got = {(r.repository, r.path): r for r in files.source_files(spark, str(root), max_bytes=1000).collect()}
    assert set(got) == {("one", "src/Main.java"), ("one", "target.java"), ("two", "a b+c.py"), ("two", "latin.py")}
    assert got[("two", "latin.py")].content == "# caf\u00e9" and got[("two", "a b+c.py")].lines == 2
    assert got[("one", "src/Main.java")].language == "java"
    few = files.read_repo_files(spark, str(root), extensions=[".py"]).select("path").collect()
    assert {r.path for r in few} == {"a b+c.py", "latin.py", "big.py"}
    (left,) = files.skipped_files(spark, str(root), 1000).collect()
    assert (left.repository, left.path, left.length, left.reason) == ("two", "big.py", 2000, "longer than 1000 bytes")
    assert "big.py" in {r.path for r in files.source_files(spark, str(root)).collect()}


def opened(df):
    """Files the scan of ``df`` has opened: those it lists, where it reads contents."""
    df.collect()
    scans, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if "FileScan" in plan.nodeName() or plan.nodeName().startswith("Scan binaryFile"):
            scans.append(plan)
        kids = plan.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    (scan,) = scans
    contents = "content" in scan.requiredSchema().fieldNames()
    return scan.metrics().apply("numFiles").value() if contents else 0


def test_only_wanted_files_are_opened(spark, repo):
    root, put = repo
    put("one/node_modules/x/y/Deep.java", "x")
    put("one/.git/Objects.java", "x")
    assert opened(files.read_repo_files(spark, str(root))) == 5
    assert opened(files.read_repo_files(spark, str(root), max_bytes=1000)) == 4
    assert opened(files.read_repo_files(spark, str(root), extensions=[".py"])) == 3
    assert opened(files.read_repo_files(spark, str(root), include=["two/**/l*.py", "src/*.java"])) == 1
    listed = files.list_repo_files(spark, str(root))
    assert opened(listed) == 0 and listed.count() == 5


@pytest.mark.parametrize("paths", [10_000, 0])
def test_a_new_look_opens_changed_files_only(spark, repo, monkeypatch, paths):
    root, put = repo
    monkeypatch.setattr(files, "MAX_PATHS", paths)
    read = []
    listed = files._listed

    def spy(*a, **b):
        read.append(b.get("only"))
        return listed(*a, **b)

    monkeypatch.setattr(files, "_listed", spy)
    none = spark.createDataFrame([], "repository string, path string, length long, modified timestamp, digest string")
    empty = line_chunks(spark.createDataFrame([], "repository string, path string, content string"), keep=["repository", "path"])
    index, chunks = files.refreshed_index(spark, str(root), none, empty)
    index, chunks = index.cache(), chunks.cache()
    assert index.count() == 5 and {r.path for r in chunks.collect()} == {r.path for r in index.collect()}
    put("one/src/Main.java", "class Main { int x; }\n")
    put("two/new.py", "import os")
    (root / "two" / "big.py").unlink()
    index2, chunks2 = files.refreshed_index(spark, str(root), index, chunks)
    asked = read[-1]
    full = files.source_files(spark, str(root))
    assert {tuple(r) for r in index2.select("repository", "path", "digest").collect()} == {tuple(r) for r in full.select("repository", "path", "digest").collect()}
    want = line_chunks(full).select("id", "chunk").collect()
    assert sorted(map(tuple, chunks2.select("id", "chunk").collect())) == sorted(map(tuple, want))
    if paths:
        assert sorted(u.rsplit("/", 1)[1] for u in asked) == ["Main.java", "new.py"]


def test_rejected_build_files(spark):
    pom = "<project><groupId>g</groupId><artifactId>{}</artifactId>{}</project>"
    rows = [("a", pom.format("a", "<version>1</version>")), ("b", pom.format("b", "")), ("c", "not xml"), ("d", None)]
    f = spark.createDataFrame(rows, "path string, content string")
    assert [r.path for r in builds.parse_poms(f).collect()] == ["a"]
    bad = {r.path: r.reason for r in builds.rejected_poms(f).collect()}
    assert bad == {"b": "coordinates missing", "c": "not a readable project", "d": "not a readable project"}


def test_decode_dropping_bad_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"ab\xffcd"),)], "bytes binary")
    assert files.decode_text(df, ignore_errors=True).first().content == "abcd"


def test_incremental_equals_full(spark, repo):
    root, put = repo
    load = lambda: files.source_files(spark, str(root)).cache()
    old = load()
    index, chunks = old.select("repository", "path", "digest"), line_chunks(old)
    index.count(), chunks.count()
    # the state before the change, apart from the files
    index, chunks = (spark.createDataFrame(d.collect(), d.schema) for d in (index, chunks))
    old.unpersist()
    put("one/src/Main.java", "class Main { int x; }\n")
    put("one/New.java", "class New {}")
    (root / "two" / "latin.py").unlink()
    now = load()
    change = {(r.repository, r.path): r.change for r in files.file_changes(now, index).collect()}
    assert change[("one", "src/Main.java")] == "changed" and change[("one", "New.java")] == "new" and change[("two", "latin.py")] == "removed"
    assert change[("two", "big.py")] == "unchanged"
    _, got = files.incremental_index(now, index, chunks)
    key = lambda df: sorted((r.id, r.chunk) for r in df.collect())
    assert key(got) == key(line_chunks(now))


def test_logs(spark, tmp_path):
    lines = [json.dumps({"timestamp": f"2024-01-0{i}", "level": "INFO", "message": f"m{i}", "component": "api"}) for i in range(1, 6)]
    (tmp_path / "a.log").write_text("\n".join(lines[:3] + ["{broken"] + lines[3:]))
    got = stores.read_app_logs(spark, str(tmp_path / "a.log"), "api", 2).collect()
    assert [r.message for r in got] == ["m5", "m4"]


def test_upserts(spark):
    a = spark.createDataFrame([("1", 1, "old"), ("2", 1, "keep")], "id string, updated_at int, text string")
    b = spark.createDataFrame([("1", 2, "new"), ("3", 2, "more")], "id string, updated_at int, text string")
    once = stores.upsert_chunks(a, b)
    want = [("1", 2, "new"), ("2", 1, "keep"), ("3", 2, "more")]
    assert sorted(tuple(r) for r in once.collect()) == want
    assert sorted(tuple(r) for r in stores.upsert_chunks(once, b).collect()) == want
    n = stores.upsert_nodes(spark.createDataFrame([("a", "x", 1)], "id string, p string, q int"), spark.createDataFrame([("a", None, 5), ("b", "z", 6)], "id string, p string, q int"), stamp=F.current_timestamp())
    got = {r.id: (r.p, r.q, r.updated_at is not None) for r in n.collect()}
    assert got == {"a": ("x", 5, True), "b": ("z", 6, True)}


def test_partitioned_upsert(spark, tmp_path):
    path = str(tmp_path / "chunks")
    cols = "id string, updated_at int, text string, repository string"
    spark.createDataFrame([("1", 1, "a", "r1"), ("2", 1, "b", "r2")], cols).write.partitionBy("repository").parquet(path)
    untouched = sorted(p.name for p in (tmp_path / "chunks" / "repository=r2").iterdir())
    new = spark.createDataFrame([("1", 2, "c", "r1"), ("3", 2, "d", "r3")], cols)
    stores.upsert_partitions(spark, path, new)
    got = sorted((r.id, r.text, r.repository) for r in spark.read.parquet(path).collect())
    assert got == [("1", "c", "r1"), ("2", "b", "r2"), ("3", "d", "r3")]
    assert untouched == sorted(p.name for p in (tmp_path / "chunks" / "repository=r2").iterdir())


def test_vectors(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.0], "r"), (2, None, "r")], "id int, vector array<float>, repository string")
    assert [r.vector for r in stores.vectors_or_none(df).collect()] == [None, None]
    stores.write_vectors(df, str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).count() == 2


def test_database_payload(spark):
    good = json.dumps({"database": {"name": "D"}, "schemas": [{"name": "S"}], "tables": [{"schema": "S", "name": "T", "columns": [{"name": "C"}]}], "foreign_keys": [{"from_table": "S.T", "to_table": "S.U"}]})
    out = catalog.load_db_objects(spark.createDataFrame([(good,)], "payload string"))
    assert {(r.src, r.dst, r.rel_type) for r in out["edges"].collect()} == {("D", "S", "CONTAINS"), ("S", "S.T", "CONTAINS"), ("S.T", "S.T.C", "HAS_COLUMN"), ("S.T", "S.U", "REFERENCES_TABLE")}
    assert ("column", "S.T.C") in {(r.kind, r.name) for r in out["nodes"].collect()}
    with pytest.raises(Exception, match="database name is required"):
        catalog.load_db_objects(spark.createDataFrame([("{}",)], "payload string"))["nodes"].collect()
