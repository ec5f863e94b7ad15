"""Text functions, chunkers and extraction on hand-checked inputs."""

from pyspark.sql import functions as F

from portolan.functions import chunking, extract, text, versions


def value(spark, column, **inputs):
    row = {k: v for k, v in inputs.items()} or {"x": 1}
    return spark.createDataFrame([tuple(row.values())], list(row)).select(column.alias("v")).first().v


def plain_chunks(content, size=1000, back=4):
    """The chunk rule, line by line."""
    out, cur, length = [], [], 0
    for line in content.split("\n"):
        if length + len(line) > size and cur:
            out.append(cur)
            cur = (cur[-back:] if len(cur) > back else []) + [line]
            length = sum(len(x) for x in cur)
        else:
            cur.append(line)
            length += len(line)
    return ["\n".join(c) for c in out + [cur] if "\n".join(c).strip()]


def test_line_chunks_sizes():
    lines = [f"{i}" * 300 for i in range(10)]
    assert [b - a + 1 for a, b, _ in chunking.line_cuts("\n".join(lines))] == [3, 3, 3, 1]
    lines = [str(i) * 150 for i in range(10)]
    assert [(a + 1, b + 1) for a, b, _ in chunking.line_cuts("\n".join(lines))] == [(1, 6), (3, 8), (5, 10)]


def test_line_chunks_of_all_documents(spark, tables):
    got = {}
    for r in chunking.line_chunks(tables.chunks, keep=["repository", "id"]).collect():
        got.setdefault(r["id"].split(":")[1], []).append((r.chunk_index, r.chunk))
    for doc in tables.documents.collect():
        assert [c for _, c in sorted(got.get(str(doc.doc_id), []))] == plain_chunks(doc.text)


def test_semantic_chunks(spark, tables):
    def plain(content, size=1000, least=100):
        lines, out, cur = content.split("\n"), [], []
        for i, line in enumerate(lines):
            cur.append(line)
            edge = not line.strip() or (i < len(lines) - 1 and not lines[i + 1].strip()) or len("\n".join(cur)) >= size
            if edge and len("\n".join(cur)) >= least:
                out.append("\n".join(cur))
                cur = []
        return out + (["\n".join(cur)] if cur and len("\n".join(cur)) >= least else [])

    for doc in tables.documents.collect():
        assert [t for _, _, t in chunking.semantic_cuts(doc.text)] == plain(doc.text)


def test_blocks_and_offsets(spark):
    code = "x = 1\nif x:\n  y\nelse:\n  z"
    f = spark.createDataFrame([("p", "python", code)], "path string, language string, content string")
    got = chunking.logical_blocks(f).orderBy("chunk_index").collect()
    assert [r.chunk for r in got] == ["x = 1", "if x:\n  y", "else:\n  z"]
    assert [(r.start_byte, r.end_byte) for r in got] == [(0, 6), (6, 16), (16, len(code) + 1)]


def test_block_words_are_whole_words():
    code = "a\nformat(x)\ndefault = 2\nwithdraw(1)\nif_x = 1\nfor(x)\nwith y:"
    assert [a for a, _, _ in chunking.block_cuts(code)] == [0, 5, 6]


def test_table_functions(spark):
    chunking.register(spark)
    spark.createDataFrame([("\n".join("a" * 300 for _ in range(4)),)], "content string").createOrReplaceTempView("some_files")
    got = spark.sql("SELECT chunk_index, start_line, end_line FROM some_files, LATERAL line_chunks(content, 1000)").collect()
    assert [tuple(r) for r in got] == [(0, 0, 2), (1, 3, 3)]


def test_complexity(spark):
    code = "if a:\n  pass\nelif b:\n  pass"
    assert value(spark, text.complexity(F.lit(code))) == 1.0
    assert value(spark, text.regex_complexity(F.lit("if (a) { while (b) {} } elif"))) == 3
    assert value(spark, text.regex_complexity(F.lit(None).cast("string"))) == 1


def test_prefix_similarity(spark):
    assert value(spark, text.prefix_similarity(F.lit("getUser"), F.lit("getUsers"))) == 7 / 8
    assert value(spark, text.prefix_similarity(F.lit("a"), F.lit("b"))) == 0.0
    assert value(spark, text.prefix_similarity(F.lit("same"), F.lit("same"))) == 1.0


def test_excluded_paths(spark):
    f = lambda p: value(spark, text.is_excluded(F.lit(p), ["**/build/**", "*.class", "**/*.jar"]))
    assert f("a/build/x.java") and f("build/x.java") and f("a/B.class") and f("lib/x.jar")
    assert not f("rebuild/x.java") and not f("a/builder.java") and not f("x.jar")


def test_domains(spark):
    assert value(spark, text.classify_domain(F.lit("LoginService"), F.lit("check the password"))) == "authentication"
    assert value(spark, text.classify_domain(F.lit(None).cast("string"), F.lit("zzz"))) is None
    assert value(spark, text.classify_repository_domain(F.lit("My-Billing-Repo"))) == "billing"
    assert value(spark, text.classify_repository_domain(F.lit("thing"))) == "general"


def test_versions(spark):
    order = ["1.0.dev1", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0.post1", "1.0.1", "1.10", "2.0", "1!0.1"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(order)], "i int, v string")
    keyed = df.withColumn("k", versions.version_key(F.col("v")))
    assert [r.i for r in keyed.orderBy("k").collect()] == list(range(len(order)))
    same = df.sparkSession.createDataFrame([("1.0", "1"), ("v1.0.0", "1.0")], "a string, b string")
    assert all(r.e for r in same.select((versions.version_key(F.col("a")) == versions.version_key(F.col("b"))).alias("e")).collect())
    assert value(spark, versions.version_key(F.lit("1.0.Final"))) is None


def test_ranges(spark):
    inside = lambda v, r: value(spark, versions.version_in_range(F.lit(v), F.lit(r)))
    assert inside("1.0", "[1.0,2.0)") and inside("1.9.9", "[1.0,2.0)") and not inside("2.0", "[1.0,2.0)")
    assert inside("3.0", "1.0") and not inside("0.9", "1.0")
    assert not inside("1.0", "(1.0,2.0]") and inside("2.0", "(1.0,2.0]") and not inside("odd", "[1.0,2.0)")


def test_severity(spark):
    sev = lambda *v: value(spark, versions.conflict_severity(F.array(*[F.lit(x) for x in v])))
    assert sev("1.0", "2.0") == "critical" and sev("1.0", "1.1", "1.2") == "high" and sev("1.0", "1.1") == "medium"
    assert sev("1.0", "1.0rc1") == "high" and sev("1.0", "1.0.Final") == "medium" and sev("*") == "low"


def test_sql(spark):
    java = 'a\nString q = "SELECT id, name FROM users JOIN orders ON x = y WHERE age > 1";\n@Update("update  t set a = 1 where b = 2")'
    f = spark.createDataFrame([("F.java", java)], "path string, content string")
    got = {r.query_type: r for r in extract.extract_sql(f).collect()}
    assert set(got["SELECT"].tables) == {"USERS", "ORDERS"} and got["SELECT"].line_number == 1
    assert set(got["SELECT"]["columns"]) == {"ID", "NAME", "AGE"}
    assert got["UPDATE"].tables == ["T"] and got["UPDATE"].line_number == 2
    same = 'String a = "SELECT id FROM users WHERE x";\n\n\nString a = "SELECT id FROM users WHERE x";'
    g = spark.createDataFrame([("G.java", same)], "path string, content string")
    assert sorted(r.line_number for r in extract.extract_sql(g).collect()) == [0, 3]


def test_jsp(spark):
    page = '<%@ page x %>\n<% if (a.isEmpty()) { session.getAttribute("u"); } %>\n<html:text property="n"/>'
    f = spark.createDataFrame([("p.jsp", page)], "path string, content string")
    got = extract.jsp_parts(f).orderBy("part").collect()
    assert [r.chunk_type for r in got] == ["scriptlet", "directive", "struts_tag"]
    assert got[0].line == 1 and "Validation: a.isEmpty" in got[0].business_rules and len(got[0].migration_notes) == 1
    assert got[2].business_purpose == "Text input field" and got[2].line == 2


def test_jsp_lines_of_repeats(spark):
    page = '<%-- if x --%>\n<%@ include file="if x" %>\n<% if x %>\n\n<% if x %><bean:write a="1"/>\n<bean:write a="1"/>'
    f = spark.createDataFrame([("p.jsp", page)], "path string, content string")
    got = [(r.chunk_type, r.text, r.line) for r in extract.jsp_parts(f).orderBy("part").collect()]
    assert got == [
        ("scriptlet", "if x", 2), ("scriptlet", "if x", 4), ("directive", 'include file="if x"', 1),
        ("struts_tag", '<bean:write a="1"/>', 4), ("struts_tag", '<bean:write a="1"/>', 5),
    ]


def test_definitions_and_edges(spark):
    code = "import os\n\nclass A(Base):\n    def run(self):\n        return helper(1)\n\ndef helper(x):\n    return x\n\nLIMIT = 3"
    f = spark.createDataFrame([("m.py", code)], "path string, content string")
    defs = extract.definitions(f)
    got = {(r.chunk_type, r.name): (r.start_line, r.end_line) for r in defs.collect()}
    assert got[("class_definition", "A")] == (2, 5) and got[("function_definition", "run")] == (3, 5)
    assert got[("import", "os")] == (0, 0) and got[("variable", "LIMIT")] == (9, 9)
    e = {(r.src, r.dst, r.rel_type) for r in extract.code_edges(defs, f).collect()}
    assert ("function:run", "function:helper", "calls") in e and ("class:A", "class:Base", "inherits") in e
    assert ("file:m.py", "module:os", "imports") in e


def test_edges_stay_in_their_repository(spark):
    rows = [("r1", "m.py", "def a():\n    x = 1\n    go(1)"), ("r2", "m.py", "def a():\n    pass\ndef b():\n    pass")]
    f = spark.createDataFrame(rows, "repository string, path string, content string")
    e = {(r.repository, r.src, r.dst) for r in extract.code_edges(extract.definitions(f), f).collect()}
    assert e == {("r1", "function:a", "function:go")}


def test_questions(spark):
    field = lambda q: value(spark, extract.extract_field_name(F.lit(q)))
    assert field("Where does 'Specified Amount' come from?") == "Specified Amount"
    assert field("show the premium amount") == "premium amount" and field("Where does x1 go") == "x1" and field("hm") == "field"
    assert value(spark, extract.column_patterns(F.lit("policy number")))[0] == "%POLICY_NUMBER%"


def test_plsql_and_struts(spark):
    assert value(spark, extract.plsql_rules(F.lit("CHECK (amou > 1000000)"))) == ["amou > 1000000"]
    rules = "IF policy_amount > max_amount THEN a; ELSIF the_net IS NULL\nTHEN b; END IF; CASE WHEN holder_type = 'T' THEN 1 END"
    assert value(spark, extract.plsql_rules(F.lit(rules))) == ["policy_amount > max_amount", "the_net IS NULL", "holder_type = 'T'"]
    s = value(spark, extract.struts_patterns(F.lit('ActionForm f; OrderService.load(1); mapping.findForward("ok")')))
    assert s.uses_action_form and s.forwards == ["ok"] and s.business_service_calls == ["OrderService.load"]
