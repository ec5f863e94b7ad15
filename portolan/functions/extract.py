"""Facts pulled from source text with regular expressions.

Functions take and return columns, so a scan of source files stays inside one stage.
The patterns are fixed values.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.functions import lexer, rules
from portolan.functions.text import classify_first_match, detect_language, struts_tag_purpose

# patterns, fixed values -----------------------------------------------------------
SCRIPTLET = r"(?s)<%(?!@|--)\s*(.*?)\s*%>"
DIRECTIVE = r"(?s)<%@\s*(.*?)\s*%>"
STRUTS_TAG = r"(?i)<(html|bean|logic|nested):(\w+)([^>]*)>"
STRUTS_TAG_NAME = r"<(html|bean|logic|nested):(\w+)"
CODE_SCRIPTLET = r"(?s)<%[^@](.*?)%>"
FORM_ACTION = r"""<html:form[^>]*action\s*=\s*["']([^"']+)["']"""
DATA_ACCESS = [
    r"""<bean:write[^>]*property\s*=\s*["']([^"']+)["']""",
    r"\$\{(\w+(?:\.\w+)*)\}",
    r"""<c:out[^>]*value\s*=\s*["'][^"']*\$\{([^}]+)\}["']""",
]
IDL_INTERFACE = r"(?s)interface\s+(\w+)\s*(?::\s*([^{]+))?\s*\{([^}]+)\}"
IDL_OPERATION = r"(\w+)\s+(\w+)\s*\([^)]*\)"
VALIDATIONS = [
    (r"(?i)if\s*\(\s*([^)]+\.(?:isEmpty|isBlank|isNull))[^)]*\)", 1),
    (r"(?i)if\s*\(\s*([^)]+\s*[<>=!]+\s*[^)]+)\)", 1),
    (r"(?i)validate\w*\([^)]*\)", 0),
    (r"(?i)assert\w*\([^)]*\)", 0),
]
FORWARD = r"""(?i)mapping\.findForward\s*\(\s*["']([^"']+)["']"""
SERVICE_CALL = r"(?i)(\w+Service|\w+Manager|\w+DAO)\.(\w+)\s*\("
XML_LEAF = r"(?s)<(\w+)([^>]*)>([^<]*)</\1>"
ACTION_METHOD = r"public\s+(?:ActionForward|String|void)\s+(\w+)\s*\([^)]*\)\s*(?:throws[^{]*)?\{"
ACTION_FORM = r"(\w+Form)\s+\w+\s*=\s*\([^)]+\)\s*form"
BUSINESS_CALLS = [
    r"\.validate\s*\(", r"\.save\s*\(", r"\.update\s*\(", r"\.delete\s*\(", r"\.find\s*\(", r"\.get\w+\s*\(",
    r"if\s*\([^)]*\.equals\s*\(", r"throw\s+new\s+\w+Exception",
]
PLSQL_RULES = [
    r"(?is)\b(?:ELS)?IF\s+(.+?)\s+THEN\b", r"(?im)CHECK\s*\(\s*([^)]+)\s*\)", r"(?is)\bWHEN\s+(.+?)\s+THEN\b",
    r"""(?im)RAISE_APPLICATION_ERROR\s*\(\s*-?\d+\s*,\s*['"]([^'"]+)['"]""",
]
EMBEDDED_SQL = [
    r"""prepareStatement\s*\(\s*["']([^"']+)["']""",
    r"""createStatement\s*\(\s*\)\s*\.executeQuery\s*\(\s*["']([^"']+)["']""",
    r"""String\s+\w+\s*=\s*["']([^"']*SELECT[^"']+)["']""",
    r"""String\s+\w+\s*=\s*["']([^"']*INSERT[^"']+)["']""",
    r"""String\s+\w+\s*=\s*["']([^"']*UPDATE[^"']+)["']""",
    r"""String\s+\w+\s*=\s*["']([^"']*DELETE[^"']+)["']""",
    r"""@Select\s*\(\s*["']([^"']+)["']""",
    r"""@Insert\s*\(\s*["']([^"']+)["']""",
    r"""@Update\s*\(\s*["']([^"']+)["']""",
    r"""@Delete\s*\(\s*["']([^"']+)["']""",
    r"""createQuery\s*\(\s*["']([^"']+)["']""",
]
SQL_VERBS = ["SELECT", "INSERT", "UPDATE", "DELETE"]
SQL_TABLE = r"(?i)(?:FROM|JOIN|UPDATE|INTO)\s+([A-Za-z_][A-Za-z0-9_]*)"
SQL_SELECT_LIST = r"(?is)SELECT\s+(.*?)\s+FROM"
SQL_WHERE_COLUMN = r"(?i)WHERE.*?([A-Za-z_][A-Za-z0-9_]*)\s*[=<>!]"
QUOTED_PATH = r"""["']([/\w\-\.]+)["']"""
QUOTED = r"""['"]([^'"]+)['"]"""
FIELD_PHRASES = [rf"(\w+\s+{w})" for w in "amount field info type status date name number".split()]
GRADLE_DEPENDENCY = r"""(\w+)\s+["']([^:"']+):([^:"']+):([^"']+)["']"""
PROPERTY_REF = r"\$\{([^}]+)\}"
# Column names known for a field
FIELD_COLUMNS = {
    "specified_amount": ["SPECIFIED_AMOUNT", "SPEC_AMT", "AMOUNT_SPECIFIED"],
    "contract_type": ["CONTRACT_TYPE", "CNTRCT_TYPE", "TYPE_CODE"],
    "account_info": ["ACCOUNT_INFO", "ACCT_INFO", "ACCOUNT_DETAILS"],
    "customer_name": ["CUSTOMER_NAME", "CUST_NAME", "NAME"],
    "policy_number": ["POLICY_NUMBER", "POLICY_NUM", "PLCY_NUM"],
    "premium_amount": ["PREMIUM_AMOUNT", "PREMIUM", "PREM_AMT"],
    "effective_date": ["EFFECTIVE_DATE", "EFF_DATE", "START_DATE"],
    "status": ["STATUS", "STATUS_CODE", "STAT_CD"],
}
# A4: Gradle configuration to Maven scope, compile for any other
GRADLE_SCOPES = {
    "implementation": "compile", "compile": "compile", "api": "compile", "compileOnly": "provided", "runtimeOnly": "runtime",
    "testImplementation": "test", "testCompile": "test", "testRuntime": "test",
}
# ------------------------------------------------------------------------------------


def find_all(col: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def named_groups(col: Column, pattern: str, names: list[str]) -> Column:
    """All matches as structs of their groups, in order."""
    z = F.arrays_zip(*[find_all(col, pattern, i + 1) for i in range(len(names))])
    return F.transform(z, lambda s: F.struct(*[s[str(i)].alias(n) for i, n in enumerate(names)]))


def match_lines(content: Column, pattern: str) -> Column:
    """Zero-based line of every match, aligned with `find_all`; no match may be empty.

    Running counts of line ends over the matches and what lies between them.
    """
    ends = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    gaps = F.split(content, pattern, -1)
    both = F.transform(find_all(content, pattern, 0), lambda m, i: F.struct(ends(F.get(gaps, i)).alias("gap"), ends(m).alias("own")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("lines"))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + x["own"]).alias("at"), F.array_append(acc["lines"], acc["at"] + x["gap"]).alias("lines")
    )
    return F.aggregate(both, start, step)["lines"]


def validation_rules(code: Column) -> Column:
    """Conditions and checks in Java code, as rule texts."""
    hits = F.concat(*[find_all(code, p, g) for p, g in VALIDATIONS])
    return F.transform(hits, lambda h: F.concat(F.lit("Validation: "), h))


def struts_patterns(code: Column) -> Column:
    """Form use, forwards and service calls."""
    calls = named_groups(code, SERVICE_CALL, ["service", "method"])
    return F.struct(
        code.contains("ActionForm").alias("uses_action_form"),
        find_all(code, FORWARD).alias("forwards"),
        F.transform(calls, lambda c: F.concat_ws(".", c["service"], c["method"])).alias("business_service_calls"),
    )


def jsp_migration_notes(code: Column) -> Column:
    """Notes raised by what a scriptlet touches."""
    notes = []
    for words, note in rules.JSP_NOTES:
        hit = F.lit(False)
        for w in words:
            hit = hit | code.contains(w)
        notes.append(F.when(hit, F.lit(note)))
    return F.array_compact(F.array(*notes))


def jsp_complexity_patterns(content: Column) -> Column:
    """What makes a page hard to migrate, as ``(type, count, complexity)``."""
    scriptlets = F.regexp_count(content, F.lit(CODE_SCRIPTLET))
    tags = F.regexp_count(content, F.lit(STRUTS_TAG_NAME))
    row = lambda kind, count, level: F.struct(F.lit(kind).alias("type"), count.cast("int").alias("count"), level.alias("complexity"))
    none = F.lit(None)
    db = content.contains("Connection") | content.contains("PreparedStatement") | content.contains("ResultSet")
    return F.array_compact(
        F.array(
            F.when(scriptlets > 0, row("scriptlets", scriptlets, F.when(scriptlets > 5, "high").otherwise("medium"))),
            F.when(db, row("direct_db_access", none, F.lit("high"))),
            F.when(content.contains("session."), row("session_management", none, F.lit("medium"))),
            F.when(tags > 0, row("struts_tags", tags, F.lit("medium"))),
        )
    )


def file_migration_complexity(patterns: Column, has_struts: Column, corba: Column, rule_count: Column) -> Column:
    """Low, medium or high from what a file holds."""
    score = patterns * 2 + F.when(has_struts, 5).otherwise(0) + corba * 3 + rule_count
    return F.when(score <= 3, "low").when(score <= 10, "medium").otherwise("high")


def plsql_rules(source: Column) -> Column:
    """The first ten conditions and error texts longer than ten characters."""
    hits = F.transform(F.concat(*[find_all(source, p) for p in PLSQL_RULES]), lambda h: F.trim(h))
    return F.slice(F.filter(hits, lambda h: F.length(h) > 10), 1, 10)


def sql_type(sql: Column) -> Column:
    """Leading verb or OTHER."""
    up = F.upper(F.regexp_replace(sql, r"^\s+", ""))
    out = F.lit("OTHER")
    for verb in SQL_VERBS:
        out = F.when(up.startswith(verb), verb).otherwise(out)
    return out


def sql_tables(sql: Column) -> Column:
    """Distinct upper-case table names."""
    return F.array_distinct(F.transform(find_all(sql, SQL_TABLE), F.upper))


def sql_columns(sql: Column) -> Column:
    """Distinct upper-case names in the select list and before comparisons."""
    listed = F.regexp_extract_all(F.regexp_extract(sql, SQL_SELECT_LIST, 1), F.lit("([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    kept = F.filter(F.transform(listed, F.upper), lambda c: ~c.isin("DISTINCT", "AS"))
    return F.array_distinct(F.concat(kept, F.transform(find_all(sql, SQL_WHERE_COLUMN), F.upper)))


def extract_sql(files: DataFrame, content: str = "content") -> DataFrame:
    """Statements embedded in code, one row each, with line, type, tables and columns."""
    c = F.col(content)
    per_pattern = F.array(
        *[
            F.transform(
                F.arrays_zip(match_lines(c, f"(?is){p}"), find_all(c, f"(?is){p}", 1)),
                lambda m: F.struct(F.trim(m["1"]).alias("query_text"), m["lines"].alias("line_number")),
            )
            for p in EMBEDDED_SQL
        ]
    )
    rest = [k for k in files.columns if k != content]
    found = files.select(*rest, F.posexplode(per_pattern).alias("pattern", "_hits")).select(*rest, "pattern", F.explode("_hits").alias("_h"))
    found = found.select(*rest, "pattern", "_h.*")
    sql = F.col("query_text")
    verb = F.lit(False)
    for v in SQL_VERBS:
        verb = verb | F.upper(sql).contains(v)
    kept = found.where((F.length(sql) >= 20) & verb)
    return kept.withColumns({"query_type": sql_type(sql), "tables": sql_tables(sql), "columns": sql_columns(sql)})


def endpoints(content: Column) -> Column:
    """Distinct quoted texts that look like a path."""
    return F.array_distinct(F.filter(find_all(content, QUOTED_PATH), lambda u: u.startswith("/") & (F.length(u) > 1)))


def extract_field_name(question: Column) -> Column:
    """Quoted name, else a known phrase, else the word after "where does", else ``field``."""
    low = F.lower(question)
    some = lambda c: F.nullif(c, F.lit(""))
    after = F.split(F.trim(F.regexp_replace(F.split(low, "where does")[1], r"\s+", " ")), " ")[0]
    phrases = [some(F.trim(F.regexp_extract(low, p, 1))) for p in FIELD_PHRASES]
    return F.coalesce(
        some(F.regexp_extract(question, QUOTED, 1)),
        *phrases,
        F.when(low.contains("where does"), some(after)),
        F.lit("field"),
    )


def extract_context(question: Column) -> Column:
    """Business context of a question, empty when there is none."""
    return classify_first_match(question, rules.QUESTION_CONTEXT, "")


def column_patterns(field: Column) -> Column:
    """LIKE patterns for the columns a field may live in."""
    low = F.replace(F.lower(field), F.lit(" "), F.lit("_"))
    around = lambda c: F.concat(F.lit("%"), c, F.lit("%"))
    known = F.create_map(
        *[x for k, cols in FIELD_COLUMNS.items() for x in (F.lit(k), F.array(*[F.lit(f"%{c}%") for c in cols]))]
    )
    short = F.array_join(F.transform(F.split(low, "_"), lambda w: F.substring(w, 1, 3)), "")
    made = F.array_compact(
        F.array(
            around(F.upper(low)),
            around(F.replace(low, F.lit("_"), F.lit(""))),
            around(low),
            F.when(low.contains("_"), around(F.upper(short))),
        )
    )
    return F.coalesce(known[low], made)


def jsp_parts(files: DataFrame, content: str = "content") -> DataFrame:
    """Scriptlets, directives and Struts tags of a page, one row each."""
    c = F.col(content)
    tags = F.arrays_zip(named_groups(c, STRUTS_TAG, ["ns", "tag", "attrs"]), match_lines(c, STRUTS_TAG))
    part = lambda kind, name, text, purpose, line: F.struct(
        F.lit(kind).alias("chunk_type"), name.alias("name"), text.alias("text"), purpose.alias("business_purpose"), line.alias("line")
    )
    none = F.lit(None).cast("string")
    numbered = lambda kind, pattern: F.transform(
        F.arrays_zip(find_all(c, pattern), match_lines(c, pattern)),
        lambda m, i: part(kind, F.concat(F.lit(kind + "_"), i.cast("string")), m["0"], none, m["lines"]),
    )
    shown = F.transform(
        tags,
        lambda m: part(
            "struts_tag",
            F.concat_ws("_", m["0"]["ns"], m["0"]["tag"]),
            F.concat(F.lit("<"), m["0"]["ns"], F.lit(":"), m["0"]["tag"], m["0"]["attrs"], F.lit(">")),
            struts_tag_purpose(m["0"]["ns"], m["0"]["tag"]),
            m["lines"],
        ),
    )
    parts = F.concat(
        F.filter(numbered("scriptlet", SCRIPTLET), lambda p: F.trim(p["text"]) != ""), numbered("directive", DIRECTIVE), shown
    )
    rest = [k for k in files.columns if k != content]
    rows = files.select(*rest, F.posexplode(parts).alias("part", "_q")).select(*rest, "part", "_q.*")
    script = F.col("chunk_type") == "scriptlet"
    return rows.withColumns(
        {
            "business_rules": F.when(script, validation_rules(F.col("text"))),
            "struts": F.when(script, struts_patterns(F.col("text"))),
            "migration_notes": F.when(script, jsp_migration_notes(F.col("text"))),
        }
    )


def jsp_refs(content: Column) -> Column:
    """Distinct Struts tags, form actions and data properties of a page."""
    tags = F.transform(named_groups(content, STRUTS_TAG_NAME, ["ns", "tag"]), lambda t: F.concat_ws(":", t["ns"], t["tag"]))
    return F.struct(
        F.array_distinct(tags).alias("struts_tags"),
        F.array_distinct(find_all(content, FORM_ACTION)).alias("actions_referenced"),
        F.array_distinct(F.concat(*[find_all(content, p) for p in DATA_ACCESS])).alias("data_accessed"),
    )


def idl_interfaces(files: DataFrame, content: str = "content") -> DataFrame:
    """Interfaces with parents and operations, one row each."""
    found = named_groups(F.col(content), IDL_INTERFACE, ["name", "parents", "body"])
    rows = files.select("*", F.explode(found).alias("_i")).select("*", F.col("_i.name").alias("interface"), "_i.parents", "_i.body").drop("_i")
    ops = named_groups(F.col("body"), IDL_OPERATION, ["returns", "name"])
    return rows.withColumns(
        {
            "parents": F.filter(F.transform(F.split("parents", ","), lambda p: F.trim(p)), lambda p: p != ""),
            "operations": F.transform(ops, lambda o: F.concat_ws(" ", o["returns"], o["name"])),
        }
    ).drop("body")


def idl_extends(interfaces: DataFrame, path: str = "path") -> DataFrame:
    """Inheritance edges between interfaces of one file."""
    ident = lambda name: F.concat(F.col(path), F.lit(":interface:"), name)
    return interfaces.select(path, ident(F.col("interface")).alias("src"), F.explode("parents").alias("_p")).select("src", ident(F.col("_p")).alias("dst"), F.lit("extends").alias("rel_type"))


def action_class(code: Column) -> Column:
    """Package, class, parent, methods, forwards, form and business calls of an action class."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.struct(
        F.regexp_extract(code, r"package\s+([\w.]+)", 1).alias("package"),
        some(F.regexp_extract(code, r"class\s+(\w+)\s+extends\s+([\w.]+)", 1)).alias("class_name"),
        F.regexp_extract(code, r"class\s+(\w+)\s+extends\s+([\w.]+)", 2).alias("extends"),
        find_all(code, ACTION_METHOD).alias("methods"),
        F.array_distinct(find_all(code, FORWARD)).alias("forwards_used"),
        F.regexp_extract(code, ACTION_FORM, 1).alias("form_used"),
        F.concat(*[find_all(code, p, 0) for p in BUSINESS_CALLS]).alias("business_logic"),
    )


def struts_file_kind(path: Column, content: Column) -> Column:
    """Config, action, form, jsp or properties; null for other files and build folders."""
    skipped = path.rlike(r"(^|/)(target|build|\.git|node_modules)/")
    is_action = content.contains("extends Action") | content.contains("extends DispatchAction")
    is_form = content.contains("extends ActionForm") | content.contains("extends ValidatorForm")
    java = path.endswith(".java")
    return (
        F.when(skipped, F.lit(None))
        .when(path.rlike(r"(^|/)struts-config\.xml$"), "config")
        .when(java & is_action, "action")
        .when(java & is_form, "form")
        .when(path.rlike(r"\.(jsp|tag|tagx)$"), "jsp")
        .when(path.endswith(".properties"), "properties")
    )


def struts_summary(files: DataFrame) -> DataFrame:
    """Counts of each kind of Struts file per repository."""
    kind = struts_file_kind(F.col("path"), F.col("content"))
    return files.withColumn("_k", kind).groupBy("repository").agg(
        *[F.count_if(F.col("_k") == k).alias(f"total_{k}s") for k in ("action", "jsp", "config", "form")]
    )


def xml_config_elements(files: DataFrame, content: str = "content") -> DataFrame:
    """Leaf elements with text, one row each."""
    leaves = named_groups(F.col(content), XML_LEAF, ["tag", "attrs", "text"])
    rows = files.select("*", F.posexplode(leaves).alias("element", "_e")).select("*", "_e.*").drop("_e")
    return rows.where(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").drop(content)


def gradle_dependencies(files: DataFrame, content: str = "content") -> DataFrame:
    """A4: dependencies of a Gradle build file with Maven scopes."""
    scopes = F.create_map(*[F.lit(x) for kv in GRADLE_SCOPES.items() for x in kv])
    found = named_groups(F.col(content), GRADLE_DEPENDENCY, ["configuration", "group_id", "artifact_id", "version"])
    rows = files.select("*", F.posexplode(found).alias("position", "_d")).select("*", "_d.*").drop("_d", content)
    return rows.withColumn("scope", F.coalesce(scopes[F.col("configuration")], F.lit("compile")))


def resolve_properties(value: Column, properties: Column) -> Column:
    """C20: ``${x}`` replaced from a map in one pass; unknown names stay as they are."""
    names = F.array_distinct(find_all(value, PROPERTY_REF))
    ref = lambda n: F.concat(F.lit("${"), n, F.lit("}"))
    return F.when(
        value.contains("${"),
        F.aggregate(names, value, lambda text, n: F.replace(text, ref(n), F.coalesce(properties[n], ref(n)))),
    ).otherwise(value)


def _languages(files: DataFrame, content: str, path: str) -> Column:
    if "language" in files.columns:
        return F.col("language")
    return detect_language(F.col(path), F.col(content)) if path in files.columns else F.lit(None).cast("string")


def definitions(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """Functions, classes, imports and module variables with their lines (from 0) and the definition around them (``scope``).

    A file is read once by `lexer.defined`, which skips strings and comments. Its language is the column ``language``, else that of
    ``path``. Null contents define nothing.
    """
    rest = [c for c in files.columns if c != content]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*rest).schema.fields]
    cols = ["chunk_type string", "name string", "start_line int", "end_line int", "scope string"]
    names = [*rest, *[c.split()[0] for c in cols]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, languages = (batch.column(len(rest) + i).to_pylist() for i in (0, 1))
            rows = [(at, *d) for at, (text, language) in enumerate(zip(texts, languages, strict=True)) if text for d in lexer.defined(text, language)]
            kept = batch.select(list(range(len(rest)))).take(pa.array([r[0] for r in rows], pa.int64()))
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array([r[i + 1] for r in rows], t) for i, t in enumerate(types)]], names)

    given = files.select(*rest, F.col(content).alias("_text"), _languages(files, content, path).alias("_language"))
    return given.mapInArrow(run, ", ".join(fields + cols))


def masked_code(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """The same files with strings and comments blanked out in ``content``; lines and places stay."""
    rest = [c for c in files.columns if c != content]
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*rest, content).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, languages = (batch.column(len(rest) + i).to_pylist() for i in (0, 1))
            code = [None if t is None else lexer.masked(t, x) for t, x in zip(texts, languages, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(code, pa.string())], [*rest, content])

    given = files.select(*rest, F.col(content).alias("_text"), _languages(files, content, path).alias("_language"))
    return given.mapInArrow(run, ", ".join(fields))


def code_edges(defs: DataFrame, files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Calls, inheritance and imports as edges ``([repository,] path, src, dst, rel_type, line)``, none from strings or comments.

    A call belongs to the innermost function of its own file whose lines hold it, or to the file.
    Paths may recur in several repositories; ``repository`` is carried along where there is one.
    """
    file = [k for k in ("repository", path) if k in files.columns]
    lines = masked_code(files, content, path).select(*file, F.posexplode(F.split(content, "\n", -1)).alias("line", "text"))
    called = F.array_except(
        find_all(F.col("text"), r"\b([A-Za-z_]\w*)\s*\("),
        F.array(*[F.lit(w) for w in "if for while switch catch return def function func fn class print super elif with".split()]),
    )
    # a name that is defined on its line is not called there
    own = defs.where("chunk_type LIKE '%definition'").select(*file, F.col("start_line").alias("line"), "name").distinct()
    calls = lines.select(*file, "line", F.explode(called).alias("name")).join(own, [*file, "line", "name"], "left_anti")
    funcs = defs.where("chunk_type = 'function_definition'").select(*file, F.col("name").alias("owner"), "start_line", "end_line")
    # a function's lines, so that the lookup is an equi-join
    spans = funcs.select(*file, "owner", "start_line", F.explode(F.sequence("start_line", "end_line")).alias("line"))
    inner = spans.groupBy(*file, "line").agg(F.max_by("owner", "start_line").alias("owner"))
    call_rows = calls.join(inner, [*file, "line"], "left").select(
        *file,
        F.coalesce(F.concat(F.lit("function:"), "owner"), F.concat(F.lit("file:"), path)).alias("src"),
        F.concat(F.lit("function:"), "name").alias("dst"), F.lit("calls").alias("rel_type"), "line",
    )
    parents = lines.select(
        *file,
        "line",
        F.regexp_extract("text", r"class\s+(\w+)", 1).alias("name"),
        F.explode(
            F.filter(
                F.transform(
                    F.split(
                        F.concat_ws(
                            ",",
                            F.regexp_extract("text", r"class\s+\w+\s*\(([^)]*)\)", 1),
                            F.regexp_extract("text", r"class\s+\w+\s+(?:extends|implements)\s+([\w., ]+)", 1),
                        ),
                        r"\s*,\s*|\s+implements\s+",
                    ),
                    lambda p: F.trim(p),
                ),
                lambda p: p.rlike(r"^[\w.]+$"),
            )
        ).alias("parent"),
    ).select(
        *file,
        F.concat(F.lit("class:"), "name").alias("src"), F.concat(F.lit("class:"), "parent").alias("dst"),
        F.lit("inherits").alias("rel_type"), "line",
    )
    imports = defs.where("chunk_type = 'import'").select(
        *file,
        F.concat(F.lit("file:"), path).alias("src"), F.concat(F.lit("module:"), "name").alias("dst"),
        F.lit("imports").alias("rel_type"), F.col("start_line").alias("line"),
    )
    return call_rows.unionByName(parents).unionByName(imports)
