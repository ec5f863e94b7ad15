"""Text, classification and extraction queries."""

from pyspark.sql import functions as F

from portolan.functions import chunking, extract, rules, text, versions
from portolan.queries.registry import query
from portolan.session import widen


def sql_list(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def count_words(col, words):
    """DuckDB: sum of non-overlapping substring counts."""
    return " + ".join(f"(length({col}) - length(replace({col}, '{w}', ''))) / {len(w)}" for w in words)


def any_of(col, words):
    return "(" + " OR ".join(f"suffix({col}, '{w[1:]}')" if w.startswith("$") else f"contains({col}, '{w}')" for w in words) + ")"


def first_match(col, rule_list, default):
    """DuckDB: the CASE chain of a rule list over an expression."""
    whens = " ".join(f"WHEN {any_of(col, words)} THEN '{label}'" for label, words in rule_list)
    return f"CASE {whens} ELSE {default} END"


def block_start(language):
    """DuckDB: the pattern of a line that starts a block."""
    return "^\\s*(?:" + "|".join(rules.BLOCK_WORDS[language]) + ")\\b"


def joined(col):
    """A list column as sorted, comma-joined text."""
    return F.array_join(F.array_sort(col), ",")


def sorted_list(expr):
    return f"array_to_string(list_sort({expr}), ',')"


@query("needs_split", """
    SELECT id, length(content) > 1000 OR size > 3000 AS needs_split FROM chunks""")
def _(t):
    c = t.chunks
    return c.select("id", text.needs_split(F.col("content"), F.col("size") / 600).alias("needs_split"))


@query("identifiers", """
    SELECT id, md5(concat(file_path, ':', repository, ':', chunk_index)) AS chunk_id FROM chunks""")
def _(t):
    return t.chunks.select("id", text.chunk_id(F.col("file_path"), F.col("repository"), F.col("chunk_index")).alias("chunk_id"))


@query("conflict_ids", """
    SELECT group_id, artifact_id, substr(md5(concat(group_id, ':', artifact_id, ':[',
           string_agg(concat('''', version, ''''), ', ' ORDER BY version), ']')), 1, 8) AS conflict_id
    FROM (SELECT DISTINCT group_id, artifact_id, version FROM repo_artifacts) GROUP BY group_id, artifact_id""")
def _(t):
    # at most 21 versions exist: seven line numbers by three minor numbers
    seen = t.repo_artifacts.groupBy("group_id", "artifact_id").agg(F.collect_set("version").alias("v"))
    return seen.select("group_id", "artifact_id", text.conflict_id(text.ga(F.col("group_id"), F.col("artifact_id")), F.col("v")).alias("conflict_id"))


WORDS = ["then", "tion", "on", "ou"]


@query("complexity", f"""
    SELECT doc_id, round((1 + {count_words('text', rules.DECISION_WORDS)} + {count_words('text', WORDS)}) /
           (length(text) - length(replace(text, chr(10), '')) + 1), 6) AS complexity FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.round(text.complexity(F.col("text"), rules.DECISION_WORDS + WORDS), 6).alias("complexity"))


@query("regex_complexity", """
    SELECT id, length(regexp_extract_all(content, '\\b(if|while|for|try|catch|switch)\\b')) + 1 AS complexity FROM source_files""")
def _(t):
    return t.source_files.select("id", text.regex_complexity(F.col("content")).cast("long").alias("complexity"))


@query("line_counts", """
    SELECT doc_id, length(string_split(text, chr(10))) AS lines, length(text) AS size FROM documents""")
def _(t):
    return t.documents.select("doc_id", text.line_count(F.col("text")).cast("long").alias("lines"), F.length("text").cast("long").alias("size"))


@query("context_windows", """
    WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x, doc_id % 7 AS s, doc_id % 7 + 2 AS e FROM documents)
    SELECT doc_id, array_to_string(x[greatest(0, s - 3) + 1 : s], chr(10)) AS before, array_to_string(x[e + 2 : e + 4], chr(10)) AS after FROM l""")
def _(t):
    s = (F.col("doc_id") % 7).cast("int")
    before, after = text.context_window(F.col("text"), s, s + 2)
    return t.documents.select("doc_id", before.alias("before"), after.alias("after"))


@query("name_similarity", """
    WITH p AS (SELECT src, dst, a.p_name AS x, b.p_name AS y FROM part_edges JOIN part a ON src = a.p_partkey JOIN part b ON dst = b.p_partkey)
    SELECT src, dst, round(CASE WHEN x = y THEN 1 ELSE
           len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: substr(x, 1, i) = substr(y, 1, i))) / greatest(length(x), length(y)) END, 6) AS similarity
    FROM p""")
def _(t):
    n = t.part.select("p_partkey", "p_name")
    e = t.part_edges.join(n.toDF("src", "x"), "src").join(n.toDF("dst", "y"), "dst")
    return e.select("src", "dst", F.round(text.prefix_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


@query("content_flags", "SELECT doc_id, " + ", ".join(
    f"{any_of('lower(text)', words)} AS {name}" for name, words in rules.CONTENT_FLAGS.items()) + " FROM documents")
def _(t):
    return t.documents.select("doc_id", *[c.alias(n) for n, c in text.content_flags(F.col("text")).items()])


def chunk_domain_sql(name, content):
    return [
        (d, " + ".join(
            f"CASE WHEN contains({name}, '{w}') THEN 3 ELSE 0 END + CASE WHEN contains({content}, '{w}') THEN 1 ELSE 0 END"
            for w in words.split()
        ))
        for d, words in rules.CHUNK_DOMAINS
    ]


@query("chunk_domains", f"""
    WITH b AS (SELECT id, lower(path) AS n, lower(content) AS c FROM source_files),
    s AS (SELECT id, [{', '.join(f"({s})" for _, s in chunk_domain_sql('n', 'c'))}] AS scores FROM b)
    SELECT id, CASE WHEN list_max(scores) >= 2 THEN {sql_list([d for d, _ in rules.CHUNK_DOMAINS])}[list_position(scores, list_max(scores))] END AS domain
    FROM s""")
def _(t):
    return widen(t.source_files).select("id", text.classify_domain(F.col("path"), F.col("content")).alias("domain"))


@query("document_domains", f"""
    WITH b AS (SELECT doc_id, lower(source) AS n, lower(text) AS c FROM documents),
    s AS (SELECT doc_id, [{', '.join(f"({s})" for _, s in chunk_domain_sql('n', 'c'))}] AS scores FROM b)
    SELECT doc_id, CASE WHEN list_max(scores) >= 2 THEN {sql_list([d for d, _ in rules.CHUNK_DOMAINS])}[list_position(scores, list_max(scores))] END AS domain
    FROM s""")
def _(t):
    return widen(t.documents).select("doc_id", text.classify_domain(F.col("source"), F.col("text")).alias("domain"))


REPO_NAMES = "concat(lower(p_type), CASE p_size % 9 WHEN 0 THEN '-billing-api' WHEN 1 THEN '-auth-web' WHEN 2 THEN '-user-service' WHEN 3 THEN '-metrics' ELSE '-core' END)"


@query("repository_domains", f"""
    WITH b AS (SELECT p_partkey, {REPO_NAMES} AS n, CASE WHEN p_size % 11 = 0 THEN p_brand ELSE '' END AS given FROM part),
    s AS (SELECT *, [{', '.join('(' + ' + '.join(f"CASE WHEN contains(n, '{w}') THEN 2 ELSE 0 END" for w in words.split()) + ')' for _, words in rules.REPOSITORY_DOMAINS)}] AS scores FROM b)
    SELECT p_partkey, CASE WHEN given <> '' THEN given WHEN list_max(scores) > 0
           THEN {sql_list([d for d, _ in rules.REPOSITORY_DOMAINS])}[list_position(scores, list_max(scores))] ELSE 'general' END AS domain FROM s""")
def _(t):
    p = t.part.selectExpr("p_partkey", f"{REPO_NAMES} AS n", "CASE WHEN p_size % 11 = 0 THEN p_brand ELSE '' END AS given")
    return p.select("p_partkey", text.classify_repository_domain(F.col("n"), F.col("given")).alias("domain"))


# names that hit many of the rules, written out of the parts
NAMES = """concat(CASE p_size % 12 WHEN 0 THEN 'CUST_ACCT' WHEN 1 THEN 'policy_code' WHEN 2 THEN 'org.apache.struts' WHEN 3 THEN 'log4j-history'
    WHEN 4 THEN 'Validate User' WHEN 5 THEN 'order-amount_type' WHEN 6 THEN 'claim.jsp' WHEN 7 THEN 'commons-lookup' WHEN 8 THEN '/api/admin/report'
    WHEN 9 THEN 'springframework_name' WHEN 10 THEN 'status_date' ELSE 'plain' END, '.', p_type, CASE p_size % 5 WHEN 0 THEN '_ID' WHEN 1 THEN '.xml' WHEN 2 THEN '.java' ELSE '' END)"""


@query("first_match_labels", f"""
    WITH b AS (SELECT p_partkey, {NAMES} AS n, lower({NAMES}) AS lo, upper({NAMES}) AS up FROM part)
    SELECT p_partkey, {first_match('up', rules.TABLE_DOMAIN, "'business_data'")} AS table_domain,
           {first_match('lo', rules.RULE_DOMAIN, "'general'")} AS rule_domain,
           {first_match('lo', rules.DEPENDENCY_FRAMEWORK, "'other'")} AS framework,
           {first_match('lo', rules.ACTION_DOMAIN, "'General'")} AS action_domain,
           {first_match('up', rules.TABLE_CONTEXT, "'business_data'")} AS table_context,
           {first_match('up', rules.COLUMN_PURPOSE, "'Business data field'")} AS column_purpose,
           CASE WHEN contains(n, '/api/') THEN 'API Endpoint' ELSE {first_match('lo', rules.ENDPOINT_TYPE, "'Web Page'")} END AS endpoint_type,
           {first_match('n', rules.FILE_TYPE, "'Other'")} AS file_type,
           {first_match('n', rules.LEGACY_FILE_KIND, "'other_files'")} AS file_kind,
           coalesce({first_match('lo', rules.SQL_CONTEXT_PATH, 'NULL')}, {first_match('lo', rules.SQL_CONTEXT_TEXT, "'general_data_access'")}) AS sql_context,
           {first_match('lo', rules.QUESTION_CONTEXT, "''")} AS question_context,
           {first_match('lo', rules.SECURITY_ADVICE, "'" + rules.SECURITY_ADVICE_DEFAULT + "'")} AS advice
    FROM b""")
def _(t):
    n = F.col("n")
    fm = text.classify_first_match
    return t.part.selectExpr("p_partkey", f"{NAMES} AS n").select(
        "p_partkey",
        fm(n, rules.TABLE_DOMAIN, "business_data", "upper").alias("table_domain"),
        fm(n, rules.RULE_DOMAIN, "general").alias("rule_domain"),
        fm(n, rules.DEPENDENCY_FRAMEWORK, "other").alias("framework"),
        fm(n, rules.ACTION_DOMAIN, "General").alias("action_domain"),
        fm(n, rules.TABLE_CONTEXT, "business_data", "upper").alias("table_context"),
        text.column_purpose(n).alias("column_purpose"),
        text.endpoint_type(n).alias("endpoint_type"),
        fm(n, rules.FILE_TYPE, "Other", "keep").alias("file_type"),
        fm(n, rules.LEGACY_FILE_KIND, "other_files", "keep").alias("file_kind"),
        text.sql_context(n, n).alias("sql_context"),
        extract.extract_context(n).alias("question_context"),
        fm(n, rules.SECURITY_ADVICE, rules.SECURITY_ADVICE_DEFAULT).alias("advice"),
    )


@query("label_maps", """
    SELECT p_partkey,
        CASE p_type WHEN 'SMALL' THEN 'User input form' WHEN 'LARGE' THEN 'Data display' ELSE concat('UI component: ', lower(p_type)) END AS tag_purpose,
        CASE p_type WHEN 'PROMO' THEN 'File' WHEN 'ECONOMY' THEN 'Endpoint' ELSE 'Unknown' END AS visual_label,
        CASE p_type WHEN 'SMALL' THEN 'Int' WHEN 'LARGE' THEN 'Float' WHEN 'PROMO' THEN 'ID' WHEN 'MEDIUM' THEN 'Boolean' ELSE 'String' END AS graphql_type
    FROM part""")
def _(t):
    pick = lambda pairs, other: F.expr("CASE p_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs) + f" ELSE {other} END")
    ns = pick([("SMALL", "html"), ("LARGE", "bean")], "'html'")
    tag = pick([("SMALL", "form"), ("LARGE", "write")], "lower(p_type)")
    label = pick([("PROMO", "File"), ("ECONOMY", "Endpoint")], "p_type")
    kind = pick([("SMALL", "Long"), ("LARGE", "BigDecimal"), ("PROMO", "UUID"), ("MEDIUM", "boolean")], "p_name")
    return t.part.select(
        "p_partkey", text.struts_tag_purpose(ns, tag).alias("tag_purpose"), text.visual_label(label).alias("visual_label"), text.graphql_type(kind).alias("graphql_type")
    )


IMPORTANCE = """0.5 * CASE WHEN p_type = 'ECONOMY' THEN 2 WHEN p_type = 'LARGE' THEN 1.6 WHEN p_type = 'MEDIUM' THEN 1.2 WHEN p_type = 'PROMO' THEN 0.6
           WHEN p_type = 'SMALL' THEN 0.4 ELSE 1 END + least(p_size / 100.0, 0.5) + CASE WHEN p_size % 2 = 0 THEN 0.3 ELSE 0 END
           + CASE WHEN p_size % 7 = 0 THEN 0 WHEN p_size % 3 = 0 THEN -0.1 ELSE 0.2 END + least(p_partkey % 9 * 0.1, 0.5)
           + CASE WHEN p_size % 5 = 0 THEN 0 ELSE 0.2 END"""


@query("importance_scores", f"SELECT p_partkey, round({IMPORTANCE}, 6) AS importance FROM part")
def _(t):
    p = t.part.selectExpr(
        "p_partkey", "p_size / 10 AS score", "p_size % 2 = 0 AS doc", "p_partkey % 9 AS related",
        "CASE p_type WHEN 'ECONOMY' THEN 'class_definition' WHEN 'LARGE' THEN 'function_definition' WHEN 'MEDIUM' THEN 'method_definition'"
        " WHEN 'PROMO' THEN 'variable' WHEN 'SMALL' THEN 'import' ELSE 'file' END AS kind",
        "CASE WHEN p_size % 7 = 0 THEN '' WHEN p_size % 3 = 0 THEN concat('_', p_name) ELSE p_name END AS name",
        "CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS domain",
    )
    c = F.col
    return p.select("p_partkey", F.round(text.importance_score(c("kind"), c("score"), c("doc"), c("name"), c("related"), c("domain")), 6).alias("importance"))


@query("embedding_texts", """
    SELECT doc_id, concat_ws(chr(10), CASE WHEN doc_id % 3 = 0 THEN 'file' ELSE concat('file: ', source) END,
           CASE WHEN doc_id % 4 = 0 THEN concat('Documentation: ', lang) END, CASE WHEN doc_id % 5 = 0 THEN concat('Domain: ', source) END,
           'Context: b c', concat('Code: ', text), CASE WHEN doc_id % 2 = 0 THEN 'Imports: x, y' END) AS embedding_text,
           concat_ws(' | ', CASE WHEN doc_id % 3 = 0 THEN 'File Part' ELSE concat('File Part: ', source) END, concat('Lines ', doc_id + 1, '-', doc_id + 10),
           concat('Language: ', lang), CASE WHEN n_chars % 40 > 3 THEN concat('Complexity: ', printf('%.1f', (n_chars % 40) / 3)) END,
           CASE WHEN doc_id % 5 = 0 THEN concat('Domain: ', source) END, CASE WHEN doc_id % 4 = 0 THEN 'Documented' END,
           CASE WHEN doc_id % 6 > 0 THEN concat('Related to ', doc_id % 6, ' other chunks') END) AS summary
    FROM documents""")
def _(t):
    some = lambda n, c: F.when(F.col("doc_id") % n == 0, F.col(c))
    name = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source"))
    none = F.array().cast("array<string>")
    return t.documents.select(
        "doc_id",
        text.embedding_text(
            F.lit("file"), name, some(4, "lang"), some(5, "source"), F.lit("a\nb\nc"), F.col("text"),
            F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(none),
        ).alias("embedding_text"),
        text.chunk_summary(
            F.lit("file_part"), name, F.col("doc_id"), F.col("doc_id") + 9, F.col("lang"), (F.col("n_chars") % 40) / 3, some(5, "source"),
            F.col("doc_id") % 4 == 0, F.col("doc_id") % 6,
        ).alias("summary"),
    )


@query("preprocessed_code", """
    SELECT id, array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
           lambda x: x <> '' AND NOT starts_with(x, '//') AND NOT starts_with(x, '#')), chr(10)) AS code FROM source_files""")
def _(t):
    return t.source_files.select("id", text.preprocess_code(F.col("content"), keep_comments=False).alias("code"))


@query("coordinates", """
    SELECT ord, repo, artifact, version, concat(group_id, ':', artifact_id, ':', version, CASE WHEN scope = 'test' THEN ':test-jar' ELSE '' END,
           CASE WHEN optional THEN ':sources' ELSE '' END) AS coordinates, concat(group_id, ':', artifact_id) AS ga FROM repo_artifacts""")
def _(t):
    c = F.col
    kind = F.when(c("scope") == "test", "test-jar").otherwise("jar")
    classifier = F.when(c("optional"), "sources").otherwise("")
    return t.repo_artifacts.select(
        "ord", "repo", "artifact", "version",
        text.coordinates(c("group_id"), c("artifact_id"), c("version"), kind, classifier).alias("coordinates"),
        text.ga(c("group_id"), c("artifact_id")).alias("ga"),
    )


@query("major_version_differs", """
    SELECT artifact_id, count(DISTINCT split_part(version, '.', 1)) > 1 AS differs FROM repo_artifacts GROUP BY artifact_id""")
def _(t):
    seen = t.repo_artifacts.groupBy("artifact_id").agg(F.collect_set("version").alias("v"))
    return seen.select("artifact_id", versions.major_version_differs(F.col("v")).alias("differs"))


@query("conflict_severity", """
    SELECT artifact_id, CASE WHEN count(DISTINCT split_part(version, '.', 1)) > 1 THEN 'critical'
           WHEN count(DISTINCT split_part(version, '.', 2)) > 2 THEN 'high' ELSE 'medium' END AS severity
    FROM repo_artifacts GROUP BY artifact_id""")
def _(t):
    seen = t.repo_artifacts.groupBy("artifact_id").agg(F.collect_set("version").alias("v"))
    return seen.select("artifact_id", versions.conflict_severity(F.col("v")).alias("severity"))


@query("versions_in_range", """
    SELECT ord, artifact, repo, version, (CAST(split_part(version, '.', 1) AS INT), CAST(split_part(version, '.', 2) AS INT)) >= (2, 1)
           AND CAST(split_part(version, '.', 1) AS INT) < 5 AS inside,
           CAST(split_part(version, '.', 1) AS INT) * 100 + CAST(split_part(version, '.', 2) AS INT) AS key
    FROM repo_artifacts""")
def _(t):
    k = versions.version_key(F.col("version"))["release"]
    return t.repo_artifacts.select(
        "ord", "artifact", "repo", "version", versions.version_in_range(F.col("version"), F.lit("[2.1,5.0)")).alias("inside"),
        (k[0] * 100 + F.coalesce(F.get(k, 1), F.lit(0))).alias("key"),
    )


@query("jsp_notes", """
    SELECT id, concat_ws('; ', CASE WHEN contains(content, 'session.getAttribute') THEN 'Session usage -> Angular state management (NgRx/services)' END,
        CASE WHEN contains(content, 'request.getParameter') THEN 'Request parameters -> Angular reactive forms' END,
        CASE WHEN contains(content, 'Connection') OR contains(content, 'PreparedStatement') OR contains(content, 'ResultSet')
             THEN 'Direct DB access -> GraphQL resolver with proper data layer' END,
        CASE WHEN contains(content, 'out.println') THEN 'Dynamic content generation -> Angular templating' END) AS notes FROM source_files""")
def _(t):
    return t.source_files.select("id", F.array_join(extract.jsp_migration_notes(F.col("content")), "; ").alias("notes"))


@query("jsp_complexity", """
    SELECT id, concat_ws(',', CASE WHEN s > 0 THEN concat('scriptlets:', CASE WHEN s > 5 THEN 'high' ELSE 'medium' END, ':', s) END,
           CASE WHEN db THEN 'direct_db_access:high' END, CASE WHEN ss THEN 'session_management:medium' END,
           CASE WHEN g > 0 THEN concat('struts_tags:medium:', g) END) AS patterns
    FROM (SELECT id, length(regexp_extract_all(content, '(?s)<%[^@](.*?)%>')) AS s,
                 length(regexp_extract_all(content, '<(html|bean|logic|nested):(\\w+)')) AS g,
                 contains(content, 'Connection') OR contains(content, 'PreparedStatement') OR contains(content, 'ResultSet') AS db,
                 contains(content, 'session.') AS ss FROM source_files)""")
def _(t):
    shown = F.transform(
        extract.jsp_complexity_patterns(F.col("content")), lambda p: F.concat_ws(":", p["type"], p["complexity"], p["count"].cast("string"))
    )
    return t.source_files.select("id", F.array_join(shown, ",").alias("patterns"))


@query("file_migration_complexity", """
    SELECT id, CASE WHEN x <= 3 THEN 'low' WHEN x <= 10 THEN 'medium' ELSE 'high' END AS level
    FROM (SELECT id, 2 * (length(content) % 4) + CASE WHEN contains(lower(content), 'html:') THEN 5 ELSE 0 END + 3 * (id % 2) + id % 3 AS x FROM source_files)""")
def _(t):
    c = F.col("content")
    return t.source_files.select(
        "id", extract.file_migration_complexity(F.length(c) % 4, F.lower(c).contains("html:"), F.col("id") % 2, F.col("id") % 3).alias("level")
    )


@query("sql_statements", """
    WITH s AS (SELECT id, length(regexp_extract_all(split_part(content, 'String sql', 1), chr(10))) AS line, regexp_extract(content, 'String\\s+\\w+\\s*=\\s*"([^"]*SELECT[^"]+)"', 1) AS q FROM source_files)
    SELECT id, q AS query_text, line AS line_number, 'SELECT' AS query_type,
           upper(regexp_extract(q, 'FROM\\s+(\\w+)', 1)) AS tables, 'PRICE,SIZE' AS columns FROM s WHERE q <> ''""")
def _(t):
    out = extract.extract_sql(t.source_files)
    return out.select("id", "query_text", F.col("line_number").cast("long").alias("line_number"), "query_type", joined(F.col("tables")).alias("tables"), joined(F.col("columns")).alias("columns"))


SQL_TEXTS = """concat(CASE p_size % 4 WHEN 0 THEN 'select distinct a, b from ' WHEN 1 THEN 'UPDATE ' WHEN 2 THEN ' insert into ' ELSE 'MERGE ' END,
    replace(p_name, ' ', '_'), CASE p_size % 3 WHEN 0 THEN ' join t2 on x = y where c1 > 5' WHEN 1 THEN ' set k = 1' ELSE '' END)"""


@query("sql_parts", f"""
    WITH s AS (SELECT p_partkey, {SQL_TEXTS} AS q FROM part)
    SELECT p_partkey, CASE WHEN regexp_matches(q, '(?i)^\\s*select') THEN 'SELECT' WHEN regexp_matches(q, '(?i)^\\s*insert') THEN 'INSERT'
           WHEN regexp_matches(q, '(?i)^\\s*update') THEN 'UPDATE' WHEN regexp_matches(q, '(?i)^\\s*delete') THEN 'DELETE' ELSE 'OTHER' END AS query_type,
           {sorted_list("list_distinct(list_transform(regexp_extract_all(q, '(?i)(FROM|JOIN|UPDATE|INTO)\\s+([A-Za-z_][A-Za-z0-9_]*)', 2), lambda x: upper(x)))")} AS tables
    FROM s""")
def _(t):
    s = t.part.selectExpr("p_partkey", f"{SQL_TEXTS} AS q")
    return s.select("p_partkey", extract.sql_type(F.col("q")).alias("query_type"), joined(extract.sql_tables(F.col("q"))).alias("tables"))


@query("endpoints", """
    WITH u AS (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '["'']([/\\w\\-\\.]+)["'']', 1))) AS url FROM pages)
    SELECT page_id, url, CASE WHEN contains(url, '/api/') THEN 'API Endpoint' WHEN contains(lower(url), 'admin') OR contains(lower(url), 'manage') THEN 'Admin Interface'
           WHEN contains(lower(url), 'user') OR contains(lower(url), 'profile') OR contains(lower(url), 'account') THEN 'User Interface' ELSE 'Web Page' END AS endpoint_type
    FROM u WHERE starts_with(url, '/') AND length(url) > 1""")
def _(t):
    u = t.pages.select("page_id", F.explode(extract.endpoints(F.col("html"))).alias("url"))
    return u.withColumn("endpoint_type", text.endpoint_type(F.col("url")))


QUESTION = """concat(CASE p_size % 5 WHEN 0 THEN 'Where does "' WHEN 1 THEN 'Where does ' WHEN 2 THEN 'Show the ' ELSE 'Which policy uses ' END, p_name,
    CASE p_size % 5 WHEN 0 THEN '" come from?' WHEN 1 THEN ' go' WHEN 2 THEN ' amount and contract type' ELSE '' END)"""


@query("question_fields", f"""
    WITH q AS (SELECT p_partkey, p_size % 5 AS k, p_name, {QUESTION} AS q FROM part)
    SELECT p_partkey, CASE k WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN concat(split_part(p_name, ' ', 2), ' amount') ELSE 'field' END AS field,
           {first_match('lower(q)', rules.QUESTION_CONTEXT, "''")} AS context FROM q""")
def _(t):
    q = t.part.selectExpr("p_partkey", f"{QUESTION} AS q")
    return q.select("p_partkey", extract.extract_field_name(F.col("q")).alias("field"), extract.extract_context(F.col("q")).alias("context"))


PHRASES = ", ".join(f"nullif(trim(regexp_extract(low, '(\\w+\\s+{w})', 1)), '')" for w in "amount field info type status date name number".split())


@query("user_question_fields", f"""
    WITH q AS (SELECT query_id, text, lower(text) AS low FROM questions)
    SELECT query_id, coalesce(nullif(regexp_extract(text, '[''"]([^''"]+)[''"]', 1), ''), {PHRASES},
           CASE WHEN contains(low, 'where does') THEN nullif(split_part(trim(regexp_replace(split_part(low, 'where does', 2), '\\s+', ' ', 'g')), ' ', 1), '') END, 'field') AS field,
           {first_match('low', rules.QUESTION_CONTEXT, "''")} AS context FROM q""")
def _(t):
    return t.questions.select("query_id", extract.extract_field_name(F.col("text")).alias("field"), extract.extract_context(F.col("text")).alias("context"))


@query("column_patterns", """
    SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '%STATUS%|%STATUS_CODE%|%STAT_CD%' ELSE concat('%', upper(replace(p_name, ' ', '_')), '%|%', replace(p_name, ' ', ''), '%|%',
           replace(p_name, ' ', '_'), '%|%', upper(concat(substr(split_part(p_name, ' ', 1), 1, 3), substr(split_part(p_name, ' ', 2), 1, 3))), '%') END AS patterns FROM part""")
def _(t):
    f = F.when(F.col("p_size") % 4 == 0, "Status").otherwise(F.col("p_name"))
    return t.part.select("p_partkey", F.array_join(extract.column_patterns(f), "|").alias("patterns"))


@query("json_properties", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, concat('{"k":"', json_extract_string(props, '$.k'), '"}') AS cleaned FROM events""")
def _(t):
    m = F.from_json("props", "map<string,string>")
    cleaned = F.to_json(text.clean_map(F.map_concat(m, F.create_map(F.lit("gone"), F.lit(None).cast("string")))))
    return t.events.select("event_id", m["k"].cast("long").alias("k"), cleaned.alias("cleaned"))


@query("previews", "SELECT doc_id, concat(substr(text, 1, 300), '...') AS preview FROM documents")
def _(t):
    return t.documents.select("doc_id", text.preview(F.col("text")).alias("preview"))


@query("effort_weeks", """
    SELECT o_orderkey, greatest(1, CAST(floor(trunc(o_totalprice / 1000) / 5) AS INT)) AS weeks,
           CAST(least(5, greatest(1, round_even(o_custkey / 2.0 / 100, 0))) AS INT) AS risk FROM orders""")
def _(t):
    days = (F.col("o_totalprice") / 1000).cast("int")
    return t.orders.select("o_orderkey", text.weeks(days).alias("weeks"), text.bucket_1_to_5(F.col("o_custkey") / 2.0 / 100).alias("risk"))


# pieces of whole texts; the SQL walks from cut to cut over running lengths -----


def line_cut_sql(source, size=1000, overlap=4):
    """DuckDB: ``pieces(id, start, stop, chunk, chunk_index)`` of ``source`` (``id, content``), lines cut greedily."""
    return f"""
    base AS (SELECT id, any_value(ls) AS ls, len(any_value(ls)) AS n, list(cum ORDER BY no) AS cum FROM (
             SELECT id, ls, no, sum(length(line)) OVER (PARTITION BY id ORDER BY no) AS cum FROM (
             SELECT id, ls, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM (SELECT id, string_split(content, chr(10)) AS ls FROM {source}))) GROUP BY id),
    walk(id, start, stop) AS (
        SELECT id, 0::BIGINT, list_filter(range(1, n), lambda x: cum[x + 1] > {size})[1] FROM base
        UNION ALL
        SELECT id, pos, list_filter(range(stop + 1, n), lambda x: cum[x + 1] - coalesce(cum[pos], 0) > {size})[1]
        FROM (SELECT w.id, w.stop, b.n, b.cum, CASE WHEN w.stop - w.start > {overlap} THEN w.stop - {overlap} ELSE w.stop END AS pos
              FROM walk w JOIN base b USING (id) WHERE w.stop IS NOT NULL)),
    cut AS (SELECT id, start, coalesce(stop, n) - 1 AS stop, array_to_string(ls[start + 1 : coalesce(stop, n)], chr(10)) AS chunk FROM walk JOIN base USING (id)),
    pieces AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start) - 1 AS chunk_index FROM cut WHERE regexp_matches(chunk, '\\S'))"""


@query("line_chunks", f"""
    WITH RECURSIVE {line_cut_sql("chunks")}
    SELECT concat(repository, ':', p.chunk_index) AS place, p.chunk_index::INT AS chunk_index, start::INT AS start_line, stop::INT AS end_line, md5(chunk) AS digest, repository
    FROM pieces p JOIN chunks USING (id)""")
def _(t):
    return chunking.line_chunks(widen(t.chunks), keep=["repository", "id"]).select(
        F.concat_ws(":", "repository", F.col("chunk_index").cast("string")).alias("place"), "chunk_index", "start_line", "end_line", F.md5("chunk").alias("digest"), "repository"
    )


@query("semantic_chunks", """
    WITH RECURSIVE base AS (
        SELECT id, any_value(ls) AS ls, len(any_value(ls)) AS n, list(cum ORDER BY no) AS cum, list(blank ORDER BY no) AS blank FROM (
        SELECT id, ls, no, sum(length(line) + 1) OVER (PARTITION BY id ORDER BY no) AS cum, NOT regexp_matches(line, '\\S') AS blank FROM (
        SELECT id, ls, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM (SELECT id, string_split(content, chr(10)) AS ls FROM chunks))) GROUP BY id),
    walk(id, start, stop) AS (
        SELECT id, 0::BIGINT, list_filter(range(0, n), lambda x: (blank[x + 1] OR coalesce(blank[x + 2], false) OR cum[x + 1] - 1 >= 1000 OR x = n - 1) AND cum[x + 1] - 1 >= 100)[1] FROM base
        UNION ALL
        SELECT id, pos, list_filter(range(pos, n), lambda x: (blank[x + 1] OR coalesce(blank[x + 2], false) OR cum[x + 1] - cum[pos] - 1 >= 1000 OR x = n - 1) AND cum[x + 1] - cum[pos] - 1 >= 100)[1]
        FROM (SELECT w.id, b.n, b.cum, b.blank, w.stop + 1 AS pos FROM walk w JOIN base b USING (id) WHERE w.stop IS NOT NULL AND w.stop + 1 < b.n)),
    cut AS (SELECT id, start, stop, array_to_string(ls[start + 1 : stop + 1], chr(10)) AS chunk FROM walk JOIN base USING (id) WHERE stop IS NOT NULL)
    SELECT id, (row_number() OVER (PARTITION BY id ORDER BY start) - 1)::INT AS chunk_index, start::INT AS start_line, stop::INT AS end_line, md5(chunk) AS digest
    FROM cut WHERE regexp_matches(chunk, '\\S')""")
def _(t):
    return chunking.semantic_chunks(widen(t.chunks), keep=["id"]).select("id", "chunk_index", "start_line", "end_line", F.md5("chunk").alias("digest"))


@query("logical_blocks", f"""
    WITH l AS (SELECT id, path, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS no FROM (SELECT id, path, string_split(content, chr(10)) AS ls FROM source_files)),
    b AS (SELECT *, sum(CASE WHEN no > 0 AND regexp_matches(line, CASE WHEN suffix(path, '.java') THEN '{block_start("java")}' WHEN suffix(path, '.js') THEN '{block_start("javascript")}'
                 ELSE '{block_start("python")}' END) THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY no) AS part,
                 sum(length(line) + 1) OVER (PARTITION BY id ORDER BY no) AS upto FROM l),
    p AS (SELECT id, min(no) AS start, max(no) AS stop, min(upto - length(line) - 1) AS a, max(upto) AS z, string_agg(line, chr(10) ORDER BY no) AS chunk FROM b GROUP BY id, part)
    SELECT id, (row_number() OVER (PARTITION BY id ORDER BY start) - 1)::INT AS chunk_index, start::INT AS start_line, stop::INT AS end_line,
           a::BIGINT AS start_byte, z::BIGINT AS end_byte, md5(chunk) AS digest FROM p WHERE regexp_matches(chunk, '\\S')""")
def _(t):
    f = t.source_files.select("id", "content", text.detect_language(F.col("path"), F.col("content")).alias("language"))
    return chunking.logical_blocks(f, keep=["id", "language"]).select("id", "chunk_index", "start_line", "end_line", "start_byte", "end_byte", F.md5("chunk").alias("digest"))


# the templates of source_files, a row per definition
DEFINED = """
    d AS (SELECT repository, path, content, 'import' AS chunk_type, 'java.sql.Connection' AS name, 1 AS a, 1 AS z, NULL AS scope FROM source_files WHERE suffix(path, '.java')
          UNION ALL SELECT repository, path, content, 'class_definition', regexp_extract(content, 'class (\\w+)', 1), 2, 8, NULL FROM source_files WHERE suffix(path, '.java')
          UNION ALL SELECT repository, path, content, 'function_definition', 'execute', 3, 7, regexp_extract(content, 'class (\\w+)', 1) FROM source_files WHERE suffix(path, '.java')
          UNION ALL SELECT repository, path, content, 'import', 'os', 0, 0, NULL FROM source_files WHERE suffix(path, '.py')
          UNION ALL SELECT repository, path, content, 'class_definition', regexp_extract(content, 'class (\\w+)', 1), 1, 5, NULL FROM source_files WHERE suffix(path, '.py')
          UNION ALL SELECT repository, path, content, 'function_definition', regexp_extract(content, 'def (\\w+)', 1), 2, 5, regexp_extract(content, 'class (\\w+)', 1)
                    FROM source_files WHERE suffix(path, '.py')
          UNION ALL SELECT repository, path, content, 'function_definition', regexp_extract(content, 'function (\\w+)', 1), 0, 0, NULL FROM source_files WHERE suffix(path, '.js')
          UNION ALL SELECT repository, path, content, 'function_definition', regexp_extract(content, '^def (\\w+)', 1), 0, 0, NULL FROM source_files WHERE starts_with(content, 'def ')
          UNION ALL SELECT repository, path, content, 'import', regexp_extract(content, '\nimport (\\w+)', 1), 1, 1, NULL FROM source_files WHERE starts_with(content, 'def '))"""


@query("definitions", f"""
    WITH {DEFINED} SELECT path, chunk_type, name, a::INT AS start_line, z::INT AS end_line, scope FROM d""")
def _(t):
    return extract.definitions(t.source_files.select("path", "content"))


@query("code_edges", f"""
    WITH {DEFINED},
    j AS (SELECT repository, path, regexp_extract(content, 'class (\\w+)', 1) AS c, regexp_extract(content, 'def (\\w+)', 1) AS f, content FROM source_files)
    SELECT repository, path, concat('file:', path) AS src, concat('module:', name) AS dst, 'imports' AS rel_type, a::INT AS line FROM d WHERE chunk_type = 'import'
    UNION ALL SELECT repository, path, concat('class:', c), 'class:Action', 'inherits', 2 FROM j WHERE suffix(path, '.java')
    UNION ALL SELECT repository, path, concat('class:', c), 'class:Base', 'inherits', 1 FROM j WHERE suffix(path, '.py')
    UNION ALL SELECT repository, path, 'function:execute', concat('function:', unnest(['isEmpty', 'findForward', 'load'])), 'calls', unnest([4, 4, 6]) FROM j WHERE suffix(path, '.java')
    UNION ALL SELECT repository, path, concat('function:', f), 'function:load', 'calls', 4 FROM j WHERE suffix(path, '.py')
    UNION ALL SELECT repository, path, concat('file:', path), concat('function:', unnest(['getAttribute', 'println'])), 'calls', 3 FROM j WHERE contains(content, 'session.')
    UNION ALL SELECT repository, path, concat('file:', path), 'function:load', 'calls', 3 FROM j WHERE contains(content, 'ResultSet')""")
def _(t):
    f = t.source_files.select("repository", "path", "content")
    return extract.code_edges(extract.definitions(f), f)


@query("jsp_parts")
def _(t):
    rows = extract.jsp_parts(t.source_files.select("id", "path", "content"))
    return rows.select("id", "part", "chunk_type", "name", "text", "line", "business_purpose", F.array_join("migration_notes", "; ").alias("notes"))


@query("jsp_part_lines", """
    WITH f AS (SELECT * FROM source_files),
    found AS (SELECT id, content, 0 AS kind, 'scriptlet' AS chunk_type, unnest(regexp_extract_all(content, '(?s)<%[^@].*?%>')) AS m FROM f
              UNION ALL SELECT id, content, 1, 'directive', unnest(regexp_extract_all(content, '(?s)<%@.*?%>')) FROM f
              UNION ALL SELECT id, content, 2, 'struts_tag', unnest(regexp_extract_all(content, '(?i)<(?:html|bean|logic|nested):\\w+[^>]*>')) FROM f),
    placed AS (SELECT *, strpos(content, m) AS pos FROM found),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY kind, pos) - 1 AS part, row_number() OVER (PARTITION BY id, kind ORDER BY pos) - 1 AS no FROM placed)
    SELECT id, part::INT AS part, chunk_type, CASE kind WHEN 2 THEN regexp_replace(regexp_extract(m, '^<(\\w+:\\w+)', 1), ':', '_') ELSE concat(chunk_type, '_', no) END AS name,
           (length(left(content, pos - 1)) - length(replace(left(content, pos - 1), chr(10), '')) )::BIGINT AS line FROM numbered""")
def _(t):
    rows = extract.jsp_parts(t.source_files.select("id", "path", "content"))
    return rows.select("id", "part", "chunk_type", "name", F.col("line").cast("long").alias("line"))


@query("jsp_references", """
    SELECT id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(content, '<((html|bean|logic|nested):\\w+)', 1), lambda x: x))), ',') AS tags,
           array_to_string(regexp_extract_all(content, '<html:form[^>]*action\\s*=\\s*"([^"]+)"', 1), ',') AS actions,
           array_to_string(regexp_extract_all(content, '<bean:write[^>]*property\\s*=\\s*"([^"]+)"', 1), ',') AS data
    FROM source_files""")
def _(t):
    r = extract.jsp_refs(F.col("content"))
    return t.source_files.select("id", joined(r["struts_tags"]).alias("tags"), joined(r["actions_referenced"]).alias("actions"), joined(r["data_accessed"]).alias("data"))


@query("action_classes", """
    SELECT id, regexp_extract(content, 'package\\s+([\\w.]+)', 1) AS package, regexp_extract(content, 'class\\s+(\\w+)\\s+extends', 1) AS class_name,
           'Action' AS extends, 'execute' AS methods, regexp_extract(content, 'findForward\\("([^"]+)"', 1) AS forwards,
           concat('Part', 'Service.load') AS calls, 'Validation: form.isEmpty' AS rules
    FROM source_files WHERE contains(content, 'extends Action')""")
def _(t):
    a = extract.action_class(F.col("content"))
    s = extract.struts_patterns(F.col("content"))
    return t.source_files.where(F.col("content").contains("extends Action")).select(
        "id", a["package"].alias("package"), a["class_name"].alias("class_name"), a["extends"].alias("extends"), F.array_join(a["methods"], ",").alias("methods"),
        joined(a["forwards_used"]).alias("forwards"), F.array_join(s["business_service_calls"], ",").alias("calls"),
        F.get(extract.validation_rules(F.col("content")), 0).alias("rules"),
    )


@query("struts_summary", """
    WITH k AS (SELECT repository, path, content, NOT regexp_matches(path, '(^|/)(target|build|\\.git|node_modules)/') AS ok FROM source_files)
    SELECT repository, count(*) FILTER (WHERE ok AND suffix(path, '.java')) AS total_actions, count(*) FILTER (WHERE ok AND suffix(path, '.jsp')) AS total_jsps,
           0 AS total_configs, 0 AS total_forms FROM k GROUP BY repository""")
def _(t):
    return extract.struts_summary(t.source_files)


@query("xml_config_elements", """
    SELECT p_partkey AS id, 0 AS element, 'name' AS tag, p_name AS text FROM part WHERE p_type = 'PROMO'
    UNION ALL SELECT p_partkey, 1, 'size', CAST(p_size AS VARCHAR) FROM part WHERE p_type = 'PROMO'""")
def _(t):
    files = t.source_files.select("id", "path", "content").where(F.col("path").endswith(".xml"))
    return extract.xml_config_elements(files).select("id", "element", "tag", "text")


@query("idl_interfaces", """
    SELECT p_partkey AS id, concat('I', p_partkey) AS interface, concat('Base', p_size, ',Other') AS parents, 'long size,string name' AS operations FROM part""")
def _(t):
    idl = t.part.selectExpr(
        "p_partkey AS id", "concat('interface I', p_partkey, ' : Base', p_size, ', Other {\\n  string name(in long x);\\n  long size();\\n};') AS content"
    )
    out = extract.idl_interfaces(idl)
    return out.select("id", "interface", joined(F.col("parents")).alias("parents"), joined(F.col("operations")).alias("operations"))


@query("idl_extends", """
    SELECT concat('f', p_partkey, ':interface:I', p_partkey) AS src, concat('f', p_partkey, ':interface:Base', p_size) AS dst, 'extends' AS rel_type FROM part""")
def _(t):
    idl = t.part.selectExpr("concat('f', p_partkey) AS path", "concat('interface I', p_partkey, ' : Base', p_size, ' { long size(); };') AS content")
    return extract.idl_extends(extract.idl_interfaces(idl))


@query("plsql_rules", """
    SELECT p_partkey, concat('the_amount > ', p_size, '|', lower(p_type), ' <> other|total_net >= ', p_size, '|', upper(p_name), ' is missing') AS rules FROM part""")
def _(t):
    src = t.part.selectExpr(
        "p_partkey", "concat('BEGIN IF the_amount > ', p_size, ' THEN x; ELSIF ', lower(p_type), ' <> other', chr(10), ' THEN z; IF a THEN y; END IF; CASE WHEN total_net >= ', p_size, ' THEN 1 END; raise_application_error(-20001, \"', upper(p_name), ' is missing\")') AS s"
    )
    return src.select("p_partkey", F.array_join(extract.plsql_rules(F.col("s")), "|").alias("rules"))


@query("gradle_dependencies", """
    SELECT p_partkey AS id, 0 AS position, p_brand AS group_id, concat('a', p_partkey) AS artifact_id, '1.0' AS version, 'compile' AS scope FROM part
    UNION ALL SELECT p_partkey, 1, 'junit', 'junit', '4.1', 'test' FROM part""")
def _(t):
    g = t.part.selectExpr("p_partkey AS id", "concat('dependencies { api \\'', p_brand, ':a', p_partkey, ':1.0\\'\\n testImplementation \"junit:junit:4.1\" }') AS content")
    return extract.gradle_dependencies(g).select("id", "position", "group_id", "artifact_id", "version", "scope")


@query("resolved_properties", """
    SELECT p_partkey, concat(p_brand, '-', p_partkey, '-', '${unknown}') AS value FROM part""")
def _(t):
    props = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("key"), F.col("p_partkey").cast("string"))
    return t.part.select("p_partkey", extract.resolve_properties(F.lit("${brand}-${key}-${unknown}"), props).alias("value"))
