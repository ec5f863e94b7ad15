"""E: questions that join chunks, components, repositories, flows and database objects.

Where the answer was once a list per row, each member is a row here, so no list grows
with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.functions import rules
from portolan.functions.extract import column_patterns
from portolan.functions.text import any_word, classify_first_match, column_purpose, prefix_similarity
from portolan.operators import graph
from portolan.operators.rank import first_n_per_group
from portolan.operators.textjoin import text_join
from portolan.session import written

# fixed values
REMOTE_CALLS = ["ServiceLocator.", "RemoteService.", ".lookup(", "JNDI."]
DOMAIN_TABLES = {
    "universal_life": ["%UNIVERSAL%", "%UL_%", "%LIFE%"], "account": ["%ACCOUNT%", "%ACCT%"], "contract": ["%CONTRACT%", "%CNTRCT%"],
    "customer": ["%CUSTOMER%", "%CUST%"], "policy": ["%POLICY%", "%PLCY%"],
}
NAME_RULES = [
    ("amount", ["Amount must be greater than 0", "Amount format must be valid currency"]),
    ("date", ["Date must be valid calendar date", "Date cannot be in the future (for some contexts)"]),
    ("status", ["Status must be valid code from lookup table", "Status transitions must follow business rules"]),
]


# code ------------------------------------------------------------------------------


def code_relationships(ids: DataFrame, edges: DataFrame, domains: DataFrame) -> DataFrame:
    """Neighbours of the given chunks, rows ``(id, relation, other)``."""
    wanted = ids.select("id").distinct()
    # fixed values: relation seen from the source and from the target
    forward = {"CALLS": "calls", "INHERITS": "inherits", "DEPENDS_ON": "depends_on"}
    backward = {"CALLS": "called_by", "INHERITS": "inherited_by"}
    name = lambda kinds: F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])[F.col("rel_type")]
    out = edges.select(F.col("src").alias("id"), name(forward).alias("relation"), F.col("dst").cast("string").alias("other"))
    into = edges.select(F.col("dst").alias("id"), name(backward).alias("relation"), F.col("src").cast("string").alias("other"))
    belongs = domains.select("id", F.lit("domain").alias("relation"), F.col("domain").cast("string").alias("other"))
    rows = out.unionByName(into).unionByName(belongs).where("relation is not null and other is not null")
    return rows.join(wanted, "id", "left_semi").distinct()


def domain_dependencies(chunks: DataFrame, edges: DataFrame, domain=None) -> DataFrame:
    """Edges between different domains with the distinct chunks at both ends."""
    d = chunks.select("id", "domain")
    source = d if domain is None else d.where(F.col("domain") == domain)
    e = edges.join(source.toDF("src", "source_domain"), "src").join(d.toDF("dst", "target_domain"), "dst")
    return (
        e.where("source_domain <> target_domain")
        .groupBy("source_domain", "target_domain")
        .agg(
            F.count("*").alias("dependency_count"),
            F.count_distinct("src").alias("source_chunks"),
            F.count_distinct("dst").alias("target_chunks"),
        )
    )


def related_chunks(chunks: DataFrame, edges: DataFrame, within: int = 10) -> DataFrame:
    """Rows ``(id, related, reason)`` by parent, edge, and a start near the end in one file.

    ``chunks`` has ``id, file_path, parent_id, start_line, end_line``. Near chunks meet by
    file and line bucket. Names alike come from ``similar_names``.
    """
    parents = chunks.where("parent_id is not null").select("id", F.col("parent_id").alias("related"), F.lit("parent").alias("reason"))
    children = parents.select(F.col("related").alias("id"), F.col("id").alias("related"), F.lit("child").alias("reason"))
    family = parents.unionByName(children).where("id <> related").distinct()
    # an edge counts from both ends, so its ends are made distinct in order and then told both ways
    ends = edges.where("src <> dst").select(F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b")).distinct()
    ways = F.explode(F.array(F.struct(F.col("_a").alias("id"), F.col("_b").alias("related")), F.struct(F.col("_b").alias("id"), F.col("_a").alias("related"))))
    linked = ends.select(ways.alias("_way")).select("_way.*", F.lit("edge").alias("reason"))
    return family.unionByName(linked).unionByName(_near_chunks(chunks, within))


def _near_chunks(chunks: DataFrame, within: int) -> DataFrame:
    """The distinct near pairs of `related_chunks`.

    A pair of ids that have one place each comes once, so only pairs with an id of several places are made distinct.
    """
    width = within + 1
    places = chunks.select("id", "file_path", "start_line", "end_line").where("id is not null and file_path is not null").distinct()
    several = places.groupBy("id").agg(F.count("*").alias("_n")).where("_n > 1").select("id", F.lit(True).alias("_several"))
    places = places.join(several, "id", "left").withColumn("_several", F.coalesce("_several", F.lit(False)))
    ends = places.select(
        "id", "_several", "file_path", "end_line", F.explode(F.sequence(F.floor((F.col("end_line") - within) / width), F.floor((F.col("end_line") + within) / width))).alias("_b")
    )
    starts = places.select(
        F.col("id").alias("related"), F.col("_several").alias("_others"), "file_path", F.col("start_line").alias("_s"), F.floor(F.col("start_line") / width).alias("_b")
    )

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        near = left.join(right, ["file_path", "_b"]).where((F.abs(F.col("_s") - F.col("end_line")) <= within) & (F.col("id") != F.col("related")))
        return near.select("id", "related", F.lit("near").alias("reason"))

    one = ends.where("not _several")
    again = pairs(ends.where("_several"), starts).unionByName(pairs(one, starts.where("_others")))
    return pairs(one, starts.where("not _others")).unionByName(again.distinct())


def similar_names(chunks: DataFrame, least: float = 0.5) -> DataFrame:
    """Distinct names of one file alike by prefix, with the chunks that carry them.

    Two names are alike when they share more than half of the longer one. The longer
    name is looked up by just over half of itself among the prefixes of the shorter, an
    equi-join that loses no pair.
    """
    names = chunks.where("name is not null and name <> ''").groupBy("file_path", "name").agg(F.count("*").alias("chunks"))
    half = F.floor(F.length("name") * least).cast("int") + 1
    longer = names.select("file_path", "name", "chunks", F.substr("name", F.lit(1), half).alias("_p"))
    shorter = names.select(
        "file_path", F.col("name").alias("similar_name"), F.col("chunks").alias("similar_chunks"),
        F.explode(F.transform(F.sequence(half, F.length("name")), lambda n: F.substr("name", F.lit(1), n))).alias("_p"),
    )
    pairs = longer.join(shorter, ["file_path", "_p"]).drop("_p")
    # the longer side stands left; equal lengths meet from both sides
    pairs = pairs.where(F.length("name") >= F.length("similar_name"))
    back = pairs.where(F.length("name") > F.length("similar_name")).select(
        "file_path", F.col("similar_name").alias("name"), F.col("similar_chunks").alias("chunks"), F.col("name").alias("similar_name"), F.col("chunks").alias("similar_chunks")
    )
    both = pairs.unionByName(back).withColumn("similarity", prefix_similarity(F.col("name"), F.col("similar_name")))
    return both.where((F.col("similarity") > least) & ((F.col("name") != F.col("similar_name")) | (F.col("chunks") > 1)))


def subgraph(nodes: DataFrame, edges: DataFrame, repo, depth: int = 2, max_nodes: int = 300) -> DataFrame:
    """Nodes to draw for a repository: its own, then what they lead to within ``depth``, the nearest first.

    ``nodes`` has ``id, repo, label``. Draw ``inner_edges`` of the result. The limit is the display's.
    """
    own = nodes.where(F.col("repo") == repo).select("id")
    reached = graph.reach(edges, own, depth).groupBy(F.col("node").alias("id")).agg(F.min("depth").alias("depth"))
    near = own.withColumn("depth", F.lit(0)).unionByName(reached).groupBy("id").agg(F.min("depth").alias("depth"))
    label = F.when(F.col("label").isin(rules.VISUAL_LABELS), F.col("label")).otherwise("Unknown")
    return near.join(nodes.select("id", label.alias("label")), "id").orderBy("depth", "id").limit(max_nodes)


def inner_edges(edges: DataFrame, drawn: DataFrame, max_edges: int = 800) -> DataFrame:
    """The distinct edges between drawn nodes, in order, up to the display's limit."""
    ids = drawn.select("id")
    inside = edges.select("src", "dst").distinct().join(ids.toDF("src"), "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")
    return inside.orderBy("src", "dst").limit(max_edges)


def incident_edges(nodes: DataFrame, edges: DataFrame, repo, max_edges: int = 200) -> DataFrame:
    """Edges with an end in the repository, each once, up to the display's limit."""
    own = nodes.where(F.col("repo") == repo).select("id")
    out = edges.join(own.toDF("src"), "src", "left_semi").select("src", "dst")
    into = edges.join(own.toDF("dst"), "dst", "left_semi").select("src", "dst")
    return out.unionByName(into).distinct().orderBy("src", "dst").limit(max_edges)


def member_nodes(nodes: DataFrame, repo, max_nodes: int = 100) -> DataFrame:
    """The repository's nodes, up to the display's limit."""
    return nodes.where(F.col("repo") == repo).orderBy("id").limit(max_nodes)


def rename_edges(edges: DataFrame, old: str, new: str) -> DataFrame:
    """One relationship type rewritten to another."""
    return edges.withColumn("rel_type", F.when(F.col("rel_type") == old, new).otherwise(F.col("rel_type")))


# across repositories ---------------------------------------------------------------


def cross_repo_references(components: DataFrame) -> DataFrame:
    """Repositories whose actions or CORBA operations name another repository's component.

    ``components`` has ``repo, kind, name, text``. An action counts when its text also
    holds a remote-call mark; a CORBA operation counts for interfaces only. Texts and mentions are
    counted per repository before they meet anything. The components are read once.
    """
    used = components.where(F.col("kind").isin("rule", "action", "corba", "jsp")).select("repo", "kind", "name", "text")
    used = written(used, "components")
    remote = (F.col("kind") == "action") & any_word(F.col("text"), REMOTE_CALLS)
    callers = used.where(remote | (F.col("kind") == "corba"))
    named = used.where(F.coalesce("name", F.lit("")) != "")
    hits = written(text_join(callers, named, "text", "name"), "hits")
    said = callers.groupBy(F.col("repo").alias("source_repo"), F.col("kind").alias("source_type"), "text").agg(F.count("*").alias("_n"))
    mentions = (
        said.join(hits.select("text", F.col("name").alias("target_component")), "text")
        .groupBy("source_repo", "source_type", "target_component")
        .agg(F.sum("_n").alias("references"))
    )
    targets = named.groupBy(F.col("repo").alias("target_repo"), F.col("kind").alias("target_type"), F.col("name").alias("target_component")).agg(
        F.count("*").alias("components")
    )
    met = mentions.join(targets, "target_component").where("source_repo <> target_repo")
    met = met.where((F.col("source_type") == "action") | (F.col("target_type") == "corba"))
    kind = F.when(F.col("source_type") == "action", "CALLS_SERVICE").otherwise("DEPENDS_ON_TYPE")
    return met.select(
        "source_repo", "source_type", "target_repo", "target_type", "target_component", kind.alias("relationship_type"),
        (F.col("references") * F.col("components")).alias("weight"),
    )


def cross_repo_rule_edges(components: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between business rules of different repositories."""
    rule = components.where("kind = 'rule'")
    s = rule.select(F.col("id").alias("src"), F.col("repo").alias("source_repo"), F.col("domain").alias("source_domain"))
    d = rule.select(F.col("id").alias("dst"), F.col("repo").alias("target_repo"), F.col("domain").alias("target_domain"))
    return (
        edges.select("src", "dst").join(s, "src").join(d, "dst").where("source_repo <> target_repo")
        .withColumn("business_context", F.concat(F.lit("Cross-domain: "), "source_domain", F.lit(" -> "), "target_domain"))
    )


def cross_repo_calls(components: DataFrame, edges: DataFrame, repos: DataFrame | None = None) -> DataFrame:
    """Actions that call a CORBA interface of another repository."""
    s = components.where("kind = 'action'").select(F.col("id").alias("src"), F.col("repo").alias("source_repo"), F.col("name").alias("action"))
    d = components.where("kind = 'corba'").select(F.col("id").alias("dst"), F.col("repo").alias("target_repo"), F.col("name").alias("interface"))
    if repos is not None:
        s = s.join(repos.toDF("source_repo"), "source_repo", "left_semi")
        d = d.join(repos.toDF("target_repo"), "target_repo", "left_semi")
    return edges.select("src", "dst").distinct().join(s, "src").join(d, "dst").where("source_repo <> target_repo")


def multi_domain_rules(rules_: DataFrame, applies: DataFrame, entities: DataFrame) -> DataFrame:
    """Rules that apply to entities of more than one domain."""
    e = applies.select("src", "dst").join(entities.select(F.col("id").alias("dst"), "domain"), "dst")
    counted = e.groupBy(F.col("src").alias("id")).agg(F.count_distinct("domain").alias("domain_count")).where("domain_count > 1")
    return rules_.join(counted, "id").select("id", "name", "domain_count")


def service_complexity(services: DataFrame, implements: DataFrame, functions: DataFrame) -> DataFrame:
    """Mean function complexity per service and domain. ``services(service, domain)``, ``implements(repo, service)``."""
    per_repo = functions.groupBy("repo").agg(F.sum("complexity").alias("_s"), F.count("complexity").alias("_n"))
    return (
        implements.join(services, "service").join(per_repo, "repo").groupBy("service", "domain")
        .agg((F.sum("_s") / F.sum("_n")).alias("avg_complexity")).orderBy(F.desc("avg_complexity"), "service")
    )


def domain_members(components: DataFrame, domain) -> DataFrame:
    """Components of one domain."""
    return components.where(F.col("domain") == domain).select("id", "name")


def repository_pairs(edges: DataFrame, repos: DataFrame) -> DataFrame:
    """Names at both ends of each repository dependency."""
    n = repos.select("repo", "name")
    return edges.select("src", "dst").distinct().join(n.toDF("src", "source"), "src").join(n.toDF("dst", "target"), "dst").select("source", "target")


# flows -----------------------------------------------------------------------------


def flows_for(flows: DataFrame, flow_repos: DataFrame, repos: DataFrame) -> DataFrame:
    """Flows of the selected repositories, one row per flow and selected repository."""
    picked = flow_repos.join(repos.toDF("repo"), "repo", "left_semi").distinct()
    count = picked.groupBy("flow").agg(F.count("*").alias("repository_count"))
    rows = flows.join(count, "flow").join(picked, "flow")
    return rows.orderBy(F.desc("business_value"), F.asc("migration_order"), "flow", "repo")


def repo_dependencies(edges: DataFrame, repos: DataFrame) -> DataFrame:
    """Dependencies with either end selected, weight 1 where none is given, no self loops; each once."""
    r = repos.toDF("_r").distinct()
    e = edges.where("src is not null and dst is not null and src <> dst").withColumn("weight", F.coalesce("weight", F.lit(1)).cast("double"))
    out = e.join(r.withColumnRenamed("_r", "src"), "src", "left_semi")
    into = e.join(r.withColumnRenamed("_r", "dst"), "dst", "left_semi").join(r.withColumnRenamed("_r", "src"), "src", "left_anti")
    return out.unionByName(into).orderBy(F.desc("criticality"), "src", "dst")


def shared_operations(operations: DataFrame, implements: DataFrame, repos: DataFrame) -> DataFrame:
    """Operations more than one selected repository implements."""
    counted = (
        implements.join(repos.toDF("repo"), "repo", "left_semi").groupBy("operation").agg(F.count_distinct("repo").alias("repository_count"))
    )
    return operations.join(counted.where("repository_count > 1"), "operation")


def migration_impact(flows: DataFrame, flow_repos: DataFrame, components: DataFrame, repos: DataFrame) -> DataFrame:
    """What a migration of the selected repositories touches, per flow.

    ``component_rows`` counts components once per affected repository.
    """
    picked = flow_repos.join(repos.toDF("repo"), "repo", "left_semi").distinct()
    per_repo = components.groupBy("repo").agg(F.count("*").alias("_c"))
    touched = picked.join(per_repo, "repo", "left").groupBy("flow").agg(
        F.count("*").alias("affected_repositories"), F.coalesce(F.sum("_c"), F.lit(0)).alias("component_rows")
    )
    return flows.join(touched, "flow").orderBy(F.asc("migration_order"), "flow")


def integration_points(points: DataFrame, repos: DataFrame) -> DataFrame:
    """Integration points of the selected repositories, by sensitivity as text, descending."""
    return points.join(repos.toDF("src"), "src", "left_semi").orderBy(F.desc("data_sensitivity"), "src", "dst")


# databases -------------------------------------------------------------------------


def code_table_edges(statements: DataFrame, tables: DataFrame) -> DataFrame:
    """Statements to the catalog tables they name, without regard to case."""
    used = statements.select("*", F.explode("tables").alias("_t")).drop("tables")
    known = tables.select("schema_name", "table_name", F.upper("table_name").alias("_t"))
    return used.join(known, "_t").drop("_t")


def fk_edges(constraints: DataFrame, tables: DataFrame) -> DataFrame:
    """References between known tables of one schema."""
    r = constraints.where("constraint_type = 'R' and referenced_table is not null")
    k = tables.select("schema_name", "table_name").distinct()
    return (
        r.join(k, ["schema_name", "table_name"], "left_semi")
        .join(k.withColumnRenamed("table_name", "referenced_table"), ["schema_name", "referenced_table"], "left_semi")
        .select("schema_name", F.col("table_name").alias("src"), F.col("referenced_table").alias("dst"), "constraint_name")
        .distinct()
    )


def view_lineage(views: DataFrame, tables: DataFrame) -> DataFrame:
    """Each view to the tables and views it derives from. ``views(view, derives_from[])``."""
    known = tables.select(F.col("table_name").alias("dst"), F.lit("table").alias("dst_type")).unionByName(
        views.select(F.col("view").alias("dst"), F.lit("view").alias("dst_type"))
    )
    return views.select(F.col("view").alias("src"), F.explode("derives_from").alias("dst")).distinct().join(known.distinct(), "dst")


def shared_db_artifacts(repo_db: DataFrame, repos: DataFrame) -> DataFrame:
    """Database objects more than one selected repository uses: tables read or written, views read.

    One row per object and repository, with the number of repositories.
    """
    used = (F.col("object_type") == "table") & F.col("rel_type").isin("READS_FROM", "WRITES_TO") | (
        (F.col("object_type") == "view") & (F.col("rel_type") == "READS_FROM")
    )
    members = repo_db.where(used).join(repos.toDF("repo"), "repo", "left_semi").select("object", "object_type", "repo").distinct()
    count = members.groupBy("object", "object_type").agg(F.count("*").alias("repository_count")).where("repository_count > 1")
    return members.join(count, ["object", "object_type"])


def matches_context(table: Column, context: Column) -> Column:
    """Table named by a word of the context, or by a pattern of a domain the context names."""
    t, c = F.lower(table), F.lower(context)
    out = F.exists(F.filter(F.split(c, r"\s+"), lambda w: w != ""), lambda w: t.contains(w))
    for domain, patterns in DOMAIN_TABLES.items():
        out = out | (c.contains(domain) & any_word(t, [p.replace("%", "").lower() for p in patterns]))
    return out


def find_data_sources(fields: DataFrame, columns: DataFrame) -> DataFrame:
    """Every column a field may come from. ``fields`` has ``field, context``.

    Columns come with purpose, table context and the number of the pattern that found them.
    """
    asked = fields.select("field", F.coalesce("context", F.lit("")).alias("context")).distinct()
    patterned = asked.select("field", "context", F.posexplode(column_patterns(F.col("field"))).alias("pattern_no", "pattern"))
    found = text_join(columns, patterned, "column_name", "pattern", like=True)
    rows = patterned.join(found, "pattern").join(columns, "column_name")
    rows = rows.where((F.col("context") == "") | matches_context(F.col("table_name"), F.col("context")))
    rows = rows.withColumns(
        {
            "business_purpose": F.coalesce("comments", column_purpose(F.col("column_name"))),
            "table_context": classify_first_match(F.col("table_name"), rules.TABLE_CONTEXT, "business_data", "upper"),
        }
    )
    # read by several of the operators below
    return written(rows, "sources")


def top_sources(sources: DataFrame, n: int = 5) -> DataFrame:
    """The first sources per field, by schema, pattern, table and column."""
    order = [F.col(c) for c in ("schema_name", "pattern_no", "table_name", "column_name", "column_id")]
    return first_n_per_group(sources, ["field", "context"], order, n, "rank")


def source_confidence(sources: DataFrame) -> DataFrame:
    """The best score among a field's sources, one at most."""
    col, field = F.lower("column_name"), F.lower("field")
    words = F.filter(F.split(field, r"\s+"), lambda w: w != "")
    name = (
        F.when(F.replace(field, F.lit(" "), F.lit("_")) == col, 0.4)
        .when(col.contains(F.replace(field, F.lit(" "), F.lit(""))), 0.3)
        .when(F.exists(words, lambda w: col.contains(w)), 0.2)
        .otherwise(0.0)
    )
    context = F.when((F.col("context") != "") & matches_context(F.col("table_name"), F.col("context")), 0.3).otherwise(0.0)
    purpose = F.when(F.lower("business_purpose").contains(field), 0.2).otherwise(0.0)
    area = F.when(field.contains("account") & (F.col("table_context") == "account_management"), 0.1).otherwise(0.0)
    return sources.groupBy("field", "context").agg(F.least(F.max(name + context + purpose + area), F.lit(1.0)).alias("confidence"))


def related_rules(sources: DataFrame, constraints: DataFrame, n: int = 5) -> DataFrame:
    """Check conditions that mention a source column, then rules by name, five per field.

    ``constraints`` has ``schema_name, table_name, constraint_type, condition``.
    """
    at = ["schema_name", "table_name"]
    checks = constraints.where("constraint_type = 'C' and condition is not null").select(*at, F.upper("condition").alias("_c"), "condition").distinct()
    hit = text_join(checks, sources, "_c", "column_name", on=at)
    found = (
        sources.select("field", *at, "column_name").distinct().join(hit, [*at, "column_name"]).join(checks, [*at, "_c"])
        .select("field", F.lit(0).alias("_o"), F.concat(F.lit("Database constraint: "), "condition").alias("rule"))
    )
    named = F.array().cast("array<string>")
    for word, texts in reversed(NAME_RULES):
        named = F.when(F.lower("field").contains(word), F.array(*[F.lit(x) for x in texts])).otherwise(named)
    common = sources.select("field").distinct().select("field", F.posexplode(named).alias("_p", "rule")).select("field", (F.col("_p") + 1).alias("_o"), "rule")
    return first_n_per_group(found.distinct().unionByName(common), ["field"], [F.col("_o"), F.col("rule")], n, "rank").drop("_o")


def related_procedures(sources: DataFrame, procedures: DataFrame, n: int = 5) -> DataFrame:
    """Procedures of a source's schema whose name holds the field or whose text mentions the source, five per field.

    ``procedures`` has ``schema_name, object_name, source_code``.
    """
    key = ["schema_name"]
    p = procedures.select("schema_name", "object_name", F.lower("object_name").alias("_name"), F.lower("source_code").alias("_code"))
    f = F.lower("field")
    spelled = F.array_distinct(F.array(f, F.replace(f, F.lit("_"), F.lit("")), F.replace(f, F.lit(" "), F.lit("_"))))
    by_name = sources.select("field", "schema_name", F.explode(spelled).alias("term")).distinct()
    by_text = sources.select("field", "schema_name", F.explode(F.array(F.lower("column_name"), F.lower("table_name"))).alias("term")).distinct()

    def hits(terms: DataFrame, col: str) -> DataFrame:
        pairs = text_join(p, terms, col, "term", on=key)
        return terms.join(pairs, [*key, "term"]).join(p, [*key, col]).select("field", F.concat_ws(".", "schema_name", "object_name").alias("procedure"))

    found = hits(by_name, "_name").unionByName(hits(by_text, "_code")).distinct()
    return first_n_per_group(found, ["field"], [F.col("procedure")], n, "rank")


def trace_data_flow(sources: DataFrame, n: int = 3) -> DataFrame:
    """The first sources of a field as flow steps with the field's confidence."""
    top = top_sources(sources, n).join(source_confidence(sources), ["field", "context"])
    return top.select(
        "field", "context", "rank", F.lit("database_source").alias("step"), F.lit("oracle_table").alias("type"),
        F.concat_ws(".", "schema_name", "table_name").alias("name"), F.col("column_name").alias("column"), "business_purpose", "confidence",
    )


def domain_tables(tables: DataFrame, domain: str) -> DataFrame:
    """Tables whose name fits a pattern of the domain, once per pattern."""
    patterns = DOMAIN_TABLES.get(domain.lower(), [f"%{domain.upper()}%"])
    fits = F.array_compact(F.array(*[F.when(F.col("table_name").ilike(p), F.lit(p)) for p in patterns]))
    return tables.select("*", F.explode(fits).alias("pattern"), F.lit(domain).alias("business_domain"))
