"""Secret scan with linking of credentials that come in parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import joined_spans, ranked, row_key, sha, span_list, whole
from portolan.session import written

#: Strong kinds; a match stands on its own.
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.=-]+"
#: What of an assignment precedes its value.
ASSIGN_HEAD = "^(?i:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}+"
#: Weak kinds; they count only near a part that completes them.
WEAK_ID = "(?i:user(?:name)?|login|account|client_?id|access_?key_?id)[\"']? *[:=] *[\"']?[A-Za-z0-9+/_.@-]{3,}"
WEAK_SECRET = "[A-Za-z0-9+/_-]{20,}+"
ENDPOINT = "(?i:https?|ftp|jdbc:[a-z]+|redis|mongodb|amqp)://[A-Za-z0-9.-]+(?::[0-9]+)?"
KINDS = ["assign", "access", "hex", "weak_id", "weak_secret", "endpoint"]
#: Which kinds complete a weak one.
COMPLETES = {"weak_id": ["assign", "hex", "weak_secret"], "weak_secret": ["access", "weak_id", "endpoint"], "endpoint": ["assign", "hex", "weak_secret"]}
#: Code points between the starts of two parts of one scope, at most.
SCOPE = 200


def _strong(t: Column) -> dict[str, Column]:
    return {
        # a failing match is consumed, not retried: the length is tested after matching
        "assign": F.filter(span_list(t, ASSIGN), lambda s: F.char_length(F.regexp_replace(s["part"], ASSIGN_HEAD, "")) >= 6),
        "access": span_list(t, ACCESS),
        "hex": span_list(t, HEX),
    }


def _weak(t: Column) -> dict[str, Column]:
    mixed = lambda s: s["part"].rlike("[0-9]") & s["part"].rlike("[A-Z]") & s["part"].rlike("[a-z]")
    return {"weak_id": span_list(t, WEAK_ID), "weak_secret": F.filter(span_list(t, WEAK_SECRET), mixed), "endpoint": span_list(t, ENDPOINT)}


def secret_spans(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``spans``, a sorted ``array<struct<start, rank, end>>``.

    ``rank`` is the place of the kind in `KINDS`. Strong spans (assignments, access identifiers, long
    hex runs) are always reported. Weak ones (user or client names, mixed runs of letters and digits,
    service addresses) only when a part that completes them starts within ``scope`` code points in
    the same text: an identifier or address for a secret, a secret for an identifier or address. A weak
    secret that overlaps a strong span is no candidate.

    Parts of a text meet by bins of ``scope`` code points. For the distance a bin is cut down to its
    first and last start per kind; for overlaps it holds few parts, as none is shorter than a few
    code points. So crowded texts make no pairs beyond their length.

    Null texts count as empty; empty texts, and rows with a null id, get a row too. Repeated rows stay
    repeated. Other columns are not looked at.
    """
    kind = "array<struct<start:int,rank:int,end:int>>"
    t = docs.select("doc_id", whole().alias("t"))
    strong, parts = _strong(F.col("t")), _strong(F.col("t")) | _weak(F.col("t"))
    flat = F.flatten(F.array(*[ranked(parts[k], i).cast(kind) for i, k in enumerate(KINDS)]))
    # texts go no further, and the patterns run once
    base = written(t.select("doc_id", row_key(F.col("doc_id"), F.col("t")).alias("row"), flat.alias("parts")), "secret_parts")
    first_weak = len(strong)
    mixed = base.where(F.exists("parts", lambda p: p["rank"] >= first_weak) & (F.size("parts") > 1))
    each = mixed.select("row", "parts").dropDuplicates(["row"]).select("row", F.inline("parts"))
    touched = lambda df: df.withColumn("bin", F.explode(F.expr(f"sequence(start div {scope}, (end - 1) div {scope})")))
    secret = KINDS.index("weak_secret")
    firm = touched(each.where(F.col("rank") < first_weak)).select("row", "bin", F.col("start").alias("s"), F.col("end").alias("e"))
    covered = touched(each.where(F.col("rank") == secret)).join(firm, ["row", "bin"]).where("s < end AND e > start")
    each = each.join(covered.select("row", "start", "rank", "end").distinct(), ["row", "start", "rank", "end"], "left_anti")
    each = each.withColumn("bin", F.expr(f"start div {scope}"))
    bins = each.groupBy("row", "bin", F.col("rank").alias("other")).agg(F.min("start").alias("low"), F.max("start").alias("high"))
    pairs = [(KINDS.index(w), KINDS.index(o)) for w, needs in COMPLETES.items() for o in needs]
    others = F.array(*[F.struct(F.lit(w).alias("weak"), F.lit(o).alias("other")) for w, o in pairs])
    asked = each.where(F.col("rank") >= first_weak).select(
        "row", "start", "rank", "end", "bin", F.explode(F.filter(others, lambda p: p["weak"] == F.col("rank"))["other"]).alias("other")
    )
    near = asked.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    linked = near.join(bins, ["row", "bin", "other"]).where(F.least(F.abs(F.col("low") - F.col("start")), F.abs(F.col("high") - F.col("start"))) <= scope)
    added = linked.select("row", "start", "rank", "end").distinct().groupBy("row").agg(F.collect_list(F.struct("start", "rank", "end")).cast(kind).alias("added"))
    kept = F.filter("parts", lambda p: p["rank"] < first_weak)
    return base.join(added, "row", "left").select("doc_id", F.array_sort(F.concat(kept, F.coalesce("added", F.array().cast(kind)))).alias("spans"))


def digest(docs: DataFrame) -> DataFrame:
    """Counts and span strings of `secret_spans`, one row per row of ``docs``."""
    own = lambda i: F.filter("spans", lambda s: s["rank"] == i)
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return secret_spans(docs).select(
        "doc_id",
        *[F.size(own(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        sha(joined_spans(base, KINDS)).alias("base_sha256"),
        joined_spans(F.col("spans"), KINDS).alias("spans"),
    )


def _sql_spans(name: str, pattern: str, rank: int, test: str = "true") -> str:
    """DuckDB: a list of ``{start, rank, end, part}``; offsets from the lengths of gaps and matches."""
    p = pattern.replace("'", "''").replace("}+", "}")
    gaps, parts = f"list_transform(regexp_split_to_array(t, '{p}'), lambda x: length(x))", f"regexp_extract_all(t, '{p}')"
    return f"""{name}_all AS (
    SELECT doc_id, g, m, list_transform(m, lambda x: length(x)) AS n FROM (SELECT doc_id, {gaps} AS g, {parts} AS m FROM d)),
{name} AS (
    SELECT doc_id, s.start AS start, {rank} AS rank, s.start + length(s.part) AS "end", s.part AS part FROM (
        SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {{start: CAST(list_sum(g[1:i]) + coalesce(list_sum(n[1:i - 1]), 0) AS BIGINT), part: m[i]}})) AS s FROM {name}_all)
    WHERE {test})"""


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{_sql_spans("assign", ASSIGN, 0, "length(regexp_replace(s.part, '" + ASSIGN_HEAD.replace("'", "''") + "', '')) >= 6")},
{_sql_spans("access", ACCESS, 1)},
{_sql_spans("hex", HEX, 2)},
{_sql_spans("weak_id", WEAK_ID, 3)},
{_sql_spans("weak_secret", WEAK_SECRET, 4, "regexp_matches(s.part, '[0-9]') AND regexp_matches(s.part, '[A-Z]') AND regexp_matches(s.part, '[a-z]')")},
{_sql_spans("endpoint", ENDPOINT, 5)},
strong AS (FROM assign UNION ALL FROM access UNION ALL FROM hex),
loose AS (
    SELECT * FROM weak_secret w WHERE NOT EXISTS (SELECT 1 FROM strong s WHERE s.doc_id = w.doc_id AND s.start < w."end" AND s."end" > w.start)),
every AS (FROM strong UNION ALL FROM weak_id UNION ALL FROM loose UNION ALL FROM endpoint),
needs AS (SELECT * FROM (VALUES {", ".join(f"({KINDS.index(w)}, {KINDS.index(o)})" for w, os in COMPLETES.items() for o in os)}) v(weak, other)),
spans AS (
    SELECT DISTINCT a.doc_id, a.start, a.rank, a."end" FROM every a
    WHERE a.rank < 3 OR EXISTS (
        SELECT 1 FROM every b JOIN needs ON needs.other = b.rank
        WHERE needs.weak = a.rank AND b.doc_id = a.doc_id AND abs(b.start - a.start) <= {SCOPE})),
named AS (
    SELECT *, concat([{", ".join(f"'{k}'" for k in KINDS)}][rank + 1], ':', start, ':', "end") AS s FROM spans)
SELECT d.doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
       sha256(coalesce(string_agg(s, ',' ORDER BY start, rank, "end") FILTER (rank < 3), '')) AS base_sha256,
       coalesce(string_agg(s, ',' ORDER BY start, rank, "end"), '') AS spans
FROM d LEFT JOIN named ON named.doc_id = d.doc_id GROUP BY d.doc_id
"""
