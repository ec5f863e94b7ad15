"""C: scalar functions over code text, all native column expressions."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from portolan.functions import rules


def any_word(col: Column, words: list[str]) -> Column:
    """True when any word occurs as a substring; ``$word`` must end the text."""
    out = F.lit(False)
    for w in words:
        out = out | (col.endswith(w[1:]) if w.startswith("$") else col.contains(w))
    return out


def classify_first_match(col: Column, rule_list: list[tuple[str, list[str]]], default: str | None = None, case: str = "lower") -> Column:
    """Label of the first rule with a matching word. ``case`` is lower, upper or keep."""
    text = {"lower": F.lower, "upper": F.upper, "keep": lambda c: c}[case](col)
    out = F.lit(default)
    for label, words in reversed(rule_list):
        out = F.when(any_word(text, words), F.lit(label)).otherwise(out)
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _best_domain(parts: list[tuple[Column, int]], domains: list[tuple[str, str]], least: int) -> Column:
    """Label with the highest score, the earliest winning ties; null below ``least``.

    Each part adds its weight for every word of the label it contains.
    """
    table = F.array(
        *[
            F.struct(F.lit(label).alias("label"), F.lit(-i).alias("order"), F.array(*[F.lit(w) for w in words.split()]).alias("words"))
            for i, (label, words) in enumerate(domains)
        ]
    )

    def hits(text: Column, words: Column) -> Column:
        return F.size(F.filter(words, lambda w: text.contains(w)))

    def scored(texts: Column) -> Column:
        def one(d: Column) -> Column:
            total = F.lit(0)
            for i, (_, weight) in enumerate(parts):
                total = total + hits(texts[f"t{i}"], d["words"]) * weight
            return F.struct(total.alias("score"), d["order"].alias("order"), d["label"].alias("label"))

        return F.array_max(F.transform(table, one))

    best = let(F.struct(*[c.alias(f"t{i}") for i, (c, _) in enumerate(parts)]), scored)
    return let(best, lambda b: F.when(b["score"] >= least, b["label"]))


def classify_domain(name: Column, content: Column, domains=rules.CHUNK_DOMAINS, least: int = 2) -> Column:
    """C14: business domain of a chunk: 3 per word in its name, 1 per word in its content."""
    return _best_domain([(F.lower(F.coalesce(name, F.lit(""))), 3), (F.lower(content), 1)], domains, least)


def classify_repository_domain(name: Column, explicit: Column | None = None, domains=rules.REPOSITORY_DOMAINS) -> Column:
    """The given domain, else the one with most words in the name, else ``general``."""
    best = F.coalesce(_best_domain([(F.lower(name), 2)], domains, 2), F.lit("general"))
    return best if explicit is None else F.coalesce(F.nullif(explicit, F.lit("")), best)


def is_excluded(path: Column, patterns: list[str]) -> Column:
    """B1: ``**/x/**`` of a known directory means any path segment x; the rest are globs over the path."""
    segments = [m.group(1) for p in patterns if (m := re.fullmatch(r"\*\*/([^/*]+)/\*\*", p)) and m.group(1) in rules.EXCLUDED_DIRECTORIES]
    globs = [p for p in patterns if not any(p == f"**/{s}/**" for s in segments)]
    out = F.lit(False)
    if segments:
        out = out | path.rlike("(^|/)(" + "|".join(re.escape(s) for s in segments) + ")/")
    for g in globs:
        out = out | path.rlike(glob_regex(g))
    return out


def glob_regex(glob: str) -> str:
    """A whole-text pattern for a glob whose ``*`` also crosses slashes."""
    inner = fnmatch.translate(glob)
    # Python's end anchor has another name in Java
    return "^" + re.sub(r"\\[zZ]$", "", inner).replace("(?>", "(?:") + "$"


def detect_language(path: Column, content: Column) -> Column:
    """B2: language by suffix, else by token pairs in the content, else null."""
    out = F.lit(None).cast("string")
    for lang, every, some in reversed(rules.LANGUAGE_TOKENS):
        hit = F.lit(True)
        for w in every:
            hit = hit & content.contains(w)
        if some:
            hit = hit & any_word(content, some)
        out = F.when(hit, lang).otherwise(out)
    for suffix, lang in reversed(rules.LANGUAGE_SUFFIXES):
        out = F.when(path.endswith(suffix), lang).otherwise(out)
    return out


def line_count(content: Column) -> Column:
    """C10."""
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1


def occurrences(content: Column, word: str) -> Column:
    """Non-overlapping substring count."""
    return (F.length(content) - F.length(F.replace(content, F.lit(word), F.lit("")))) / len(word)


def complexity(content: Column, words: list[str] = rules.DECISION_WORDS) -> Column:
    """One plus all decision words, per line."""
    total = F.lit(1.0)
    for w in words:
        total = total + occurrences(content, w)
    return total / line_count(content)


def regex_complexity(content: Column, words: list[str] = rules.REGEX_DECISION_WORDS) -> Column:
    """Whole decision words plus one; 1 without content."""
    return F.coalesce(F.regexp_count(content, F.lit(r"\b(" + "|".join(words) + r")\b")) + 1, F.lit(1))


def needs_split(content: Column, score: Column, max_size: int = 1000, max_complexity: float = 5) -> Column:
    """C4."""
    return (F.length(content) > max_size) | (score > max_complexity)


def chunk_id(path: Column, name: Column, line: Column) -> Column:
    """C7."""
    return F.md5(F.concat_ws(":", path, name, line.cast("string")))


def conflict_id(ga: Column, versions: Column) -> Column:
    """First eight digits over the coordinates and the sorted, quoted version list."""
    quoted = F.transform(F.array_sort(versions), lambda v: F.concat(F.lit("'"), v, F.lit("'")))
    return F.substring(F.md5(F.concat(ga, F.lit(":["), F.array_join(quoted, ", "), F.lit("]"))), 1, 8)


def cycle_id(path: Column) -> Column:
    """C7."""
    return F.substring(F.md5(F.array_join(F.array_sort(path), "->")), 1, 8)


def context_window(content: Column, start: Column, end: Column, n: int = 3) -> tuple[Column, Column]:
    """C11: up to ``n`` lines before line ``start`` and after line ``end`` (both count from 0)."""
    lines = F.split(content, "\n", -1)
    first = F.greatest(F.lit(0), start - n)
    before = F.slice(lines, first + 1, start - first)
    after = F.slice(lines, end + 2, F.lit(n))
    return F.array_join(before, "\n"), F.array_join(after, "\n")


def prefix_similarity(a: Column, b: Column) -> Column:
    """Length of the common prefix over the longer length; 1 for equal names."""
    longest = F.greatest(F.length(a), F.length(b))
    shared = F.size(
        F.filter(
            F.sequence(F.lit(1), F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))),
            lambda i: (F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i)) & (i <= F.least(F.length(a), F.length(b))),
        )
    )
    return F.when(a == b, F.lit(1.0)).otherwise(shared / longest)


def content_flags(content: Column) -> dict[str, Column]:
    """Named flags for error handling, loops, conditionals, async, database and API use."""
    low = F.lower(content)
    return {name: any_word(low, words) for name, words in rules.CONTENT_FLAGS.items()}


def importance_score(
    chunk_type: Column, score: Column, has_doc: Column, name: Column, related: Column, domain: Column
) -> Column:
    """C17."""
    base = F.lit(0.5)
    for kind, value in rules.CHUNK_TYPE_SCORES.items():
        base = F.when(chunk_type == kind, value).otherwise(base)
    named = F.when(name.isNull() | (name == ""), 0.0).when(name.startswith("_"), -0.1).otherwise(0.2)
    return (
        base
        + F.least(score * 0.1, F.lit(0.5))
        + F.when(has_doc, 0.3).otherwise(0.0)
        + named
        + F.least(related * 0.1, F.lit(0.5))
        + F.when(domain.isNotNull(), 0.2).otherwise(0.0)
    )


def embedding_text(chunk_type: Column, name: Column, doc: Column, domain: Column, before: Column, content: Column, imports: Column) -> Column:
    """The text a chunk is embedded by."""
    put = lambda tag, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(tag), c))
    tail = F.array_join(F.slice(F.split(before, "\n", -1), F.greatest(F.lit(-2), -F.size(F.split(before, "\n", -1))), F.lit(2)), " ")
    return F.concat_ws(
        "\n",
        F.concat_ws(": ", chunk_type, F.nullif(name, F.lit(""))),
        put("Documentation: ", doc),
        put("Domain: ", domain),
        F.when(before.isNotNull() & (before != ""), F.concat(F.lit("Context: "), tail)),
        F.concat(F.lit("Code: "), content),
        F.when(F.size(imports) > 0, F.concat(F.lit("Imports: "), F.array_join(imports, ", "))),
    )


def chunk_summary(chunk_type: Column, name: Column, start: Column, end: Column, language: Column, score: Column, domain: Column, has_doc: Column, related: Column) -> Column:
    """One line about a chunk."""
    return F.concat_ws(
        " | ",
        F.concat_ws(": ", F.initcap(F.replace(chunk_type, F.lit("_"), F.lit(" "))), F.nullif(name, F.lit(""))),
        F.concat(F.lit("Lines "), (start + 1).cast("string"), F.lit("-"), (end + 1).cast("string")),
        F.concat(F.lit("Language: "), language),
        F.when(score > 1, F.concat(F.lit("Complexity: "), F.format_string("%.1f", score))),
        F.concat(F.lit("Domain: "), domain),
        F.when(has_doc, F.lit("Documented")),
        F.when(related > 0, F.concat(F.lit("Related to "), related.cast("string"), F.lit(" other chunks"))),
    )


def preprocess_code(content: Column, keep_comments: bool = True) -> Column:
    """Stripped lines without blanks, optionally without comment lines."""
    lines = F.transform(F.split(content, "\n", -1), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kept = F.filter(lines, lambda x: x != "")
    if not keep_comments:
        kept = F.filter(kept, lambda x: ~(x.startswith("//") | x.startswith("#")))
    return F.array_join(kept, "\n")


def coordinates(group: Column, artifact: Column, version: Column, kind: Column, classifier: Column) -> Column:
    """Group:artifact:version[:type][:classifier], the type only when it is not jar."""
    return F.concat_ws(":", group, artifact, version, F.when(kind != "jar", kind), F.nullif(classifier, F.lit("")))


def ga(group: Column, artifact: Column) -> Column:
    """C21."""
    return F.concat_ws(":", group, artifact)


def preview(content: Column, n: int = 300) -> Column:
    """The first characters and three dots."""
    return F.concat(F.substring(content, 1, n), F.lit("..."))


def weeks(days: Column) -> Column:
    """Whole five-day weeks, one at least."""
    return F.greatest(F.lit(1), F.floor(days / 5)).cast("int")


def bucket_1_to_5(value: Column) -> Column:
    """Rounded half to even and held between 1 and 5."""
    return F.least(F.lit(5), F.greatest(F.lit(1), F.bround(value, 0))).cast("int")


def endpoint_type(url: Column) -> Column:
    """Kind of a web address; the API mark is case-sensitive."""
    return F.when(url.contains("/api/"), "API Endpoint").otherwise(classify_first_match(url, rules.ENDPOINT_TYPE, "Web Page"))


def sql_context(path: Column, sql: Column) -> Column:
    """Business context of a statement, from its file first."""
    by_text = classify_first_match(sql, rules.SQL_CONTEXT_TEXT, "general_data_access")
    return F.coalesce(classify_first_match(path, rules.SQL_CONTEXT_PATH), by_text)


def struts_tag_purpose(namespace: Column, tag: Column) -> Column:
    """C16."""
    known = F.create_map(*[F.lit(x) for kv in rules.STRUTS_TAG_PURPOSE.items() for x in kv])
    return F.coalesce(known[F.concat_ws(":", namespace, tag)], F.concat(F.lit("UI component: "), tag))


def graphql_type(field_type: Column) -> Column:
    """GraphQL scalar of a field type."""
    low = F.lower(F.coalesce(field_type, F.lit("")))
    out = F.lit("String")
    for name, kinds in rules.GRAPHQL_TYPE.items():
        out = F.when(low.isin(kinds), name).otherwise(out)
    return out


def visual_label(label: Column) -> Column:
    """A label the display knows, else ``Unknown``."""
    return F.when(label.isin(rules.VISUAL_LABELS), label).otherwise("Unknown")


def column_purpose(name: Column) -> Column:
    """What a column holds, by its name."""
    return classify_first_match(name, rules.COLUMN_PURPOSE, "Business data field", case="upper")


def severity_rank(severity: Column) -> Column:
    """Order of severities, the worst first."""
    names = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
    out = F.lit(len(names))
    for i, name in enumerate(names):
        out = F.when(F.upper(severity) == name, i).otherwise(out)
    return out


def clean_map(m: Column) -> Column:
    """A map without its null values."""
    return F.map_filter(m, lambda _, v: v.isNotNull())
