"""Search queries: embeddings for vectors, documents for texts, benchmark items as questions."""

import uuid

from pyspark.sql import functions as F

from portolan.functions import rules
from portolan.operators import search
from portolan.queries.registry import query
from portolan.queries.text_queries import first_match
from portolan.session import scratch_root, widen, written
from portolan.sources import stores


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


def asked(t):
    """Benchmark items with a text and a vector."""
    b, e = t.benchmark, t.embeddings
    return b.join(e, b.item_id == e.vec_id).select(F.col("item_id").alias("query_id"), "text", F.col("embedding").alias("vector"))


def chunks(t):
    """Documents that have a vector."""
    return t.chunks.join(t.vectors, "id")


def files(t):
    """Source files that have a vector."""
    return t.source_files.withColumnRenamed("path", "file_path").join(t.vectors, "id")


ASKED = "asked AS (SELECT item_id AS query_id, text, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON item_id = vec_id)"


def hits(name, source, k, least=None, asked="asked"):
    cut = "" if least is None else f" AND score >= {least}"
    return f"""
    {name}_scored AS (SELECT q.query_id, c.id, round(list_cosine_similarity(q.v, c.vector::DOUBLE[]), 6) AS score
                      FROM {asked} q CROSS JOIN {source} c),
    {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_scored)
               WHERE rank <= {k}{cut})"""


def with_rows(found, rows):
    return found.join(rows.select("id", "file_path", "content"), "id")


@query("normalized_vectors", """
    SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) / pow(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 2), 6) AS len2,
           round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first,
           round(embedding[64]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS last FROM embeddings""")
def _(t):
    v = t.embeddings.select("vec_id", search.l2_normalize(F.col("embedding")).alias("u"))
    return v.select(
        "vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("len2"), F.round(F.col("u")[0], 6).alias("first"),
        F.round(F.element_at("u", -1), 6).alias("last"),
    )


@query("vector_search", f"WITH {ASKED}, {hits('h', 'vectors', 10, 0.2)} SELECT query_id, id, score, rank FROM h")
def _(t):
    return search.vector_search(asked(t), t.vectors, 10, 0.2)


@query("vector_search_filtered", f"""
    WITH {ASKED}, c AS (SELECT id, vector FROM chunks JOIN vectors USING (id) WHERE language = 'en'), {hits('h', 'c', 5)}
    SELECT query_id, id, score, rank FROM h""")
def _(t):
    return search.vector_search(asked(t), chunks(t).where("language = 'en'"), 5)


@query("similar_chunks", """
    WITH s AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.vector::DOUBLE[], b.vector::DOUBLE[]), 6) AS score
               FROM vectors a, vectors b WHERE a.id <> b.id)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5 AND score >= 0.3""")
def _(t):
    return search.similar_chunks(t.vectors, k=5, min_score=0.3)


@query("similar_files", """
    WITH c AS (SELECT id, file_path, vector::DOUBLE[] AS v FROM chunks JOIN vectors USING (id)),
    f AS (SELECT file_path, v FROM c WHERE (file_path, id) IN (SELECT (file_path, min(id)) FROM c GROUP BY file_path)),
    s AS (SELECT f.file_path, c.file_path AS similar_file, c.id, round(list_cosine_similarity(f.v, c.v), 6) AS score FROM f JOIN c ON f.file_path <> c.file_path),
    n AS (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, id) AS rn FROM s),
    b AS (SELECT file_path, similar_file, max(score) AS score FROM n WHERE rn <= 15 GROUP BY 1, 2)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, similar_file) AS rank FROM b) WHERE rank <= 5""")
def _(t):
    return search.similar_files(chunks(t), 5)


def bm25(name, asked, docs, k):
    tok = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
    return f"""
    {name}_d AS (SELECT id, {tok.format('content')} AS tk FROM {docs}),
    {name}_n AS (SELECT count(*) AS n, avg(len(tk)) AS m FROM {name}_d),
    {name}_p AS (SELECT id, len(tk) AS size, t.term, count(*) AS tf FROM {name}_d, unnest(tk) AS t(term) GROUP BY 1, 2, 3),
    {name}_f AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS w FROM {name}_p, {name}_n GROUP BY term, n),
    {name}_q AS (SELECT DISTINCT query_id, t.term FROM {asked}, unnest({tok.format('text')}) AS t(term)),
    {name}_s AS (SELECT query_id, id, round(sum(w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / m))), 6) AS score
                 FROM {name}_q JOIN {name}_p USING (term) JOIN {name}_f USING (term), {name}_n GROUP BY query_id, id),
    {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {name}_s) WHERE rank <= {k})"""


@query("keyword_search", f"WITH {bm25('w', 'questions', 'chunks', 10)} SELECT query_id, id, score, rank FROM w")
def _(t):
    return search.keyword_search(t.questions, widen(t.chunks).select("id", "content"), 10)


@query("hybrid_search", f"""
    WITH {ASKED}, c AS (SELECT * FROM chunks JOIN vectors USING (id)), {hits('h', 'c', 20)}, {bm25('w', 'asked', 'chunks', 10)},
    b AS (SELECT query_id, id, round(score * 0.7, 9) AS score, 'semantic' AS source FROM h
          UNION ALL SELECT query_id, id, round(score * 0.3, 9), 'graph' FROM w),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, source DESC) AS rn FROM b) WHERE rn = 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, count(*) OVER (PARTITION BY query_id) AS total_results FROM u)
    SELECT query_id, id, score, source, rank, total_results FROM r WHERE rank <= 10""")
def _(t):
    every = widen(t.chunks).join(t.vectors, "id", "left")
    return search.hybrid_search(asked(t), every.select("id", "content", "vector"), 10)


EXPANDED = f"""
    {ASKED}, c AS (SELECT * FROM chunks JOIN vectors USING (id)), {hits('h', 'c', 10)},
    l AS (SELECT DISTINCT src, dst FROM chunk_edges),
    i AS (SELECT dst AS id, array_to_string(list_sort(list(src))[1:5], ', ') AS five, array_to_string(list_sort(list(src))[1:3], ', ') AS three FROM l GROUP BY dst),
    o AS (SELECT src AS id, array_to_string(list_sort(list(dst))[1:5], ', ') AS five, array_to_string(list_sort(list(dst))[1:3], ', ') AS three FROM l GROUP BY src),
    x AS (SELECT h.*, coalesce(i.five, '') AS callers, coalesce(o.five, '') AS callees, coalesce(i.three, '') AS callers3, coalesce(o.three, '') AS callees3, CAST(label AS VARCHAR) AS domains
          FROM h LEFT JOIN i USING (id) LEFT JOIN o USING (id) JOIN embeddings ON id = vec_id)"""


def expanded(t, items):
    c = chunks(t)
    found = search.vector_search(asked(t), c, 10)
    return search.expand_hits(found, t.chunk_edges, t.vectors.select("id", "domain"), items)


@query("expanded_hits", f"WITH {EXPANDED} SELECT query_id, id, score, rank, callers, callees, domains FROM x WHERE rank <= 5")
def _(t):
    x = expanded(t, 5)
    return x.select("query_id", "id", "score", "rank", *[F.array_join(c, ", ").alias(c) for c in ("callers", "callees", "domains")])


@query("retrieval_context", f"""
    WITH {EXPANDED} SELECT query_id, rank, x.id, repository, file_path, score, substr(content, 1, 1200) AS snippet, domains, callers3 AS callers, callees3 AS callees,
           CAST(NULL AS INT) AS start_line, CAST(NULL AS INT) AS end_line
    FROM x JOIN chunks ON x.id = chunks.id WHERE rank <= 8""")
def _(t):
    return search.build_context(expanded(t, 10), t.chunks)


@query("context_flows", """
    SELECT flow, name, array_to_string(list_sort(list(repo))[1:5], ', ') AS repos
    FROM (SELECT * FROM flows ORDER BY name LIMIT 5) LEFT JOIN flow_repos USING (flow) GROUP BY flow, name""")
def _(t):
    return search.context_flows(t.flow_repos, t.flows)


@query("embedding_quality", """
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
    x AS (SELECT unnest(e) AS x FROM v),
    p AS (SELECT avg(list_cosine_similarity(a.e, b.e)) AS s FROM v a JOIN v b ON a.vec_id < b.vec_id)
    SELECT round(avg(n), 6) AS mean_norm, round(stddev_pop(n), 6) AS std_norm, round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm,
           (SELECT round(avg(x), 6) FROM x) AS mean_activation, (SELECT round(stddev_pop(x), 6) FROM x) AS std_activation,
           (SELECT round(count(*) FILTER (WHERE abs(x) < 1e-6) / count(*), 6) FROM x) AS sparsity,
           (SELECT round(s, 6) FROM p) AS mean_similarity, (SELECT round(1 - s, 6) FROM p) AS diversity_score FROM v""")
def _(t):
    q = search.embedding_quality(t.vectors)
    return q.select(*r6(*q.columns))


@query("embedding_validation", """
    SELECT repository, count(*) AS chunks, count(*) FILTER (WHERE vector IS NULL) AS missing, 0 AS wrong_dimension, 0 AS with_null, 0 AS zero
    FROM chunks LEFT JOIN vectors USING (id) GROUP BY repository""")
def _(t):
    return search.validate_embeddings(t.chunks.join(t.vectors, "id", "left"), 64)


FILES = f"{ASKED}, f AS (SELECT source_files.id, path AS file_path, content, vector FROM source_files JOIN vectors ON source_files.id = vectors.id)"


STRUTS_HITS = """
    n AS (SELECT query_id, rank, score, file_path, content, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.[^.]*$', '') AS c,
                 row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rn
          FROM h JOIN f USING (id) WHERE contains(file_path, 'Action') AND contains(file_path, '.java'))
    SELECT query_id, replace(c, 'Action', '') AS feature_name, c AS class_name, file_path, score, concat(substr(content, 1, 300), '...') AS code_preview
    FROM n WHERE rn <= 20"""


@query("struts_action_search", f"WITH {FILES}, {hits('h', 'f', 50, 0.05)}, {STRUTS_HITS}")
def _(t):
    f = files(t)
    return search.struts_action_hits(with_rows(search.vector_search(asked(t), f, 50, 0.05), f))


LOGIC_HITS = f"""
    SELECT query_id, file_path, score, concat(substr(content, 1, 400), '...') AS code_snippet, {first_match('file_path', rules.FILE_TYPE, "'Other'")} AS file_type
    FROM h JOIN f USING (id)"""


@query("business_logic_search", f"WITH {FILES}, {hits('h', 'f', 15, 0.05)} {LOGIC_HITS}")
def _(t):
    f = files(t)
    return search.business_logic_hits(with_rows(search.vector_search(asked(t), f, 15, 0.05), f))


SECURITY_HITS = f"""
    SELECT split_part(text, ' ', 1) AS security_pattern, file_path, score, concat(substr(content, 1, 250), '...') AS code_snippet,
           {first_match('lower(text)', rules.SECURITY_ADVICE, "'" + rules.SECURITY_ADVICE_DEFAULT + "'")} AS recommendation
    FROM h JOIN f USING (id) JOIN asked ON h.query_id = asked.query_id ORDER BY h.query_id, rank LIMIT 20"""


@query("security_search", f"WITH {FILES}, {hits('h', 'f', 8, 0.05)} {SECURITY_HITS}")
def _(t):
    f = files(t)
    found = with_rows(search.vector_search(asked(t), f, 8, 0.05), f)
    return search.security_hits(found.join(asked(t).select("query_id", F.col("text").alias("pattern")), "query_id"))


FEATURE_HITS = """
    r AS (SELECT h.*, file_path, content FROM h JOIN f USING (id)),
    j AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rn FROM r WHERE contains(file_path, '.java')),
    x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rn FROM r WHERE contains(file_path, '.xml') OR contains(file_path, '.properties')),
    b AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(content, '(?i)FROM\\s+(\\w+)', 1)) AS name FROM r WHERE regexp_matches(content, '(?i)(SELECT|INSERT|UPDATE|DELETE|FROM)')),
    bn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY name) AS rn FROM b)
    SELECT query_id, 'class' AS kind, file_path AS name FROM j WHERE rn <= 10
    UNION ALL SELECT query_id, 'config', file_path FROM x WHERE rn <= 5
    UNION ALL SELECT query_id, 'table', name FROM bn WHERE rn <= 10
    UNION ALL SELECT query_id, 'service', concat('Referenced in ', regexp_extract(file_path, '([^/]*)$', 1)) FROM r WHERE regexp_matches(content, '(?i)(service|client|api|http)')"""


@query("feature_dependencies", f"WITH {FILES}, {hits('h', 'f', 20, 0.05)}, {FEATURE_HITS}")
def _(t):
    f = files(t)
    return search.feature_dependencies(with_rows(search.vector_search(asked(t), f, 20, 0.05), f))


@query("migration_suggestions", f"""
    WITH {FILES}, g AS (SELECT id, vector, concat(replace(file_path, 'red', 'OrderForm'), '') AS file_path, content FROM f), {hits('h', 'g', 20, 0.05)},
    r AS (SELECT h.*, file_path, lower(content) AS low, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem FROM h JOIN g USING (id))
    SELECT DISTINCT query_id, kind, name FROM (
        SELECT query_id, 'type' AS kind, replace(replace(replace(replace(stem, 'Form', ''), 'DTO', ''), 'Bean', ''), 'Data', '') AS name FROM r
        WHERE rank <= 8 AND (contains(stem, 'Form') OR contains(stem, 'DTO') OR contains(stem, 'Bean') OR contains(stem, 'Data'))
        UNION ALL SELECT query_id, 'query', concat('get', replace(replace(stem, 'Action', ''), 'Service', '')) FROM r
        WHERE rank <= 10 AND regexp_matches(low, 'get|find|search|list|retrieve')
        UNION ALL SELECT query_id, 'mutation', concat('update', replace(replace(stem, 'Action', ''), 'Service', '')) FROM r
        WHERE rank <= 10 AND regexp_matches(low, 'save|create|update|delete|insert')) WHERE name <> ''""")
def _(t):
    f = files(t).withColumn("file_path", F.expr("replace(file_path, 'red', 'OrderForm')"))
    found = with_rows(search.vector_search(asked(t), f, 20, 0.05), f)
    return search.migration_suggestions(found, found)


@query("legacy_pattern_search", f"""
    WITH {FILES}, {hits('h', 'f', 20, 0.05)}
    SELECT query_id, {first_match('file_path', rules.LEGACY_FILE_KIND, "'other_files'")} AS kind, file_path, score,
           concat(substr(content, 1, 300), '...') AS content_preview, count(*) OVER (PARTITION BY query_id) AS total_results
    FROM h JOIN f USING (id)""")
def _(t):
    f = files(t)
    return search.legacy_pattern_hits(with_rows(search.vector_search(asked(t), f, 20, 0.05), f))


def embedded_files(t):
    """All source files with a vector of the default encoder."""
    f = t.source_files.select("id", F.col("path").alias("file_path"), "content")
    return written(search.embed_chunks(f, size=search.VECTOR_SIZE), "embedded_files")


def named(t, texts, k, least):
    """Hits of named texts over all source files, with the files."""
    f = embedded_files(t)
    return with_rows(search.named_search(f, texts, k, least), f)


CRC_PLACE = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(token, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
                   lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384)), 4294967295) % 768"""


def preset_hits(asked, k, least):
    """DuckDB: hits ``h`` of the texts ``asked(query_id, text)`` among the source files ``f`` by the default encoder."""
    return f"""
    f AS (SELECT id, path AS file_path, content FROM source_files), asked AS ({asked}),
    said AS (SELECT 'f' AS kind, id::VARCHAR AS key, content AS words FROM f UNION ALL SELECT 'q', query_id, text FROM asked),
    token AS (SELECT kind, key, token, count(*) AS n FROM (SELECT kind, key, unnest(regexp_extract_all(lower(words), '\\w+')) AS token FROM said) GROUP BY ALL),
    place AS (SELECT token, {CRC_PLACE} AS place FROM (SELECT DISTINCT token FROM token)),
    vec AS (SELECT kind, key, place, sum(n)::DOUBLE AS x FROM token JOIN place USING (token) GROUP BY ALL),
    size AS (SELECT kind, key, sqrt(sum(x * x)) AS s FROM vec GROUP BY ALL),
    scored AS (SELECT q.key AS query_id, v.key::BIGINT AS id, round(sum(q.x * v.x) / (any_value(a.s) * any_value(b.s)), 6) AS score
               FROM vec q JOIN vec v ON q.place = v.place AND q.kind = 'q' AND v.kind = 'f' JOIN size a ON a.kind = 'q' AND a.key = q.key JOIN size b ON b.kind = 'f' AND b.key = v.key
               GROUP BY q.key, v.key),
    h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= {k} AND score >= {least})"""


def preset_rows(texts):
    return "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{text}')" for n, text in texts.items()) + ") a(query_id, text)"


def preset_texts(names, subject=""):
    return {n: search.PRESET_QUERIES[n].format(subject) for n in names}


SECURITY_TEXTS = {f"{i:02d}": q for i, q in enumerate(search.SECURITY_QUERIES)}


@query("named_struts_actions", f"WITH {preset_hits(preset_rows(preset_texts(['struts_actions'])), 50, 0.2)}, {STRUTS_HITS}")
def _(t):
    return search.struts_action_hits(named(t, preset_texts(["struts_actions"]), 50, 0.2))


@query("named_business_logic", f"WITH {preset_hits(preset_rows(preset_texts(['business_logic'], 'PartService')), 15, 0.1)} {LOGIC_HITS}")
def _(t):
    return search.business_logic_hits(named(t, preset_texts(["business_logic"], "PartService"), 15, 0.1))


@query("named_security", f"WITH {preset_hits(preset_rows(SECURITY_TEXTS), 8, 0.05)} {SECURITY_HITS}")
def _(t):
    return search.security_hits(named(t, SECURITY_TEXTS, 8, 0.05))


@query("named_feature_dependencies", f"WITH {preset_hits(preset_rows(preset_texts(['feature'], 'PartService')), 20, 0.05)}, {FEATURE_HITS}")
def _(t):
    return search.feature_dependencies(named(t, preset_texts(["feature"], "PartService"), 20, 0.05))


@query("named_migration_suggestions", f"""
    WITH {preset_hits(preset_rows(preset_texts(['suggestion_logic', 'suggestion_data'])), 20, 0.05)},
    r AS (SELECT h.*, lower(content) AS low, regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem FROM h JOIN f USING (id))
    SELECT DISTINCT 'suggestions' AS query_id, kind, name FROM (
        SELECT 'type' AS kind, replace(replace(replace(replace(stem, 'Form', ''), 'DTO', ''), 'Bean', ''), 'Data', '') AS name FROM r
        WHERE query_id = 'suggestion_data' AND rank <= 8 AND (contains(stem, 'Form') OR contains(stem, 'DTO') OR contains(stem, 'Bean') OR contains(stem, 'Data'))
        UNION ALL SELECT 'query', concat('get', replace(replace(stem, 'Action', ''), 'Service', '')) FROM r
        WHERE query_id = 'suggestion_logic' AND rank <= 10 AND regexp_matches(low, 'get|find|search|list|retrieve')
        UNION ALL SELECT 'mutation', concat('update', replace(replace(stem, 'Action', ''), 'Service', '')) FROM r
        WHERE query_id = 'suggestion_logic' AND rank <= 10 AND regexp_matches(low, 'save|create|update|delete|insert')) WHERE kind <> 'type' OR name <> ''""")
def _(t):
    found = named(t, preset_texts(["suggestion_logic", "suggestion_data"]), 20, 0.05)
    one = found.withColumn("query_id", F.lit("suggestions"))
    of = lambda name: one.where(F.col("pattern") == search.PRESET_QUERIES[name])
    return search.migration_suggestions(of("suggestion_logic"), of("suggestion_data"))


LEGACY_TEXTS = preset_rows(search.LEGACY_QUERIES) + " UNION ALL SELECT DISTINCT lower(p_type), lower(p_type) FROM part"


@query("embedded_legacy_search", f"""
    WITH {preset_hits(LEGACY_TEXTS, 20, 0.1)}
    SELECT query_id, {first_match('file_path', rules.LEGACY_FILE_KIND, "'other_files'")} AS kind, file_path, score,
           concat(substr(content, 1, 300), '...') AS content_preview, count(*) OVER (PARTITION BY query_id) AS total_results
    FROM h JOIN f USING (id)""")
def _(t):
    """Named patterns embedded with the default encoder and searched in the embedded source files."""
    f = search.embed_chunks(t.source_files.select("id", F.col("path").alias("file_path"), "content"), size=search.VECTOR_SIZE)
    patterns = t.part.select(F.lower("p_type").alias("pattern")).distinct().unionByName(
        t.spark.createDataFrame([(p,) for p in search.LEGACY_QUERIES], "pattern string")
    )
    q = search.embed_chunks(search.legacy_queries(patterns), content="text").select(F.col("pattern").alias("query_id"), "vector")
    return search.legacy_pattern_hits(with_rows(search.vector_search(q, f, 20, 0.1), f))


@query("embedded_chunks")
def _(t):
    out = search.embed_chunks(widen(t.chunks).select("id", "content"))
    return out.select("id", F.size("vector").alias("dimension"), F.round(F.array_max("vector"), 4).alias("largest"), "embedding_failed")


@query("embedding_places", f"""
    WITH w AS (SELECT id, content AS code FROM source_files),
    tokens AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(code), '\\w+')) AS token FROM w),
    crc AS (SELECT id, {CRC_PLACE} AS place FROM tokens)
    SELECT id, count(DISTINCT place) AS places, 768::BIGINT AS dimension, 1.0::DOUBLE AS norm, false AS embedding_failed FROM crc GROUP BY id""")
def _(t):
    """The default encoder: as many places as hashed tokens, at length one."""
    out = search.embed_chunks(t.source_files.select("id", "content"))
    size = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return out.select(
        "id", F.size(F.filter("vector", lambda x: x != 0)).cast("long").alias("places"), F.size("vector").cast("long").alias("dimension"),
        F.round(F.sqrt(size(F.col("vector"))), 4).alias("norm"), "embedding_failed",
    )


@query("written_vectors", """
    SELECT repository, count(*) AS chunks, count(*) FILTER (contains(content, 'tion')) AS failed, 4 * count(*) AS numbers,
           count(*) FILTER (contains(content, 'tion')) AS zero_vectors
    FROM chunks GROUP BY repository""")
def _(t):
    """A batch the encoder fails on is written with zero vectors, its flag and the error, and read back."""
    import numpy as np

    def encoder(texts):
        if any("tion" in x for x in texts):
            raise ValueError("no vector")
        return np.ones((len(texts), 4))

    made = search.embed_chunks(widen(t.chunks).select("id", "repository", "content"), encoder=encoder, size=4, batch=1).drop("content")
    path = f"{scratch_root(t.spark)}/vectors-{uuid.uuid4().hex}"
    stores.write_vectors(made, path)
    back = t.spark.read.parquet(path)
    empty = F.forall("vector", lambda x: x == 0)
    return back.groupBy("repository").agg(
        F.count("*").alias("chunks"), F.count_if(F.col("embedding_failed") & F.col("embedding_error").contains("no vector")).alias("failed"),
        F.sum(F.size("vector")).alias("numbers"), F.count_if(empty).alias("zero_vectors"),
    )
