"""Benchmark decontamination: windows of test items found in training texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import ascii_lower, fresh, row_key, sha, whole
from portolan.session import written

#: Consecutive words of a test item that make a window.
WINDOW = 10
#: Up to so many distinct windows go to every task as a hash set; more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000
#: Characters that separate words: ASCII other than letters and digits, after lower-casing.
GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.filter(F.split(ascii_lower(whole(text)), GAP), lambda w: w != "")


def _mark(ws: Column, at: Column, size: Column | int) -> Column:
    """A cheap hash of the window of ``size`` words at the 0-based ``at``: three of its words."""
    size = F.lit(size) if isinstance(size, int) else size
    pick = lambda i: F.get(ws, at + i)
    return F.xxhash64(size, pick(F.lit(0)), pick((size / 2).cast("int")), pick(size - 1))


def item_windows(bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """``item_id, size, gram`` (an array of words), one row per distinct window of an item.

    An item of fewer than ``window`` words is one window; an item without words has none.
    """
    size = F.least(F.size("ws"), F.lit(window))
    return (
        bench.select("item_id", words(F.col("text")).alias("ws"))
        .where(F.size("ws") > 0)
        .select("item_id", size.alias("size"), F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - size + 1), lambda i: F.slice("ws", i, size))).alias("gram"))
        .distinct()
    )


def hits(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """``row, doc_id, at, size, gram_id``: where windows of test items occur in texts.

    Every window of every text is hashed from three of its words and looked up in the set of item
    windows; a hit counts when all its words agree. The set is sent to every task if it is
    small, and joined by a shuffle if not.
    """
    spark = docs.sparkSession
    grams = item_windows(bench, window).select("size", "gram").distinct()
    grams = written(grams.select("size", "gram", _mark(F.col("gram"), F.lit(0), F.col("size")).alias("mark"), F.md5(F.concat_ws(" ", "gram")).alias("gram_id")), "grams")
    # at most ``window`` numbers
    sizes = sorted(r["size"] for r in grams.select("size").distinct().collect())
    set_ = grams.withColumnRenamed("size", "gram_size").withColumnRenamed("mark", "gram_mark")
    if grams.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        set_ = F.broadcast(set_)
    if not sizes:
        return spark.createDataFrame([], "row string, doc_id long, at int, size int, gram_id string")
    text = docs.select("doc_id", whole().alias("t")).select("doc_id", "t", words(F.col("t")).alias("ws"))
    starts = lambda n: F.when(F.size("ws") >= n, F.sequence(F.lit(0), F.size("ws") - n)).otherwise(F.array().cast("array<int>"))
    marked = lambda n: F.transform(starts(n), lambda i: F.struct(i.alias("at"), F.lit(n).alias("size"), _mark(F.col("ws"), i, n).alias("mark")))
    spread = text.select("doc_id", "t", "ws", F.explode(F.concat(*map(marked, sizes))).alias("m")).select("doc_id", "t", "ws", "m.at", "m.size", "m.mark")
    same = (F.col("mark") == F.col("gram_mark")) & (F.col("size") == F.col("gram_size")) & (F.slice("ws", F.col("at") + 1, F.col("size")) == F.col("gram"))
    return spread.join(set_, same).select(row_key(F.col("doc_id"), F.col("t")).alias("row"), "doc_id", "at", "size", "gram_id")


def decontaminate(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: ``row, doc_id, n_words, n_hit, item_ids, spans, contaminated``.

    Words are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased.
    A word inside an occurrence of a window is hit. ``item_ids`` are the items with an occurring
    window, sorted as strings; ``spans`` the maximal runs of hit words as ``struct<start, end>``, word
    numbers, end exclusive. Null texts have no words; items without words and null items match
    nothing; a null item_id counts for hits but is not listed. Repeated rows stay repeated. An empty
    benchmark hits nothing.
    """
    found = written(hits(docs, bench, window).distinct(), "hits")
    ids = item_windows(bench, window).select(F.col("item_id").cast("string").alias("item"), F.md5(F.concat_ws(" ", "gram")).alias("gram_id"))
    items = found.select("row", "gram_id").distinct().join(ids, "gram_id").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    places = found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("size")).alias("end")))).alias("places"))
    kind = "struct<start:int,end:int>"

    def merge(acc, p):
        last = F.element_at(acc, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], p["end"]).alias("end")).cast(kind)
        new = F.struct(p["at"].alias("start"), p["end"].alias("end")).cast(kind)
        meets = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= p["at"])
        return F.when(meets, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.array_append(acc, new))

    spans = F.aggregate("places", F.array().cast(f"array<{kind}>"), merge)
    base = docs.select("doc_id", row_key(F.col("doc_id"), whole()).alias("row"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(places.select("row", spans.alias("spans")), "row", "left").join(items, "row", "left")
    none = F.array().cast(f"array<{kind}>")
    return out.select(
        "row",
        "doc_id",
        "n_words",
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.lit(0)).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.coalesce("spans", none).alias("spans"),
        F.col("spans").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the texts that hold a window of a test item."""
    key = fresh("row_key", docs)
    bad = hits(docs, bench, window).select(F.col("row").alias(key)).distinct()
    return docs.withColumn(key, row_key(F.col("doc_id"), whole())).join(bad, key, "left_anti").select(*docs.columns)


def remove_spans(docs: DataFrame, bench: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the hit words cut out of ``text``; each cut runs from its first word to its last."""
    key = fresh("row_key", docs)
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    bad = decontaminate(docs, bench, window).where("contaminated").select(F.col("row").alias(key), F.col("spans").alias(key + "_s")).dropDuplicates([key])
    joined = docs.withColumn(key, row_key(F.col("doc_id"), whole())).join(bad, key, "left")
    gaps, ws = F.split(whole(), word, -1), F.regexp_extract_all(whole(), F.lit(word), F.lit(0))
    inside = lambda i: F.exists(key + "_s", lambda s: (s["start"] <= i) & (i < s["end"]))
    within = lambda i: F.exists(key + "_s", lambda s: (s["start"] < i) & (i < s["end"]))
    pieces = F.transform(gaps, lambda g, i: F.concat(F.when(within(i), "").otherwise(g), F.when(inside(i), "").otherwise(F.coalesce(F.get(ws, i), F.lit("")))))
    text = F.when(F.col(key + "_s").isNull(), F.col("text")).otherwise(F.concat_ws("", pieces))
    return joined.withColumn("text", text).select(*docs.columns)


def digest(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Counts and the digest of the items, one row per row of ``docs``."""
    return decontaminate(docs, bench).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        sha(F.concat_ws(",", "item_ids")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM documents),
b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
    FROM benchmark),
g AS (
    SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS size, array_to_string(ws[i:i + least(len(ws), {WINDOW}) - 1], ' ') AS gram
    FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(len(ws), {WINDOW}) + 2)) AS i FROM b WHERE len(ws) > 0)),
p AS (
    SELECT doc_id, ws, i, size
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d), (SELECT DISTINCT size FROM g)
    WHERE i + size - 1 <= len(ws)),
h AS (SELECT doc_id, i, p.size, item_id FROM p JOIN g ON p.size = g.size AND array_to_string(ws[i:i + p.size - 1], ' ') = gram),
w AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM h) GROUP BY doc_id),
n AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN w ON w.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
