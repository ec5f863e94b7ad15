"""Exact de-duplication by progressive refinement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import SPACE, fresh, sha, whole
from portolan.session import written

#: Characters of the normalised text that the second step hashes.
PREFIX = 64
#: Bits of the map of surviving keys; it is 8 MiB at most, however large the input is.
MAP_BITS = 1 << 26


def normalised(text: Column | str = "text") -> Column:
    """The text with each run of white space as one space."""
    return F.regexp_replace(whole(text), SPACE, " ")


def surviving_bits(keys: DataFrame, key: Column) -> DataFrame:
    """``bucket, bits``: a bit map of the keys, ``MAP_BITS`` in all, by ``key % MAP_BITS``."""
    at = F.pmod(key, F.lit(MAP_BITS))
    return keys.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def exact_groups(docs: DataFrame, every_hash: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they agree after white space is normalised; null counts as empty. Rows
    are grouped by length, those of a shared length by the hash of a prefix too, and only where
    length and prefix are shared is the full text hashed and compared. Which rows need that is
    told by a bit map of fixed size, sent to every task, so no text is shuffled; keys that share a
    bit by chance are hashed in vain, which changes nothing. ``text_sha256`` is null for the rest
    unless ``every_hash``.

    Of a group the smallest doc_id stays; a null id loses to any other, and of repeated rows (equal
    id and text) one stays. An empty table gives no rows. Other columns are not looked at.
    """
    text = normalised()
    lone = docs.select("doc_id", text.alias("t")).select(
        "doc_id", F.length("t").alias("len"), F.xxhash64(F.length("t"), F.substring("t", 1, PREFIX)).alias("prefix"), "t"
    )
    seen = written(lone.select("len", "prefix").groupBy("len", "prefix").agg(F.count("*").alias("n")), "prefixes")
    lengths = seen.groupBy("len").agg(F.sum("n").alias("all")).where("all > 1").select("len")
    keys = seen.where("n > 1").join(lengths, "len", "left_semi")
    # at most MAP_BITS / 32768 rows of 4 KiB
    bits = F.broadcast(surviving_bits(keys, F.col("prefix")))
    place = F.pmod("prefix", F.lit(MAP_BITS))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = (
        lone.withColumns({"bucket": F.bitmap_bucket_number(place), "bit": bit})
        .join(bits, "bucket", "left")
        .withColumn("maybe", F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(bit % 8 as int))")) != 0, F.lit(False)))
    )
    hashed = F.col("maybe") | F.lit(every_hash)
    rows = marked.select("doc_id", "maybe", F.when(hashed, sha(F.col("t"))).alias("h"))
    rows = written(rows, "hashed")
    copies = rows.where("maybe").groupBy("h", "doc_id").agg(F.count("*").alias("n"))
    groups = copies.groupBy("h").agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    # a group may hold a third of all rows: it is the left side of the join, which Spark can split
    again = copies.join(groups, "h").select("doc_id", "keep_id", "group_size", "h", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i"))
    found = again.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), F.col("h").alias("text_sha256"))
    single = rows.where("NOT maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("h").alias("text_sha256"))
    return found.unionByName(single)


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept; rules as in `exact_groups`."""
    key = fresh("copy_key", docs)
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), sha(normalised()))
    groups = exact_groups(docs).where("group_size > 1")
    gone = groups.where("NOT doc_id <=> keep_id").select(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_sha256").alias(key)).distinct()
    # the second step takes repeated rows, on the partitions of the first
    return docs.withColumn(key, name).join(gone.hint("merge"), key, "left_anti").dropDuplicates([key]).select(*docs.columns)


ORACLE = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
h AS (SELECT doc_id, sha256(t) AS text_sha256 FROM n)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM h WINDOW w AS (PARTITION BY text_sha256)
"""
