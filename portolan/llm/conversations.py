"""Conversations as a trie of shared beginnings, found by blocks of turns first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import sha, whole
from portolan.operators.rank import with_rank
from portolan.session import written

#: Turns of a block.
BLOCK = 8
#: Conversations of a family share the first turns of its first one, this many less one at most.
FAMILY, HEADS = 20, 4
#: Ids that one row of a list of ids holds at most, as a power of two.
LIST_BITS = 12
WORD = "[^ \\t-\\r]+"


def _digest(parts: Column) -> Column:
    """128 bits, in hex, of strings of a fixed length each."""
    return F.substring(sha(F.array_join(parts, "")), 1, 32)


def turns_of(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, mark, words``: every turn with its place (from 1), a digest of role and text, and its words.

    Turns are ordered by ``turn``, null first; ties by the digest, so that reruns agree. Null roles and texts
    are empty. Rows without conv_id belong to no conversation. No text goes on from here.
    """
    role, text = whole("role"), whole("text")
    mark = F.substring(sha(F.concat_ws(":", F.char_length(role).cast("string"), role, text)), 1, 32)
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), mark.alias("mark"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    ranked = with_rank(written(rows, "turns"), ["conv_id"], ["turn", "mark"], "pos")
    return written(ranked.select("conv_id", F.col("pos").cast("long").alias("pos"), "mark", "words"), "places")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns, and the ids, of conversations that begin as the first one of their family does.

    Conversation ``c`` takes the first ``h`` turns of ``c - c % 20`` in place of its own first ``h``, where
    ``h = crc32(c) % 4``; there may be fewer such turns or none.
    """
    c = F.col("conv_id")
    ids = turns.select("conv_id").distinct().select(c, (c - c % FAMILY).alias("first"), F.pmod(F.crc32(c.cast("string")), F.lit(HEADS)).alias("h"))
    heads = (
        turns.where((c % FAMILY == 0) & (F.col("pos") < HEADS))
        .groupBy(c.alias("first"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", "mark", "words"))).alias("head"))
    )
    empty = F.array().cast("array<struct<pos:bigint,mark:string,words:bigint>>")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), empty)
    families = written(ids.join(heads, "first", "left").select("conv_id", "h", head.alias("head")), "families")
    taken = families.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.mark", "t.words")
    # a conversation may hold a third of all turns: it is the side that adaptive execution splits
    own = turns.join(families.select("conv_id", "h", F.size("head").alias("n")), "conv_id").where("pos > h")
    return taken.unionByName(own.select("conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("pos"), "mark", "words")), families.select("conv_id")


def _upto(words: Column, n: Column) -> Column:
    return F.aggregate(F.slice(words, F.lit(1), n), F.lit(0).cast("long"), lambda a, x: a + x)


def _id(carry: Column, marks: Column, n: Column, after: Column, block: int) -> Column:
    """The node after ``n`` turns of a block: its own digest, at the end of a whole block that of all blocks so far."""
    inside = _digest(F.concat(F.array(carry), F.slice(marks, F.lit(1), n)))
    return F.when(n == 0, carry).when(n == block, after).otherwise(inside)


def blocks_of(turns: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id, block, carry, after, before, marks, words``: the blocks of every conversation, an empty one at the end of whole ones.

    ``carry`` stands for all blocks before, ``after`` for these and the block itself (null unless whole), ``before`` is
    the words so far. Both come from digests of blocks of blocks in the same way, so a conversation of
    any length takes as many steps as its length has digits, and each group holds ``block`` rows at most.
    """
    at = ((F.col("pos") - 1) / block).cast("long")
    listed = F.array_sort(F.collect_list(F.struct("pos", "mark", "words")))
    grouped = turns.groupBy("conv_id", at.alias("block")).agg(listed.alias("t")).select("conv_id", "block", F.col("t.mark").alias("marks"), F.col("t.words").alias("words"))
    grouped = written(grouped, "blocks")
    whole_ = grouped.where(F.size("marks") == block)
    if whole_.isEmpty():
        top = ids.select("conv_id", F.lit(0).cast("long").alias("block"), F.lit("").alias("carry"), F.lit(None).cast("string").alias("after"), F.lit(0).cast("long").alias("before"))
    else:
        whole_ = whole_.select("conv_id", (F.col("block") + 1).alias("pos"), _digest(F.col("marks")).alias("mark"), _upto(F.col("words"), F.lit(block)).alias("words"))
        upper = blocks_of(whole_, ids, block)
        carry, marks, after, size = F.col("carry"), F.col("marks"), F.col("after"), F.size("marks")

        def place(j):
            return F.struct(
                (F.col("block") * block + j).alias("block"),
                _id(carry, marks, j, after, block).alias("carry"),
                F.when(j < size, _id(carry, marks, j + 1, after, block)).alias("after"),
                (F.col("before") + _upto(F.col("words"), j)).alias("before"),
            )

        places = F.transform(F.sequence(F.lit(0), F.least(size, F.lit(block - 1))), place)
        top = upper.select("conv_id", F.explode(places).alias("p")).select("conv_id", "p.*")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return top.join(grouped, ["conv_id", "block"], "left").select("conv_id", "block", "carry", "after", "before", none("marks", "string"), none("words", "bigint"))


def _turn_rows(rows: DataFrame, block: int, keep: list[str]) -> DataFrame:
    """One row per turn of the blocks: ``id, parent, depth, words, before`` and ``keep``."""
    carry, marks, after = F.col("carry"), F.col("marks"), F.col("after")

    def turn(j):
        return F.struct(
            _id(carry, marks, j, after, block).alias("id"),
            _id(carry, marks, j - 1, after, block).alias("parent"),
            (F.col("block") * block + j).alias("depth"),
            F.get(F.col("words"), j - 1).alias("words"),
            (F.col("before") + _upto(F.col("words"), j - 1)).alias("before"),
        )

    turns = F.transform(F.sequence(F.lit(1), F.size("marks")), turn)
    return rows.select(*keep, F.explode(turns).alias("t")).select("t.*", *keep)


def _ends(ends: DataFrame) -> DataFrame:
    """``id, ends_sha256``: digest of the ids that end at a node, over rows ``id, conv_id``.

    Runs of ids are joined where they are grouped, so a node at which a third of all conversations end comes as few rows;
    these go past a running digest in order.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    runs = ends.groupBy("id", F.shiftright("conv_id", LIST_BITS).alias("run")).agg(ids.alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            ready = []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key == last:
                    state.update(b",")
                else:
                    if last is not None:
                        ready.append((last, state.hexdigest()))
                    last, state = key, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in ready], pa.string()) for i in (0, 1)], ["id", "ends_sha256"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([state.hexdigest()])], ["id", "ends_sha256"])

    return runs.repartition("id").sortWithinPartitions("id", "run").mapInArrow(hashed, "id string, ends_sha256 string")


def prefix_trie(turns: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """The trie over ``turns`` (``conv_id, pos, mark, words``) of the conversations ``ids``, one row per node.

    A node is a distinct sequence of the first ``depth`` turns; its members begin with it, and ``conv_id``, its smallest
    member, and ``depth`` name it (and find its last turn). Conversations meet by blocks first: equal blocks after equal
    blocks are one row from there on. Only where blocks after the same blocks differ are their turns
    compared; elsewhere the turns of a block have the members of the block.

    Sums over a subtree need no walk of the tree. Each conversation owns the nodes it is smallest member of, the end
    of its path; so a node's subtree is what its members own, less what its own smallest member owns above it, and sums
    over members give ``n_leaves`` and ``saved_tokens``.

    Conversations without turns are members of the root. No ids give no rows.
    """
    ids = written(ids.distinct(), "ids")
    rows = written(blocks_of(turns, ids, block), "chains")
    size = F.size("marks")
    last = _id(F.col("carry"), F.col("marks"), size, F.col("after"), block)
    rows = rows.withColumn("last", last)
    blocks = rows.where(size > 0)
    one = lambda *cols: [F.first(c).alias(c) for c in cols]
    met = blocks.groupBy("last").agg(F.count("*").alias("n"), F.min("conv_id").alias("m"), *one("block", "carry", "after", "before", "marks", "words"))
    met = written(met, "block_nodes")
    # blocks that no other block stands beside
    lone = met.groupBy("carry").agg(F.count("*").alias("siblings"), F.min("last").alias("last")).where("siblings = 1").select("last")
    lone = written(lone, "lone_blocks")

    def refined(of: DataFrame, aggs: dict[str, Column]) -> DataFrame:
        """Nodes of the blocks ``of``; where blocks differ, turns they share are one node."""
        straight = _turn_rows(of.join(lone, "last", "left_semi"), block, list(aggs))
        forked = _turn_rows(of.join(lone, "last", "left_anti"), block, list(aggs))
        return straight.unionByName(forked.groupBy("id").agg(*one("parent", "depth", "words", "before"), *[a.alias(c) for c, a in aggs.items()]))

    nodes = written(refined(met, {"n": F.sum("n"), "m": F.min("m")}), "nodes")
    children = written(nodes.groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("n_children")), "children")
    leaf = nodes.join(children.select("id", F.lit(0).alias("leaf")), "id", "left").select("m", "words", F.coalesce("leaf", F.lit(1)).alias("leaf"))
    owned = leaf.groupBy(F.col("m").alias("conv_id")).agg(F.sum("words").alias("own"), F.sum("leaf").cast("long").alias("leaves"))
    total = blocks.groupBy("conv_id").agg(F.sum(_upto(F.col("words"), size)).alias("total"))
    per = written(ids.join(total, "conv_id", "left").join(owned, "conv_id", "left").na.fill(0, ["total", "own", "leaves"]), "conversations")

    sums = {"total": F.sum("total"), "own": F.sum("own"), "leaves": F.sum("leaves"), "least": F.min("least"), "n": F.sum("n")}
    member = F.struct("conv_id", "total", "own").alias("least")
    summed = blocks.select("conv_id", "last").join(per, "conv_id").select("last", "total", "own", "leaves", member, F.lit(1).cast("long").alias("n"))
    summed = summed.groupBy("last").agg(*[a.alias(c) for c, a in sums.items()])
    below = refined(met.drop("n", "m").join(summed, "last"), sums)
    root = per.select("total", "own", "leaves", member).agg(F.count("*").alias("n"), *[sums[c].alias(c) for c in sums if c != "n"]).where("n > 0")
    root = root.select(F.lit("").alias("id"), F.lit(None).cast("string").alias("parent"), *[F.lit(0).cast("long").alias(c) for c in ("depth", "words", "before")], *sums)
    every = written(below.unionByName(root), "summed")

    ends = _ends(rows.where("after IS NULL").select(F.col("last").alias("id"), "conv_id"))
    named = every.select(F.col("id").alias("parent"), F.col("least.conv_id").alias("parent_conv_id"))
    # the root itself may end no conversation, yet has leaves where it is one
    saved = F.col("total") - F.col("own") - F.col("n") * F.col("before") - (F.col("least.total") - F.col("least.own") - F.col("before"))
    return (
        every.join(named, "parent", "left")
        .join(children, "id", "left")
        .join(ends, "id", "left")
        .select(
            F.col("least.conv_id").alias("conv_id"),
            "depth",
            "parent_conv_id",
            F.col("n").alias("n_convs"),
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.when(F.col("n_children").isNull(), 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
            saved.alias("saved_tokens"),
            F.coalesce("ends_sha256", sha(F.lit(""))).alias("ends_sha256"),
        )
    )


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """Nodes of a trie over ``conversations`` as they are, each with ``role`` and ``text`` of its last turn; the root has none."""
    role, text = whole("role").alias("role"), whole("text").alias("text")
    mark = F.substring(sha(F.concat_ws(":", F.char_length(whole("role")).cast("string"), whole("role"), whole("text"))), 1, 32)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), mark.alias("mark"), role, text)
    placed = with_rank(rows, ["conv_id"], ["turn", "mark"], "pos").select("conv_id", F.col("pos").cast("long").alias("depth"), "role", "text")
    return nodes.join(placed, ["conv_id", "depth"], "left")


def digest(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (`rebuilt`); an empty table gives none.

    Null roles and texts are empty, null turns come first, repeated rows are turns of their own, rows without
    conv_id count nowhere. Texts of any length are digested where they are read. Other columns are not looked at.
    """
    return prefix_trie(*rebuilt(turns_of(conversations)), block)


ORACLE = r"""
WITH RECURSIVE own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, mark) AS pos, mark, words FROM (
    SELECT conv_id, turn, left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')), 32) AS mark,
           len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
    FROM conversations WHERE conv_id IS NOT NULL)),
crc AS (
  SELECT conv_id, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
           lambda c, e: xor(xor(c, e) >> 1, (xor(c, e) & 1) * 3988292384)), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
heads AS (SELECT c.conv_id, c.h, count(o.pos) AS n FROM crc c LEFT JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.pos <= c.h GROUP BY ALL),
turns AS (
  SELECT c.conv_id, o.pos, o.mark, o.words FROM crc c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.pos <= c.h
  UNION ALL SELECT o.conv_id, o.pos - h.h + h.n, o.mark, o.words FROM own o JOIN heads h USING (conv_id) WHERE o.pos > h.h),
paths AS (
  SELECT conv_id, pos AS depth, words, sha256(string_agg(mark, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS id FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM crc),
linked AS (SELECT *, lag(id) OVER (PARTITION BY conv_id ORDER BY depth) AS parent, lead(id) OVER (PARTITION BY conv_id ORDER BY depth) IS NULL AS ends FROM paths),
nodes AS (
  SELECT id, any_value(parent) AS parent, any_value(depth) AS depth, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM linked GROUP BY id),
kids AS (SELECT parent AS id, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY 1),
full_ AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (id)),
below AS (
  SELECT a.id, sum((u.n_convs - 1) * u.words) AS saved_tokens, count(*) FILTER (u.n_children = 0) AS n_leaves
  FROM full_ u JOIN linked a ON a.conv_id = u.conv_id AND a.depth <= u.depth GROUP BY a.id)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves, b.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_ f JOIN below b USING (id) LEFT JOIN nodes p ON p.id = f.parent
"""
