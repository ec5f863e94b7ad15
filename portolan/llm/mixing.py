"""Mixing sources to target weights: blocks of words, drawn per output shard and found by permuted indexes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from portolan.llm.common import whole
from portolan.operators.rank import with_rank
from portolan.session import RoundTable, written

WORD = "[^ \\t-\\r]+"
#: Words of a block, and blocks of an output shard.
BLOCK, SHARD = 1024, 1024
#: Weights of the sources in their order, repeating; no source is taken more often than `MOST` times.
WEIGHTS, MOST = (1, 2, 3), 3
#: Sources whose counts one draw divides, and shards that one task puts in order.
BUNDLE, CHUNK = 4096, 50_000
SEED = 11


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a pseudorandom permutation of ``0 .. n - 1``, one per ``key``, puts each index.

    Four Feistel rounds over the least even number of bits that holds ``n``; what falls outside goes round again.
    """
    x, n, key = (np.asarray(a).astype(np.int64).view(np.uint64).copy() for a in (index, n, key))
    bits = np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.uint64)
    half = (bits + np.uint64(1)) >> np.uint64(1)
    # log2 may round down close to a power of two
    half += (np.uint64(1) << (half + half)) < n
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo = np.flatnonzero(n > 1)
    x[n <= 1] = 0
    while len(todo):
        left, right, k, h, m = x[todo] >> half[todo], x[todo] & mask[todo], key[todo], half[todo], mask[todo]
        for step in range(1, 5):
            left, right = right, left ^ (_mixed(right + k * np.uint64(2 * step + 1) + np.uint64(step)) & m)
        x[todo] = (left << h) | right
        todo = todo[x[todo] >= n[todo]]
    return x.view(np.int64)


def _permute(index: Column, n: Column, *key) -> Column:
    # no result that later steps filter or join on may differ between attempts; this one is a function of its input
    call = F.pandas_udf(lambda i, n, k: pd.Series(permuted(i.to_numpy(), n.to_numpy(), k.to_numpy())), "long")
    return call(index.cast("long"), n.cast("long"), F.xxhash64(*[k if isinstance(k, Column) else F.lit(k) for k in key]))


def _before(df: DataFrame, key: str, chunk: str, order: list, value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its key before each, by ``chunk``, then ``order``.

    Chunks are summed first, so a key that holds many rows is put in order by many tasks.
    """
    sums = df.groupBy(key, chunk).agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(key).orderBy(chunk)
    starts = sums.select(key, chunk, (F.sum("_sum").over(w) - F.col("_sum")).alias("_start"))
    inside = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(starts, [key, chunk]).withColumn(name, F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_start")


def sources_of(rows: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """``source, no, source_size, weight, target, quota, blocks, rounds, rest, slots``, one row per source.

    ``rows`` holds ``source, size, n`` (n documents of that size). Sources are numbered from 0 by code point, null
    last. ``target`` shares all words by weight, but stops at ``most`` times the source's size, the excess going to the
    others by weight until none is above. A source of ``blocks`` blocks is taken whole ``rounds`` times and then
    ``rest`` words of it, in ``slots`` slots. Only sums over all sources reach the driver.
    """
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")).withColumn("all", F.lit(0))
    numbered = with_rank(sums, ["all"], [F.col("source").asc_nulls_last()], "no").withColumn("no", F.col("no").cast("long") - 1)
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("no") % len(weights)).cast("int"))
    sources = written(numbered.withColumn("weight", weight).drop("all"), "sources")
    cap = F.col("source_size") * F.lit(most)
    rate = None
    while True:
        full = F.lit(False) if rate is None else cap <= F.col("weight") * rate
        got = sources.agg(F.sum("source_size"), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        total, filled, left = (x or 0 for x in got)
        if not left or (total - filled) / left == rate:
            break
        rate = (total - filled) / left
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(float(rate or 0)))
    size, quota = F.col("source_size"), F.col("quota")
    # of a source without words nothing is taken
    per = lambda x: F.when(size > 0, x).otherwise(0).cast("long")
    out = sources.withColumn("target", target).withColumn("quota", F.least(F.round("target").cast("long"), cap))
    out = out.withColumns({"blocks": F.ceil(size / block).cast("long"), "rounds": per(F.floor(F.try_divide(quota, size))), "rest": per(F.try_mod(quota, size))})
    return written(out.withColumn("slots", F.col("rounds") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long")), "targets")


def _draws(sources: DataFrame, shard: int, seed: int) -> tuple[DataFrame, int]:
    """``shard, no, n``: a multinomial draw of the slots of every output shard, shares by ``slots``; and the slots in all.

    The draw first divides a shard over bundles of sources, then each bundle's part over its sources, which is a
    multinomial draw over all. The driver holds a number per bundle.
    """
    spark = sources.sparkSession
    bundles = sources.withColumn("bundle", F.floor(F.col("no") / BUNDLE)).groupBy("bundle").agg(F.sum("slots").alias("slots"), F.array_sort(F.collect_list(F.struct("no", "slots"))).alias("members"))
    bundles = written(bundles, "bundles")
    top = np.array(bundles.orderBy("bundle").select("slots").toPandas()["slots"], dtype=np.int64)
    total = int(top.sum())
    draws = "shard long, bundle long, n long"

    def first(frames):
        for frame in frames:
            out = []
            for k in frame["id"]:
                counts = np.random.Generator(np.random.Philox(key=[seed, k])).multinomial(min(shard, total - k * shard), top / total)
                at = np.flatnonzero(counts)
                out.append(pd.DataFrame({"shard": k, "bundle": at, "n": counts[at]}))
            yield pd.concat(out) if out else pd.DataFrame({"shard": [], "bundle": [], "n": []})

    def second(frames):
        for frame in frames:
            out = []
            for k, b, n, nos, slots in frame.itertuples(index=False, name=None):
                counts = np.random.Generator(np.random.Philox(key=[seed, k], counter=[0, 0, 0, b + 1])).multinomial(n, slots / slots.sum())
                at = np.flatnonzero(counts)
                out.append(pd.DataFrame({"shard": k, "no": np.asarray(nos)[at], "n": counts[at]}))
            yield pd.concat(out) if out else pd.DataFrame({"shard": [], "no": [], "n": []})

    shards = spark.range(-(-total // shard))
    by_bundle = shards.mapInPandas(first, draws).join(bundles.select("bundle", "members"), "bundle")
    drawn = by_bundle.select("shard", "bundle", "n", F.col("members.no").alias("nos"), F.col("members.slots").alias("slots")).mapInPandas(second, "shard long, no long, n long")
    return written(drawn, "draws"), total


def plan(sources: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """``shard, slot, no, block, words``: which block, or how many first words of it, each slot of each output shard holds.

    Every shard draws how many slots each source gets. A source's slots are numbered through all shards, and a
    pseudorandom permutation of its own puts the numbers in order; numbers beyond its ``slots`` pass to the sources
    that were drawn too seldom, so every source gets its slots exactly. Ordered number ``i`` is block
    ``i % blocks`` of round ``i // blocks``, the block index going through a permutation per round. So each
    round takes every block once, and no block is taken more often than there are rounds. The short last block comes last.
    """
    drawn, total = _draws(sources, shard, seed)
    drawn = drawn.withColumn("chunk", F.floor(F.col("shard") / CHUNK))
    offset = _before(drawn, "no", "chunk", ["shard"], F.col("n"), "offset").drop("chunk")
    got = offset.groupBy("no").agg(F.sum("n").alias("drawn"))
    shares = sources.join(got, "no", "left").na.fill(0, ["drawn"]).withColumns({"all": F.lit(0), "chunk": F.floor(F.col("no") / CHUNK)})
    over, under = F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("drawn"), F.lit(0))
    shares = _before(_before(shares, "all", "chunk", ["no"], over, "over_before"), "all", "chunk", ["no"], under, "under_before")
    shares = written(shares.drop("all", "chunk"), "shares")
    first = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = offset.withColumn("first", first).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    in_shard = F.least(F.lit(shard), F.lit(total) - F.col("shard") * shard)
    each = each.select("shard", (F.col("first") + F.col("i")).alias("slot"), in_shard.alias("in_shard"), "no", (F.col("offset") + F.col("i")).alias("number"))
    each = each.join(shares.select("no", "drawn", "slots", "over_before"), "no")
    each = each.select("shard", _permute(F.col("slot"), F.col("in_shard"), seed, "slot", F.col("shard")).alias("slot"), "no", _permute(F.col("number"), F.col("drawn"), seed, "number", F.col("no")).alias("number"), "slots", "over_before")
    each = written(each, "numbers")
    kept = each.where("number < slots").select("shard", "slot", "no", "number")
    # numbers over meet the sources that lack some in bins of ranks
    spare = each.where("number >= slots").select("shard", "slot", (F.col("over_before") + F.col("number") - F.col("slots")).alias("rank"))
    lacking = shares.where("slots > drawn").select("no", "drawn", F.col("under_before").alias("lo"), (F.col("under_before") + F.col("slots") - F.col("drawn")).alias("hi"))
    binned = lacking.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / CHUNK), F.floor((F.col("hi") - 1) / CHUNK))))
    passed = spare.withColumn("bin", F.floor(F.col("rank") / CHUNK)).join(binned, "bin").where("rank >= lo AND rank < hi").select("shard", "slot", "no", (F.col("drawn") + F.col("rank") - F.col("lo")).alias("number"))
    slots = kept.unionByName(passed).join(shares.select("no", "source_size", "blocks", "rounds", "rest"), "no")
    at, turn = F.col("at"), F.col("turn")
    slots = slots.withColumns({"turn": F.floor(F.col("number") / F.col("blocks")), "at": F.col("number") % F.col("blocks")})
    limit = F.when(turn < F.col("rounds"), F.col("source_size")).otherwise(F.col("rest"))
    even = F.floor(F.col("source_size") / block)
    found = _permute(F.least(at, F.greatest(even - 1, F.lit(0))), even, seed, "block", F.col("no"), turn)
    return written(
        slots.select("shard", "slot", "no", F.when(at < even, found).otherwise(at).alias("block"), F.least(F.lit(block), limit - at * block).cast("long").alias("words")), "plan"
    )


def packed(rows: DataFrame, count: int, sources: DataFrame, ids: list[str], block: int = BLOCK) -> DataFrame:
    """``rows`` (``source, size, n`` and the columns ``ids``, unique together) cut into blocks of their sources.

    A source's documents lie one after another, by a hash of ``ids``, then by ``ids``; ``n`` equal ones are one row until here.
    Gives ``no, start, ids.., block, at, until``: one row per document and block it touches, ``start`` naming the document within
    the source, ``at`` and ``until`` its words within the block. Of ``count`` rows about the square root makes a chunk that a task
    puts in order, and as many chunks are put in order after that.
    """
    numbered = rows.where("size > 0").join(sources.select(F.col("source").alias("of"), "no"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    chunked = numbered.withColumn("chunk", F.pmod(F.xxhash64(*ids), F.lit(int(count**0.5) + 1)))
    put = _before(chunked, "no", "chunk", ids, F.col("size") * F.col("n"), "first")
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    each = put.withColumn("copy", copy).withColumn("start", F.col("first") + F.col("copy") * F.col("size"))
    last = F.col("start") + F.col("size") - 1
    cut = each.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(last / block))))
    base = F.col("block") * block
    return cut.select("no", "start", *ids, "block", F.greatest(F.col("start") - base, F.lit(0)).alias("at"), F.least(F.col("start") + F.col("size") - base, F.lit(block)).alias("until"))


def _sized(docs: DataFrame, *more: Column) -> RoundTable:
    """``source, doc_id, size, .., n``: rows of the same words count counted, not repeated."""
    size = F.regexp_count(whole(), F.lit(WORD)).cast("long")
    table = RoundTable(docs.sparkSession, "sizes")
    table.add(docs.select("source", "doc_id", size.alias("size"), *more).groupBy("source", "doc_id", "size", *[f"_{i}" for i in range(len(more))]).agg(F.count("*").alias("n")))
    return table


def mixture(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """``shard, slot, source, words, text``: the mix itself, one row per block, its words space-joined.

    Rules as in `digest`. A block holds the words of at most ``block`` documents.
    """
    mark = F.xxhash64(whole()).alias("_0")
    table = _sized(docs, mark)
    rows = table.all()
    sources = sources_of(rows, weights, most, block)
    pieces = packed(rows, table.rows, sources, ["doc_id", "size", "_0"], block)
    texts = docs.select(F.col("source").alias("_source"), F.col("doc_id").alias("_id"), mark.alias("_mark"), F.filter(F.split(whole(), "[ \\t-\\r]+"), lambda w: w != "").alias("_words")).dropDuplicates(["_source", "_id", "_mark"])
    named = pieces.join(sources.select("no", "source"), "no")
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_0") == F.col("_mark"))
    skip = F.col("block") * block + F.col("at") - F.col("start")
    words = F.slice("_words", skip.cast("int") + 1, (F.col("until") - F.col("at")).cast("int"))
    filled = named.join(texts, same).groupBy("no", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", words.alias("w")))), lambda p: p["w"])).alias("all"))
    chosen = plan(sources, block, shard, seed).join(filled, ["no", "block"]).join(sources.select("no", "source"), "no")
    return chosen.select("shard", "slot", "source", "words", F.array_join(F.slice("all", F.lit(1), F.col("words").cast("int")), " ").alias("text"))


def digest(docs: DataFrame, weights: tuple = WEIGHTS, most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken``, one row per row of ``docs``: the words the mix takes of each.

    Each source's ``taken`` add up to its target, rounded; no document is taken more often than ``most`` times. A null
    text has no words; null sources are one source, the last; null and repeated ids are documents like any other,
    of any length. An empty table gives no rows. The same rows give the same mix. Other columns are not looked at.
    """
    table = _sized(docs)
    rows = table.all()
    sources = sources_of(rows, weights, most, block)
    pieces = packed(rows, table.rows, sources, ["doc_id", "size"], block)
    # blocks that no slot holds have no words here, which `least` would pass over
    took = F.when(F.col("words").isNotNull(), F.greatest(F.lit(0), F.least(F.col("words"), F.col("until")) - F.col("at"))).otherwise(0)
    met = pieces.join(plan(sources, block, shard, seed).select("no", "block", "words"), ["no", "block"], "left")
    full = met.groupBy("no", "start", "doc_id", "size").agg(F.sum(took).cast("long").alias("taken")).drop("start")
    none = rows.where("size = 0").join(sources.select(F.col("source").alias("of"), "no"), F.col("source").eqNullSafe(F.col("of")))
    none = none.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("no", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    return full.unionByName(none).join(sources.select("no", "source_size", "target"), "no").select("doc_id", "size", "source_size", "target", "taken")
