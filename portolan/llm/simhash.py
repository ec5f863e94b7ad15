"""SimHash near-duplicates, candidates pruned by chains of segments (pigeonring)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import SPACE, ascii_lower, fresh, row_key, whole
from portolan.operators.graph import components
from portolan.session import written

#: Words of a shingle, differing bits that still link, segments of a fingerprint.
SHINGLE, DISTANCE, SEGMENTS = 3, 3, 4
#: Fingerprints of one key that one task compares; a key with more is cut into blocks.
BLOCK = 4096
SEGMENT_MASKS = [np.uint64(0xFFFF << 16 * i) for i in range(SEGMENTS)]


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """XXH64 (seed 42) of every shingle of ``size`` words, repeats included.

    Fewer words make one shingle of all, no words none.
    """
    words = F.filter(F.split(ascii_lower(text), SPACE), lambda w: w != "")

    def hashes(ws):
        whole_ = F.array(F.xxhash64(F.array_join(ws, " ")))
        each = F.transform(F.sequence(F.lit(0), F.size(ws) - size), lambda i: F.xxhash64(F.concat_ws(" ", *[F.get(ws, i + j) for j in range(size)])))
        return F.when(F.size(ws) >= size, each).when(F.size(ws) > 0, whole_).otherwise(F.array().cast("array<long>"))

    # bound once, so the split does not run for every use
    return F.element_at(F.transform(F.array(words), hashes), 1)


def _bits(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of hashes the number whose bits, sized over half the run, are set."""
    counts = np.zeros((len(sizes), 64), np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(values), 1 << 16):
        part, own = values[at : at + (1 << 16)], owner[at : at + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.diff(own, prepend=-1))
        counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    set_ = counts * 2 > sizes[:, None]
    return np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``row, doc_id, fingerprint`` (the 64 bits as a signed long), one row per row of ``docs``."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select(row_key(F.col("doc_id"), whole()).alias("row"), "doc_id", shingle_hashes(whole(), size).alias("hashes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            prints = pa.array(_bits(values, sizes).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), prints], ["row", "doc_id", "fingerprint"])

    return source.mapInArrow(run, f"row string, doc_id {kind}, fingerprint long")


def _keys(fingerprint: Column) -> Column:
    """The keys two fingerprints within `DISTANCE` share at least one of.

    If two differ in at most 3 bits over a ring of 4 segments, then some segment starts a chain in
    which the first ``n`` segments differ in at most ``3 n / 4`` bits, for every ``n``: 0, 1, 2, 3. So from
    there one segment agrees and the next differs in a bit at most, that is in one of its quarters at
    most. A key is a start, its segment, and the next segment without one quarter: 28 bits that agree.
    """
    at = lambda i: F.shiftrightunsigned(fingerprint, 16 * (i % SEGMENTS)).bitwiseAND(F.lit(0xFFFF))
    return F.array(
        *[
            F.lit((i * 4 + q) << 32) + F.shiftleft(at(i), 16) + at(i + 1).bitwiseAND(F.lit(0xFFFF & ~(0xF << 4 * q)))
            for i in range(SEGMENTS)
            for q in range(4)
        ]
    )


def _linked(prints: np.ndarray, left: np.ndarray, right: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose chain from their start stays within its budgets, and with it the whole distance."""
    masks = np.array(SEGMENT_MASKS)
    differ = prints[left] ^ prints[right]
    seen = masks[starts]
    for n in range(1, SEGMENTS + 1):
        ok = np.bitwise_count(differ & seen) <= DISTANCE * n // SEGMENTS
        left, right, differ, starts, seen = left[ok], right[ok], differ[ok], starts[ok], seen[ok]
        seen = seen | masks[(starts + n) % SEGMENTS]
    return left, right


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index each of ``n`` nodes is joined to by the pairs."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _compare(keys: np.ndarray, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a forest over the links between fingerprints of equal key; rows sorted by key."""
    starts = (keys >> np.int64(34)).astype(np.int64)
    same = np.flatnonzero(keys[1:] == keys[:-1])
    lefts, rights, held = [], [], 0
    step, left = 1, same
    while len(left):
        a, b = _linked(prints, left, left + step, starts[left])
        lefts.append(a), rights.append(b)
        held += len(a)
        if held > 1 << 20:  # fold the links found so far into their forest
            label = _forest(len(prints), np.concatenate(lefts), np.concatenate(rights))
            node = np.flatnonzero(label != np.arange(len(label)))
            lefts, rights, held = [label[node]], [node], 0
        step += 1
        left = left[left + step < len(keys)]
        left = left[keys[left + step] == keys[left]]
    if lefts:
        label = _forest(len(prints), np.concatenate(lefts), np.concatenate(rights))
        node = np.flatnonzero(label != np.arange(len(label)))
        yield prints[node], prints[label[node]]


def _edges(keyed: DataFrame, most: int) -> DataFrame:
    """``src, dst, key, fp`` over rows ``key, fp`` partitioned and sorted by key.

    Links come as ``src, dst``; a key with over ``most`` fingerprints is handed back as its rows.
    """
    names = ["src", "dst", "key", "fp"]
    nulls = lambda n: pa.nulls(n, pa.int64())
    batch_of = lambda *columns: pa.RecordBatch.from_arrays(list(columns), names)

    def done(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        sizes = np.diff(np.append(first, len(keys)))
        big = np.repeat(sizes > most, sizes)
        if big.any():
            k, f = keys[big], prints[big].view(np.int64)
            yield batch_of(nulls(len(k)), nulls(len(k)), pa.array(k), pa.array(f))
        for a, b in _compare(keys[~big], prints[~big]):
            yield batch_of(pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), nulls(len(a)), nulls(len(a)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            prints = np.concatenate([prints, batch.column(1).to_numpy().view(np.uint64)])
            last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            if last:
                yield from done(keys[:last], prints[:last])
                keys, prints = keys[last:], prints[last:]
        if len(keys):
            yield from done(keys, prints)

    return keyed.mapInArrow(run, "src long, dst long, key long, fp long")


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """``src, dst``: edges that join the fingerprints of ``prints`` (column ``fingerprint``) as their links do.

    Two distinct fingerprints are linked when they differ in at most `DISTANCE` bits. Only pairs that
    share a key of `_keys` and pass the chain of segments are compared in full, and per key
    only a forest over its links is handed on. A key of more than ``block`` fingerprints is cut into
    blocks; every two blocks meet in a task of their own.
    """
    spread = prints.select(F.explode(_keys(F.col("fingerprint"))).alias("key"), F.col("fingerprint").alias("fp"))
    found = written(_edges(spread.repartition("key").sortWithinPartitions("key", "fp"), block), "links")
    near = found.where("src IS NOT NULL").select("src", "dst")
    crowded = found.where("key IS NOT NULL").select("key", "fp")
    sizes = crowded.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    if sizes.isEmpty():
        return near
    # two blocks meet under the start of their key and a hash; what shares a hash by chance is only compared in vain
    cut = crowded.join(sizes, "key").withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    pairs = cut.select("key", "fp", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.lit(1).cast("long")), lambda j: F.struct(F.least("b", j).alias("lo"), F.greatest("b", j).alias("hi")))).alias("p"))
    start = F.shiftleft(F.shiftright("key", 34), 34)
    group = start + F.pmod(F.xxhash64("key", "p.lo", "p.hi"), F.lit(1 << 34))
    far = _edges(pairs.select(group.alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp"), 1 << 30)
    return near.unionByName(written(far.where("src IS NOT NULL").select("src", "dst"), "far_links"))


def near_copies(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``row, doc_id, fingerprint, component_id, best_row``, one row per row of ``docs``.

    Words are runs of other characters than white space, A-Z lower-cased; a bit of the fingerprint is set
    if over half of the shingle hashes have it. Null and empty texts have fingerprint zero, linked like
    any other. ``component_id`` is the smallest doc_id that can be reached over links; null ids are
    never smallest, and the component of null ids alone is null. ``best_row`` names the row to keep:
    that of the smallest id, ties by text. Repeated rows stay repeated. Equal fingerprints are
    compared once, whatever their number.
    """
    rows = written(fingerprints(docs, size), "fingerprints")
    least = lambda c: F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias(c)
    prints = written(rows.groupBy("fingerprint").agg(least("least")), "prints")
    edges = written(links(prints), "edges")
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    part = written(components(nodes, edges), "components")
    of = prints.join(part, prints["fingerprint"] == part["node"], "left").select("fingerprint", F.coalesce("component", "fingerprint").alias("component"), "least")
    best = of.groupBy("component").agg(F.min("least").alias("best"))
    # singletons keep their own row: only linked ones meet, so no component is gathered
    named = of.join(best, "component").select("fingerprint", "best")
    return rows.join(named, "fingerprint", "left").select(
        "row", "doc_id", "fingerprint", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("best_row")
    )


def drop_near_copies(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``docs`` with one row of each group of near copies, that of the smallest doc_id."""
    key = fresh("near_key", docs)
    gone = near_copies(docs, size).where("row <> best_row").select(F.col("row").alias(key)).distinct()
    keyed = docs.withColumn(key, row_key(F.col("doc_id"), whole()))
    return keyed.join(gone.hint("merge"), key, "left_anti").dropDuplicates([key]).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """Fingerprint in hex and component, one row per row of ``docs``."""
    return near_copies(docs).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
