"""Repeated byte strings: a distributed merge sort of sampled suffixes that compares no known prefix twice."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import row_key, whole
from portolan.session import written

#: Bytes of a string that must not repeat, and of the grams that suffixes are sampled by.
SPAN, GRAM = 200, 64
#: Grams in a window of `SPAN` bytes.
WINDOW = SPAN - GRAM + 1
#: Bits of the map of repeated grams: 16 MiB at most, however large the input is.
MAP_BITS = 1 << 27
#: Bytes looked at in one go; positions in them take 20 bits.
BUFFER = (1 << 20) - SPAN
#: Sampled suffixes that a task sorts into one run, and that one bucket of the merge is meant to get.
RUN, BUCKET = 1 << 18, 1 << 17
#: Suffixes of one gram that one task compares; more meet by the hash of every string instead.
GROUP = 1 << 18

BASE = 0x9E3779B97F4A7C15


def _powers(base: int) -> np.ndarray:
    out = np.full(BUFFER + SPAN + 1, base % (1 << 64), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS, INVERSE = _powers(BASE), _powers(pow(BASE, -1, 1 << 64))
PLACE = np.uint64((1 << 20) - 1)


def anchors(data: np.ndarray, whole_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``gram, low, high, hash``: runs of strings of `SPAN` bytes with the same sampled gram.

    The sampled gram of a string is its leftmost one of least hash, so equal strings sample the same
    gram at the same place. ``whole_`` tells at which starts a string counts. A run has the strings
    that start from ``low`` to ``high``.
    """
    n = len(data) - GRAM + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * POWERS[: len(data)], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * INVERSE[:n]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    least, size = (h & ~PLACE) | np.arange(n, dtype=np.uint64), 1
    while size * 2 <= WINDOW:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    if size < WINDOW:
        least = np.minimum(least[: len(least) - (WINDOW - size)], least[WINDOW - size :])
    at = np.where(whole_, (least & PLACE).astype(np.int64), -1)
    low = np.flatnonzero(np.diff(at, prepend=-2))
    high = np.append(low[1:], len(at)) - 1
    real = at[low] >= 0
    low, high = low[real], high[real]
    return at[low], low, high, h[at[low]]


def buffers(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """Texts laid end to end in buffers of bounded size: the bytes, where a string may start, and
    ``(text, place in the buffer, place in the text)`` of every piece. A long text comes in pieces that
    overlap by one byte less than a string."""
    parts: list[bytes] = []
    index: list[tuple[int, int, int]] = []
    size = 0

    def flush():
        data = np.frombuffer(b"".join(parts), np.uint8)
        ok = np.zeros(len(data) - SPAN + 1, bool)
        for (_, at, _), p in zip(index, parts, strict=True):
            ok[at : at + len(p) - SPAN + 1] = True
        return data, ok, index

    for i, text in enumerate(texts):
        for at in range(0, len(text) - SPAN + 1, BUFFER - SPAN):
            piece = text[at : at + BUFFER - 1]
            if size + len(piece) > BUFFER and parts:
                yield flush()
                parts, index, size = [], [], 0
            parts.append(piece)
            index.append((i, size, at))
            size += len(piece)
    if parts:
        yield flush()


def _grams(docs: DataFrame) -> DataFrame:
    """The hash of the sampled gram of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, ok, _ in buffers(batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(anchors(data, ok)[3].view(np.int64))], ["h"])

    return docs.select(whole().cast("binary").alias("t")).mapInArrow(run, "h long")


def _bit_map(keys: DataFrame, place) -> np.ndarray:
    """A bit map of the places that ``keys`` have, of `MAP_BITS` however many there are."""
    rows = keys.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    out = np.zeros(MAP_BITS // 8, np.uint8)
    # at most MAP_BITS / 32768 rows of 4 KiB
    for r in rows.toLocalIterator():
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def _map_of(grams: DataFrame) -> np.ndarray:
    """A bit map of the grams that occur more than once, by the upper bits of their hash."""
    twice = grams.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    return _bit_map(twice, F.shiftrightunsigned("h", 37))


def common(a: bytes, b: bytes, at: int) -> int:
    """The length of the common prefix, which is known up to ``at``."""
    n = min(len(a), len(b))
    step = 16
    while at < n and a[at : at + step] == b[at : at + step]:
        at += step
    if at >= n:
        return n
    while at < n and a[at] == b[at]:
        at += 1
    return at


def front_coded(strings: list[bytes]) -> tuple[list[int], bytes, list[int]]:
    """Of sorted strings: the prefix shared with the one before, the rests end to end, and their lengths."""
    shared, rests, last = [], [], b""
    for s in strings:
        n = common(last, s, 0)
        shared.append(n)
        rests.append(s[n:])
        last = s
    return shared, b"".join(rests), [len(r) for r in rests]


class Run:
    """A sorted run read from its front coding; ``head`` is the next string, ``shared`` what it shares with the last."""

    def __init__(self, shared: np.ndarray, rests: bytes, sizes: np.ndarray):
        self.all_shared, self.rests, self.sizes = shared.tolist(), rests, sizes.tolist()
        self.next = self.at = self.shared = 0
        self.head: bytes | None = b""
        self.advance()

    def advance(self) -> None:
        i = self.next
        if i == len(self.sizes):
            self.head = None
            return
        self.shared = self.all_shared[i]
        end = self.at + self.sizes[i]
        self.head = self.head[: self.shared] + self.rests[self.at : end]
        self.at = end
        self.next = i + 1


def merge(runs: list[Run]) -> Iterator[tuple[int, int, int, bytes]]:
    """``run, place, shared, string`` of all strings in order; ``shared`` is the prefix shared with the one before.

    A loser tree in which every run knows how much its head shares with the last winner. Of two heads the
    one that shares more is the smaller; only if they share as much are they compared, from there on.
    """
    n = 1
    while n < len(runs):
        n *= 2
    heads = [r.head for r in runs] + [None] * (n - len(runs))
    shared = [0] * n
    losers = [0] * n

    def play(a: int, b: int) -> tuple[int, int]:
        if heads[b] is None:
            return a, b
        if heads[a] is None:
            return b, a
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = heads[a], heads[b]
        h = common(x, y, shared[a])
        if h == len(x) or (h < len(y) and x[h] < y[h]):
            shared[b] = h
            return a, b
        shared[a] = h
        return b, a

    winners = [*([0] * n), *range(n)]
    for i in range(n - 1, 0, -1):
        winners[i], losers[i] = play(winners[2 * i], winners[2 * i + 1])
    top = winners[1]
    while heads[top] is not None:
        run = runs[top]
        yield top, run.next - 1, shared[top], heads[top]
        run.advance()
        heads[top] = run.head
        shared[top] = run.shared
        i = (top + n) // 2
        while i:
            top, losers[i] = play(top, losers[i])
            i //= 2


def prefixes(strings: list[bytes]) -> np.ndarray:
    """What each of sorted strings shares with the one before, in one pass over a matrix."""
    if not strings:
        return np.zeros(0, np.int64)
    sizes = np.array([len(s) for s in strings])
    width = max(1, int(sizes.max()))
    rows = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width)
    out = np.zeros(len(strings), np.int64)
    same = rows[1:] == rows[:-1]
    first = np.where(same.all(1), width, same.argmin(1))
    out[1:] = np.minimum(first, np.minimum(sizes[1:], sizes[:-1]))
    return out


def repeated(right: np.ndarray, left: list[bytes], low: np.ndarray, high: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which strings occur again: a row per suffix, a column per offset of the gram in the string.

    ``right``: what each suffix, in sorted order, shares with the one before; ``left``: the bytes before
    the gram, backwards. The string at offset ``o`` has ``o`` bytes of the one and ``SPAN - o`` of the
    other, so it occurs again where both agree with those of another suffix. ``low`` to ``high`` are the
    offsets a suffix stands for, ``many`` tells that it occurs more than once by itself.
    """
    n = len(right)
    group = np.cumsum(right < GRAM)
    order = sorted(range(n), key=lambda i: (group[i], left[i]))
    order = np.array(order, np.int64)
    l = prefixes([left[i] for i in order])
    l[np.diff(group[order], prepend=-1) != 0] = -1
    out = np.zeros((n, WINDOW), bool)
    for o in range(int(low.min()), int(high.max()) + 1):
        on = np.flatnonzero((low <= o) & (o <= high))
        r_class = np.cumsum(right < SPAN - o)[on]
        l_class = np.empty(n, np.int64)
        l_class[order] = np.cumsum(l < o)
        key = r_class * (n + 1) + l_class[on]
        by = np.argsort(key, kind="stable")
        twin = key[by][1:] == key[by][:-1]
        hit = many[on]
        hit[by[1:][twin]] = True
        hit[by[:-1][twin]] = True
        out[on[hit], o] = True
    return out


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, first, last`` of every run of set columns."""
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, after = np.nonzero(edge == -1)
    return row, first, after - 1


def identity(left: bytes, right: bytes) -> bytes:
    """16 bytes that stand for a suffix and the bytes before it."""
    return hashlib.blake2b(left + right, digest_size=15, key=bytes([len(left)])).digest() + bytes([len(left)])


def _marked(texts: list[bytes], marks: np.ndarray) -> Iterator[tuple[bytes, list, Iterator[tuple[int, int, int, int, int]]]]:
    """Of every buffer: its bytes, its index, and ``piece, gram, low, high, hash`` of the runs whose gram is in the map."""
    for data, ok, index in buffers(texts):
        gram, low, high, h = anchors(data, ok)
        place = (h >> np.uint64(37)).astype(np.int64)
        on = (marks[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
        gram, low, high, h = gram[on], low[on], high[on], h[on]
        owner = np.searchsorted(np.array([at for _, at, _ in index]), low, "right") - 1
        yield data.tobytes(), index, zip(owner.tolist(), gram.tolist(), low.tolist(), high.tolist(), (h & np.uint64(0xFFFFFFFF)).tolist(), strict=True)


def _places(docs: DataFrame, bits, known) -> DataFrame:
    """``row, ids, grams``: per text the identities of its suffixes, 16 bytes each, and where their grams are.

    Only identities in the map ``known`` of those found are named, and the few that share a bit with one by chance.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, hits = bits.value, known.value
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for raw, index, found in _marked(texts, marks):
                mine: dict[int, tuple[list, list]] = {}
                for o, g, a, z, _ in found:
                    text, start, base = index[o]
                    name = identity(raw[a:g][::-1], raw[g : z + SPAN])
                    place = int.from_bytes(name[:4], "big") >> 5
                    if hits[place >> 3] >> (place & 7) & 1:
                        ids, grams = mine.setdefault(text, ([], []))
                        ids.append(name)
                        grams.append(base + g - start)
                if mine:
                    rows = [(keys[t], b"".join(i), g) for t, (i, g) in mine.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.list_(pa.int32())), strict=True)], ["row", "ids", "grams"])

    source = docs.select(row_key(F.col("doc_id"), whole()).alias("row"), whole().cast("binary").alias("t"))
    return source.mapInArrow(run, "row string, ids binary, grams array<int>")


def write_run(items: list[tuple[bytes, bytes, int]]) -> bytes:
    """Sorted ``(suffix, bytes before it, how often)``, front-coded and packed."""
    shared, rests, sizes = front_coded([r for r, _, _ in items])
    lefts = [l for _, l, _ in items]
    arrays = [np.array(x, np.uint8).tobytes() for x in (shared, sizes, [len(l) for l in lefts], [min(n, 2) for *_, n in items])]
    return zstandard.ZstdCompressor(level=3).compress(b"".join([np.array([len(items), len(rests)], np.int64).tobytes(), *arrays, rests, *lefts]))


def _runs(docs: DataFrame, bits, buckets: int) -> DataFrame:
    """``bucket, run``: every task's suffixes as sorted runs, equal ones once, cut by the bucket of their gram."""

    def flushed(seen: dict[tuple[int, bytes, bytes], int]) -> Iterator[pa.RecordBatch]:
        rows = [(bucket, write_run([(r, l, n) for (_, r, l), n in own])) for bucket, own in groupby(sorted(seen.items()), lambda x: x[0][0])]
        seen.clear()
        for at in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[at : at + 64], strict=True), (pa.int64(), pa.binary()), strict=True)], ["bucket", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = bits.value
        seen: dict[tuple[int, bytes, bytes], int] = {}
        for batch in batches:
            for raw, _, found in _marked(batch.column(0).to_pylist(), marks):
                for _, g, a, z, h in found:
                    key = (h % buckets, raw[g : z + SPAN], raw[a:g][::-1])
                    seen[key] = seen.get(key, 0) + 1
                if len(seen) >= RUN:
                    yield from flushed(seen)
        yield from flushed(seen)

    return docs.select(whole().cast("binary").alias("t")).mapInArrow(run, "bucket long, run binary")


def read_run(blob: bytes) -> tuple[Run, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """A run and, per suffix: the bytes before it, the least and greatest offset, and how often it came (2: more)."""
    blob = zstandard.ZstdDecompressor().decompress(blob)
    n, size = np.frombuffer(blob, np.int64, 2).tolist()
    shared, sizes, lefts, many = (np.frombuffer(blob, np.uint8, n, 16 + i * n).astype(np.int64) for i in range(4))
    at = 16 + 4 * n
    ends = at + size + np.cumsum(lefts)
    left = [blob[e - k : e] for e, k in zip(ends.tolist(), lefts.tolist(), strict=True)]
    return Run(shared, blob[at : at + size], sizes), left, SPAN - (shared + sizes), lefts, many


def _merged(runs: DataFrame, group: int) -> DataFrame:
    """``id, first, last``: the offsets at which the strings around a suffix occur again; of grams with more than
    ``group`` suffixes instead the suffixes themselves, as ``id, text, low, high, many``."""
    schema = pa.schema([("id", pa.binary()), ("first", pa.int32()), ("last", pa.int32()), ("text", pa.binary()), ("low", pa.int32()), ("high", pa.int32()), ("many", pa.int32())])

    def bucket_rows(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        read = [read_run(b) for b in blobs]
        held: list[tuple[int, int, int, bytes]] = []
        for item in merge([r[0] for r in read]):
            # a gram's suffixes share at least the gram
            if item[2] < GRAM and len(held) >= BUCKET:
                yield from resolve(read, held)
                held = []
            held.append(item)
        yield from resolve(read, held)

    def batch_of(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def resolve(read: list, held: list[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        right = np.array([h[2] for h in held])
        right[0] = 0
        left = [read[r][1][p] for r, p, _, _ in held]
        low, high, many = (np.array([read[r][k][p] for r, p, _, _ in held]) for k in (2, 3, 4))
        size = np.diff(np.append(np.flatnonzero(right < GRAM), len(right)))
        sizes = np.repeat(size, size)
        keep = np.flatnonzero(((sizes > 1) | (many > 1)) & (sizes <= group))
        if len(keep):
            row, first, last = runs_of(repeated(right[keep], [left[i] for i in keep.tolist()], low[keep], high[keep], many[keep] > 1))
            ids = [identity(left[i], held[i][3]) for i in keep[row].tolist()]
            nulls = [None] * len(ids)
            yield batch_of([ids, first, last, nulls, nulls, nulls, nulls])
        crowd = np.flatnonzero(sizes > group).tolist()
        for at in range(0, len(crowd), 4096):
            some = crowd[at : at + 4096]
            nulls = [None] * len(some)
            texts = [left[i][::-1] + held[i][3] for i in some]
            yield batch_of([[identity(left[i], held[i][3]) for i in some], nulls, nulls, texts, low[some], high[some], many[some]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != now and blobs:
                    yield from bucket_rows(blobs)
                    blobs = []
                now = b
                blobs.append(x)
        if blobs:
            yield from bucket_rows(blobs)

    return runs.mapInArrow(run, "id binary, first int, last int, text binary, low int, high int, many int")


def _by_hash(crowd: DataFrame) -> DataFrame:
    """``id, first, last`` for suffixes of crowded grams: every string by itself, found again by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                offsets = list(range(r["low"], r["high"] + 1))
                hashes = [hashlib.blake2b(r["text"][r["high"] - o : r["high"] - o + SPAN], digest_size=16).digest() for o in offsets]
                k = len(offsets)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((([r["id"]] * k), pa.binary()), (offsets, pa.int32()), (hashes, pa.binary()), ([r["many"]] * k, pa.int32()))], ["id", "first", "hash", "many"])

    strings = crowd.select("id", "text", "low", "high", "many").mapInArrow(run, "id binary, first int, hash binary, many int")
    again = strings.groupBy("hash").agg(F.sum("many").alias("n")).where("n > 1").select("hash")
    return strings.join(again, "hash", "left_semi").select("id", "first", F.col("first").alias("last"))


def repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """``row, spans``: the maximal byte ranges, ``array<struct<start, end>>``, covered by strings of `SPAN` bytes that
    start again somewhere else; one row per distinct row of ``docs`` that has some.

    1. Every string samples one of its grams (`anchors`), and runs of strings share one; a first pass counts
       the grams, and a bit map of fixed size tells which may repeat.
    2. A second pass takes the suffixes from those grams on, with the bytes before them. Each task sorts its own
       into runs, equal ones once, and sends them front-coded and packed to the bucket of their gram.
    3. Each bucket merges its runs by a loser tree that goes by shared prefixes. Suffixes of a gram then stand
       together, and what they share on both sides tells which strings repeat (`repeated`).
    4. A third pass names the suffixes of every text by hash; those that a bit map of the found ones lets through
       get their offsets back, and ranges are joined.

    A gram with more than ``group`` different surroundings does not go through one task: its strings meet by hash.
    """
    spark = docs.sparkSession
    grams = _grams(docs)
    bits = spark.sparkContext.broadcast(_map_of(grams))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism) * 8
    runs = _runs(docs, bits, buckets).repartition("bucket").sortWithinPartitions("bucket")
    found = written(_merged(runs, group), "repeated")
    plain = found.where("text IS NULL").select("id", "first", "last")
    crowd = found.where("text IS NOT NULL")
    if not crowd.isEmpty():
        plain = plain.unionByName(_by_hash(crowd))
    # an id is 16 bytes; suffixes equal in two tasks have one id and the same offsets
    # written, so that the join below has shuffles of its own, which adaptive execution splits where one id is in most texts
    per = written(plain.groupBy("id").agg(F.collect_set(F.struct("first", "last")).alias("offsets")), "offsets")
    # the same 27 bits as in `_places`
    named = F.shiftright(F.conv(F.hex(F.expr("substring(id, 1, 4)")), 16, 10).cast("long"), 5)
    known = spark.sparkContext.broadcast(_bit_map(per, named))
    places = _places(docs, bits, known).select("row", F.posexplode("grams").alias("i", "gram"), "ids").select(
        "row", F.expr("substring(ids, i * 16 + 1, 16)").alias("id"), "gram"
    )
    hit = places.join(per, "id").select("row", "gram", F.explode("offsets").alias("o"))
    spans = hit.select("row", (F.col("gram") - F.col("o.last")).alias("start"), (F.col("gram") - F.col("o.first") + SPAN).alias("end"))
    return spans.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("raw")).select("row", _joined("raw").alias("spans"))


def _joined(raw: str):
    """Sorted ranges, with those that overlap or touch joined."""
    kind = "struct<start:int,end:int>"
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("open"))

    def step(acc, s):
        now = acc["open"]
        grown = F.struct(now["start"].alias("start"), F.greatest(now["end"], s["end"]).alias("end")).cast(kind)
        new = F.struct(acc["done"].alias("done"), grown.alias("open"))
        shut = F.struct(F.when(now.isNull(), acc["done"]).otherwise(F.array_append(acc["done"], now)).alias("done"), s.cast(kind).alias("open"))
        return F.when(now.isNotNull() & (s["start"] <= now["end"]), new).otherwise(shut)

    return F.aggregate(raw, start, step, lambda acc: F.array_append(acc["done"], acc["open"]))


def without_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, spans, kept``: the ranges removed and the bytes that remain.

    Texts count as UTF-8 bytes, null as empty, and strings never cross texts. All occurrences of a repeated
    string go, the first one too, and all are judged on the input. Repeated rows repeat each other.
    Null ids stay; other columns are not looked at.
    """
    kind = "array<struct<start:int,end:int>>"
    doc_kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", row_key(F.col("doc_id"), whole()).alias("row"), whole().cast("binary").alias("t"))
    found = written(repeats(docs), "spans")
    # a bit map of rows with ranges: no other text is shuffled
    place = F.shiftrightunsigned(F.xxhash64("row"), 37)
    bits = found.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bit = F.bitmap_bit_position(place + 1)
    byte = F.conv(F.hex(F.substring("bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int"))) != 0
    marked = source.withColumn("bucket", F.bitmap_bucket_number(place + 1)).join(F.broadcast(bits), "bucket", "left").withColumn("maybe", F.coalesce(set_, F.lit(False)))
    none = F.array().cast(kind)
    joined = marked.where("maybe").select("doc_id", "row", "t").join(found, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"), "t")
    joined = joined.unionByName(marked.where("NOT maybe").select("doc_id", none.alias("spans"), "t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for spans, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                edges = [0, *[x for s in spans for x in (s["start"], s["end"])], len(t)]
                kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if spans else t)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(kept, pa.binary())], ["doc_id", "spans", "kept"])

    return joined.mapInArrow(run, f"doc_id {doc_kind}, spans {kind}, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """Sizes and the hash of what remains, one row per row of ``docs``."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return without_repeats(docs).select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


ORACLE = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, md5(b[i + 1:i + {SPAN}]) AS k FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - {SPAN - 1})) AS i FROM d WHERE octet_length(b) >= {SPAN})),
r AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
s AS (SELECT *, i > coalesce(max(i + {SPAN}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS opens FROM r),
g AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM s),
p AS (SELECT doc_id, n, min(i) AS a, max(i) + {SPAN} AS z FROM g GROUP BY doc_id, n),
e AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS last, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS next FROM p),
k AS (SELECT doc_id, sum(z - a) AS gone, count(*) AS n, string_agg(hex(b[last + 1:a]) || CASE WHEN next IS NULL THEN hex(b[z + 1:octet_length(b)]) ELSE '' END, '' ORDER BY a) AS rest FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(CASE WHEN rest IS NULL THEN b ELSE unhex(rest) END) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
