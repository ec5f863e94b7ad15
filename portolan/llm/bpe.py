"""Byte-level BPE: encoding by numpy matrices of pieces, and decoding."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.llm.common import fresh, whole

#: No merge: greater than any rank.
NONE = np.int32(2**31 - 1)
#: Pieces a worker remembers before it starts anew.
MEMORY = 200_000
#: Rows whose ids leave a task together, and the bytes of text after which they leave sooner.
ROWS, BYTES = 256, 4_000_000
#: Longer pieces are merged alone, with a heap.
LONG = 256
#: Cells of one matrix.
CELLS = 1 << 20
#: Letters and numbers newer than Unicode 16, which the library takes for neither.
NEWER = re.compile(
    "[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f]"
)


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions ``start, start + 1, ...`` of every run, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


class Table:
    """Ranks of pairs of ids: a hash table with open addresses in two arrays."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(pairs) * 4 + 1))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        slots = self.slots(pairs)
        while len(pairs):
            free = self.keys[slots] == -1
            self.keys[slots[free]] = pairs[free]
            put = self.keys[slots] == pairs
            self.ranks[slots[put]] = ranks[put]
            pairs, ranks, slots = pairs[~put], ranks[~put], (slots[~put] + 1) & ((1 << self.bits) - 1)

    def slots(self, pairs: np.ndarray) -> np.ndarray:
        mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; `NONE` where there is none or an id is negative."""
        pairs = (left.astype(np.int64) << 32) | right
        out = np.full(len(pairs), NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        slots = self.slots(pairs[todo])
        while len(todo):
            found = self.keys[slots]
            hit = found == pairs[todo]
            out[todo[hit]] = self.ranks[slots[hit]]
            on = ~hit & (found != -1)
            todo, slots = todo[on], (slots[on] + 1) & ((1 << self.bits) - 1)
        return out


class Vocabulary:
    """Ranks of byte strings, as a file of base64 token and rank per line."""

    def __init__(self, content: bytes):
        rows = [line.split() for line in content.splitlines() if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in rows}
        size = max(self.ranks.values()) + 1
        by_id = [b""] * size
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.sizes = np.array([len(t) for t in by_id], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.byte_ids = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        left, right, rank = (np.array(x, np.int64) for x in (left, right, rank))
        self.table = Table((left << 32) | right, rank.astype(np.int32))
        self.merges = dict(zip(((left << 32) | right).tolist(), rank.tolist(), strict=True))

    def merge_rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """The ids of pieces of at most ``width`` bytes, merged side by side in one padded matrix."""
        out: list = [None] * len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        sizes = np.array([len(p) for p in pieces])
        ids = np.where(np.arange(width) < sizes[:, None], self.byte_ids[raw], np.int32(-1))
        ranks = self.table.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), -1)
        row = np.arange(len(pieces))
        while len(row):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            best = ranks[np.arange(len(row)), at] if ranks.shape[1] else np.full(len(row), NONE)
            done = best == NONE
            if done.any():
                for r, x in zip(row[done], ids[done], strict=True):
                    out[r] = x[x >= 0]
                on = ~done
                row, ids, ranks, at, best = row[on], ids[on], ranks[on], at[on], best[on]
                if not len(row):
                    break
            n, k = ids.shape
            every = np.arange(n)
            ids[every, at] = best
            # the right half of the pair leaves, and with it the pair's own rank
            stay = np.ones((n, k), bool)
            stay[every, at + 1] = False
            ids = ids[stay].reshape(n, k - 1)
            stay = np.ones((n, k - 1), bool)
            stay[every, at] = False
            ranks = ranks[stay].reshape(n, k - 2)
            for left in (at - 1, at):
                some = np.flatnonzero((left >= 0) & (left < k - 2))
                ranks[some, left[some]] = self.table.find(ids[some, left[some]], ids[some, left[some] + 1])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The ids of one long piece: the same merges in the same order, next pair from a heap.

        A matrix round costs as much as the piece is long, so a long one would take the square of its length.
        """
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        first = self.table.find(ids[:-1], ids[1:])
        at = np.flatnonzero(first != NONE)
        heap = list(zip(first[at].tolist(), at.tolist(), strict=True))
        heapq.heapify(heap)
        ids, n = ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges, now = self.merges, dict(heap and ((i, r) for r, i in heap))
        while heap:
            rank, i = heapq.heappop(heap)
            if now.get(i) != rank:  # one of the two has merged since
                continue
            j = after[i]
            now.pop(i), now.pop(j, None)
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n:
                    new = merges.get((ids[a] << 32) | ids[b])
                    if new is None:
                        now.pop(a, None)
                    else:
                        now[a] = new
                        heapq.heappush(heap, (new, a))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of every piece. A piece that is a token is that token, as the library has it."""
        out: list = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            known = self.ranks.get(p)
            if known is not None:
                out[i] = np.array([known], np.int32)
            elif len(p) > LONG:
                out[i] = self.merge_long(p)
            else:
                buckets.setdefault(-(-len(p) // 4) * 4, []).append(i)
        for width, members in buckets.items():
            step = max(1, CELLS // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for i, ids in zip(part, self.merge_rows([pieces[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        return self.bytes[gather(self.starts[ids], self.sizes[ids])]


class Encoder:
    """Encodes texts; remembers the pieces it has met, within a bound."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.pattern = vocabulary, regex.compile(pattern)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.sizes, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def split(self, text: str) -> list[str]:
        """The matches of the pattern."""
        if text.isascii() or not NEWER.search(text):
            return self.pattern.findall(text)
        # a sign that is no letter, number or space stands in for them
        return [text[m.start() : m.end()] for m in self.pattern.finditer(NEWER.sub("\u00a7", text))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after the other, and the number of ids of each text."""
        if len(self.known) > MEMORY:
            self.forget()
        split = list(map(self.split, texts))
        known = self.known
        new = list({p for pieces in split for p in pieces if p not in known})
        if new:
            got = self.vocabulary.encode_pieces([p.encode() for p in new])
            sizes = np.array([len(x) for x in got], np.int64)
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.ids = np.concatenate([self.ids, *got])
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
        at = np.array([known[p] for pieces in split for p in pieces], np.int64)
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        bounds = np.cumsum([0, *map(len, split)])
        return self.ids[gather(self.starts[at], sizes)], np.diff(ends[bounds])


@lru_cache(maxsize=2)
def _encoder(content: bytes, pattern: str) -> Encoder:
    return Encoder(Vocabulary(content), pattern)


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if i + 1 - start == ROWS or size >= BYTES:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])


def encode(docs: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with the columns ``ids`` (``array<int>``) and ``decoded`` (the bytes of those ids).

    ``vocabulary`` is a file of ranks, read by the driver (under a few MB) and sent to the tasks.
    Every match of ``pattern`` in a whole text is encoded by itself, without special tokens: pieces not
    met before stand as rows of padded matrices, bucketed by length; in each round every row
    merges its leftmost pair of minimum rank, and rows without one leave. Null and empty texts have no
    ids. Rows, their order within a task, repeats and other columns are kept; columns named ``ids`` or
    ``decoded`` are replaced. An empty table gives an empty one.
    """
    with open(vocabulary, "rb") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = docs.drop(ids, decoded)
    text = fresh("bpe_text", kept)
    source = kept.withColumn(text, whole())
    names = [*kept.columns, ids, decoded]
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(content.value, pattern)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for a, b in _parts(texts):
                flat, sizes = encoder.encode(texts[a:b])
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                back = encoder.vocabulary.decode(flat)
                lengths = np.diff(np.concatenate([[0], np.cumsum(encoder.vocabulary.sizes[flat])])[ends])
                columns = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, lists, _binary(back, lengths)], names)

    return source.mapInArrow(run, schema)


def digest(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Number and hashes of the ids and of the decoded bytes, one row per row of ``docs``."""
    return encode(docs.select("doc_id", "text"), vocabulary, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
