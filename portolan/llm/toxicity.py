"""Toxicity scores: averaged subword embeddings under a linear softmax."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portolan.llm.common import fresh, whole

#: Buckets of subwords, length of an embedding, lengths of character n-grams.
BUCKETS, DIM, GRAMS = 1 << 17, 8, (3, 4, 5)
#: Labelled rows that training takes, at most.
SAMPLE = 4000
EPOCHS, BATCH, RATE, DECAY, Z = 20, 128, 0.02, 1e-4, 5.0
#: Every so-many-th id is held out of training.
FOLDS = 5
#: Words whose score a worker remembers before it starts anew.
MEMORY = 300_000
WORD = re.compile(r"\w+")


def held_out(doc_id):
    """True for the ids that training must not see."""
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the subwords of all words, and how many each has: the word and its n-grams.

    Words stand between marks, so that beginnings and ends differ from the middle.
    """
    sizes = np.zeros(len(words), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_size.setdefault(len(w), []).append(i)
    for size, members in by_size.items():
        step = max(1, (1 << 20) // (size + 2))
        for at in range(0, len(members), step):
            part = members[at : at + step]
            codes = np.frombuffer("".join(f"<{words[i]}>" for i in part).encode("utf-32-le"), np.uint32).reshape(len(part), -1).astype(np.uint64)
            columns = []
            for n in (*[g for g in GRAMS if g < size + 2], size + 2):
                h = np.full((len(part), size + 3 - n), n, np.uint64)
                for j in range(n):
                    h = (h ^ codes[:, j : size + 3 - n + j]) * np.uint64(0x100000001B3)
                    h ^= h >> np.uint64(29)
                columns.append((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(47))
            got = np.concatenate(columns, axis=1).astype(np.int64) % BUCKETS
            sizes[part] = got.shape[1]
            found.append((np.array(part), got))
    ends = np.cumsum(sizes)
    flat = np.zeros(int(ends[-1]) if len(words) else 0, np.int64)
    for part, got in found:
        at = (ends - sizes)[part][:, None] + np.arange(got.shape[1])
        flat[at] = got
    return flat, sizes


@dataclass
class Model:
    """``gain``: what a subword adds to the logit; ``bias``: the logit of an empty text."""

    gain: np.ndarray
    bias: float

    def words(self, words: list[str]) -> np.ndarray:
        """The mean over each word's subwords."""
        if not words:
            return np.zeros(0)
        flat, sizes = subwords(words)
        return np.add.reduceat(self.gain[flat].astype(np.float64), np.cumsum(sizes) - sizes) / sizes


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bags(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Per text its distinct words and their shares, and the subwords of all words with their number per word."""
    index: dict[str, int] = {}
    out = []
    for t in texts:
        ws = tokens(t)
        word, n = np.unique(np.fromiter((index.setdefault(w, len(index)) for w in ws), np.int32, len(ws)), return_counts=True)
        out.append((word, (n / max(1, len(ws))).astype(np.float32)))
    flat, sizes = subwords(list(index))
    return out, flat.astype(np.int32), sizes


def features(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows ``doc, bucket, weight``, sorted by doc: a word is the mean of its subwords, a text that of its words.

    Only buckets that one class has more often than chance explains, by `Z` deviations, are kept: the
    others would serve to learn mislabelled texts by heart. Texts are gone through twice, so that only
    what is kept is ever held.
    """
    split, flat, sizes = bags(texts)
    starts = np.cumsum(sizes) - sizes

    def row(d: int) -> tuple[np.ndarray, np.ndarray]:
        word, share = split[d]
        size = sizes[word]
        at = np.repeat(starts[word] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        bucket, back = np.unique(flat[at], return_inverse=True)
        return bucket, np.bincount(back, np.repeat(share / np.maximum(size, 1), size), len(bucket)).astype(np.float32)

    n, bad = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for d in range(len(texts)):
        bucket, _ = row(d)
        n[bucket] += 1
        bad[bucket] += toxic[d]
    p = toxic.mean()
    telling = np.abs(bad - n * p) >= Z * np.sqrt(np.maximum(n, 1) * p * (1 - p))
    docs, cols, weights = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    for d in range(len(texts)):
        bucket, weight = row(d)
        keep = telling[bucket]
        docs.append(np.full(keep.sum(), d, np.int32)), cols.append(bucket[keep]), weights.append(weight[keep])
    return np.concatenate(docs), np.concatenate(cols), np.concatenate(weights)


def train(texts: list[str], toxic: np.ndarray) -> Model:
    """Fits subword embeddings and the softmax over their mean together, by Adam on batches of texts.

    With two classes the softmax is told by the difference of its two outputs, which is what is kept.
    """
    if not len(texts) or toxic.min() == toxic.max():
        share = float(toxic.mean()) if len(texts) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), 10.0 * (2 * share - 1))
    doc, col, weight = features(texts, toxic)
    kept, col = np.unique(col, return_inverse=True)
    # weights are shares of a text, so small numbers
    scale = 1 / np.sqrt(max((weight**2).mean() if len(weight) else 0.0, 1e-12))
    weight = (weight * scale).astype(np.float32)
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    rng = np.random.default_rng(7)
    emb = rng.normal(0, 0.01, (len(kept), DIM)).astype(np.float32)
    out = rng.normal(0, 0.3, DIM).astype(np.float32)
    bias = np.zeros(1, np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, out, bias)]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            sizes = ends[batch + 1] - ends[batch]
            pick = np.repeat(ends[batch] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            own, c, w = np.repeat(np.arange(len(batch)), sizes), col[pick], weight[pick]
            logit = np.bincount(own, w * (emb @ out)[c], len(batch)) + bias
            g = ((1 / (1 + np.exp(-np.clip(logit, -40, 40))) - toxic[batch]) / len(batch)).astype(np.float32)
            back = np.bincount(c, w * g[own], len(kept)).astype(np.float32)
            grads = (np.outer(back, out) + DECAY * emb, emb.T @ back + DECAY * out, g.sum(keepdims=True))
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for param, grad, (m, v) in zip((emb, out, bias), grads, state, strict=True):
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                param -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    gain = np.zeros(BUCKETS, np.float32)
    gain[kept] = emb @ out * scale
    return Model(gain, float(bias[0]))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Texts and labels to train on: the first ``most`` labelled rows in hash order.

    Held out ids and null labels or ids are left out, an id labelled both ways counts as toxic, and of
    several texts of an id the smallest is taken.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    present = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    # at most ``most`` rows of two numbers
    ids = F.broadcast(present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    rows = docs.select("doc_id", whole().alias("t")).join(ids, "doc_id").groupBy("doc_id", "toxic").agg(F.min("t").alias("t")).collect()
    rows.sort(key=lambda r: str(r["doc_id"]))
    return [r["t"] for r in rows], np.array([r["toxic"] for r in rows], np.int64)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``: how likely a text is toxic, 0 to 1.

    Whole texts count, each word alike. Null and empty texts, and texts without words, get the score of the
    bias alone. Rows, repeats and other columns are kept; a column called ``name`` is replaced.
    """
    kept = docs.drop(name)
    text = fresh("toxic_text", kept)
    weights = docs.sparkSession.sparkContext.broadcast(model)
    names = [*kept.columns, name]
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = weights.value, {}
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            scores = []
            for at in range(0, len(texts), 128):
                split = [tokens(t) for t in texts.slice(at, 128).to_pylist()]
                if len(known) > MEMORY:
                    known = {}
                new = list({w for ws in split for w in ws if w not in known})
                known.update(zip(new, model.words(new).tolist(), strict=True))
                scores += [sum(map(known.__getitem__, ws)) / len(ws) if ws else 0.0 for ws in split]
            out = 1 / (1 + np.exp(-np.clip(np.array(scores) + model.bias, -40, 40)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.float64())], names)

    return kept.withColumn(text, whole()).mapInArrow(run, schema)


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    return train(*sample(docs, labels))


def drop_toxic(docs: DataFrame, labels: DataFrame, most: float = 0.5) -> DataFrame:
    """``docs`` without the texts that score ``most`` or more; the model is learnt from ``labels``."""
    name = fresh("toxic_score", docs)
    return score(docs, trained(docs, labels), name).where(F.col(name) < most).select(*docs.columns)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fold, score and prediction, one row per row of ``docs``; a null id is not held out."""
    scored = score(docs.select("doc_id", "text"), trained(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
