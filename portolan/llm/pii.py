"""Personal data: fixed patterns, and a character model (BiLSTM with CRF) learnt from their spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.llm.common import joined_spans, sha, whole

KINDS = ["email", "ip", "card", "phone"]
#: Length and step of the windows; characters around a digit or an @ that windows cover.
WINDOW, STEP, MARGIN = 64, 32, 24
#: Sizes of the model, and of its training: documents sampled, windows taken, batches run.
EMB, HIDDEN, TAGS = 10, 16, 1 + 2 * len(KINDS)
SAMPLE, WINDOWS, BATCH, BATCHES, RATE = 4000, 3000, 32, 240, 0.02
#: Windows scored side by side.
BLOCK = 512

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CUE = re.compile(r"[0-9@]+")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def patterns(text: str) -> list[Span]:
    """``(start, kind, end)`` of the fixed patterns, leftmost and without overlap per kind, failing ones dropped.

    Each is found in time linear in the text: what a pattern repeats is taken whole, never retried from within.
    """
    found: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        head = text[last:at]
        size = len(head) - len(head.rstrip(LOCAL))
        match = DOMAIN.match(text, at + 1) if size else None
        if match:
            found.append((at - size, 0, match.end()))
            last = match.end()
        else:
            last = at + 1
        at = text.find("@", last)
    for m in NUMBERS.finditer(text):
        parts = m.group().split(".")
        start = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            # a long run of digits is over 255 unless it is zeros
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                found.append((start, 1, end))
            start = end + 1
    for m in DIGITS.finditer(text):
        digits = only_digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(only_digits(m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def plausible(kind: int, text: str) -> bool:
    """Whether a span that the model proposes can be what it is taken for."""
    digits = only_digits(text)
    if kind == 0:
        name, _, host = text.partition("@")
        return bool(name.strip()) and "." in host.strip(" .") and "@" not in host and "\n" not in text
    if kind == 1:
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 and text[0] in "+(0" and "\n" not in text


def codes(text: str) -> np.ndarray:
    """Places in the alphabet: printable ASCII, line end, other letters, everything else."""
    raw = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    out = np.where((raw >= 32) & (raw < 127), raw - 32, 97)
    out[raw == 10] = 95
    out[raw > 0xBF] = 96
    return out


ALPHABET, PAD = 99, 98


def windows(text: str) -> list[int]:
    """Starts of the windows of a text: they overlap, and cover all that lies near a digit or an @.

    A span of any of the kinds holds such a character, so nothing can be missed elsewhere.
    """
    starts: list[int] = []
    low = high = -1
    for m in CUE.finditer(text):
        a, b = max(0, m.start() - MARGIN), min(len(text), m.end() + MARGIN)
        if a > high:
            if high > low:
                starts += range(low, max(low + 1, high - STEP), STEP)
            low = a
        high = max(high, b)
    if high > low:
        starts += range(low, max(low + 1, high - STEP), STEP)
    return starts


def cut(text: str, starts: list[int]) -> np.ndarray:
    """The windows as rows of codes, padded."""
    padded = np.concatenate([codes(text), np.full(WINDOW, PAD)])
    return padded[np.array(starts)[:, None] + np.arange(WINDOW)]


def spread(spans: list[Span], size: int) -> np.ndarray:
    """Tags of a text: 0 outside, 1 + 2 k where a span of kind k begins, 2 + 2 k inside it."""
    tags = np.zeros(size, np.int64)
    for start, kind, end in spans:
        tags[start:end] = 2 + 2 * kind
        tags[start] = 1 + 2 * kind
    return tags


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Embeddings, an LSTM each way, scores per tag, and transitions between tags."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.p = {"emb": draw(ALPHABET, EMB) * 3, "out": draw(2 * HIDDEN, TAGS), "bias": np.zeros(TAGS, np.float32), "next": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": draw(EMB, 4 * HIDDEN), f"h{d}": draw(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first

    def _lstm(self, e: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        p, n, t = self.p, len(e), e.shape[1]
        pre = e @ p["x" + d] + p["c" + d]
        h = c = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((n, t, HIDDEN), np.float32)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = pre[:, i] + h @ p["h" + d]
            gates = sigmoid(z[:, : 3 * HIDDEN])
            new = np.tanh(z[:, 3 * HIDDEN :])
            i_, f_, o_ = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            before, c = c, f_ * c + i_ * new
            tc = np.tanh(c)
            if keep is not None:
                keep.append((i, h, before, i_, f_, o_, new, tc))
            h = o_ * tc
            out[:, i] = h
        return out

    def scores(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """A score per window, character and tag."""
        e = self.p["emb"][x]
        steps = {d: [] if keep is not None else None for d in "fb"}
        h = np.concatenate([self._lstm(e, d, steps[d]) for d in "fb"], axis=2)
        if keep is not None:
            keep |= {"e": e, "h": h, "steps": steps}
        return h @ self.p["out"] + self.p["bias"]

    def gradients(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags under the CRF, and its gradients."""
        keep: dict = {}
        s = self.scores(x, keep).astype(np.float64)
        n, t, k = s.shape
        step = self.p["next"].astype(np.float64)
        add = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha, beta = np.empty_like(s), np.zeros_like(s)
        alpha[:, 0] = s[:, 0]
        for i in range(1, t):
            alpha[:, i] = s[:, i] + add(alpha[:, i - 1, :, None] + step, 1)
        for i in range(t - 2, -1, -1):
            beta[:, i] = add(step + (s[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        total = add(alpha[:, -1], 1)
        rows, cols = np.arange(n)[:, None], np.arange(t)
        path = s[rows, cols, tags].sum(1) + step[tags[:, :-1], tags[:, 1:]].sum(1)
        gs = np.exp(alpha + beta - total[:, None, None])
        gs[rows, cols, tags] -= 1
        edge = np.exp(alpha[:, :-1, :, None] + step + (s + beta)[:, 1:, None, :] - total[:, None, None, None]).sum((0, 1))
        np.subtract.at(edge, (tags[:, :-1], tags[:, 1:]), 1)
        gs = (gs / n).astype(np.float32)
        g = {"next": (edge / n).astype(np.float32), "bias": gs.sum((0, 1)), "out": keep["h"].reshape(-1, 2 * HIDDEN).T @ gs.reshape(-1, k)}
        gh = gs @ self.p["out"].T
        ge = np.zeros_like(keep["e"])
        for j, d in enumerate("fb"):
            gz = np.empty((n, t, 4 * HIDDEN), np.float32)
            wide = np.zeros((HIDDEN, 4 * HIDDEN), np.float32)
            dh = dc = np.zeros((n, HIDDEN), np.float32)
            for i, h, before, i_, f_, o_, new, tc in reversed(keep["steps"][d]):
                dh = dh + gh[:, i, j * HIDDEN : (j + 1) * HIDDEN]
                dc = dc + dh * o_ * (1 - tc * tc)
                z = np.concatenate([dc * new * i_ * (1 - i_), dc * before * f_ * (1 - f_), dh * tc * o_ * (1 - o_), dc * i_ * (1 - new * new)], axis=1)
                gz[:, i] = z
                wide += h.T @ z
                dh, dc = z @ self.p["h" + d].T, dc * f_
            flat = gz.reshape(-1, 4 * HIDDEN)
            g |= {"h" + d: wide, "x" + d: keep["e"].reshape(-1, EMB).T @ flat, "c" + d: flat.sum(0)}
            ge += gz @ self.p["x" + d].T
        g["emb"] = np.zeros_like(self.p["emb"])
        np.add.at(g["emb"], x.ravel(), ge.reshape(-1, EMB))
        return float((total - path).mean()), g

    def fit(self, x: np.ndarray, tags: np.ndarray, batches: int = BATCHES) -> Tagger:
        rng = np.random.default_rng(11)
        state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        for step in range(1, batches + 1):
            pick = rng.choice(len(x), min(BATCH, len(x)), replace=False)
            _, g = self.gradients(x[pick], tags[pick])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            rate = RATE * min(1, 2 * (1 - step / (batches + 1)))
            for k, (m, v) in state.items():
                grad = g[k] * min(1.0, 5 / (norm + 1e-9))
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                self.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags of each window, by Viterbi."""
        s, step = self.scores(x), self.p["next"]
        n, t, k = s.shape
        best, back = s[:, 0], np.empty((n, t, k), np.int8)
        for i in range(1, t):
            both = best[:, :, None] + step
            back[:, i] = both.argmax(1)
            best = both.max(1) + s[:, i]
        tags = np.empty((n, t), np.int64)
        tags[:, -1] = best.argmax(1)
        for i in range(t - 1, 0, -1):
            tags[:, i - 1] = back[np.arange(n), i, tags[:, i]]
        return tags


def reconcile(size: int, starts: list[int], tags: np.ndarray) -> np.ndarray:
    """One tag per character: where windows overlap, that of the window it lies deepest in."""
    out, depth = np.zeros(size + WINDOW, np.int64), np.full(size + WINDOW, -1, np.int64)
    own = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    for start, row in zip(starts, tags, strict=True):
        here = slice(start, start + WINDOW)
        deeper = own > depth[here]
        out[here][deeper] = row[deeper]
        depth[here][deeper] = own[deeper]
    return out[:size]


def proposed(text: str, tags: np.ndarray) -> list[Span]:
    """Maximal runs of one kind as spans, without the blanks and stops at their ends, if plausible."""
    spans: list[Span] = []
    at = np.flatnonzero(tags)
    if not len(at):
        return spans
    kind = (tags[at] - 1) // 2
    new = (np.diff(at, prepend=-2) != 1) | (np.diff(kind, prepend=-1) != 0) | (tags[at] % 2 == 1)
    first = np.flatnonzero(new)
    for a, b in zip(first, np.append(first[1:], len(at)), strict=True):
        start, end, k = int(at[a]), int(at[b - 1]) + 1, int(kind[a])
        piece = text[start:end]
        start += len(piece) - len(piece.lstrip(" \n.,;:"))
        piece = piece.strip(" \n.,;:")
        if piece and plausible(k, piece):
            spans.append((start, k, start + len(piece)))
    return spans


def added(text: str, base: list[Span], starts: list[int], tags: np.ndarray) -> list[Span]:
    """The model's spans that overlap no base span."""
    found, i = [], 0
    reach = np.maximum.accumulate([e for _, _, e in base]) if base else []
    begins = [s for s, _, _ in base]
    for start, kind, end in proposed(text, reconcile(len(text), starts, tags)):
        # of the base spans that begin before the end, the farthest reaching
        i = int(np.searchsorted(begins, end))
        if not i or reach[i - 1] <= start:
            found.append((start, kind, end))
    return found


def vary(text: str, tags: np.ndarray, rng: np.random.Generator) -> tuple[str, np.ndarray]:
    """A window as it would look if its writer had dodged the fixed patterns: blanks put around the @,
    dots of numbers put in brackets, the plus of a phone number left out. Labels follow the characters."""
    out, own = [], []
    for c, t in zip(text, tags.tolist(), strict=True):
        inside = t + 1 if t and t % 2 else t
        if t and c == "@" and inside == 2:
            out += [" ", "@", " "]
            own += [inside] * 3
        elif t and c == "." and inside == 4:
            out += ["[", ".", "]"]
            own += [inside] * 3
        elif t and c == "+" and inside == 8:
            out.append("(")
            own.append(t)
        else:
            out.append(c)
            own.append(t)
    return "".join(out)[:WINDOW], np.array(own[:WINDOW])


def training_windows(docs: DataFrame) -> tuple[list[str], list[np.ndarray]]:
    """Windows of sampled documents, with the tags of the fixed patterns: `WINDOWS` at most, half with a span.

    The sample is the first `SAMPLE` ids in hash order; windows are taken in hash order too.
    """
    ids = F.broadcast(docs.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    texts = docs.join(ids, "doc_id").select(whole().alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                starts = windows(text)
                if starts:
                    tags = spread(patterns(text), len(text))
                    rows = [(text[s : s + WINDOW], tags[s : s + WINDOW].tolist(), bool(tags[s : s + WINDOW].any())) for s in starts]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], schema=pa.schema([("w", pa.string()), ("tags", pa.list_(pa.int64())), ("held", pa.bool_())]))

    cut_ = texts.mapInArrow(run, "w string, tags array<long>, held boolean").dropDuplicates(["w"])
    rows = [r for held in (True, False) for r in cut_.where(F.col("held") == held).orderBy(F.xxhash64("w"), "w").limit(WINDOWS // 2).collect()]
    return [r["w"] for r in rows], [np.array(r["tags"], np.int64) for r in rows]


def trained(docs: DataFrame) -> Tagger | None:
    """A model learnt from the documents' own pattern spans, each window also in a dodging form; none without spans."""
    texts, tags = training_windows(docs)
    if not any(t.any() for t in tags):
        return None
    rng = np.random.default_rng(3)
    more = [vary(w, t, rng) for w, t in zip(texts, tags, strict=True) if t.any()]
    rows = np.concatenate([cut(w, [0]) for w in [*texts, *[w for w, _ in more]]])
    marks = np.zeros((len(rows), WINDOW), np.int64)
    for i, t in enumerate([*tags, *[t for _, t in more]]):
        marks[i, : len(t)] = t
    return Tagger().fit(rows, marks)


def pii_spans(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``base`` and ``spans``, ``array<struct<start, rank, end>>``.

    ``base`` has the spans of the fixed patterns, ``spans`` those and what the model adds: it reads
    overlapping windows over every place of the whole text that is near a digit or an @, each is decoded
    by itself, and one tag per character is settled over all windows of the text. Added spans are
    plausible for their kind and overlap no base span. Offsets count code points, ends are exclusive, rank is
    the place in `KINDS`. Without ``model`` one is learnt from ``docs``.

    Null texts count as empty. Repeated rows and null ids stay. Other columns are not looked at.
    """
    model = model or trained(docs)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    spans = "array<struct<start:int,rank:int,end:int>>"
    kind = docs.schema["doc_id"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))
    as_rows = lambda found: [{"start": s, "rank": k, "end": e} for s, k, e in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                base = [patterns(t) for t in texts]
                starts = [windows(t) if tagger else [] for t in texts]
                tags = decoded(tagger, texts, starts)
                every = [sorted([*b, *added(t, b, s, g)]) if s else b for t, b, s, g in zip(texts, base, starts, tags, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(as_rows, base), span_type), pa.array(map(as_rows, every), span_type)], ["doc_id", "base", "spans"])

    return docs.select("doc_id", whole().alias("t")).mapInArrow(run, f"doc_id {kind}, base {spans}, spans {spans}")


def decoded(tagger: Tagger | None, texts: list[str], starts: list[list[int]]) -> Iterator[np.ndarray | None]:
    """The tags of each text's windows; windows of several texts are decoded side by side, in blocks of bounded size."""
    rows: list[np.ndarray] = []
    waiting: list[int] = []
    held = 0

    def flush() -> Iterator[np.ndarray | None]:
        x = np.concatenate(rows) if rows else np.zeros((0, WINDOW), np.int64)
        tags = [tagger.decode(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)]
        tags = np.concatenate(tags) if tags else x
        ends = np.cumsum(waiting)
        for n, e in zip(waiting, ends, strict=True):
            yield tags[e - n : e] if n else None

    for text, own in zip(texts, starts, strict=True):
        if own:
            rows.append(cut(text, own))
        waiting.append(len(own))
        held += len(own)
        if held >= 8 * BLOCK:
            yield from flush()
            rows, waiting, held = [], [], 0
    yield from flush()


def digest(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """Counts and span strings, one row per row of ``docs``."""
    count = lambda i: F.size(F.filter("base", lambda s: s["rank"] == i)).cast("long")
    return pii_spans(docs, model).select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        sha(joined_spans(F.col("base"), KINDS)).alias("base_sha256"),
        joined_spans(F.col("spans"), KINDS).alias("spans"),
    )
