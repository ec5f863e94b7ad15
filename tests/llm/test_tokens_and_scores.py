"""Token ids against the public library, toxicity on held-out rows, and the pipeline against its parts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from llm_texts import prose

from portolan.llm import bpe, queries, toxicity


@pytest.fixture(scope="module")
def vocabulary():
    with open(queries.VOCABULARY, "rb") as f:
        return bpe.Vocabulary(f.read())


def test_ids_are_the_librarys(docs_of, odd_rows, vocabulary):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    r = random.Random(5)
    letters = lambda: r.choice([chr(r.randrange(32, 127)), chr(r.randrange(1, 0x3000)), chr(r.randrange(0x10000, 0x40000)), " ", "\n", "'s", "the"])
    texts = ["".join(letters() for _ in range(r.randrange(60))) for _ in range(400)]
    texts += ["".join(r.choice(["th", "e", "ing", "io", "n"]) for _ in range(900)), " " * 2000, "\U0003d300's", "<|endoftext|>", "a\r\n\r\n b"]
    rows = [*odd_rows, *enumerate(texts, 100)]
    got = {}
    for x in bpe.digest(docs_of(rows), queries.VOCABULARY, public_tokenizers.PATTERN).collect():
        got.setdefault(x["doc_id"], set()).add((x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]))
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert (len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) in got[i]


def test_rows_merge_as_one_by_one(vocabulary):
    r = random.Random(8)
    pieces = [bytes(r.choice(b"theinorg sa\xc3\xa9") for _ in range(r.randrange(2, 40))) for _ in range(500)]

    def plain(piece):
        ids = [vocabulary.ranks[bytes([c])] for c in piece]
        while True:
            pairs = [(vocabulary.merges.get((a << 32) | b, 1 << 40), i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False))]
            if not pairs or min(pairs)[0] == 1 << 40:
                return ids
            rank, i = min(pairs)
            ids[i : i + 2] = [rank]

    for width in (40,):
        for piece, ids in zip(pieces, vocabulary.merge_rows(pieces, width), strict=True):
            assert ids.tolist() == plain(piece) == vocabulary.merge_long(piece).tolist()


def test_encode_keeps_other_columns(docs_of, odd_rows):
    docs = docs_of(odd_rows)
    got = bpe.encode(docs, queries.VOCABULARY, public_tokenizers.PATTERN)
    assert got.columns == [*[c for c in docs.columns if c not in ("ids", "decoded")], "ids", "decoded"]
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in got.collect())


@pytest.fixture(scope="module")
def marked():
    r = random.Random(12)
    bad = ["idiotic", "wretched", "scoundrel", "vermin"]
    rows = []
    for i in range(900):
        toxic = r.random() < 0.3
        ws = prose(r.random(), r.randrange(20, 200)).split(" ")
        if toxic:
            for _ in range(max(2, len(ws) // 30)):
                ws.insert(r.randrange(len(ws)), r.choice(bad))
        rows.append((i, " ".join(ws), int(toxic if r.random() > 0.04 else not toxic), int(toxic)))
    return rows


def test_held_out_accuracy(spark, docs_of, marked):
    docs = docs_of([(i, t) for i, t, _, _ in marked] + [(5000, prose(77, 40) + " idiotiic vermiin scoundrell wretchedd"), (5001, ""), (5002, None)])
    labels = spark.createDataFrame([(i, k) for i, _, k, _ in marked], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.digest(docs, labels).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    out = [(got[i]["predicted"], true) for i, _, _, true in marked if got[i]["held_out"]]
    assert np.mean([p == t for p, t in out]) >= 0.93
    # never seen in this spelling
    assert got[5000]["predicted"] == 1
    assert got[5001]["score"] == got[5002]["score"]


def test_held_out_labels_are_never_read(spark, docs_of, marked):
    docs = docs_of([(i, t) for i, t, _, _ in marked[:300]])
    flip = lambda i, k: 1 - k if zlib.crc32(str(i).encode()) % 5 == 0 else k
    labels = [spark.createDataFrame([(i, f(i, k)) for i, _, k, _ in marked[:300]], "doc_id long, toxic int") for f in (lambda i, k: k, flip)]
    a, b = (toxicity.trained(docs, x) for x in labels)
    assert (a.gain == b.gain).all() and a.bias == b.bias


def test_no_labels(spark, docs_of, marked):
    docs = docs_of([(i, t) for i, t, _, _ in marked[:20]])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r["predicted"] == 0 for r in toxicity.digest(docs, none).collect())
