"""Source mixing, spelling variants and the conversation trie against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_texts import prose

from portolan.llm import conversations, mixing, variants

WORD = re.compile("[^\x20\x09-\x0d]+")


# --- mixing ---


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 65536, 65537])
def test_permuted_is_a_permutation(n):
    for key in (0, 1, -7, 1 << 62):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))
        assert sorted(got.tolist()) == list(range(n))
    if n > 100:
        assert got.tolist() != list(range(n))


def plain_targets(sizes):
    """Shares by weight with stops, source by source."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        per = left / sum(weight[s] for s in rest) if rest else 0
        over = {s for s in rest if 3 * sizes[s] < weight[s] * per}
        if not over:
            return {s: 3 * sizes[s] if s in full else weight[s] * per for s in names}
        full |= over


@pytest.fixture(scope="module")
def sourced(spark):
    r = random.Random(4)
    rows = []
    for i in range(400):
        source = r.choice(["hot"] * 8 + ["b", "é", "z", None, "tiny"] if i > 3 else ["void"])
        text = r.choice([prose(i, r.randrange(1, 90)), "same words here", None, "", " \t"]) if source != "void" else " \n"
        text = "one two" if source == "tiny" else text
        rows.append((r.choice([i, i, 7, None]), source, text))
    rows += [(9999, "hot", prose(5, 20000))] + [(1, "b", "again and again")] * 60
    return rows, spark.createDataFrame([(*x, "x", 0) for x in rows], "doc_id long, source string, text string, no string, start long")


@pytest.mark.parametrize("block,shard", [(16, 8), (1024, 1024), (7, 50)])
def test_mix_meets_its_targets(sourced, block, shard):
    rows, df = sourced
    got = mixing.digest(df, block=block, shard=shard).collect()
    words = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for _, s, t in rows:
        sizes[s] += words(t)
    targets = plain_targets(sizes)
    assert Counter((r.doc_id, r["size"], r.source_size) for r in got) == Counter((i, words(t), sizes[s]) for i, s, t in rows)
    by_target = defaultdict(int)
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        by_target[r.source_size, round(r.target, 6)] += r.taken
    assert {k: v for k, v in by_target.items()} == {(sizes[s], round(t, 6)): round(t) for s, t in targets.items()}
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.digest(df.repartition(5), block=block, shard=shard).collect()))


def test_mix_is_made_of_blocks(sourced):
    rows, df = sourced
    out = mixing.mixture(df, block=50, shard=16).collect()
    taken = Counter()
    slots = defaultdict(list)
    for r in out:
        assert len(r.text.split(" ")) == r.words <= 50
        taken[r.source] += r.words
        slots[r.shard].append(r.slot)
    sizes = Counter()
    known = defaultdict(Counter)
    for _, s, t in rows:
        sizes[s] += len(WORD.findall(t or ""))
        known[s].update(WORD.findall(t or ""))
    assert taken == Counter({s: round(t) for s, t in plain_targets(sizes).items() if t})
    # every shard is full but the last, and each word comes from its source, three times at most
    assert all(sorted(s) == list(range(16)) for k, s in slots.items() if k < max(slots))
    seen = defaultdict(Counter)
    for r in out:
        seen[r.source].update(r.text.split(" "))
    assert all(n <= 3 * known[s][w] for s in seen for w, n in seen[s].items())


def test_mix_of_nothing(spark):
    kind = "doc_id long, source string, text string"
    assert mixing.digest(spark.createDataFrame([], kind)).collect() == []
    (row,) = mixing.digest(spark.createDataFrame([(1, None, None)], kind)).collect()
    assert tuple(row) == (1, 0, 0, 0.0, 0)


def test_draw_over_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUNDLE", 7)
    df = spark.createDataFrame([(i, f"s{i % 40:02}", prose(i, 30 + i % 40)) for i in range(120)], "doc_id long, source string, text string")
    got = mixing.digest(df, block=8, shard=32).collect()
    assert abs(sum(r.taken for r in got) - sum(r["size"] for r in got)) <= 40


# --- spelling variants ---


def plain_near(a, b):
    edits = {a[:i] + a[i + 1 :] for i in range(len(a))}
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return b in edits if len(a) == len(b) + 1 else a in {b[:i] + b[i + 1 :] for i in range(len(b))} if len(b) == len(a) + 1 else False


def plain_variants(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = {w: [x for x in n if plain_near(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


@pytest.fixture(scope="module")
def spelt():
    r = random.Random(8)
    letters = "abcdefghiétù×ÿß"
    words = ["".join(r.choice(letters) for _ in range(r.randrange(5, 9))) for _ in range(60)]
    words += [w[: (k := r.randrange(len(w)))] + r.choice(letters) * r.randrange(3) + w[k + 1 :] for w in words for _ in range(4)]
    words += ["".join(r.sample("aabbccd", 7)) for _ in range(120)] + ["x" * 40, "x" * 41]
    rows = [(i if i % 9 else None, " ".join(w.title() if r.random() < 0.2 else w for w in r.choices(words, [1 + 60 * (j % 7 == 0) for j in range(len(words))], k=90))) for i in range(120)]
    chain = [(300, "stepped " * 6), (301, "steppeds " * 35), (303, "steppedst " * 200)]
    star = [(400 + i, f"starwo{c}d " * 6) for i, c in enumerate("abcdefgr")]
    return rows + chain + star + [(5, None), (6, ""), (7, "Abcdefg" * 20000), (8, "zzzzzz " * 900)] + [(9, "repeated rowsss")] * 6


@pytest.mark.parametrize("least", [4096, 20, 3])
def test_variants_as_in_plain_python(docs_of, spelt, least, monkeypatch):
    monkeypatch.setattr(variants, "MOST", least)
    monkeypatch.setattr(variants, "QUERIES", least)
    got = [tuple(r) for r in variants.digest(docs_of(spelt), least=least).collect()]
    want = plain_variants(spelt)
    assert len(got) == len(want) and set(got) == want
    assert any(r[2] not in (r[0], r[1]) for r in want) and any(r[4] > 5 for r in want)


def test_search_by_halves(monkeypatch):
    r = random.Random(2)
    words = sorted({"".join(r.choice("ab") for _ in range(r.randrange(6, 10))) for _ in range(400)} | {"q" * 9})
    want = {(a, b) for a, x in enumerate(words) for b, y in enumerate(words) if plain_near(x, y)}
    for leaf, pairs in ((16, 1 << 16), (1, 0), (10**9, 1 << 16)):
        monkeypatch.setattr(variants, "LEAF", leaf)
        monkeypatch.setattr(variants, "PAIRS", pairs)
        found = list(zip(*variants.search(words, words), strict=True))
        assert len(found) == len(set(found)) and set(found) == want
    assert all(variants.one_edit(x, y) == plain_near(x, y) for x in words[:90] for y in words)


def test_no_words(docs_of):
    assert variants.digest(docs_of([])).collect() == []
    assert variants.digest(docs_of([(1, None), (None, "short words only")])).collect() == []


# --- conversations ---


def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            mark = hashlib.sha256(f"{len(role or '')}:{role or ''}:{text or ''}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, mark, role or "", text or ""))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        paths[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    kids, below, saved = Counter(), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p in members:
        gain = (len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += gain
            below[p[:d]] += not kids[p]
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(paths[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], below[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


@pytest.fixture(scope="module")
def talks():
    r = random.Random(6)
    said = [("user", "hello there"), ("user", "hello there"), ("assistant", "yes  of course"), ("user", ""), (None, "no role"), ("user", None), ("sys", "a:b"), ("sys:", "a")]
    rows = []
    for c in [*range(0, 90, 3), *range(61), -5, -20, 2**40, 10**12]:
        line = [r.choice(said[: 2 + c % 7]) for _ in range(r.choice([1, 2, 3, 5, 8, 9, 16, 17]))]
        rows += [(c, r.choice([i, i, None]), *t) for i, t in enumerate(line)]
    rows += [(500 + c, i, "user", f"line {i}") for c in range(120) for i in range(9)]  # copies
    rows += [(700, i, "user", f"line {i % 3}") for i in range(700)]  # very long
    rows += [(701, i, "user", f"line {i % 3}") for i in range(699)]
    return rows + [(None, 1, "user", "lost"), (60, 2, "user", "x " * 50000), (3, 4, "u", "twice"), (3, 4, "u", "twice")]


@pytest.mark.parametrize("block", [2, 3, 8, 1000])
def test_trie_as_in_plain_python(spark, talks, block):
    df = spark.createDataFrame([(*x, "x", "y") for x in talks], "conv_id long, turn long, role string, text string, id string, parent string")
    got = [tuple(r) for r in conversations.digest(df, block).collect()]
    assert Counter(got) == plain_trie(talks)


def test_trie_of_nothing(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert conversations.digest(spark.createDataFrame([], kind)).collect() == []
    # crc32('1') % 4 is 3: its only turn gives way to a first conversation that is not there
    (row,) = conversations.digest(spark.createDataFrame([(1, 1, "u", "x")], kind)).collect()
    assert tuple(row) == (1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())


def test_nodes_with_their_turns(spark):
    df = spark.createDataFrame([(1, 1, "u", "a"), (1, 2, "u", "b"), (2, 1, "u", "a"), (2, 2, None, "c")], "conv_id long, turn long, role string, text string")
    turns = conversations.turns_of(df)
    nodes = conversations.prefix_trie(turns, turns.select("conv_id"))
    got = {(r.depth, r.role, r.text, r.n_convs) for r in conversations.with_turns(nodes, df).collect()}
    assert got == {(0, None, None, 2), (1, "u", "a", 2), (2, "u", "b", 1), (2, "", "c", 1)}
