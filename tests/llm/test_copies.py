"""Copies, near copies, repeated strings and shared passages against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from llm_texts import prose

from portolan.llm import exact, passages, simhash, suffixes


def test_exact_groups(docs_of):
    base = [prose(i, 40) for i in range(4)]
    rows = [(9, base[0]), (3, base[0].replace(" ", "\t\n")), (7, base[0] + " "), (8, base[0] + "\n"), (1, base[1]), (1, base[1]), (4, base[2]), (None, base[2]), (None, base[3]), (None, base[3]), (5, None), (6, ""), (2, base[0][:-1] + "#"), (1, base[3] + "!"), (11, "\u00a0"), (12, " ")]
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    for every in (True, False):
        got = exact.exact_groups(docs_of(rows), every_hash=every).collect()
        assert len(got) == len(rows)
        keeps = {}
        for (i, _), n in zip(rows, norm, strict=True):
            members = [j for (j, _), m in zip(rows, norm, strict=True) if m == n]
            keeps[i, n] = (min((j for j in members if j is not None), default=None), len(members))
        want = sorted([(str(i), str(keeps[i, n][0]), keeps[i, n][1], hashlib.sha256(n.encode()).hexdigest()) for (i, _), n in zip(rows, norm, strict=True)])
        if every:
            assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
        assert sum(r["kept"] for r in got) == len(set(norm))
        assert all(str(r["doc_id"]) == str(r["keep_id"]) for r in got if r["kept"])
    left = exact.drop_copies(docs_of(rows))
    assert left.columns == docs_of(rows).columns
    assert sorted(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in left.collect()) == sorted(set(norm))


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] if ws else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def joined(prints):
    """The smallest index each distinct fingerprint is joined to by links of 3 bits."""
    label = np.arange(len(prints))
    near = [np.flatnonzero(np.bitwise_count(prints ^ p) <= 3) for p in prints]
    changed = True
    while changed:
        new = np.array([label[n].min() for n in near])
        new = np.array([new[x] for x in new])
        changed = (new != label).any()
        label = new
    return label


def test_fingerprints(docs_of, odd_rows):
    rows = [*odd_rows, (30, "One two"), (31, "one TWO"), (32, "word")]
    got = simhash.digest(docs_of(rows)).collect()
    want = {(str(i), f"{fingerprint(t):016x}") for i, t in rows if len(t or "") < 5000}
    have = {(str(r["doc_id"]), r["fingerprint"]) for r in got}
    assert want <= have
    comp = {r["doc_id"]: r["component_id"] for r in got}
    assert comp[2] == comp[1] == 1 and comp[3] == comp[4] == comp[5] == 3 and comp[31] == 30


@pytest.mark.parametrize("block", [4096, 5])
def test_links_of_clustered_fingerprints(spark, block):
    r = random.Random(block)
    prints = set()
    for _ in range(60):
        p = r.getrandbits(64)
        for _ in range(r.randrange(1, 40)):
            prints.add(p)
            for _ in range(r.randrange(1, 5)):
                p ^= 1 << r.randrange(64)
    p = np.array(sorted(prints), np.uint64)
    label = joined(p)
    df = spark.createDataFrame([(int(x),) for x in p.view(np.int64)], "fingerprint long")
    edges = simhash.links(df, block).collect()
    at = {int(x): i for i, x in enumerate(p.view(np.int64))}
    root = list(range(len(p)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for e in edges:
        a, b = sorted((find(at[e["src"]]), find(at[e["dst"]])))
        root[b] = a
    assert [find(i) for i in range(len(p))] == label.tolist()


def test_one_of_each_near_group_stays(docs_of):
    long = prose(1, 3000).split(" ")
    near = [" ".join([*long[:i], "changed", *long[i + 1 :]]) for i in (5, 1000, 2000)]
    rows = [(4, " ".join(long)), (2, near[0]), (9, near[1]), (None, near[2]), (2, near[0]), (3, prose(2, 300)), (None, prose(3, 200)), (1, None), (8, "")]
    assert len(set(joined(np.array([fingerprint(t) for t in (rows[0][1], *near)], np.uint64)).tolist())) == 1
    left = simhash.drop_near_copies(docs_of(rows)).collect()
    assert sorted(str(r["doc_id"]) for r in left) == ["1", "2", "3", "None"]


def repeats(texts):
    seen = {}
    for t in texts:
        for s in range(len(t) - 199):
            seen[t[s : s + 200]] = seen.get(t[s : s + 200], 0) + 1
    for t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - 199):
            if seen[t[s : s + 200]] > 1:
                gone[s : s + 200] = b"\1" * 200
        spans = len(re.findall(b"\1+", bytes(gone)))
        yield len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize("group", [suffixes.GROUP, 2])
def test_repeated_strings(docs_of, odd_rows, group, monkeypatch):
    monkeypatch.setattr(suffixes.repeats, "__defaults__", (group,))
    r = random.Random(6)
    part = prose(21, 90)
    texts = [prose(r.random(), 40) + part[a : a + n] + prose(r.random(), 20) for a in (0, 7, 150) for n in (199, 200, 201, 300)]
    texts += [part[:200], part[:199], "ab" * 300, "ab" * 101, "é" * 150 + prose(3, 50), "z" + "é" * 150, prose(8, 200) * 2, None, ""]
    texts += ["é".join([prose(9, 60)[:150]] * 5)]
    docs = [*enumerate(texts), (None, texts[0]), (50, texts[3]), (50, texts[3])]
    got = suffixes.digest(docs_of(docs)).collect()
    want = list(repeats([(t or "").encode() for _, t in docs]))
    key = lambda i, w: (str(i), *w)
    have = sorted(key(x["doc_id"], (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"])) for x in got)
    assert have == sorted(key(i, w) for (i, _), w in zip(docs, want, strict=True))


def test_long_texts_are_cut_with_overlap(docs_of, monkeypatch):
    r = random.Random(9)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    part = noise(400)
    text = noise(int(suffixes.BUFFER * 1.2)) + part + noise(suffixes.BUFFER) + part + noise(50)
    (row,) = suffixes.digest(docs_of([(1, text)])).collect()
    assert (row["n_bytes"], row["n_spans"]) == (len(text), 2) and 800 <= row["n_removed"] <= 812


def test_merge_goes_by_known_prefixes():
    r = random.Random(3)
    for _ in range(200):
        lists = [sorted("".join(r.choice("ab") for _ in range(r.randrange(12))).encode() for _ in range(r.randrange(9))) for _ in range(r.randrange(1, 9))]
        runs = []
        for strings in lists:
            shared, rests, sizes = suffixes.front_coded(strings)
            runs.append(suffixes.Run(np.array(shared, np.int64), rests, np.array(sizes, np.int64)))
        out, last = [], b""
        for run, place, shared, s in suffixes.merge(runs):
            assert s == lists[run][place]
            assert shared == suffixes.common(last, s, 0)
            out.append(s)
            last = s
        assert out == sorted(s for strings in lists for s in strings)


def test_chains_by_fenwick_tree():
    r = random.Random(1)
    for _ in range(100):
        pairs = sorted({(r.randrange(60), r.randrange(60)) for _ in range(r.randrange(1, 25))})
        xs, ys = [p[0] for p in pairs], [p[1] for p in pairs]
        best = [0.0] * len(pairs)
        for i, (x, y) in enumerate(pairs):
            before = [best[j] - passages.MOVE * (x - xs[j] + y - ys[j]) for j in range(i) if xs[j] < x and ys[j] < y]
            best[i] = passages.SEED + max(0.0, *before, 0.0)
        for chain in passages.chains(xs, ys)[:1]:
            score = passages.SEED * len(chain) - sum(passages.MOVE * (xs[b] - xs[a] + ys[b] - ys[a]) for a, b in zip(chain, chain[1:], strict=False))
            assert score >= max(best) - 1e-9
            assert all(xs[a] < xs[b] and ys[a] < ys[b] for a, b in zip(chain, chain[1:], strict=False))


def test_shared_passages(docs_of):
    fresh = iter(range(1000, 9999))
    new = lambda n: prose(next(fresh), n, vocabulary=5000)
    exact_, fuzzy, short, twice = new(60), new(120).split(" "), new(45), new(80)
    edit = lambda at: " ".join([*fuzzy[:at], "changed", *fuzzy[at + 1 :]])
    rows = [(i, f"{new(200)} {exact_} {new(100 + i)}") for i in range(12)]
    rows += [(20 + i, f"{new(30)} {edit(25 + 20 * i)} {new(70)}") for i in range(4)]
    rows += [(30 + i, f"{new(100)} {short} {new(50)}") for i in range(3)]
    rows += [(40, f"{new(50)} {twice} {new(20)} {twice}"), (41, new(500)), (42, new(49)), (43, None), (44, twice.upper())]
    got = passages.shared_passages(docs_of(rows)).collect()
    texts = {i: (t or "").lower().split() for i, t in rows}
    linked = {}
    for r in got:
        a, b = texts[r["doc_id"]][r["start"] : r["end"]], texts[r["ref_id"]][r["ref_start"] : r["ref_end"]]
        assert min(len(a), len(b)) >= passages.LEAST
        shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        assert len(shingles(a) & shingles(b)) >= 0.8 * len(shingles(a) | shingles(b))
        linked.setdefault(r["doc_id"], set()).add(r["ref_id"])
        linked.setdefault(r["ref_id"], set()).add(r["doc_id"])
    assert set(linked) == {*range(12), 20, 21, 22, 23, 40, 44}
    assert len(got) <= 11 + 6 + 2

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        return seen

    assert reach(0) == set(range(12)) and reach(20) == {20, 21, 22, 23} and reach(40) == {40, 44}
    for r in got:
        if r["doc_id"] in range(12):
            assert " ".join(texts[r["doc_id"]][r["start"] : r["end"]]) == exact_


@pytest.mark.parametrize("gap", [100, 300, 1000])
def test_every_passage_of_a_chain(docs_of, gap):
    """Also where the first ends, and the last begins, with an edit and 15 words that hold no seed."""
    r = random.Random(gap)
    new = lambda n: prose(r.random(), n, vocabulary=5000)
    one, two, three = new(60), new(60), new(60)
    edited = lambda t, at: " ".join([*t.split(" ")[:at], "changed", *t.split(" ")[at + 1 :]])
    rows = [(i, f"{new(40)} {a} {new(gap)} {two} {new(gap + 7 * i)} {b} {new(30)}") for i, (a, b) in enumerate([(one, three), (edited(one, 44), edited(three, 15)), (one, three)])]
    rows += [(10, f"{new(20)} {four} {new(gap)} {five}") for four, five in [(new(60), new(70))]]
    rows += [(11, f"{rows[3][1].split(' ', 20)[20]} {new(40)}"), (12, f"{' '.join(rows[3][1].split(' ')[20:80])} {new(gap)} {' '.join(rows[3][1].split(' ')[-70:])}")]
    got = passages.shared_passages(docs_of(rows)).collect()
    words = {i: t.split(" ") for i, t in rows}
    spans = lambda i: sorted((x["start"], x["end"]) for x in got if i == x["doc_id"]) + sorted((x["ref_start"], x["ref_end"]) for x in got if i == x["ref_id"])
    start = lambda i, part: next(k for k in range(len(words[i])) if words[i][k : k + 14] == part[:14])
    for i in range(3):
        for part in (one, two, three):
            at = start(i, part.split(" "))
            assert (at, at + 60) in spans(i), (i, at, spans(i))
    assert {(0, 60), (60 + gap, 130 + gap)} <= set(spans(12))


def test_passages_beside_a_longer_stretch_that_is_none():
    """A shared stretch under 50 words that scores best hides no passage with edits before or behind it."""
    r = random.Random(4)
    noise = lambda n: [r.randrange(1 << 30) for _ in range(n)]
    fuzzy, line = noise(60), noise(49)
    other = [*fuzzy[:20], *noise(1), *fuzzy[21:]]
    a, b = [*fuzzy, *noise(300), *line, *noise(300), *fuzzy], [*other, *noise(300), *line, *noise(300), *other]
    got = passages.passages(a, b, [30, 370, 739], [30, 370, 739])
    assert sorted(g[:4] for g in got) == [(0, 60, 0, 60), (709, 769, 709, 769)]


@pytest.mark.parametrize("block", [passages.BLOCK, 7])
def test_passages_round_a_frequent_line(docs_of, block):
    """Two texts each agree beyond a line of 42 words that all have: by 5 words on either side, or 16 words behind an edit."""
    r = random.Random(11)
    new = lambda n: prose(r.random(), n, vocabulary=5000)
    line = new(42)
    rows = [(i, f"{new(60)} {line} {new(60)}") for i in range(20)]
    for i in range(20, 40, 2):
        before, behind = new(5), new(5)
        rows += [(k, f"{new(60)} {before} {line} {behind} {new(60)}") for k in (i, i + 1)]
    for i in range(40, 50, 2):
        behind = new(16)
        rows += [(k, f"{new(60)} {line} {new(1)} {behind} {new(60)}") for k in (i, i + 1)]
    got = passages.shared_passages(docs_of(rows), block).collect()
    assert sorted((min(x["doc_id"], x["ref_id"]), max(x["doc_id"], x["ref_id"])) for x in got) == [(i, i + 1) for i in range(20, 50, 2)]


@pytest.mark.parametrize("block", [passages.BLOCK, 2])
def test_passages_of_texts_that_others_explain(docs_of, block):
    """All words that 3 and 4 share are in passages of 3 with 1 and 2; 20 and 21 go on 9 words behind an edit, 30 and 31 over 7 words put in."""
    r = random.Random(3)
    new = lambda n: prose(r.random(), n, vocabulary=5000)
    part = lambda text, *at: " ".join(text.split(" ")[slice(*at)])
    before, both, behind, line, long_, tail, other = new(10), new(55), new(10), new(42), new(40), new(9), new(30)
    inner = [f"{before} {part(both, 45)}", f"{part(both, 10, None)} {behind}", f"{before} {both} {behind}", both]
    rows = [(i + 1, f"{new(80)} {t} {new(80)}") for i, t in enumerate(inner)]
    rows += [(i, f"{new(80)} {line} {new(80)}") for i in range(10, 16)]
    rows += [(i, f"{new(80)} {long_} {new(1)} {tail} {new(80)}") for i in (20, 21)]
    rows += [(30, f"{new(80)} {line} {new(7)} {other} {new(80)}"), (31, f"{new(80)} {line} {other} {new(80)}")]
    got = passages.shared_passages(docs_of(rows).coalesce(1), block).collect()
    assert {(min(x["doc_id"], x["ref_id"]), max(x["doc_id"], x["ref_id"])) for x in got} == {(1, 3), (2, 3), (3, 4), (20, 21), (30, 31)}


def test_near_pairs_tie_what_hashes_tie():
    """Occurrences compared word by word and by hashes fall into the same sets: by an equal run, or one behind an edit."""
    r = random.Random(8)
    side = passages.REACH
    noise = lambda n: [r.randrange(1 << 30) for _ in range(n)]
    seed, rows = noise(passages.SEED), []
    before, behind = noise(side), noise(side)
    for k in range(24):
        left, right = noise(side), noise(side)
        if k % 3:  # runs of 25 words and more
            left[side - 5 :], right[: 4 + k] = before[side - 5 :], behind[: 4 + k]
        if k % 3 == 2:  # and on behind an edit, of one word or of one put in
            right = [*behind[:20], *noise(1), *behind[20 + k % 2 : side - 1 + k % 2]]
        rows.append([*left, *seed, *right])
    around = np.array(rows, np.int64)
    n = len(rows)
    zeros, no, rid = np.zeros(n, np.int64), np.zeros(n, bool), np.arange(n)
    sets = passages._Sets(n)
    near, hashed = passages._near_pairs([(0, n)], rid, zeros, no, around, sets), passages._pairs_by_hash(zeros, rid, zeros, no, around, rid)

    def parts(pairs):
        s = passages._Sets(n)
        for i, j in pairs:
            s.join(i, j)
        tops = s.tops(rid)
        return {frozenset(np.flatnonzero(tops == t).tolist()) for t in tops}

    assert parts(near) == parts(hashed) and any(len(p) > 1 for p in parts(near))


def test_only_needed_texts_are_moved(spark):
    texts = spark.range(400).selectExpr("(id div 100 << 33) + id % 100 AS rid", "array(id) AS words")
    wanted = texts.where("rid % 100 IN (3, 4)").select("rid")
    got = {r["rid"] for r in passages._needed(texts, wanted).collect()}
    assert got == {r["rid"] for r in wanted.collect()}


def test_only_ascii_letters_are_lowered(spark):
    df = spark.createDataFrame([("AbC \t Zz",), ("AbC ÉÀ\nZz",), ("abc ÉÀ zz",)], "text string")
    first, second, third = (r[0] for r in df.select(passages.word_hashes(df["text"])).collect())
    assert second == third and [second[0], second[2]] == first and len(first) == 2
