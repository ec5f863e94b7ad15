"""Components, bit sets and path counts against plain Python on random graphs."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from portolan.operators import condense, graph
from portolan.operators import dependencies as deps


def frame(spark, pairs, kind="int"):
    return spark.createDataFrame([(a, b) for a, b in pairs], f"src {kind}, dst {kind}")


def random_pairs(seed, n, links, loops=True):
    r = random.Random(seed)
    return [(a, b) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(links)) if loops or a != b]


def closure(pairs):
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    out = {}
    for root in after:
        seen, todo = set(), list(after[root])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after.get(x, ())
        out[root] = seen
    return out


def simple_paths(pairs):
    after = {}
    for a, b in pairs:
        if a != b:
            after.setdefault(a, set()).add(b)
    out, todo = [], [(a, b) for a in after for b in after[a]]
    while todo:
        p = todo.pop()
        out.append(p)
        todo += [(*p, b) for b in after.get(p[-1], ()) if b not in p]
    ends = [p for p in out if not any(b not in p for b in after.get(p[-1], ()))]
    return out, ends


# two components that lead to each other one way, tails before, between and behind, a long ring
SHAPES = {
    "none": [],
    "loop": [(1, 1)],
    "chain": [(i, i + 1) for i in range(9)],
    "ring": [(i, (i + 1) % 9) for i in range(9)],
    "two": [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 5), (6, 7), (0, 1), (0, 5), (7, 8), (9, 8), (2, 8)],
    "sparse": random_pairs(1, 14, 17),
    "dense": random_pairs(2, 7, 24),
    "wide": random_pairs(3, 40, 46),
    "copies": random_pairs(4, 10, 13) * 2,
}


# all of them side by side, each on node numbers of its own
SHAPES["all"] = [(100 * i + a, 100 * i + b) for i, shape in enumerate(list(SHAPES.values())) for a, b in shape]


@pytest.fixture(params=["none", "all"])
def pairs(request):
    return SHAPES[request.param]


def test_components_and_what_they_give(spark, pairs):
    reach = closure(pairs)
    both = {(a, b) for a in reach for b in reach[a] if a != b and a in reach.get(b, ())}
    e = frame(spark, pairs)
    want = {a: min(a, min(b for x, b in both if x == a)) for a, _ in both}
    assert {r.node: r.component for r in condense.strong_components(e).collect()} == want
    assert sorted(tuple(r) for r in graph.circular_pairs(e).collect()) == sorted((a, b) for a, b in both if a < b)
    counts = {r.node: (r.direct_deps, r.total_deps, r.transitive_deps) for r in graph.reach_counts(e).collect()}
    direct = {a: len({b for x, b in pairs if x == a and b != a}) for a in reach}
    assert counts == {a: (direct[a], len(reach[a] - {a}), len(reach[a] - {a}) - direct[a]) for a in reach if reach[a] - {a}}


def test_paths_are_counted_and_ranked(spark, pairs):
    e = frame(spark, pairs)
    every, ends = simple_paths(pairs)
    got = {r.node: (int(r.paths), int(r.depths), r.deepest) for r in condense.path_counts(e).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    depths = lambda a: [len(p) - 1 for p in every if p[0] == a]
    assert got == {a: (len(depths(a)), sum(depths(a)), max(depths(a), default=0)) for a in nodes}
    through = Counter(x for p in every for x in p)
    assert {r.node: int(r.paths) for r in condense.path_shares(e).collect()} == {a: through[a] for a in nodes}
    best = sorted((p for p in ends if len(p) > 2), key=lambda p: (-len(p), p))[:5]
    assert [tuple(r.path) for r in graph.critical_paths(e, 5).collect()] == best


def test_rounds_hold_few_paths(spark):
    e = frame(spark, SHAPES["two"])
    per = condense.longest_paths(e, 2).groupBy("node").count().agg(F.max("count")).first()[0]
    assert per == 2
    with pytest.raises(ValueError, match="over 1 edges"):
        condense.longest_paths(e, 3, limit=1)


def test_small_chunks_give_the_same(spark):
    pairs = SHAPES["two"] + SHAPES["wide"]
    e = frame(spark, pairs)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(condense.longest_paths(e, 3, chunk=2)) == rows(condense.longest_paths(e, 3))
    assert rows(condense.path_counts(e, chunk=1)) == rows(condense.path_counts(e))
    assert rows(condense.strong_components(e, chunk=1)) == rows(condense.strong_components(e))


def test_text_nodes(spark):
    name = lambda x: f"n{x:03}"
    pairs = [(name(a), name(b)) for a, b in SHAPES["two"]]
    e = frame(spark, pairs, "string")
    reach = closure(pairs)
    assert {r.node: r.total_deps for r in graph.reach_counts(e).collect()} == {a: len(reach[a] - {a}) for a in reach}
    assert [r.path for r in graph.critical_paths(e, 1).collect()] == [list(map(name, [0, 1, 2, 3, 4, 5, 6, 7, 8]))]


def test_cycles_of_random_graphs(spark):
    for shape in ("loop", "all"):
        pairs = SHAPES[shape]
        every, _ = simple_paths(pairs)
        links = set(pairs)
        want = {(*p, p[0]) for p in every if p[0] == min(p) and (p[-1], p[0]) in links} | {(a, a) for a, b in links if a == b}
        got = [tuple(r.cycle_path) for r in graph.cycles(frame(spark, pairs)).collect()]
        assert len(got) == len(want) and set(got) == want


def test_licenses_and_versions_without_a_closure(spark):
    r = random.Random(9)
    pairs = SHAPES["two"] + SHAPES["wide"]
    reach = closure(pairs)
    held = [(i, r.choice("ABC")) for i in range(40) for _ in range(r.randrange(3))]
    roots = [(r.randrange(4), r.randrange(40)) for _ in range(30)]
    licenses = spark.createDataFrame(held, "artifact int, license string")
    repo_roots = spark.createDataFrame(roots, "repo int, artifact int")
    per = {(q, a, x): len({n for n in reach.get(a, set()) - {a} if (n, x) in held}) for q, a in roots for x in "ABC"}
    got = {(x.repo, x.root, x.license): x.dependencies for x in deps.reached_licenses(repo_roots, frame(spark, pairs), licenses).collect()}
    assert got == {k: n for k, n in per.items() if n}
    assert {tuple(x) for x in deps.licenses_by_repository(repo_roots, frame(spark, pairs), licenses).collect()} == {(q, x) for (q, _, x), n in per.items() if n}
    bad = spark.createDataFrame([("A", "B")], "license string, conflicting string")
    found = {tuple(x) for x in deps.license_conflicts(repo_roots, frame(spark, pairs), licenses, bad).collect()}
    assert found == {(q, a, "A", per[q, a, "A"], "B", per[q, a, "B"]) for q, a in roots if per[q, a, "A"] and per[q, a, "B"]}
    own = [(i, r.choice("gh"), "x", r.choice(["1", "2", "3", None])) for i in range(40)]
    coordinates = spark.createDataFrame(own, "node int, group_id string, artifact_id string, version string")
    want = {}
    for a, nodes in reach.items():
        for g in "gh":
            n = len({v for i, q, _, v in own if i in nodes and q == g and v})
            if n > 1:
                want[a, g, "x"] = n
    assert {tuple(x)[:3]: x.version_count for x in deps.closure_conflicts(frame(spark, pairs), coordinates).collect()} == want
    everything = [i for i in range(40)]
    many = spark.createDataFrame([(i, "g", "x", str(i)) for i in everything] + [(i, "g", "x", f"v{i}") for i in range(100)], "node int, group_id string, artifact_id string, version string")
    got = {x.root: x.version_count for x in deps.closure_conflicts(frame(spark, pairs), many).collect()}
    assert got == {a: n for a in reach if (n := 2 * len([i for i in reach[a] if i < 40])) > 1}


def test_waves_take_no_weight_as_lightest_on_both_ways(spark):
    nodes = spark.createDataFrame([(1, 5.0), (2, float("nan")), (3, None), (4, 1.0)], "node int, weight double")
    ring = frame(spark, [(1, 2), (2, 3), (3, 4), (4, 1)])
    own = {r.node: r.wave for r in graph.waves(nodes, ring).collect()}
    assert own == {r.node: r.wave for r in graph.waves(nodes, ring, group_links=0).collect()}
    assert own[2] == 1
