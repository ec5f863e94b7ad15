"""Graph operators against small graphs and plain Python."""

import random

from portolan.operators import graph
from portolan.operators.relations import subgraph
from portolan.plans import migration


def edges(spark, pairs, **cols):
    return spark.createDataFrame([(a, b) for a, b in pairs], "src string, dst string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


DIAMOND = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "d")]


def test_breadth_first_depths(spark):
    e = edges(spark, DIAMOND)
    root = spark.createDataFrame([("a",)], "id string")
    assert rows(graph.transitive(e, root)) == [("a", "b", 1), ("a", "c", 1), ("a", "d", 2), ("a", "e", 3)]
    assert rows(graph.transitive(e, root, 2)) == [("a", "b", 1), ("a", "c", 1), ("a", "d", 2)]


def test_circular_pairs_and_cycles(spark):
    e = edges(spark, DIAMOND)
    assert rows(graph.circular_pairs(e)) == [("d", "e")]
    assert [(r.cycle_path, r.path_length, r.severity) for r in graph.cycles(e).collect()] == [(["d", "e", "d"], 3, "medium")]


def test_long_cycle_is_high(spark):
    ring = [(f"n{i}", f"n{(i + 1) % 6}") for i in range(6)]
    (found,) = graph.cycles(edges(spark, ring + [("n0", "n0")])).where("path_length > 2").collect()
    assert found.path_length == 7 and found.severity == "high"


def test_hubs(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    best = graph.hubs(nodes, edges(spark, DIAMOND), 1).first()
    assert (best.node, best.out_degree, best.in_degree, best.total_degree) == ("d", 1, 3, 4)


def test_waves(spark):
    nodes = spark.createDataFrame([("r1", 1.0), ("r2", 1.0), ("r3", 1.0), ("r4", 1.0)], "node string, weight double")
    got = {r.node: r.wave for r in graph.waves(nodes, edges(spark, [("r1", "r2"), ("r2", "r3")])).collect()}
    assert got == {"r3": 1, "r4": 1, "r2": 2, "r1": 3}


def test_stalled_wave_releases_the_lightest(spark):
    nodes = spark.createDataFrame([("r1", 40.0), ("r2", 10.0)], "node string, weight double")
    got = {r.node: r.wave for r in graph.waves(nodes, edges(spark, [("r1", "r2"), ("r2", "r1")])).collect()}
    assert got == {"r2": 1, "r1": 2}


def reference_waves(weights, pairs):
    """Round by round over all nodes: the free ones, else the lightest alone."""
    left, wave, out = dict(weights), 0, {}
    while left:
        wave += 1
        free = [n for n in left if not any(a == n and b in left and a != b for a, b in pairs)] or [min(left, key=lambda n: (left[n], n))]
        for n in free:
            out[n] = wave
            del left[n]
    return out


def test_waves_of_one_group_follow_the_rule(spark, monkeypatch):
    r = random.Random(4)
    for n, density in ((12, 0.9), (15, 0.2), (20, 0.12)):
        weights = {i: float(r.randrange(5)) for i in range(n)}
        ring = [(i, (i + 1) % n) for i in range(n)]
        pairs = ring + [(a, b) for a in range(n) for b in range(n) if a != b and r.random() < density]
        nodes = spark.createDataFrame(list(weights.items()), "node int, weight double")
        e = spark.createDataFrame(pairs, "src int, dst int")
        want = reference_waves(weights, pairs)
        assert {x.node: x.wave for x in graph.waves(nodes, e).collect()} == want
        if n == 12:
            assert {x.node: x.wave for x in graph.waves(nodes, e, group_links=0).collect()} == want


def test_large_clique_takes_few_rounds(spark, monkeypatch):
    made = []
    add = graph.RoundTable.add
    monkeypatch.setattr(graph.RoundTable, "add", lambda self, *a, **b: made.append(1) or add(self, *a, **b))
    n = 200
    nodes = spark.createDataFrame([(i, float(n - i)) for i in range(n)], "node int, weight double")
    e = spark.createDataFrame([(a, b) for a in range(n) for b in range(n) if a != b], "src int, dst int")
    got = {x.node: x.wave for x in graph.waves(nodes, e).collect()}
    assert got == {i: n - i for i in range(n)}
    assert len(made) <= 12


def test_components(spark):
    nodes = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "node string")
    assert rows(graph.components(nodes, edges(spark, [("r1", "r2")]))) == [("r1", "r1"), ("r2", "r1"), ("r3", "r3")]


def test_components_of_random_graph(spark):
    rnd = random.Random(3)
    n = 60
    pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(45)]
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    e = spark.createDataFrame(pairs, "src int, dst int")
    got = {r.node: r.component for r in graph.components(spark.range(n).selectExpr("CAST(id AS INT) AS node"), e).collect()}
    assert got == dict(enumerate(label))


def test_random_reach_paths_and_waves(spark):
    rnd = random.Random(5)
    n = 14
    pairs = sorted({(rnd.randrange(n), rnd.randrange(n)) for _ in range(20)})
    pairs = [(a, b) for a, b in pairs if a != b]
    nxt = {a: [b for x, b in pairs if x == a] for a in range(n)}
    depth = {}
    for s in range(n):
        level, seen = {s}, set()
        for d in range(1, n + 1):
            level = {b for a in level for b in nxt[a]} - seen
            for b in level:
                depth[(s, b)] = d
            seen |= level
    e = spark.createDataFrame(pairs, "src int, dst int")
    assert {(r.root, r.node): r.depth for r in graph.reach(e).collect()} == depth

    trails = []

    def walk(path):
        for b in nxt[path[-1]]:
            if b not in path:
                trails.append(path + [b])
                walk(path + [b])

    for s in range(n):
        walk([s])
    assert sorted(r.path for r in graph.paths(e).collect()) == sorted(trails)
    loops = sorted(p + [p[0]] for p in trails if p[0] in nxt[p[-1]] and p[0] == min(p))
    assert sorted(r.cycle_path for r in graph.cycles(e).collect()) == loops

    dag = [(max(p), min(p)) for p in pairs]
    nodes = spark.createDataFrame([(i, float(i)) for i in range(n)], "node int, weight double")
    wave = {r.node: r.wave for r in graph.waves(nodes, spark.createDataFrame(dag, "src int, dst int")).collect()}
    assert all(wave[a] > wave[b] for a, b in dag)


def test_migration_waves_with_cycles(spark, tables):
    """The registered query against a plain loop over the same repositories."""
    from portolan.queries import load

    got = {r.repo: r.wave for r in load()[0]["migration_waves_with_cycles"](tables).collect()}
    weight = {r.repo: r.complexity for r in tables.repositories.collect()}
    links = {(r.src, r.dst) for r in tables.repo_edges.collect()}
    want = {}
    for block in {r // 5 for r in weight}:
        own = {r: w for r, w in weight.items() if r // 5 == block}
        want |= reference_waves(own, [(a, b) for a, b in links if a in own])
    assert got == want


def test_subgraph_depth(spark):
    nodes = spark.createDataFrame([(x, "R", "File") for x in "ab"] + [(x, "S", "Odd") for x in "cde"], "id string, repo string, label string")
    got = rows(subgraph(nodes, edges(spark, DIAMOND), "R", 1))
    assert got == [("a", 0, "File"), ("b", 0, "File"), ("c", 1, "Unknown"), ("d", 1, "Unknown")]


def test_slices(spark):
    repos = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "repo string")
    e = spark.createDataFrame([("r1", "r2", 4)], "src string, dst string, weight int")
    shared = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "repo string")
    got = {r.component: (r.size, r.effort, r.risk) for r in migration.slices(repos, e, shared).collect()}
    assert got == {"r1": (2, 2, 1), "r3": (1, 1, 1)}
