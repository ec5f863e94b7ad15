"""Iterative graph operators over ``edges(src, dst)``.

Each round is one equi-join on the frontier and one anti-join on what is already
known; rounds are written tables (see session.RoundTable). A hub node makes a
skewed join key, which adaptive execution splits; the distinct before each
anti-join is pre-aggregated on the map side.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portolan.operators.condense import bits_of, cyclic_core, longest_paths, others_bits, plain_links, strong_components
from portolan.session import RoundTable, written


def _links(edges: DataFrame) -> DataFrame:
    return written(edges.select("src", "dst").distinct(), "links")


def reach(edges: DataFrame, roots: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """Every node reachable from each root with its shortest depth.

    Rows ``(root, node, depth)``. A root shows up as its own node only when it lies
    on a cycle. ``roots`` is a one-column frame; without it every source node is one.
    """
    links = _links(edges)
    start = links
    if roots is not None:
        start = links.join(roots.toDF("src").distinct(), "src", "left_semi")
    rounds = RoundTable(edges.sparkSession, "reach")
    frontier = rounds.add(start.select(F.col("src").alias("root"), F.col("dst").alias("node"), F.lit(1).alias("depth")))
    depth = 1
    while max_depth is None or depth < max_depth:
        depth += 1
        step = (
            frontier.join(links, F.col("node") == F.col("src"))
            .select("root", F.col("dst").alias("node"))
            .distinct()
            .join(rounds.all().select("root", "node"), ["root", "node"], "left_anti")
        )
        frontier = rounds.add(step.select("root", "node", F.lit(depth).alias("depth")))
        if not rounds.rows:
            break
    return rounds.all()


def transitive(edges: DataFrame, roots: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """Dependencies of each root, the root itself left out."""
    return reach(edges, roots, max_depth).where("root <> node")


def paths(
    edges: DataFrame,
    roots: DataFrame | None = None,
    max_depth: int | None = None,
    label: str | None = None,
) -> DataFrame:
    """Every simple path from the roots, one row per path.

    Rows ``(root, node, depth, path[, labels])``; ``labels`` chains the edge column
    ``label`` (a scope, say) along the path. No path visits a node twice.
    """
    keep = ["src", "dst"] + ([label] if label else [])
    links = written(edges.select(*keep).distinct(), "links")
    start = links.where("src <> dst")
    if roots is not None:
        start = start.join(roots.toDF("src").distinct(), "src", "left_semi")
    first = [
        F.col("src").alias("root"),
        F.col("dst").alias("node"),
        F.lit(1).alias("depth"),
        F.array("src", "dst").alias("path"),
    ]
    if label:
        first.append(F.array(label).alias("labels"))
    rounds = RoundTable(edges.sparkSession, "paths")
    frontier = rounds.add(start.select(*first))
    depth = 1
    while max_depth is None or depth < max_depth:
        depth += 1
        cols = ["root", F.col("dst").alias("node"), F.lit(depth).alias("depth"), F.array_append("path", F.col("dst")).alias("path")]
        if label:
            cols.append(F.array_append("labels", F.col(label)).alias("labels"))
        step = frontier.join(links, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        frontier = rounds.add(step.select(*cols))
        if not rounds.rows:
            break
    return rounds.all()


def reach_counts(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Direct, total and transitive dependency counts per node with an outgoing edge.

    Without a depth the counts come from sets of bits; up to a depth from the closure that far.
    """
    if max_depth is not None:
        near = reach(edges, max_depth=max_depth).where("root <> node").groupBy(F.col("root").alias("node"))
        return near.agg(F.count_if(F.col("depth") == 1).alias("direct_deps"), F.count("*").alias("total_deps"), F.count_if(F.col("depth") > 1).alias("transitive_deps"))
    links = plain_links(edges)
    nodes = bits_of(links.select(F.col("dst").alias("node")).distinct(), "node")
    total = others_bits(links, nodes).groupBy("node").agg(F.sum(F.bit_count("bits")).alias("total_deps"))
    direct = links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("direct_deps"))
    return direct.join(total, "node").select("node", "direct_deps", "total_deps", (F.col("total_deps") - F.col("direct_deps")).alias("transitive_deps"))


def circular_pairs(edges: DataFrame) -> DataFrame:
    """Pairs ``node_a < node_b`` that reach each other, that is of one strong component."""
    part = written(strong_components(edges), "strong")
    other = part.select(F.col("node").alias("node_b"), "component")
    return part.withColumnRenamed("node", "node_a").join(other, "component").where("node_a < node_b").select("node_a", "node_b")


def cycles(edges: DataFrame, max_len: int | None = None) -> DataFrame:
    """E5: simple cycles, each once, written from its smallest node.

    Rows ``(cycle_path, path_length, severity)``; the path repeats the start at its
    end and severity is high when it has more than five entries. A node with an edge
    to itself is a cycle of one node. ``max_len`` bounds the number of distinct nodes;
    without it the search runs until no open path is left. A path stays inside the strong component of its start.
    """
    spark = edges.sparkSession
    part = written(strong_components(edges), "strong")
    of = lambda side: part.select(F.col("node").alias(side), F.col("component").alias(f"{side}_part"))
    inside = plain_links(edges).join(of("src"), "src").join(of("dst"), "dst").where("src_part = dst_part").select("src", "dst")
    inside = written(inside, "inside")
    loops = edges.where("src = dst").select(F.array("src", "dst").alias("cycle_path")).distinct()
    rounds = RoundTable(spark, "cycles")
    end, start = F.element_at("path", -1), F.element_at("path", 1)
    open_paths = rounds.add(inside.where("dst > src").select(F.array("src", "dst").alias("path"), F.lit(False).alias("closed")))
    length = 2
    while rounds.rows and (max_len is None or length <= max_len):
        step = open_paths.select("path", start.alias("start"), end.alias("end")).join(inside, F.col("end") == F.col("src"))
        onward = (F.col("dst") > F.col("start")) & ~F.array_contains("path", F.col("dst"))
        grown = step.where((F.col("dst") == F.col("start")) | onward)
        open_paths = rounds.add(grown.select(F.array_append("path", F.col("dst")).alias("path"), (F.col("dst") == F.col("start")).alias("closed"))).where("NOT closed")
        length += 1
    found = loops.unionByName(rounds.all().where("closed").select(F.col("path").alias("cycle_path")))
    size = F.size("cycle_path")
    return found.select(
        "cycle_path", size.alias("path_length"), F.when(size > 5, "high").otherwise("medium").alias("severity")
    )


def critical_paths(edges: DataFrame, n: int = 10, max_depth: int | None = None) -> DataFrame:
    """The ``n`` longest simple paths that cannot be extended, more than two nodes each.

    Without a depth only the best paths of every node are kept (`longest_paths`); up to a depth all are listed that far.
    """
    if max_depth is None:
        ends = longest_paths(edges, n).where("size(path) > 2")
    else:
        every = paths(edges, max_depth=max_depth)
        onward = every.join(edges.select("src", "dst").distinct(), F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        ends = every.where("size(path) > 2").join(onward.select("path").distinct(), "path", "left_anti")
    return ends.select("path", F.size("path").alias("path_length")).orderBy(F.desc("path_length"), "path").limit(n)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Weakly connected components, rows ``(node, component)``, the smallest member names it.

    Alternates the large-star and small-star steps: both only take a minimum per node
    and hand it to that node's neighbours, so no component is ever gathered in one task.
    """
    ids = nodes.select(F.col(nodes.columns[0]).alias("node")).distinct()
    # only links inside the node set count
    inside = (
        edges.select("src", "dst")
        .where("src <> dst")
        .join(ids.withColumnRenamed("node", "src"), "src", "left_semi")
        .join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi")
    )
    stars = RoundTable(nodes.sparkSession, "stars")
    # a round that changes nothing leaves count and digest as they were
    digest = {"digest": F.bit_xor(F.xxhash64("u", "v")), "total": F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))}
    pairs = stars.add(inside.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), **digest)
    mark = stars.marks
    while stars.rows:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                )
            ).alias("p")
        )
        pairs = stars.add(small.select("p.u", "p.v").where("u <> v").distinct(), **digest)
        if stars.marks == mark:
            break
        mark = stars.marks
    named = pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return ids.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


#: Links of one stuck group that a single task takes; larger groups go node by node through Spark.
GROUP_LINKS = 100_000


def waves(nodes: DataFrame, edges: DataFrame, key: str = "node", weight: str = "weight", group_links: int = GROUP_LINKS) -> DataFrame:
    """Dependency waves, rows ``nodes + wave``.

    A source waits for its targets. What cycles hold up falls into connected groups, which do not wait for
    each other: a group starts when all that it waits for outside is done, and whenever nothing in it
    is free its lightest node (ties by key; null and NaN are lightest of all) is released alone. Free nodes take a round per
    wave; each stuck group is worked through in one task, as long as it has at most ``group_links`` links.
    """
    spark = nodes.sparkSession
    cols = nodes.columns
    left = RoundTable(spark, "nodes")
    todo = left.add(nodes)
    links = (
        edges.select("src", "dst")
        .where("src <> dst")
        .distinct()
        .join(todo.select(F.col(key).alias("src")), "src", "left_semi")
        .join(todo.select(F.col(key).alias("dst")), "dst", "left_semi")
    )
    every = links = written(links, "links")
    done = RoundTable(spark, "waves")
    wave = 0
    while left.rows:
        wave += 1
        got = done.add(todo.join(links.select(F.col("src").alias(key)).distinct(), key, "left_anti").select(*cols, F.lit(wave).alias("wave")))
        if not done.rows:
            break
        out = got.select(key)
        todo = left.add(todo.join(out, key, "left_anti").select(*cols))
        # what is done waits for nothing itself, so only links into it go
        links = written(links.join(out.withColumnRenamed(key, "dst"), "dst", "left_anti").select("src", "dst"), "links")
    if not left.rows:
        return done.all()
    part = written(components(todo.select(key), links), "stuck")
    of = links.join(part.withColumnRenamed("node", "src"), "src").select("component", "src", "dst")
    sizes = of.groupBy("component").agg(F.count("*").alias("n"))
    waited = (
        every.join(part.withColumnRenamed("node", "src"), "src")
        .join(done.all().select(F.col(key).alias("dst"), "wave"), "dst")
        .groupBy("component")
        .agg(F.max("wave").alias("base"))
    )
    base = written(sizes.join(waited, "component", "left").na.fill(0, ["base"]), "groups")
    members = todo.join(part.withColumnRenamed("node", key), key).join(base, "component")
    kind = nodes.schema[key].dataType.simpleString()

    def work(own: pd.DataFrame, inner: pd.DataFrame) -> pd.DataFrame:
        order = wave_order(list(zip(own["key"], own["weight"], strict=True)), list(zip(inner["src"], inner["dst"], strict=True)))
        return pd.DataFrame({"_key": list(order), "wave": [w + int(own["base"].iloc[0]) for w in order.values()]})

    own = members.where(F.col("n") <= group_links).select("component", "base", F.col(key).alias("key"), F.col(weight).cast("double").alias("weight"))
    inner = of.join(base.where(F.col("n") <= group_links), "component", "left_semi").select("component", "src", "dst")
    own, inner = written(own, "members"), written(inner, "inner")
    waved = own.groupBy("component").cogroup(inner.groupBy("component")).applyInPandas(work, f"_key {kind}, wave int")
    done.add(todo.join(waved.withColumnRenamed("_key", key), key).select(*cols, "wave"))
    large = base.where(F.col("n") > group_links)
    if not large.isEmpty():
        rest = members.join(large.select("component"), "component", "left_semi")
        _stepwise(rest, of.join(large.select("component"), "component", "left_semi"), cols, key, weight, done)
    return done.all()


def wave_order(members: list[tuple], links: list[tuple]) -> dict:
    """Waves of one group, counted from 1: free nodes together, else the lightest alone (no weight: lightest of all)."""
    waiting = {k: 0 for k, _ in members}
    before: dict = {k: [] for k in waiting}
    for src, dst in links:
        waiting[src] += 1
        before[dst].append(src)
    by_weight = sorted(members, key=lambda m: (m[1] is not None and m[1] == m[1], 0 if m[1] is None or m[1] != m[1] else m[1], m[0]))
    light = iter([k for k, _ in by_weight])
    free, order, wave = [k for k, n in waiting.items() if not n], {}, 0
    while len(order) < len(waiting):
        wave += 1
        if not free:
            free = [next(k for k in light if k not in order)]
        out, free = free, []
        for k in out:
            order[k] = wave
        for k in out:
            for s in before[k]:
                waiting[s] -= 1
                if not waiting[s] and s not in order:
                    free.append(s)
    return order


def _stepwise(members: DataFrame, links: DataFrame, cols: list[str], key: str, weight: str, done: RoundTable) -> None:
    """The same for groups too large for a task: each round releases what is free, or each group's lightest."""
    spark = members.sparkSession
    left = RoundTable(spark, "large")
    todo = left.add(members.select("component", "base", *cols))
    links = written(links.select("component", "src", "dst"), "links")
    known = F.col(weight).cast("double")
    known = F.when(~F.isnan(known), known)
    step = 0
    while left.rows:
        step += 1
        free = todo.join(links.select(F.col("src").alias(key)).distinct(), key, "left_anti")
        stalled = todo.join(free.select("component").distinct(), "component", "left_anti")
        lightest = stalled.groupBy("component").agg(F.min(F.struct(known.isNotNull().alias("has"), known.alias("known"), key)).alias("m")).select(F.col(f"m.{key}").alias(key))
        out = written(free.select(key).unionByName(lightest), "released")
        done.add(todo.join(out, key, "left_semi").select(*cols, (F.col("base") + step).cast("int").alias("wave")))
        todo = left.add(todo.join(out, key, "left_anti").select("component", "base", *cols))
        links = written(
            links.join(out.withColumnRenamed(key, "src"), "src", "left_anti").join(out.withColumnRenamed(key, "dst"), "dst", "left_anti").select("component", "src", "dst"), "links"
        )


def hubs(nodes: DataFrame, edges: DataFrame, n: int | None = 10) -> DataFrame:
    """Distinct outgoing, incoming and total neighbours; the ``n`` best connected."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("in_degree"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ranked = (
        nodes.join(out, "node", "left")
        .join(into, "node", "left")
        .select(
            "node",
            zero("out_degree").alias("out_degree"),
            zero("in_degree").alias("in_degree"),
            (zero("out_degree") + zero("in_degree")).alias("total_degree"),
        )
        .orderBy(F.desc("total_degree"), "node")
    )
    return ranked if n is None else ranked.limit(n)


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes no edge touches."""
    return nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti").join(
        edges.select(F.col("dst").alias("node")), "node", "left_anti"
    )
