"""Every row of the tables that a view names counts."""

from portolan.queries.report_queries import shared_base


def one(t, text):
    return t.sql(text).first()[0]


def test_graph_views_hold_all_order_lines(tables):
    t, lines = tables, tables.lineitem.count()
    assert one(t, "SELECT sum(weight) FROM repo_edges") == lines == one(t, "SELECT sum(weight) FROM layered_edges")
    assert t.repo_artifacts.count() == lines == shared_base(t).count()
    keys = t.lineitem.selectExpr("l_orderkey * 16 + l_linenumber * 2 + 1 AS src").distinct()
    assert keys.join(t.dep_edges, "src", "left_anti").count() == 0
    assert t.dep_edges.select("src").distinct().count() == keys.count()
    # a line's link may fall on another's where multiples of 7 step aside
    assert t.part_edges.count() >= 0.75 * t.lineitem.selectExpr("l_partkey", "(l_partkey * 7 + l_orderkey) % 200").distinct().count()


def test_node_views_hold_all_rows(tables):
    t = tables
    assert t.artifacts.count() == t.part.count() + t.lineitem.select("l_orderkey", "l_linenumber").distinct().count()
    assert t.licenses.count() == t.artifacts.count()
    ends = t.dep_edges.selectExpr("dst AS id").unionByName(t.dep_edges.selectExpr("src AS id"))
    assert ends.join(t.artifacts, "id", "left_anti").count() == 0


def test_graph_views_have_no_loops(tables):
    t = tables
    assert not any(getattr(t, v).where("src = dst").count() for v in ("dep_edges", "part_edges", "repo_edges", "chunk_edges"))
