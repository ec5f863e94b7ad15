"""Relations of chunks and components against brute force."""

import random

from portolan.operators import relations


def test_related_chunks_are_distinct_without_a_shuffle_of_all_pairs(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice("ab"), rnd.choice([None, i - 1]), s := rnd.randrange(60), s + rnd.randrange(20)) for i in range(60)]
    # ids that come twice, with one place and with several, and nulls
    rows += [rows[3], rows[4], (5, "a", 4, 7, 9), (5, "b", 4, 7, 30), (None, "a", 1, 5, 6), (8, None, None, 5, 6), (9, "a", None, None, 6), (10, "a", None, 5, None)]
    edges = [(rnd.randrange(12), rnd.randrange(12)) for _ in range(60)] + [(None, 1), (2, None)]
    chunks = spark.createDataFrame(rows, "id int, file_path string, parent_id int, start_line int, end_line int")
    found = relations.related_chunks(chunks, spark.createDataFrame(edges, "src int, dst int"))
    want = set()
    for i, _, p, _, _ in rows:
        if p is not None:
            want |= {(i, p, "parent"), (p, i, "child")}
    for a, b in edges:
        want |= {(a, b, "edge"), (b, a, "edge")}
    for i, f, _, _, e in rows:
        want |= {(j, k, "near") for j, k in [(i, x[0]) for x in rows if None not in (f, e, x[3]) and x[1] == f and abs(x[3] - e) <= 10]}
    want = {w for w in want if None not in w and w[0] != w[1]}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # the pairs of all chunks are not made distinct once more
    assert found._jdf.queryExecution().optimizedPlan().nodeName() == "Union"


def test_cross_repo_references_read_components_once(spark):
    rnd = random.Random(6)
    names = ["Rate", "Fund", "Loan", "", None]
    texts = ['ServiceLocator.get("Rate") Fund', "long Loan(in string s)", "none", 'x.lookup("Loan")', None]
    rows = [(rnd.choice([1, 2, 3, None]), rnd.choice(["rule", "action", "corba", "jsp", "file", None]), rnd.choice(names), rnd.choice(texts)) for _ in range(80)]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    schema = "repo int, kind string, name string, text string"
    found = relations.cross_repo_references(spark.createDataFrame(rows, schema).mapInArrow(counted, schema)).collect()
    assert seen.value == len(rows)
    want = {}
    for r, k, _, x in rows:
        if x is None or not (k == "corba" or k == "action" and any(m in x for m in relations.REMOTE_CALLS)):
            continue
        for r2, k2, n, _ in rows:
            if None not in (r, r2) and r != r2 and n and n in x and k2 in ("rule", "action", "corba", "jsp") and (k == "action" or k2 == "corba"):
                want[r, k, r2, k2, n] = want.get((r, k, r2, k2, n), 0) + 1
    assert {tuple(f)[:5]: f.weight for f in found} == want and len(found) == len(want)
