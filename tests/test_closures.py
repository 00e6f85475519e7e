"""Closures, failures and cycles in lineage, by plain walks, and on a long chain."""

import random

from ballast.operators import graph

EDGES = "group int, parent int, child int, relation string"


def reach(edges, seeds):
    found, todo = set(seeds), list(seeds)
    while todo:
        g, n = todo.pop()
        for nxt in edges.get((g, n), ()):
            if (g, nxt) not in found:
                found.add((g, nxt))
                todo.append((g, nxt))
    return found


def lineage(seed, cyclic):
    rng = random.Random(seed)
    rows = set()
    for g in range(6):
        n = rng.randint(2, 14)
        for _ in range(rng.randint(1, 22)):
            a, b = rng.randrange(n), rng.randrange(n)
            if cyclic or a < b:
                rows.add((g, a, b, "DERIVED_FROM"))
    return sorted(rows)


def test_closures_and_cycles(spark):
    for seed, cyclic in ((1, False), (2, True), (3, True)):
        rows = lineage(seed, cyclic)
        df = spark.createDataFrame(rows + rows[:3] + [(0, 0, 1, "OTHER")], EDGES)
        up, down = {}, {}
        for g, a, b, _ in rows:
            up.setdefault((g, b), set()).add(a)
            down.setdefault((g, a), set()).add(b)
        nodes = sorted({(g, x) for g, a, b, _ in rows for x in (a, b)})
        members = spark.createDataFrame(nodes, "group int, record_id int")
        seeds = nodes[::4]
        direct = spark.createDataFrame([(g, f"r{n % 2}", n) for g, n in seeds], "group int, role string, record_id int")
        got = {tuple(r) for r in graph.ancestors(direct, df, members).collect()}
        assert got == {(g, f"r{n % 2}", m) for g, n in seeds for _, m in reach(up, [(g, n)])}
        stays = {v for v in nodes if any(u in reach(down, {(u[0], x) for x in down.get(u, ())}) and v in reach(down, [u]) for u in nodes if u[0] == v[0])}
        only = df.where("relation = 'DERIVED_FROM'")
        assert {tuple(r) for r in graph.unpeeled(only).collect()} == stays and (cyclic or not stays)
        derived = spark.createDataFrame([v for v in nodes if v[1] % 5], "group int, record_id int")
        bad = seeds[::2]
        through = {k: {x for x in v if x % 5} for k, v in down.items()}
        first = {(g, x) for g, n in bad for x in through.get((g, n), ())}
        want = reach(through, first)
        assert {tuple(r) for r in graph.tainted(spark.createDataFrame(bad, "group int, record_id int"), only, derived).collect()} == want


def test_a_chain_of_ten_thousand_records(spark, monkeypatch):
    written = []
    cut = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(1) or cut(df))
    n = 10_000
    chain = spark.range(n - 1).selectExpr("0 group", "cast(id as int) parent", "cast(id + 1 as int) child", "'DERIVED_FROM' relation")
    direct = spark.createDataFrame([(0, "r", n - 1)], "group int, role string, record_id int")
    members = spark.range(n).selectExpr("0 group", "cast(id as int) record_id")
    assert graph.ancestors(direct, chain, members).count() == n
    assert len(written) < 21  # 14 squarings, and the pass over them in threes
    assert graph.unpeeled(chain).count() == 0
    ring = chain.unionByName(spark.createDataFrame([(0, n - 1, 0, "DERIVED_FROM")], EDGES))
    assert graph.unpeeled(ring).count() == n


def test_no_edges(spark):
    none = spark.createDataFrame([], EDGES)
    direct = spark.createDataFrame([(0, "r", 1)], "group int, role string, record_id int")
    ids = spark.createDataFrame([], "group int, record_id int")
    assert [tuple(r) for r in graph.ancestors(direct, none, ids).collect()] == [(0, "r", 1)]
    assert graph.unpeeled(none).count() == 0 == graph.tainted(ids, none, ids).count()
