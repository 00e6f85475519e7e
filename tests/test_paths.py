"""Cheapest simple paths by deviations against enumeration and a search of one pair at a time."""

import heapq
import random

from ballast.operators import paths


def walk(edges, node, dest, seen, cost=0.0, path=()):
    if node == dest:
        yield (round(cost, 9), list(path))
        return
    for a, b, s, c in edges:
        if a == node and b not in seen:
            yield from walk(edges, b, dest, seen | {b}, cost + c, (*path, s))


def frames(spark, edges, wanted):
    return spark.createDataFrame(edges, "src int, dst int, seg_id int, cost double"), spark.createDataFrame(wanted, "source int, dest int")


def answer(edges, a, b, k):
    return sorted(walk(edges, a, b, {a}))[:k]


def test_all_lengths_ties_and_parallel_edges(spark):
    rng = random.Random(4)
    chain = [(i, i + 1, i, 1.0) for i in range(6)]
    more = [(100 + k, rng.randrange(8), rng.randrange(8)) for k in range(22)]
    edges = chain + [(20 + a, 20 + b, k, 1.0 + (k * 37 % 4) / 2) for k, a, b in more if a != b] + [(3, 3, 90, 1.0), (20, 21, 91, 1.0), (20, 21, 92, 1.0)]
    wanted = [(0, 6), (0, 6), (6, 0), (5, 5), (1, 77), (None, 1)] + [(20 + a, 20 + b) for a in range(8) for b in range(8) if a != b]
    for k in (1, 3, 9):  # 9: more than some pairs have
        got = paths.k_cheapest_paths(*frames(spark, edges, wanted), k).collect()
        want = sorted((a, b, n + 1, c, p) for a, b in set(wanted) if a is not None and a != b for n, (c, p) in enumerate(answer(edges, a, b, k)))
        assert sorted((r.source, r.dest, r["rank"], r.cost, r.path) for r in got) == want
    found = {}
    for r in paths.simple_paths(*frames(spark, edges, wanted[:5]), 3).collect():
        found.setdefault((r.source, r.dest), []).append((r.status, r.cost, r.path))
    assert found == {(0, 6): [("FOUND", 6.0, [0, 1, 2, 3, 4, 5])], (6, 0): [("NO_PATH", None, None)], (5, 5): [("SAME_NODE", 0.0, [])], (1, 77): [("NO_PATH", None, None)]}
    assert paths.k_cheapest_paths(*frames(spark, [], wanted), 3).count() == 0 == paths.k_cheapest_paths(*frames(spark, edges, []), 3).count()


def test_least_cost_paths(spark):
    rng = random.Random(5)
    edges = [(a, b, k, float(rng.randint(1, 4))) for k in range(40) if (a := rng.randrange(12)) != (b := rng.randrange(12))] + [(30 + i, 31 + i, 500 + i, 1.0) for i in range(40)]
    df, _ = frames(spark, edges, [])
    want = {(a, b): found[0] for a in range(80) for b in range(80) if a != b and (a < 12) == (b < 12) and (found := answer(edges, a, b, 1))}
    got = {(r.source, r.dest): (r.cost, r.path) for r in paths.least_cost_paths(df).collect()}
    assert got == want
    asked = [(0, 5), (30, 70), (70, 30), (3, 3), (1, 99)]
    got = {(r.source, r.dest): (r.cost, r.path) for r in paths.least_cost_paths(*frames(spark, edges, asked)).collect()}
    assert got == {p: want[p] for p in asked if p in want}


def best_way(out, source, dest, off, banned):
    heap = [(0, (), source, (source,))]
    done = set()
    while heap:
        cost, segs, node, nodes = heapq.heappop(heap)
        if node == dest:
            return cost, segs, nodes
        if node in done:
            continue
        done.add(node)
        for b, s, c in out.get(node, ()):
            if b not in off and b not in done and not (node == source and s in banned):
                heapq.heappush(heap, (cost + c, (*segs, s), b, (*nodes, b)))
    return None


def cheapest(out, step, source, dest, k):
    """One pair's paths, one search after another."""
    first = best_way(out, source, dest, set(), set())
    taken, pool = [first[:2] + (first[2],)] if first else [], set()
    while taken and len(taken) < k:
        _, segs, nodes = taken[-1]
        for i in range(len(segs)):
            banned = {t[1][i] for t in taken if t[1][:i] == segs[:i] and len(t[1]) > i}
            way = best_way(out, nodes[i], dest, set(nodes[:i]), banned)
            if way:
                pool.add((sum(step[s] for s in segs[:i]) + way[0], segs[:i] + way[1], nodes[:i] + way[2]))
        pool -= set(taken)
        if not pool:
            break
        taken.append(min(pool))
        pool.discard(taken[-1])
    return [(c, list(s)) for c, s, _ in taken]


def test_five_hundred_nodes(spark):
    rng = random.Random(9)
    n = 500
    edges = [(i, i + 1, i, float(rng.randint(1, 9))) for i in range(n - 1)]
    edges += [(a, b, 1000 + k, float(rng.randint(5, 90))) for k, (a, b) in enumerate(sorted((rng.sample(range(n), 2)) for _ in range(1500)))]
    out, step = {}, {}
    for a, b, s, c in edges:
        out.setdefault(a, []).append((b, s, int(c)))
        step[s] = int(c)
    wanted = [(0, 499), (10, 480), (250, 300), (499, 0), (3, 4)]
    got = {}
    for r in paths.k_cheapest_paths(*frames(spark, edges, wanted), 4).orderBy("rank").collect():
        got.setdefault((r.source, r.dest), []).append((int(r.cost), r.path))
    assert got == {p: found for p in wanted if (found := cheapest(out, step, *p, 4))}
