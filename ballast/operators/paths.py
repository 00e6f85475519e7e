"""Cheapest paths of all requested pairs at once, and the k cheapest without a repeated node by deviations.

The best path of a pair that is not yet taken leaves an earlier one at some node.
So each path taken is followed up to each of its nodes in turn (the root), and
the best way on from there is sought that neither meets the root again nor takes
an edge that an earlier path with the same root took. These best ways are the
pair's candidates; the cheapest is taken next. Nothing is enumerated: a pair
costs as many searches as the taken paths have nodes, also where it has fewer
paths than wanted.

Most searches end at once: if the unrestricted best way on keeps off the root it
is the answer. The rest relax costs within their own part of the network, and
only as far as the bound that the pair's candidates set.

Costs are whole billionths, so sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ballast.session import cut

SCALE = 1_000_000_000
#: Hops that a round of relaxation takes.
STRIDE = 3
PAIR = ["source", "dest"]


def distances_to(hops: DataFrame, ends: DataFrame) -> DataFrame:
    """Least cost from every node that reaches an end: dest, node, rest.

    A round takes ``STRIDE`` hops from the rows improved last and writes only
    what it improves.
    """
    node = hops.schema["src"].dataType.simpleString()
    least = F.min("rest").alias("rest")
    front = best = cut(ends.select("dest", F.col("dest").cast(node).alias("node"), F.lit(0).cast("long").alias("rest")))
    rounds = 0
    while not front.isEmpty():
        rounds += 1
        tried = front
        for _ in range(STRIDE):
            back = tried.join(hops, F.col("node") == F.col("dst")).where(F.col("src") != F.col("dest")).select("dest", F.col("src").alias("node"), (F.col("rest") + F.col("step")).alias("rest"))
            tried = tried.unionByName(back).groupBy("dest", "node").agg(least)
        known = best.withColumnRenamed("rest", "known")
        front = cut(tried.join(known, ["dest", "node"], "left").where("known is null or rest < known").select("dest", "node", "rest"))
        best = best.unionByName(front).groupBy("dest", "node").agg(least)
        if rounds % 8 == 0:
            best = cut(best)
    return cut(best)


def ways_to(hops: DataFrame, ends: DataFrame) -> DataFrame:
    """Least cost way from every node to each end: dest, node, rest, segs, nodes. Equal costs: the smaller list of segments.

    Of the edges on cheapest ways each node takes the one of smallest id. These
    pointers are followed by doubling: rounds grow with the logarithm of a way's length.
    """
    rest = distances_to(hops, ends)
    ahead = rest.select("dest", F.col("node").alias("dst"), F.col("rest").alias("after"))
    kind, node = hops.schema["seg_id"].dataType.simpleString(), hops.schema["src"].dataType.simpleString()
    tight = rest.where("node <> dest").join(hops, F.col("node") == F.col("src")).join(ahead, ["dest", "dst"]).where("rest = step + after")
    way = cut(tight.groupBy("dest", "node", "rest").agg(F.min(F.struct("seg_id", "dst")).alias("e")).select(
        "dest", "node", "rest", F.array("e.seg_id").alias("segs"), F.array("node", "e.dst").alias("nodes")))
    while True:
        end = F.element_at("nodes", -1)
        open_ = way.where(end != F.col("dest")).withColumn("at", end)
        if open_.isEmpty():
            break
        more = way.select("dest", F.col("node").alias("at"), F.col("segs").alias("on"), F.col("nodes").alias("over"))
        longer = open_.join(more, ["dest", "at"]).select("dest", "node", "rest", F.concat("segs", "on").alias("segs"), F.concat("nodes", F.slice("over", 2, F.size("over"))).alias("nodes"))
        way = cut(way.where(end == F.col("dest")).unionByName(longer))
    there = rest.where("node = dest").select("dest", "node", "rest", F.array().cast(f"array<{kind}>").alias("segs"), F.array(F.col("node").cast(node)).alias("nodes"))
    return way.unionByName(there)


def whole_costs(edges: DataFrame) -> DataFrame:
    """Edges between different nodes with their cost in billionths."""
    return cut(edges.where("src <> dst").select("src", "dst", "seg_id", F.round(F.col("cost") * SCALE).cast("long").alias("step")))


def least_cost_paths(edges: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Cheapest path of each requested pair, or of all pairs: source, dest, cost, path (segment ids in order).

    Pairs of one node and pairs that nothing connects get no rows. Costs are above zero.
    """
    hops = whole_costs(edges)
    want = None if requests is None else requests.select(*PAIR).where("source <> dest").distinct()
    ends = hops.select(F.col("dst").alias("dest")).distinct() if want is None else want.select("dest").distinct()
    found = ways_to(hops, ends).where("node <> dest").select(F.col("node").alias("source"), "dest", (F.col("rest") / SCALE).alias("cost"), F.col("segs").alias("path"))
    return found if want is None else found.join(want, PAIR, "left_semi")


def spurs(taken: DataFrame, last: DataFrame) -> DataFrame:
    """Searches that follow from the paths taken last: the root of each and the edges it must not leave by."""
    at = F.explode(F.sequence(F.col("deviates"), F.size("segs") - 1)).alias("at")
    root = last.where(F.size("segs") > 0).select(*PAIR, at, "segs", "nodes", "steps").select(
        *PAIR, "at", F.slice("segs", F.lit(1), F.col("at")).alias("root"), F.slice("nodes", F.lit(1), F.col("at") + 1).alias("off"), F.slice("steps", F.lit(1), F.col("at")).alias("spent"))
    known = taken.select(*PAIR, F.col("segs").alias("known"))
    # at most as many as paths were taken
    same = (F.size("known") > F.col("at")) & (F.slice("known", F.lit(1), F.col("at")) == F.col("root"))
    return root.join(known, PAIR).where(same).groupBy(*PAIR, "at").agg(
        F.first("root").alias("root"), F.first("off").alias("off"), F.first("spent").alias("spent"), F.collect_set(F.element_at("known", F.col("at") + 1)).alias("banned"))


def sums(steps: str):
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def follow(searches: DataFrame, hops: DataFrame, ways: DataFrame, bound: DataFrame, left: int) -> DataFrame:
    """Best way of each search: source, dest, cost, segs, nodes, steps, deviates.

    ``bound`` holds the costs over which a pair has no use for a candidate. So do
    the ``left`` cheapest ways found at once, as that many are wanted at most.
    """
    step_of = hops.select("seg_id", F.col("step"))
    node = F.element_at("off", -1)
    first = searches.join(bound, PAIR, "left").withColumn("node", node).join(hops, F.col("node") == F.col("src")).where(
        ~F.array_contains("banned", F.col("seg_id")) & ~F.array_contains("off", F.col("dst")))
    ahead = ways.select("dest", F.col("node").alias("dst"), "rest", F.col("segs").alias("on"), F.col("nodes").alias("over"))
    spent = sums("spent")
    opened = cut(first.join(ahead, ["dest", "dst"]).withColumn("total", spent + F.col("step") + F.col("rest")).where("most is null or total <= most").select(
        *PAIR, "at", "off", "root", "most", "dst", "seg_id", "step", "total", F.concat("root", F.array("seg_id"), "on").alias("segs"),
        F.concat("off", "over").alias("nodes"), (~F.arrays_overlap("over", "off")).alias("clear"), (spent + F.col("step")).alias("cost")))
    key = [*PAIR, "at"]
    best = opened.groupBy(*key).agg(F.min(F.struct("total", "segs", "clear", "nodes")).alias("b"))
    done = best.where("b.clear").select(*PAIR, F.col("b.total").alias("cost"), "b.segs", "b.nodes", F.col("at").alias("deviates"))
    # the best way meets the root again: relax within the search's own part of the network
    enough = opened.where("clear").withColumn("n", F.row_number().over(W.partitionBy(*PAIR).orderBy("total"))).where(F.col("n") == left).select(*PAIR, F.col("total").alias("enough"))
    hard = opened.join(best.where("not b.clear").select(*key), key, "left_semi").join(enough, PAIR, "left").withColumn(
        "most", F.least("most", "enough")).where("most is null or total <= most")
    state = cut(hard.select(
        *key, F.col("dst").alias("node"), "cost", F.concat("root", F.array("seg_id")).alias("segs"), F.concat("off", F.array("dst")).alias("nodes"), F.size("off").alias("fixed"), "most", F.lit(0).alias("round"))
        .groupBy(*key, "node").agg(F.min(F.struct("cost", "segs", "nodes", "fixed", "most", "round")).alias("b")).select(*key, "node", "b.*"))
    rest = ways.select("dest", F.col("node").alias("dst"), "rest")
    i = 0
    while not state.where(F.col("round") == i).isEmpty():
        i += 1
        tried = state.where((F.col("round") == i - 1) & (F.col("node") != F.col("dest"))).join(hops, F.col("node") == F.col("src")).where(~F.array_contains("nodes", F.col("dst"))).join(
            rest, ["dest", "dst"]).where("most is null or cost + step + rest <= most").select(
            *key, F.col("dst").alias("node"), (F.col("cost") + F.col("step")).alias("cost"), F.concat("segs", F.array("seg_id")).alias("segs"), F.concat("nodes", F.array("dst")).alias("nodes"), "fixed", "most", F.lit(i).alias("round"))
        state = cut(state.unionByName(tried).groupBy(*key, "node").agg(F.min(F.struct("cost", "segs", "nodes", "fixed", "most", "round")).alias("b")).select(*key, "node", "b.*"))
    found = done.unionByName(state.where("node = dest").select(*PAIR, "cost", "segs", "nodes", F.col("at").alias("deviates")))
    # steps in order, for the roots of later searches
    legs = found.select(*PAIR, "deviates", F.posexplode("segs").alias("pos", "seg_id")).join(step_of, "seg_id").groupBy(*PAIR, "deviates").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "step"))), lambda x: x["step"]).alias("steps"))
    return found.join(legs, [*PAIR, "deviates"])


def k_cheapest_paths(edges: DataFrame, requests: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` cheapest paths without a repeated node of each requested pair: source, dest, cost, path, rank.

    ``edges`` (src, dst, seg_id, cost) may be parallel; ids are unique and costs
    above zero. Equal costs are settled by the smaller list of segments. Pairs
    whose ends are one node, or that nothing connects, get no rows.
    """
    hops = whole_costs(edges)
    want = cut(requests.select(*PAIR).where("source is not null and dest is not null and source <> dest").distinct())
    ways = ways_to(hops, want.select("dest").distinct())
    zero = F.lit(0)
    start = want.join(ways.withColumnRenamed("node", "source"), PAIR).select(*PAIR, F.col("rest").alias("cost"), "segs", "nodes", zero.alias("deviates"))
    legs = start.select(*PAIR, F.posexplode("segs").alias("pos", "seg_id")).join(hops.select("seg_id", "step"), "seg_id").groupBy(*PAIR).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "step"))), lambda x: x["step"]).alias("steps"))
    last = cut(start.join(legs, PAIR))
    taken, pool = last.withColumn("rank", F.lit(1)), last.where("false")
    for rank in range(2, k + 1):
        # a pair needs no candidate dearer than the last of those that could still be taken
        bound = pool.withColumn("at", F.row_number().over(W.partitionBy(*PAIR).orderBy("cost", "segs"))).where(F.col("at") == k + 1 - rank).select(*PAIR, F.col("cost").alias("most"))
        new = follow(cut(spurs(taken, last)), hops, ways, cut(bound), k + 1 - rank)
        order = F.row_number().over(W.partitionBy(*PAIR).orderBy("cost", "segs"))
        ranked = cut(pool.unionByName(new).withColumn("at", order).where(F.col("at") <= k + 1 - rank))
        last, pool = ranked.where("at = 1").drop("at"), ranked.where("at > 1").drop("at")
        if last.isEmpty():
            break
        taken = cut(taken.unionByName(last.withColumn("rank", F.lit(rank))))
    return taken.select(*PAIR, (F.col("cost") / SCALE).alias("cost"), F.col("segs").alias("path"), "rank")


def simple_paths(edges: DataFrame, requests: DataFrame, max_paths: int = 5) -> DataFrame:
    """An answer to every requested pair: its ``max_paths`` cheapest simple paths, of any length.

    Columns as ``k_cheapest_paths`` and status: FOUND, SAME_NODE with an empty
    path, or NO_PATH without cost and path.
    """
    want = requests.select(*PAIR).distinct()
    found = k_cheapest_paths(edges, want, max_paths)
    kind = edges.schema["seg_id"].dataType.simpleString()
    same = F.col("source") == F.col("dest")
    empty = F.array().cast(f"array<{kind}>")
    rest = want.join(found.select(*PAIR).distinct(), PAIR, "left_anti").select(
        *PAIR, F.when(same, 0.0).alias("cost"), F.when(same, empty).alias("path"), F.lit(1).alias("rank"), F.when(same, "SAME_NODE").otherwise("NO_PATH").alias("status"))
    return found.withColumn("status", F.lit("FOUND")).unionByName(rest)
