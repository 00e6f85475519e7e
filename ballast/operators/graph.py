"""Costs of edges, closures and cycles as loops of joins.

Each round is one join whose result is written to reliable storage, so plans
stay short and a lost executor costs one round. Closures square their relation,
so that rounds grow with the logarithm of the longest chain. Only counts reach
the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions.digest import group_digest
from ballast.functions.scoring import segment_cost
from ballast.functions.vocab import TRUST_RELATIONS
from ballast.session import cut


def powers(edges: DataFrame, start: str, end: str) -> tuple[list[DataFrame], bool]:
    """Pairs (group, start, end) that 1, 2, 4, ... edges lead along, and whether there are cycles.

    Each table is the one before it joined with itself. Without cycles the last
    one is empty after the logarithm of the longest path; with them the walks
    end where they are longer than any group has edges.
    """
    last = cut(edges.select("group", start, end).distinct())
    most = last.groupBy("group").count().agg(F.max("count")).first()[0] or 0
    out = []
    while not last.isEmpty():
        out.append(last)
        if 1 << (len(out) - 1) > most:
            return out, True
        on = last.select("group", F.col(start).alias("_on"), F.col(end).alias("_over"))
        last = cut(last.withColumnRenamed(end, "_on").join(on, ["group", "_on"]).select("group", start, F.col("_over").alias(end)).distinct())
    return out, False


def reached(seed: DataFrame, steps: list[DataFrame], start: str, end: str, node: str = "record_id") -> DataFrame:
    """``seed`` with all that its nodes lead to; other columns go along.

    Every distance is a sum of different powers of two, so one pass over the powers suffices.
    """
    cols = seed.columns
    found = seed.distinct()
    for i, step in enumerate(steps):
        # a node and where it leads in one pass, so that nothing is computed twice
        led = found.withColumnRenamed(node, start).join(step, ["group", start], "left")
        here = F.explode(F.when(F.col(end).isNull(), F.array(start)).otherwise(F.array(start, end))).alias(node)
        found = led.select(*[here if c == node else c for c in cols]).distinct()
        if i % 4 == 3 and i + 1 < len(steps):
            found = cut(found)
    return cut(found)


def carried_on(edges: DataFrame, start: str, end: str) -> DataFrame:
    """Edges that go on from where another one of their group ends.

    Walks of two edges and more hold only these after their first edge, and most
    lineage is shallow, so that few edges are left to be squared.
    """
    ends = edges.select("group", F.col(end).alias(start))
    return edges.select("group", start, end).join(ends, ["group", start], "left_semi")


def edge_costs(segments: DataFrame) -> DataFrame:
    """Directed edges with their cost; negative delays would break the fixed point and are refused."""
    bad = segments.where("delay_h < 0")
    if not bad.isEmpty():
        raise ValueError("negative historical delay")
    cost = segment_cost(F.col("delay_h"), F.col("factor"))
    # parallel edges: the cheaper one, then the smaller id, is the only one a path can use
    return segments.select("src", "dst", "seg_id", F.round(cost, 9).alias("cost")).groupBy("src", "dst").agg(
        F.min_by(F.struct("seg_id", "cost"), F.struct("cost", "seg_id")).alias("e")
    ).select("src", "dst", "e.seg_id", "e.cost")


def paths_from(edges: DataFrame, sources: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """Cheapest path from each of a few sources to every node it reaches: cost and segment ids in order.

    Relaxation in rounds: only nodes improved in the last round are expanded.
    Equal costs are settled by the smaller list of segments.
    """
    starts = sources.select("source").distinct()
    kind = edges.schema["seg_id"].dataType.simpleString()
    best = cut(starts.select(
        "source", F.col("source").alias("node"), F.lit(0.0).alias("cost"),
        F.array().cast(f"array<{kind}>").alias("path"), F.lit(0).alias("round"),
    ))
    hop = edges.withColumnRenamed("cost", "step")
    for i in range(1, max_rounds):
        front = best.where(F.col("round") == i - 1)
        tried = front.join(hop, F.col("node") == F.col("src")).where("dst <> source").select(
            "source", F.col("dst").alias("node"), F.round(F.col("cost") + F.col("step"), 9).alias("cost"),
            F.concat("path", F.array("seg_id")).alias("path"), F.lit(i).alias("round"),
        )
        pick = F.min(F.struct("cost", "path", "round")).alias("b")
        best = cut(best.unionByName(tried).groupBy("source", "node").agg(pick).select("source", "node", "b.*"))
        if best.where(F.col("round") == i).isEmpty():
            break
    else:
        raise RuntimeError(f"paths still improve after {max_rounds} rounds")
    return best.where("source <> node").select("source", F.col("node").alias("dest"), "cost", "path")


# --- lineage ---------------------------------------------------------------------------


def trusted_edges(edges: DataFrame, relations=TRUST_RELATIONS) -> DataFrame:
    return edges.where(F.col("relation").isin(*relations))


def ancestors(direct: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """Records that each role rests on: its direct records and their trusted ancestors in the set.

    ``direct`` and the result have (group, role, record_id); ``edges`` have
    (group, parent, child, relation) and ``members`` (group, record_id).
    """
    up = trusted_edges(edges).join(
        members.select("group", F.col("record_id").alias("parent")), ["group", "parent"], "left_semi"
    ).select("group", "child", "parent")
    steps = powers(carried_on(up, "child", "parent"), "child", "parent")[0]
    return reached(direct.select("group", "role", "record_id"), [up, *steps], "child", "parent")


def unpeeled(edges: DataFrame) -> DataFrame:
    """Records in a cycle or depending on one: what stays after removing records without open parents.

    ``edges`` have (group, parent, child). Those are the ends of walks longer
    than the group has edges.
    """
    steps, cyclic = powers(carried_on(edges, "parent", "child"), "parent", "child")
    ends = steps[-1] if cyclic else edges.select("group", "child").where("false")
    return ends.select("group", F.col("child").alias("record_id")).distinct()


def lineage_faults(edges: DataFrame, members: DataFrame, relations=TRUST_RELATIONS) -> DataFrame:
    """Groups whose trusted lineage has a loose end, a self edge or a cycle: (group, fault)."""
    e = trusted_edges(edges, relations).select("group", "parent", "child").distinct()
    ids = members.select("group", "record_id").distinct()
    loose = [
        e.join(ids.select("group", F.col("record_id").alias(end)), ["group", end], "left_anti").select(
            "group", F.lit("DANGLING").alias("fault"))
        for end in ("parent", "child")
    ]
    selfish = e.where("parent = child").select("group", F.lit("SELF_EDGE").alias("fault"))
    cyclic = unpeeled(e.where("parent <> child")).select("group", F.lit("CYCLE").alias("fault"))
    return loose[0].unionByName(loose[1]).unionByName(selfish).unionByName(cyclic).distinct()


def tainted(invalid: DataFrame, edges: DataFrame, derived: DataFrame | None = None) -> DataFrame:
    """Derived records that rest, through derived records, on an invalid one.

    All frames are keyed by (group, record_id); ``derived`` are the records that
    pass a failure on, where ``edges`` lead to others too. Each record appears once.
    """
    return _tainted(invalid, *_passed_on(edges, derived))


def _passed_on(edges: DataFrame, derived: DataFrame | None) -> tuple[DataFrame, list[DataFrame]]:
    """Edges that pass a failure on, and where 1, 2, 4, ... of them lead from the end of one."""
    down = edges.select("group", "parent", "child")
    if derived is not None:
        down = down.join(derived.select("group", F.col("record_id").alias("child")), ["group", "child"], "left_semi").select("group", "parent", "child")
    return down, powers(carried_on(down, "parent", "child"), "parent", "child")[0]


def _tainted(invalid: DataFrame, down: DataFrame, steps: list[DataFrame]) -> DataFrame:
    first = invalid.select("group", F.col("record_id").alias("parent")).join(down, ["group", "parent"]).select("group", F.col("child").alias("record_id"))
    return reached(first, steps, "parent", "child")


def tainted_by(invalid: DataFrame, edges: DataFrame, derived: DataFrame) -> DataFrame:
    """The same with every invalid ancestor of each tainted record, one row per pair.

    A tainted parent counts as invalid for its children, so it is listed too.
    """
    down, steps = _passed_on(edges, derived)
    bad = invalid.select("group", "record_id").unionByName(_tainted(invalid, down, steps)).distinct()
    first = down.join(cut(bad).withColumnRenamed("record_id", "parent"), ["group", "parent"]).select(
        "group", F.col("child").alias("record_id"), F.col("parent").alias("ancestor")
    )
    return reached(first, steps, "parent", "child")


def lineage_digests(edges: DataFrame) -> DataFrame:
    """Digest of the edges into each child."""
    row = F.sha2(F.concat_ws("|", F.col("parent").cast("string"), "relation"), 256)
    return group_digest(edges.withColumn("_row", row), ["child"], "_row", "lineage_digest").drop("lineage_digest_rows")


def root_digests(records: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """One digest per decision over its record digests and its edges."""
    r = group_digest(records, [key], "envelope_digest", "_r").select(key, "_r")
    row = F.sha2(F.concat(F.col("parent").cast("string"), F.lit(">"), F.col("child").cast("string"), F.lit(":"), "relation"), 256)
    e = group_digest(edges.withColumn("_row", row), [key], "_row", "_e").select(key, "_e")
    return r.join(e, key, "left").select(key, F.sha2(F.concat("_r", F.coalesce("_e", F.lit(""))), 256).alias("computed_root"))


# Which record kind feeds which, and by what relation. The last two depend on the decision.
DERIVATIONS = (
    ("CARGO_DECLARATION", "CLEARANCE_RESULT", "INPUT_TO"),
    ("ENGINEERING_LIMITS", "CLEARANCE_RESULT", "VALIDATES"),
    ("WEATHER_OBSERVATION", "WEATHER_SCORE", "DERIVED_FROM"),
    ("SPACE_WEATHER_OBSERVATION", "WEATHER_SCORE", "REFERENCES"),
    ("CONGESTION_BASELINE", "CONGESTION_SCORE", "DERIVED_FROM"),
    ("RAIL_CONGESTION_SIGNAL", "CONGESTION_SCORE", "DERIVED_FROM"),
    ("AIS_PORT_ACTIVITY", "CONGESTION_SCORE", "DERIVED_FROM"),
    ("ENGINEERING_LIMITS", "HISTORICAL_DELAY_SCORE", "DERIVED_FROM"),
    ("WEATHER_SCORE", "FINAL_RRI", "INPUT_TO"),
    ("CONGESTION_SCORE", "FINAL_RRI", "INPUT_TO"),
    ("HISTORICAL_DELAY_SCORE", "FINAL_RRI", "INPUT_TO"),
    ("PORT_ALIGNMENT_SCORE", "FINAL_RRI", "PORT"),
    ("CLEARANCE_RESULT", "FINAL_RRI", "OVERRIDES"),
)


def derivation_edges(records: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Lineage edges of each decision's records by the fixed rules.

    ``decisions`` give ``port_available`` and ``hard_blocked`` per key.
    """
    rules = records.sparkSession.createDataFrame(list(DERIVATIONS), "parent_kind string, child_kind string, rule string")
    p = records.select(key, F.col("entity_type").alias("parent_kind"), F.col("record_id").alias("parent"))
    c = records.select(key, F.col("entity_type").alias("child_kind"), F.col("record_id").alias("child"))
    j = p.join(F.broadcast(rules), "parent_kind").join(c, [key, "child_kind"]).join(decisions, key)
    relation = F.when(F.col("rule") == "PORT", F.when(F.col("port_available"), "INPUT_TO").otherwise("EXCLUDED_FROM")).otherwise(F.col("rule"))
    return j.where("rule <> 'OVERRIDES' or hard_blocked").select(key, "parent", "child", relation.alias("relation"))
