"""Paths through the network and the flagship route evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballast.functions import scoring
from ballast.operators import aggregates as agg
from ballast.operators import graph, paths
from ballast.plans.registry import query
from ballast.plans.scalars import joined

COST_SQL = "SELECT seg_id, src, dst, round(4.5e0 + delay_h * 1.2e0 + greatest(0.0::double, factor - 1) * 3.0e0, 9) AS cost FROM segments"


def relaxed(rounds: int) -> str:
    """Bellman-Ford rounds written out; more rounds than nodes never change anything."""
    parts = [f"e AS MATERIALIZED ({COST_SQL})",
             "r0 AS MATERIALIZED (SELECT DISTINCT src AS source, src AS node, 0.0e0 AS cost, []::int[] AS path FROM e)"]
    for i in range(1, rounds + 1):
        parts.append(f"""r{i} AS MATERIALIZED (SELECT source, node, min(cost) AS cost, arg_min(path, (cost, path)) AS path FROM (SELECT source, node, cost, path FROM r{i - 1}
          UNION ALL SELECT r.source, e.dst, round(r.cost + e.cost, 9), list_append(r.path, e.seg_id) FROM r{i - 1} r JOIN e ON e.src = r.node WHERE e.dst <> r.source) x GROUP BY source, node)""")
    return "WITH " + ", ".join(parts) + f", best AS (SELECT source, node AS dest, cost, path FROM r{rounds} WHERE source <> node)"


PATHS_SQL = relaxed(25)


@query("gra_01_least_cost_paths", needs=("segments",), oracle=f"{PATHS_SQL} SELECT source, dest, round(cost, 6) AS cost, array_to_string(path, ',') AS path FROM best")
def _(t):
    p = paths.least_cost_paths(graph.edge_costs(t.segments))
    return p.select("source", "dest", F.round("cost", 6).alias("cost"), joined("path").alias("path"))


WANT_SQL = "SELECT DISTINCT c_nationkey AS source, (c_nationkey + 1 + o_orderkey % 12) % 25 AS dest FROM orders JOIN customer ON c_custkey = o_custkey"


def cheapest_sql(k: int) -> str:
    """Partial paths go on only below the ``k``-th cost of the paths that take one edge between two cheapest ways."""
    return PATHS_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""", w AS MATERIALIZED ({WANT_SQL}), n AS (SELECT DISTINCT src AS v FROM e UNION SELECT DISTINCT dst FROM e),
way AS MATERIALIZED (SELECT b.source, b.dest, cost, path, [b.source] || list_transform(path, lambda s: s % 100) AS nodes FROM best b UNION ALL SELECT v, v, 0.0e0, []::int[], [v] FROM n),
over AS (SELECT DISTINCT w.source, w.dest, round(a.cost + e.cost + z.cost, 9) AS cost, a.path || [e.seg_id] || z.path AS path FROM w JOIN way a ON a.source = w.source JOIN e ON e.src = a.dest JOIN way z ON z.source = e.dst AND z.dest = w.dest
  WHERE len(list_distinct(a.nodes || z.nodes)) = len(a.nodes || z.nodes)),
most AS MATERIALIZED (SELECT source, dest, cost AS most FROM (SELECT *, row_number() OVER (PARTITION BY source, dest ORDER BY cost, path) AS n FROM over) x WHERE n = {k}),
p AS (SELECT w.source, w.dest, w.source AS node, [w.source] AS visited, 0.0e0 AS cost, []::int[] AS path, most FROM w LEFT JOIN most USING (source, dest)
  UNION ALL SELECT p.source, p.dest, e.dst, list_append(visited, e.dst), round(p.cost + e.cost, 9), list_append(p.path, e.seg_id), most FROM p JOIN e ON e.src = p.node JOIN way r ON r.source = e.dst AND r.dest = p.dest
    WHERE p.node <> p.dest AND NOT list_contains(visited, e.dst) AND (most IS NULL OR p.cost + e.cost + r.cost <= most + 1e-6)),
hit AS (SELECT * FROM (SELECT source, dest, cost, path, row_number() OVER (PARTITION BY source, dest ORDER BY cost, path) AS rank FROM p WHERE node = dest) x WHERE rank <= {k})"""


def requests(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("request_id"), F.col("c_nationkey").alias("source"), ((F.col("c_nationkey") + 1 + F.col("o_orderkey") % 12) % 25).alias("dest"))


def edges(t):
    return t.segments.select("seg_id", "src", "dst", F.round(scoring.segment_cost(F.col("delay_h"), F.col("factor")), 9).alias("cost"))


@query("gra_02_simple_paths", needs=("segments",), oracle=f"""{cheapest_sql(8)}
SELECT source, dest, round(cost, 6) AS cost, array_to_string(path, ',') AS path, 'FOUND' AS status FROM hit
UNION ALL SELECT n_nationkey, n_nationkey, 0, '', 'SAME_NODE' FROM nation UNION ALL SELECT n_nationkey, n_nationkey + 25, NULL, NULL, 'NO_PATH' FROM nation""")
def _(t):
    own = t.nation.select(F.col("n_nationkey").alias("source"), F.explode(F.array("n_nationkey", F.col("n_nationkey") + 25)).alias("dest"))
    p = paths.simple_paths(edges(t), requests(t).select("source", "dest").unionByName(own), 8)
    return p.select("source", "dest", F.round("cost", 6).alias("cost"), joined("path").alias("path"), "status")


@query("top_03_k_cheapest_paths", needs=("segments",), oracle=f"{cheapest_sql(5)} SELECT source, dest, round(cost, 6) AS cost, array_to_string(path, ',') AS path, rank FROM hit")
def _(t):
    p = paths.k_cheapest_paths(edges(t), requests(t), 5)
    return p.select("source", "dest", F.round("cost", 6).alias("cost"), joined("path").alias("path"), "rank")


@query("evaluated_routes", needs=("segments",), oracle=f"""{PATHS_SQL},
req AS (SELECT o_orderkey AS request_id, c_nationkey AS source, (c_nationkey + 1 + o_orderkey % 12) % 25 AS dest, 4 + (o_orderkey % 8) / 1e1 AS h, 3 + (o_orderkey % 5) / 1e1 AS w, cast(70 + o_orderkey % 50 as double) AS wt,
   CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE (o_orderkey % 1000) / 1e1 END AS weather, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 97) / 1e0 END AS port FROM orders JOIN customer ON c_custkey = o_custkey),
leg AS (SELECT source, dest, unnest(path) AS seg_id, unnest(range(len(path))) AS seq FROM best),
per AS (SELECT source, dest, count(*) AS n, avg(factor) AS f, avg(delay_h) AS d, sum(delay_h) AS s FROM leg JOIN segments USING (seg_id) GROUP BY source, dest),
blk AS (SELECT r.request_id, arg_min(l.seg_id, l.seq) AS blocking FROM req r JOIN leg l ON l.source = r.source AND l.dest = r.dest JOIN segments g ON g.seg_id = l.seg_id WHERE h > max_h OR w > max_w OR wt > max_t GROUP BY r.request_id),
x AS (SELECT r.*, b.cost, array_to_string(b.path, ',') AS path, blocking, n, s, round(greatest(0.0::double, least(100.0::double, 100 - (f - 1) * 40)), 6) AS cs, round(greatest(0.0::double, least(100.0::double, 100 - d * 10)), 6) AS hs
  FROM req r LEFT JOIN best b ON b.source = r.source AND b.dest = r.dest LEFT JOIN per p ON p.source = r.source AND p.dest = r.dest LEFT JOIN blk k ON k.request_id = r.request_id)
SELECT request_id, source, dest, round(cost, 6) AS cost, path, CASE WHEN path IS NULL THEN 'NO_PATH' WHEN blocking IS NULL THEN 'APPROVED' ELSE 'HARD_BLOCKED' END AS status, blocking AS blocking_segment, round(n * 4.5e0 + s, 2) AS transit_hours,
  CASE WHEN path IS NULL THEN NULL WHEN blocking IS NOT NULL THEN 0 ELSE cast(ceil((0.0e0 + 0.15e0 * cs + 0.15e0 * hs + coalesce(0.4e0 * weather, 0) + coalesce(0.3e0 * port, 0))
   / (0.0e0 + 0.15e0 + 0.15e0 + CASE WHEN weather IS NULL THEN 0 ELSE 0.4e0 END + CASE WHEN port IS NULL THEN 0 ELSE 0.3e0 END)) as int) END AS reliability_score FROM x""")
def evaluated_routes(t):
    """All requests at once: cheapest path, clearance of the cargo on it, transit hours and reliability.

    A request that no path answers has the status NO_PATH and no figures.
    """
    c = F.col
    best = paths.least_cost_paths(graph.edge_costs(t.segments), requests(t))
    legs = best.select("source", "dest", F.posexplode("path").alias("seq", "seg_id")).join(t.segments.drop("src", "dst"), "seg_id")
    # path facts once per pair of ends, not once per request
    pair = F.concat_ws(">", "source", "dest")
    scores = agg.route_scores(legs.withColumn("route_id", pair)).withColumnRenamed("route_id", "pair")
    req = requests(t).withColumns({
        "pair": pair, "cargo_h": 4 + (c("request_id") % 8) / 10, "cargo_w": 3 + (c("request_id") % 5) / 10, "cargo_t": (70 + c("request_id") % 50).cast("double"),
        "weather": F.when(c("request_id") % 6 != 0, (c("request_id") % 1000) / 10), "port": F.when(c("request_id") % 5 != 0, (c("request_id") % 97) / 1),
    })
    facts = best.select("source", "dest", "cost", "path")
    cargo = req.select("request_id", "source", "dest", "cargo_h", "cargo_w", "cargo_t")
    clear = agg.clearance(cargo.join(legs, ["source", "dest"]).withColumnRenamed("request_id", "route_id")).withColumnRenamed("route_id", "request_id")
    j = req.join(facts, ["source", "dest"], "left").join(scores, "pair", "left").join(clear, "request_id", "left")
    score = scoring.reliability(c("weather"), c("port"), F.round("congestion_score", 6), F.round("historical_score", 6), c("status") == "HARD_BLOCKED")
    found = c("path").isNotNull()
    return j.select(
        "request_id", "source", "dest", F.round("cost", 6).alias("cost"), joined("path").alias("path"), F.when(found, c("status")).otherwise("NO_PATH").alias("status"),
        "blocking_segment", "transit_hours", F.when(found, score).alias("reliability_score"))
