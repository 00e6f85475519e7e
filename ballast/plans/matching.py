"""Joins, windows, listings and set comparisons over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballast.functions.vocab import REQUIRED_DOCUMENTS
from ballast.operators import conflicts, joins, nearest, ordered, selections, windows
from ballast.operators import aggregates as agg
from ballast.plans.registry import query

REC = "l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100"


@query("join_01_segment_stations", needs=("segments", "stations"), oracle="""
SELECT seg_id, a.name AS source_name, b.name AS dest_name, a.lat AS source_lat, b.lat AS dest_lat FROM segments
JOIN stations a ON a.station_id = src JOIN stations b ON b.station_id = dst""")
def _(t):
    j = joins.with_stations(t.segments, t.stations)
    return j.select("seg_id", F.col("source.name").alias("source_name"), F.col("dest.name").alias("dest_name"),
                    F.col("source.lat").alias("source_lat"), F.col("dest.lat").alias("dest_lat"))


@query("join_02_record_source", needs=("trace_records", "sources"), oracle="""
SELECT record_id, decision_id, r.source_id, source_key, enabled FROM trace_records r LEFT JOIN sources s ON s.source_id = r.source_id""")
def _(t):
    return joins.with_source(t.trace_records, t.sources).select("record_id", "decision_id", "source_id", "source_key", "enabled")


@query("join_03_case_evidence", needs=("trace_records", "members", "sources"), oracle="""
SELECT r.decision_id AS case_id, r.record_id, r.role, s.source_key FROM trace_records r
JOIN members m ON m.record_id = r.record_id LEFT JOIN sources s ON s.source_id = r.source_id WHERE m.user_id = r.decision_id % 75""")
def _(t):
    links = t.trace_records.select("record_id", F.col("decision_id").alias("case_id"), "role", "source_id", (F.col("decision_id") % 75).alias("owner_id"))
    return joins.case_evidence(links, t.members, t.sources.drop("enabled")).select("case_id", "record_id", "role", "source_key")


@query("join_04_prediction_corridors", needs=("predictions", "routes"), oracle="""
SELECT prediction_id, coalesce(upper(source_code) || '-' || upper(dest_code), 'unassigned') AS corridor FROM predictions p
LEFT JOIN routes r ON r.route_id = p.prediction_id AND r.user_id = p.user_id + CASE WHEN p.prediction_id % 6 = 0 THEN 1 ELSE 0 END""")
def _(t):
    p = t.predictions.select("prediction_id", F.col("prediction_id").alias("route_id"),
                             (F.col("user_id") + F.when(F.col("prediction_id") % 6 == 0, 1).otherwise(0)).alias("user_id"))
    return joins.prediction_corridors(p, t.routes).select("prediction_id", "corridor")


@query("join_05_nested_children", needs=("checks",), oracle="""
SELECT check_id, 'header' AS kind, 0 AS position, '{"overall_status":"' || overall_status || '"}' AS fields FROM checks
UNION ALL SELECT l_partkey, 'item', row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey),
  '{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || ',"l_suppkey":' || l_suppkey || '}' FROM lineitem WHERE l_returnflag <> 'N'
UNION ALL SELECT l_partkey, 'override', row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey),
  '{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || ',"l_suppkey":' || l_suppkey || '}' FROM lineitem WHERE l_returnflag = 'N'""")
def _(t):
    cols = [F.col("l_partkey").alias("check_id"), "l_orderkey", "l_linenumber", "l_suppkey"]
    order, slot = ["l_orderkey", "l_linenumber", "l_suppkey"], ordered.number_slot("l_orderkey", 100_000)
    return joins.nested_rows(t.checks, "check_id", {
        "item": (t.lineitem.where("l_returnflag <> 'N'").select(*cols), order, slot),
        "override": (t.lineitem.where("l_returnflag = 'N'").select(*cols), order, slot)})


@query("join_06_owned_snapshot", needs=("routes", "outcomes"), oracle="""
SELECT r.route_id, full_gate FROM routes r JOIN outcomes o ON o.case_id = r.route_id AND r.user_id % 3 = o.case_id % 3""")
def _(t):
    r = t.routes.select("route_id", (F.col("user_id") % 3).alias("user_id"))
    s = t.outcomes.select(F.col("case_id").alias("route_id"), (F.col("case_id") % 3).alias("user_id"), "full_gate")
    return joins.owned_snapshot(r, s).select("route_id", "full_gate")


@query("join_07_edges_within_set", needs=("lineage", "members"), oracle="""
SELECT parent, child, relation FROM lineage WHERE parent IN (SELECT record_id FROM members) AND child IN (SELECT record_id FROM members)""")
def _(t):
    return joins.edges_within(t.lineage, t.members).select("parent", "child", "relation")


@query("join_08_linked_records", needs=("lineage", "members"), oracle="""
SELECT record_id FROM members m WHERE EXISTS (SELECT 1 FROM lineage WHERE relation <> 'REFERENCES' AND parent = m.record_id) OR EXISTS (SELECT 1 FROM lineage WHERE relation <> 'REFERENCES' AND child = m.record_id)""")
def _(t):
    return joins.linked_records(t.members, t.lineage.where("relation <> 'REFERENCES'")).select("record_id")


@query("agg_09_traced_share", needs=("lineage", "trace_records"), oracle="""
SELECT count(*) FILTER (source_id IS NOT NULL OR source_type = 'OPERATOR_INPUT' OR record_id IN (SELECT parent FROM lineage WHERE relation = 'INPUT_TO' UNION SELECT child FROM lineage WHERE relation = 'INPUT_TO')) AS traced,
  count(*) AS total, round(count(*) FILTER (source_id IS NOT NULL OR source_type = 'OPERATOR_INPUT' OR record_id IN (SELECT parent FROM lineage WHERE relation = 'INPUT_TO' UNION SELECT child FROM lineage WHERE relation = 'INPUT_TO')) * 100.0e0 / count(*), 1) AS percent
FROM trace_records WHERE role IS NOT NULL""")
def _(t):
    return agg.traced_share(t.trace_records, t.lineage.where("relation = 'INPUT_TO'"))


@query("join_09_shipment_twin", needs=("positions", "obs"), oracle="""
WITH ship AS (SELECT c_custkey AS shipment_id, timestamp '2024-01-01 00:00:00' + to_hours(cast((c_custkey * 37) % 900 as int)) AS updated_at FROM customer ORDER BY 2 DESC, 1 LIMIT 100),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY observed_at DESC, position_id DESC) AS rn FROM positions) p WHERE rn = 1),
ev AS (SELECT user_id, count(*) AS n FROM obs WHERE event_type = 'error' GROUP BY user_id)
SELECT s.shipment_id, epoch_us(updated_at) AS updated_us, position_id, coalesce(n, 0) AS open_events,
  CASE WHEN source_type IS NULL THEN 'UNAVAILABLE' WHEN source_type = 'SIMULATED' THEN 'SIMULATED' ELSE 'OPERATOR_DECLARED_UNVERIFIED:' || source_type END AS state_source
FROM ship s LEFT JOIN last l ON l.shipment_id = s.shipment_id LEFT JOIN ev ON ev.user_id = s.shipment_id""")
def _(t):
    base = F.lit("2024-01-01").cast("timestamp")
    ship = t.customer.select(F.col("c_custkey").alias("shipment_id"),
                             F.timestamp_micros(F.unix_micros(base) + (F.col("c_custkey") * 37) % 900 * 3_600_000_000).alias("updated_at"))
    ev = t.obs.select(F.col("user_id").alias("shipment_id"), F.when(F.col("event_type") == "error", "OPEN").otherwise("RESOLVED").alias("state"))
    out = joins.shipment_twin(ship, t.positions, ev)
    return out.select("shipment_id", F.unix_micros("updated_at").alias("updated_us"), "position_id", "open_events", "state_source")


OVERLAP_SQL = """SELECT section_id, conflict_type, candidate, other, min(s) AS conflict_start, arg_min(e, (s, e)) AS conflict_end FROM (
  SELECT a.section_id, CASE WHEN p.single_track AND a.direction <> b.direction THEN 'OPPOSING_SINGLE_TRACK' ELSE 'SAME_SECTION_OVERLAP' END AS conflict_type,
    a.schedule_id AS candidate, b.schedule_id AS other, epoch_us(greatest(a.entry_at, b.entry_at)) AS s, epoch_us(least(a.exit_at, b.exit_at)) AS e
  FROM windows a JOIN windows b ON a.section_id = b.section_id AND a.schedule_id <> b.schedule_id AND a.entry_at < b.exit_at AND b.entry_at < a.exit_at
  LEFT JOIN policies p ON p.section_id = a.section_id) x GROUP BY section_id, conflict_type, candidate, other"""
HEADWAY_SQL = """SELECT section_id, 'MINIMUM_HEADWAY' AS conflict_type, candidate, other, min(s) AS conflict_start, arg_min(e, (s, e)) AS conflict_end FROM (
  SELECT a.section_id, a.schedule_id AS candidate, b.schedule_id AS other, epoch_us(least(a.entry_at, b.entry_at)) AS s, epoch_us(greatest(a.entry_at, b.entry_at)) AS e
  FROM windows a JOIN windows b ON a.section_id = b.section_id AND a.schedule_id <> b.schedule_id JOIN policies p ON p.section_id = a.section_id
  WHERE (p.single_track OR a.direction = b.direction) AND abs(epoch_us(a.entry_at) - epoch_us(b.entry_at)) / 1e6 < p.headway_s) x GROUP BY section_id, candidate, other"""


def micros(df, *cols):
    return df.withColumns({c: F.unix_micros(c) for c in cols})


@query("join_10_section_overlaps", needs=("windows", "policies"), oracle=OVERLAP_SQL)
def _(t):
    return micros(conflicts.overlap_conflicts(t.windows, t.policies), "conflict_start", "conflict_end")


@query("join_11_headway_conflicts", needs=("windows", "policies"), oracle=HEADWAY_SQL)
def _(t):
    return micros(conflicts.headway_conflicts(t.windows, t.policies), "conflict_start", "conflict_end")


@query("join_12_coarse_slots", needs=("schedules",), oracle="""
SELECT schedule_id, CASE WHEN miss OR other IS NOT NULL THEN 'WARNING' ELSE 'CLEAR' END AS status, CASE WHEN miss THEN 'OUTSIDE_BERTH_WINDOW' WHEN other IS NOT NULL THEN 'SLOT_OVERLAP' END AS reason,
  CASE WHEN NOT miss THEN other END AS other
FROM (SELECT a.schedule_id, coalesce(NOT (a.arrives_at BETWEEN a.berth_start AND a.berth_end), false) AS miss, min(b.schedule_id) AS other
      FROM schedules a LEFT JOIN schedules b ON b.dest_code = a.dest_code AND b.schedule_id <> a.schedule_id AND b.status <> 'CANCELLED'
       AND a.departs_at < b.arrives_at AND b.departs_at < a.arrives_at GROUP BY 1, 2) x""")
def _(t):
    return conflicts.coarse_slots(t.schedules)


@query("join_13_coverage_gaps", needs=("schedules", "windows", "policies"), oracle="""
SELECT schedule_id, 'OCCUPATION_WINDOWS_MISSING' AS code, NULL AS section_id FROM schedules WHERE status <> 'CANCELLED' AND schedule_id NOT IN (SELECT schedule_id FROM windows)
UNION ALL SELECT DISTINCT schedule_id, 'TRACK_POLICY_MISSING', section_id FROM windows WHERE section_id NOT IN (SELECT section_id FROM policies)
UNION ALL SELECT DISTINCT schedule_id, 'MINIMUM_HEADWAY_POLICY_MISSING', section_id FROM windows WHERE section_id IN (SELECT section_id FROM policies WHERE headway_s IS NULL)""")
def _(t):
    return conflicts.coverage_gaps(t.schedules, t.windows, t.policies)


SRC_BAD = """(source_type NOT IN ('LIVE_PROVIDER', 'AUTHORIZED_FEED', 'IMPORTED_DOCUMENT', 'OPERATOR_INPUT', 'REAL_HISTORICAL', 'REPLAYED_SNAPSHOT')
  OR length(trim(source_reference)) < 3 OR NOT regexp_matches(source_checksum, '^[0-9a-fA-F]{64}$') OR verification_state <> 'VERIFIED' OR fetched_at < observed_at)"""
STATUS_SQL = f"""
WITH a AS (SELECT schedule_id, user_id FROM schedules WHERE status <> 'CANCELLED'),
w AS (SELECT w.*, a.user_id, {SRC_BAD} AS bad, source_type IN ('REAL_HISTORICAL', 'REPLAYED_SNAPSHOT') AS old FROM windows w JOIN a ON a.schedule_id = w.schedule_id),
p AS (SELECT section_id, single_track, headway_s, source_type IN ('REAL_HISTORICAL', 'REPLAYED_SNAPSHOT') AS pold, {SRC_BAD} OR headway_s IS NULL OR source_type IN ('REAL_HISTORICAL', 'REPLAYED_SNAPSHOT') AS pbad FROM policies),
c AS (SELECT DISTINCT x.schedule_id FROM w x JOIN w y ON x.user_id = y.user_id AND x.section_id = y.section_id AND x.schedule_id <> y.schedule_id LEFT JOIN p ON p.section_id = x.section_id
      WHERE (x.entry_at < y.exit_at AND y.entry_at < x.exit_at) OR (p.headway_s > abs(epoch_us(x.entry_at) - epoch_us(y.entry_at)) / 1e6 AND (p.single_track OR x.direction = y.direction))),
n AS (SELECT a.user_id, count(DISTINCT a.schedule_id) AS assessed_schedules, count(w.window_id) AS assessed_windows, bool_or(w.window_id IS NULL OR w.bad OR w.old) AS nm, bool_or(coalesce(w.old, false)) AS nold FROM a LEFT JOIN w ON w.schedule_id = a.schedule_id GROUP BY a.user_id),
o AS (SELECT w.schedule_id, bool_or(p.section_id IS NULL OR pbad) AS om, bool_or(coalesce(pold, false)) AS oold FROM w LEFT JOIN p ON p.section_id = w.section_id GROUP BY w.schedule_id)
SELECT a.schedule_id, a.user_id, CASE WHEN a.schedule_id IN (SELECT schedule_id FROM c) THEN 'BLOCKED' WHEN nold OR nm OR coalesce(om, false) OR coalesce(oold, false) THEN 'UNAVAILABLE' ELSE 'CLEAR' END AS status,
  CASE WHEN nold OR coalesce(oold, false) THEN 'HISTORICAL_REPLAY' WHEN nm OR coalesce(om, false) THEN 'INCOMPLETE' ELSE 'CURRENT_REAL' END AS evidence_state, cast(assessed_windows as bigint) AS assessed_windows, assessed_schedules
FROM a JOIN n ON n.user_id = a.user_id LEFT JOIN o ON o.schedule_id = a.schedule_id"""


@query("evd_13_schedule_reassessment", needs=("schedules", "windows", "policies"), oracle=STATUS_SQL)
def _(t):
    return conflicts.schedule_statuses(t.schedules, t.windows, t.policies, "user_id")


@query("agg_42_conflict_status_counts", needs=("schedules", "windows", "policies"), oracle=f"""
SELECT user_id, status, evidence_state, count(*) AS n FROM ({STATUS_SQL.strip()}) z GROUP BY user_id, status, evidence_state""")
def _(t):
    s = conflicts.schedule_statuses(t.schedules, t.windows, t.policies, "user_id")
    return s.groupBy("user_id", "status", "evidence_state").agg(F.count("*").alias("n"))


PIECES_SQL = """SELECT seg_id, pos AS piece, plat AS a_lat, plon AS a_lon, lat AS b_lat, lon AS b_lon, sqrt(pow(lat - plat, 2) + pow(lon - plon, 2)) AS len,
  sum(sqrt(pow(lat - plat, 2) + pow(lon - plon, 2))) OVER (PARTITION BY seg_id ORDER BY pos) AS upto
  FROM (SELECT *, lag(lat) OVER (PARTITION BY seg_id ORDER BY pos) AS plat, lag(lon) OVER (PARTITION BY seg_id ORDER BY pos) AS plon FROM segment_points) x WHERE plat IS NOT NULL"""
SNAP_SQL = f"""
pieces AS ({PIECES_SQL}), totals AS (SELECT seg_id, sum(len) AS total FROM pieces GROUP BY seg_id),
proj AS (SELECT p.point_id, p.lat, p.lon, c.*, greatest(0.0::double, least(1.0::double, ((p.lat - a_lat) * (b_lat - a_lat) + (p.lon - a_lon) * (b_lon - a_lon)) / ((b_lat - a_lat) * (b_lat - a_lat) + (b_lon - a_lon) * (b_lon - a_lon)))) AS t FROM weather p CROSS JOIN pieces c),
sp AS (SELECT *, a_lat + (b_lat - a_lat) * t AS s_lat, a_lon + (b_lon - a_lon) * t AS s_lon, upto - len + t * len AS d FROM proj),
seg AS (SELECT point_id, seg_id, any_value(lat) AS lat, any_value(lon) AS lon, arg_min(s_lat, q) AS s_lat, arg_min(s_lon, q) AS s_lon, arg_min(d, q) AS d FROM (SELECT *, (pow(s_lat - lat, 2) + pow(s_lon - lon, 2), piece) AS q FROM sp) z GROUP BY point_id, seg_id),
off AS (SELECT seg.*, d / total AS fraction, round(2 * 6371.0 * asin(sqrt(least(1.0::double, pow(sin(radians(s_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(s_lat)) * pow(sin(radians(s_lon - lon) / 2), 2)))), 2) AS km FROM seg JOIN totals USING (seg_id)),
snapped AS (SELECT point_id, arg_min(seg_id, (km, seg_id)) AS seg_id, min(km) AS offset_km, arg_min(fraction, (km, seg_id)) AS fraction FROM off GROUP BY point_id)"""


@query("join_14_nearest_segment", needs=("weather", "segment_points"), oracle=f"WITH {SNAP_SQL} SELECT point_id, seg_id, offset_km, round(fraction, 6) AS fraction FROM snapped")
def _(t):
    s = nearest.nearest_line(t.weather, "point_id", t.segment_points, "seg_id")
    return s.select("point_id", "seg_id", "offset_km", F.round("fraction", 6).alias("fraction"))


@query("fun_36_position_on_line", needs=("weather", "segment_points", "segments"), oracle=f"""
WITH {SNAP_SQL} SELECT point_id, src_code || '→' || dst_code AS snapped_track, dst_code AS routing_start, round(fraction, 6) < 0.95 AS has_remaining, offset_km FROM snapped JOIN segments USING (seg_id)
UNION ALL SELECT -1 - c_custkey, code || ' yard', code, false, 0.0e0 FROM customer JOIN stations ON code = 'N' || cast((c_nationkey * 3) % 40 as varchar)""")
def _(t):
    ends = t.segment_points.where("pos = 2").select("seg_id", F.col("lat").alias("end_lat"), F.col("lon").alias("end_lon"))
    s = nearest.nearest_line(t.weather, "point_id", t.segment_points, "seg_id")
    r = nearest.resolved_positions(s, t.segments.join(ends, "seg_id"), "seg_id").select(
        "point_id", "snapped_track", "routing_start", F.col("remaining").isNotNull().alias("has_remaining"), "offset_km")
    req = t.customer.select((-1 - F.col("c_custkey")).alias("point_id"), F.concat(F.lit("n"), (F.col("c_nationkey") * 3 % 40).cast("string")).alias("station_code"))
    yard = nearest.at_stations(req, t.stations).select("point_id", "snapped_track", "routing_start", F.lit(False).alias("has_remaining"), "offset_km")
    return r.unionByName(yard)


@query("join_15_nearest_station", needs=("weather", "stations"), oracle="""
SELECT point_id, arg_min(station_id, (round(km, 9), station_id)) AS station_id, round(min(km), 1) AS km FROM (SELECT point_id, station_id,
  2 * 6371.0 * asin(sqrt(least(1.0::double, pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - p.lon) / 2), 2)))) AS km
  FROM weather p CROSS JOIN stations s) x GROUP BY point_id""")
def _(t):
    return nearest.nearest_place(t.weather, "point_id", t.stations, "station_id")


@query("join_16_reading_as_of", needs=("positions", "obs"), oracle="""
SELECT q.position_id AS query_id, q.shipment_id AS code, CASE WHEN r.seen IS NOT NULL THEN 'CACHED' END AS source, epoch_us(r.seen) AS observed_us, r.k
FROM (SELECT *, observed_at + INTERVAL 17 MINUTE AS ts FROM positions) q
LEFT JOIN LATERAL (SELECT seen, k FROM obs WHERE user_id = q.shipment_id AND event_type <> 'error' AND seen <= q.ts AND seen >= q.ts - INTERVAL 7200 SECOND ORDER BY seen DESC LIMIT 1) r ON true""")
def _(t):
    """All positions, whatever their source."""
    q = t.positions.select(F.col("shipment_id").alias("code"), (F.col("observed_at") + F.expr("interval 17 minutes")).alias("ts"), F.col("position_id").alias("query_id"))
    r = t.obs.where("event_type <> 'error'").select(F.col("user_id").alias("code"), F.col("seen").alias("ts"), "k")
    out = joins.reading_as_of(q, r, "code", 7200)
    return out.select("query_id", "code", "source", F.unix_micros("observed_at").alias("observed_us"), "k")


@query("join_17_manifest_reconciliation", needs=("windows", "sources"), oracle="""
SELECT 'envelopes' AS section, coalesce(e.id, a.id) AS id, CASE WHEN a.id IS NULL THEN 'MISSING' WHEN e.id IS NULL THEN 'EXTRA' ELSE 'DIGEST_MISMATCH' END AS code
FROM (SELECT window_id AS id, source_checksum AS d FROM windows WHERE seq <> 3) e FULL JOIN (SELECT window_id AS id, sha256(window_id) AS d FROM windows WHERE seq <> 5) a ON a.id = e.id
WHERE a.id IS NULL OR e.id IS NULL OR e.d <> a.d
UNION ALL SELECT 'sources', coalesce(e.id, a.id), CASE WHEN a.id IS NULL THEN 'MISSING' WHEN e.id IS NULL THEN 'EXTRA' ELSE 'DIGEST_MISMATCH' END
FROM (SELECT cast(s_suppkey as varchar) AS id, sha256(s_name) AS d FROM supplier) e FULL JOIN (SELECT cast(source_id as varchar) AS id, source_digest AS d FROM sources) a ON a.id = e.id
WHERE a.id IS NULL OR e.id IS NULL OR e.d <> a.d""")
def _(t):
    e = t.windows.where("seq <> 3").select("window_id", F.col("source_checksum").alias("digest"))
    a = t.windows.where("seq <> 5").select("window_id", F.sha2("window_id", 256).alias("digest"))
    s = t.supplier.select(F.col("s_suppkey").alias("source_id"), F.sha2("s_name", 256).alias("digest"))
    return joins.reconcile(e, a, "window_id", "envelopes").unionByName(
        joins.reconcile(s, t.sources.select("source_id", F.col("source_digest").alias("digest")), "source_id", "sources"))


@query("join_18_stored_assurance_check", needs=("windows", "sources", "lineage"), oracle="""
WITH m AS (SELECT schedule_id AS case_id, window_id AS record_id, supp AS source_id, source_checksum AS expected_digest, sha256('Supplier#' || lpad(cast(supp as varchar), 9, '0') || ':' || cast(section_id % 25 as varchar)) AS expected_source,
   CASE WHEN section_id % 9 = 0 THEN 'x' ELSE cast(section_id % 3 as varchar) END AS expected_lineage FROM windows),
r AS (SELECT window_id AS record_id, sha256(window_id) AS computed, CASE WHEN days = 50 THEN 'altered' ELSE sha256(window_id) END AS stored, cast(section_id % 3 as varchar) AS lin FROM windows WHERE seq <> 6)
SELECT case_id, m.record_id, CASE WHEN computed IS NULL THEN 'RECORD_MISSING' WHEN expected_digest <> computed OR stored <> computed THEN 'RECORD_DIGEST'
  WHEN source_digest IS NULL OR source_digest <> expected_source THEN 'SOURCE_DIGEST' WHEN lin IS DISTINCT FROM expected_lineage THEN 'LINEAGE_DIGEST' END AS code
FROM m LEFT JOIN r ON r.record_id = m.record_id LEFT JOIN sources s ON s.source_id = m.source_id
WHERE computed IS NULL OR expected_digest <> computed OR stored <> computed OR source_digest IS NULL OR source_digest <> expected_source OR lin IS DISTINCT FROM expected_lineage""")
def _(t):
    c = F.col
    name = F.concat(F.lit("Supplier#"), F.lpad(c("supp").cast("string"), 9, "0"), F.lit(":"), (c("section_id") % 25).cast("string"))
    manifest = t.windows.select(
        c("schedule_id").alias("case_id"), c("window_id").alias("record_id"), c("supp").alias("source_id"), c("source_checksum").alias("expected_digest"),
        F.sha2(name, 256).alias("expected_source"),
        F.when(c("section_id") % 9 == 0, "x").otherwise((c("section_id") % 3).cast("string")).alias("expected_lineage"))
    kept = t.windows.where("seq <> 6")
    digest = F.sha2("window_id", 256)
    records = kept.select(c("window_id").alias("record_id"), digest.alias("computed_digest"), F.when(c("days") == 50, "altered").otherwise(digest).alias("stored_digest"))
    lineage = kept.select(c("window_id").alias("record_id"), (c("section_id") % 3).cast("string").alias("lineage_digest"))
    return joins.invalid_manifest_rows(manifest, records, t.sources.select("source_id", "source_digest"), lineage)


@query("join_18_receipt_binding", needs=("outcomes", "routes"), oracle="""
SELECT case_id AS receipt_id, CASE WHEN case_id % 8 = 3 THEN 'UNBOUND' ELSE 'REVIEWER_RULE' END AS code FROM outcomes
WHERE case_id % 8 = 3 OR (case_id % 2 = 0 AND (case_id % 3 = 0 OR case_id % 5 = 1 OR case_id % 7 = case_id % 11))""")
def _(t):
    c = F.col
    r = t.outcomes.select(
        c("case_id").alias("receipt_id"), c("case_id").alias("snapshot_id"), F.when(c("case_id") % 8 == 3, "old").otherwise("d").alias("snapshot_digest"),
        F.when(c("case_id") % 2 == 0, "ATTESTED").otherwise("REJECTED").alias("outcome"), F.when(c("case_id") % 3 == 0, "viewer").otherwise("approver").alias("reviewer_role"),
        (c("case_id") % 7).alias("reviewer_id"))
    s = t.outcomes.select(c("case_id").alias("snapshot_id"), "case_id", F.lit("d").alias("bundle_digest"))
    k = t.outcomes.select("case_id", F.when(c("case_id") % 5 != 1, c("case_id") % 7).alias("assigned_reviewer_id"), (c("case_id") % 11).alias("owner_id"))
    return joins.invalid_receipts(r, s, k)


@query("join_19_neighbourhood", needs=("lineage", "members"), oracle="""
SELECT m.record_id, x.side, x.neighbour, x.relation FROM members m JOIN (SELECT child AS id, parent AS neighbour, 'PARENT' AS side, relation FROM lineage UNION ALL SELECT parent, child, 'CHILD', relation FROM lineage) x ON x.id = m.record_id
JOIN members n ON n.record_id = x.neighbour AND n.user_id = m.user_id""")
def _(t):
    return joins.neighbourhood(t.members, t.lineage)


@query("join_20_resolved_legs", needs=("legs", "checks"), oracle="""
WITH j AS (SELECT l.*, c.overall_status, l.check_id IS NOT NULL AND c.check_id IS NULL AS bad FROM legs l LEFT JOIN checks c ON c.check_id = l.check_id)
SELECT plan_id, seq, tie, CASE WHEN overall_status IS NULL THEN compliance_status WHEN overall_status = 'PASS' THEN 'PASSED' WHEN overall_status IN ('WARNING', 'BLOCKED', 'MANUAL_REVIEW') THEN overall_status ELSE 'MANUAL_REVIEW' END AS resolved_status,
  NOT bool_or(bad) OVER (PARTITION BY plan_id) AS plan_ok FROM j""")
def _(t):
    return joins.resolved_legs(t.legs, t.checks).select("plan_id", "seq", "tie", "resolved_status", "plan_ok")


@query("join_21_port_areas", needs=("positions",), oracle="""
SELECT position_id, CASE WHEN lat BETWEEN 18.93 AND 18.97 AND lon BETWEEN 72.92 AND 72.99 THEN 'BERTH' WHEN lat BETWEEN 18.85 AND 19.05 AND lon BETWEEN 72.80 AND 73.05 THEN 'APPROACH' ELSE 'OUTSIDE' END AS area FROM positions""")
def _(t):
    return joins.port_areas(t.positions).select("position_id", "area")


@query("join_22_sealed_timing", needs=("schedules",), oracle="""
SELECT schedule_id, CASE WHEN schedule_id % 10 = 0 THEN 'NO_SEALED_TIMING' WHEN schedule_id % 6 = 5 THEN 'ARRIVAL_MISMATCH'
  WHEN (CASE WHEN schedule_id % 8 = 0 THEN NULL ELSE berth_start END) IS NULL THEN CASE WHEN berth_start IS NULL AND berth_end IS NULL THEN 'MATCH' ELSE 'WINDOW_MISMATCH' END
  WHEN schedule_id % 12 = 4 THEN 'WINDOW_MISMATCH' ELSE 'MATCH' END AS verdict FROM schedules""")
def _(t):
    c = F.col
    absent = c("schedule_id") % 8 == 0
    drift = F.when(c("schedule_id") % 12 == 4, 400).otherwise(200)
    sealed = t.schedules.where("schedule_id % 10 <> 0").select(
        "schedule_id", (c("departs_at") + F.expr("interval 30 seconds")).alias("evaluated_at"),
        (((1 + c("schedule_id") % 40) * 21600 + F.when(c("schedule_id") % 6 == 5, 600).otherwise(0)) / 3600).alias("arrival_hours"),
        F.when(~absent, F.timestamp_micros(F.unix_micros("berth_start") + drift * 1_000_000)).alias("window_start"),
        F.when(~absent, c("berth_end")).alias("window_end"))
    return joins.sealed_timing(t.schedules, sealed)


@query("join_23_referential_checks", needs=("checks", "sources"), oracle="""
SELECT 'UNKNOWN_SOURCE' AS code, cast(source_id as varchar) AS ref FROM (SELECT DISTINCT l_suppkey AS source_id FROM lineitem) x WHERE source_id NOT IN (SELECT source_id FROM sources)
UNION ALL SELECT 'UNKNOWN_TRIP', cast(o_orderkey as varchar) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def _(t):
    used = t.lineitem.select(F.col("l_suppkey").alias("source_id"), F.col("l_orderkey").alias("trip_id"))
    return joins.dangling(used, t.sources, "source_id", "UNKNOWN_SOURCE").unionByName(
        joins.dangling(t.orders.select(F.col("o_orderkey").alias("trip_id")), used, "trip_id", "UNKNOWN_TRIP"))


@query("join_24_foreign_parents", needs=("lineage", "members"), oracle="""
SELECT child // 1000 AS case_id, (child // 1000) % 150 AS owner_id, parent AS record_id, child FROM lineage WHERE NOT EXISTS (
  SELECT 1 FROM members WHERE record_id = parent AND record_id // 1000 = child // 1000 AND user_id = (child // 1000) % 150)""")
def _(t):
    case = lambda c: F.floor(F.col(c) / 1000)
    declared = t.lineage.select(case("child").alias("case_id"), (case("child") % 150).alias("owner_id"), F.col("parent").alias("record_id"), "child", "relation")
    links = t.members.select(case("record_id").alias("case_id"), F.col("user_id").alias("owner_id"), "record_id")
    return joins.foreign_parents(declared, links).select("case_id", "owner_id", "record_id", "child")


@query("join_25_plans_with_legs", needs=("legs", "chains"), oracle="""
SELECT p.plan_id, created_key, seq, tie, row_number() OVER (PARTITION BY p.plan_id ORDER BY seq, tie) AS leg_no FROM (SELECT * FROM chains ORDER BY created_key DESC, plan_id DESC LIMIT 50) p JOIN legs l ON l.plan_id = p.plan_id""")
def _(t):
    out = joins.newest_plans(t.chains.withColumn("created_at", F.col("created_key")), t.legs, 50)
    return out.select("plan_id", "created_key", "seq", "tie", "leg_no")


# --- windows --------------------------------------------------------------------------


@query("win_01_latest_position", needs=("positions",), oracle="""
SELECT shipment_id, position_id, speed FROM (SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY observed_at DESC, received_at DESC, position_id DESC) AS rn FROM positions) p WHERE rn = 1""")
def _(t):
    return windows.latest_position(t.positions).select("shipment_id", "position_id", "speed")


@query("win_02_stop_sequence_checks", oracle="""
SELECT trip_id, file_row, unnest(list_filter([CASE WHEN dep < arr THEN 'DEPARTS_BEFORE_ARRIVAL' END, CASE WHEN sq <= psq THEN 'NON_INCREASING_SEQUENCE' END, CASE WHEN arr < pdep THEN 'BACKWARDS_IN_TIME' END], lambda x: x IS NOT NULL)) AS code
FROM (SELECT *, lag(sq) OVER w AS psq, lag(dep) OVER w AS pdep FROM (SELECT l_suppkey AS trip_id, l_orderkey * 8 + l_linenumber AS file_row, l_partkey AS part, l_orderkey // 3 AS sq, l_orderkey * 60 + (l_partkey % 5) * 100 AS arr,
   l_orderkey * 60 + (l_partkey % 5) * 100 + l_partkey % 40 - 1 AS dep, cast(round(l_extendedprice * 100) as bigint) AS tie FROM lineitem) s WINDOW w AS (PARTITION BY trip_id ORDER BY file_row, tie)) x""")
def _(t):
    c = F.col
    arr = c("l_orderkey") * 60 + (c("l_partkey") % 5) * 100
    st = t.lineitem.select(
        c("l_suppkey").alias("trip_id"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("file_row"), F.floor(c("l_orderkey") / 3).alias("stop_sequence"),
        arr.alias("arrival_s"), (arr + c("l_partkey") % 40 - 1).alias("departure_s"), F.round(c("l_extendedprice") * 100).cast("bigint").alias("tie"))
    out = windows.stop_sequence_errors(st, ordered.number_slot("file_row", 20_000), ["file_row", "tie"])
    return out.select("trip_id", "file_row", "code")


@query("win_03_leg_continuity", needs=("legs", "chains"), oracle="""
WITH x AS (SELECT *, lag(destination) OVER (PARTITION BY plan_id ORDER BY seq, tie) AS pd FROM legs),
e AS (SELECT plan_id, arg_min(origin, (seq, tie)) AS o, arg_max(destination, (seq, tie)) AS d, min(seq) AS lo, max(seq) AS hi FROM legs GROUP BY plan_id)
SELECT plan_id, 'DISCONTINUOUS' AS code, seq FROM x WHERE lower(pd) <> lower(origin)
UNION ALL SELECT e.plan_id, 'WRONG_START', lo FROM e JOIN chains c ON c.plan_id = e.plan_id WHERE lower(o) <> lower(plan_origin)
UNION ALL SELECT e.plan_id, 'WRONG_END', hi FROM e JOIN chains c ON c.plan_id = e.plan_id WHERE lower(d) <> lower(plan_destination)""")
def _(t):
    return windows.leg_continuity(t.legs, t.chains)


@query("win_04_chronological_split", needs=("features",), oracle="""
SELECT row_id, CASE WHEN i <= greatest(1, floor(n * 0.7e0)) THEN 'train' WHEN i <= greatest(greatest(1, floor(n * 0.7e0)) + 1, floor(n * 0.85e0)) THEN 'validation' ELSE 'test' END AS part
FROM (SELECT row_id, row_number() OVER (ORDER BY observation_time, row_id) AS i, count(*) OVER () AS n FROM features) x""")
def _(t):
    slot = ordered.hour_slot("observation_time", 24)
    return windows.chronological_split(t.features, "observation_time", "row_id", slot).select("row_id", "part")


@query("win_07_new_rows_since_marker", needs=("obs",), oracle="""
SELECT event_id, event_type FROM obs WHERE (seen, event_id) > (timestamp '2024-01-15 12:00:00', 5000) ORDER BY seen, event_id LIMIT 25""")
def _(t):
    marker = F.struct(F.lit("2024-01-15 12:00:00").cast("timestamp").alias("created_at"), F.lit(5000).cast("bigint").alias("event_id"))
    return windows.newer_than(t.obs.withColumnRenamed("seen", "created_at"), marker).select("event_id", "event_type")


def attempts(t):
    return t.obs.select(F.concat_ws("-", "provider_key", (F.col("user_id") % 7).cast("string")).alias("provider"), F.col("seen").alias("at"),
                        F.col("event_id").alias("attempt_id"), (F.col("k") % 4 == 0).alias("ok"))


ATTEMPTS_SQL = "SELECT provider_key || '-' || cast(user_id % 7 as varchar) AS provider, seen AS at_, event_id AS attempt_id, k % 4 = 0 AS ok FROM obs"


@query("win_08_circuit_states", needs=("obs",), oracle=f"""
WITH a AS ({ATTEMPTS_SQL}), s AS (SELECT provider, max(at_) FILTER (ok) AS ls, max(at_) FILTER (NOT ok) AS lf FROM a GROUP BY provider),
f AS (SELECT a.provider, count(*) AS n, max(at_) AS t FROM a JOIN s ON s.provider = a.provider WHERE NOT ok AND (ls IS NULL OR at_ > ls) GROUP BY a.provider)
SELECT s.provider, coalesce(n, 0) AS failures, CASE WHEN coalesce(n, 0) < 3 THEN 'CLOSED' WHEN timestamp '2024-01-30 23:58:00' >= t + INTERVAL 120 SECOND THEN 'HALF_OPEN' ELSE 'OPEN' END AS state,
  epoch_us(ls) AS last_success_at, epoch_us(lf) AS last_failure_at FROM s LEFT JOIN f ON f.provider = s.provider""")
def _(t):
    out = windows.circuit_states(attempts(t), F.lit("2024-01-30 23:58:00").cast("timestamp"))
    return micros(out, "last_success_at", "last_failure_at").drop("next_attempt_at")


@query("win_08_failure_streaks", needs=("obs",), oracle=f"""
SELECT provider, attempt_id, f - coalesce(max(CASE WHEN ok THEN f END) OVER (PARTITION BY provider ORDER BY at_, attempt_id), 0) AS streak
FROM (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY provider ORDER BY at_, attempt_id) AS f FROM ({ATTEMPTS_SQL}) a) x""")
def _(t):
    return windows.failure_streaks(attempts(t), ordered.hour_slot("at", 6)).select("provider", "attempt_id", "streak")


@query("win_09_even_sample", needs=("positions",), oracle="""
WITH r AS (SELECT shipment_id, position_id, row_number() OVER (PARTITION BY shipment_id ORDER BY observed_at, position_id) AS i, count(*) OVER (PARTITION BY shipment_id) AS m FROM positions)
SELECT DISTINCT shipment_id, position_id FROM r CROSS JOIN range(5) p(j) WHERE m <= 5 OR i = 1 + cast(round_even(j * (m - 1) / 4.0e0, 0) as bigint)""")
def _(t):
    out = windows.even_sample(t.positions, "shipment_id", ["observed_at", "position_id"], ordered.hour_slot("observed_at", 24), 5)
    return out.select("shipment_id", "position_id")


@query("win_11_latest_models", needs=("predictions",), oracle="""
SELECT model_name, version, model_id, status FROM (SELECT *, row_number() OVER (PARTITION BY model_name, version ORDER BY status = 'PRODUCTION' DESC, predicted_at DESC, model_id DESC) AS rn
 FROM (SELECT model_name, model_version || '.' || cast(user_id % 20 as varchar) AS version, prediction_id AS model_id, predicted_at, CASE WHEN prediction_id % 9 = 0 THEN 'PRODUCTION' ELSE 'CANDIDATE' END AS status FROM predictions) m) x WHERE rn = 1""")
def _(t):
    m = t.predictions.select(
        "model_name", F.concat_ws(".", "model_version", (F.col("user_id") % 20).cast("string")).alias("version"), F.col("prediction_id").alias("model_id"),
        F.col("predicted_at").alias("created_at"), F.when(F.col("prediction_id") % 9 == 0, "PRODUCTION").otherwise("CANDIDATE").alias("status"))
    return windows.latest_models(m).select("model_name", "version", "model_id", "status")


@query("win_12_latest_record_per_role", needs=("trace_records",), oracle="""
SELECT decision_id, role, max(record_id) AS record_id FROM (SELECT decision_id, role, record_id, rank() OVER (PARTITION BY decision_id, role ORDER BY fetched_at DESC, record_id DESC) AS rk
 FROM trace_records WHERE role IS NOT NULL AND fetched_at IS NOT NULL) x WHERE rk = 1 GROUP BY decision_id, role""")
def _(t):
    rows = t.trace_records.where("role is not null and fetched_at is not null").select("decision_id", "role", "record_id", "fetched_at")
    return windows.latest_per_role(rows, ["decision_id", "role"]).select("decision_id", "role", "record_id")


@query("win_13_route_samples", needs=("route_legs", "segment_points"), oracle=f"""
WITH pieces AS ({PIECES_SQL}), lines AS (SELECT seg_id, sum(len) AS total, round(sum(2 * 6371.0 * asin(sqrt(least(1.0::double, pow(sin(radians(b_lat - a_lat) / 2), 2) + cos(radians(a_lat)) * cos(radians(b_lat)) * pow(sin(radians(b_lon - a_lon) / 2), 2))))), 1) AS km FROM pieces GROUP BY seg_id),
lg AS (SELECT route_id, seg_id, seq - 1 AS leg_no FROM route_legs), per AS (SELECT route_id, count(*) AS n, CASE WHEN round(sum(km), 6) < 500 THEN 3 ELSE 5 END AS c FROM lg JOIN lines USING (seg_id) GROUP BY route_id),
pk AS (SELECT route_id, i, i / cast(c - 1 as double) * n AS place, n FROM per CROSS JOIN range(5) r(i) WHERE i < c),
on_ AS (SELECT p.route_id, i, seg_id, (place - least(n - 1, floor(place))) * total AS want, total FROM pk p JOIN lg ON lg.route_id = p.route_id AND leg_no = least(n - 1, floor(place)) JOIN lines USING (seg_id)),
hit AS (SELECT o.route_id, i, least(1.0::double, (want - upto + len) / len) AS t, a_lat, a_lon, b_lat, b_lon FROM on_ o JOIN pieces USING (seg_id) WHERE want >= upto - len AND (want < upto OR upto >= total - 1e-9))
SELECT route_id, lat, lon, min(i) AS sample FROM (SELECT route_id, i, round(a_lat + (b_lat - a_lat) * t, 4) AS lat, round(a_lon + (b_lon - a_lon) * t, 4) AS lon FROM hit) h GROUP BY route_id, lat, lon""")
def _(t):
    # routes whose stored legs are numbered without gaps
    full = t.route_legs.select("route_id", "seg_id", (F.col("seq") - 1).cast("bigint").alias("leg_no"))
    return windows.route_samples(full, t.segment_points)


QUOTA_SQL = """
WITH RECURSIVE r AS (SELECT user_id % 5 AS provider, month(seen) AS month, event_id, seen, CASE WHEN k % 3 = 2 THEN -1 ELSE 1 END AS d,
   row_number() OVER (PARTITION BY user_id % 5, month(seen) ORDER BY seen, event_id) AS i FROM obs),
s AS (SELECT provider, month, i, event_id, (d < 0 OR 40 > 0) AS admitted, greatest(0, least(40, d)) AS used FROM r WHERE i = 1
  UNION ALL SELECT r.provider, r.month, r.i, r.event_id, r.d < 0 OR s.used < 40, greatest(0, least(40, s.used + r.d)) FROM s JOIN r ON r.provider = s.provider AND r.month = s.month AND r.i = s.i + 1)
SELECT provider, event_id, admitted, used FROM s"""


@query("win_06_quota_ledger", needs=("obs",), oracle=QUOTA_SQL)
def _(t):
    req = t.obs.select((F.col("user_id") % 5).alias("provider"), F.date_trunc("month", "seen").alias("month"), "seen", "event_id",
                       F.when(F.col("k") % 3 == 2, "refund").otherwise("spend").alias("kind"))
    out = windows.quota_ledger(req, ["provider", "month"], ["seen", "event_id"], 40)
    return out.select("provider", "event_id", "admitted", "used")


# --- listings and sets -------------------------------------------------------------------


@query("prj_01_owner_scope", needs=("routes",), oracle="SELECT route_id, owner FROM (SELECT route_id, CASE WHEN route_id % 5 <> 0 THEN user_id % 10 END AS owner FROM routes) r WHERE owner IS NULL OR owner = 3")
def _(t):
    r = t.routes.select("route_id", F.when(F.col("route_id") % 5 != 0, F.col("user_id") % 10).alias("owner"))
    return selections.owned(r, F.lit(3), shared=True, column="owner")


@query("prj_23_event_state", needs=("obs",), oracle="SELECT event_id FROM obs WHERE event_type = 'error'")
def _(t):
    e = t.obs.withColumn("state", F.when(F.col("event_type") == "error", "OPEN").when(F.col("event_type") == "view", "RESOLVED").otherwise("DISMISSED"))
    return selections.in_state(e, "OPEN").select("event_id")


@query("prj_24_name_search", oracle="SELECT s_name AS name FROM supplier WHERE lower(s_name) LIKE '%er#00000000%' ORDER BY s_name LIMIT 10")
def _(t):
    return selections.name_search(t.supplier.select(F.col("s_name").alias("name")), "ER#00000000")


@query("prj_25_visible_cases", needs=("routes",), oracle="SELECT route_id AS case_id FROM routes WHERE user_id % 10 = 4 OR (route_id % 3 = 0 AND route_id % 11 = 4)")
def _(t):
    c = t.routes.select(F.col("route_id").alias("case_id"), (F.col("user_id") % 10).alias("owner_id"),
                        F.when(F.col("route_id") % 3 == 0, F.col("route_id") % 11).alias("reviewer_id"), F.col("created_at").alias("updated_at"))
    return selections.visible_cases(c, F.lit(4)).select("case_id")


@query("top_01_newest_rows", needs=("routes",), oracle="SELECT route_id, epoch_us(created_at) AS created_us FROM routes ORDER BY created_at DESC, route_id DESC LIMIT 100")
def _(t):
    return selections.newest_rows(t.routes, "created_at", "route_id", 100).select("route_id", F.unix_micros("created_at").alias("created_us"))


@query("top_02_page", needs=("schedules",), oracle="SELECT schedule_id, train_code FROM schedules ORDER BY departs_at, schedule_id LIMIT 250 OFFSET 500")
def _(t):
    return selections.page(t.schedules, ["departs_at", "schedule_id"], 250, 500).select("schedule_id", "train_code")


@query("top_04_best_alternates", needs=("journey_legs",), oracle="""
SELECT journey_id, path_id, score, rank FROM (SELECT journey_id, leg_no AS path_id, reliability_score AS score, row_number() OVER (PARTITION BY journey_id ORDER BY reliability_score DESC, leg_no, route_id) AS rank
 FROM (SELECT DISTINCT journey_id, leg_no, route_id, reliability_score, status FROM journey_legs) j WHERE status <> 'HARD_BLOCKED') x WHERE rank <= 2""")
def _(t):
    j = t.journey_legs.select("journey_id", "leg_no", "route_id", "reliability_score", "status").distinct()
    p = j.select("journey_id", F.struct("leg_no", "route_id").alias("path_id"), F.col("reliability_score").alias("score"), (F.col("status") == "HARD_BLOCKED").alias("blocked"))
    return selections.best_alternates(p, "journey_id").select("journey_id", F.col("path_id.leg_no").alias("path_id"), "score", "rank")


def audit(t):
    return selections.unioned(
        selections.audit_rows("ROUTE_DECISION", t.routes, "route_id", "created_at", "dest_code"),
        selections.audit_rows("DELAY_PREDICTION", t.predictions, "prediction_id", "predicted_at", "model_version"),
        selections.audit_rows("SCHEDULE", t.schedules.where("status = 'CANCELLED'"), "schedule_id", "departs_at", "status"),
        selections.audit_rows("OBSERVATION", t.obs.where("not valid"), "event_id", "fetched_at", "status"))


AUDIT_SQL = """SELECT 'ROUTE_DECISION' AS type, cast(route_id as varchar) AS id, epoch_us(created_at) AS created_at, dest_code, NULL AS model_version, NULL AS status FROM routes
UNION ALL SELECT 'DELAY_PREDICTION', cast(prediction_id as varchar), epoch_us(predicted_at), NULL, model_version, NULL FROM predictions
UNION ALL SELECT 'SCHEDULE', cast(schedule_id as varchar), epoch_us(departs_at), NULL, NULL, status FROM schedules WHERE status = 'CANCELLED'
UNION ALL SELECT 'OBSERVATION', cast(event_id as varchar), epoch_us(fetched_at), NULL, NULL, status FROM obs WHERE NOT valid"""
AUDIT_NEEDS = ("routes", "predictions", "schedules", "obs")


@query("set_01_audit_union", needs=AUDIT_NEEDS, oracle=AUDIT_SQL)
def _(t):
    return micros(audit(t), "created_at")


@query("top_05_newest_over_union", needs=AUDIT_NEEDS, oracle=f"SELECT type, id, created_at FROM ({AUDIT_SQL}) a ORDER BY created_at DESC, type || id DESC LIMIT 200")
def _(t):
    a = micros(audit(t), "created_at").withColumn("tie", F.concat("type", "id"))
    return selections.newest_rows(a, "created_at", "tie", 200).select("type", "id", "created_at")


@query("top_06_enabled_sources", needs=("sources",), oracle="SELECT source_id, display_name FROM sources WHERE enabled")
def _(t):
    return selections.enabled_sources(t.sources).select("source_id", "display_name")


@query("top_07_labeled_predictions", needs=("predictions",), oracle="SELECT prediction_id FROM predictions WHERE actual_value IS NOT NULL ORDER BY predicted_at DESC, prediction_id DESC LIMIT 500")
def _(t):
    return selections.labeled_predictions(t.predictions, 500).select("prediction_id")


@query("set_02_case_timeline", needs=("routes", "trace_records", "outcomes"), oracle="""
SELECT route_id AS case_id, epoch_us(created_at) AS at_us, 'CASE_CREATED' AS event_type, cast(route_id as varchar) AS entity FROM routes
UNION ALL SELECT decision_id, epoch_us(fetched_at), 'EVIDENCE_CAPTURED', cast(record_id as varchar) FROM trace_records WHERE fetched_at IS NOT NULL
UNION ALL SELECT route_id, epoch_us(created_at) + 86400000000, 'CASE_ASSESSED', cast(route_id as varchar) FROM routes WHERE route_id % 2 = 0
UNION ALL SELECT route_id, epoch_us(created_at) + 172800000000, 'REVIEW_RECORDED', cast(route_id as varchar) FROM routes WHERE route_id % 4 = 0""")
def _(t):
    def part(df, case, time, kind, entity, shift=0):
        return df.select(F.col(case).alias("case_id"), (F.unix_micros(time) + shift).alias("at_us"), F.lit(kind).alias("event_type"), F.col(entity).cast("string").alias("entity"))

    day = 86_400_000_000
    return selections.unioned(
        part(t.routes, "route_id", "created_at", "CASE_CREATED", "route_id"),
        part(t.trace_records.where("fetched_at is not null"), "decision_id", "fetched_at", "EVIDENCE_CAPTURED", "record_id"),
        part(t.routes.where("route_id % 2 = 0"), "route_id", "created_at", "CASE_ASSESSED", "route_id", day),
        part(t.routes.where("route_id % 4 = 0"), "route_id", "created_at", "REVIEW_RECORDED", "route_id", 2 * day))


@query("set_03_set_equality", needs=("members", "trace_records"), oracle="""
SELECT a AS left_only, b AS right_only, a = 0 AND b = 0 AS equal FROM (SELECT (SELECT count(*) FROM (SELECT record_id FROM trace_records EXCEPT ALL SELECT record_id FROM members) x) AS a,
 (SELECT count(*) FROM (SELECT record_id FROM members EXCEPT ALL SELECT record_id FROM trace_records) y) AS b) z""")
def _(t):
    return selections.same_members(t.trace_records.select("record_id"), t.members.select("record_id"))


DOC_SQL = "SELECT l_orderkey AS check_id, CASE l_partkey % 5 WHEN 0 THEN 'PERMIT' WHEN 1 THEN 'INSURANCE' WHEN 2 THEN 'CARGO_DECLARATION' ELSE 'OTHER' END AS kind FROM lineitem"


@query("set_04_missing_kinds", oracle=f"""
SELECT o_orderkey AS check_id, r.kind AS missing FROM orders CROSS JOIN (VALUES ('PERMIT'), ('INSURANCE'), ('CARGO_DECLARATION')) r(kind)
WHERE NOT EXISTS (SELECT 1 FROM ({DOC_SQL}) d WHERE d.check_id = o_orderkey AND d.kind = r.kind)""")
def _(t):
    k = F.when(F.col("l_partkey") % 5 == 0, "PERMIT").when(F.col("l_partkey") % 5 == 1, "INSURANCE").when(F.col("l_partkey") % 5 == 2, "CARGO_DECLARATION").otherwise("OTHER")
    docs = t.lineitem.select(F.col("l_orderkey").alias("check_id"), k.alias("kind"))
    return selections.missing_kinds(docs, t.orders.select(F.col("o_orderkey").alias("check_id")), "check_id", "kind", REQUIRED_DOCUMENTS)


@query("set_05_ordered_distinct", needs=("legs",), oracle="SELECT plan_id, mode AS value, min(seq) AS first_pos FROM legs GROUP BY plan_id, mode")
def _(t):
    return agg.distinct_in_order(t.legs, "plan_id", "seq", "mode").select("plan_id", F.col("mode").alias("value"), "first_pos")


@query("set_06_labeled_union", needs=("features", "predictions"), oracle="""
SELECT row_id, data_class, remaining_delay_minutes AS target FROM features UNION ALL SELECT prediction_id, 'OPERATOR_CONFIRMED', actual_value FROM predictions WHERE actual_value IS NOT NULL""")
def _(t):
    a = t.features.select("row_id", "data_class", F.col("remaining_delay_minutes").alias("target"))
    b = t.predictions.where("actual_value is not null").select(F.col("prediction_id").alias("row_id"), F.lit("OPERATOR_CONFIRMED").alias("data_class"), F.col("actual_value").alias("target"))
    return selections.unioned(a, b)


KM_SQL = "2 * 6371.0 * asin(sqrt(least(1.0::double, pow(sin(radians(lat - 18.95e0) / 2), 2) + cos(radians(18.95e0)) * cos(radians(lat)) * pow(sin(radians(lon - 72.95e0) / 2), 2))))"
PLACES_SQL = "SELECT point_id AS station_id, ' Halt ' || cast(point_id % 40 as varchar) AS name, round(lat / 4, 1) + 0.0012e0 AS lat, round(lon / 4, 1) + 0.0012e0 AS lon FROM weather"


def places(t):
    return t.weather.select(F.col("point_id").alias("station_id"), F.concat(F.lit(" Halt "), (F.col("point_id") % 40).cast("string")).alias("name"),
                            (F.round(F.col("lat") / 4, 1) + 0.0012).alias("lat"), (F.round(F.col("lon") / 4, 1) + 0.0012).alias("lon"))


@query("set_07_distinct_stations", needs=("weather",), oracle=f"""
SELECT station_id, round({KM_SQL}, 1) AS km FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(name)), printf('%.2f', lat), printf('%.2f', lon) ORDER BY station_id) AS rn FROM ({PLACES_SQL}) p) q WHERE rn = 1) z""")
def _(t):
    return selections.distinct_stations(places(t), 18.95, 72.95).select("station_id", "km")


@query("set_08_nearest_per_name", needs=("weather",), oracle=f"""
SELECT name, arg_min(station_id, (round(km, 9), station_id)) AS station_id, round(min(km), 2) AS km FROM (SELECT *, {KM_SQL} AS km FROM ({PLACES_SQL}) p) q GROUP BY name""")
def _(t):
    return selections.nearest_per_name(places(t), 18.95, 72.95).select("name", "station_id", "km")


@query("fun_38_corridor_points", needs=("weather",), oracle="""
WITH p AS (SELECT route_id, point_id, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY route_id, printf('%.3f', lat), printf('%.3f', lon) ORDER BY point_id) AS rn FROM weather) x WHERE rn = 1),
d AS (SELECT *, (lat - 10) * 10 / sqrt(325.0e0) + (lon - 70) * 15 / sqrt(325.0e0) AS a0,
 2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - 10) / 2), 2) + cos(radians(10)) * cos(radians(lat)) * pow(sin(radians(lon - 70) / 2), 2))) AS d1,
 2 * 6371.0 * asin(sqrt(pow(sin(radians(lat - 20) / 2), 2) + cos(radians(20)) * cos(radians(lat)) * pow(sin(radians(lon - 85) / 2), 2))) AS d2,
 2 * 6371.0 * asin(sqrt(pow(sin(radians(10.0e0) / 2), 2) + cos(radians(10)) * cos(radians(20)) * pow(sin(radians(15.0e0) / 2), 2))) AS span FROM p)
SELECT route_id, point_id, row_number() OVER (PARTITION BY route_id ORDER BY round(((lat - 10) * 10 + (lon - 70) * 15) / sqrt(325.0e0), 9), point_id) AS position FROM d WHERE d1 < span * 1.6 AND d2 < span * 1.6""")
def _(t):
    pts = t.weather.select("route_id", "point_id", "lat", "lon", F.lit(10.0).alias("fa"), F.lit(70.0).alias("fo"), F.lit(20.0).alias("ta"), F.lit(85.0).alias("to"))
    return selections.ordered_points(pts, "route_id", 2.0, ("fa", "fo", "ta", "to")).select("route_id", "point_id", "position")
