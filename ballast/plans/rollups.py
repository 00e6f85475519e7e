"""Aggregations over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballast.functions import track
from ballast.functions.delay import delay_risk
from ballast.operators import aggregates as agg
from ballast.operators import statistics as st
from ballast.functions.vocab import REAL_CLASSES
from ballast.operators.ordered import hour_slot, percentiles
from ballast.operators.windows import chronological_split
from ballast.plans.registry import query
from ballast.plans.scalars import CONDITIONS_SQL, all_conditions, joined

RULES = ["b0", "b1", "b2", "b3", "b4", "full_gate"]
PAIRS = [("full_gate", r) for r in RULES[:-1]]


@query("agg_01_route_congestion_score", needs=("route_legs", "routes"), oracle="""
SELECT r.route_id, coalesce(round(greatest(0.0::double, least(100.0::double, 100 - (f - 1) * 40)), 6), 50.0e0) AS score
FROM routes r LEFT JOIN (SELECT route_id, avg(factor) AS f FROM route_legs GROUP BY route_id) g USING (route_id)""")
def _(t):
    return agg.route_scores(t.route_legs, t.routes).select("route_id", F.round("congestion_score", 6).alias("score"))


@query("agg_02_route_historical_score", needs=("route_legs", "routes"), oracle="""
SELECT r.route_id, coalesce(round(greatest(0.0::double, least(100.0::double, 100 - d * 10)), 6), 75.0e0) AS score
FROM routes r LEFT JOIN (SELECT route_id, avg(delay_h) AS d FROM route_legs GROUP BY route_id) g USING (route_id)""")
def _(t):
    return agg.route_scores(t.route_legs, t.routes).select("route_id", F.round("historical_score", 6).alias("score"))


@query("agg_03_transit_hours", needs=("route_legs", "routes"), oracle="""
SELECT r.route_id, coalesce(round(n * 4.5e0 + s, 2), 0) AS transit_hours, coalesce(round(k / 45 + s, 2), 0) AS eta_hours
FROM routes r LEFT JOIN (SELECT route_id, count(*) AS n, sum(delay_h) AS s, sum(delay_h * 100) AS k FROM route_legs GROUP BY route_id) g USING (route_id)""")
def _(t):
    eta = agg.remaining_hours(t.route_legs.withColumn("km", F.col("delay_h") * 100), routes=t.routes).select("route_id", "eta_hours")
    return agg.route_scores(t.route_legs, t.routes).select("route_id", "transit_hours").join(eta, "route_id")


@query("agg_04_clearance_decision", needs=("route_legs", "routes"), oracle="""
SELECT r.route_id, b AS blocking_segment, CASE WHEN b IS NULL THEN 'APPROVED' ELSE 'HARD_BLOCKED' END AS status
FROM routes r LEFT JOIN (SELECT route_id, min_by(seg_id, seq * 100000 + seg_id) FILTER (cargo_h > max_h OR cargo_w > max_w OR cargo_t > max_t) AS b FROM route_legs GROUP BY route_id) g USING (route_id)""")
def _(t):
    return agg.clearance(t.route_legs, t.routes)


@query("agg_05_station_board", needs=("boards",), oracle="""
SELECT station, reading, count(*) AS trains, round(coalesce(avg(delay), 0), 1) AS mean_delay, coalesce(max(delay), 0) AS max_delay,
  count(*) FILTER (live_type = 'at-station') AS at_station FROM boards GROUP BY station, reading""")
def _(t):
    return agg.station_board(t.boards, ["station", "reading"])


@query("agg_06_corridor_score", needs=("readings",), oracle="""
SELECT corridor, source, observed_at, worst_delay, CASE WHEN m >= 180 THEN 0.0e0 WHEN m <= 15 THEN round(100 - 15 * (m / 15), 1)
  WHEN m <= 30 THEN round(85 + -15.0e0 * ((m - 15) / 15), 1) WHEN m <= 60 THEN round(70 + -30.0e0 * ((m - 30) / 30), 1)
  WHEN m <= 120 THEN round(40 + -30.0e0 * ((m - 60) / 60), 1) ELSE round(10 + -10.0e0 * ((m - 120) / 60), 1) END AS score
FROM (SELECT corridor, round(sum(mean_delay * greatest(trains, 1)) / sum(greatest(trains, 1)), 9) AS m, CASE WHEN bool_or(source = 'LIVE') THEN 'LIVE' ELSE 'CACHED' END AS source,
        epoch_us(min(observed_at)) AS observed_at, max(max_delay) AS worst_delay FROM readings WHERE source <> 'UNAVAILABLE' GROUP BY corridor) g""")
def _(t):
    return agg.corridor_score(t.readings, "corridor").withColumn("observed_at", F.unix_micros("observed_at"))


PORT_AT = "2024-01-30 23:50:00"


@query("agg_07_port_activity", needs=("positions",), oracle=f"""
SELECT region, count(*) AS tracked, count(*) FILTER (nav_status = 1) AS at_anchor,
  count(*) FILTER (nav_status = 5 AND lat BETWEEN 18.93 AND 18.97 AND lon BETWEEN 72.92 AND 72.99) AS moored, count(*) FILTER (nav_status = 0) AS underway,
  CASE WHEN epoch_us(timestamp '{PORT_AT}') - epoch_us(max(observed_at)) > 600000000 THEN 'STALE_AIS' ELSE 'LIVE_AIS' END AS source
FROM (SELECT *, shipment_id % 4 AS region, row_number() OVER (PARTITION BY shipment_id ORDER BY observed_at DESC, position_id DESC) AS rn FROM positions) p
WHERE rn = 1 AND observed_at >= timestamp '{PORT_AT}' - INTERVAL 2 DAY GROUP BY region""")
def _(t):
    msgs = t.positions.select(F.col("shipment_id").alias("vessel_id"), F.col("observed_at").alias("seen_at"),
                              F.col("position_id").alias("message_id"), "nav_status", "lat", "lon")
    latest = agg.latest_vessels(msgs).withColumn("region", F.col("vessel_id") % 4)
    out = agg.port_activity(latest, F.lit(PORT_AT).cast("timestamp"), ["region"], expiry_min=2 * 24 * 60)
    return out.select("region", "tracked", "at_anchor", "moored", "underway", "source")


@query("fun_09_resolved_congestion", needs=("routes", "readings", "route_legs"), oracle="""
WITH live AS (SELECT corridor, round(sum(mean_delay * greatest(trains, 1)) / sum(greatest(trains, 1)), 9) AS m, max(max_delay) AS worst FROM readings WHERE source <> 'UNAVAILABLE' GROUP BY corridor),
curve AS (SELECT corridor, worst, CASE WHEN m >= 180 THEN 0.0e0 WHEN m <= 15 THEN round(100 - 15 * (m / 15), 1)
  WHEN m <= 30 THEN round(85 + -15.0e0 * ((m - 15) / 15), 1) WHEN m <= 60 THEN round(70 + -30.0e0 * ((m - 30) / 30), 1)
  WHEN m <= 120 THEN round(40 + -30.0e0 * ((m - 60) / 60), 1) ELSE round(10 + -10.0e0 * ((m - 120) / 60), 1) END AS live FROM live),
st AS (SELECT route_id, round(greatest(0.0::double, least(100.0::double, 100 - (avg(factor) - 1) * 40)), 6) + 0.0137e0 AS s FROM route_legs GROUP BY route_id),
x AS (SELECT r.route_id, s, live, worst, dest_code = 'JNPT' AS port, 30.0e0 + r.route_id % 70 AS pct, r.route_id % 14 AS anchored
      FROM routes r JOIN st USING (route_id) LEFT JOIN curve ON corridor = r.user_id)
SELECT route_id, CASE WHEN live IS NULL THEN s WHEN port THEN round(greatest(0.0::double, round(s * (1 - 0.6e0) + live * 0.6e0, 1) - round(least(25.0::double, pct * 0.25e0), 1)), 1)
    ELSE round(s * (1 - 0.6e0) + live * 0.6e0, 1) END AS score,
  CASE WHEN live IS NULL THEN 'STATIC_ONLY' WHEN port THEN 'STATIC_PLUS_LIVE_RAIL_AND_PORT' ELSE 'STATIC_PLUS_LIVE_RAIL' END AS source,
  concat_ws(',', CASE WHEN live IS NOT NULL AND worst >= 60 THEN 'LONG_DELAYS' END, CASE WHEN live IS NOT NULL AND port AND anchored >= 7 THEN 'BERTH_QUEUE' END) AS alerts FROM x""")
def _(t):
    from ballast.functions.scoring import resolved_congestion

    live = agg.corridor_score(t.readings, "corridor").select("corridor", F.col("score").alias("live"), "worst_delay")
    static = agg.route_scores(t.route_legs).select("route_id", (F.round("congestion_score", 6) + 0.0137).alias("static"))
    j = t.routes.join(static, "route_id").join(live, F.col("user_id") == F.col("corridor"), "left")
    v = resolved_congestion(F.col("static"), F.col("live"), F.col("worst_delay"), F.col("dest_code"),
                            30.0 + F.col("route_id") % 70, F.col("route_id") % 14)
    return j.select("route_id", v.alias("v")).select("route_id", "v.score", "v.source", joined("v.alerts").alias("alerts"))


@query("agg_08_group_counts", needs=("schedules",), oracle="SELECT status AS key, count(*) AS n FROM schedules GROUP BY status")
def _(t):
    return agg.group_counts(t.schedules, "status")


@query("agg_09_operations_overview", needs=("schedules", "routes", "obs", "legs", "checks", "predictions"), oracle="""
SELECT 'schedules' AS section, status AS key, count(*) AS n FROM schedules GROUP BY status
UNION ALL SELECT 'events', event_type, count(*) FROM obs WHERE status <> 'LIVE' GROUP BY event_type
UNION ALL SELECT 'compliance', overall_status, count(*) FROM checks GROUP BY overall_status
UNION ALL SELECT 'legs', mode, count(*) FROM legs GROUP BY mode UNION ALL SELECT 'sync', status, count(*) FROM obs GROUP BY status
UNION ALL SELECT 'total', 'routes', count(*) FROM routes UNION ALL SELECT 'total', 'predictions', count(*) FROM predictions""")
def _(t):
    return agg.overview(
        {"schedules": (t.schedules, "status"), "events": (t.obs.where("status <> 'LIVE'"), "event_type"),
         "compliance": (t.checks, "overall_status"), "legs": (t.legs, "mode"), "sync": (t.obs, "status")},
        {"routes": t.routes, "predictions": t.predictions})


@query("agg_10_traceability_summary", needs=("trace_records",), oracle="""
SELECT decision_id, traced, fresh, aging, stale, "unknown", not_applicable, included, excluded, informational, round(cast(traced as double) / 5 * 100, 1) AS coverage_pct
FROM (SELECT decision_id, count(DISTINCT CASE WHEN role IS NOT NULL AND fetched_at IS NOT NULL AND has_value AND (source_id IS NOT NULL OR source_type = 'UNAVAILABLE') THEN role END) AS traced,
  count(*) FILTER (freshness = 'FRESH') AS fresh, count(*) FILTER (freshness = 'AGING') AS aging, count(*) FILTER (freshness = 'STALE') AS stale,
  count(*) FILTER (freshness = 'UNKNOWN') AS "unknown", count(*) FILTER (freshness = 'NOT_APPLICABLE') AS not_applicable,
  count(*) FILTER (u = 'included') AS included, count(*) FILTER (u = 'excluded') AS excluded, count(*) FILTER (u = 'informational') AS informational
 FROM (SELECT *, CASE WHEN decision_use = 'excluded' THEN 'excluded' WHEN used THEN 'included' WHEN excluded_reason IS NOT NULL THEN 'excluded' ELSE 'informational' END AS u FROM trace_records) r
 GROUP BY decision_id) g""")
def _(t):
    return agg.traceability(t.trace_records, "decision_id")


@query("agg_10_source_modes", needs=("trace_records",), oracle="SELECT decision_id, source_type, count(*) AS n FROM trace_records GROUP BY decision_id, source_type")
def _(t):
    return agg.source_modes(t.trace_records, "decision_id")


@query("agg_11_missing_values", needs=("trace_records", "routes"), oracle="\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", n FROM (SELECT count(*) FILTER ({c} IS NULL) AS n FROM {src}) x WHERE n > 0"
    for src, names in (("trace_records", ("decision_id", "role", "source_id", "fetched_at", "excluded_reason")), ("routes", ("route_id", "weather_score", "port_score", "estimated_hours"))) for c in names))
def _(t):
    first = st.missing_values(t.trace_records.select("decision_id", "role", "source_id", "fetched_at", "excluded_reason"))
    return first.unionByName(st.missing_values(t.routes.select("route_id", "weather_score", "port_score", "estimated_hours")))


@query("agg_11_dataset_profile", needs=("features",), oracle="""
SELECT count(*) AS row_count, count(*) FILTER (data_class LIKE 'REAL%') AS real_row_count, count(*) FILTER (data_class = 'SIMULATED') AS simulated_row_count,
  count(*) FILTER (data_class = 'SEEDED') AS seeded_row_count, count(*) FILTER (data_class = 'OPERATOR_CONFIRMED') AS operator_confirmed_row_count,
  epoch_us(min(observation_time)) AS start_time, epoch_us(max(observation_time)) AS end_time,
  cast(greatest(1, ceil((epoch_us(max(observation_time)) - epoch_us(min(observation_time))) / 86400e6)) as int) AS coverage_days,
  count(DISTINCT route_id) AS routes_count, count(DISTINCT corridor) AS corridors_count, min(remaining_delay_minutes) AS target_min,
  round(avg(remaining_delay_minutes), 6) AS target_mean, max(remaining_delay_minutes) AS target_max, round(quantile_cont(remaining_delay_minutes, 0.5), 6) AS target_median FROM features""")
def _(t):
    r = st.dataset_report(t.features)
    return r.withColumns({c: F.unix_micros(c) for c in ("start_time", "end_time")}).withColumns(
        {c: F.round(c, 6) for c in ("target_mean", "target_median")})


CONFUSION_SQL = " UNION ALL ".join(
    f"SELECT '{r}' AS classifier, count(*) FILTER (expected_admissible AND {r}) AS tp, count(*) FILTER (NOT expected_admissible AND NOT {r}) AS tn, "
    f"count(*) FILTER (NOT expected_admissible AND {r}) AS fp, count(*) FILTER (expected_admissible AND NOT {r}) AS fn FROM outcomes" for r in RULES)


@query("agg_12_confusion_counts", needs=("outcomes",), oracle=CONFUSION_SQL)
def _(t):
    return st.confusion(t.outcomes, RULES, "expected_admissible")


@query("agg_13_classifier_metrics", needs=("outcomes",), oracle=f"""
WITH c AS ({CONFUSION_SQL}), d AS (SELECT *, sqrt(cast(tp + fp as double) * (tp + fn) * (tn + fp) * (tn + fn)) AS b FROM c)
SELECT classifier, tp, tn, fp, fn, round(CASE WHEN tn + fp > 0 THEN cast(fp as double) / (tn + fp) ELSE 0 END, 6) AS false_admission_rate,
  round(CASE WHEN tp + fn > 0 THEN cast(fn as double) / (tp + fn) ELSE 0 END, 6) AS false_hold_rate,
  round((CASE WHEN tp + fn > 0 THEN cast(tp as double) / (tp + fn) ELSE 0 END + CASE WHEN tn + fp > 0 THEN cast(tn as double) / (tn + fp) ELSE 0 END) / 2, 6) AS balanced_accuracy,
  round(CASE WHEN b > 0 THEN (cast(tp as double) * tn - cast(fp as double) * fn) / b ELSE 0 END, 6) AS matthews FROM d""")
def _(t):
    return st.classifier_metrics(st.confusion(t.outcomes, RULES, "expected_admissible"))


@query("agg_14_wilson_interval", needs=("outcomes",), oracle="""
SELECT fault_type, round(greatest(0.0::double, (p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4.0e0 * n * n)) / (1 + z * z / n)), 6) AS low,
  round(least(1.0::double, (p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4.0e0 * n * n)) / (1 + z * z / n)), 6) AS high
FROM (SELECT fault_type, count(*) AS n, cast(count(*) FILTER (b0) as double) / count(*) AS p, 1.959963984540054e0 AS z FROM outcomes GROUP BY fault_type) g""")
def _(t):
    per = t.outcomes.groupBy("fault_type").agg(F.count("*").alias("n"), F.count_if("b0").alias("k"))
    return per.select("fault_type", st.wilson(F.col("k"), F.col("n")).alias("w")).select("fault_type", "w.low", "w.high")


@query("agg_15_interpolated_percentiles", needs=("outcomes",), oracle="""
SELECT fault_type, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.95), 4) AS p95, round(quantile_cont(latency_ms, 0.99), 4) AS p99
FROM outcomes GROUP BY fault_type""")
def _(t):
    p = percentiles(t.outcomes, ["fault_type"], "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return p.select("fault_type", *[F.round(c, 4).alias(c) for c in ("p50", "p95", "p99")])


@query("agg_16_nearest_rank_percentile", needs=("outcomes",), oracle="""
SELECT fault_type, max(latency_ms) FILTER (rn = 1 + cast(round_even((n - 1) * 0.95e0, 0) as bigint)) AS p95
FROM (SELECT *, row_number() OVER (PARTITION BY fault_type ORDER BY latency_ms) AS rn, count(*) OVER (PARTITION BY fault_type) AS n FROM outcomes) o GROUP BY fault_type""")
def _(t):
    return percentiles(t.outcomes, ["fault_type"], "latency_ms", {"p95": 0.95}, method="nearest")


MCNEMAR_SQL = "SELECT *, l + r AS n, least(l, r) AS k FROM (" + " UNION ALL ".join(
    f"SELECT '{a}|{b}' AS pair, count(*) FILTER (({a} = expected_admissible) AND ({b} <> expected_admissible)) AS l, "
    f"count(*) FILTER (({b} = expected_admissible) AND ({a} <> expected_admissible)) AS r FROM outcomes" for a, b in PAIRS) + ") u"
LOG_P_SQL = f"""SELECT pair, l AS left_only, r AS right_only, n AS discordant,
  CASE WHEN n = 0 THEN 0.0e0 ELSE least(0.0::double, (ln(2.0::double) + lgamma(n + 1) - n * ln(2.0::double)
     + list_reduce(list_transform(range(0, k + 1), lambda i: -lgamma(i + 1) - lgamma(n - i + 1)),
         lambda a, b: greatest(a, b) + ln(1 + exp(least(a, b) - greatest(a, b))))) / ln(10.0::double)) END AS lp FROM ({MCNEMAR_SQL}) m"""


@query("agg_17_exact_mcnemar", needs=("outcomes",), oracle=f"""
SELECT pair, left_only, right_only, discordant, round(CASE WHEN lp > -324 THEN pow(10.0::double, lp) ELSE 0 END, 10) AS p, round(lp, 4) AS log10_p FROM ({LOG_P_SQL}) x""")
def _(t):
    r = st.exact_mcnemar(st.paired_disagreements(t.outcomes, PAIRS, "expected_admissible"))
    return r.withColumns({"p": F.round("p", 10), "log10_p": F.round("log10_p", 4)})


@query("win_05_holm_adjustment", needs=("outcomes",), oracle=f"""
SELECT pair, round(max(raw) OVER (ORDER BY p, pair ROWS UNBOUNDED PRECEDING), 9) AS adjusted_p
FROM (SELECT pair, p, least(1.0::double, (count(*) OVER () - row_number() OVER (ORDER BY p, pair) + 1) * p) AS raw
      FROM (SELECT pair, round(CASE WHEN lp > -324 THEN pow(10.0::double, lp) ELSE 0 END, 12) AS p FROM ({LOG_P_SQL}) x) y) z""")
def _(t):
    r = st.holm(st.exact_mcnemar(st.paired_disagreements(t.outcomes, PAIRS, "expected_admissible")))
    return r.select("pair", F.round("adjusted_p", 9).alias("adjusted_p"))


@query("agg_18_feature_bounds", needs=("features",), oracle=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, min({c}) AS low, max({c}) AS high FROM features" for c in st.FEATURES))
def _(t):
    return st.feature_bounds(t.features)


@query("agg_19_consist_totals", needs=("carriages",), oracle="""
SELECT o_orderkey AS consist_id, coalesce(round(sum(gross_t), 3), 0) AS gross_t, coalesce(round(sum(length_m), 3), 0) AS length_m, coalesce(max(height_m), 0) AS max_height_m,
  coalesce(max(width_m), 0) AS max_width_m, coalesce(round(max(gross_t / axles), 6), 0) AS max_axle_t,
  coalesce(count(position) = 1 + o_orderkey % 6 AND count(DISTINCT position) = count(position) AND min(position) = 1 AND max(position) = count(position), false) AS complete
FROM orders LEFT JOIN carriages ON consist_id = o_orderkey GROUP BY o_orderkey""")
def _(t):
    declared = t.orders.select(F.col("o_orderkey").alias("consist_id"), (1 + F.col("o_orderkey") % 6).alias("declared"))
    return agg.consist_totals(t.carriages, declared)


@query("agg_20_per_fault_summary", needs=("outcomes",), oracle="""
SELECT a.fault_type, code, n, cases, b0_admitted, full_gate_admitted FROM
 (SELECT fault_type, count(*) AS cases, count(*) FILTER (b0) AS b0_admitted, count(*) FILTER (full_gate) AS full_gate_admitted FROM outcomes GROUP BY fault_type) a
 LEFT JOIN (SELECT fault_type, code, count(*) AS n FROM (SELECT fault_type, unnest(string_split(reason_codes, '|')) AS code FROM outcomes) u WHERE code <> '' GROUP BY fault_type, code) r
 ON a.fault_type = r.fault_type""")
def _(t):
    cases = st.fault_summary(t.outcomes, ["b0", "full_gate"])
    return cases.join(st.reason_counts(t.outcomes, ["fault_type"]), "fault_type", "left")


DRIFT_SQL = """SELECT model_version, labels, fallback_rows, ml_rows, CASE WHEN labels < 20 THEN 'INSUFFICIENT_DATA' WHEN mae / ref > 1.5 THEN 'DRIFT_DETECTED' WHEN mae / ref > 1.2 THEN 'WATCH' ELSE 'STABLE' END AS status,
  CASE WHEN labels >= 20 THEN round(mae, 4) END AS observed_mae, CASE WHEN labels >= 20 THEN round(bias, 4) END AS observed_bias, CASE WHEN labels >= 20 THEN round(ref, 4) END AS reference_mae,
  CASE WHEN labels >= 20 THEN round(mae / ref, 4) END AS mae_ratio
FROM (SELECT model_version, count(*) AS labels, count(*) FILTER (f) AS fallback_rows, count(*) FILTER (NOT f) AS ml_rows, avg(abs(e)) AS mae, avg(e) AS bias, avg(CASE WHEN f THEN 5.5e0 ELSE 7.25e0 END) AS ref
      FROM (SELECT *, predicted_value - actual_value AS e, abs(predicted_value - deterministic_value) < 1e-9 AS f FROM predictions WHERE actual_value IS NOT NULL) p GROUP BY model_version) g"""


@query("agg_21_drift_report", needs=("predictions",), oracle=DRIFT_SQL)
def _(t):
    return st.drift_report(t.predictions, ["model_version"], 7.25, 5.5).drop("window_start", "window_end")


@query("agg_22_retraining_readiness", needs=("predictions",), oracle=f"""
SELECT d.model_version, enough_labels, enough_days, enough_routes, trusted_labels, status IN ('WATCH', 'DRIFT_DETECTED') AS drift_needs_attention,
  CASE WHEN enough_labels AND enough_days AND enough_routes AND trusted_labels AND status IN ('WATCH', 'DRIFT_DETECTED') THEN 'READY_FOR_MANUAL_REVIEW'
       WHEN status = 'STABLE' AND labels >= 20 THEN 'NOT_NEEDED' ELSE 'NOT_READY' END AS status
FROM ({DRIFT_SQL}) d JOIN (SELECT model_version, count(*) >= 100 AS enough_labels,
   floor((epoch_us(max(predicted_at)) - epoch_us(min(predicted_at))) / 86400e6) + 1 >= 14 AS enough_days, count(DISTINCT route_id) >= 3 AS enough_routes,
   bool_and(outcome_class = 'OPERATOR_CONFIRMED') AS trusted_labels FROM predictions WHERE actual_value IS NOT NULL GROUP BY model_version) g ON d.model_version = g.model_version""")
def _(t):
    drift = st.drift_report(t.predictions, ["model_version"], 7.25, 5.5)
    return st.retraining_readiness(t.predictions, drift, ["model_version"])


@query("agg_23_regression_metrics", needs=("predictions",), oracle="""
SELECT model_version, count(*) AS rows, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, round(quantile_cont(abs(y - p), 0.5), 4) AS median_ae,
  round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 5) AS r2
FROM (SELECT model_version, actual_value AS y, predicted_value + 0.00013e0 AS p FROM predictions WHERE actual_value IS NOT NULL) x GROUP BY model_version""")
def _(t):
    rows = t.predictions.where("actual_value is not null").withColumn("p", F.col("predicted_value") + 0.00013)
    return st.metric_set(rows, ["model_version"], "actual_value", "p")


@query("agg_24_residual_p90", needs=("features",), oracle="""
SELECT corridor, count(*) AS rows, round(quantile_cont(abs(remaining_delay_minutes - current_delay), 0.9), 4) AS p90,
  count(*) >= 30 AND bool_and(data_class IN ('REAL_LIVE', 'REAL_HISTORICAL')) AS trusted FROM features GROUP BY corridor""")
def _(t):
    """All rows of all corridors."""
    return st.residual_p90(t.features, ["corridor"], "remaining_delay_minutes", "current_delay")


@query("agg_25_promotion_gates", needs=("features",), oracle="""
SELECT a AS minimum_real_rows, b AS minimum_coverage_days, c AS minimum_corridors, d AS no_synthetic_test_rows, e AS beats_deterministic_by_10_pct, true AS no_forbidden_feature_leakage, a AND b AND c AND d AND e AS eligible
FROM (SELECT count(*) FILTER (data_class LIKE 'REAL%') >= 1000 AS a, ceil((epoch_us(max(observation_time)) - epoch_us(min(observation_time))) / 86400e6) >= 14 AS b,
  count(DISTINCT corridor) >= 3 AS c, 100 * (avg(abs(remaining_delay_minutes - current_delay)) - avg(abs(remaining_delay_minutes - 70))) / avg(abs(remaining_delay_minutes - current_delay)) >= 10 AS e FROM features) x,
 (SELECT bool_and(data_class LIKE 'REAL%') AS d FROM (SELECT data_class, row_number() OVER (ORDER BY observation_time, row_id) AS i, count(*) OVER () AS n FROM features) r WHERE i > greatest(greatest(1, floor(n * 0.7e0)) + 1, floor(n * 0.85e0))) y""")
def _(t):
    y = F.col("remaining_delay_minutes")
    err = t.features.agg(F.avg(F.abs(y - F.col("current_delay"))).alias("a"), F.avg(F.abs(y - 70)).alias("b"))
    split = chronological_split(t.features, "observation_time", "row_id", hour_slot("observation_time", 24))
    real = split.where("part = 'test'").agg(F.bool_and(F.col("data_class").isin(*REAL_CLASSES)).alias("all_real"))
    rep = st.dataset_report(t.features).crossJoin(F.broadcast(err)).crossJoin(F.broadcast(real))
    return st.promotion_gates(rep, (F.col("a") - F.col("b")) * 100 / F.col("a"), F.coalesce("all_real", F.lit(False)))


@query("agg_25_stored_gates", needs=("features",), oracle="""
SELECT corridor, concat_ws(',', CASE WHEN NOT beats THEN 'beats_deterministic_by_10_pct' END, CASE WHEN NOT days THEN 'minimum_coverage_days' END, CASE WHEN NOT rows_ THEN 'minimum_real_rows' END,
  'missing:minimum_corridors', 'no_forbidden_feature_leakage', CASE WHEN synthetic THEN 'no_synthetic_test_rows' END) AS missing
FROM (SELECT corridor, count(*) FILTER (data_class LIKE 'REAL%') >= 1000 AS rows_, ceil((epoch_us(max(observation_time)) - epoch_us(min(observation_time))) / 86400e6) >= 14 AS days,
  bool_or(data_class NOT LIKE 'REAL%') AS synthetic, avg(abs(remaining_delay_minutes - 70)) <= 0.9e0 * avg(abs(remaining_delay_minutes - current_delay)) AS beats FROM features GROUP BY corridor) g""")
def _(t):
    """Stored gate maps, one per corridor, without the gate on corridors and with an unknown one."""
    y, real = F.col("remaining_delay_minutes"), F.col("data_class").isin(*REAL_CLASSES)
    days = F.ceil((F.unix_micros(F.max("observation_time")) - F.unix_micros(F.min("observation_time"))) / 86_400e6)
    held = {
        "minimum_real_rows": F.count_if(real) >= 1000, "minimum_coverage_days": days >= 14, "no_synthetic_test_rows": F.bool_and(real),
        "beats_deterministic_by_10_pct": F.avg(F.abs(y - 70)) <= 0.9 * F.avg(F.abs(y - F.col("current_delay"))), "no_forbidden_feature_leakage": F.lit(None).cast("boolean")}
    g = t.features.groupBy("corridor").agg(*[v.alias(k) for k, v in held.items()])
    gates = F.create_map(*[x for k in held for x in (F.lit(k), F.col(k))])
    return g.select("corridor", joined(st.missing_gates(gates)).alias("missing"))


@query("agg_28_journey_merge", needs=("journey_legs",), oracle="""
SELECT journey_id, count(*) AS legs, min(reliability_score) AS reliability_score,
  CASE WHEN bool_or(decision_state = 'ODD') THEN 'UNAVAILABLE' WHEN bool_or(decision_state = 'HARD_BLOCKED') THEN 'HARD_BLOCKED' WHEN bool_or(decision_state = 'UNAVAILABLE') THEN 'UNAVAILABLE'
       WHEN bool_or(decision_state = 'HOLD') THEN 'HOLD' ELSE 'READY' END AS decision_state,
  coalesce(min_by(status, leg_no) FILTER (status <> 'APPROVED'), 'APPROVED') AS status,
  CASE WHEN count(estimated_hours) = count(*) THEN round(sum(estimated_hours), 2) END AS estimated_hours, count(DISTINCT route_id) AS routes
FROM journey_legs GROUP BY journey_id""")
def _(t):
    return agg.journey_merge(t.journey_legs, "journey_id")


@query("agg_28_journey_parts", needs=("journey_legs",), oracle="""
WITH p AS (SELECT journey_id, 'segment' AS part, cast(l_suppkey as varchar) AS value, leg_no, l_linenumber AS seq FROM journey_legs JOIN lineitem ON l_orderkey = route_id
UNION ALL SELECT journey_id, 'alert', decision_state, leg_no, 0 FROM journey_legs WHERE decision_state <> 'READY')
SELECT journey_id, part, value, min(leg_no) AS leg_no, arg_min(seq, (leg_no, seq)) AS seq FROM p GROUP BY journey_id, part, value""")
def _(t):
    """Segments and alerts of whole journeys, each once, at their first place."""
    steps = t.lineitem.select(F.col("l_orderkey").alias("route_id"), F.col("l_suppkey").cast("string").alias("segment"), F.col("l_linenumber").alias("seq"))
    alerts = t.journey_legs.select("journey_id", "leg_no", F.when(F.col("decision_state") != "READY", F.col("decision_state")).alias("alert"))
    return agg.journey_parts(t.journey_legs, steps, alerts, "journey_id")


@query("agg_33_sample_alerts", needs=("weather",), oracle="""
SELECT route_id, point_id // 40 AS day, alert, min(point_id) AS first_pos FROM (SELECT *, unnest([CASE WHEN visibility IS NULL THEN 'WEATHER_UNKNOWN' END, CASE WHEN visibility IS NOT NULL AND weather_code * 9 BETWEEN 200 AND 699 THEN 'PRECIPITATION' END,
  CASE WHEN visibility IS NOT NULL AND wind_speed_10m > 15 THEN 'HIGH_WIND' END, CASE WHEN visibility < 5000 THEN 'REDUCED_VISIBILITY' END]) AS alert FROM weather) w
WHERE alert IS NOT NULL GROUP BY route_id, day, alert""")
def _(t):
    from ballast.functions.weather import weather_score

    v = weather_score(F.array(F.col("weather_code") * 9), F.col("wind_speed_10m"), F.col("visibility"))
    each = t.weather.select(F.struct("route_id", F.floor(F.col("point_id") / 40).alias("day")).alias("key"), "point_id", F.explode(v["alerts"]).alias("alert"))
    return agg.distinct_in_order(each, "key", "point_id", "alert").select("key.route_id", "key.day", "alert", "first_pos")


@query("agg_33_weakest_weather_sample", needs=("weather",), oracle="""
SELECT route_id, day, CASE WHEN count(score) = count(*) THEN min(score) END AS score,
  CASE WHEN count(score) = count(*) THEN min_by(point_id, score * 1000000000 + point_id) ELSE min(point_id) END AS governing, count(*) AS samples
FROM (SELECT *, point_id // 40 AS day, CASE WHEN visibility IS NOT NULL THEN 100.0e0 - CASE WHEN weather_code * 9 BETWEEN 200 AND 699 THEN 30 ELSE 0 END
   - CASE WHEN wind_speed_10m > 15 THEN 20 ELSE 0 END - CASE WHEN visibility < 5000 THEN 25 ELSE 0 END END AS score FROM weather) w GROUP BY route_id, day""")
def _(t):
    from ballast.functions.weather import weather_score

    v = weather_score(F.array(F.col("weather_code") * 9), F.col("wind_speed_10m"), F.col("visibility"))
    s = t.weather.withColumn("day", F.floor(F.col("point_id") / 40)).withColumn("score", v["score"])
    out = agg.weakest_weather(s.withColumn("key", F.struct("route_id", "day")), "key", "point_id")
    return out.select("key.route_id", "key.day", "score", "governing", "samples")


@query("agg_34_delay_bottleneck", needs=("route_legs", "routes"), oracle="""
SELECT g.route_id, cast(ceil(round(h + c + w, 9)) as int) AS delay_minutes, bottleneck,
  CASE WHEN ceil(round(h + c + w, 9)) < 30 THEN 'LOW' WHEN ceil(round(h + c + w, 9)) < 60 THEN 'MODERATE' WHEN ceil(round(h + c + w, 9)) < 90 THEN 'HIGH' ELSE 'CRITICAL' END AS risk,
  CASE WHEN known THEN CASE WHEN round(h + c + w, 9) > 0 THEN round(w / round(h + c + w, 9) * 100, 1) ELSE 0 END END AS weather_pct,
  CASE WHEN round(h + c + w, 9) > 0 THEN round(c / round(h + c + w, 9) * 100, 1) ELSE 0 END AS congestion_pct
FROM (SELECT route_id, sum(hm) AS h, sum(cm) AS c, arg_min(src_code || ' → ' || dst_code, (-round(hm + cm, 9), seq)) AS bottleneck
      FROM (SELECT *, greatest(0.0::double, delay_h * 60) AS hm, greatest(0.0::double, (factor - 1) * 30) AS cm FROM route_legs) l GROUP BY route_id) g
JOIN (SELECT route_id, weather_score IS NOT NULL AS known, coalesce(greatest(0.0::double, (100 - weather_score) * 0.3e0), 0) AS w FROM routes) r USING (route_id)""")
def _(t):
    return agg.bottleneck(t.route_legs, t.routes).withColumn("risk", delay_risk(F.col("delay_minutes")))


HOP_SQL = """2 * 6371.0 * asin(sqrt(least(1.0::double, pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lon - plon) / 2), 2))))"""
LAGGED_SQL = "SELECT *, lag(lat) OVER (PARTITION BY seg_id ORDER BY pos) AS plat, lag(lon) OVER (PARTITION BY seg_id ORDER BY pos) AS plon FROM segment_points"


@query("agg_35_path_length", needs=("segment_points",), oracle=f"""
SELECT seg_id, round(sum({HOP_SQL}), 1) AS km FROM ({LAGGED_SQL}) x WHERE plat IS NOT NULL GROUP BY seg_id""")
def _(t):
    return agg.line_length(t.segment_points, "seg_id")


@query("win_10_consecutive_points", needs=("positions",), oracle=f"""
SELECT shipment_id, position_id, round({HOP_SQL}, 6) AS km FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM positions
  WINDOW w AS (PARTITION BY shipment_id ORDER BY position_id)) x WHERE plat IS NOT NULL""")
def _(t):
    p = agg.hops(t.positions, "shipment_id", "position_id", width=2000)
    return p.select("shipment_id", "position_id", F.round("km", 6).alias("km"))


@query("agg_37_provider_summary", needs=("obs",), oracle="""
SELECT provider_key AS provider, count(*) AS requests, count(*) FILTER (status <> 'UNAVAILABLE') AS http_200, count(*) FILTER (valid) AS valid, round(avg(value + 0.00013e0), 3) AS mean_ms,
  round(max(value + 0.00013e0) FILTER (rn = 1 + cast(round_even((n - 1) * 0.95e0, 0) as bigint)), 3) AS p95_ms, round(count(*) FILTER (valid) * 100.0e0 / count(*), 2) AS availability_pct
FROM (SELECT *, row_number() OVER (PARTITION BY provider_key ORDER BY value) AS rn, count(*) OVER (PARTITION BY provider_key) AS n FROM obs) o GROUP BY provider_key""")
def _(t):
    return st.provider_summary(t.obs.select(
        F.col("provider_key").alias("provider"), F.when(F.col("status") != "UNAVAILABLE", 200).otherwise(503).alias("http_status"),
        F.col("valid").alias("schema_valid"), (F.col("value") + 0.00013).alias("latency_ms")))


@query("agg_38_scenario_summary", needs=("outcomes",), oracle="""
SELECT fault_type AS scenario, count(*) AS trials, count(*) FILTER (full_gate = b1) AS passed, round(count(*) FILTER (full_gate = b1) * 100.0e0 / count(*), 2) AS pass_rate_pct,
  round(avg(latency_ms), 6) AS mean_ms, round(quantile_cont(latency_ms, 0.5), 6) AS median_ms, round(max(latency_ms) FILTER (rn = 1 + cast(round_even((n - 1) * 0.95e0, 0) as bigint)), 6) AS p95_ms
FROM (SELECT *, row_number() OVER (PARTITION BY fault_type ORDER BY latency_ms) AS rn, count(*) OVER (PARTITION BY fault_type) AS n FROM outcomes) o GROUP BY fault_type""")
def _(t):
    return st.scenario_summary(t.outcomes.select(
        F.col("fault_type").alias("scenario"), (F.col("full_gate") == F.col("b1")).alias("passed"), F.col("latency_ms").alias("elapsed_ms")))


@query("agg_38_scenario_states", needs=("outcomes",), oracle="""
SELECT fault_type AS scenario, CASE WHEN full_gate THEN 'READY' ELSE 'HOLD' END AS actual_state, count(*) AS n FROM outcomes GROUP BY 1, 2""")
def _(t):
    return st.state_counts(t.outcomes.select(
        F.col("fault_type").alias("scenario"), F.when(F.col("full_gate"), "READY").otherwise("HOLD").alias("actual_state")))


LOG = "(SELECT event_type AS method, provider_key AS path, CASE WHEN valid THEN 200 ELSE 503 END AS status, value AS seconds FROM obs) q"


@query("agg_39_request_log", needs=("obs",), oracle=f"""
SELECT 'status' AS level, method, path, status, count(*) AS n, round(sum(seconds), 4) AS seconds FROM {LOG} GROUP BY method, path, status
UNION ALL SELECT 'path', method, path, NULL, count(*), round(sum(seconds), 4) FROM {LOG} GROUP BY method, path""")
def _(t):
    log = t.obs.select(F.col("event_type").alias("method"), F.col("provider_key").alias("path"),
                       F.when(F.col("valid"), 200).otherwise(503).alias("status"), F.col("value").alias("seconds"))
    return agg.request_log(log).withColumn("seconds", F.round("seconds", 4))


@query("agg_39_prediction_totals", needs=("predictions",), oracle="""
SELECT count(*) AS requests, count(*) FILTER (predicted_value = deterministic_value) AS fallbacks, count(*) FILTER (actual_value IS NULL) AS errors, round(sum(deterministic_value), 4) AS seconds FROM predictions""")
def _(t):
    return agg.prediction_totals(t.predictions.select(
        (F.col("predicted_value") == F.col("deterministic_value")).alias("fallback"), F.col("actual_value").isNull().alias("error"),
        F.col("deterministic_value").alias("seconds"))).withColumn("seconds", F.round("seconds", 4))


@query("agg_40_next_sequence", oracle="""
SELECT case_id, coalesce(max(o_orderkey % 50), 0) + 1 AS next FROM (SELECT c_custkey AS case_id FROM customer UNION ALL SELECT -1 - c_custkey FROM customer) c
LEFT JOIN orders ON o_custkey = case_id GROUP BY case_id""")
def _(t):
    """All orders; the negative keys are cases without any."""
    snaps = t.orders.select(F.col("o_custkey").alias("case_id"), (F.col("o_orderkey") % 50).alias("sequence_no"))
    own = t.customer.select(F.col("c_custkey").alias("case_id"))
    return agg.next_sequence(own.unionByName(own.select((-1 - F.col("case_id")).alias("case_id"))), snaps, "case_id")


@query("agg_41_feed_summary", oracle="""
SELECT 'stops' AS "table", count(*) AS n, 'demo' AS provider FROM supplier UNION ALL SELECT 'routes', count(*), 'demo' FROM part
UNION ALL SELECT 'trips', count(*), 'demo' FROM orders UNION ALL SELECT 'stop_times', count(*), 'demo' FROM lineitem""")
def _(t):
    return agg.feed_summary({"stops": t.supplier, "routes": t.part, "trips": t.orders, "stop_times": t.lineitem}, provider="demo")


@query("agg_43_declared_count_backfill", needs=("carriages",), oracle="""
SELECT o_orderkey AS consist_id, greatest(count(position), 1) AS declared FROM orders LEFT JOIN carriages ON consist_id = o_orderkey GROUP BY o_orderkey""")
def _(t):
    return agg.backfilled_counts(t.orders.select(F.col("o_orderkey").alias("consist_id")), t.carriages, "consist_id")


@query("agg_44_condition_report", needs=("weather",), oracle=f"""
WITH p AS (SELECT *, point_id // 20 AS report, point_id % 20 AS pos, valid AND visibility IS NOT NULL AS ok FROM weather),
k AS (SELECT report, CASE WHEN report % 6 <> 0 THEN report % 10 END AS kp FROM p GROUP BY report),
s AS (SELECT p.report, count(*) FILTER (NOT ok) + CASE WHEN max(kp) IS NULL THEN 1 ELSE 0 END AS failures, max(kp) AS kp FROM p LEFT JOIN k ON k.report = p.report WHERE pos < 8 GROUP BY p.report),
c AS (SELECT p.report, kind AS type FROM ({CONDITIONS_SQL}) c JOIN p ON p.point_id = c.point_id WHERE ok AND pos < 8 UNION ALL SELECT report, 'solar' FROM s WHERE kp >= 5),
g AS (SELECT report, type, count(*) AS n FROM c GROUP BY report, type)
SELECT s.report, CASE WHEN failures = 0 THEN 'AVAILABLE' ELSE 'UNAVAILABLE' END AS status, failures, type, coalesce(n, 0) AS n FROM s LEFT JOIN g ON g.report = s.report""")
def _(t):
    report, pos = F.floor(F.col("point_id") / 20).alias("report"), (F.col("point_id") % 20).alias("pos")
    points = t.weather.select(report, pos, (F.col("valid") & F.col("visibility").isNotNull()).alias("valid"), "lat", "lon")
    conds = all_conditions(t).select(report, pos, F.col("c.type").alias("type"))
    kp = points.select("report").distinct().withColumn("kp", F.when(F.col("report") % 6 != 0, F.col("report") % 10))
    return agg.condition_report(points, conds, kp, "report", first_points=8)


@query("agg_45_journey_what_if", needs=("journey_legs",), oracle="""
SELECT journey_id, scenario, original, stressed, alerts, CASE WHEN original = 0 THEN 0.0e0 ELSE round(greatest(0, original - stressed) * 100.0e0 / original, 6) END AS degradation_pct
FROM (SELECT journey_id, scenario, min(base) AS original, min(sim) AS stressed, any_value(alerts) AS alerts
 FROM (SELECT journey_id, scenario, reliability_score AS base, alerts, cast(greatest(0, trunc(reliability_score - pen)) as int) AS sim
  FROM journey_legs CROSS JOIN (VALUES ('storm', 28.0e0, 'STORM'), ('solar', 24.0e0, 'GEOMAGNETIC')) s(scenario, pen, alerts)) x GROUP BY journey_id, scenario) g""")
def _(t):
    scenarios = t.spark.createDataFrame([("storm", 80.0, 3, 0.0), ("solar", 0.0, 8, 0.0)], "scenario string, storm double, kp int, port double")
    out = agg.journey_stress(agg.stress_every_route(t.journey_legs, scenarios), "journey_id")
    return out.withColumn("alerts", joined("alerts"))


@query("agg_46_journey_kit_status", needs=("journey_legs",), oracle="""
SELECT journey_id, CASE WHEN bool_or(kit_status IS NULL) THEN 'UNAVAILABLE' WHEN bool_or(kit_status <> 'HOT') THEN 'DEGRADED' ELSE 'HOT' END AS kit_status,
  CASE WHEN sum(total) > 0 THEN cast(round(cast(sum(traced) as double) / sum(total) * 100) as int) END AS coverage_pct FROM journey_legs GROUP BY journey_id""")
def _(t):
    return agg.kit_status(t.journey_legs, "journey_id")


@query("agg_47_centroid", needs=("weather",), oracle="""
SELECT route_id, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM weather GROUP BY route_id""")
def _(t):
    return agg.centroid(t.weather, "route_id").select("route_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("fun_18_prediction_interval", needs=("predictions", "features"), oracle="""
WITH c AS (SELECT round(quantile_cont(abs(remaining_delay_minutes - current_delay), 0.9), 4) AS p90, count(*) AS n, bool_and(data_class LIKE 'REAL%') AS trusted FROM features WHERE data_class LIKE 'REAL%')
SELECT prediction_id, trusted AND n >= 30 AS available, CASE WHEN trusted AND n >= 30 THEN round(greatest(0.0::double, predicted_value - p90), 2) END AS lower,
  CASE WHEN trusted AND n >= 30 THEN round(predicted_value + p90, 2) END AS upper FROM predictions, c""")
def _(t):
    from ballast.functions.delay import prediction_interval

    cal = st.residual_p90(t.features.where("data_class like 'REAL%'"), [], "remaining_delay_minutes", "current_delay")
    v = prediction_interval(F.col("predicted_value"), F.col("p90"), F.col("trusted"), F.col("rows"))
    return t.predictions.crossJoin(F.broadcast(cal)).select("prediction_id", v.alias("v")).select("prediction_id", "v.*")
