"""Contracts, document checks, plan decisions and case assessments over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballast.functions import digest
from ballast.functions import geo  # noqa: F401
from ballast.operators import cases, checks, contracts, joins
from ballast.operators import statistics as st
from ballast.operators.conflicts import source_errors
from ballast.plans.matching import SRC_BAD  # noqa: F401
from ballast.plans.registry import query
from ballast.plans.scalars import AT, asof, joined
from ballast.session import cut

NOW_US = f"epoch_us(timestamp '{AT}')"


def tests(*pairs):
    return "(VALUES " + ", ".join(f"('{code}', {cond})" for code, cond in pairs) + ") u(code, hit)"


def nested(t):
    """Frames with nested, badly named and sensitive fields."""
    c = F.col
    return t.obs.select(
        c("event_id").alias("Event Id"),
        F.struct(c("user_id").alias("User-ID"), c("event_type").alias("API Key"), F.struct(c("provider_key").alias("Token"), (c("value") / 3).alias("Value X")).alias("Inner Part")).alias(" Detail "),
        F.array(F.struct(c("status").alias("password"), c("k").alias("K"))).alias("Items"),
        F.create_map(F.lit("api-key"), c("status"), F.lit("my_access_token_1"), c("provider_key"), F.lit("note"), c("event_type")).alias("Props"),
    )


@query("prj_02_snake_columns", needs=("obs",), oracle="""
SELECT event_id, user_id, event_type AS api_key, provider_key AS token, round(value / 3, 6) AS value_x, status AS password, k FROM obs""")
def _(t):
    return contracts.snake_columns(nested(t)).select("event_id", "detail.user_id", "detail.api_key", "detail.inner_part.token", F.round("detail.inner_part.value_x", 6).alias("value_x"),
                                                     F.col("items")[0]["password"].alias("password"), F.col("items")[0]["k"].alias("k"))


@query("prj_03_exact_redaction", needs=("obs",), oracle="""
SELECT event_id, '[REDACTED]' AS api_key, '[REDACTED]' AS token, '[REDACTED]' AS password, '[REDACTED]' AS p1, provider_key AS p2, event_type AS p3 FROM obs""")
def _(t):
    r = contracts.snake_columns(contracts.redact_exact(nested(t)))
    p = F.col("props")
    return r.select("event_id", "detail.api_key", "detail.inner_part.token", F.col("items")[0]["password"].alias("password"), p["api-key"].alias("p1"), p["my_access_token_1"].alias("p2"), p["note"].alias("p3"))


@query("prj_04_fragment_redaction", needs=("obs",), oracle="""
SELECT event_id, event_type AS api_key, provider_key AS token, round(value / 3, 6) AS value_x, '[REDACTED]' AS password, status AS p1, '[REDACTED]' AS p2 FROM obs""")
def _(t):
    r = contracts.snake_columns(contracts.redact_fragments(nested(t)))
    p = F.col("props")
    return r.select("event_id", "detail.api_key", "detail.inner_part.token", "detail.inner_part.value_x", F.col("items")[0]["password"].alias("password"), p["api-key"].alias("p1"), p["my_access_token_1"].alias("p2"))


@query("prj_05_url_redaction", oracle=r"""
SELECT page_id, regexp_replace(u, '([?&](?:api_key|api-key|apikey|key|token|auth|password|secret)=)[^&#]*', '\1%5BREDACTED%5D', 'gi') AS url
FROM (SELECT page_id, url || CASE page_id % 4 WHEN 0 THEN '?a=1&Token=abc&x=2' WHEN 1 THEN '?key=1#top' WHEN 2 THEN '?monkey=1&api-key=zz' ELSE '' END AS u FROM pages) p""")
def _(t):
    c = F.col("page_id") % 4
    tail = F.when(c == 0, "?a=1&Token=abc&x=2").when(c == 1, "?key=1#top").when(c == 2, "?monkey=1&api-key=zz").otherwise("")
    return t.pages.select("page_id", contracts.redact_url(F.concat("url", tail)).alias("url"))


@query("prj_06_source_state", needs=("obs",), oracle="""
SELECT event_id, CASE upper(s) WHEN 'LIVE' THEN 'LIVE_PROVIDER' WHEN 'LIVE_AIS' THEN 'LIVE_PROVIDER' WHEN 'CACHED' THEN 'CACHED_PROVIDER' WHEN 'OPERATOR_DECLARED' THEN 'OPERATOR_INPUT' WHEN 'STATIC_ONLY' THEN 'SEEDED_BASELINE'
  WHEN 'SIMULATED' THEN 'SIMULATED' WHEN 'OFFLINE' THEN 'OFFLINE_COMPUTED' WHEN 'PROVIDER-UNAVAILABLE' THEN 'UNAVAILABLE' ELSE 'DERIVED' END AS source_type
FROM (SELECT event_id, CASE k % 10 WHEN 0 THEN 'live' WHEN 1 THEN 'LIVE_AIS' WHEN 2 THEN 'Cached' WHEN 3 THEN 'OPERATOR_DECLARED' WHEN 4 THEN 'STATIC_ONLY' WHEN 5 THEN 'SIMULATED' WHEN 6 THEN 'OFFLINE' WHEN 7 THEN 'provider-unavailable' WHEN 8 THEN 'odd' END AS s FROM obs) o""")
def _(t):
    words = ["live", "LIVE_AIS", "Cached", "OPERATOR_DECLARED", "STATIC_ONLY", "SIMULATED", "OFFLINE", "provider-unavailable", "odd"]
    raw = F.get(F.array(*[F.lit(w) for w in words]), F.col("k") % 10)
    return t.obs.select("event_id", contracts.source_state(raw).alias("source_type"))


@query("prj_07_observation_codes", needs=("obs",), oracle=f"""
SELECT event_id, code FROM (SELECT *, CASE WHEN k % 23 = 0 THEN 'nan'::double WHEN k % 29 = 0 THEN 'inf'::double ELSE value END AS v FROM obs) o,
LATERAL {tests(('FUTURE_TIMESTAMP', f'epoch_us(observed_at) - {NOW_US} > 300000000'), ('LATITUDE_RANGE', 'lat NOT BETWEEN -90 AND 90'), ('LONGITUDE_RANGE', 'lon NOT BETWEEN -180 AND 180'), ('NOT_FINITE:v', 'isnan(v) OR isinf(v)'))} WHERE hit""")
def _(t):
    v = F.when(F.col("k") % 23 == 0, float("nan")).when(F.col("k") % 29 == 0, float("inf")).otherwise(F.col("value"))
    return contracts.violations(t.obs.withColumn("v", v), ["event_id"], contracts.observation_codes(asof(), ["v"]))


@query("prj_08_scoring_fields", needs=("weather",), oracle=f"""
SELECT point_id, code FROM weather, LATERAL {tests(('WIND', 'wind_speed_10m - 3 < 0'), ('VISIBILITY', 'visibility IS NULL'), ('CONDITIONS', 'weather_code % 10 = 0 OR weather_code - 5 < 0'))} WHERE hit""")
def _(t):
    listed = F.when(F.col("weather_code") % 10 == 0, F.array().cast("array<int>")).otherwise(F.array(F.col("weather_code") - 5))
    return contracts.violations(t.weather, ["point_id"], contracts.scoring_codes(F.col("wind_speed_10m") - 3, F.col("visibility"), listed))


@query("prj_28_current_weather", needs=("weather",), oracle=f"""
SELECT point_id, code FROM (SELECT *, weather_code + 3 AS wc, wind_speed_10m - 2 AS w, CASE WHEN point_id % 31 = 0 THEN 'calm' ELSE cast(uv_index as varchar) END AS uv FROM weather) x,
LATERAL {tests(('RANGE:weather_code', 'wc > 99'), ('RANGE:wind_speed_10m', 'w < 0'), ('MISSING:visibility', 'visibility IS NULL'), ('NOT_NUMERIC:uv_index', "uv = 'calm'"))} WHERE hit""")
def _(t):
    uv = F.when(F.col("point_id") % 31 == 0, "calm").otherwise(F.col("uv_index").cast("string"))
    w = t.weather.withColumns({"weather_code": F.col("weather_code") + 3, "wind_speed_10m": F.col("wind_speed_10m") - 2, "uv_index": uv})
    return contracts.violations(w, ["point_id"], contracts.current_weather_codes())


@query("prj_10_json_bounds", needs=("obs",), oracle="""
SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'TOO_LARGE' WHEN event_id % 89 = 0 THEN 'TOO_MANY_NODES' WHEN event_id % 83 = 0 THEN 'NOT_FINITE' WHEN event_id % 79 = 0 THEN 'NOT_JSON' WHEN event_id % 71 = 0 THEN 'NOT_OBJECT'
  WHEN k % 20 + 1 > 16 THEN 'TOO_DEEP' END AS code FROM obs""")
def _(t):
    e, deep = F.col("event_id"), F.expr("cast(k % 20 as int)")
    text = (
        F.when(e % 97 == 0, F.concat(F.lit('{"s":"'), F.repeat(F.lit("x"), 70_000), F.lit('"}')))
        .when(e % 89 == 0, F.concat(F.lit('{"a":['), F.repeat(F.lit("1,"), 5_000), F.lit("1]}")))
        .when(e % 83 == 0, '{"n":NaN}').when(e % 79 == 0, '{"n":').when(e % 71 == 0, "[1]")
        .otherwise(F.concat(F.lit('{"v":'), F.repeat(F.lit("["), deep), F.lit("1"), F.repeat(F.lit("]"), deep), F.lit("}"))))
    return t.obs.select("event_id", contracts.json_bounds(text).alias("code"))


@query("prj_11_repeated_keys", oracle="""
SELECT cast(l_partkey as varchar) AS key, count(*) AS n, 'DUPLICATE' AS code FROM lineitem GROUP BY l_partkey HAVING count(*) > 1""")
def _(t):
    return contracts.repeated_keys(t.lineitem.select(F.col("l_partkey").alias("part")), "part")


@query("prj_12_source_attribution", needs=("windows",), oracle=f"""
SELECT window_id, code FROM windows, LATERAL {tests(('SOURCE_NOT_REAL', "source_type = 'SIMULATED'"), ('SOURCE_REFERENCE_MISSING', 'length(source_reference) < 3'), ('SOURCE_CHECKSUM_INVALID', "source_checksum = 'none'"),
 ('SOURCE_AUTHENTICATION_UNVERIFIED', "verification_state <> 'VERIFIED'"), ('FETCHED_BEFORE_OBSERVED', 'fetched_at < observed_at'))} WHERE hit""")
def _(t):
    return contracts.violations(t.windows, ["window_id"], source_errors())


@query("prj_13_carriage_manifest", needs=("carriages",), oracle=f"""
SELECT consist_id, code FROM (SELECT consist_id, count(*) AS n, count(DISTINCT identifier) AS ids, count(DISTINCT position) AS p, min(position) AS lo, max(position) AS hi, bool_or(abs(gross_t - tare_t - cargo_t) > 0.01) AS bad FROM carriages GROUP BY consist_id) g,
LATERAL {tests(('CARRIAGE_INVALID', 'bad'), ('IDENTIFIER_REPEATED', 'ids < n'), ('POSITION_REPEATED', 'p < n'), ('POSITIONS_NOT_CONTIGUOUS', 'p = n AND (lo <> 1 OR hi <> n)'), ('COUNT_MISMATCH', 'n <> 1 + consist_id % 6'))} WHERE hit""")
def _(t):
    declared = t.orders.select(F.col("o_orderkey").alias("consist_id"), (1 + F.col("o_orderkey") % 6).alias("declared"))
    return contracts.manifest_violations(t.carriages, declared)


@query("prj_14_occupation_batch", needs=("windows",), oracle=f"""
SELECT schedule_id, code FROM (SELECT schedule_id, count(*) AS n, count(DISTINCT seq) AS k, min(seq) AS lo, max(seq) AS hi, bool_or(fetched_at < observed_at) AS f, bool_or(train_length_m <> 10 + schedule_id % 8) AS l, bool_or(schedule_id % 13 = 0) AS u FROM windows GROUP BY schedule_id) g,
LATERAL {tests(('FETCHED_BEFORE_OBSERVED', 'f'), ('SEQUENCE_REPEATED', 'k < n'), ('SEQUENCE_NOT_CONTIGUOUS', 'k = n AND (lo <> 0 OR hi <> n - 1)'), ('TRAIN_LENGTH_MISMATCH', 'l AND NOT u'), ('CONSIST_MISSING', 'u'))} WHERE hit""")
def _(t):
    lengths = t.orders.where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("schedule_id"), (10.0 + F.col("o_orderkey") % 8).alias("consist_length_m"))
    return contracts.occupation_violations(t.windows, lengths)


@query("prj_15_section_policy", needs=("policies",), oracle="SELECT section_id, 'SINGLE_TRACK_WITHOUT_HEADWAY' AS code FROM policies WHERE single_track AND headway_s IS NULL")
def _(t):
    return contracts.violations(t.policies, ["section_id"], contracts.policy_codes())


@query("prj_16_certification", needs=("obs",), oracle=f"""
SELECT event_id, code FROM obs, LATERAL {tests(('ISSUER_NOT_ALLOWED', 'user_id % 4 = 3'), ('CERTIFIED_AT_INVALID', 'event_id % 10 = 0'), ('CERTIFIED_IN_FUTURE', "event_id % 10 <> 0 AND seen > timestamp '2024-01-20 00:00:00'"))} WHERE hit""")
def _(t):
    by = F.get(F.array(*[F.lit(x) for x in (" Issuer A", "ISSUER B ", "issuer a", "someone")]), F.col("user_id") % 4)
    at = F.date_format("seen", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    df = t.obs.withColumns({"certified_by": by, "certified_at": F.when(F.col("event_id") % 10 == 0, at).otherwise(F.concat(at, F.lit("Z")))})
    return contracts.violations(df, ["event_id"], contracts.certification_codes(asof(), ["Issuer A", "issuer b"]))


@query("prj_17_training_contract", needs=("features",), oracle="""
SELECT code, n FROM (SELECT 'MISSING_VALUE:rainfall' AS code, count(*) FILTER (row_id % 50 = 3) AS n FROM features UNION ALL SELECT 'NOT_FINITE:visibility', count(*) FILTER (row_id % 70 = 5) FROM features
 UNION ALL SELECT 'UNKNOWN_CLASS', count(*) FILTER (row_id % 90 = 7) FROM features UNION ALL SELECT 'BAD_TIME', count(*) FILTER (row_id % 60 = 1) FROM features) x WHERE n > 0""")
def _(t):
    r = F.col("row_id")
    return st.dataset_violations(t.features.withColumns({
        "rainfall": F.when(r % 50 != 3, F.col("rainfall")), "visibility": F.when(r % 70 == 5, float("inf")).otherwise(F.col("visibility")),
        "data_class": F.when(r % 90 == 7, "GUESSED").otherwise(F.col("data_class")), "observation_time": F.when(r % 60 == 1, "soon").otherwise(F.col("observation_time").cast("string"))}))


@query("prj_22_out_of_range", needs=("features",), oracle=f"""
WITH b AS (SELECT {', '.join(f'min({c}) AS lo_{c}, max({c}) AS hi_{c}' for c in st.FEATURES)} FROM features),
x AS (SELECT * REPLACE (segment_count + CASE WHEN row_id % 7 = 3 THEN 1000 ELSE 0 END AS segment_count, rainfall - CASE WHEN row_id % 5 = 1 THEN 1000 ELSE 0 END AS rainfall) FROM features)
SELECT row_id, concat_ws(',', {', '.join(f"CASE WHEN {c} < lo_{c} OR {c} > hi_{c} THEN '{c}' END" for c in st.FEATURES)}) AS outliers FROM x, b""")
def _(t):
    """Bounds of all rows; some rows are moved out of them."""
    moved = t.features.withColumns({"segment_count": F.col("segment_count") + F.when(F.col("row_id") % 7 == 3, 1000).otherwise(0),
                                    "rainfall": F.col("rainfall") - F.when(F.col("row_id") % 5 == 1, 1000).otherwise(0)})
    return contracts.out_of_range(moved, st.feature_bounds(t.features)).select("row_id", joined("outliers").alias("outliers"))


LEG_TESTS = tests(
    ("COST_WITHOUT_SOURCE", "cost_source_type = 'UNAVAILABLE' AND cost_amount IS NOT NULL"), ("COST_SOURCE_WITHOUT_COST", "cost_source_type <> 'UNAVAILABLE' AND cost_amount IS NULL"),
    ("RISK_WITHOUT_SOURCE", "risk_source_type = 'UNAVAILABLE' AND risk_score IS NOT NULL"), ("RISK_SOURCE_WITHOUT_RISK", "risk_source_type <> 'UNAVAILABLE' AND risk_score IS NULL"),
    ("STATUS_WITHOUT_CHECK", "compliance_status IN ('PASSED', 'WARNING', 'BLOCKED') AND check_id IS NULL"),
    ("TARIFF_REFERENCE_MISSING", "cost_source_type = 'VERIFIED_TARIFF' AND (source_provider IS NULL OR source_reference IS NULL)"),
    ("RISK_REFERENCE_MISSING", "risk_source_type IN ('LIVE_PROVIDER', 'DERIVED') AND (source_provider IS NULL OR source_reference IS NULL)"),
    ("RISK_TIME_MISSING", "risk_source_type = 'LIVE_PROVIDER' AND source_observed_at IS NULL"))


@query("prj_26_leg_evidence", needs=("legs",), oracle=f"SELECT plan_id, seq, tie, code FROM legs, LATERAL {LEG_TESTS} WHERE hit")
def _(t):
    return contracts.violations(t.legs, ["plan_id", "seq", "tie"], contracts.leg_codes())


CONSTRAINT_TESTS = tests(
    ("CHECKSUM_INVALID", "checksum = 'bad'"), ("REFERENCE_MISSING", "length(source_reference) < 3"), ("TIME_MISSING", "valid_until IS NULL"), ("OBSERVED_AFTER_FETCHED", "observed_at > fetched_at"),
    ("AUTHORITY_NOT_ALLOWED", "source_type = 'OPERATOR_INPUT' AND authority_level = 'AUTHORITATIVE'"), ("BRAKES_NOT_AUTHORITATIVE", "category = 'BRAKING' AND authority_level <> 'AUTHORITATIVE'"),
    ("BRAKE_SOURCE_NOT_ALLOWED", "category = 'BRAKING' AND source_type NOT IN ('AUTHORIZED_FEED', 'IMPORTED_DOCUMENT')"), ("LIMIT_RANGE", "category <> 'BRAKING' AND NOT (limit_kph > 0 AND limit_kph <= 500)"))


@query("prj_27_constraint_evidence", needs=("speed_rows",), oracle=f"SELECT request_id, constraint_no, code FROM speed_rows, LATERAL {CONSTRAINT_TESTS} WHERE hit")
def _(t):
    return contracts.violations(t.speed_rows, ["request_id", "constraint_no"], contracts.constraint_codes())


@query("prj_29_review_rules", needs=("outcomes",), oracle=f"""
WITH s AS (SELECT case_id AS snapshot_id, case_id // 3 AS case_id, case_id % 3 AS sequence_no, CASE WHEN case_id % 4 = 0 THEN 'HOLD' ELSE 'REVIEWABLE' END AS decision_state FROM outcomes),
r AS (SELECT case_id AS receipt_id, case_id - case_id % 2 AS snapshot_id, CASE WHEN case_id % 5 = 0 THEN 'REJECTED' ELSE 'ATTESTED' END AS outcome, CASE WHEN case_id % 6 = 0 THEN 'viewer' ELSE 'Admin' END AS reviewer_role, case_id % 7 AS reviewer_id FROM outcomes),
j AS (SELECT r.*, s.case_id, decision_state, s.case_id % 7 AS assigned, s.case_id % 11 AS owner, s.case_id % 17 = 0 AS archived, count(*) OVER (PARTITION BY r.snapshot_id) AS n, (SELECT max(snapshot_id) FROM s s2 WHERE s2.case_id = s.case_id) AS latest FROM r JOIN s USING (snapshot_id))
SELECT receipt_id, code FROM j, LATERAL {tests(('CASE_ARCHIVED', 'archived'), ('NOT_INDEPENDENT_REVIEWER', 'reviewer_id <> assigned OR reviewer_id = owner'), ('ROLE_NOT_ALLOWED', "reviewer_role = 'viewer'"), ('NOT_REVIEWABLE', "outcome = 'ATTESTED' AND decision_state = 'HOLD'"), ('NOT_LATEST_SNAPSHOT', 'latest <> snapshot_id'), ('ALREADY_REVIEWED', 'n > 1'))} WHERE hit""")
def _(t):
    c = F.col
    k = c("case_id")
    s = t.outcomes.select(k.alias("snapshot_id"), F.floor(k / 3).alias("case_id"), (k % 3).alias("sequence_no"), F.when(k % 4 == 0, "HOLD").otherwise("REVIEWABLE").alias("decision_state"))
    r = t.outcomes.select(k.alias("receipt_id"), (k - k % 2).alias("snapshot_id"), F.when(k % 5 == 0, "REJECTED").otherwise("ATTESTED").alias("outcome"),
                          F.when(k % 6 == 0, "viewer").otherwise("Admin").alias("reviewer_role"), (k % 7).alias("reviewer_id"))
    ca = s.select("case_id").distinct().select("case_id", (k % 7).alias("assigned_reviewer_id"), (k % 11).alias("owner_id"), F.when(k % 17 == 0, "ARCHIVED").otherwise("ASSESSED").alias("case_status"))
    return cases.review_violations(r, s, ca)


# --- plans, documents, speed --------------------------------------------------------------

RESOLVED = """(SELECT l.*, CASE WHEN c.overall_status IS NULL THEN compliance_status WHEN c.overall_status = 'PASS' THEN 'PASSED' WHEN c.overall_status IN ('WARNING', 'BLOCKED', 'MANUAL_REVIEW') THEN c.overall_status ELSE 'MANUAL_REVIEW' END AS rs FROM legs l LEFT JOIN checks c ON c.check_id = l.check_id)"""


@query("agg_26_plan_decision", needs=("legs", "checks"), oracle=f"""
SELECT plan_id, CASE WHEN b THEN 'HARD_BLOCKED' WHEN r THEN 'REVIEW_REQUIRED' ELSE 'EVALUATED' END AS status, CASE WHEN b THEN 'HOLD' WHEN r THEN 'MANUAL_REVIEW' WHEN w THEN 'PROCEED_WITH_REVIEW' ELSE 'PROCEED' END AS recommendation,
  CASE WHEN b THEN 'BLOCKED' WHEN r THEN 'MANUAL_REVIEW' WHEN w THEN 'WARNING' ELSE 'PASSED' END AS compliance
FROM (SELECT plan_id, bool_or(rs = 'BLOCKED' OR constraint_status = 'HARD_BLOCKED') AS b, bool_or(rs IN ('MANUAL_REVIEW', 'NOT_ASSESSED') OR constraint_status = 'UNKNOWN' OR risk_score IS NULL) AS r,
  bool_or(rs = 'WARNING' OR constraint_status = 'WARNING' OR coalesce(risk_score >= 70, false)) AS w FROM {RESOLVED} x GROUP BY plan_id) g""")
def _(t):
    return checks.plan_decision(joins.resolved_legs(t.legs, t.checks))


@query("agg_27_plan_totals", needs=("legs",), oracle="""
SELECT plan_id, round(sum(distance_km), 3) AS distance_km, sum(minutes) AS minutes, CASE WHEN count(cost_amount) = count(*) THEN round(sum(cost_amount), 2) END AS total_cost, round(count(cost_amount) / cast(count(*) as double), 4) AS cost_completeness,
  max(risk_score) AS worst_risk, round((count(*) + count(cost_amount) + count(risk_score) + count(check_id)) / cast(count(*) * 4 as double) * 100, 1) AS traceability_pct FROM legs GROUP BY plan_id""")
def _(t):
    return checks.plan_totals(t.legs)


CHECK_AT = "1998-06-01 00:00:00"
CHECKLIST_SQL = f"""
WITH d AS (SELECT * FROM (SELECT *, upper(trim(document_type)) AS kind, row_number() OVER (PARTITION BY check_id, upper(trim(document_type)) ORDER BY doc_no DESC) AS rn FROM documents_in) q WHERE rn = 1),
s AS (SELECT route_id AS check_id, CASE WHEN clearance_failed THEN 'HARD_BLOCKED' ELSE 'APPROVED' END AS route_status, estimated_hours FROM routes),
g AS (SELECT s.check_id, count(DISTINCT kind) FILTER (kind IN ('PERMIT', 'INSURANCE', 'CARGO_DECLARATION') AND (document_number <> '' OR checksum <> '' OR storage_reference <> '')) AS have,
   count(*) FILTER (expires_at <= timestamp '{CHECK_AT}' OR expires_at < make_timestamp(epoch_us(timestamp '{CHECK_AT}') + cast(floor(estimated_hours * 3600 * 1e6) as bigint))) AS late, count(*) FILTER (verification_state <> 'VERIFIED') AS unv FROM d JOIN s USING (check_id) GROUP BY s.check_id),
items AS (SELECT s.check_id, u.rule, u.status FROM s LEFT JOIN g USING (check_id), LATERAL (VALUES ('ROUTE_PHYSICAL_CLEARANCE', CASE WHEN route_status = 'HARD_BLOCKED' THEN 'BLOCKED' ELSE 'PASS' END), ('REQUIRED_DOCUMENT_METADATA', CASE WHEN coalesce(have, 0) < 3 THEN 'MANUAL_REVIEW' ELSE 'PASS' END),
  ('DOCUMENT_AND_PERMIT_EXPIRY', CASE WHEN late > 0 THEN 'WARNING' ELSE 'PASS' END), ('DOCUMENT_VERIFICATION', CASE WHEN unv > 0 THEN 'MANUAL_REVIEW' ELSE 'PASS' END), ('CARGO_DECLARATION_COMPLETENESS', CASE WHEN s.check_id % 5 = 0 THEN 'MANUAL_REVIEW' ELSE 'PASS' END),
  ('HUMAN_APPROVAL', CASE WHEN s.check_id % 6 = 0 THEN 'MANUAL_REVIEW' ELSE 'PASS' END), ('REFERENCE_METADATA', CASE WHEN s.check_id % 7 = 0 THEN 'MANUAL_REVIEW' ELSE 'PASS' END)) u(rule, status))"""


def shipment_checks(t):
    k = F.col("route_id")
    s = t.routes.select(
        k.alias("check_id"), F.when(F.col("clearance_failed"), "HARD_BLOCKED").otherwise("APPROVED").alias("route_status"), "estimated_hours", (k % 5 != 0).alias("cargo_declaration_complete"),
        (k % 6 != 0).alias("human_approval_obtained"), F.lit("t").alias("transporter_reference"), F.lit("s").alias("shipment_reference"), F.when(k % 7 == 0, "").otherwise("e").alias("eway_bill_reference"), F.lit("p").alias("port_customs_reference"))
    return checks.checklist(s, t.documents_in, F.lit(CHECK_AT).cast("timestamp"))


@query("agg_29_document_checklist", needs=("documents_in", "routes"), oracle=f"{CHECKLIST_SQL} SELECT check_id, rule, status FROM items")
def _(t):
    return shipment_checks(t)


@query("agg_30_worst_status", needs=("documents_in", "routes"), oracle=f"""{CHECKLIST_SQL}
SELECT check_id, CASE WHEN bool_or(status = 'BLOCKED') THEN 'BLOCKED' WHEN bool_or(status = 'MANUAL_REVIEW') THEN 'MANUAL_REVIEW' WHEN bool_or(status = 'WARNING') THEN 'WARNING' ELSE 'PASS' END AS overall_status FROM items GROUP BY check_id""")
def _(t):
    return checks.worst_status(shipment_checks(t), "check_id")


@query("agg_36_limiting_constraint", needs=("speed_rows",), oracle="""
WITH q AS (SELECT o_orderkey AS request_id, o_orderdate + INTERVAL 900 DAY AS ev FROM orders),
c AS (SELECT s.*, ev, CASE WHEN source_type = 'REPLAYED_SNAPSHOT' THEN false ELSE coalesce(observed_at <= ev AND fetched_at <= ev AND valid_until >= ev, valid_until IS NULL AND observed_at <= ev AND fetched_at <= ev) END AS cur FROM speed_rows s JOIN q USING (request_id) WHERE category <> 'BRAKING'),
g AS (SELECT request_id, count(DISTINCT category) FILTER (use AND must) AS k, bool_or(must AND NOT use) AS bad, min(limit_kph) FILTER (use) AS lim, arg_min(label, (limit_kph, constraint_no)) FILTER (use) AS label
  FROM (SELECT *, cur AND authority_level = 'AUTHORITATIVE' AS use, category IN ('ROUTE_LIMIT', 'HEADWAY') AS must FROM c) x GROUP BY request_id)
SELECT q.request_id, CASE WHEN ok THEN 'ADVISORY' WHEN g.request_id IS NULL OR q.request_id % 9 = 0 THEN 'UNAVAILABLE' ELSE 'HOLD' END AS status, CASE WHEN ok THEN round(lim, 2) END AS advisory_kph, CASE WHEN ok THEN label END AS limiting_constraint,
  CASE WHEN ok THEN round(lim / 3.6e0 * 2.5e0 + (lim / 3.6e0) * (lim / 3.6e0) / (0.7e0 * 2) + 100, 2) END AS stopping_m
FROM q LEFT JOIN g USING (request_id), LATERAL (SELECT coalesce(k = 2 AND NOT bad, false) AND q.request_id % 9 <> 0 AND q.request_id % 10 <> 1 AS ok) z""")
def _(t):
    return checks.speed_advisory(*advisory_inputs(t))


def advisory_inputs(t):
    """Requests, constraints and brakes; some requests have none, some brakes are out of date."""
    k = F.col("o_orderkey")
    at = (F.col("o_orderdate") + F.expr("interval 900 days")).alias("evaluation_at")
    req = t.orders.select(k.alias("request_id"), at)
    b = t.orders.where("o_orderkey % 9 <> 0").select(
        k.alias("request_id"), F.col("o_orderdate").alias("observed_at"), F.col("o_orderdate").alias("fetched_at"),
        (F.col("o_orderdate") + F.when(k % 10 == 1, F.expr("interval 1 day")).otherwise(F.expr("interval 2000 days"))).alias("valid_until"), F.lit("AUTHORIZED_FEED").alias("source_type"),
        F.lit(2.5).alias("reaction_s"), F.lit(0.7).alias("deceleration"), F.lit(100.0).alias("margin_m"))
    return req, t.speed_rows.where("category <> 'BRAKING'"), b


@query("agg_36_withheld_reasons", needs=("speed_rows",), oracle="""
WITH q AS (SELECT o_orderkey AS request_id, o_orderdate + INTERVAL 900 DAY AS ev FROM orders),
s AS (SELECT s.*, CASE WHEN source_type = 'REPLAYED_SNAPSHOT' THEN 'EXPIRED' WHEN observed_at > ev OR fetched_at > ev THEN 'FUTURE' WHEN valid_until < ev THEN 'EXPIRED' END AS late FROM speed_rows s JOIN q USING (request_id) WHERE category <> 'BRAKING'),
c AS (SELECT *, CASE WHEN late IS NOT NULL THEN 'EVIDENCE_' || late WHEN authority_level <> 'AUTHORITATIVE' THEN 'NOT_AUTHORITATIVE' END AS code FROM s)
SELECT request_id, CASE WHEN category IN ('ROUTE_LIMIT', 'HEADWAY') THEN 'REASON' ELSE 'WARNING' END AS kind, label, constraint_no, code FROM c WHERE code IS NOT NULL
UNION ALL SELECT request_id, 'REASON', k, NULL, 'CATEGORY_MISSING' FROM q, (VALUES ('HEADWAY'), ('ROUTE_LIMIT')) v(k) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.request_id = q.request_id AND category = k AND code IS NULL)
UNION ALL SELECT request_id, 'REASON', NULL, NULL, 'NO_CONSTRAINTS' FROM q WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.request_id = q.request_id)
UNION ALL SELECT request_id, 'REASON', NULL, NULL, CASE WHEN request_id % 9 = 0 THEN 'BRAKING_MISSING' ELSE 'BRAKING_EXPIRED' END FROM q WHERE request_id % 9 = 0 OR request_id % 10 = 1""")
def _(t):
    return checks.withheld_reasons(*advisory_inputs(t))


# --- cases ----------------------------------------------------------------------------------

CASE_TESTS = tests(
    ("EVIDENCE_OWNER_MISMATCH", "user_id <> owner_id"), ("EVIDENCE_ROLE_MISMATCH", "record_role <> role"), ("SOURCE_UNAVAILABLE", "source_id IS NULL OR catalogue_id IS NULL OR NOT enabled"),
    ("EVIDENCE_SOURCE_TYPE_UNSUPPORTED", "source_type = 'SEEDED_BASELINE'"), ("EVIDENCE_EXCLUDED", "NOT used"),
    ("SOURCE_AUTHENTICITY_UNVERIFIED", "(source_type = 'LIVE_PROVIDER' AND NOT (raw_state = 'AUTHENTICATED_CONNECTOR' AND connector_authenticated)) OR (source_type = 'IMPORTED_DOCUMENT' AND NOT signature_verified)"),
    ("SOURCE_USER_DECLARED", "source_type = 'OPERATOR_INPUT'"), ("EVIDENCE_CONTEXT_MISMATCH", "(bound_case_id <> '' AND bound_case_id <> cast(case_id as varchar)) OR bound_subject_key <> subject_key"),
    ("EVIDENCE_INTEGRITY_INVALID", "integrity_checksum <> envelope_digest"), ("EVIDENCE_TIME_INVALID", f"coalesce(observed_at, fetched_at) > fetched_at OR epoch_us(fetched_at) - {NOW_US} > 300000000"),
    ("EVIDENCE_EXPIRED", f"coalesce(epoch_us(valid_until) < {NOW_US}, false) OR coalesce(({NOW_US} - epoch_us(coalesce(observed_at, fetched_at))) / 1e6 > stale_after_s, false)"),
    ("EVIDENCE_FRESHNESS_UNBOUNDED", "source_type = 'LIVE_PROVIDER' AND valid_until IS NULL AND stale_after_s IS NULL"), ("EVIDENCE_NOT_FRESH", "freshness_state NOT IN ('FRESH', 'NOT_APPLICABLE')"),
    ("EVIDENCE_UNAVAILABLE", "availability <> 'AVAILABLE'"), ("EVIDENCE_INCOMPLETE", "completeness < 0.9"), ("EVIDENCE_PAYLOAD_EMPTY", "NOT has_value"))
FINDINGS_SQL = f"""
WITH RECURSIVE req AS (SELECT case_id, unnest(['CLEARANCE_DECISION', 'WEATHER', 'PORT_ALIGNMENT']) AS role FROM judged_cases),
e AS (SELECT r.*, c.owner_id, c.subject_key, link_required OR role IN ('CLEARANCE_DECISION', 'WEATHER', 'PORT_ALIGNMENT') AS required FROM case_rows r JOIN judged_cases c USING (case_id)),
own AS (SELECT case_id, role, record_id, required, code FROM e, LATERAL {CASE_TESTS} WHERE hit),
ln AS (SELECT DISTINCT d.snapshot_id AS case_id, parent, child, p.record_id IS NOT NULL AS inside FROM ev_edges d JOIN e c ON c.case_id = d.snapshot_id AND c.record_id = d.child LEFT JOIN e p ON p.case_id = d.snapshot_id AND p.record_id = d.parent WHERE relation IN ('DERIVED_FROM', 'INPUT_TO')),
cyc AS (SELECT case_id, child AS record_id FROM ln WHERE parent = child UNION SELECT a.case_id, a.child FROM ln a JOIN ln b ON b.case_id = a.case_id AND b.parent = a.child AND b.child = a.parent
  UNION SELECT c.case_id, l.child FROM cyc c JOIN ln l ON l.case_id = c.case_id AND l.parent = c.record_id),
lf AS (SELECT case_id, role, record_id, required, 'DERIVED_LINEAGE_MISSING' AS code FROM e WHERE source_type = 'DERIVED' AND NOT EXISTS (SELECT 1 FROM ln WHERE ln.case_id = e.case_id AND ln.child = e.record_id AND inside)
  UNION ALL SELECT case_id, role, record_id, required, 'DERIVED_LINEAGE_INCOMPLETE' FROM e WHERE source_type = 'DERIVED' AND EXISTS (SELECT 1 FROM ln WHERE ln.case_id = e.case_id AND ln.child = e.record_id AND NOT inside)
  UNION ALL SELECT case_id, role, record_id, required, 'DERIVED_LINEAGE_CYCLE' FROM e WHERE EXISTS (SELECT 1 FROM cyc WHERE cyc.case_id = e.case_id AND cyc.record_id = e.record_id)),
cl AS (SELECT case_id, role, entity_kind, entity_key FROM e GROUP BY case_id, role, entity_kind, entity_key HAVING count(DISTINCT value_digest) > 1),
bad AS (SELECT case_id, record_id FROM own UNION SELECT case_id, record_id FROM lf UNION SELECT e.case_id, record_id FROM e JOIN cl ON cl.case_id = e.case_id AND cl.role = e.role AND cl.entity_kind = e.entity_kind AND cl.entity_key = e.entity_key),
dn AS (SELECT l.case_id, l.parent, l.child FROM ln l JOIN e ON e.case_id = l.case_id AND e.record_id = l.child WHERE inside AND e.source_type = 'DERIVED' AND NOT EXISTS (SELECT 1 FROM cyc WHERE cyc.case_id = l.case_id AND cyc.record_id = l.child)),
tn AS (SELECT d.case_id, d.child AS record_id FROM dn d JOIN bad b ON b.case_id = d.case_id AND b.record_id = d.parent UNION SELECT d.case_id, d.child FROM tn JOIN dn d ON d.case_id = tn.case_id AND d.parent = tn.record_id),
rn AS (SELECT case_id, role, bool_or(required) AS required FROM e GROUP BY case_id, role),
f AS (SELECT * FROM own UNION ALL SELECT * FROM lf UNION ALL SELECT e.case_id, role, e.record_id, required, 'DERIVED_LINEAGE_INVALID' FROM e JOIN tn ON tn.case_id = e.case_id AND tn.record_id = e.record_id
  UNION ALL SELECT cl.case_id, cl.role, NULL, required, 'EVIDENCE_CONFLICT' FROM cl JOIN rn ON rn.case_id = cl.case_id AND rn.role = cl.role
  UNION ALL SELECT q.case_id, q.role, NULL, true, 'REQUIRED_ROLE_MISSING' FROM req q WHERE NOT EXISTS (SELECT 1 FROM rn WHERE rn.case_id = q.case_id AND rn.role = q.role)),
found AS (SELECT case_id, role, record_id, code, CASE WHEN required THEN 'ERROR' ELSE 'WARNING' END AS severity FROM f),
pr AS (SELECT case_id, role, count(*) AS records, bool_or(link_required) AS l, count(DISTINCT catalogue_id) AS sources FROM case_rows GROUP BY case_id, role),
cd AS (SELECT case_id, role, bool_or(severity = 'ERROR') AS er, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM found GROUP BY case_id, role),
k AS (SELECT case_id, role FROM req UNION SELECT case_id, role FROM pr),
matrix AS (SELECT k.case_id, k.role, req.role IS NOT NULL OR coalesce(l, false) AS required, CASE WHEN records IS NULL THEN 'MISSING' WHEN coalesce(er, false) THEN 'FAIL' WHEN codes IS NOT NULL THEN 'WARNING' ELSE 'PASS' END AS status,
  coalesce(records, 0) AS records, coalesce(sources, 0) AS sources, coalesce(codes, '') AS codes FROM k LEFT JOIN req ON req.case_id = k.case_id AND req.role = k.role LEFT JOIN pr ON pr.case_id = k.case_id AND pr.role = k.role LEFT JOIN cd ON cd.case_id = k.case_id AND cd.role = k.role),
states AS (SELECT c.case_id, CASE WHEN n IS NULL THEN 'UNAVAILABLE' WHEN er > 0 THEN 'HOLD' ELSE 'REVIEWABLE' END AS state, coalesce(n, 0) AS evidence_records, coalesce(er, 0) AS errors, coalesce(wa, 0) AS warnings, coalesce(ok, 0) AS satisfied_roles
 FROM judged_cases c LEFT JOIN (SELECT case_id, count(*) AS n FROM case_rows GROUP BY case_id) a USING (case_id) LEFT JOIN (SELECT case_id, count(*) FILTER (severity = 'ERROR') AS er, count(*) FILTER (severity = 'WARNING') AS wa FROM found GROUP BY case_id) b USING (case_id)
 LEFT JOIN (SELECT case_id, count(*) FILTER (required AND status = 'PASS') AS ok FROM matrix GROUP BY case_id) m USING (case_id))"""
CASE_NEEDS = ("case_rows", "judged_cases", "ev_edges")


def assessed(t):
    ca = t.judged_cases.withColumn("required_roles", F.array(*[F.lit(r) for r in ("CLEARANCE_DECISION", "WEATHER", "PORT_ALIGNMENT")]))
    ev = t.case_rows.drop("f", "no", "entity_type").withColumnRenamed("entity_kind", "entity_type")
    return ca, ev, cases.findings(ca, ev, t.ev_edges.withColumnRenamed("snapshot_id", "case_id"), asof())


@query("evd_03_case_findings", needs=CASE_NEEDS, oracle=f"{FINDINGS_SQL} SELECT * FROM found")
def _(t):
    return assessed(t)[2]


@query("agg_31_role_matrix", needs=CASE_NEEDS, oracle=f"{FINDINGS_SQL} SELECT * FROM matrix")
def _(t):
    ca, ev, found = assessed(t)
    return cases.role_matrix(ca, ev, found).withColumn("codes", joined("codes"))


@query("agg_31_role_records", needs=CASE_NEEDS, oracle="SELECT DISTINCT case_id, role, record_id, catalogue_id FROM case_rows")
def _(t):
    return cases.role_records(assessed(t)[1])


@query("evd_03_case_states", needs=CASE_NEEDS, oracle=f"{FINDINGS_SQL} SELECT * FROM states")
def _(t):
    ca, ev, found = assessed(t)
    return cases.case_states(ca, ev, found, cases.role_matrix(ca, ev, found))


@query("evd_14_case_snapshot_digest", needs=CASE_NEEDS, oracle=f"""{FINDINGS_SQL}
SELECT s.case_id, sha256(cast(s.case_id as varchar) || '|' || state || '|' || evidence_records || '|' || errors || '|' || warnings || '|' || satisfied_roles || '|' || coalesce(t, '')) AS bundle_digest FROM states s
LEFT JOIN (SELECT case_id, sha256(string_agg(d, '' ORDER BY d)) AS t FROM (SELECT case_id, sha256(string_agg(x, '' ORDER BY x)) AS d FROM (SELECT case_id, sha256(role || '|' || coalesce(cast(record_id as varchar), '-') || '|' || code || '|' || severity) AS x FROM found) q GROUP BY case_id, substring(x, 1, 5)) r GROUP BY case_id) z ON z.case_id = s.case_id""")
def _(t):
    ca, ev, found = assessed(t)
    states = cases.case_states(ca, ev, found, cases.role_matrix(ca, ev, found))
    return cases.snapshot_digests(states, found)


def tree_sql(name, select, source):
    """Digest of each case's rows by leading digits of theirs."""
    return f"""{name} AS (SELECT case_id, sha256(string_agg(d, '' ORDER BY d)) AS t FROM (SELECT case_id, sha256(string_agg(x, '' ORDER BY x)) AS d FROM (SELECT case_id, sha256({select}) AS x FROM {source}) q GROUP BY case_id, substring(x, 1, 5)) r GROUP BY case_id)"""


MANIFEST_TEXT = "role || '|' || cast(record_id as varchar) || '|' || coalesce(cast(catalogue_id as varchar), '-') || '|' || coalesce({}, '-') || '|' || coalesce(integrity_checksum, '-')"
SEAL_TEXT = "sha256(concat_ws('|', cast(s.case_id as varchar), owner_id, subject_type, subject_key, context_digest, state, evidence_records, errors, warnings, satisfied_roles, coalesce({}, ''), coalesce(f.t, ''), coalesce(m.t, '')))"


@query("evd_14_verified_seals", needs=CASE_NEEDS, oracle=f"""{FINDINGS_SQL},
{tree_sql("sealed_tree", MANIFEST_TEXT.format("value_digest"), "case_rows")},
{tree_sql("now_tree", MANIFEST_TEXT.format("CASE WHEN case_id % 9 = 4 THEN 'changed' ELSE value_digest END"), "case_rows")},
{tree_sql("finding_tree", "role || '|' || coalesce(cast(record_id as varchar), '-') || '|' || code || '|' || severity", "found")},
{tree_sql("matrix_tree", "role || '|' || cast(required as varchar) || '|' || status || '|' || cast(records as varchar) || '|' || cast(sources as varchar) || '|' || codes", "matrix")},
sealed AS (SELECT s.case_id, {SEAL_TEXT.format("n.t")} AS seal, CASE WHEN s.case_id % 13 <> 5 THEN {SEAL_TEXT.format("b.t")} END AS stored_seal FROM states s JOIN judged_cases c ON c.case_id = s.case_id
 LEFT JOIN sealed_tree b ON b.case_id = s.case_id LEFT JOIN now_tree n ON n.case_id = s.case_id LEFT JOIN finding_tree f ON f.case_id = s.case_id LEFT JOIN matrix_tree m ON m.case_id = s.case_id)
SELECT case_id, seal, stored_seal, CASE WHEN stored_seal IS NULL THEN 'UNSEALED' WHEN seal <> stored_seal THEN 'ALTERED' ELSE 'SEALED' END AS code FROM sealed""")
def _(t):
    ca, ev, found = assessed(t)
    matrix = cut(cases.role_matrix(ca, ev, found))
    judged = cases.judgements(ca, cases.case_states(ca, ev, found, matrix), matrix, found)
    stored = cases.case_seals(judged, ev).where("case_id % 13 <> 5").withColumnRenamed("seal", "stored_seal")
    # records changed after their case was sealed
    ev = ev.withColumn("value_digest", F.when(F.col("case_id") % 9 == 4, "changed").otherwise(F.col("value_digest")))
    return cases.verified_seals(cases.case_seals(judged, ev), stored)


@query("evd_09_run_verification", needs=("outcomes",), oracle="""
SELECT code, n FROM (SELECT 'FINGERPRINT_INVALID' AS code, count(*) FILTER (case_id % 500 = 7) AS n FROM outcomes UNION ALL SELECT 'FINGERPRINT_REPEATED', count(*) FILTER (case_id % 300 = 1 AND case_id > 0) FROM outcomes UNION ALL SELECT 'SOURCE_DIGEST_MISMATCH', count(*) FILTER (case_id % 400 = 9) FROM outcomes
 UNION ALL SELECT 'LABEL_INVALID', count(*) FILTER (case_id % 700 = 3) FROM outcomes UNION ALL SELECT 'CLASSIFIER_INVALID', count(*) FILTER (case_id % 600 = 5) FROM outcomes UNION ALL SELECT 'CASE_COUNT_MISMATCH', abs(count(*) - 1501) FROM outcomes) x WHERE n > 0""")
def _(t):
    k = F.col("case_id")
    fp = F.when(k % 500 == 7, "short").otherwise(F.sha2(F.when(k % 300 == 1, k - 1).otherwise(k).cast("string"), 256))
    fp = F.when(k % 500 == 7, F.concat(F.lit("short"), k.cast("string"))).otherwise(fp)
    rows = t.outcomes.select(
        fp.alias("case_fingerprint_sha256"), F.when(k % 400 == 9, "x").otherwise("src").alias("source_snapshot_manifest_sha256"), F.when(k % 700 == 3, "yes").otherwise("True").alias("expected_admissible"),
        F.when(k % 600 == 5, "1").otherwise("False").alias("b0"), F.lit("True").alias("b1"))
    return contracts.run_violations(rows, ["b0", "b1"], "src", 1501)


CARRIAGE_TEXT = " || ',' || ".join(
    f"""'"{f}":' || """ + (f"cast(cast({f} as decimal(38,6)) as varchar)" if k == "d" else f"""'"' || {f} || '"'""" if k == "s" else f"cast({f} as varchar)")
    for f, k in (("axles", "i"), ("cargo_t", "d"), ("gross_t", "d"), ("height_m", "d"), ("identifier", "s"), ("length_m", "d"), ("position", "i"), ("tare_t", "d"), ("width_m", "d")))


@query("fun_31_manifest_digest", needs=("carriages",), oracle=f"""
SELECT consist_id, sha256(cast(consist_id as varchar) || '|' || cast(sum(n) as varchar) || '|' || sha256(string_agg(d, '' ORDER BY d))) AS manifest_digest
FROM (SELECT consist_id, sha256(string_agg(x, '' ORDER BY x)) AS d, count(*) AS n FROM (SELECT consist_id, sha256('{{' || {CARRIAGE_TEXT} || '}}') AS x FROM carriages) c GROUP BY consist_id, substring(x, 1, 5)) l GROUP BY consist_id""")
def _(t):
    # ``tie`` only settles equal places and is no field of a carriage
    return digest.manifest_digest(t.carriages, ["consist_id"], "manifest_digest", left_out=("tie",))


@query("fun_37_prediction_outcomes", needs=("predictions",), oracle="""
SELECT prediction_id, round(predicted_value - actual, 4) AS error_minutes FROM predictions JOIN (SELECT l_orderkey AS pid, arg_min(l_quantity * 2, (l_shipdate, round(l_extendedprice * 100))) AS actual FROM lineitem GROUP BY l_orderkey) o ON pid = prediction_id WHERE actual_value IS NULL""")
def _(t):
    from ballast.operators.models import record_outcomes

    out = t.lineitem.select(F.col("l_orderkey").alias("prediction_id"), (F.col("l_quantity") * 2).alias("actual"), F.col("l_shipdate").alias("recorded_at"), F.round(F.col("l_extendedprice") * 100).alias("outcome_id"))
    return record_outcomes(t.predictions, out).where("recorded_at is not null").select("prediction_id", "error_minutes")
