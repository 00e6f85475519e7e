"""Evidence of route decisions: codes, roles, states, digests and baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballast.functions import digest
from ballast.operators import contracts, evidence, graph
from ballast.operators import selections as sel
from ballast.plans.registry import query
from ballast.plans.scalars import AT, asof, joined

EV = ("ev_snapshots", "ev_records", "ev_edges", "ev_sources", "ev_roots")
NOW = f"timestamp '{AT}'"
NOW_US = f"epoch_us({NOW})"
TRUST = "('INPUT_TO', 'DERIVED_FROM', 'OVERRIDES', 'VALIDATES', 'FALLBACK_FOR')"
ROLE_LIST = "('CLEARANCE_DECISION', 'WEATHER', 'PORT_ALIGNMENT', 'CONGESTION', 'HISTORICAL_DELAY')"


def num(path):
    return f"try_cast(json_extract_string(value, '$.{path}') as double)"


def txt(path):
    return f"json_extract_string(value, '$.{path}')"


PAYLOAD_OK = f"""coalesce(CASE entity_type
  WHEN 'CARGO_DECLARATION' THEN {num('height')} >= 0.001 AND {num('width')} >= 0.001 AND {num('weight')} >= 0.001
  WHEN 'ENGINEERING_LIMITS' THEN {txt('certification')} = 'VERIFIED' AND json_array_length(value, '$.segments') > 0
    AND {num('segments[0].max_height')} >= 0.001 AND {txt('segments[0].verified')} = 'true' AND {txt('segments[0].declared_checksum')} = {txt('segments[0].computed_checksum')}
    AND {num('segments[1].max_height')} >= 0.001 AND {txt('segments[1].verified')} = 'true' AND {txt('segments[1].declared_checksum')} = {txt('segments[1].computed_checksum')}
  WHEN 'CLEARANCE_RESULT' THEN {txt('status')} IN ('APPROVED', 'HARD_BLOCKED')
  WHEN 'WEATHER_OBSERVATION' THEN {num('wind.speed')} >= 0 AND {num('main.visibility')} >= 0 AND {num('weather[0].id')} >= 0
  WHEN 'WEATHER_SCORE' THEN {num('score')} BETWEEN 0 AND 100 AND {txt('provider_unavailable')} = 'false'
  WHEN 'PORT_ALIGNMENT_SCORE' THEN {num('score')} BETWEEN 0 AND 100 AND {txt('available')} = 'true' AND {txt('aligned')} IN ('true', 'false') AND trim({txt('port_id')}) <> '' AND trim({txt('vessel_id')}) <> ''
    AND trim({txt('evaluated_at')}) <> '' AND {num('train_arrival_hours')} >= 0 AND trim({txt('loading_window.start')}) <> '' AND trim({txt('loading_window.end')}) <> ''
  WHEN 'RAIL_CONGESTION_SIGNAL' THEN {num('score')} BETWEEN 0 AND 100 AND {num('stations_live')} BETWEEN 0 AND {num('stations_total')}
  WHEN 'CONGESTION_SCORE' THEN {num('score')} BETWEEN 0 AND 100 AND {num('static_score')} BETWEEN 0 AND 100
  WHEN 'HISTORICAL_DELAY_SCORE' THEN {num('score')} BETWEEN 0 AND 100 AND json_array_length(value, '$.segment_delay_hours') > 0 AND {num('segment_delay_hours[0]')} >= 0 AND {num('segment_delay_hours[1]')} >= 0
  ELSE false END, false)"""

CONTEXT_SQL = f"""
SELECT record_id, snapshot_id, CASE WHEN user_id <> s_user THEN 'EVIDENCE_CONTEXT_MISMATCH'
  WHEN entity_type = 'CARGO_DECLARATION' AND NOT coalesce(abs({num('height')} - height) <= 1e-6 AND abs({num('width')} - width) <= 1e-6 AND abs({num('weight')} - weight) <= 1e-6, false) THEN 'EVIDENCE_SEMANTIC_CONTEXT_MISMATCH'
  WHEN entity_type = 'ENGINEERING_LIMITS' AND NOT ({txt('segments[0].id')} || ',' || {txt('segments[1].id')} = segment_ids AND {txt('segments[0].source_code')} = source_code AND {txt('segments[1].destination_code')} = destination_code) THEN 'EVIDENCE_SEMANTIC_CONTEXT_MISMATCH' END AS code
FROM (SELECT r.*, s.user_id AS s_user, s.height, s.width, s.weight, s.segment_ids, s.source_code, s.destination_code FROM ev_records r JOIN ev_snapshots s ON s.snapshot_id = r.snapshot_id) x"""

ALLOWED_SQL = "(VALUES ('open_meteo', 'LIVE_PROVIDER'), ('railradar', 'LIVE_PROVIDER'), ('maritime_feed', 'LIVE_PROVIDER'), ('operator_input', 'OPERATOR_INPUT'), ('imported_engineering', 'IMPORTED_DOCUMENT'), ('derived_engine', 'DERIVED')) al(sid, typ)"
IDENTITY_SQL = f"""
SELECT record_id, snapshot_id, CASE WHEN source_id IS NULL THEN 'EVIDENCE_SOURCE_ID_MISSING' WHEN source_id NOT IN (SELECT sid FROM {ALLOWED_SQL}) THEN 'EVIDENCE_SOURCE_ID_UNKNOWN'
   WHEN (source_id, source_type) NOT IN (SELECT (sid, typ) FROM {ALLOWED_SQL}) THEN 'EVIDENCE_SOURCE_ID_MISMATCH' END AS code FROM ev_records
UNION ALL SELECT record_id, snapshot_id, CASE WHEN c.source_id IS NULL THEN 'EVIDENCE_SOURCE_POLICY_MISSING' WHEN NOT c.enabled THEN 'EVIDENCE_SOURCE_DISABLED' END
 FROM ev_records r LEFT JOIN ev_sources c ON c.source_id = r.source_id WHERE r.source_id IS NOT NULL"""
TIMES_SQL = f"""
SELECT record_id, snapshot_id, CASE WHEN fetched_us - {NOW_US} > 300000000 THEN 'EVIDENCE_TIMESTAMP_IN_FUTURE' WHEN observed_us - {NOW_US} > 300000000 THEN 'EVIDENCE_TIMESTAMP_IN_FUTURE' END AS code FROM ev_records
UNION ALL SELECT record_id, snapshot_id, 'EVIDENCE_TIMESTAMP_INVALID' FROM ev_records WHERE (observed_us IS NULL AND source_id IN ('open_meteo', 'railradar', 'maritime_feed')) OR observed_us - fetched_us > 300000000 OR valid_us < observed_us
UNION ALL SELECT record_id, snapshot_id, 'EVIDENCE_TIME_SCOPE_MISSING' FROM ev_records WHERE source_type IN ('OPERATOR_INPUT', 'IMPORTED_DOCUMENT') AND observed_us IS NULL
UNION ALL SELECT record_id, snapshot_id, 'EVIDENCE_STALE' FROM ev_records WHERE source_type IN ('OPERATOR_INPUT', 'IMPORTED_DOCUMENT') AND valid_us IS NULL AND ({NOW_US} - observed_us) / 1e6 > CASE source_type WHEN 'OPERATOR_INPUT' THEN 86400 ELSE 31622400 END"""

MEMBERS_CTE = f"""members AS (SELECT snapshot_id, role, record_id FROM ev_records WHERE role IS NOT NULL
  UNION SELECT m.snapshot_id, m.role, e.parent FROM members m JOIN ev_edges e ON e.snapshot_id = m.snapshot_id AND e.child = m.record_id AND e.relation IN {TRUST}
    JOIN ev_records r ON r.snapshot_id = e.snapshot_id AND r.record_id = e.parent)"""
FRESH = f"""CASE WHEN valid_us < {NOW_US} THEN 'STALE' WHEN source_id IN ('operator_input', 'imported_engineering', 'derived_engine') THEN 'NOT_APPLICABLE' WHEN source_id IS NULL OR source_id = 'x9' THEN freshness_state
  WHEN observed_us IS NULL THEN 'UNKNOWN' WHEN ({NOW_US} - observed_us) / 1e6 <= CASE source_id WHEN 'railradar' THEN 7200 ELSE 900 END THEN 'FRESH'
  WHEN ({NOW_US} - observed_us) / 1e6 > CASE source_id WHEN 'railradar' THEN 21600 ELSE 3600 END THEN 'STALE' ELSE 'AGING' END"""
QUALITY_TESTS = f"""(VALUES ('EVIDENCE_PAYLOAD_EMPTY', value = '{{}}'), ('EVIDENCE_PAYLOAD_INCOMPLETE', completeness < 1), ('EVIDENCE_PAYLOAD_SCHEMA_INVALID', NOT ok), ('EVIDENCE_AGING', fresh = 'AGING'),
  ('EVIDENCE_STALE', fresh = 'STALE'), ('EVIDENCE_FRESHNESS_UNKNOWN', fresh NOT IN ('AGING', 'STALE', 'FRESH', 'NOT_APPLICABLE')), ('EVIDENCE_UNAVAILABLE', availability = 'UNAVAILABLE'),
  ('CHECKSUM_INVALID', checksum <> sha256(value)), ('RECORD_ENVELOPE_INVALID', integrity_checksum <> envelope_digest), ('EVIDENCE_SEEDED', source_type = 'SEEDED_BASELINE'),
  ('CRITICAL_CLEARANCE_SEEDED', member_role = 'CLEARANCE_DECISION' AND source_type = 'SEEDED_BASELINE'),
  ('OPERATOR_EVIDENCE_UNVERIFIED', member_role = 'PORT_ALIGNMENT' AND source_type = 'OPERATOR_INPUT'))"""
HELD_CTE = f"""held AS (SELECT m.role AS member_role, r.*, {FRESH} AS fresh, {PAYLOAD_OK} AS ok, s.clearance_state, s.weather AS x_weather, s.port AS x_port, s.congestion AS x_cong, s.historical AS x_hist
  FROM members m JOIN ev_records r ON r.snapshot_id = m.snapshot_id AND r.record_id = m.record_id JOIN ev_snapshots s ON s.snapshot_id = m.snapshot_id)"""
QUALITY_SQL = f"""SELECT snapshot_id, member_role AS role, record_id, u.code FROM held, LATERAL {QUALITY_TESTS} u(code, hit) WHERE u.hit"""
POLICY_SQL = f"""SELECT snapshot_id, member_role AS role, u.code FROM (
  SELECT snapshot_id, member_role, count(*) FILTER (d) AS n,
   bool_or(d AND (CASE WHEN member_role = 'PORT_ALIGNMENT' THEN source_type NOT IN ('LIVE_PROVIDER', 'CACHED_PROVIDER') OR source_id <> 'maritime_feed' ELSE source_type <> 'DERIVED' END)) AS src,
   bool_or(d AND coalesce(CASE member_role WHEN 'CLEARANCE_DECISION' THEN {txt('status')} <> clearance_state ELSE abs({num('score')} - CASE member_role WHEN 'WEATHER' THEN x_weather WHEN 'PORT_ALIGNMENT' THEN x_port WHEN 'CONGESTION' THEN x_cong ELSE x_hist END) > 1e-6 END, true)) AS conflict,
   bool_or(NOT d AND entity_type = 'CARGO_DECLARATION' AND source_id = 'operator_input' AND source_type = 'OPERATOR_INPUT') AS cargo,
   bool_or(NOT d AND entity_type = 'ENGINEERING_LIMITS' AND source_id = 'imported_engineering' AND json_extract_string(metadata, '$.signature_verified') = 'true') AS signed,
   bool_or(NOT d AND entity_type = 'WEATHER_OBSERVATION' AND source_id = 'open_meteo') AS observed, bool_or(NOT d AND source_type IN ('LIVE_PROVIDER', 'CACHED_PROVIDER', 'IMPORTED_DOCUMENT', 'OPERATOR_INPUT')) AS measured
  FROM (SELECT *, coalesce(role = member_role, false) AS d FROM held) h GROUP BY snapshot_id, member_role) g,
 LATERAL (VALUES ('EVIDENCE_ROLE_SOURCE_NOT_ALLOWED', src), ('EVIDENCE_ROLE_CONFLICT', n <> 1), ('EVIDENCE_SNAPSHOT_CONFLICT', conflict),
  ('EVIDENCE_LINEAGE_INCOMPLETE', CASE member_role WHEN 'CLEARANCE_DECISION' THEN NOT coalesce(cargo AND signed, false) WHEN 'WEATHER' THEN NOT coalesce(observed, false) WHEN 'CONGESTION' THEN NOT coalesce(measured, false) WHEN 'HISTORICAL_DELAY' THEN NOT coalesce(signed, false) ELSE false END)) u(code, hit) WHERE u.hit"""
# every edge chain of these decisions is shorter than four, so a walk of four edges proves a cycle
FAULTS_SQL = f"""SELECT DISTINCT snapshot_id, fault FROM (
 SELECT snapshot_id, 'SELF_EDGE' AS fault FROM ev_edges WHERE relation IN {TRUST} AND parent = child
 UNION ALL SELECT snapshot_id, 'DANGLING' FROM ev_edges WHERE relation IN {TRUST} AND ((snapshot_id, parent) NOT IN (SELECT (snapshot_id, record_id) FROM ev_records) OR (snapshot_id, child) NOT IN (SELECT (snapshot_id, record_id) FROM ev_records))
 UNION ALL SELECT a.snapshot_id, 'CYCLE' FROM ev_edges a JOIN ev_edges b ON b.snapshot_id = a.snapshot_id AND b.parent = a.child AND b.child = a.parent WHERE a.relation IN {TRUST} AND b.relation IN {TRUST} AND a.parent <> a.child) f"""
CODES_SQL = f"""
WITH RECURSIVE {MEMBERS_CTE}, {HELD_CTE},
codes AS (SELECT snapshot_id, code FROM ({CONTEXT_SQL}) a UNION ALL SELECT snapshot_id, code FROM ({IDENTITY_SQL}) b UNION ALL SELECT snapshot_id, code FROM ({TIMES_SQL}) c
 UNION ALL SELECT snapshot_id, 'EVIDENCE_LINEAGE_INVALID' FROM ({FAULTS_SQL}) d UNION ALL SELECT snapshot_id, code FROM ({QUALITY_SQL}) e UNION ALL SELECT snapshot_id, code FROM ({POLICY_SQL}) f
 UNION ALL SELECT snapshot_id, 'REQUIRED_INPUT_EXCLUDED' FROM held WHERE NOT used
 UNION ALL SELECT s.snapshot_id, 'REQUIRED_ROLE_MISSING' FROM ev_snapshots s CROSS JOIN (SELECT unnest(['CLEARANCE_DECISION', 'WEATHER', 'PORT_ALIGNMENT', 'CONGESTION', 'HISTORICAL_DELAY']) AS role) q WHERE NOT EXISTS (SELECT 1 FROM ev_records r WHERE r.snapshot_id = s.snapshot_id AND r.role = q.role)
 UNION ALL SELECT snapshot_id, 'CLEARANCE_NOT_APPROVED' FROM ev_snapshots WHERE clearance_state NOT IN ('APPROVED', 'HARD_BLOCKED')
 UNION ALL SELECT snapshot_id, CASE WHEN root_checksum IS NULL THEN 'EVIDENCE_ROOT_MISSING' WHEN root_checksum <> computed_root THEN 'EVIDENCE_ROOT_INVALID' END FROM ev_roots),
per AS (SELECT snapshot_id, string_agg(DISTINCT code, ',' ORDER BY code) AS c FROM codes WHERE code IS NOT NULL GROUP BY snapshot_id),
gate AS (SELECT s.snapshot_id, CASE WHEN clearance_state = 'HARD_BLOCKED' THEN 'HARD_BLOCKED' WHEN c IS NULL THEN 'READY' ELSE 'HOLD' END AS decision_state, CASE WHEN c IS NULL THEN 'HOT' ELSE 'DEGRADED' END AS kit_status,
  CASE WHEN clearance_state = 'HARD_BLOCKED' THEN concat_ws(',', 'HARD_CLEARANCE_BLOCK', c) ELSE coalesce(c, 'ALL_REQUIRED_EVIDENCE_TRUSTWORTHY') END AS reason_codes FROM ev_snapshots s LEFT JOIN per p ON p.snapshot_id = s.snapshot_id)"""


def snapshots(t):
    return t.ev_snapshots.withColumn("segment_ids", F.split("segment_ids", ","))


def rows(t, kinds=None):
    r = evidence.opened(t.ev_records, kinds)
    return evidence._with_decision(r, snapshots(t)).join(t.ev_sources, "source_id", "left")


def coded(df, col, *keys):
    return df.select(*keys, F.explode(col).alias("code"))


@query("prj_09_payload_contract", needs=("ev_records",), oracle=f"SELECT record_id, entity_type, {PAYLOAD_OK} AS ok FROM ev_records")
def _(t):
    return evidence.opened(t.ev_records).select("record_id", "entity_type", evidence.payload_matches().alias("ok"))


@query("prj_18_timestamp_codes", needs=("ev_records",), oracle=f"SELECT DISTINCT record_id, code FROM ({TIMES_SQL}) x WHERE code IS NOT NULL")
def _(t):
    return coded(evidence.opened(t.ev_records), evidence.timestamp_codes(asof()), "record_id")


@query("prj_19_source_identity_codes", needs=("ev_records", "ev_sources"), oracle=f"SELECT DISTINCT record_id, code FROM ({IDENTITY_SQL}) x WHERE code IS NOT NULL")
def _(t):
    r = evidence.opened(t.ev_records).join(t.ev_sources, "source_id", "left")
    return coded(r, evidence.identity_codes(), "record_id")


@query("prj_20_context_codes", needs=("ev_records", "ev_snapshots"), oracle=f"SELECT record_id, code FROM ({CONTEXT_SQL}) x WHERE code IS NOT NULL")
def _(t):
    return coded(rows(t, evidence.CONTEXT_KINDS), evidence.context_codes(), "record_id")


@query("prj_21_record_quality_codes", needs=("ev_records", "ev_snapshots", "ev_edges"), oracle=f"""
WITH RECURSIVE {MEMBERS_CTE}, {HELD_CTE} SELECT role, record_id, code FROM ({QUALITY_SQL}) q""")
def _(t):
    held = evidence.role_members(t.ev_records, t.ev_edges).withColumnRenamed("role", "r").join(evidence.opened(t.ev_records), ["snapshot_id", "record_id"])
    return held.select(F.col("r").alias("role"), "record_id", F.explode(evidence.quality_codes(asof(), F.col("r"))).alias("code"))


@query("gra_03_role_ancestors", needs=("ev_records", "ev_edges"), oracle=f"WITH RECURSIVE {MEMBERS_CTE} SELECT snapshot_id, role, record_id FROM members")
def _(t):
    return evidence.role_members(t.ev_records, t.ev_edges)


@query("gra_04_unpeeled_records", needs=("ev_edges",), oracle="""
WITH RECURSIVE e AS (SELECT DISTINCT snapshot_id, parent, child FROM ev_edges), cyc AS (SELECT snapshot_id, child AS record_id FROM e WHERE parent = child
  UNION SELECT a.snapshot_id, a.child FROM e a JOIN e b ON b.parent = a.child AND b.child = a.parent
  UNION SELECT c.snapshot_id, e.child FROM cyc c JOIN e ON e.parent = c.record_id)
SELECT snapshot_id, record_id FROM cyc""")
def _(t):
    return graph.unpeeled(t.ev_edges.withColumnRenamed("snapshot_id", "group")).select(F.col("group").alias("snapshot_id"), "record_id")


TAINT_BASE = """bad AS (SELECT snapshot_id, record_id FROM ev_records WHERE checksum <> sha256(value) OR NOT used OR source_id IS NULL OR source_id = 'x9' OR observed_us IS NULL OR snapshot_id % 7 = 3 AND entity_type = 'WEATHER_OBSERVATION'),
down AS (SELECT e.snapshot_id, e.parent, e.child FROM ev_edges e JOIN ev_records r ON r.record_id = e.child WHERE r.source_type = 'DERIVED' AND e.relation IN ('DERIVED_FROM', 'INPUT_TO') AND e.parent <> e.child)"""


def taint_inputs(t):
    r = t.ev_records.withColumnRenamed("snapshot_id", "group")
    bad = r.where("checksum <> sha2(value, 256) or not used or source_id is null or source_id = 'x9' or observed_us is null or (group % 7 = 3 and entity_type = 'WEATHER_OBSERVATION')")
    e = t.ev_edges.where("relation in ('DERIVED_FROM', 'INPUT_TO') and parent <> child").withColumnRenamed("snapshot_id", "group")
    return bad, e, r.where("source_type = 'DERIVED'")


@query("gra_05_failure_propagation", needs=("ev_records", "ev_edges"), oracle=f"""
WITH RECURSIVE {TAINT_BASE}, t AS (SELECT d.snapshot_id, d.child AS record_id FROM down d JOIN bad b ON b.record_id = d.parent UNION SELECT d.snapshot_id, d.child FROM t JOIN down d ON d.parent = t.record_id),
inv AS (SELECT snapshot_id, record_id FROM bad UNION SELECT * FROM t),
p AS (SELECT d.snapshot_id, d.child AS record_id, d.parent AS ancestor FROM down d JOIN inv i ON i.record_id = d.parent UNION SELECT d.snapshot_id, d.child, p.ancestor FROM p JOIN down d ON d.parent = p.record_id)
SELECT snapshot_id, record_id, ancestor FROM p""")
def _(t):
    return graph.tainted_by(*taint_inputs(t)).select(F.col("group").alias("snapshot_id"), "record_id", "ancestor")


@query("gra_06_lineage_faults", needs=("ev_records", "ev_edges"), oracle=FAULTS_SQL)
def _(t):
    ids = t.ev_records.select(F.col("snapshot_id").alias("group"), "record_id")
    return graph.lineage_faults(t.ev_edges.withColumnRenamed("snapshot_id", "group"), ids).select(F.col("group").alias("snapshot_id"), "fault")


@query("gra_07_lineage_digests", needs=("ev_edges",), oracle="""
SELECT child, sha256(string_agg(d, '' ORDER BY d)) AS lineage_digest FROM (SELECT child, sha256(string_agg(x, '' ORDER BY x)) AS d FROM (SELECT child, sha256(cast(parent as varchar) || '|' || relation) AS x FROM ev_edges) e GROUP BY child, substring(x, 1, 5)) l GROUP BY child""")
def _(t):
    return graph.lineage_digests(t.ev_edges)


@query("gra_08_root_digests", needs=EV, oracle="SELECT snapshot_id, computed_root, coalesce(root_checksum = computed_root, false) AS valid FROM ev_roots")
def _(t):
    r = graph.root_digests(t.ev_records, t.ev_edges, "snapshot_id").join(t.ev_roots.select("snapshot_id", "root_checksum"), "snapshot_id")
    return r.select("snapshot_id", "computed_root", F.coalesce(F.col("root_checksum") == F.col("computed_root"), F.lit(False)).alias("valid"))


@query("gra_09_derivation_edges", needs=("ev_records", "ev_snapshots"), oracle="""
WITH r AS MATERIALIZED (SELECT snapshot_id, record_id, entity_type FROM ev_records UNION ALL SELECT snapshot_id, snapshot_id * 10 + 99000000000, 'FINAL_RRI' FROM ev_snapshots)
SELECT p.snapshot_id, p.record_id AS parent, c.record_id AS child, CASE WHEN rule = 'PORT' THEN CASE WHEN p.snapshot_id % 5 <> 0 THEN 'INPUT_TO' ELSE 'EXCLUDED_FROM' END ELSE rule END AS relation
FROM r p JOIN (VALUES ('CARGO_DECLARATION', 'CLEARANCE_RESULT', 'INPUT_TO'), ('ENGINEERING_LIMITS', 'CLEARANCE_RESULT', 'VALIDATES'), ('WEATHER_OBSERVATION', 'WEATHER_SCORE', 'DERIVED_FROM'),
 ('RAIL_CONGESTION_SIGNAL', 'CONGESTION_SCORE', 'DERIVED_FROM'), ('ENGINEERING_LIMITS', 'HISTORICAL_DELAY_SCORE', 'DERIVED_FROM'), ('WEATHER_SCORE', 'FINAL_RRI', 'INPUT_TO'), ('CONGESTION_SCORE', 'FINAL_RRI', 'INPUT_TO'),
 ('HISTORICAL_DELAY_SCORE', 'FINAL_RRI', 'INPUT_TO'), ('PORT_ALIGNMENT_SCORE', 'FINAL_RRI', 'PORT'), ('CLEARANCE_RESULT', 'FINAL_RRI', 'OVERRIDES')) q(pk, ck, rule) ON pk = p.entity_type
JOIN r c ON c.snapshot_id = p.snapshot_id AND c.entity_type = ck WHERE rule <> 'OVERRIDES' OR p.snapshot_id % 40 = 6""")
def _(t):
    final = t.ev_snapshots.select("snapshot_id", (F.col("snapshot_id") * 10 + 99_000_000_000).alias("record_id"), F.lit("FINAL_RRI").alias("entity_type"))
    r = t.ev_records.select("snapshot_id", "record_id", "entity_type").unionByName(final)
    d = t.ev_snapshots.select("snapshot_id", (F.col("snapshot_id") % 5 != 0).alias("port_available"), (F.col("clearance_state") == "HARD_BLOCKED").alias("hard_blocked"))
    return graph.derivation_edges(r, d, "snapshot_id")


@query("fun_32_envelope_digest", needs=("ev_records",), oracle="SELECT record_id, envelope_digest AS digest FROM ev_records")
def _(t):
    c = F.col
    fields = {
        "id": "record_id", "user_id": "user_id", "route_id": "route_id", "decision_snapshot_id": "snapshot_id", "source_id": "source_id",
        "entity_type": "entity_type", "entity_key": "entity_key", "decision_input_role": "role", "canonical_source_type": "source_type",
        "raw_source_state": "raw_state", "observed_at": "observed_at", "fetched_at": "fetched_at", "valid_until": "valid_until",
        "freshness_state_at_capture": "freshness_state", "cache_hit": "cache_hit", "used_in_decision": "used", "excluded_reason": "excluded_reason",
        "availability_state": "availability", "confidence": "confidence", "completeness": "completeness", "transform_name": "transform_name",
        "transform_version": "transform_version", "formula_reference": "formula_reference", "request_id": "request_id",
        "value_checksum": "checksum", "value_summary": "value", "metadata": "metadata",
    }
    df = t.ev_records.select(*[c(v).alias(k) for k, v in fields.items()])
    return df.select(c("id").alias("record_id"), digest.digest_of(df, list(fields)).alias("digest"))


@query("evd_01_decision_gate", needs=EV, oracle=f"{CODES_SQL} SELECT * FROM gate")
def _(t):
    found = evidence.decision_codes(snapshots(t), t.ev_records, t.ev_edges, t.ev_sources, t.ev_roots, asof())
    return evidence.decisions(t.ev_snapshots, found).withColumn("reason_codes", joined("reason_codes"))


@query("evd_01_role_status", needs=EV, oracle=f"""
WITH RECURSIVE {MEMBERS_CTE}, {HELD_CTE}, asked AS (SELECT snapshot_id, unnest(['CLEARANCE_DECISION', 'WEATHER', 'PORT_ALIGNMENT', 'CONGESTION', 'HISTORICAL_DELAY']) AS role FROM ev_snapshots),
rc AS (SELECT snapshot_id, role, code FROM ({QUALITY_SQL}) a UNION ALL SELECT snapshot_id, role, code FROM ({POLICY_SQL}) b UNION ALL SELECT snapshot_id, member_role, 'REQUIRED_INPUT_EXCLUDED' FROM held WHERE NOT used
 UNION ALL SELECT snapshot_id, role, 'REQUIRED_ROLE_MISSING' FROM asked a WHERE NOT EXISTS (SELECT 1 FROM ev_records r WHERE r.snapshot_id = a.snapshot_id AND r.role = a.role))
SELECT a.snapshot_id, a.role, c IS NULL AS trustworthy, coalesce(n, 0) AS records, coalesce(c, '') AS codes FROM asked a
 LEFT JOIN (SELECT snapshot_id, role, string_agg(DISTINCT code, ',' ORDER BY code) AS c FROM rc GROUP BY snapshot_id, role) x ON x.snapshot_id = a.snapshot_id AND x.role = a.role
 LEFT JOIN (SELECT snapshot_id, role, count(*) AS n FROM members GROUP BY snapshot_id, role) y ON y.snapshot_id = a.snapshot_id AND y.role = a.role""")
def _(t):
    members = evidence.role_members(t.ev_records, t.ev_edges)
    found = evidence.decision_codes(snapshots(t), t.ev_records, t.ev_edges, t.ev_sources, t.ev_roots, asof(), members)
    return evidence.role_status(t.ev_snapshots, found, members).withColumn("codes", joined("codes"))


@query("evd_01_requested_decisions", needs=EV, oracle=f"""{CODES_SQL}
SELECT c_custkey AS request_no, coalesce(decision_state, 'UNAVAILABLE') AS decision_state, coalesce(kit_status, 'UNAVAILABLE') AS kit_status, coalesce(reason_codes, 'NO_STORED_DECISION_EVIDENCE') AS reason_codes
FROM customer LEFT JOIN gate ON snapshot_id = c_custkey * 11""")
def _(t):
    req = t.customer.select(F.col("c_custkey").alias("request_no"), (F.col("c_custkey") * 11).alias("snapshot_id"))
    asked = req.select("snapshot_id").distinct()
    # a decision is judged by its own rows alone, so those that no request names need not be judged
    named = lambda df: df.join(asked, "snapshot_id", "left_semi")
    found = evidence.decision_codes(named(snapshots(t)), named(t.ev_records), named(t.ev_edges), t.ev_sources, named(t.ev_roots), asof())
    out = evidence.requested_decisions(req, evidence.decisions(named(t.ev_snapshots), found))
    return out.drop("snapshot_id").withColumn("reason_codes", joined("reason_codes"))


@query("evd_02_role_policy_codes", needs=("ev_records", "ev_snapshots", "ev_edges"), oracle=f"""
WITH RECURSIVE {MEMBERS_CTE}, {HELD_CTE} {POLICY_SQL}""")
def _(t):
    members = evidence.role_members(t.ev_records, t.ev_edges).withColumnRenamed("role", "member_role")
    return evidence.role_policy_codes(members.join(rows(t), ["snapshot_id", "record_id"]))


@query("evd_12_role_components", needs=("ev_records", "ev_edges"), oracle=f"""
WITH RECURSIVE {MEMBERS_CTE} SELECT d.snapshot_id, d.role, CASE WHEN u THEN 'TRACED' ELSE 'EXCLUDED' END AS status, direct, n AS members
FROM (SELECT snapshot_id, role, bool_or(used) AS u, count(*) AS direct FROM ev_records WHERE role IS NOT NULL GROUP BY snapshot_id, role) d
JOIN (SELECT snapshot_id, role, count(*) AS n FROM members GROUP BY snapshot_id, role) m ON m.snapshot_id = d.snapshot_id AND m.role = d.role""")
def _(t):
    return evidence.role_components(t.ev_records, t.ev_edges)


@query("evd_10_manifest_rows", needs=("ev_records",), oracle="""
SELECT snapshot_id, record_id, checksum AS stored, sha256(value) AS computed, integrity_checksum AS stored_envelope, envelope_digest AS computed_envelope, checksum = sha256(value) AND integrity_checksum = envelope_digest AS valid FROM ev_records""")
def _(t):
    return evidence.manifest_rows(t.ev_records)


@query("evd_11_bundle_fingerprints", needs=("ev_snapshots", "ev_roots"), oracle="""
SELECT snapshot_id, sha256(cast(s.snapshot_id as varchar) || '|fault_' || cast(s.snapshot_id % 40 as varchar) || '|' || coalesce(computed_root, '') || '|' || coalesce(root_checksum, '')) AS fingerprint, 1 AS cases FROM ev_snapshots s JOIN ev_roots r USING (snapshot_id)""")
def _(t):
    fault = F.concat(F.lit("fault_"), (F.col("snapshot_id") % 40).cast("string"))
    return evidence.bundle_fingerprints(t.ev_snapshots, t.ev_roots, fault)


BASE_SQL = f"""
WITH r AS (SELECT *, coalesce({txt('status')} = 'APPROVED', false) AS appr, value <> '{{}}' AS filled,
   checksum = sha256(value) AND completeness >= 1 AND availability = 'AVAILABLE' AND freshness_state NOT IN ('STALE', 'UNKNOWN') AND fetched_us <= {NOW_US} + 300000000 AND coalesce(observed_us <= {NOW_US} + 300000000, true)
   AND coalesce(valid_us >= {NOW_US}, true) AND NOT (source_type = 'IMPORTED_DOCUMENT' AND coalesce({NOW_US} - observed_us > 366 * 86400000000, false)) AS sound FROM ev_records),
w AS (SELECT snapshot_id, bool_and(sound) AS sound, bool_and(used AND excluded_reason IS NULL) AS au, bool_or(role = 'CLEARANCE_DECISION' AND appr) AS anya, count(DISTINCT role) FILTER (filled) AS nf, count(DISTINCT role) AS nr, count(role) AS nd FROM r GROUP BY snapshot_id),
l AS (SELECT snapshot_id, bool_and(filled) AS lf, coalesce(bool_or(role = 'CLEARANCE_DECISION' AND appr), false) AS lo FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, role ORDER BY fetched_us DESC, cast(record_id as varchar) DESC) AS rn FROM r WHERE role IS NOT NULL) x WHERE rn = 1 GROUP BY snapshot_id),
b AS (SELECT s.snapshot_id, nr = 5 AND lo AND lf AS b0, nr = 5 AND lo AND lf AND sound AS b1, nf >= 4 AND lo AS b2, nr = 5 AND lo AND lf AND sound AND nd = 5 AND au AS b3, anya AND reliability_score >= 60 AS b4
 FROM ev_snapshots s JOIN w USING (snapshot_id) JOIN l USING (snapshot_id))"""
for _no, _name in enumerate(["latest_value", "checksum_timestamp", "role_quorum", "conservative_complete", "legacy_score"]):
    def _rule(t, no=_no):
        return evidence.baselines(t.ev_snapshots, t.ev_records, asof()).select("snapshot_id", f"b{no}")

    query(f"evd_{4 + _no:02d}_baseline_{_name}", needs=("ev_snapshots", "ev_records"), oracle=f"{BASE_SQL} SELECT snapshot_id, b{_no} FROM b")(_rule)


@query("evd_04_08_baselines", needs=("ev_snapshots", "ev_records"), oracle=f"{BASE_SQL} SELECT * FROM b")
def _(t):
    return evidence.baselines(t.ev_snapshots, t.ev_records, asof())


@query("agg_32_conflicting_assertions", needs=("ev_records",), oracle="""
SELECT snapshot_id, role, entity_type, entity_key, count(DISTINCT sha256(value)) AS digests, count(*) AS records FROM (SELECT * REPLACE (coalesce(role, entity_type) AS role,
  CASE WHEN snapshot_id % 6 < 2 THEN 'shared' ELSE entity_key END AS entity_key, snapshot_id // 2 AS snapshot_id) FROM ev_records) r GROUP BY snapshot_id, role, entity_type, entity_key HAVING count(DISTINCT sha256(value)) > 1""")
def _(t):
    from ballast.operators import cases

    r = t.ev_records.select(F.floor(F.col("snapshot_id") / 2).alias("snapshot_id"), F.coalesce("role", "entity_type").alias("role"), "entity_type",
                            F.when(F.col("snapshot_id") % 6 < 2, "shared").otherwise(F.col("entity_key")).alias("entity_key"), F.sha2("value", 256).alias("value_digest"))
    return cases.conflicting_assertions(r, "snapshot_id")
