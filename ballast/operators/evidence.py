"""Admissibility of route decisions: record codes, role policies, states and simpler baselines.

Records carry one decision each (``snapshot_id``). Codes are closed vocabularies,
so a decision's set of codes stays small whatever its number of records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions.common import coded, codes, seconds_between
from ballast.functions.freshness import FUTURE_SECONDS, effective_freshness
from ballast.functions.vocab import (
    LIVE_ALLOWED,
    LIVE_SOURCES,
    OTHER_ALLOWED,
    ROLE_ENTITY,
    ROLE_SCORE,
    ROLE_TYPES,
    ROLES,
    SOURCE_TYPES,
)
from ballast.operators import graph
from ballast.operators.ordered import newest
from ballast.session import cut

SEGMENT = (
    "struct<id:string,max_height:double,max_width:double,max_weight:double,source_reference:string,"
    "certified_by:string,certified_at:string,verified:boolean,declared_checksum:string,"
    "computed_checksum:string,source_code:string,destination_code:string>"
)
# every field any record kind may carry; a field of another JSON type reads as null
VALUE = (
    f"struct<height:double,width:double,weight:double,certification:string,segments:array<{SEGMENT}>,"
    "status:string,blocking_segment_id:string,wind:struct<speed:double>,main:struct<visibility:double>,"
    "weather:array<struct<id:double>>,score:double,provider_unavailable:boolean,available:boolean,aligned:boolean,"
    "port_id:string,vessel_id:string,evaluated_at:string,train_arrival_hours:double,"
    "loading_window:struct<start:string,end:string,manifest_reference:string,manifest_sha256:string>,"
    "segment_factors:array<double>,stations_live:int,stations_total:int,congestion_pct:double,penalty:double,"
    "static_score:double,segment_delay_hours:array<double>>"
)
META = "struct<verified:boolean,signature_verified:boolean,issuer_authentication:string>"


# the kinds whose payload a decision's context is compared with
CONTEXT_KINDS = ("CARGO_DECLARATION", "ENGINEERING_LIMITS")


def opened(records: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Records with their payload and metadata parsed and their catalogue key resolved.

    With ``kinds`` only their payloads are parsed, for rules that read no others.
    """
    known = (*LIVE_SOURCES, *OTHER_ALLOWED)
    text = F.trim(F.coalesce("value", F.lit("")))
    parsed = F.from_json("value", VALUE)
    return records.withColumns({
        "v": parsed if kinds is None else F.when(F.col("entity_type").isin(*kinds), parsed), "m": F.from_json("metadata", META),
        "has_value": ~text.isin("", "{}", "null"),
        "source_key": F.when(F.col("source_id").isin(*known), F.col("source_id")),
    })


def _is(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _text(x: Column) -> Column:
    return _is(F.trim(x) != "")


def _in(x: Column, low: float, high: float | None = None) -> Column:
    ok = (x >= low) & ~F.isnan(x)
    return _is(ok if high is None else ok & (x <= high))


def payload_matches() -> Column:
    """Whether a parsed payload keeps its record kind's contract; unknown kinds do not."""
    v = F.col("v")
    score = _in(v["score"], 0, 100)

    def every(arr, test):
        return _is(F.size(arr) > 0) & _is(F.forall(arr, test))

    segment = lambda s: (
        _text(s["id"]) & _in(s["max_height"], 0.001) & _in(s["max_width"], 0.001) & _in(s["max_weight"], 0.001)
        & _text(s["source_reference"]) & _text(s["certified_by"]) & _text(s["certified_at"]) & _is(s["verified"])
        & _text(s["declared_checksum"]) & _is(s["declared_checksum"] == s["computed_checksum"])
    )
    number = lambda x: _is(x >= 0)
    rules = {
        "CARGO_DECLARATION": _in(v["height"], 0.001) & _in(v["width"], 0.001) & _in(v["weight"], 0.001),
        "ENGINEERING_LIMITS": _is(v["certification"] == "VERIFIED") & every(v["segments"], segment),
        "CLEARANCE_RESULT": _is(v["status"].isin("APPROVED", "HARD_BLOCKED"))
        & (v["blocking_segment_id"].isNull() | _text(v["blocking_segment_id"])),
        "WEATHER_OBSERVATION": _in(v["wind"]["speed"], 0) & _in(v["main"]["visibility"], 0)
        & _in(F.get(v["weather"], 0)["id"], 0),
        "WEATHER_SCORE": score & _is(~v["provider_unavailable"]),
        "PORT_ALIGNMENT_SCORE": score & _is(v["available"]) & v["aligned"].isNotNull() & _text(v["port_id"])
        & _text(v["vessel_id"]) & _text(v["evaluated_at"]) & _in(v["train_arrival_hours"], 0)
        & _text(v["loading_window"]["start"]) & _text(v["loading_window"]["end"]),
        "CONGESTION_BASELINE": score & every(v["segment_factors"], number),
        "RAIL_CONGESTION_SIGNAL": score & _is((v["stations_live"] >= 0) & (v["stations_live"] <= v["stations_total"])),
        "AIS_PORT_ACTIVITY": _in(v["congestion_pct"], 0, 100) & _in(v["penalty"], 0),
        "CONGESTION_SCORE": score & _in(v["static_score"], 0, 100),
        "HISTORICAL_DELAY_SCORE": score & every(v["segment_delay_hours"], number),
    }
    out = F.lit(False)
    for kind, ok in rules.items():
        out = F.when(F.col("entity_type") == kind, ok).otherwise(out)
    return _is(out)


def timestamp_codes(asof: Column) -> Column:
    """Plausibility of a record's times; a missing fetch time hides the other checks."""
    o, f, u = F.col("observed_at"), F.col("fetched_at"), F.col("valid_until")
    live = _is(F.col("source_key").isin(*LIVE_SOURCES))
    operator, imported = (F.upper("source_type") == t for t in ("OPERATOR_INPUT", "IMPORTED_DOCUMENT"))
    scoped = operator | imported
    old = seconds_between(asof, o) > F.when(operator, 86_400).otherwise(31_622_400)
    rest = codes(
        (seconds_between(f, asof) > FUTURE_SECONDS, "EVIDENCE_TIMESTAMP_IN_FUTURE"),
        (seconds_between(o, asof) > FUTURE_SECONDS, "EVIDENCE_TIMESTAMP_IN_FUTURE"),
        ((live & o.isNull()) | (seconds_between(o, f) > FUTURE_SECONDS) | (u < o), "EVIDENCE_TIMESTAMP_INVALID"),
        (scoped & o.isNull(), "EVIDENCE_TIME_SCOPE_MISSING"),
        (scoped & u.isNull() & old, "EVIDENCE_STALE"),
    )
    return F.array_distinct(F.when(f.isNull(), F.array(F.lit("EVIDENCE_TIMESTAMP_INVALID"))).otherwise(rest))


def identity_codes(catalogued: bool = True) -> Column:
    """Source identity, and with ``catalogued`` also its catalogue row (catalogue_key, enabled)."""
    key, kind = F.col("source_key"), F.upper("source_type")
    allowed = F.when(key.isin(*LIVE_SOURCES), kind.isin(*LIVE_ALLOWED))
    for k, types in OTHER_ALLOWED.items():
        allowed = allowed.when(key == k, kind.isin(*types))
    missing, unknown = F.col("source_id").isNull(), F.col("source_id").isNotNull() & key.isNull()
    own = F.when(missing, "EVIDENCE_SOURCE_ID_MISSING").when(unknown, "EVIDENCE_SOURCE_ID_UNKNOWN").when(
        ~_is(allowed), "EVIDENCE_SOURCE_ID_MISMATCH"
    )
    if not catalogued:
        return coded(own)
    row = F.col("catalogue_key")
    listed = F.when(~missing, F.when(row.isNull(), "EVIDENCE_SOURCE_POLICY_MISSING")
                    .when(~row.eqNullSafe(key), "EVIDENCE_SOURCE_ID_MISMATCH").when(~_is(F.col("enabled")), "EVIDENCE_SOURCE_DISABLED"))
    return F.array_distinct(coded(own, listed))


def context_codes() -> Column:
    """A record's binding to its decision (decision columns prefixed ``s_``) and agreement with the request."""
    c, v = F.col, F.col("v")
    bound = c("route_id").eqNullSafe(c("s_route_id")) & c("user_id").eqNullSafe(c("s_user_id")) & c("request_id").eqNullSafe(c("s_request_id"))
    cargo = F.lit(True)
    for k in ("height", "width", "weight"):
        cargo = cargo & _is(F.abs(v[k] - c(f"s_{k}")) <= 1e-6)
    ids = F.array_sort(F.array_distinct(F.transform(v["segments"], lambda s: s["id"])))
    same = _is(ids == F.array_sort(F.array_distinct(c("s_segment_ids"))))
    ends = _is(F.element_at(v["segments"], 1)["source_code"] == c("s_source_code")) & _is(
        F.element_at(v["segments"], -1)["destination_code"] == c("s_destination_code"))
    filled = _is(F.size(v["segments"]) > 0)
    wrong = F.when(c("entity_type") == "CARGO_DECLARATION", ~cargo).when(
        c("entity_type") == "ENGINEERING_LIMITS", filled & ~(same & ends))
    return coded(F.when(~bound, "EVIDENCE_CONTEXT_MISMATCH").when(_is(wrong), "EVIDENCE_SEMANTIC_CONTEXT_MISMATCH"))


def record_codes(asof: Column) -> Column:
    """Payload, completeness, freshness, availability, digests and source class of a record, whatever role it serves."""
    c = F.col
    fresh = effective_freshness(asof, c("source_key"), c("observed_at"), c("valid_until"), c("freshness_state"))
    avail = F.upper(F.coalesce("availability", F.lit("UNKNOWN")))
    kind = F.upper(F.coalesce("source_type", F.lit("")))
    return codes(
        (~c("has_value"), "EVIDENCE_PAYLOAD_EMPTY"),
        (c("completeness").isNull() | (c("completeness") < 1), "EVIDENCE_PAYLOAD_INCOMPLETE"),
        (~payload_matches(), "EVIDENCE_PAYLOAD_SCHEMA_INVALID"),
        (fresh == "AGING", "EVIDENCE_AGING"), (fresh == "STALE", "EVIDENCE_STALE"),
        (~fresh.isin("AGING", "STALE", "FRESH", "NOT_APPLICABLE"), "EVIDENCE_FRESHNESS_UNKNOWN"),
        (avail.isin("UNAVAILABLE", "NOT_CONFIGURED") | (kind == "UNAVAILABLE"), "EVIDENCE_UNAVAILABLE"),
        (avail == "DEGRADED", "EVIDENCE_DEGRADED"),
        (~avail.isin("UNAVAILABLE", "NOT_CONFIGURED", "DEGRADED", "AVAILABLE"), "EVIDENCE_AVAILABILITY_UNKNOWN"),
        (c("checksum").isNull(), "CHECKSUM_MISSING"), (c("checksum") != F.sha2("value", 256), "CHECKSUM_INVALID"),
        (c("integrity_checksum").isNull(), "RECORD_ENVELOPE_MISSING"),
        (c("integrity_checksum") != c("envelope_digest"), "RECORD_ENVELOPE_INVALID"),
        (~kind.isin(*SOURCE_TYPES), "EVIDENCE_SOURCE_UNKNOWN"),
        (kind == "SIMULATED", "EVIDENCE_SIMULATED"), (kind == "SEEDED_BASELINE", "EVIDENCE_SEEDED"),
    )


def manifest_proven() -> Column:
    """Whether a record names a manifest and its digest."""
    window = F.col("v")["loading_window"]
    return _is(F.length(F.trim(window["manifest_reference"])) >= 3) & _is(window["manifest_sha256"].rlike("^[0-9a-fA-F]{64}$"))


def served_codes(role: Column, proven: Column) -> Column:
    """What a record's source class means for the role it serves."""
    kind = F.upper(F.coalesce("source_type", F.lit("")))
    clearance = role == "CLEARANCE_DECISION"
    return codes(
        (clearance & (kind == "SIMULATED"), "CRITICAL_CLEARANCE_SIMULATED"),
        (clearance & (kind == "SEEDED_BASELINE"), "CRITICAL_CLEARANCE_SEEDED"),
        ((role == "PORT_ALIGNMENT") & (kind == "OPERATOR_INPUT") & ~proven, "OPERATOR_EVIDENCE_UNVERIFIED"),
    )


def quality_codes(asof: Column, role: Column) -> Column:
    """Codes of a record under a role."""
    return F.concat(record_codes(asof), served_codes(role, manifest_proven()))


def _with_decision(records: DataFrame, snapshots: DataFrame) -> DataFrame:
    cols = [c for c in snapshots.columns if c != "snapshot_id"]
    return records.join(snapshots.select("snapshot_id", *[F.col(c).alias(f"s_{c}") for c in cols]), "snapshot_id")


def role_members(records: DataFrame, edges: DataFrame) -> DataFrame:
    """Which records each role of each decision rests on: (snapshot_id, role, record_id)."""
    ids = records.select(F.col("snapshot_id").alias("group"), "record_id", "role")
    direct = ids.where(F.col("role").isin(*ROLES))
    e = edges.withColumnRenamed("snapshot_id", "group")
    return graph.ancestors(direct, e, ids).withColumnRenamed("group", "snapshot_id")


def role_policy_codes(rows: DataFrame) -> DataFrame:
    """Codes of each decided role from its direct records and ancestors: (snapshot_id, role, code).

    ``rows`` are role members with their record and decision columns; ``member_role``
    is the role served and ``role`` the record's own.
    """
    c, v, m = F.col, F.col("v"), F.col("m")
    served = c("member_role")
    direct = _is(c("role") == served)
    above = ~direct
    kind = F.upper(F.coalesce("source_type", F.lit("")))
    allowed, entity, expected = F.lit(None), F.lit(None), F.lit(None)
    for r in ROLES:
        allowed = F.when(served == r, kind.isin(*ROLE_TYPES[r])).otherwise(allowed)
        entity = F.when(served == r, F.lit(ROLE_ENTITY[r])).otherwise(entity)
        if r in ROLE_SCORE:
            expected = F.when(served == r, c(f"s_{ROLE_SCORE[r]}")).otherwise(expected)
    agrees = F.when(served == "CLEARANCE_DECISION", _is(v["status"] == F.upper("s_clearance_state"))).otherwise(
        _is(F.abs(v["score"] - expected) <= 1e-6))
    foreign_port = (served == "PORT_ALIGNMENT") & c("source_type").isin("LIVE_PROVIDER", "CACHED_PROVIDER") & ~_is(c("source_id") == "maritime_feed")
    cargo = above & (c("entity_type") == "CARGO_DECLARATION") & _is(c("source_id") == "operator_input") & (c("source_type") == "OPERATOR_INPUT")
    signed = (
        above & (c("entity_type") == "ENGINEERING_LIMITS") & _is(c("source_id") == "imported_engineering")
        & (c("source_type") == "IMPORTED_DOCUMENT") & _is(m["verified"]) & _is(m["signature_verified"])
        & _is(m["issuer_authentication"].isin("DETACHED_SIGNATURE", "AUTHENTICATED_CONNECTOR"))
    )
    observed = above & (c("entity_type") == "WEATHER_OBSERVATION") & _is(c("source_id").isin("open_meteo", "openweather")) & c("source_type").isin("LIVE_PROVIDER", "CACHED_PROVIDER")
    measured = above & c("source_type").isin("LIVE_PROVIDER", "CACHED_PROVIDER", "IMPORTED_DOCUMENT", "OPERATOR_INPUT")
    g = rows.groupBy("snapshot_id", served.alias("role")).agg(
        F.count_if(direct).alias("n"), F.bool_or(direct & (~_is(allowed) | foreign_port)).alias("source"),
        F.bool_or(direct & (c("entity_type") != entity)).alias("entity"), F.bool_or(direct & ~agrees).alias("conflict"),
        *[F.bool_or(_is(x)).alias(n) for n, x in (("cargo", cargo), ("signed", signed), ("observed", observed), ("measured", measured))],
    )
    r = F.col("role")
    short = (
        ((r == "CLEARANCE_DECISION") & ~(c("cargo") & c("signed"))) | ((r == "WEATHER") & ~c("observed"))
        | ((r == "CONGESTION") & ~c("measured")) | ((r == "HISTORICAL_DELAY") & ~c("signed"))
    )
    return g.select("snapshot_id", "role", F.explode(codes(
        (c("source"), "EVIDENCE_ROLE_SOURCE_NOT_ALLOWED"), (c("n") != 1, "EVIDENCE_ROLE_CONFLICT"),
        (c("entity"), "EVIDENCE_PAYLOAD_SCHEMA_INVALID"), (c("conflict"), "EVIDENCE_SNAPSHOT_CONFLICT"),
        (short, "EVIDENCE_LINEAGE_INCOMPLETE"),
    )).alias("code"))


def judged_records(snapshots: DataFrame, records: DataFrame, sources: DataFrame, asof: Column) -> DataFrame:
    """One narrow row per record: its codes and what the role policies ask of it; payloads are read here and left behind."""
    wide = _with_decision(opened(records), snapshots).join(sources, "source_id", "left")
    own = F.array_distinct(F.concat(context_codes(), identity_codes(), timestamp_codes(asof)))
    return wide.select(
        "snapshot_id", "record_id", "source_id", "source_type", "entity_type", "role", "used", "m",
        F.struct("v.status", "v.score").alias("v"), "s_clearance_state", *[f"s_{x}" for x in dict.fromkeys(ROLE_SCORE.values())],
        own.alias("own_codes"), record_codes(asof).alias("record_codes"), manifest_proven().alias("proven"),
    )


def decision_codes(
    snapshots: DataFrame, records: DataFrame, edges: DataFrame, sources: DataFrame, roots: DataFrame, asof: Column, members: DataFrame | None = None,
) -> DataFrame:
    """Every failure code of every decision: (snapshot_id, role or null, code).

    ``members`` are the role members, where the caller has them already.
    """
    rows = cut(judged_records(snapshots, records, sources, asof))
    none = F.lit(None).cast("string").alias("role")
    plain = rows.select("snapshot_id", none, F.explode("own_codes").alias("code"))

    ids = records.select(F.col("snapshot_id").alias("group"), "record_id")
    faults = graph.lineage_faults(edges.withColumnRenamed("snapshot_id", "group"), ids).select(
        F.col("group").alias("snapshot_id"), none, F.lit("EVIDENCE_LINEAGE_INVALID").alias("code"))

    members = (role_members(records, edges) if members is None else members).withColumnRenamed("role", "member_role")
    held = members.join(rows, ["snapshot_id", "record_id"])
    served = F.col("member_role")
    left_out = codes((~_is(F.col("used")), "REQUIRED_INPUT_EXCLUDED"))
    quality = held.select("snapshot_id", served.alias("role"), F.explode(F.concat("record_codes", served_codes(served, F.col("proven")), left_out)).alias("code"))
    policy = role_policy_codes(held)

    present = records.where(F.col("role").isin(*ROLES)).groupBy("snapshot_id").agg(F.collect_set("role").alias("_h"))
    gone = snapshots.select("snapshot_id").join(present, "snapshot_id", "left").select("snapshot_id", F.explode(F.array_except(
        F.array(*[F.lit(r) for r in ROLES]), F.coalesce("_h", F.array().cast("array<string>")))).alias("role"), F.lit("REQUIRED_ROLE_MISSING").alias("code"))

    state = F.upper(F.coalesce("clearance_state", F.lit("")))
    unsure = snapshots.where(~state.isin("APPROVED", "HARD_BLOCKED")).select("snapshot_id", none, F.lit("CLEARANCE_NOT_APPROVED").alias("code"))
    computed = graph.root_digests(records, edges, "snapshot_id")
    sealed = snapshots.select("snapshot_id").join(roots.select("snapshot_id", "root_checksum"), "snapshot_id", "left").join(computed, "snapshot_id", "left")
    root = F.when(F.col("root_checksum").isNull(), "EVIDENCE_ROOT_MISSING").when(~F.col("root_checksum").eqNullSafe(F.col("computed_root")), "EVIDENCE_ROOT_INVALID")
    rooted = sealed.select("snapshot_id", none, root.alias("code")).where("code is not null")

    out = plain
    for part in (faults, quality, policy, gone, unsure, rooted):
        out = out.unionByName(part)
    return out.distinct()


def decisions(snapshots: DataFrame, found: DataFrame) -> DataFrame:
    """State, kit status and sorted reason codes of each decision."""
    # a decision's codes come from a closed vocabulary of about 40
    per = found.groupBy("snapshot_id").agg(F.array_sort(F.collect_set("code")).alias("_c"))
    j = snapshots.select("snapshot_id", F.upper("clearance_state").alias("_s")).join(per, "snapshot_id", "left")
    some = F.col("_c").isNotNull()
    blocked = _is(F.col("_s") == "HARD_BLOCKED")
    got = F.coalesce("_c", F.array().cast("array<string>"))
    return j.select(
        "snapshot_id", F.when(blocked, "HARD_BLOCKED").when(some, "HOLD").otherwise("READY").alias("decision_state"),
        F.when(some, "DEGRADED").otherwise("HOT").alias("kit_status"),
        F.when(blocked, F.concat(F.array(F.lit("HARD_CLEARANCE_BLOCK")), got)).when(some, got)
        .otherwise(F.array(F.lit("ALL_REQUIRED_EVIDENCE_TRUSTWORTHY"))).alias("reason_codes"),
    )


def role_status(snapshots: DataFrame, found: DataFrame, members: DataFrame) -> DataFrame:
    """Each required role of each decision: (snapshot_id, role, trustworthy, records, codes).

    ``records`` counts the direct records and ancestors the role rests on, which are
    the rows of ``members``; a role without records has the code of a missing one.
    """
    keys = ["snapshot_id", "role"]
    asked = snapshots.select("snapshot_id", F.explode(F.array(*[F.lit(r) for r in ROLES])).alias("role"))
    # codes are a closed vocabulary
    coded = found.where("role is not null").groupBy(*keys).agg(F.array_sort(F.collect_set("code")).alias("codes"))
    held = members.groupBy(*keys).agg(F.count("*").alias("records"))
    return asked.join(coded, keys, "left").join(held, keys, "left").select(
        *keys, F.col("codes").isNull().alias("trustworthy"), F.coalesce("records", F.lit(0)).alias("records"),
        F.coalesce("codes", F.array().cast("array<string>")).alias("codes"))


def requested_decisions(requests: DataFrame, decided: DataFrame) -> DataFrame:
    """Answers per request; a request without a stored decision is UNAVAILABLE."""
    j = requests.join(decided, "snapshot_id", "left")
    lost = F.col("decision_state").isNull()
    return j.select(
        *requests.columns, F.coalesce("decision_state", F.lit("UNAVAILABLE")).alias("decision_state"),
        F.coalesce("kit_status", F.lit("UNAVAILABLE")).alias("kit_status"),
        F.when(lost, F.array(F.lit("NO_STORED_DECISION_EVIDENCE"))).otherwise(F.col("reason_codes")).alias("reason_codes"),
    )


def role_components(records: DataFrame, edges: DataFrame) -> DataFrame:
    """TRACED or EXCLUDED per role with the number of direct and of supporting records."""
    members = role_members(records, edges).groupBy("snapshot_id", "role").agg(F.count("*").alias("members"))
    direct = records.where(F.col("role").isin(*ROLES)).groupBy("snapshot_id", "role").agg(
        F.bool_or("used").alias("_u"), F.count("*").alias("direct"))
    return direct.join(members, ["snapshot_id", "role"]).select(
        "snapshot_id", "role", F.when(F.col("_u"), "TRACED").otherwise("EXCLUDED").alias("status"), "direct", "members")


def manifest_rows(records: DataFrame) -> DataFrame:
    """Stored and computed digests of every record and whether both agree."""
    computed = F.sha2("value", 256)
    ok = _is(F.col("checksum") == computed) & _is(F.col("integrity_checksum") == F.col("envelope_digest"))
    return records.select(
        "snapshot_id", "record_id", F.col("checksum").alias("stored"), computed.alias("computed"),
        F.col("integrity_checksum").alias("stored_envelope"), F.col("envelope_digest").alias("computed_envelope"), ok.alias("valid"))


def bundle_fingerprints(snapshots: DataFrame, roots: DataFrame, fault: Column) -> DataFrame:
    """Fingerprint of each case and how many cases share it."""
    text = F.concat_ws("|", F.col("snapshot_id").cast("string"), fault, F.coalesce("computed_root", F.lit("")), F.coalesce("root_checksum", F.lit("")))
    # counted and returned, so written lest the roots are computed twice
    f = cut(snapshots.join(roots, "snapshot_id").select("snapshot_id", F.sha2(text, 256).alias("fingerprint")))
    n = f.groupBy("fingerprint").agg(F.count("*").alias("cases"))
    return f.join(n, "fingerprint")


# --- simpler rules the gate is compared with --------------------------------------------


def baselines(snapshots: DataFrame, records: DataFrame, asof: Column, quorum: int = 4, threshold: float = 60.0) -> DataFrame:
    """Answers of the five baseline rules per decision, from two aggregates over the records."""
    c = F.col
    text = F.trim(F.coalesce("value", F.lit("")))
    # no other role's payload is asked for a status
    status = F.when(c("role") == "CLEARANCE_DECISION", F.from_json("value", "struct<status:string>")["status"])
    approved = _is(status == "APPROVED")
    soon = lambda t: F.coalesce(seconds_between(t, asof) <= FUTURE_SECONDS, F.lit(True))
    sound = (
        _is(c("checksum") == F.sha2("value", 256)) & _is(c("completeness") >= 1) & _is(c("availability") == "AVAILABLE")
        & ~_is(c("freshness_state").isin("STALE", "UNKNOWN")) & c("fetched_at").isNotNull() & soon(c("fetched_at"))
        & soon(c("observed_at")) & F.coalesce(c("valid_until") >= asof, F.lit(True))
        & ~_is((c("source_type") == "IMPORTED_DOCUMENT") & (seconds_between(asof, c("observed_at")) > 366 * 86_400))
    )
    # both aggregates read these few columns instead of the payloads
    rows = cut(records.select(
        "snapshot_id", "role", "fetched_at", c("record_id").cast("string").alias("rid"), (~text.isin("", "{}", "null")).alias("has_value"),
        approved.alias("ok"), sound.alias("sound"), (_is(c("used")) & c("excluded_reason").isNull()).alias("kept"),
    ))
    whole = rows.groupBy("snapshot_id").agg(
        F.bool_and("sound").alias("sound"), F.bool_and("kept").alias("all_used"),
        F.bool_or((c("role") == "CLEARANCE_DECISION") & c("ok")).alias("any_approved"),
        F.count_distinct(F.when(c("role").isin(*ROLES) & c("has_value"), c("role"))).alias("filled"),
        F.count_distinct(F.when(c("role").isin(*ROLES), c("role"))).alias("roles"),
        F.count_if(c("role").isin(*ROLES)).alias("direct"),
    )
    last = newest(
        rows.where(c("role").isin(*ROLES)).select("snapshot_id", "role", "fetched_at", "rid", "has_value", "ok"),
        ["snapshot_id", "role"], ["fetched_at", "rid"])
    latest = last.groupBy("snapshot_id").agg(
        F.bool_and("has_value").alias("latest_filled"), F.bool_or((c("role") == "CLEARANCE_DECISION") & c("ok")).alias("latest_ok"))
    j = snapshots.select("snapshot_id", "reliability_score").join(whole, "snapshot_id", "left").join(latest, "snapshot_id", "left")
    every = _is(c("roles") == len(ROLES))
    b0 = every & _is(c("latest_ok")) & _is(c("latest_filled"))
    b1 = b0 & _is(c("sound"))
    return j.select(
        "snapshot_id", b0.alias("b0"), b1.alias("b1"), (_is(c("filled") >= quorum) & _is(c("latest_ok"))).alias("b2"),
        (b1 & (c("direct") == len(ROLES)) & _is(c("all_used"))).alias("b3"),
        (_is(c("any_approved")) & (F.coalesce("reliability_score", F.lit(0)) >= threshold)).alias("b4"),
    )
