"""Decisions on plans, shipment documents and speed limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions.common import plus_seconds
from ballast.functions.delay import stopping_distance_m
from ballast.functions.freshness import constraint_currency
from ballast.functions.vocab import CHECK_RANK, REQUIRED_CONSTRAINTS, REQUIRED_DOCUMENTS


def plan_decision(legs: DataFrame, status: str = "resolved_status") -> DataFrame:
    """Blocked before review or unknown risk, before warnings or high risk, before proceed."""
    s, k, r = F.col(status), F.col("constraint_status"), F.col("risk_score")
    g = legs.groupBy("plan_id").agg(
        F.bool_or((s == "BLOCKED") | (k == "HARD_BLOCKED")).alias("_b"),
        F.bool_or(s.isin("MANUAL_REVIEW", "NOT_ASSESSED") | (k == "UNKNOWN") | r.isNull()).alias("_r"),
        F.bool_or((s == "WARNING") | (k == "WARNING") | F.coalesce(r >= 70, F.lit(False))).alias("_w"),
    )
    pick = lambda a, b, c, d: F.when(F.col("_b"), a).when(F.col("_r"), b).when(F.col("_w"), c).otherwise(d)
    return g.select(
        "plan_id", pick("HARD_BLOCKED", "REVIEW_REQUIRED", "EVALUATED", "EVALUATED").alias("status"),
        pick("HOLD", "MANUAL_REVIEW", "PROCEED_WITH_REVIEW", "PROCEED").alias("recommendation"),
        pick("BLOCKED", "MANUAL_REVIEW", "WARNING", "PASSED").alias("compliance"),
    )


def plan_totals(legs: DataFrame) -> DataFrame:
    """Distance, time, cost where complete, worst risk, and the share of inputs that are traced."""
    n, costs, risks, cited = F.count("*"), F.count("cost_amount"), F.count("risk_score"), F.count("check_id")
    return legs.groupBy("plan_id").agg(
        F.round(F.sum("distance_km"), 3).alias("distance_km"), F.sum("minutes").alias("minutes"),
        F.when(costs == n, F.round(F.sum("cost_amount"), 2)).alias("total_cost"),
        F.round(costs / n, 4).alias("cost_completeness"), F.max("risk_score").alias("worst_risk"),
        F.round((n + costs + risks + cited) / (n * 4) * 100, 1).alias("traceability_pct"),
    )


def checklist(shipments: DataFrame, documents: DataFrame, asof: Column) -> DataFrame:
    """The seven document rules of each shipment: (check_id, rule, status).

    Of several documents of one kind the last supplied counts; a document
    identifies itself by number, checksum or storage reference.
    """
    kind = F.upper(F.trim("document_type"))
    d = documents.withColumn("kind", kind).groupBy("check_id", "kind").agg(
        F.max_by(F.struct("document_number", "checksum", "storage_reference", "expires_at", "verification_state"), "doc_no").alias("d")
    ).select("check_id", "kind", "d.*")
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    named = filled("document_number") | filled("checksum") | filled("storage_reference")
    j = d.join(shipments.select("check_id", "estimated_hours"), "check_id")
    eta = plus_seconds(asof, F.col("estimated_hours") * 3600)
    g = j.groupBy("check_id").agg(
        # only the three required kinds are gathered
        F.collect_set(F.when(named & F.col("kind").isin(*REQUIRED_DOCUMENTS), F.col("kind"))).alias("have"),
        F.count_if((F.col("expires_at") <= asof) | (F.col("expires_at") < eta)).alias("late"),
        F.count_if(F.coalesce("verification_state", F.lit("")) != "VERIFIED").alias("unverified"),
    )
    s = shipments.join(g, "check_id", "left")
    need = F.array(*[F.lit(k) for k in REQUIRED_DOCUMENTS])
    lacking = F.size(F.array_except(need, F.coalesce("have", F.array().cast("array<string>")))) > 0
    refs = ("transporter_reference", "shipment_reference", "eway_bill_reference", "port_customs_reference")
    gap = F.lit(False)
    for r in refs:
        gap = gap | ~filled(r)
    review = lambda bad: F.when(bad, "MANUAL_REVIEW").otherwise("PASS")
    rules = {
        "ROUTE_PHYSICAL_CLEARANCE": F.when(F.col("route_status") == "HARD_BLOCKED", "BLOCKED").otherwise("PASS"),
        "REQUIRED_DOCUMENT_METADATA": review(lacking),
        "DOCUMENT_AND_PERMIT_EXPIRY": F.when(F.coalesce("late", F.lit(0)) > 0, "WARNING").otherwise("PASS"),
        "DOCUMENT_VERIFICATION": review(F.coalesce("unverified", F.lit(0)) > 0),
        "CARGO_DECLARATION_COMPLETENESS": review(~F.col("cargo_declaration_complete")),
        "HUMAN_APPROVAL": review(~F.col("human_approval_obtained")),
        "REFERENCE_METADATA": review(gap),
    }
    each = F.array(*[F.struct(F.lit(r).alias("rule"), st.alias("status")) for r, st in rules.items()])
    return s.select("check_id", F.explode(each).alias("x")).select("check_id", "x.rule", "x.status")


def worst_status(items: DataFrame, key: str) -> DataFrame:
    rank = F.lit(None).cast("int")
    for status, r in CHECK_RANK.items():
        rank = F.when(F.col("status") == status, r).otherwise(rank)
    return items.groupBy(key).agg(F.max_by("status", rank).alias("overall_status"))


def speed_advisory(requests: DataFrame, constraints: DataFrame, brakes: DataFrame) -> DataFrame:
    """Lowest usable limit of each request and the stopping distance from it, or why none is given.

    A number is withheld unless every required category has current authoritative
    evidence, none of their rows is unusable, and brakes are current.
    """
    c = F.col
    state = constraint_currency(c("evaluation_at"), c("observed_at"), c("fetched_at"), c("valid_until"), c("source_type"))
    rows = constraints.join(requests, "request_id").withColumn(
        "usable", (state == "CURRENT") & F.coalesce(c("authority_level") == "AUTHORITATIVE", F.lit(False)))
    must = c("category").isin(*REQUIRED_CONSTRAINTS)
    g = rows.groupBy("request_id").agg(
        F.count_distinct(F.when(c("usable") & must, c("category"))).alias("_k"), F.bool_or(must & ~c("usable")).alias("_bad"),
        F.min(F.when(c("usable"), F.struct("limit_kph", "constraint_no", "label"))).alias("_m"),
    )
    b = brakes.join(requests, "request_id").select(
        "request_id", (state == "CURRENT").alias("_cur"), "reaction_s", "deceleration", "margin_m", F.lit(True).alias("_has"))
    j = requests.join(g, "request_id", "left").join(b, "request_id", "left")
    no = F.lit(False)
    ok = (F.coalesce(c("_k") == len(REQUIRED_CONSTRAINTS), no)) & ~F.coalesce("_bad", no) & F.coalesce("_cur", no)
    absent = c("_k").isNull() | c("_has").isNull()
    limit = c("_m.limit_kph")
    return j.select(
        "request_id", F.when(ok, "ADVISORY").when(absent, "UNAVAILABLE").otherwise("HOLD").alias("status"),
        F.when(ok, F.round(limit, 2)).alias("advisory_kph"), F.when(ok, c("_m.label")).alias("limiting_constraint"),
        F.when(ok, stopping_distance_m(limit, c("reaction_s"), c("deceleration"), c("margin_m"))).alias("stopping_m"),
    )


def withheld_reasons(requests: DataFrame, constraints: DataFrame, brakes: DataFrame) -> DataFrame:
    """Why a request has no advisory speed, as rows (request_id, kind, label, constraint_no, code).

    REASON rows withhold the number; WARNING rows tell of evidence of other
    categories that was not used. The label is the constraint's, or the required
    category that has no usable evidence.
    """
    c = F.col
    state = constraint_currency(c("evaluation_at"), c("observed_at"), c("fetched_at"), c("valid_until"), c("source_type"))
    rows = constraints.join(requests, "request_id").withColumns({
        "_must": c("category").isin(*REQUIRED_CONSTRAINTS),
        "_why": F.when(state != "CURRENT", F.concat(F.lit("EVIDENCE_"), state))
        .when(~F.coalesce(c("authority_level") == "AUTHORITATIVE", F.lit(False)), "NOT_AUTHORITATIVE")})
    number = constraints.schema["constraint_no"].dataType
    reason = lambda df, label, code: df.select(
        "request_id", F.lit("REASON").alias("kind"), label.cast("string").alias("label"), F.lit(None).cast(number).alias("constraint_no"), code.alias("code"))
    unused = rows.where("_why is not null").select("request_id", F.when(c("_must"), "REASON").otherwise("WARNING").alias("kind"), "label", "constraint_no", c("_why").alias("code"))
    usable = [F.bool_or((c("category") == k) & c("_why").isNull()).alias(f"_{k}") for k in REQUIRED_CONSTRAINTS]
    seen = rows.groupBy("request_id").agg(F.count("*").alias("_n"), *usable)
    braking = brakes.join(requests, "request_id").select("request_id", state.alias("_brake"))
    j = requests.select("request_id").join(seen, "request_id", "left").join(braking, "request_id", "left")
    lacking = F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(f"_{k}", F.lit(False)), F.lit(k)) for k in REQUIRED_CONSTRAINTS])))
    gaps = reason(j.select("request_id", lacking.alias("_k")), c("_k"), F.lit("CATEGORY_MISSING"))
    none = reason(j.where("_n is null"), F.lit(None), F.lit("NO_CONSTRAINTS"))
    held = j.where("_brake is null or _brake <> 'CURRENT'")
    brake = reason(held, F.lit(None), F.coalesce(F.concat(F.lit("BRAKING_"), c("_brake")), F.lit("BRAKING_MISSING")))
    return unused.unionByName(gaps).unionByName(none).unionByName(brake)
