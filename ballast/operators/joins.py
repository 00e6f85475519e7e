"""Joins of stored records, plans, readings and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions.common import plus_seconds, seconds_between
from ballast.functions.geo import in_box
from ballast.functions.vocab import APPROACH_BOX, BERTH_BOX, LEG_STATUS
from ballast.operators.ordered import Step, newest, number_slot, ranked, scan
from ballast.session import sent_if_few


def with_stations(segments: DataFrame, stations: DataFrame) -> DataFrame:
    """Segments with both end stations' fields as structs."""
    ends = stations.select("station_id", F.struct("code", "name", "lat", "lon").alias("s"))
    a = ends.select(F.col("station_id").alias("src"), F.col("s").alias("source"))
    b = ends.select(F.col("station_id").alias("dst"), F.col("s").alias("dest"))
    return segments.join(a, "src").join(b, "dst")


def with_source(records: DataFrame, sources: DataFrame) -> DataFrame:
    return records.join(sources, "source_id", "left")


def case_evidence(links: DataFrame, records: DataFrame, sources: DataFrame) -> DataFrame:
    """Linked records of each case owned by the case's owner, with their source if catalogued."""
    j = links.join(records, "record_id").where(F.col("owner_id") == F.col("user_id"))
    return j.join(sources, "source_id", "left")


def prediction_corridors(predictions: DataFrame, routes: DataFrame) -> DataFrame:
    """Predictions with their route's corridor, 'unassigned' where the owner's route is unknown."""
    label = F.concat_ws("-", F.upper("source_code"), F.upper("dest_code"))
    known = routes.where("source_code <> '' and dest_code <> ''").select("route_id", "user_id", label.alias("corridor"))
    return predictions.join(known, ["route_id", "user_id"], "left").withColumn(
        "corridor", F.coalesce("corridor", F.lit("unassigned"))
    )


def nested_rows(header: DataFrame, key: str, children: dict[str, tuple[DataFrame, list[str], Column]]) -> DataFrame:
    """Children of several kinds per header as ordered rows (key, kind, position, fields as JSON).

    Rows instead of arrays: a header with very many children stays spread out,
    and kinds do not multiply each other. ``children`` gives each kind's frame,
    its order and the slot expression of that order.
    """
    parts = []
    for kind, (df, order, slot) in children.items():
        kept = df.join(header.select(key), key, "left_semi")
        r = ranked(kept, [key], order, slot, out="position")
        fields = [c for c in df.columns if c != key]
        parts.append(r.select(key, F.lit(kind).alias("kind"), "position", F.to_json(F.struct(*fields)).alias("fields")))
    out = header.select(key, F.lit("header").alias("kind"), F.lit(0).cast("bigint").alias("position"),
                        F.to_json(F.struct(*[c for c in header.columns if c != key])).alias("fields"))
    for p in parts:
        out = out.unionByName(p)
    return out


def owned_snapshot(routes: DataFrame, snapshots: DataFrame) -> DataFrame:
    return routes.join(snapshots, ["route_id", "user_id"])


def edges_within(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges whose both ends are members."""
    ids = members.select("record_id").distinct()
    return edges.join(ids, F.col("parent") == F.col("record_id"), "left_semi").join(
        ids, F.col("child") == F.col("record_id"), "left_semi"
    )


def linked_records(records: DataFrame, edges: DataFrame) -> DataFrame:
    """Records at either end of an edge: one equi-join instead of an OR over two keys."""
    ends = edges.select(F.col("parent").alias("record_id")).union(edges.select("child")).distinct()
    return records.join(ends, "record_id", "left_semi")


def shipment_twin(shipments: DataFrame, positions: DataFrame, events: DataFrame, limit: int = 100) -> DataFrame:
    """Newest shipments with their latest position and number of open events."""
    top = shipments.orderBy(F.desc("updated_at"), "shipment_id").limit(limit)
    mine = positions.join(top.select("shipment_id"), "shipment_id", "left_semi")
    last = newest(mine, ["shipment_id"], ["observed_at", "position_id"])
    open_n = events.where("state = 'OPEN'").join(top.select("shipment_id"), "shipment_id", "left_semi")
    counts = open_n.groupBy("shipment_id").agg(F.count("*").alias("open_events"))
    src = F.when(F.col("source_type").isNull(), "UNAVAILABLE").when(F.col("source_type") == "SIMULATED", "SIMULATED").otherwise(
        F.concat(F.lit("OPERATOR_DECLARED_UNVERIFIED:"), "source_type")
    )
    return top.join(last, "shipment_id", "left").join(counts, "shipment_id", "left").withColumns(
        {"open_events": F.coalesce("open_events", F.lit(0)), "state_source": src}
    )


def reading_as_of(queries: DataFrame, readings: DataFrame, key: str, ttl_s: int) -> DataFrame:
    """The newest reading at or before each query's time and not older than the TTL, marked CACHED.

    Readings and queries are merged into one time order and the last reading is
    carried forward, so the cost is linear however many share a key.
    """
    fields = [c for c in readings.columns if c not in (key, "ts")]
    r = readings.select(key, "ts", F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("query_id"),
                        F.struct(F.col("ts").alias("observed_at"), *fields).alias("_r"))
    q = queries.select(key, "ts", F.lit(1).alias("_kind"), "query_id")
    both = r.unionByName(q, allowMissingColumns=True)
    slot = F.floor(F.unix_micros("ts") / F.lit(ttl_s * 1_000_000))
    both = both.withColumn("_tie", F.to_json("_r"))
    got = scan(both, [key], ["ts", "_kind", "query_id", "_tie"], slot, [Step("_last", "last", F.col("_r"))]).where("_kind = 1")
    fresh = seconds_between(F.col("ts"), F.col("_last.observed_at")) <= ttl_s
    hit = F.when(fresh, F.col("_last"))
    return got.select(
        "query_id", key, "ts", F.when(hit.isNotNull(), "CACHED").alias("source"), hit["observed_at"].alias("observed_at"),
        *[hit[f].alias(f) for f in fields],
    )


def reconcile(expected: DataFrame, actual: DataFrame, key: str, section: str) -> DataFrame:
    """MISSING, EXTRA or DIGEST_MISMATCH rows between a manifest and stored rows."""
    e = expected.select(F.col(key).alias("_e"), F.col("digest").alias("_ed"))
    a = actual.select(F.col(key).alias("_a"), F.col("digest").alias("_ad"))
    j = e.join(a, F.col("_e") == F.col("_a"), "full_outer")
    code = (
        F.when(F.col("_a").isNull(), "MISSING").when(F.col("_e").isNull(), "EXTRA")
        .when(~F.col("_ed").eqNullSafe(F.col("_ad")), "DIGEST_MISMATCH")
    )
    return j.select(F.lit(section).alias("section"), F.coalesce("_e", "_a").cast("string").alias("id"), code.alias("code")).where("code is not null")


def invalid_manifest_rows(manifest: DataFrame, records: DataFrame, sources: DataFrame, lineage: DataFrame) -> DataFrame:
    """Manifest entries whose record is gone or whose record, source or lineage digest differs.

    ``manifest``: record_id, source_id and three expected digests; ``records``:
    record_id, stored and computed digests; ``sources`` and ``lineage``: computed digests.
    """
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    # what needs no other frame is compared before rows are dealt by record, and sources before both
    m = manifest.join(sent_if_few(sources), "source_id", "left").select(
        "case_id", "record_id", _packed("expected_digest"), "expected_lineage", same("expected_source", "source_digest").alias("source_ok"))
    r = records.select("record_id", _packed("computed_digest"), same("stored_digest", "computed_digest").alias("stored_ok"))
    j = m.join(r, "record_id", "left").join(lineage, "record_id", "left")
    record_ok = same("expected_digest", "computed_digest") & F.col("stored_ok")
    code = (
        F.when(F.col("computed_digest").isNull(), "RECORD_MISSING").when(~record_ok, "RECORD_DIGEST")
        .when(~F.col("source_ok"), "SOURCE_DIGEST")
        .when(~F.col("expected_lineage").eqNullSafe(F.col("lineage_digest")), "LINEAGE_DIGEST")
    )
    return j.select("case_id", "record_id", code.alias("code")).where("code is not null")


def _packed(digest: str) -> Column:
    """A digest as bytes: half as long where it is 64 lower-case hex digits; different texts stay different."""
    c = F.col(digest)
    return F.when(c.rlike(r"\A[0-9a-f]{64}\z"), F.concat(F.unhex(F.lit("00")), F.unhex(c))).otherwise(
        F.concat(F.unhex(F.lit("01")), c.cast("binary"))).alias(digest)


def invalid_receipts(receipts: DataFrame, snapshots: DataFrame, cases: DataFrame) -> DataFrame:
    """Receipts not bound to their snapshot's digest, or attested by someone who may not."""
    j = receipts.join(snapshots.select("snapshot_id", "case_id", "bundle_digest"), "snapshot_id").join(cases, "case_id")
    allowed = F.lower("reviewer_role").isin("approver", "admin")
    assigned = F.coalesce(F.col("reviewer_id") == F.col("assigned_reviewer_id"), F.lit(False))
    wrong = (F.col("outcome") == "ATTESTED") & (~allowed | ~assigned | (F.col("reviewer_id") == F.col("owner_id")))
    code = F.when(F.col("snapshot_digest") != F.col("bundle_digest"), "UNBOUND").when(wrong, "REVIEWER_RULE")
    return j.select("receipt_id", code.alias("code")).where("code is not null")


def neighbourhood(records: DataFrame, edges: DataFrame, owner: str = "user_id") -> DataFrame:
    """Every record's direct parents and children of the same owner, as rows."""
    mine = records.select(F.col("record_id").alias("_id"), F.col(owner).alias("_o"))
    up = edges.select(F.col("child").alias("record_id"), F.col("parent").alias("neighbour"), F.lit("PARENT").alias("side"), "relation")
    down = edges.select(F.col("parent").alias("record_id"), F.col("child").alias("neighbour"), F.lit("CHILD").alias("side"), "relation")
    j = up.unionByName(down).join(records.select("record_id", owner), "record_id")
    return j.join(mine, (F.col("neighbour") == F.col("_id")) & (F.col(owner) == F.col("_o"))).select(
        "record_id", "side", "neighbour", "relation"
    )


def resolved_legs(legs: DataFrame, checks: DataFrame) -> DataFrame:
    """Legs with the status of the check they cite; ``plan_ok`` is false if any citation dangles."""
    got = F.lit("MANUAL_REVIEW")
    for status, reads in LEG_STATUS.items():
        got = F.when(F.col("overall_status") == status, reads).otherwise(got)
    j = legs.join(checks.select("check_id", "overall_status"), "check_id", "left")
    cited = F.col("check_id").isNotNull()
    j = j.withColumns({
        "resolved_status": F.when(cited & F.col("overall_status").isNotNull(), got).otherwise(F.col("compliance_status")),
        "_dangling": cited & F.col("overall_status").isNull(),
    })
    ok = j.groupBy("plan_id").agg((~F.bool_or("_dangling")).alias("plan_ok"))
    return j.drop("_dangling").join(ok, "plan_id")


def port_areas(vessels: DataFrame) -> DataFrame:
    """Which named box each position lies in, the berth before the wider approach."""
    berth = in_box(F.col("lat"), F.col("lon"), BERTH_BOX)
    approach = in_box(F.col("lat"), F.col("lon"), APPROACH_BOX)
    return vessels.withColumn("area", F.when(berth, "BERTH").when(approach, "APPROACH").otherwise("OUTSIDE"))


def sealed_timing(schedules: DataFrame, sealed: DataFrame, tolerance_s: int = 300) -> DataFrame:
    """Whether each schedule agrees with its sealed arrival and loading window within the tolerance."""
    near = lambda a, b: F.coalesce(F.abs(seconds_between(a, b)) <= tolerance_s, F.lit(False))
    j = schedules.join(sealed, "schedule_id", "left")
    arrival = plus_seconds(F.col("evaluated_at"), F.col("arrival_hours") * 3600)
    no_window = F.col("window_start").isNull() & F.col("window_end").isNull()
    no_berth = F.col("berth_start").isNull() & F.col("berth_end").isNull()
    window_ok = F.when(no_window, no_berth).otherwise(
        near(F.col("berth_start"), F.col("window_start")) & near(F.col("berth_end"), F.col("window_end"))
    )
    code = (
        F.when(F.col("evaluated_at").isNull(), "NO_SEALED_TIMING")
        .when(~near(F.col("arrives_at"), arrival), "ARRIVAL_MISMATCH")
        .when(~window_ok, "WINDOW_MISMATCH").otherwise("MATCH")
    )
    return j.select("schedule_id", code.alias("verdict"))


def dangling(children: DataFrame, parents: DataFrame, column: str, code: str) -> DataFrame:
    """Distinct references that no parent row answers."""
    return children.select(column).distinct().join(parents.select(column).distinct(), column, "left_anti").select(
        F.lit(code).alias("code"), F.col(column).cast("string").alias("ref")
    )


def foreign_parents(declared: DataFrame, links: DataFrame) -> DataFrame:
    """Declared parents that are not linked to the same case and owner."""
    return declared.join(links, ["case_id", "owner_id", "record_id"], "left_anti")


def newest_plans(plans: DataFrame, legs: DataFrame, limit: int) -> DataFrame:
    """The newest plans with their legs in order, as one row per leg."""
    top = plans.orderBy(F.desc("created_at"), F.desc("plan_id")).limit(limit)
    kept = legs.join(top.select("plan_id"), "plan_id", "left_semi")
    order = ranked(kept, ["plan_id"], ["seq", "tie"], number_slot("seq", 64), out="leg_no")
    return top.join(order, "plan_id", "left")
