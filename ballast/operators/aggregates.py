"""Roll-ups of routes, feeds, ports, consists and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions import scoring
from ballast.functions.geo import great_circle_km, in_box
from ballast.functions.track import exceeds, route_label
from ballast.functions.vocab import (
    BERTH_BOX,
    NAV_AT_ANCHOR,
    NAV_MOORED,
    NAV_UNDERWAY,
    ROLES,
    STATE_RANK,
)
from ballast.operators.ordered import Step, newest, number_slot, scan



# --- routes ---------------------------------------------------------------------


def route_scores(legs: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """Congestion and historical scores and transit hours per route.

    With ``routes`` given, a route without legs gets the neutral scores.
    """
    per = legs.groupBy("route_id").agg(
        F.count("*").alias("segments"), F.avg("factor").alias("_f"), F.avg("delay_h").alias("_d"),
        F.sum("delay_h").alias("_s"),
    )
    if routes is not None:
        per = routes.select("route_id").join(per, "route_id", "left")
    n = F.coalesce("segments", F.lit(0))
    return per.select(
        "route_id", n.alias("segments"),
        scoring.static_congestion(F.col("_f")).alias("congestion_score"),
        scoring.historical_score(F.col("_d")).alias("historical_score"),
        F.round(n * 4.5 + F.coalesce("_s", F.lit(0.0)), 2).alias("transit_hours"),
    )


def remaining_hours(legs: DataFrame, km: str = "km", routes: DataFrame | None = None) -> DataFrame:
    """Hours left from a position: distance at 45 km/h plus stored delays; none on a route without legs."""
    per = legs.groupBy("route_id").agg(
        F.round(F.sum(km) / 45 + F.sum("delay_h"), 2).alias("eta_hours"), F.round(F.sum(km), 1).alias("remaining_km")
    )
    return per if routes is None else routes.select("route_id").join(per, "route_id", "left").fillna(0.0, ["eta_hours", "remaining_km"])


def clearance(legs: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """APPROVED, or HARD_BLOCKED with the first segment whose limits the cargo exceeds.

    With ``routes`` given, a route without legs is approved, as nothing blocks it.
    """
    c = F.col
    over = exceeds((c("cargo_h"), c("cargo_w"), c("cargo_t")), (c("max_h"), c("max_w"), c("max_t")))
    first = F.min_by("seg_id", F.when(over, F.struct("seq", "seg_id")))
    per = legs.groupBy("route_id").agg(first.alias("blocking_segment"))
    if routes is not None:
        per = routes.select("route_id").join(per, "route_id", "left")
    return per.withColumn(
        "status", F.when(F.col("blocking_segment").isNull(), "APPROVED").otherwise("HARD_BLOCKED")
    )


def stress_every_route(routes: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Each route under each scenario. Every pair is asked for; Spark broadcasts the scenarios if their size allows."""
    pairs = routes.crossJoin(scenarios)
    v = scoring.stressed(F.col("reliability_score"), F.col("storm"), F.col("kp"), F.col("port"))
    return pairs.withColumn("_v", v).select("*", "_v.score", "_v.degradation_pct", "_v.alerts").drop("_v")


def journey_stress(stressed: DataFrame, journey: str) -> DataFrame:
    """Weakest leg of each journey before and after stress, per scenario."""
    per = stressed.groupBy(journey, "scenario").agg(
        F.min("reliability_score").alias("original"), F.min("score").alias("stressed"),
        # alerts are a closed set of three codes
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("alerts")))).alias("alerts"),
    )
    lost = F.greatest(F.lit(0), F.col("original") - F.col("stressed")) * 100.0 / F.col("original")
    return per.withColumn("degradation_pct", F.when(F.col("original") == 0, 0.0).otherwise(F.round(lost, 6)))


def journey_merge(legs: DataFrame, journey: str) -> DataFrame:
    """One row per multi-leg journey: weakest score, strictest state, first status that is not approved."""
    rank = F.lit(None).cast("int")
    for state, r in STATE_RANK.items():
        rank = F.when(F.col("decision_state") == state, r).otherwise(rank)
    worst = F.max_by("decision_state", rank)
    unknown = F.bool_or(rank.isNull())
    bad = F.col("status") != "APPROVED"
    return legs.groupBy(journey).agg(
        F.count("*").alias("legs"),
        F.min("reliability_score").alias("reliability_score"),
        F.when(unknown, "UNAVAILABLE").otherwise(worst).alias("decision_state"),
        F.coalesce(F.min_by("status", F.when(bad, F.struct("leg_no", "status"))), F.lit("APPROVED")).alias("status"),
        F.when(F.count("estimated_hours") == F.count("*"), F.round(F.sum("estimated_hours"), 2)).alias("estimated_hours"),
        F.count_distinct("route_id").alias("routes"),
    )


def distinct_in_order(df: DataFrame, key: str, pos: str, value: str) -> DataFrame:
    """Each distinct value of a key with the first place it takes."""
    return df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(pos).alias("first_pos"))


def journey_parts(legs: DataFrame, steps: DataFrame, alerts: DataFrame, journey: str) -> DataFrame:
    """Distinct segments and alerts of multi-leg journeys as rows (part, value, leg_no, seq), at their first place.

    ``steps``: route_id, segment and its place seq; ``alerts``: journey, leg_no and
    alert. Rows, not arrays: a journey may have any number of segments.
    """
    place = F.struct("leg_no", "seq").alias("pos")
    on = legs.select(journey, "leg_no", "route_id").join(steps, "route_id")
    rows = on.select(F.struct(journey, F.lit("segment").alias("part")).alias("key"), place, F.col("segment").alias("value")).unionByName(
        alerts.withColumn("seq", F.lit(0).cast(steps.schema["seq"].dataType)).select(F.struct(journey, F.lit("alert").alias("part")).alias("key"), place, F.col("alert").alias("value")))
    return distinct_in_order(rows, "key", "pos", "value").select(f"key.{journey}", "key.part", "value", "first_pos.leg_no", "first_pos.seq")


def kit_status(legs: DataFrame, journey: str) -> DataFrame:
    """Evidence-kit status of a journey and how much of it is traced, as a rounded percentage."""
    total = F.sum("total")
    return legs.groupBy(journey).agg(
        F.when(F.bool_or(F.col("kit_status").isNull()), "UNAVAILABLE")
        .when(F.bool_or(F.col("kit_status") != "HOT"), "DEGRADED").otherwise("HOT").alias("kit_status"),
        F.when(total > 0, F.round(F.sum("traced") / total * 100).cast("int")).alias("coverage_pct"),
    )


def weakest_weather(samples: DataFrame, key: str, pos: str) -> DataFrame:
    """The lowest-scored sample governs; one unknown sample makes the route's score unknown."""
    known = F.count("score") == F.count("*")
    return samples.groupBy(key).agg(
        F.when(known, F.min("score")).alias("score"),
        F.when(known, F.min_by(pos, F.struct("score", pos))).otherwise(F.min(pos)).alias("governing"),
        F.count("*").alias("samples"),
    )


def bottleneck(legs: DataFrame, weather: DataFrame) -> DataFrame:
    """Predicted delay in whole minutes, its worst segment, and how much is weather or congestion."""
    hist = F.greatest(F.lit(0.0), F.col("delay_h") * 60)
    cong = F.greatest(F.lit(0.0), (F.col("factor") - 1) * 30)
    per = legs.withColumns({"_h": hist, "_c": cong}).groupBy("route_id").agg(
        F.sum("_h").alias("_h"), F.sum("_c").alias("_c"),
        F.min_by(route_label(F.col("src_code"), F.col("dst_code")), F.struct(-F.round(F.col("_h") + F.col("_c"), 9), F.col("seq"))).alias("bottleneck"),
    )
    w = F.greatest(F.lit(0.0), (100 - F.col("weather_score")) * 0.3)
    wm = F.coalesce(w, F.lit(0.0))
    # the parts are sums of doubles: drop noise far below a minute before rounding up
    total = F.round(F.col("_h") + F.col("_c") + wm, 9)
    return per.join(weather.select("route_id", "weather_score"), "route_id").select(
        "route_id", F.ceil(total).cast("int").alias("delay_minutes"), "bottleneck",
        F.when(F.col("weather_score").isNotNull(), F.when(total > 0, F.round(wm / total * 100, 1)).otherwise(0.0)).alias("weather_pct"),
        F.when(total > 0, F.round(F.col("_c") / total * 100, 1)).otherwise(0.0).alias("congestion_pct"),
    )


def line_length(points: DataFrame, line: str, pos: str = "pos") -> DataFrame:
    """Sum of great-circle hops along each line, to 0.1 km."""
    return hops(points, line, pos).groupBy(line).agg(F.round(F.sum("km"), 1).alias("km"))


def hops(points: DataFrame, line: str, pos: str = "pos", width: int = 4096) -> DataFrame:
    """Each point with the one before it on its line and the distance between them."""
    here = F.struct("lat", "lon")
    pairs = scan(points, [line], [pos], number_slot(pos, width), [Step("prev", "lag", here)])
    km = great_circle_km(F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon"))
    return pairs.where("prev is not null").withColumn("km", km)


def centroid(points: DataFrame, key: str) -> DataFrame:
    return points.groupBy(key).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


# --- feeds ----------------------------------------------------------------------


def station_board(trains: DataFrame, keys: list[str]) -> DataFrame:
    """Trains, mean and worst known delay and trains standing, per station."""
    d = F.col("delay")
    return trains.groupBy(*keys).agg(
        F.count("*").alias("trains"),
        F.round(F.coalesce(F.avg(d), F.lit(0.0)), 1).alias("mean_delay"),
        F.coalesce(F.max(d), F.lit(0)).alias("max_delay"),
        F.count_if(F.col("live_type") == "at-station").alias("at_station"),
    )


def corridor_score(readings: DataFrame, key: str) -> DataFrame:
    """Delay of a corridor's usable stations weighted by their trains, as a score."""
    usable = readings.where(F.col("source") != "UNAVAILABLE")
    w = F.greatest(F.col("trains"), F.lit(1))
    mean = F.sum(F.col("mean_delay") * w) / F.sum(w)
    return usable.groupBy(key).agg(
        F.round(mean, 9).alias("_m"), F.when(F.bool_or(F.col("source") == "LIVE"), "LIVE").otherwise("CACHED").alias("source"),
        F.min("observed_at").alias("observed_at"), F.max("max_delay").alias("worst_delay"),
    ).select(key, scoring.delay_curve(F.col("_m")).alias("score"), "source", "observed_at", "worst_delay")


def late_trains(trains: DataFrame, minutes: float = 30) -> DataFrame:
    text = F.format_string("%s (%s) running %dm late", F.col("number"), F.col("name"), F.floor("delay"))
    return trains.where(F.col("delay") >= minutes).withColumn("alert", text)


def port_activity(vessels: DataFrame, asof: Column, keys: list[str], expiry_min: int = 45, idle_min: int = 10) -> DataFrame:
    """Counts over each vessel's latest state that is not older than the expiry."""
    now = F.unix_micros(asof)
    live = vessels.where(F.unix_micros("seen_at") >= now - expiry_min * 60_000_000)
    status = F.col("nav_status")
    per = live.groupBy(*keys).agg(
        F.count("*").alias("tracked"),
        F.count_if(status == NAV_AT_ANCHOR).alias("at_anchor"),
        F.count_if((status == NAV_MOORED) & in_box(F.col("lat"), F.col("lon"), BERTH_BOX)).alias("moored"),
        F.count_if(status == NAV_UNDERWAY).alias("underway"),
        F.max("seen_at").alias("observed_at"),
    )
    stale = now - F.unix_micros("observed_at") > idle_min * 60_000_000
    return per.withColumns({
        "source": F.when(F.col("tracked") == 0, "UNAVAILABLE").when(stale, "STALE_AIS").otherwise("LIVE_AIS"),
        "congestion_pct": F.when(F.col("tracked") > 0, scoring.queue_pct(F.col("at_anchor"), F.col("moored"))),
    })


def latest_vessels(messages: DataFrame) -> DataFrame:
    return newest(messages, ["vessel_id"], ["seen_at", "message_id"])


def condition_report(points: DataFrame, conditions: DataFrame, kp: DataFrame, report: str, first_points: int | None = None) -> DataFrame:
    """Conditions of each report's points, one solar row at Kp 5 or more, and its status.

    A report covers all its points, or the first ``first_points`` where that is given.

    ``points`` has (report, pos, valid, lat, lon); ``conditions`` has (report, pos, type);
    ``kp`` has one row per report with a nullable index.
    """
    first = points if first_points is None else points.where(F.col("pos") < first_points)
    status = first.groupBy(report).agg(F.count_if(~F.col("valid")).alias("failures")).join(kp, report, "left")
    status = status.select(
        report, (F.col("failures") + F.when(F.col("kp").isNull(), 1).otherwise(0)).alias("failures"), "kp"
    )
    usable = conditions.join(first.where("valid").select(report, "pos"), [report, "pos"], "left_semi")
    solar = status.where("kp >= 5").select(report, F.lit("solar").alias("type"))
    rows = usable.select(report, "type").unionByName(solar).groupBy(report, "type").agg(F.count("*").alias("n"))
    return status.join(rows, report, "left").select(
        report, F.when(F.col("failures") == 0, "AVAILABLE").otherwise("UNAVAILABLE").alias("status"),
        "failures", "type", F.coalesce("n", F.lit(0)).alias("n"),
    )


# --- consists -------------------------------------------------------------------


def consist_totals(carriages: DataFrame, declared: DataFrame) -> DataFrame:
    """Weight, length and largest dimensions of each consist, and whether every declared place is filled once."""
    per = carriages.groupBy("consist_id").agg(
        F.round(F.sum("gross_t"), 3).alias("gross_t"), F.round(F.sum("length_m"), 3).alias("length_m"),
        F.max("height_m").alias("max_height_m"), F.max("width_m").alias("max_width_m"),
        F.round(F.max(F.col("gross_t") / F.col("axles")), 6).alias("max_axle_t"),
        F.count("*").alias("_n"), F.count_distinct("position").alias("_k"),
        F.min("position").alias("_lo"), F.max("position").alias("_hi"),
    )
    n = F.col("declared")
    whole = (n > 0) & (F.col("_n") == n) & (F.col("_k") == n) & (F.col("_lo") == 1) & (F.col("_hi") == n)
    return declared.join(per, "consist_id", "left").select(
        "consist_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in
                        ("gross_t", "length_m", "max_height_m", "max_width_m", "max_axle_t")],
        F.coalesce(whole, F.lit(False)).alias("complete"),
    )


def backfilled_counts(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Declared child count of every parent: the children it has, and at least one."""
    n = children.groupBy(key).agg(F.count("*").alias("_n"))
    return parents.join(n, key, "left").select(key, F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1)).alias("declared"))


# --- counts ---------------------------------------------------------------------


def group_counts(df: DataFrame, column: str, section: str | None = None) -> DataFrame:
    out = df.groupBy(F.col(column).cast("string").alias("key")).agg(F.count("*").alias("n"))
    return out if section is None else out.select(F.lit(section).alias("section"), "key", "n")


def overview(sections: dict[str, tuple[DataFrame, str]], totals: dict[str, DataFrame]) -> DataFrame:
    """All group counts and totals as (section, key, n)."""
    parts = [group_counts(df, col, name) for name, (df, col) in sections.items()]
    parts += [
        df.agg(F.count("*").alias("n")).select(F.lit("total").alias("section"), F.lit(name).alias("key"), "n")
        for name, df in totals.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def traced_share(records: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of role-bearing records with a known source, an operator origin or any lineage edge.

    The "either end" condition is one equi-join against all ends, not an OR.
    """
    ends = edges.select(F.col("parent").alias("record_id")).union(edges.select("child")).distinct()
    roles = records.where("role is not null")
    linked = roles.join(ends.withColumn("_l", F.lit(True)), "record_id", "left")
    ok = F.col("source_id").isNotNull() | (F.col("source_type") == "OPERATOR_INPUT") | F.col("_l").isNotNull()
    return linked.agg(F.count_if(ok).alias("traced"), F.count("*").alias("total")).withColumn(
        "percent", F.when(F.col("total") > 0, F.round(F.col("traced") / F.col("total") * 100, 1)).otherwise(0.0)
    )


def traceability(records: DataFrame, key: str) -> DataFrame:
    """Traced roles of five, and counts by freshness and by use, per decision."""
    c = F.col
    traced = (
        c("role").isin(*ROLES) & c("fetched_at").isNotNull() & c("has_value")
        & (c("source_id").isNotNull() | (c("source_type") == "UNAVAILABLE"))
    )
    stated = c("decision_use")
    use = F.coalesce(
        F.when(stated.isin("included", "excluded", "informational"), stated),
        F.when(c("used"), "included").when(c("excluded_reason").isNotNull(), "excluded").otherwise("informational"),
    )
    states = ("FRESH", "AGING", "STALE", "UNKNOWN", "NOT_APPLICABLE")
    per = records.withColumn("_use", use).groupBy(key).agg(
        F.count_distinct(F.when(traced, c("role"))).alias("traced"),
        *[F.count_if(c("freshness") == s).alias(s.lower()) for s in states],
        *[F.count_if(c("_use") == u).alias(u) for u in ("included", "excluded", "informational")],
    )
    return per.withColumn("coverage_pct", F.round(c("traced") / len(ROLES) * 100, 1))


def source_modes(records: DataFrame, key: str) -> DataFrame:
    return records.groupBy(key, "source_type").agg(F.count("*").alias("n"))


def request_log(requests: DataFrame) -> DataFrame:
    """Counts by method, path and status, and count and time by method and path, in one pass."""
    out = requests.groupingSets(
        [["method", "path", "status"], ["method", "path"]], "method", "path", "status"
    ).agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 6).alias("seconds"), F.grouping("status").alias("_g"))
    return out.select(
        F.when(F.col("_g") == 0, "status").otherwise("path").alias("level"), "method", "path", "status", "n", "seconds"
    )


def prediction_totals(predictions: DataFrame) -> DataFrame:
    return predictions.agg(
        F.count("*").alias("requests"), F.count_if("fallback").alias("fallbacks"),
        F.count_if("error").alias("errors"), F.round(F.sum("seconds"), 6).alias("seconds"),
    )


def next_sequence(parents: DataFrame, snapshots: DataFrame, key: str) -> DataFrame:
    top = snapshots.groupBy(key).agg(F.max("sequence_no").alias("_m"))
    return parents.select(key).join(top, key, "left").select(key, (F.coalesce("_m", F.lit(0)) + 1).alias("next"))


def feed_summary(members: dict[str, DataFrame], **identity: str) -> DataFrame:
    """Row counts of a feed's tables with the identity of its source."""
    parts = [
        df.agg(F.count("*").alias("n")).select(
            F.lit(name).alias("table"), "n", *[F.lit(v).alias(k) for k, v in identity.items()]
        )
        for name, df in members.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
