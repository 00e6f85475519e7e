"""Latest rows, sequences, splits, quotas and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions.geo import great_circle_km
from ballast.operators.ordered import balanced_rank, clamped, compose_clamped, newest, number_slot, ranked, scan, Step


def latest_position(positions: DataFrame) -> DataFrame:
    return newest(positions, ["shipment_id"], ["observed_at", "received_at", "position_id"])


def stop_sequence_errors(stop_times: DataFrame, slot: Column, order: list[str]) -> DataFrame:
    """Rows whose sequence does not rise or whose arrival precedes the previous departure.

    ``order`` is the order of the file within a trip.
    """
    prev = F.struct("stop_sequence", "departure_s")
    rows = scan(stop_times, ["trip_id"], order, slot, [Step("_p", "lag", prev)])
    code = F.array_compact(F.array(
        F.when(F.col("departure_s") < F.col("arrival_s"), "DEPARTS_BEFORE_ARRIVAL"),
        F.when(F.col("stop_sequence") <= F.col("_p.stop_sequence"), "NON_INCREASING_SEQUENCE"),
        F.when(F.col("arrival_s") < F.col("_p.departure_s"), "BACKWARDS_IN_TIME"),
    ))
    return rows.withColumn("code", F.explode(code)).drop("_p")


def leg_continuity(legs: DataFrame, plans: DataFrame) -> DataFrame:
    """Breaks in each plan's chain of legs, and ends that differ from the plan's."""
    rows = scan(legs, ["plan_id"], ["seq", "tie"], number_slot("seq", 64), [Step("_p", "lag", F.col("destination"))])
    gaps = rows.where(F.lower("_p") != F.lower("origin")).select("plan_id", F.lit("DISCONTINUOUS").alias("code"), "seq")
    ends = legs.groupBy("plan_id").agg(
        F.min_by("origin", F.struct("seq", "tie")).alias("_o"), F.max_by("destination", F.struct("seq", "tie")).alias("_d"),
        F.min("seq").alias("_lo"), F.max("seq").alias("_hi"),
    ).join(plans, "plan_id")
    start = ends.where(F.lower("_o") != F.lower("plan_origin")).select("plan_id", F.lit("WRONG_START").alias("code"), F.col("_lo").alias("seq"))
    stop = ends.where(F.lower("_d") != F.lower("plan_destination")).select("plan_id", F.lit("WRONG_END").alias("code"), F.col("_hi").alias("seq"))
    return gaps.unionByName(start).unionByName(stop)


def chronological_split(rows: DataFrame, time: str, tie: str, slot: Column, train: float = 0.70, valid: float = 0.85) -> DataFrame:
    """Label rows train, validation or test by place in time; shares are cut to whole rows."""
    r = ranked(rows, [], [time, tie], slot, out="_i", total="_n")
    n = F.col("_n")
    t_end = F.greatest(F.lit(1), F.floor(n * train))
    v_end = F.greatest(t_end + 1, F.floor(n * valid))
    part = F.when(F.col("_i") <= t_end, "train").when(F.col("_i") <= v_end, "validation").otherwise("test")
    return r.withColumn("part", part).drop("_i", "_n")


def quota_ledger(requests: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """Admit single-unit spends while the period's use is under the limit; refunds give back, not below zero.

    A spend is u → min(u + 1, limit) and a refund u → max(u - 1, 0). Any run of
    such steps is u → min(max(u + shift, low), high), and two runs combine into
    one, so the use before and after each request is a composition of steps.
    """
    whole = lambda v: F.lit(v).cast("long")
    shift = F.when(F.col("kind") == "spend", 1).otherwise(-1).cast("long")
    rows = balanced_rank(requests.select(*keys, *order, shift.alias("_d")), keys, order, "_at")
    step = F.struct(F.col("_d").alias("shift"), whole(0).alias("low"), whole(limit).alias("high"))
    found = compose_clamped(rows.select(*keys, *order, "_d", (F.col("_at") - 1).alias("_at"), step.alias("_step")), keys, "_at", "_step")
    use = F.when(F.col("before").isNull(), whole(0)).otherwise(clamped(F.col("before"), whole(0)))
    return found.select(*keys, *order, ((F.col("_d") < 0) | (use < limit)).alias("admitted"), clamped(F.col("upto"), whole(0)).cast("int").alias("used"))


def newer_than(events: DataFrame, marker: Column, limit: int = 25) -> DataFrame:
    """Events after a (created_at, id) marker, oldest first."""
    return events.where(F.struct("created_at", "event_id") > marker).orderBy("created_at", "event_id").limit(limit)


def circuit_states(attempts: DataFrame, asof: Column, threshold: int = 3, cooldown_s: int = 120) -> DataFrame:
    """Failures since the last success per provider and the breaker state that follows.

    Two aggregates replace an ordered walk: the last success, then what failed after it.
    """
    order = F.struct("at", "attempt_id")
    last = attempts.groupBy("provider").agg(
        F.max(F.when(F.col("ok"), order)).alias("_s"), F.max(F.when(F.col("ok"), F.col("at"))).alias("last_success_at"),
        F.max(F.when(~F.col("ok"), F.col("at"))).alias("last_failure_at"),
    )
    after = attempts.where("not ok").join(last.select("provider", "_s"), "provider").where(
        F.col("_s").isNull() | (order > F.col("_s"))
    ).groupBy("provider").agg(F.count("*").alias("failures"), F.max("at").alias("_t"))
    j = last.drop("_s").join(after, "provider", "left")
    n = F.coalesce("failures", F.lit(0))
    retry = F.timestamp_micros(F.unix_micros("_t") + cooldown_s * 1_000_000)
    state = F.when(n < threshold, "CLOSED").when(asof >= retry, "HALF_OPEN").otherwise("OPEN")
    return j.select(
        "provider", n.alias("failures"), state.alias("state"), "last_success_at", "last_failure_at",
        F.when(state == "OPEN", retry).alias("next_attempt_at"),
    )


def failure_streaks(attempts: DataFrame, slot: Column) -> DataFrame:
    """Consecutive failures up to and including each attempt."""
    bad = F.when(F.col("ok"), 0).otherwise(1)
    r = scan(attempts, ["provider"], ["at", "attempt_id"], slot, [Step("_f", "sum", bad)])
    r = scan(r, ["provider"], ["at", "attempt_id"], slot, [Step("_m", "max", F.when(F.col("ok"), F.col("_f")))])
    return r.withColumn("streak", F.col("_f") - F.coalesce("_m", F.lit(0))).drop("_f", "_m")


def even_sample(items: DataFrame, key: str, order: list[str], slot: Column, n: int) -> DataFrame:
    """At most n items of each key at even spacing, both ends kept."""
    r = ranked(items, [key], order, slot, out="_i", total="_m")
    m = F.col("_m")
    if n == 1:
        return r.where("_i = 1").drop("_i", "_m")
    picks = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (m - 1) / (n - 1)).cast("bigint") + 1)
    return r.where((m <= n) | F.array_contains(picks, F.col("_i"))).drop("_i", "_m")


def latest_models(models: DataFrame) -> DataFrame:
    """One row per name and version, a PRODUCTION row before a newer one."""
    live = models.withColumn("_p", (F.col("status") == "PRODUCTION").cast("int"))
    return newest(live, ["model_name", "version"], ["_p", "created_at", "model_id"]).drop("_p")


def latest_per_role(records: DataFrame, keys: list[str]) -> DataFrame:
    return newest(records, keys, ["fetched_at", "record_id"])


def route_samples(legs: DataFrame, points: DataFrame) -> DataFrame:
    """Evenly spaced points of each route: 3 under 500 km, else 5; equal points kept once.

    ``legs``: route_id, seg_id and 0-based leg_no; ``points``: the segments' lines.
    """
    from ballast.operators.nearest import line_pieces

    pieces = line_pieces(points, "seg_id")
    km = great_circle_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    lines = pieces.groupBy("seg_id").agg(F.round(F.sum(km), 1).alias("km"), F.sum("len").alias("line_len"))
    sized = legs.join(lines, "seg_id")
    per = sized.groupBy("route_id").agg(F.count("*").alias("n"), F.sum("km").alias("km"))
    count = F.when(F.round("km", 6) < 500, 3).otherwise(5)
    picks = per.withColumn("_c", count).select(
        "route_id", "n", F.explode(F.transform(F.sequence(F.lit(0), F.col("_c") - 1), lambda i: F.struct(i.alias("i"), (i / (F.col("_c") - 1)).alias("f")))).alias("p")
    )
    place = F.col("p.f") * F.col("n")
    leg = F.least(F.col("n") - 1, F.floor(place))
    picks = picks.select("route_id", F.col("p.i").alias("sample"), leg.alias("leg_no"), (place - leg).alias("share"))
    on = picks.join(sized.select("route_id", "leg_no", "seg_id", "line_len"), ["route_id", "leg_no"])
    want = F.col("share") * F.col("line_len")
    j = on.join(pieces, "seg_id").withColumn("_want", want)
    last = F.col("upto") >= F.col("line_len") - 1e-9
    holds = ((F.col("_want") >= F.col("upto") - F.col("len")) & (F.col("_want") < F.col("upto"))) | (last & (F.col("_want") >= F.col("upto") - F.col("len")))
    t = F.least(F.lit(1.0), (F.col("_want") - F.col("upto") + F.col("len")) / F.nullif("len", F.lit(0.0)))
    at = j.where(holds).select(
        "route_id", "sample",
        F.round(F.col("a_lat") + (F.col("b_lat") - F.col("a_lat")) * F.coalesce(t, F.lit(0.0)), 4).alias("lat"),
        F.round(F.col("a_lon") + (F.col("b_lon") - F.col("a_lon")) * F.coalesce(t, F.lit(0.0)), 4).alias("lon"),
    )
    return at.groupBy("route_id", "lat", "lon").agg(F.min("sample").alias("sample"))
