"""Scores of routes, corridors and ports, on a 0..100 scale unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ballast.functions.common import clamp, codes, plus_seconds, seconds_between
from ballast.functions.vocab import DELAY_CURVE, PORT_TERMINALS, WEIGHTS


def blend(static: Column, live: Column, weight: Column | float) -> Column:
    w = clamp(F.lit(weight).cast("double"), 0.0, 1.0)
    return F.round(static * (1 - w) + live * w, 1)


def delay_curve(minutes: Column) -> Column:
    """Straight lines through the fixed points; 0 from the last one on."""
    last_x = DELAY_CURVE[-1][0]
    out = F.when(minutes >= last_x, 0.0)
    for (x0, y0), (x1, y1) in zip(DELAY_CURVE, DELAY_CURVE[1:]):
        line = F.round(y0 + (y1 - y0) * ((minutes - x0) / (x1 - x0)), 1)
        out = out.when(minutes.between(x0, x1), line)
    return F.when(minutes.isNotNull(), out.otherwise(100.0))


def queue_pct(at_anchor: Column, moored: Column) -> Column:
    """Port congestion from the anchored queue, raised by up to 10 for occupied berths."""
    base = (
        F.when(at_anchor <= 2, at_anchor * 10.0)
        .when(at_anchor <= 6, 20.0 + (at_anchor - 2) * 8.75)
        .when(at_anchor <= 12, 55.0 + (at_anchor - 6) * 5.0)
        .otherwise(F.least(F.lit(100.0), 85.0 + (at_anchor - 12) * 3.0))
    )
    return F.round(F.least(F.lit(100.0), base + F.least(F.lit(10.0), moored * 1.25)), 1)


def port_penalty(pct: Column) -> Column:
    return F.round(F.least(F.lit(25.0), pct * 0.25), 1)


def static_congestion(mean_factor: Column) -> Column:
    return F.coalesce(clamp(100 - (mean_factor - 1) * 40, 0.0, 100.0), F.lit(50.0))


def historical_score(mean_delay_hours: Column) -> Column:
    return F.coalesce(clamp(100 - mean_delay_hours * 10, 0.0, 100.0), F.lit(75.0))


def segment_cost(delay_hours: Column, factor: Column) -> Column:
    return F.lit(4.5) + delay_hours * 1.2 + F.greatest(F.lit(0.0), factor - 1) * 3.0


def resolved_congestion(
    static: Column, live: Column, worst_delay: Column, dest_code: Column,
    port_pct: Column, at_anchor: Column, weight: float = 0.6,
) -> Column:
    """Static score blended with the live one; ports weigh in only for routes that end there.

    Returns ``struct<score,source,penalty,alerts>``. A null ``live`` leaves the static score.
    """
    to_port = F.upper(dest_code).isin(*PORT_TERMINALS) & port_pct.isNotNull()
    railed = blend(static, live, weight)
    penalty = F.when(live.isNotNull() & to_port, port_penalty(port_pct)).otherwise(0.0)
    score = (
        F.when(live.isNull(), static)
        .when(to_port, F.round(F.greatest(F.lit(0.0), railed - penalty), 1))
        .otherwise(railed)
    )
    source = (
        F.when(live.isNull(), "STATIC_ONLY")
        .when(to_port, "STATIC_PLUS_LIVE_RAIL_AND_PORT")
        .otherwise("STATIC_PLUS_LIVE_RAIL")
    )
    alerts = codes(
        (live.isNotNull() & (worst_delay >= 60), "LONG_DELAYS"),
        (live.isNotNull() & to_port & (at_anchor >= 7), "BERTH_QUEUE"),
    )
    return F.struct(
        score.alias("score"), source.alias("source"), penalty.alias("penalty"), alerts.alias("alerts")
    )


def window_alignment(asof: Column, hours: Column, start: Column, end: Column) -> Column:
    """How well an arrival falls in a loading window: ``struct<available,score,aligned,state>``."""
    arrival = plus_seconds(asof, hours * 3600)
    early_h = seconds_between(start, arrival) / 3600
    span = F.greatest(seconds_between(end, start), F.lit(1.0))
    share = seconds_between(arrival, start) / span
    known = start.isNotNull() & end.isNotNull()
    score = (
        F.when(~known, 0.0)
        .when(arrival < start, F.greatest(F.lit(40.0), 100 - early_h * 3))
        .when(arrival > end, 0.0)
        .otherwise(clamp(100 - F.abs(share - 0.3) * 30, 60.0, 100.0))
    )
    state = (
        F.when(~known, "UNAVAILABLE").when(arrival < start, "EARLY").when(arrival > end, "MISSED").otherwise("ALIGNED")
    )
    return F.struct(
        known.alias("available"), score.alias("score"), (state == "ALIGNED").alias("aligned"), state.alias("state")
    )


def reliability(
    weather: Column, port: Column, congestion: Column, historical: Column, blocked: Column
) -> Column:
    """Weighted mean rounded up; unknown weather or port leave both sum and weight; 0 when blocked."""
    # summed in this order: the last bit decides where the mean lies just above a whole number
    parts = (
        (WEIGHTS["congestion"], congestion), (WEIGHTS["historical"], historical),
        (WEIGHTS["weather"], weather), (WEIGHTS["port"], port),
    )
    total, value = F.lit(0.0), F.lit(0.0)
    for w, c in parts:
        total = total + F.when(c.isNotNull(), w).otherwise(0.0)
        value = value + F.coalesce(F.lit(w) * c, F.lit(0.0))
    return F.when(blocked | (total <= 0), 0).otherwise(F.ceil(value / total).cast("int"))


def applied_weights(port_known: Column, weather_known: Column) -> Column:
    """Map of the weights in use after renormalising, to 4 places; absent factors have no key."""
    used = {
        "congestion": F.lit(True), "historical": F.lit(True), "weather": weather_known, "port": port_known,
    }
    total = sum((F.when(on, WEIGHTS[k]).otherwise(0.0) for k, on in used.items()), F.lit(0.0))
    pairs = [
        F.when(on, F.struct(F.lit(k).alias("key"), F.round(WEIGHTS[k] / total, 4).alias("value")))
        for k, on in used.items()
    ]
    return F.map_from_entries(F.array_compact(F.array(*pairs)))


def stressed(base: Column, storm: Column, kp: Column, port: Column) -> Column:
    """What-if score: ``struct<score,degradation_pct,alerts>``."""
    penalty = (
        F.when(storm > 0, storm * 0.35).otherwise(0.0)
        + F.when(kp >= 7, (kp - 6) * 12.0).otherwise(0.0)
        + F.when(port > 0, port * 0.25).otherwise(0.0)
    )
    score = F.greatest(F.lit(0), (base - penalty).cast("int"))
    lost = F.when(base == 0, 0.0).otherwise(F.round((base - score) / base * 100, 1))
    alerts = codes((storm > 0, "STORM"), (kp >= 7, "GEOMAGNETIC"), (port > 0, "PORT_GRIDLOCK"))
    return F.struct(score.alias("score"), lost.alias("degradation_pct"), alerts.alias("alerts"))
