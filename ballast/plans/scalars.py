"""Column functions applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ballast.functions import clock, delay, digest, freshness, geo, scoring, track, weather
from ballast.operators import aggregates as agg
from ballast.plans.registry import query

AT = "2024-01-20 00:00:00"


def asof():
    return F.lit(AT).cast("timestamp")


def joined(col):
    """Arrays as one text, so that results compare cell by cell."""
    return F.array_join(col, ",")


@query("fun_01_great_circle_km", needs=("weather",), oracle="""
SELECT point_id, round(2 * 6371.0 * asin(sqrt(least(1.0,
    pow(sin(radians(18.95 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(18.95)) * pow(sin(radians(72.95 - lon) / 2), 2)))), 6) AS km
FROM weather""")
def _(t):
    km = geo.great_circle_km(F.col("lat"), F.col("lon"), F.lit(18.95), F.lit(72.95))
    return t.weather.select("point_id", F.round(km, 6).alias("km"))


@query("fun_02_service_time_seconds", needs=("clock_texts",), oracle=r"""
SELECT event_id, CASE WHEN regexp_matches(trim(text), '^[0-9]{1,3}:[0-5][0-9](:[0-5][0-9])?$')
    AND cast(split_part(trim(text), ':', 1) as int) <= 167
    THEN cast(split_part(trim(text), ':', 1) as int) * 3600 + cast(split_part(trim(text), ':', 2) as int) * 60
       + coalesce(try_cast(split_part(trim(text), ':', 3) as int), 0) END AS seconds
FROM clock_texts""")
def _(t):
    return t.clock_texts.select("event_id", clock.service_seconds(F.col("text")).alias("seconds"))


@query("fun_03_schedule_value", needs=("clock_texts",), oracle=r"""
SELECT event_id,
  CASE WHEN plain AND h <= 167 THEN CASE WHEN h < 100 THEN lpad(cast(h as varchar), 2, '0') ELSE cast(h as varchar) END || ':' || split_part(x, ':', 2) || ':' ||
            CASE WHEN split_part(x, ':', 3) = '' THEN '00' ELSE split_part(x, ':', 3) END
       WHEN NOT plain THEN strftime(utc, '%H:%M:%S') END AS time,
  CASE WHEN NOT plain THEN strftime(utc, '%Y-%m-%d') END AS date
FROM (SELECT event_id, trim(text) AS x, regexp_matches(trim(text), '^[0-9]{1,3}:[0-5][0-9](:[0-5][0-9])?$') AS plain,
             try_cast(split_part(trim(text), ':', 1) as int) AS h,
             make_timestamp(epoch_us(try_cast(text as timestamptz))) AS utc FROM clock_texts) s""")
def _(t):
    v = clock.schedule_value(F.col("text"))
    return t.clock_texts.select("event_id", v["time"].alias("time"), v["date"].alias("date"))


@query("fun_04_unix_to_timestamp", needs=("obs",), oracle="""
SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN (1700000000 + event_id * 61) * 1000000 END AS micros FROM obs""")
def _(t):
    raw = F.when(F.col("event_id") % 9 == 0, F.lit("n/a")).otherwise((1700000000 + F.col("event_id") * 61).cast("string"))
    return t.obs.select("event_id", F.unix_micros(clock.from_unix(raw)).alias("micros"))


@query("fun_05_blend", needs=("routes",), oracle="""
SELECT route_id, round(congestion_score * (1 - w) + historical_score * w, 1) AS score
FROM (SELECT *, greatest(0.0::double, least(1.0::double, (route_id % 15) / 1e1 - 0.2137e0)) AS w FROM routes) r""")
def _(t):
    w = (F.col("route_id") % 15) / 10 - 0.2137
    return t.routes.select("route_id", scoring.blend(F.col("congestion_score"), F.col("historical_score"), w).alias("score"))


@query("fun_06_delay_curve", needs=("features",), oracle="""
SELECT row_id, CASE WHEN m >= 180 THEN 0.0::double WHEN m <= 15 THEN round(100 - 15 * (m / 15), 1)
  WHEN m <= 30 THEN round(85 + -15.0e0 * ((m - 15) / 15), 1) WHEN m <= 60 THEN round(70 + -30.0e0 * ((m - 30) / 30), 1)
  WHEN m <= 120 THEN round(40 + -30.0e0 * ((m - 60) / 60), 1) ELSE round(10 + -10.0e0 * ((m - 120) / 60), 1) END AS score
FROM (SELECT row_id, current_delay * 5 AS m FROM features) f""")
def _(t):
    return t.features.select("row_id", scoring.delay_curve(F.col("current_delay") * 5).alias("score"))


@query("fun_07_queue_pct", needs=("obs",), oracle="""
SELECT event_id, round(least(100.0::double, CASE WHEN a <= 2 THEN a * 10.0e0 WHEN a <= 6 THEN 20 + (a - 2) * 8.75e0
   WHEN a <= 12 THEN 55 + (a - 6) * 5.0e0 ELSE least(100.0::double, 85 + (a - 12) * 3.0e0) END + least(10.0::double, m * 1.25e0)), 1) AS pct
FROM (SELECT event_id, k % 20 AS a, k % 11 AS m FROM obs) o""")
def _(t):
    return t.obs.select("event_id", scoring.queue_pct(F.col("k") % 20, F.col("k") % 11).alias("pct"))


@query("fun_08_port_penalty", needs=("obs",), oracle="""
SELECT event_id, round(least(25.0::double, (k * 1.5e0) * 0.25e0), 1) AS penalty FROM obs""")
def _(t):
    return t.obs.select("event_id", scoring.port_penalty(F.col("k") * 1.5).alias("penalty"))


@query("fun_10_window_alignment", needs=("schedules",), oracle="""
SELECT schedule_id, available, aligned, state,
  round(CASE state WHEN 'UNAVAILABLE' THEN 0 WHEN 'EARLY' THEN greatest(40.0::double, 100 - ((s - a) / 1e6 / 3600) * 3) WHEN 'MISSED' THEN 0
     ELSE greatest(60.0::double, least(100.0::double, 100 - abs((a - s) / 1e6 / greatest((e - s) / 1e6, 1.0::double) - 0.3e0) * 30)) END, 6) AS score
FROM (SELECT *, s IS NOT NULL AS available, s IS NOT NULL AND a >= s AND a <= e AS aligned,
        CASE WHEN s IS NULL THEN 'UNAVAILABLE' WHEN a < s THEN 'EARLY' WHEN a > e THEN 'MISSED' ELSE 'ALIGNED' END AS state
      FROM (SELECT schedule_id, epoch_us(departs_at) + (schedule_id % 200) * 3600000000 AS a, epoch_us(berth_start) AS s, epoch_us(berth_end) AS e
            FROM schedules) x) y""")
def _(t):
    v = scoring.window_alignment(
        F.col("departs_at"), (F.col("schedule_id") % 200).cast("double"), F.col("berth_start"), F.col("berth_end")
    )
    return t.schedules.select("schedule_id", v.alias("v")).select(
        "schedule_id", "v.available", "v.aligned", "v.state", F.round("v.score", 6).alias("score")
    )


@query("fun_11_reliability", needs=("routes",), oracle="""
SELECT route_id, CASE WHEN clearance_failed THEN 0 ELSE cast(ceil((0.0e0 + 0.15e0 * congestion_score + 0.15e0 * historical_score
    + coalesce(0.4e0 * weather_score, 0) + coalesce(0.3e0 * port_score, 0))
  / (0.0e0 + 0.15e0 + 0.15e0 + CASE WHEN weather_score IS NULL THEN 0 ELSE 0.4e0 END + CASE WHEN port_score IS NULL THEN 0 ELSE 0.3e0 END)) as int) END AS score
FROM routes""")
def _(t):
    c = F.col
    return t.routes.select("route_id", scoring.reliability(
        c("weather_score"), c("port_score"), c("congestion_score"), c("historical_score"), c("clearance_failed")).alias("score"))


@query("fun_12_applied_weights", needs=("routes",), oracle="""
SELECT route_id, round(0.15e0 / w, 4) AS congestion, round(0.15e0 / w, 4) AS historical,
  CASE WHEN weather_score IS NOT NULL THEN round(0.4e0 / w, 4) END AS weather, CASE WHEN port_score IS NOT NULL THEN round(0.3e0 / w, 4) END AS port
FROM (SELECT *, 0.15e0 + 0.15e0 + CASE WHEN weather_score IS NULL THEN 0 ELSE 0.4e0 END + CASE WHEN port_score IS NULL THEN 0 ELSE 0.3e0 END AS w FROM routes) r""")
def _(t):
    m = scoring.applied_weights(F.col("port_score").isNotNull(), F.col("weather_score").isNotNull())
    return t.routes.select("route_id", m.alias("m")).select(
        "route_id", *[F.col("m")[k].alias(k) for k in ("congestion", "historical", "weather", "port")])


@query("fun_13_what_if_stress", needs=("routes",), oracle="""
SELECT route_id, scenario, sim AS score, CASE WHEN base = 0 THEN 0 ELSE round((base - sim) / cast(base as double) * 100, 1) END AS degradation_pct, alerts
FROM (SELECT route_id, scenario, reliability_score AS base,
   cast(greatest(0, trunc(reliability_score - (CASE WHEN storm > 0 THEN storm * 0.35e0 ELSE 0 END + CASE WHEN kp >= 7 THEN (kp - 6) * 12.0e0 ELSE 0 END
      + CASE WHEN port > 0 THEN port * 0.25e0 ELSE 0 END))) as int) AS sim,
   concat_ws(',', CASE WHEN storm > 0 THEN 'STORM' END, CASE WHEN kp >= 7 THEN 'GEOMAGNETIC' END, CASE WHEN port > 0 THEN 'PORT_GRIDLOCK' END) AS alerts
 FROM routes CROSS JOIN (VALUES ('storm', 80.0e0, 3, 0.0e0), ('solar', 0.0e0, 8, 0.0e0), ('all', 60.0e0, 9, 40.0e0)) s(scenario, storm, kp, port)) x""")
def _(t):
    scenarios = t.spark.createDataFrame(
        [("storm", 80.0, 3, 0.0), ("solar", 0.0, 8, 0.0), ("all", 60.0, 9, 40.0)], "scenario string, storm double, kp int, port double")
    return agg.stress_every_route(t.routes, scenarios).select(
        "route_id", "scenario", "score", "degradation_pct", joined("alerts").alias("alerts"))


@query("fun_14_segment_cost", needs=("segments",), oracle="""
SELECT seg_id, round(4.5e0 + delay_h * 1.2e0 + greatest(0.0::double, factor - 1) * 3.0e0, 6) AS cost FROM segments""")
def _(t):
    return t.segments.select("seg_id", F.round(scoring.segment_cost(F.col("delay_h"), F.col("factor")), 6).alias("cost"))


@query("fun_15_delay_estimate", needs=("route_legs", "routes"), oracle="""
SELECT r.route_id, CASE WHEN n IS NULL THEN 30 ELSE cast(floor(round(d, 6) * 60 + congestion_score * 0.5e0 + coalesce(100 - weather_score, 0) * 0.8e0) as int) END AS delay_minutes,
  CASE WHEN n IS NULL THEN 'LOW' WHEN coalesce(100 - weather_score, 0) < 30 AND congestion_score < 40 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence
FROM routes r LEFT JOIN (SELECT route_id, count(*) AS n, sum(delay_h) AS d FROM route_legs GROUP BY route_id) g USING (route_id)""")
def _(t):
    legs = t.route_legs.groupBy("route_id").agg(F.count("*").alias("n"), F.round(F.sum("delay_h"), 6).alias("d"))
    v = delay.delay_estimate(
        F.col("d"), F.coalesce("n", F.lit(0)), F.col("congestion_score"), F.coalesce(100 - F.col("weather_score"), F.lit(0.0)))
    return t.routes.join(legs, "route_id", "left").select("route_id", v.alias("v")).select("route_id", "v.*")


FORMULA_SQL = """round(greatest(0.0::double, current_delay + historical_delay * greatest(0.0::double, 1 - journey_progress) + (100 - weather_score) * 0.32e0
  + corridor_congestion * 0.28e0 + greatest(0.0::double, port_pressure - 50) * 0.18e0 + schedule_conflicts * 12 + greatest(0.0::double, cargo_weight - 100) * 0.08e0), 2)"""


@query("fun_16_formula_delay", needs=("features",), oracle=f"SELECT row_id, {FORMULA_SQL} AS minutes FROM features")
def _(t):
    return t.features.select("row_id", delay.formula_delay().alias("minutes"))


@query("fun_17_delay_explanation", needs=("features",), oracle="""
WITH shifted AS (SELECT *, current_delay - 150 AS cd FROM features),
terms AS (SELECT row_id, u.* FROM shifted, LATERAL (VALUES
  ('current_delay', cd, cd), ('historical_delay_remaining', historical_delay * greatest(0.0::double, 1 - journey_progress), historical_delay),
  ('weather_risk', (100 - weather_score) * 0.32e0, weather_score), ('corridor_congestion', corridor_congestion * 0.28e0, corridor_congestion),
  ('port_pressure', greatest(0.0::double, port_pressure - 50) * 0.18e0, port_pressure), ('schedule_conflicts', schedule_conflicts * 12, schedule_conflicts),
  ('cargo_weight_over_100', greatest(0.0::double, cargo_weight - 100) * 0.08e0, cargo_weight)) u(factor, v, input_value))
SELECT row_id, factor, round(v, 4) AS minutes, CASE WHEN v > 0 THEN 'INCREASE' WHEN v < 0 THEN 'DECREASE' ELSE 'NEUTRAL' END AS direction, input_value FROM terms
UNION ALL
SELECT row_id, 'non_negative_floor', round(-s, 4), 'INCREASE', NULL FROM (SELECT row_id, round(sum(v), 9) AS s FROM terms GROUP BY row_id) q WHERE s < 0""")
def _(t):
    df = t.features.withColumn("current_delay", F.col("current_delay") - 150)
    return df.select("row_id", F.explode(delay.delay_explanation()).alias("e")).select(
        "row_id", "e.factor", "e.minutes", "e.direction", "e.input_value")


@query("fun_19_weather_score", needs=("weather",), oracle="""
SELECT point_id, CASE WHEN visibility IS NOT NULL THEN 100.0e0 - CASE WHEN c1 >= 200 AND c1 < 700 THEN 30 ELSE 0 END
   - CASE WHEN wind_speed_10m > 15 THEN 20 ELSE 0 END - CASE WHEN visibility < 5000 THEN 25 ELSE 0 END END AS score,
  CASE WHEN visibility IS NULL THEN 'WEATHER_UNKNOWN' ELSE concat_ws(',', CASE WHEN c1 >= 200 AND c1 < 700 THEN 'PRECIPITATION' END,
     CASE WHEN wind_speed_10m > 15 THEN 'HIGH_WIND' END, CASE WHEN visibility < 5000 THEN 'REDUCED_VISIBILITY' END) END AS alerts
FROM (SELECT *, weather_code * 9 AS c1 FROM weather) w""")
def _(t):
    v = weather.weather_score(F.array(F.col("weather_code") * 9), F.col("wind_speed_10m"), F.col("visibility"))
    return t.weather.select("point_id", v.alias("v")).select("point_id", "v.score", joined("v.alerts").alias("alerts"))


LABEL_SQL = """CASE WHEN c = 0 THEN 'clear' WHEN c = 1 THEN 'partly_cloudy' WHEN c IN (2, 3) THEN 'cloudy' WHEN c = 45 THEN 'mist' WHEN c = 48 THEN 'fog'
  WHEN c BETWEEN 51 AND 57 THEN 'light_rain' WHEN c BETWEEN 61 AND 62 THEN 'light_rain' WHEN c BETWEEN 63 AND 65 THEN 'heavy_rain' WHEN c IN (66, 67) THEN 'sleet'
  WHEN c BETWEEN 71 AND 77 THEN 'snow' WHEN c BETWEEN 80 AND 82 THEN 'heavy_rain' WHEN c IN (85, 86) THEN 'snow' WHEN c = 95 THEN 'thunderstorm'
  WHEN c BETWEEN 96 AND 99 THEN 'hail' ELSE 'cloudy' END"""

CONDITIONS_SQL = f"""
SELECT point_id, kind, category, reading FROM (SELECT *, weather_code AS c, temperature_2m AS t, relative_humidity_2m AS h, wind_speed_10m AS w, visibility AS v, uv_index AS uv FROM weather) b,
LATERAL (VALUES
 ({LABEL_SQL}, 'weather', cast(cast(round(t) as int) as varchar) || '°C'),
 (CASE WHEN w >= 20 THEN 'high_winds' WHEN w >= 10 THEN 'strong_wind' END, 'weather', cast(cast(round(w) as int) as varchar) || ' km/h'),
 (CASE WHEN t >= 35 THEN 'high_temp' WHEN t <= 5 THEN 'low_temp' END, 'weather', cast(cast(round(t) as int) as varchar) || '°C'),
 (CASE WHEN h >= 85 THEN 'high_humidity' WHEN h <= 30 THEN 'low_humidity' END, 'weather', cast(cast(round(h) as int) as varchar) || '%'),
 (CASE WHEN v > 0 AND v < 2000 THEN 'low_visibility' END, 'weather', printf('%.1f', v / 1000) || ' km'),
 (CASE WHEN uv >= 8 THEN 'high_uv' END, 'weather', 'UV ' || cast(cast(round(uv) as int) as varchar)),
 (CASE WHEN t <= 2 AND c BETWEEN 51 AND 67 THEN 'icing' END, 'weather', NULL),
 (CASE WHEN c >= 95 THEN 'storm_warning' END, 'environmental', NULL),
 (CASE WHEN c >= 63 AND h > 80 THEN 'flood_risk' END, 'environmental', NULL),
 (CASE WHEN v > 0 AND v < 3000 AND w > 8 AND h < 40 THEN 'dust' END, 'weather', NULL)) u(kind, category, reading)
WHERE kind IS NOT NULL"""


def all_conditions(t):
    c = F.col
    arr = weather.conditions(
        c("point_id").cast("string"), c("weather_code"), c("temperature_2m"), c("relative_humidity_2m"),
        c("wind_speed_10m"), c("visibility"), c("uv_index"))
    return t.weather.select("point_id", "lat", "lon", F.explode(arr).alias("c"))


@query("fun_20_weather_conditions", needs=("weather",), oracle=CONDITIONS_SQL)
def _(t):
    return all_conditions(t).select("point_id", F.col("c.type").alias("kind"), "c.category", "c.reading")


@query("fun_21_weather_label", needs=("weather",), oracle=f"""
SELECT point_id, {LABEL_SQL} AS label FROM (SELECT point_id, weather_code AS c FROM weather) w""")
def _(t):
    return t.weather.select("point_id", weather.weather_label(F.col("weather_code")).alias("label"))


@query("fun_22_dust_level", needs=("weather",), oracle="""
SELECT point_id, CASE WHEN p >= 250 THEN 'HAZARD' WHEN p >= 150 THEN 'SEVERE' WHEN p >= 100 THEN 'ADVISORY' ELSE 'SAFE' END AS level,
  round(least(100.0::double, greatest(p, coalesce(visibility / 20, 0)) / 3), 1) AS risk FROM (SELECT *, relative_humidity_2m * 3 AS p FROM weather) w""")
def _(t):
    p = F.col("relative_humidity_2m") * 3
    return t.weather.select("point_id", weather.dust_level(p).alias("level"), weather.dust_index(p, F.col("visibility") / 20).alias("risk"))


@query("fun_23_stopping_distance", needs=("features",), oracle="""
SELECT row_id, round((weather_score / 3.6e0) * 2.5e0 + (weather_score / 3.6e0) * (weather_score / 3.6e0) / ((0.3e0 + journey_progress) * 2) + 50, 2) AS metres FROM features""")
def _(t):
    return t.features.select("row_id", delay.stopping_distance_m(
        F.col("weather_score"), F.lit(2.5), F.lit(0.3) + F.col("journey_progress"), F.lit(50.0)).alias("metres"))


AGE = f"cast(trunc((epoch_us(timestamp '{AT}') - epoch_us(observed_at)) / 1e6) as bigint)"


@query("fun_24_observation_freshness", needs=("evidence_times",), oracle=f"""
SELECT event_id, CASE WHEN observed_at IS NULL THEN 'UNKNOWN' WHEN age <= 900 THEN 'FRESH' WHEN age <= 3600 THEN 'AGING' ELSE 'STALE' END AS label,
  CASE WHEN observed_at IS NOT NULL THEN age END AS age_s FROM (SELECT *, greatest(0, {AGE}) AS age FROM evidence_times) e""")
def _(t):
    o = F.col("observed_at")
    return t.evidence_times.select(
        "event_id", freshness.observation_freshness(asof(), o, 900, 3600).alias("label"),
        F.when(o.isNotNull(), freshness.observation_age(asof(), o)).alias("age_s"))


LIMITS_SQL = """(VALUES ('noaa_swpc', 14400, 21600, 32400), ('railradar', 7200, 10800, 21600), ('aisstream', 300, 600, 1200), ('ixigo_partner', 300, 900, 1800))
 l(k, f, a, s)"""
FRESH_SQL = f"""CASE WHEN source_key = 'operator_input' THEN 'NOT_APPLICABLE' WHEN observed_at IS NULL OR {AGE} < -300 THEN 'UNKNOWN'
  WHEN greatest(0, {AGE}) <= coalesce(f, 900) THEN 'FRESH' WHEN greatest(0, {AGE}) > coalesce(s, 3600) THEN 'STALE' ELSE 'AGING' END"""


@query("fun_25_evidence_freshness", needs=("evidence_times",), oracle=f"""
SELECT event_id, {FRESH_SQL} AS label FROM evidence_times LEFT JOIN {LIMITS_SQL} ON k = source_key WHERE source_key IS NOT NULL""")
def _(t):
    return t.evidence_times.where("source_key is not null").select(
        "event_id", freshness.evidence_freshness(asof(), F.col("source_key"), F.col("observed_at")).alias("label"))


@query("fun_26_effective_freshness", needs=("evidence_times",), oracle=f"""
SELECT event_id, CASE WHEN valid_until < timestamp '{AT}' THEN 'STALE' WHEN source_key IS NULL THEN upper(coalesce(stored, 'UNKNOWN')) ELSE {FRESH_SQL} END AS label
FROM evidence_times LEFT JOIN {LIMITS_SQL} ON k = source_key""")
def _(t):
    c = F.col
    return t.evidence_times.select("event_id", freshness.effective_freshness(
        asof(), c("source_key"), c("observed_at"), c("valid_until"), c("stored")).alias("label"))


@query("fun_27_leg_freshness", needs=("evidence_times",), oracle=f"""
SELECT event_id, CASE WHEN source_type = 'UNAVAILABLE' THEN 'UNAVAILABLE' WHEN source_type IN ('OPERATOR_INPUT', 'IMPORTED_DOCUMENT') THEN 'NOT_APPLICABLE'
  WHEN observed_at IS NULL THEN 'UNAVAILABLE' WHEN a <= 900 THEN 'FRESH' WHEN a <= 3600 THEN 'AGING' ELSE 'STALE' END AS label
FROM (SELECT *, (epoch_us(timestamp '{AT}') - epoch_us(observed_at)) / 1e6 AS a FROM evidence_times) e""")
def _(t):
    return t.evidence_times.select(
        "event_id", freshness.leg_freshness(asof(), F.col("source_type"), F.col("observed_at")).alias("label"))


@query("fun_28_constraint_currency", needs=("evidence_times",), oracle=f"""
SELECT event_id, CASE WHEN source_type = 'REPLAYED_SNAPSHOT' THEN 'EXPIRED' WHEN observed_at > timestamp '{AT}' OR fetched_at > timestamp '{AT}' THEN 'FUTURE'
  WHEN valid_until < timestamp '{AT}' THEN 'EXPIRED' ELSE 'CURRENT' END AS label FROM evidence_times""")
def _(t):
    c = F.col
    return t.evidence_times.select("event_id", freshness.constraint_currency(
        asof(), c("observed_at"), c("fetched_at"), c("valid_until"), c("source_type")).alias("label"))


@query("fun_29_position_freshness", needs=("evidence_times",), oracle=f"""
SELECT event_id, CASE WHEN (epoch_us(timestamp '{AT}') - epoch_us(observed_at)) / 1e6 < -300 THEN 'REJECTED' WHEN greatest(0, {AGE}) <= 120 THEN 'FRESH'
  WHEN greatest(0, {AGE}) <= 900 THEN 'AGING' ELSE 'STALE' END AS label FROM evidence_times WHERE observed_at IS NOT NULL""")
def _(t):
    return t.evidence_times.where("observed_at is not null").select(
        "event_id", freshness.position_freshness(asof(), F.col("observed_at")).alias("label"))


ENVELOPE_SQL = """sha256('{"api_key":"[REDACTED]","days":' || cast(cast(days as decimal(38,6)) as varchar) || ',"entry_at":' || cast(epoch_us(entry_at) as varchar) ||
  ',"source":{"reference":"' || source_reference || '","type":"' || source_type || '"},"tags":[' || '"' || direction || '",null],"window_id":"' || window_id || '"}')"""


@query("fun_30_canonical_digest", needs=("windows",), oracle=f"SELECT window_id, {ENVELOPE_SQL} AS digest FROM windows")
def _(t):
    df = t.windows.select(
        "window_id", "days", "entry_at", F.lit("k1").alias("api_key"),
        F.struct(F.col("source_type").alias("type"), F.col("source_reference").alias("reference")).alias("source"),
        F.array("direction", F.lit(None).cast("string")).alias("tags"))
    return df.select("window_id", digest.digest_of(df, df.columns).alias("digest"))


@query("fun_33_track_detail", needs=("route_legs",), oracle="""
SELECT route_id, seg_id, src_code || ' → ' || dst_code AS label, CASE WHEN seq = 1 THEN 'CURRENT' ELSE 'AHEAD' END AS phase,
  CASE WHEN seq = 1 THEN cast(round((route_id % 100) / 1e2 * 100) as int) END AS progress_pct,
  CASE WHEN blocked THEN 'HARD_BLOCKED' ELSE 'APPROVED' END AS clearance,
  CASE WHEN factor >= 1.5 THEN 'High congestion — expect slow orders' WHEN delay_h >= 1 THEN 'Historically delayed block'
       WHEN blocked THEN 'Clearance violation on this tract' END AS advisory
FROM (SELECT *, cargo_h > max_h OR cargo_w > max_w OR cargo_t > max_t AS blocked FROM route_legs) r""")
def _(t):
    c = F.col
    blocked = track.exceeds((c("cargo_h"), c("cargo_w"), c("cargo_t")), (c("max_h"), c("max_w"), c("max_t")))
    phase = F.when(c("seq") == 1, "CURRENT").otherwise("AHEAD")
    return t.route_legs.select(
        "route_id", "seg_id", track.route_label(c("src_code"), c("dst_code")).alias("label"), phase.alias("phase"),
        track.progress_pct(phase, c("seq") == 1, (c("route_id") % 100) / 100).alias("progress_pct"),
        F.when(blocked, "HARD_BLOCKED").otherwise("APPROVED").alias("clearance"),
        track.advisory(c("factor"), c("delay_h"), blocked).alias("advisory"))


@query("fun_34_forecast_risk", needs=("weather",), oracle="""
SELECT point_id, 10 + CASE WHEN precipitation > 5 THEN 35.0e0 WHEN wind_speed_10m > 25 THEN 25 WHEN round(visibility / 1000, 1) < 3 THEN 30 ELSE 0 END AS risk,
  CASE WHEN precipitation > 5 THEN 'Heavy monsoon rainfall — speed reduction advised' WHEN wind_speed_10m > 25 THEN 'Crosswind advisory on high bridges'
       WHEN round(visibility / 1000, 1) < 3 THEN 'Low visibility — fog/dust alert' END AS advisory,
  CASE WHEN precipitation > 2 THEN 'Rainy' ELSE 'Clear' END AS condition FROM weather""")
def _(t):
    v = weather.forecast_risk(F.col("precipitation"), F.col("wind_speed_10m"), F.col("visibility"))
    return t.weather.select("point_id", v.alias("v")).select("point_id", "v.*")


@query("fun_35_late_train_alerts", needs=("predictions",), oracle="""
SELECT prediction_id, cast(prediction_id as varchar) || ' (T' || cast(route_id as varchar) || ') running ' || cast(cast(floor(predicted_value) as int) as varchar) || 'm late' AS alert
FROM predictions WHERE predicted_value >= 30""")
def _(t):
    return agg.late_trains(
        t.predictions.select(F.col("prediction_id").cast("string").alias("number"), "prediction_id",
                             F.concat(F.lit("T"), "route_id").alias("name"), F.col("predicted_value").alias("delay")),
    ).select("prediction_id", "alert")


@query("fun_39_client_score", needs=("weather",), oracle="""
SELECT route_id, round(0.4e0 * s + 0.3e0 * 0.65e0 + 0.15e0 * 0.8e0 + 0.15e0 * 0.7e0, 6) AS score,
  CASE WHEN round(0.4e0 * s + 0.3e0 * 0.65e0 + 0.15e0 * 0.8e0 + 0.15e0 * 0.7e0, 6) >= 0.65 THEN 'APPROVED' WHEN round(0.4e0 * s + 0.3e0 * 0.65e0 + 0.15e0 * 0.8e0 + 0.15e0 * 0.7e0, 6) >= 0.45 THEN 'CAUTION' ELSE 'HARD_BLOCKED' END AS status
FROM (SELECT route_id, avg(CASE WHEN valid THEN CASE WHEN c BETWEEN 200 AND 299 THEN 0.2e0 WHEN c BETWEEN 500 AND 599 THEN 0.6e0 WHEN c BETWEEN 600 AND 699 THEN 0.5e0 WHEN c = 800 THEN 1.0e0 ELSE 0.7e0 END ELSE 0.7e0 END) AS s
      FROM (SELECT *, weather_code * 10 AS c FROM weather) w GROUP BY route_id) x""")
def _(t):
    s = F.when(F.col("valid"), weather.client_score(F.col("weather_code") * 10))
    per = t.weather.groupBy("route_id").agg(F.avg(F.coalesce(s, F.lit(0.7))).alias("s"))
    return per.select("route_id", weather.client_status(F.col("s")).alias("v")).select("route_id", "v.*")


@query("fun_40_zone_boxes", needs=("weather",), oracle=f"""
WITH c AS ({CONDITIONS_SQL})
SELECT c.point_id, 'zone-' || cast(c.point_id as varchar) || '-' || kind AS zone_id, corner,
  round(CASE WHEN corner < 2 THEN lat + 0.15e0 ELSE lat - 0.15e0 END, 6) AS lat, round(CASE WHEN corner IN (1, 2) THEN lon + 0.2e0 ELSE lon - 0.2e0 END, 6) AS lon
FROM c JOIN weather w ON w.point_id = c.point_id CROSS JOIN range(4) r(corner)""")
def _(t):
    return all_conditions(t).where("c.category <> 'operational'").select(
        "point_id", F.concat(F.lit("zone-"), "c.id").alias("zone_id"),
        F.posexplode(geo.zone_box(F.col("lat"), F.col("lon"))).alias("corner", "p"),
    ).select("point_id", "zone_id", F.col("corner").cast("bigint").alias("corner"),
             F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))
