"""Sources, sinks and streams, fed with texts and files that Spark derives from the supplied tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.operators import aggregates as agg
from ballast.operators import models
from ballast.operators import windows as win
from ballast.operators.ordered import hour_slot
from ballast.plans.registry import query
from ballast.plans.scalars import joined
from ballast.session import run_folder
from ballast.sources import feeds, files, sinks, timetables
from ballast.streaming import observations as so
from ballast.streaming import state

c = F.col


def scratch(t) -> str:
    return f"{run_folder(t.spark)}/{uuid.uuid4().hex}"


# --- timetables ---------------------------------------------------------------------------


def static_members(t, bad_time=None, bad_number=None):
    """Static tables made of the supplied ones; stop times under the conditions are unreadable."""
    bad_time, bad_number = [F.lit(False) if x is None else x for x in (bad_time, bad_number)]
    two = lambda x: F.lpad((x).cast("string"), 2, "0")
    k = c("l_orderkey")
    at = lambda shift: F.concat((c("l_partkey") % 30).cast("string"), F.lit(":"), two((c("l_suppkey") + shift) % 60))
    return {
        "stops": t.supplier.select(c("s_suppkey").alias("stop_id"), F.concat(F.lit(" "), c("s_name"), F.lit(', "halt"')).alias("stop_name"), F.when(c("s_nationkey") % 3 == 0, "").otherwise("c").alias("stop_code")),
        "routes": t.part.select(c("p_partkey").alias("route_id"), c("p_brand").alias("route_short_name"), (c("p_size") % 12).alias("route_type")),
        "trips": t.orders.select(c("o_orderkey").alias("trip_id"), (c("o_orderkey") % 150).alias("route_id"), c("o_custkey").alias("service_id"), F.when(c("o_orderkey") % 5 != 0, c("o_orderkey") % 2).alias("direction_id")),
        "stop_times": t.lineitem.select(k.alias("trip_id"), c("l_suppkey").alias("stop_id"), F.when(bad_number, "x").otherwise(c("l_linenumber").cast("string")).alias("stop_sequence"), F.when(bad_time, "7:5").otherwise(at(F.lit(0))).alias("arrival_time"), F.concat(at(F.lit(1)), F.lit(":30")).alias("departure_time")),
        "calendar": t.customer.select(c("c_custkey").alias("service_id"), F.lit("1").alias("monday")),
    }


def landed_static(t, members=None):
    folder = scratch(t)
    members = members or static_members(t)
    for name, df in members.items():
        df.write.option("header", True).option("escape", '"').csv(f"{folder}/{name}.txt")
    return timetables.read_static(t.spark, folder, list(members))


TIME_SQL = "(l_partkey % 30) * 3600 + ((l_suppkey + {}) % 60) * 60 + {}"


@query("src_01_static_timetable", oracle=f"""
SELECT cast(l_orderkey as varchar) AS trip_id, cast(l_suppkey as varchar) AS stop_id, l_linenumber AS stop_sequence, {TIME_SQL.format(0, 0)} AS arrival_s, {TIME_SQL.format(1, 30)} AS departure_s, s_name || ', "halt"' AS stop_name,
  CASE WHEN s_nationkey % 3 <> 0 THEN 'c' END AS stop_code, CASE WHEN l_orderkey % 5 <> 0 THEN cast(l_orderkey % 2 as int) END AS direction_id FROM lineitem JOIN supplier ON s_suppkey = l_suppkey""")
def _(t):
    f = timetables.typed_static(landed_static(t))
    trips = f["trips"].select("trip_id", "direction_id")
    return f["stop_times"].join(f["stops"], "stop_id").join(trips, "trip_id").select(
        "trip_id", "stop_id", "stop_sequence", "arrival_s", "departure_s", "stop_name", "stop_code", "direction_id")


def faulty_members(t):
    """Static tables with blank, repeated and unknown ids, unreadable times and integers."""
    m = static_members(t)
    k, o, text = c("stop_id"), c("trip_id"), lambda x: x.cast("string")
    return {
        **m, "stops": m["stops"].withColumn("stop_id", F.when(k % 17 == 3, "").when(k % 19 == 4, text(k - 1)).otherwise(text(k))),
        "trips": m["trips"].withColumns({"route_id": F.when(o % 23 == 5, "none").otherwise(text(c("route_id"))), "direction_id": F.when(o % 37 == 1, "-1").otherwise(text(c("direction_id")))}),
        "stop_times": static_members(t, c("l_partkey") % 29 == 6, c("l_partkey") % 31 == 7)["stop_times"],
    }


@query("src_01_violations", oracle=f"""
WITH st AS (SELECT CASE WHEN s_suppkey % 17 = 3 THEN NULL WHEN s_suppkey % 19 = 4 THEN s_suppkey - 1 ELSE s_suppkey END AS id FROM supplier),
tr AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 23 = 5 THEN 'none' ELSE cast(o_orderkey % 150 as varchar) END AS route FROM orders),
tm AS (SELECT l_orderkey AS trip, l_suppkey AS stop, CASE WHEN l_partkey % 31 <> 7 THEN l_linenumber END AS seq, CASE WHEN l_partkey % 29 <> 6 THEN {TIME_SQL.format(0, 0)} END AS a, {TIME_SQL.format(1, 30)} AS d FROM lineitem),
tk AS (SELECT *, trip || '|' || coalesce(cast(seq as varchar), 'x') AS key FROM tm), p AS (SELECT trip, seq, count(*) AS n, min(a) AS a, max(d) AS d FROM tm WHERE seq IS NOT NULL AND a IS NOT NULL GROUP BY trip, seq),
f AS (SELECT 'stops' AS member, '' AS key, 'stop_id' AS field, 'MISSING_FIELD' AS code FROM st WHERE id IS NULL
UNION ALL SELECT 'stops', cast(id as varchar), 'stop_id', 'DUPLICATE_ID' FROM st WHERE id IN (SELECT id FROM st WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'routes', cast(p_partkey as varchar), 'route_id', 'DUPLICATE_ID' FROM part WHERE p_partkey IN (SELECT p_partkey FROM part GROUP BY p_partkey HAVING count(*) > 1)
UNION ALL SELECT 'trips', cast(id as varchar), 'trip_id', 'DUPLICATE_ID' FROM tr WHERE id IN (SELECT id FROM tr GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'trips', cast(id as varchar), 'direction_id', 'BAD_VALUE' FROM tr WHERE id % 37 = 1
UNION ALL SELECT 'trips', route, 'route_id', 'BAD_REFERENCE' FROM tr WHERE route NOT IN (SELECT cast(p_partkey as varchar) FROM part)
UNION ALL SELECT 'stop_times', cast(trip as varchar), 'trip_id', 'BAD_REFERENCE' FROM tm WHERE trip NOT IN (SELECT id FROM tr)
UNION ALL SELECT 'stop_times', cast(stop as varchar), 'stop_id', 'BAD_REFERENCE' FROM tm WHERE stop NOT IN (SELECT id FROM st WHERE id IS NOT NULL)
UNION ALL SELECT 'stop_times', key, 'stop_sequence', 'BAD_VALUE' FROM tk WHERE seq IS NULL UNION ALL SELECT 'stop_times', key, 'arrival_time', 'BAD_TIME' FROM tk WHERE a IS NULL
UNION ALL SELECT 'stop_times', key, 'departure_time', 'BAD_TIME' FROM tk WHERE d < a
UNION ALL SELECT 'stop_times', key, 'stop_sequence', 'BAD_ORDER' FROM tk JOIN p ON p.trip = tk.trip AND p.seq = tk.seq WHERE tk.a IS NOT NULL AND n > 1
UNION ALL SELECT 'stop_times', trip || '|' || seq, 'arrival_time', 'BAD_ORDER' FROM (SELECT *, lag(d) OVER (PARTITION BY trip ORDER BY seq) AS before FROM p) w WHERE a < before)
SELECT member, key, field, code, count(*) AS n FROM f GROUP BY member, key, field, code""")
def _(t):
    return timetables.static_violations(landed_static(t, faulty_members(t)))


@query("src_13_member_counts", oracle="""
SELECT 'stops' AS member, count(*) AS rows, true AS ok FROM supplier UNION ALL SELECT 'routes', count(*), true FROM part UNION ALL SELECT 'trips', count(*), true FROM orders
UNION ALL SELECT 'stop_times', count(*), true FROM lineitem UNION ALL SELECT 'calendar', count(*), true FROM customer""")
def _(t):
    return timetables.member_counts(landed_static(t))


def landed_lines(t):
    """A CSV with short, blank and over-wide lines."""
    k = c("o_orderkey")
    line = F.concat(k.cast("string"), F.when(k % 9 == 4, "").otherwise(F.concat(F.lit(",  "), c("o_orderpriority"), F.lit(" "))), F.when(k % 50 == 7, F.when(k % 9 == 4, ",,x,y").otherwise(",x")).otherwise(""))
    # whole lines as the only column, whose name is the header line of every file
    text = t.orders.select(F.when(k % 11 == 3, " , ").otherwise(line).alias(" a ,b"))
    path = scratch(t)
    text.write.options(header=True, sep="\u0001", quote="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


@query("src_02_strict_csv", oracle="""
SELECT a, b, n_bad FROM (SELECT cast(o_orderkey as varchar) AS a, CASE WHEN o_orderkey % 9 <> 4 THEN trim(o_orderpriority) END AS b FROM orders WHERE o_orderkey % 11 <> 3 AND o_orderkey % 50 <> 7) x, (SELECT count(*) FILTER (o_orderkey % 50 = 7 AND o_orderkey % 11 <> 3) AS n_bad FROM orders) y""")
def _(t):
    path = landed_lines(t)
    rows, bad = timetables.strict_csv(t.spark, path)
    n = bad.groupBy().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_bad"))
    return rows.select("a", "b").crossJoin(F.broadcast(n))


@query("src_02_refused_rows", oracle="""
SELECT cast(o_orderkey as varchar) AS key, 'BAD_ROW' AS code, CASE WHEN o_orderkey % 9 = 4 THEN 4 ELSE 3 END AS fields FROM orders WHERE o_orderkey % 50 = 7 AND o_orderkey % 11 <> 3""")
def _(t):
    return timetables.refused_rows(t.spark, landed_lines(t)).select("key", "code", "fields")


def realtime_docs(t):
    """One document per event, with a trip update, a vehicle or an alert."""
    e = t.obs.select("*", (c("event_id") % 3).alias("z"))
    stop = F.struct(c("k").cast("string").alias("stop_id"), c("k").alias("stop_sequence"), F.struct((1_700_000_000 + c("event_id")).alias("time"), c("k").alias("delay")).alias("arrival"))
    trip = F.struct(F.struct(F.when(c("k") % 11 == 0, " ").otherwise(c("user_id").cast("string")).alias("trip_id"), F.lit("r1").alias("route_id")).alias("trip"), F.array(stop).alias("stop_time_update"))
    veh = F.struct(F.struct(c("user_id").cast("string").alias("id")).alias("vehicle"), F.struct(c("lat").alias("latitude"), c("lon").alias("longitude"), (c("value") - 1).alias("speed")).alias("position"), (1_700_000_000 + c("event_id")).alias("timestamp"))
    alert = F.struct(c("event_type").alias("effect"), F.struct(F.array(F.struct(F.concat(c("event_type"), F.repeat(F.lit("x"), 2100)).alias("text"))).alias("translation")).alias("header_text"))
    ent = F.struct(F.when(c("k") % 23 == 0, "").otherwise(c("event_id").cast("string")).alias("id"), F.when(c("z") == 0, trip).alias("trip_update"), F.when(c("z") == 1, veh).alias("vehicle"), F.when(c("z") == 2, alert).alias("alert"))
    doc = F.struct(F.struct(F.when(c("k") % 29 != 0, "2.0").alias("gtfs_realtime_version"), F.lit(1_700_000_000).alias("timestamp")).alias("header"), F.array(ent).alias("entity"))
    return e.select(c("event_id").alias("doc_id"), F.to_json(doc).alias("text"))


@query("src_03_realtime_feed", needs=("obs",), oracle="""
SELECT event_id AS doc_id, 'trip' AS kind, CASE WHEN k % 11 <> 0 THEN cast(user_id as varchar) END AS ref, 1700000000 + event_id AS at_s FROM obs WHERE event_id % 3 = 0
UNION ALL SELECT event_id, 'vehicle', cast(user_id as varchar), 1700000000 + event_id FROM obs WHERE event_id % 3 = 1
UNION ALL SELECT event_id, 'alert', event_type || repeat('x', 2100), NULL FROM obs WHERE event_id % 3 = 2
UNION ALL SELECT event_id, 'NO_VERSION', NULL, NULL FROM obs WHERE k % 29 = 0 UNION ALL SELECT event_id, 'NO_ENTITY_ID', NULL, NULL FROM obs WHERE k % 23 = 0
UNION ALL SELECT event_id, 'NO_TRIP_ID', NULL, NULL FROM obs WHERE event_id % 3 = 0 AND k % 11 = 0 UNION ALL SELECT event_id, 'POSITION_RANGE', NULL, NULL FROM obs WHERE event_id % 3 = 1 AND coalesce(lat NOT BETWEEN -90 AND 90 OR lon NOT BETWEEN -180 AND 180, lat NOT BETWEEN -90 AND 90, lon NOT BETWEEN -180 AND 180)
UNION ALL SELECT event_id, 'SPEED_RANGE', NULL, NULL FROM obs WHERE event_id % 3 = 1 AND value < 1""")
def _(t):
    f = timetables.realtime_tables(realtime_docs(t))
    none = F.lit(None).cast("bigint").alias("at_s")
    return (
        f["trip_updates"].select("doc_id", F.lit("trip").alias("kind"), c("trip_id").alias("ref"), c("stop_time_updates")[0]["arrival"]["at"].cast("bigint").alias("at_s"))
        .unionByName(f["vehicle_positions"].select("doc_id", F.lit("vehicle").alias("kind"), c("vehicle_id").alias("ref"), c("observed_at").cast("bigint").alias("at_s")))
        .unionByName(f["alerts"].select("doc_id", F.lit("alert").alias("kind"), c("header_text").alias("ref"), none))
        .unionByName(f["violations"].select("doc_id", c("code").alias("kind"), F.lit(None).cast("string").alias("ref"), none)))


def open_docs(t):
    k = c("schedule_id")
    pairs = lambda *xs: F.map_from_entries(F.array_compact(F.array(*xs)))
    kv = lambda key, v, when=None: (F.struct(F.lit(key).alias("key"), v.cast("string").alias("value")) if when is None else F.when(when, F.struct(F.lit(key).alias("key"), v.cast("string").alias("value"))))
    rec = pairs(
        kv("Train No", c("train_code"), k % 2 == 0), kv("train_number", c("train_code"), k % 2 == 1), kv("Name", F.concat(F.lit("Exp "), k)), kv("from-code", F.lit("AAA")),
        kv("to_station_code", c("dest_code"), k % 7 != 0), kv("departure", F.date_format("departs_at", "HH:mm")), kv("arr_time", F.date_format("arrives_at", "yyyy-MM-dd'T'HH:mm:ssXXX")), kv("api_key", F.lit("zzz")))
    j = F.to_json(F.array(rec))
    text = F.when(k % 3 == 0, j).when(k % 3 == 1, F.concat(F.lit('{"records":[],"data":'), j, F.lit("}"))).otherwise(F.concat(F.lit('{"results":'), j, F.lit("}")))
    return t.schedules.select(k.alias("doc_id"), text.alias("text"))


@query("src_04_open_data_timetable", needs=("schedules",), oracle="""
SELECT schedule_id AS doc_id, NULL AS code, train_code, dest_code AS dest_station_code, strftime(departs_at, '%H:%M:00') AS scheduled_departure, strftime(arrives_at, '%H:%M:%S') AS scheduled_arrival, strftime(arrives_at, '%Y-%m-%d') AS service_date, NULL AS missing FROM schedules WHERE schedule_id % 7 <> 0
UNION ALL SELECT schedule_id, 'MISSING_FIELD', NULL, NULL, NULL, NULL, NULL, 'dest_station_code' FROM schedules WHERE schedule_id % 7 = 0""")
def _(t):
    good, bad = timetables.open_data_timetable(timetables.open_data_records(open_docs(t)), ["doc_id", "record_no"])
    return good.unionByName(bad, allowMissingColumns=True).select(
        "doc_id", "code", "train_code", "dest_station_code", "scheduled_departure", "scheduled_arrival", "service_date", "missing")


# --- provider messages ------------------------------------------------------------------------


def vessel_messages(t):
    k = c("position_id")
    far = k % 31 == 0
    report = F.struct(F.when(k % 6 != 0, c("shipment_id")).alias("UserID"), F.when(far, 91.0).otherwise(c("lat")).alias("Latitude"), F.when(k % 10 != 0, c("lon")).alias("Longitude"),
                      F.when(k % 4 != 0, c("nav_status")).alias("NavigationalStatus"), c("speed").alias("Sog"))
    meta = F.struct((c("shipment_id") + 1000).alias("MMSI"), F.concat(F.lit(" SHIP "), c("shipment_id"), F.lit("@@@ ")).alias("ShipName"), c("lat").alias("latitude"), (c("lon") + 1).alias("longitude"))
    doc = F.struct(F.when(k % 17 == 0, "StaticData").otherwise("PositionReport").alias("MessageType"), F.struct(report.alias("PositionReport")).alias("Message"), meta.alias("MetaData"))
    return t.positions.select(k.alias("message_id"), "observed_at", F.to_json(doc).alias("text"))


@query("src_05_vessel_positions", needs=("positions",), oracle="""
SELECT position_id AS message_id, CASE WHEN position_id % 6 = 0 OR shipment_id = 0 THEN shipment_id + 1000 ELSE shipment_id END AS vessel_id, 'SHIP ' || cast(shipment_id as varchar) AS name, lat, CASE WHEN position_id % 10 = 0 THEN lon + 1 ELSE lon END AS lon,
  CASE WHEN position_id % 4 = 0 THEN 15 ELSE nav_status END AS nav_status, speed AS sog FROM positions WHERE position_id % 17 <> 0 AND position_id % 31 <> 0""")
def _(t):
    return feeds.vessel_positions(vessel_messages(t)).drop("observed_at")


def board_docs(t):
    z = c("k") % 9
    train = lambda kind, d: F.struct(F.struct(F.lit("1").alias("number")).alias("train"), F.struct(F.lit(kind).alias("type"), d.cast("int").alias("delayMinutes")).alias("live"))
    full = F.struct(F.lit(True).alias("success"), F.struct(F.array(train("at-station", c("k")), train("running", F.when(c("k") % 5 != 0, c("user_id")))).alias("trains")).alias("data"))
    text = F.when(z == 0, '{"success":false,"error":{"message":"limit"}}').when(z == 1, '{"success":true,"data":{"count":3}}').when(z == 2, '{"success":true,"data":{"trains":[]}}').otherwise(F.to_json(full))
    return t.obs.select("event_id", text.alias("text"))


@query("src_06_board_trains", needs=("obs",), oracle="""
SELECT event_id, '1' AS number, 'at-station' AS live_type, cast(k as int) AS delay FROM obs WHERE k % 9 > 2
UNION ALL SELECT event_id, '1', 'running', CASE WHEN k % 5 <> 0 THEN cast(user_id as int) END FROM obs WHERE k % 9 > 2""")
def _(t):
    return feeds.board_trains(board_docs(t), ["event_id"])


@query("snk_03_retained_latest", needs=("obs",), oracle="""
SELECT provider_key, entity_id, event_id AS observation_id FROM (SELECT *, row_number() OVER (PARTITION BY provider_key, entity_id ORDER BY fetched_at DESC, event_id DESC) AS n
 FROM (SELECT event_type AS provider_key, cast(user_id as varchar) AS entity_id, fetched_at, event_id FROM obs WHERE valid) o) x WHERE n = 1 AND fetched_at >= timestamp '2024-01-30 00:00:00' - INTERVAL 10 DAY""")
def _(t):
    rows = t.obs.select(c("event_type").alias("provider_key"), F.lit("state").alias("observation_type"), c("user_id").cast("string").alias("entity_id"), "fetched_at", c("event_id").alias("observation_id"), "valid")
    return sinks.latest_valid(rows, F.lit("2024-01-30 00:00:00").cast("timestamp"), 10 * 86400).select("provider_key", "entity_id", "observation_id")


@query("src_06_station_boards", needs=("obs",), oracle="""
SELECT event_id, CASE WHEN k % 9 = 0 OR k % 9 = 1 THEN 'UNAVAILABLE' ELSE 'LIVE' END AS source, CASE WHEN k % 9 > 2 THEN 2 ELSE 0 END AS trains, CASE WHEN k % 9 > 2 THEN round((k + CASE WHEN k % 5 = 0 THEN 0 ELSE user_id END) / CASE WHEN k % 5 = 0 THEN 1.0e0 ELSE 2.0e0 END, 1) ELSE 0 END AS mean_delay,
  CASE WHEN k % 9 > 2 THEN CASE WHEN k % 5 = 0 THEN k ELSE greatest(k, user_id) END ELSE 0 END AS max_delay, CASE WHEN k % 9 > 2 THEN 1 ELSE 0 END AS at_station,
  CASE k % 9 WHEN 0 THEN 'limit' WHEN 1 THEN 'Malformed response: no train list' WHEN 2 THEN 'No trains in window' END AS detail FROM obs""")
def _(t):
    return feeds.station_boards(board_docs(t), ["event_id"])


@query("src_07_authorized_corridors", needs=("obs",), oracle="""
SELECT event_id, NULL AS code, k * 1.0e0 AS score, station_code, epoch_us(date_trunc('second', seen)) - 19800000000 AS at_us FROM obs, LATERAL (VALUES ('NGP'), ('S' || cast(k as varchar))) s(station_code) WHERE event_id % 7 NOT IN (0, 1, 2, 3)
UNION ALL SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'NO_SCORE' WHEN 1 THEN 'SCORE_RANGE' WHEN 2 THEN 'NO_TIME' ELSE 'BAD_TIME' END, NULL, NULL, NULL FROM obs WHERE event_id % 7 IN (0, 1, 2, 3)""")
def _(t):
    z = c("event_id") % 7
    at = F.date_format("seen", "yyyy-MM-dd'T'HH:mm:ss")
    doc = F.struct(F.when(z == 1, 140.5).when(z != 0, c("k") * 1.0).alias("congestion_score"), F.when(z == 2, "").when(z == 3, at).otherwise(F.concat(at, F.lit("+05:30"))).alias("observed_at"))
    d = t.obs.select("event_id", F.array(F.lit("NGP"), F.concat(F.lit("S"), "k")).alias("stations"), F.to_json(doc).alias("text"))
    good, bad = feeds.authorized_corridors(d, ["event_id"], "stations")
    return good.select("event_id", F.lit(None).cast("string").alias("code"), "score", "station_code", F.unix_micros("observed_at").alias("at_us")).unionByName(
        bad.select("event_id", "code", F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("station_code"), F.lit(None).cast("bigint").alias("at_us")))


def weather_docs(t):
    k = c("point_id")
    cur = F.struct(
        F.when(k % 13 != 0, F.date_format("seen", "yyyy-MM-dd'T'HH:mm")).alias("time"), F.when(k % 11 != 0, c("temperature_2m")).alias("temperature_2m"), "relative_humidity_2m", "precipitation",
        (c("precipitation") * 1.5).alias("rain"), "weather_code", "wind_speed_10m", (c("wind_speed_10m") * 2).alias("wind_gusts_10m"), "visibility")
    return t.weather.select("point_id", F.to_json(F.struct(cur.alias("current"))).alias("text"))


@query("src_08_weather_observations", needs=("weather",), oracle="""
SELECT point_id, temperature_2m, weather_code, wind_speed_10m, visibility, epoch_us(date_trunc('minute', seen)) AS at_us FROM weather WHERE point_id % 13 <> 0 AND point_id % 11 <> 0""")
def _(t):
    w = feeds.weather_observations(weather_docs(t), ["point_id"])
    return w.select("point_id", "temperature_2m", "weather_code", "wind_speed_10m", "visibility", F.unix_micros("observed_at").alias("at_us"))


@query("src_09_kp_latest", needs=("obs",), oracle="""
SELECT event_id, epoch_us(date_trunc('second', seen)) AS at_us, cast(floor(k / 9.0e0) as int) AS kp_index, CASE WHEN floor(k / 9.0e0) >= 7 THEN 'WARNING' ELSE 'NONE' END AS alert_level FROM obs WHERE k / 9.0e0 <= 9 AND event_id % 5 <> 4""")
def _(t):
    at, kp = F.date_format("seen", "yyyy-MM-dd HH:mm:ss"), (c("k") / 9.0).cast("string")
    obj = F.to_json(F.array(F.struct(F.lit("2020-01-01 00:00:00").alias("time_tag"), F.lit("1").alias("Kp")), F.struct(at.alias("time_tag"), kp.alias("Kp"))))
    lst = F.to_json(F.array(F.array(F.lit("time_tag"), F.lit("Kp")), F.array(at, kp)))
    text = F.when(c("event_id") % 5 == 4, "[]").when(c("event_id") % 2 == 0, obj).otherwise(lst)
    k = feeds.kp_latest(t.obs.select("event_id", text.alias("text")), ["event_id"])
    return k.select("event_id", F.unix_micros("observed_at").alias("at_us"), "kp_index", "alert_level")


@query("src_15_route_weather", needs=("weather",), oracle="""
SELECT point_id, visibility IS NOT NULL AND point_id % 11 <> 0 AS available, CASE WHEN visibility IS NOT NULL AND point_id % 11 <> 0 THEN temperature_2m END AS temperature_2m, CASE WHEN visibility IS NOT NULL AND point_id % 11 <> 0 THEN uv_index END AS uv_index FROM weather""")
def _(t):
    cur = F.struct(F.when(c("point_id") % 11 != 0, c("temperature_2m")).alias("temperature_2m"), (c("temperature_2m") - 1).alias("apparent_temperature"), "relative_humidity_2m", "weather_code", "wind_speed_10m",
                   F.lit(90).alias("wind_direction_10m"), "visibility", "uv_index", "precipitation")
    return feeds.route_weather(t.weather.select("point_id", F.to_json(F.struct(cur.alias("current"))).alias("text")), ["point_id"]).select("point_id", "available", "temperature_2m", "uv_index")


@query("src_14_passenger_status", needs=("obs",), oracle="""
SELECT event_id, CASE WHEN event_id % 8 = 0 THEN 'NO_TIME' WHEN value * 60 > 10000 THEN 'DELAY_RANGE' WHEN lat NOT BETWEEN -90 AND 90 THEN 'LATITUDE_RANGE' WHEN lon NOT BETWEEN -180 AND 180 THEN 'LONGITUDE_RANGE' END AS code,
  CASE WHEN NOT bad THEN repeat(event_type, 30) END AS running_status, CASE WHEN NOT bad THEN round(value * 60, 6) END AS delay_minutes
FROM (SELECT *, event_id % 8 = 0 OR value * 60 > 10000 OR coalesce(lat NOT BETWEEN -90 AND 90, false) OR coalesce(lon NOT BETWEEN -180 AND 180, false) AS bad FROM obs) o""")
def _(t):
    k = c("event_id")
    at = F.date_format("seen", "yyyy-MM-dd'T'HH:mm:ssXXX")
    d = F.struct(F.when(k % 4 == 1, at).alias("observed_at"), F.when(k % 8 != 0, at).alias("last_updated"), F.when(k % 2 == 0, c("value") * 60).alias("delay_minutes"), F.when(k % 2 == 1, c("value") * 60).alias("delay"),
                 c("lat"), c("lon").alias("longitude"), F.repeat("event_type", F.lit(30)).alias("status"), F.lit("secret").alias("token"))
    text = F.when(k % 3 == 0, F.to_json(d)).otherwise(F.to_json(F.struct(d.alias("data"))))
    good, bad = feeds.passenger_status(t.obs.select("event_id", text.alias("text")), ["event_id"])
    return good.select("event_id", F.lit(None).cast("string").alias("code"), "running_status", F.round("delay_minutes", 6).alias("delay_minutes")).unionByName(bad, allowMissingColumns=True)


# --- recorded files, ways, limits ------------------------------------------------------------------


@query("src_10_snapshot_check", oracle="""
SELECT page_id, 'page' AS source_key, CASE WHEN page_id % 13 = 0 THEN '../x' ELSE 'p' || cast(page_id as varchar) END AS local_filename, page_id % 13 <> 0 AND page_id % 7 <> 0 AND page_id % 5 <> 0 AS checksum_valid,
  concat_ws(',', CASE WHEN page_id % 13 = 0 THEN 'UNSAFE_NAME' END, CASE WHEN page_id % 11 = 0 THEN 'AUTHORITY_CLAIMED' END) AS codes FROM pages""")
def _(t):
    k = c("page_id")
    body = F.encode("html", "UTF-8")
    feed = F.struct(F.lit("page").alias("source_key"), F.when(k % 13 == 0, "../x").otherwise(F.concat(F.lit("p"), k)).alias("local_filename"), (F.length(body) + F.when(k % 7 == 0, 1).otherwise(0)).alias("byte_length"), F.sha2(body, 256).alias("sha256"))
    m = t.pages.select("page_id", F.when(k % 11 == 0, "SIGNALLING").otherwise("NONE").alias("operational_authority"), F.array(feed).alias("feeds"))
    f = t.pages.where("page_id % 5 <> 0").select("page_id", F.concat(F.lit("p"), k).alias("local_filename"), F.length(body).alias("actual_length"), F.sha2(body, 256).alias("actual_digest"))
    return files.snapshot_check(m, f, ["page_id"])


@query("src_11_way_tracks", oracle="""
WITH s AS (SELECT l_orderkey AS way_id, l_suppkey AS node_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) - 1 AS pos FROM lineitem),
p AS (SELECT way_id, pos, node_id / 4.0e0 AS lat, node_id / 2.0e0 AS lon FROM s WHERE node_id % 6 <> 5)
SELECT way_id, pos, lat, lon FROM p WHERE way_id IN (SELECT way_id FROM p GROUP BY way_id HAVING count(*) >= 2)""")
def _(t):
    none = lambda kind: F.lit(None).cast(kind)
    nodes = t.supplier.where("s_suppkey % 6 <> 5").select(F.lit("node").alias("type"), c("s_suppkey").alias("id"), (c("s_suppkey") / 4.0).alias("lat"), (c("s_suppkey") / 2.0).alias("lon"), none("array<bigint>").alias("nodes"))
    # a way's own node list, at most a few dozen long
    seq = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey"))), lambda x: x["l_suppkey"])
    ways = t.lineitem.groupBy("l_orderkey").agg(seq.alias("nodes")).select(F.lit("way").alias("type"), c("l_orderkey").alias("id"), none("double").alias("lat"), none("double").alias("lon"), "nodes")
    return files.way_tracks(nodes.unionByName(ways))


def limit_rows(t, faulty=True):
    k = c("seg_id")
    fault = lambda n, bad, good: F.when(F.lit(faulty) & (k % n == 0), bad).otherwise(good)
    return t.segments.where("seg_id % 5 <> 0").select(
        F.lower("src_code").alias("source_code"), fault(7, "ZZZ", F.concat(F.lit(" "), "dst_code")).alias("destination_code"), (c("max_h") + 1).cast("string").alias("max_height"), fault(9, "0", "4.5").alias("max_width"),
        F.lit("150").alias("max_weight"), fault(17, "much", "1.25").alias("congestion_factor"), F.lit("0.5").alias("historical_delay_hours"), fault(11, "[[1,2]]", "[[1.123456789,2],[3,4]]").alias("geometry_lon_lat"),
        F.lit("imported_document").alias("source_type"), F.lit("doc 7").alias("source_reference"), fault(8, " ", "Issuer A").alias("certified_by"),
        fault(13, "2031-01-01T00:00:00Z", "2024-01-01T00:00:00Z").alias("certified_at"))


def loaded(t, rows):
    out, bad = files.load_engineering(t.segments, rows, F.lit("2025-06-01T00:00:00Z").cast("timestamp"), ["issuer a ", "issuer b"])
    a = out.select(F.lit("segment").alias("kind"), F.concat_ws("->", "src_code", "dst_code").alias("segment"), "max_h", "max_w", "factor", c("engineering_digest").isNotNull().alias("sealed"))
    return a.unionByName(bad.select(c("code").alias("kind"), "segment"), allowMissingColumns=True)


@query("src_12_engineering_limits", needs=("segments",), oracle="""
WITH l AS (SELECT *, src_code || '->' || CASE WHEN seg_id % 7 = 0 THEN 'ZZZ' ELSE dst_code END AS k FROM segments WHERE seg_id % 5 <> 0)
SELECT 'segment' AS kind, src_code || '->' || dst_code AS segment, max_h, max_w, factor, false AS sealed FROM segments
UNION ALL SELECT DISTINCT 'UNKNOWN_SEGMENT', k, NULL, NULL, NULL, NULL FROM l WHERE seg_id % 7 = 0
UNION ALL SELECT 'DUPLICATE_SEGMENT', k, NULL, NULL, NULL, NULL FROM l GROUP BY k HAVING count(*) > 1
UNION ALL SELECT code, k, NULL, NULL, NULL, NULL FROM l, LATERAL (VALUES ('TOO_FEW_POINTS', seg_id % 11 = 0), ('LIMIT_NOT_POSITIVE', seg_id % 9 = 0), ('NUMBER_INVALID', seg_id % 17 = 0),
  ('CERTIFICATION_MISSING', seg_id % 8 = 0), ('ISSUER_NOT_ALLOWED', seg_id % 8 = 0), ('CERTIFIED_IN_FUTURE', seg_id % 13 = 0)) u(code, hit) WHERE hit""")
def _(t):
    """A load with faults: the segments stay as they were, and every fault is a row."""
    return loaded(t, limit_rows(t))


@query("src_12_engineering_load", needs=("segments",), oracle="""
WITH l AS (SELECT *, seg_id % 5 <> 0 AS ok FROM segments)
SELECT 'segment' AS kind, src_code || '->' || dst_code AS segment, CASE WHEN ok THEN max_h + 1 ELSE max_h END AS max_h, CASE WHEN ok THEN 4.5e0 ELSE max_w END AS max_w, CASE WHEN ok THEN 1.25e0 ELSE factor END AS factor, ok AS sealed FROM l""")
def _(t):
    """A load without faults is applied."""
    return loaded(t, limit_rows(t, faulty=False))


# --- sinks --------------------------------------------------------------------------------------------


@query("snk_01_labeled_dataset", needs=("features",), oracle="SELECT row_id, data_class, round(remaining_delay_minutes, 6) AS target, 1 AS new_versions FROM features")
def _(t):
    from ballast.operators.statistics import dataset_report

    folder = scratch(t)
    known = t.spark.createDataFrame([("v0",)], "dataset_version string")
    reg = sinks.publish_dataset(t.features, dataset_report(t.features), "v1", folder, known)
    n = reg.groupBy().agg(F.count("*").cast("int").alias("new_versions"))
    back = t.spark.read.option("header", True).csv(f"{folder}/v1/rows")
    return back.select(c("row_id").cast("bigint").alias("row_id"), "data_class", F.round(c("remaining_delay_minutes").cast("double"), 6).alias("target")).crossJoin(F.broadcast(n))


@query("snk_02_write_once", needs=("outcomes",), oracle="SELECT case_id, fault_type, true AS second_write_refused FROM outcomes")
def _(t):
    from pyspark.errors import AnalysisException

    path = scratch(t)
    rows = t.outcomes.select("case_id", "fault_type")
    sinks.write_once(rows, path)
    try:
        sinks.write_once(rows, path)
        refused = False
    except AnalysisException:
        refused = True
    back = t.spark.read.schema("case_id bigint, fault_type string").option("header", True).csv(path)
    return back.withColumn("second_write_refused", F.lit(refused))


def observation_rows(df):
    return df.select(c("event_id").alias("observation_id"), "provider_key", c("event_type").alias("observation_type"), (c("user_id") % 50).cast("string").alias("entity_id"), "observed_at", "fetched_at", "status", "valid", "lat", "lon",
                     c("value").alias("rain"), (c("value") * 100).alias("visibility"), (c("value") * 3).alias("wind_gusts_10m"), "k")


@query("snk_03_latest_values", needs=("obs",), oracle="""
SELECT provider_key, event_type AS observation_type, cast(user_id % 50 as varchar) AS entity_id, arg_max(event_id, (fetched_at, event_id)) AS observation_id FROM obs WHERE valid GROUP BY 1, 2, 3""")
def _(t):
    state.keyed_states(t.spark)
    path = scratch(t)
    observation_rows(t.obs).where("valid").repartition(2, "observation_id").write.parquet(f"{path}/in")
    rows = so.file_stream(t.spark, f"{path}/in", maxFilesPerTrigger="1")
    state.keep_states(state.newest_states(rows, ["provider_key", "observation_type", "entity_id"], "fetched_at", "observation_id"), f"{path}/checkpoint")
    return state.newest_stored(t.spark, f"{path}/checkpoint", rows.schema).select("provider_key", "observation_type", "entity_id", "observation_id")


@query("snk_04_preview_tables", oracle="""
SELECT 'Stops' AS "table", s_suppkey || '|' || s_name AS cells FROM (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 10) a UNION ALL SELECT 'Trips', o_orderkey || '|' || o_custkey FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 10) b""")
def _(t):
    p = sinks.preview({"Stops": (t.supplier, ["s_suppkey", "s_name"], ["s_suppkey"]), "Trips": (t.orders, ["o_orderkey", "o_custkey"], ["o_orderkey"]), "Empty": (t.part.where("false"), ["p_name"], ["p_name"])})
    return p.select("table", F.array_join("cells", "|").alias("cells"))


PURGE_AT = "2024-01-31 00:00:00"


def kept_and_deleted(name, kind, column, days):
    limit = f"timestamp '{PURGE_AT}' - INTERVAL {days} DAY"
    return f"SELECT '{name}' AS \"table\", count(*) FILTER ({column} < {limit}) AS deleted, count(*) FILTER ({column} >= {limit}) AS kept, count(DISTINCT {column}::date) FILTER ({column} >= {limit}) AS days FROM {kind}"


@query("snk_05_retention", needs=("positions", "obs"), oracle=" UNION ALL ".join((
    kept_and_deleted("positions", "positions", "observed_at", 14), kept_and_deleted("observations", "obs", "seen", 30),
    kept_and_deleted("routes", "(SELECT seen - to_days(k) AS created_at FROM obs) r", "created_at", 90))))
def _(t):
    now = datetime.fromisoformat(PURGE_AT)
    routes = t.obs.select((c("seen") - F.make_dt_interval(c("k"))).alias("created_at"), "event_id")
    out = None
    for name, rows, column in (("positions", t.positions, "observed_at"), ("observations", t.obs, "seen"), ("routes", routes, "created_at")):
        table = sinks.DailyTable(t.spark, scratch(t), column)
        table.append(rows.where("event_id % 3 = 0" if name != "positions" else "position_id % 3 = 0"), 0)
        table.append(rows.where("event_id % 3 <> 0" if name != "positions" else "position_id % 3 <> 0"), 1)
        gone = table.purge(now, sinks.RETENTION_DAYS[name])
        part = table.read().agg(F.count("*").alias("kept"), F.count_distinct("day").alias("days")).select(F.lit(name).alias("table"), F.lit(gone).cast("long").alias("deleted"), "kept", "days")
        out = part if out is None else out.unionByName(part)
    return out


@query("snk_05_expired_counts", needs=("positions", "obs"), oracle=f"""
SELECT 'positions' AS "table", count(*) FILTER (observed_at < timestamp '{PURGE_AT}' - INTERVAL 14 DAY) AS deleted FROM positions
UNION ALL SELECT 'observations', count(*) FILTER (seen < timestamp '{PURGE_AT}' - INTERVAL 30 DAY) FROM obs""")
def _(t):
    return sinks.expired_counts({"positions": (t.positions, "observed_at"), "observations": (t.obs, "seen")}, F.lit(PURGE_AT).cast("timestamp"))


# --- streams ---------------------------------------------------------------------------------------------


def streamed(t):
    """The derived observations and positions over a stream of the events files."""
    from ballast.plans.stand_ins import SPARK, TABLES

    events = so.file_stream(t.spark, f"{t.folder}/events.parquet")
    make = lambda name: t.spark.sql(TABLES[name][1](SPARK), events=events)
    return make


@query("str_01_vessel_state", needs=("positions",), oracle="""
SELECT shipment_id AS vessel_id, arg_max(position_id, (observed_at, position_id)) AS message_id FROM positions GROUP BY shipment_id HAVING max(observed_at) >= timestamp '2024-01-30 20:00:00' - INTERVAL 45 MINUTE""")
def _(t):
    # messages may be a week late, so that the state still holds every vessel asked for
    held = vessels(t, "7 days")
    return so.fresh_vessels(held, F.lit("2024-01-30 20:00:00").cast("timestamp")).select("vessel_id", "message_id")


def vessels(t, delay):
    state.keyed_states(t.spark)
    path = scratch(t)
    msgs = streamed(t)("positions").select(c("shipment_id").alias("vessel_id"), c("observed_at").alias("seen_at"), c("position_id").alias("message_id"), "nav_status", "lat", "lon")
    state.keep_states(so.vessel_states(msgs, delay), f"{path}/checkpoint")
    return state.newest_stored(t.spark, f"{path}/checkpoint", msgs.schema)


@query("str_01_vessels_in_state", needs=("positions",), oracle="""
SELECT shipment_id AS vessel_id, arg_max(position_id, (observed_at, position_id)) AS message_id, arg_max(nav_status, (observed_at, position_id)) AS nav_status, round(arg_max(lat, (observed_at, position_id)), 6) AS lat
FROM positions GROUP BY shipment_id HAVING max(observed_at) > (SELECT max(observed_at) FROM positions) - INTERVAL 6 HOUR - INTERVAL 45 MINUTE""")
def _(t):
    """What is left when the watermark, six hours behind, has passed all messages."""
    return vessels(t, "6 hours").select("vessel_id", "message_id", "nav_status", F.round("lat", 6).alias("lat"))


@query("str_02_stream_deduplication", needs=("obs",), oracle="SELECT DISTINCT provider_key, event_type, k, status FROM obs")
def _(t):
    path = scratch(t)
    keys = ["provider_key", "event_type", "k", "status"]
    s = so.unseen_in_stream(streamed(t)("obs"), keys, "90 days").select(*keys)
    so.run_available(s.writeStream.format("parquet").option("path", f"{path}/out").outputMode("append"), f"{path}/checkpoint")
    return t.spark.read.schema(s.schema).parquet(f"{path}/out")


@query("str_02_stream_observation_keys", needs=("obs",), oracle="""
SELECT provider_key, event_type, status, count(*) AS observations FROM (SELECT DISTINCT provider_key, event_type, k, status, coalesce(epoch_us(observed_at), -epoch_us(fetched_at)) AS stamp FROM obs) o GROUP BY 1, 2, 3""")
def _(t):
    """Failures have no observation time; each is kept by its fetch time."""
    path = scratch(t)
    s = streamed(t)("obs").withColumn("observation_key", so.observation_key(["provider_key", "event_type", "k", "status"]))
    s = so.unseen_in_stream(s, ["observation_key"], "90 days").select("provider_key", "event_type", "status", "observation_key")
    so.run_available(s.writeStream.format("parquet").option("path", f"{path}/out").outputMode("append"), f"{path}/checkpoint")
    return t.spark.read.schema(s.schema).parquet(f"{path}/out").groupBy("provider_key", "event_type", "status").agg(F.count("*").alias("observations"))


@query("str_02_batch_deduplication", needs=("obs",), oracle="""
SELECT user_id % 3 AS provider, entity, k, min(event_id) AS observation_id FROM (SELECT *, CASE WHEN user_id % 4 <> 0 THEN user_id % 4 END AS entity FROM obs WHERE event_id % 5 <> 0) o
WHERE NOT EXISTS (SELECT 1 FROM obs p WHERE p.event_id % 5 = 0 AND p.event_id % 2 = 0 AND p.user_id % 3 = o.user_id % 3 AND (CASE WHEN p.user_id % 4 <> 0 THEN p.user_id % 4 END) IS NOT DISTINCT FROM o.entity AND p.k = o.k) GROUP BY 1, 2, 3""")
def _(t):
    rows = t.obs.select((c("user_id") % 3).alias("provider"), F.when(c("user_id") % 4 != 0, c("user_id") % 4).alias("entity"), "k", c("event_id").alias("observation_id"))
    fresh, stored = rows.where("observation_id % 5 <> 0"), rows.where("observation_id % 5 = 0 and observation_id % 2 = 0")
    return so.unseen_in_batch(fresh, stored, ["provider", "entity", "k"], ["observation_id"])


BAD_OBS = "(coalesce(epoch_us(observed_at) - epoch_us(fetched_at) > 300000000, false) OR coalesce(lat NOT BETWEEN -90 AND 90, false) OR coalesce(lon NOT BETWEEN -180 AND 180, false))"
NEW_OBS = """SELECT provider_key, event_type, cast(user_id % 50 as varchar) AS entity_id, k, coalesce(epoch_us(observed_at), -epoch_us(fetched_at)) AS stamp, min(event_id) AS observation_id FROM obs GROUP BY 1, 2, 3, 4, 5"""


@query("str_03_ingest_cycle", needs=("obs",), oracle=f"""
WITH n AS ({NEW_OBS}), o AS (SELECT *, valid AND NOT {BAD_OBS} AS ok FROM obs WHERE event_id IN (SELECT observation_id FROM n)),
e AS (SELECT event_id FROM o WHERE status IN ('STALE', 'UNAVAILABLE') UNION ALL SELECT event_id FROM o WHERE provider_key = 'open_meteo' AND ok AND value >= 7.5 UNION ALL SELECT event_id FROM o WHERE provider_key = 'open_meteo' AND ok AND value * 100 > 0 AND value * 100 < 2000 UNION ALL SELECT event_id FROM o WHERE provider_key = 'open_meteo' AND ok AND value * 3 >= 50),
r AS (SELECT *, coalesce(observed_at, fetched_at) < (SELECT max(fetched_at) FROM obs) - INTERVAL 30 DAY AS old FROM o)
SELECT (SELECT count(*) FROM o) AS stored, (SELECT count(*) FROM o WHERE NOT ok) AS invalid, (SELECT count(*) FROM e) AS events, (SELECT count(*) FROM obs WHERE status = 'UNAVAILABLE') AS failures,
  (SELECT count(*) FROM r WHERE old) AS expired, (SELECT count(*) FROM r WHERE NOT old) AS kept, (SELECT count(*) FROM (SELECT DISTINCT provider_key, event_type, user_id % 50 FROM r WHERE ok AND NOT old) l) AS latest""")
def _(t):
    path = scratch(t)
    run = so.IngestCycle(t.spark, f"{path}/tables", ["rain"], ["provider_key", "observation_type", "entity_id", "k"], ["observation_id"])
    so.run_available(observation_rows(streamed(t)("obs")).writeStream.foreachBatch(run), f"{path}/checkpoint")
    tally = run.counters().agg(*[F.sum(x).alias(x) for x in ("stored", "invalid", "events", "failures", "expired")])
    rows = run.observations.read()
    return tally.crossJoin(F.broadcast(rows.agg(F.count("*").alias("kept")))).crossJoin(F.broadcast(sinks.latest_valid(rows).agg(F.count("*").alias("latest"))))


@query("str_04_event_rules", needs=("obs",), oracle="""
SELECT event_id AS observation_id, code AS event_type, CASE WHEN code LIKE 'PROVIDER%' THEN 'MEDIUM' ELSE 'HIGH' END AS severity FROM obs, LATERAL (VALUES ('PROVIDER_STALE', status = 'STALE'), ('PROVIDER_UNAVAILABLE', status = 'UNAVAILABLE'),
 ('HEAVY_RAIN', provider_key = 'open_meteo' AND valid AND value >= 7.5), ('LOW_VISIBILITY', provider_key = 'open_meteo' AND valid AND value * 100 > 0 AND value * 100 < 2000), ('HIGH_WIND', provider_key = 'open_meteo' AND valid AND value * 3 >= 50)) u(code, hit) WHERE hit""")
def _(t):
    path = scratch(t)
    s = so.observation_events(observation_rows(streamed(t)("obs")), ["observation_id"])
    so.run_available(s.writeStream.format("parquet").option("path", f"{path}/out"), f"{path}/checkpoint")
    return t.spark.read.schema(s.schema).parquet(f"{path}/out")


@query("str_05_provider_runtime", needs=("obs",), oracle="""
WITH a AS (SELECT provider_key || '-' || event_type AS provider_key, fetched_at AS at_, event_id AS seq, k % 4 < 2 AS ok, status FROM obs),
s AS (SELECT provider_key, max((at_, seq)) FILTER (ok) AS ls, epoch_us(max(at_) FILTER (ok)) AS last_success_at, epoch_us(max(at_) FILTER (NOT ok)) AS last_failure_at, arg_max(status, (at_, seq)) AS status FROM a GROUP BY provider_key),
f AS (SELECT s.*, (SELECT count(*) FROM a WHERE a.provider_key = s.provider_key AND NOT ok AND (ls IS NULL OR (at_, seq) > ls)) AS failures, (SELECT epoch_us(max(at_)) FROM a WHERE a.provider_key = s.provider_key AND NOT ok AND (ls IS NULL OR (at_, seq) > ls)) AS failed FROM s),
o AS (SELECT *, CASE WHEN failures >= 3 THEN failed END AS opened_at, greatest(coalesce(last_success_at, last_failure_at), coalesce(last_failure_at, last_success_at)) + (60 + 90 * (len(provider_key) % 2)) * 1000000 AS now_ FROM f)
SELECT provider_key, failures, last_success_at, last_failure_at, opened_at, CASE WHEN opened_at IS NULL THEN 'CLOSED' WHEN now_ >= opened_at + 120000000 THEN 'HALF_OPEN' ELSE 'OPEN' END AS state,
  CASE WHEN now_ < opened_at + 120000000 THEN opened_at + 120000000 END AS next_attempt_at, status FROM o""")
def _(t):
    state.keyed_states(t.spark)
    path = scratch(t)
    rows = streamed(t)("obs").select(F.concat_ws("-", "provider_key", "event_type").alias("provider_key"), c("fetched_at").alias("at"), c("event_id").alias("seq"), (c("k") % 4 < 2).alias("ok"), "status")
    state.keep_states(state.breakers(rows), f"{path}/checkpoint")
    runtime = state.runtime_stored(t.spark, f"{path}/checkpoint", so.THRESHOLD)
    late = F.unix_micros(F.greatest("last_success_at", "last_failure_at")) + (60 + 90 * (F.length("provider_key") % 2)) * 1_000_000
    found = so.breaker_states(runtime, F.timestamp_micros(late))
    times = ("last_success_at", "last_failure_at", "opened_at", "next_attempt_at")
    return found.select("provider_key", "failures", "state", "status", *[F.unix_micros(x).alias(x) for x in times])


@query("str_06_future_and_late", needs=("obs",), oracle="""
SELECT event_id, CASE WHEN observed_at IS NULL THEN 'UNKNOWN' WHEN age <= f THEN 'FRESH' WHEN age <= s THEN 'AGING' ELSE 'STALE' END AS freshness, coalesce(epoch_us(observed_at) > 1705700000000000 + 300000000, false) AS quarantined
FROM (SELECT *, CASE provider_key WHEN 'noaa_swpc' THEN 1800 ELSE 900 END AS f, CASE provider_key WHEN 'noaa_swpc' THEN 10800 ELSE 3600 END AS s, greatest(0, trunc((1705700000000000 - epoch_us(observed_at)) / 1e6)) AS age FROM obs) o""")
def _(t):
    path = scratch(t)
    at = F.timestamp_micros(F.lit(1705700000000000))
    s = so.labelled(streamed(t)("obs"), at).withColumn("errors", F.array_compact(F.array(F.when(F.unix_micros("observed_at") > F.lit(1705700000000000 + 300_000_000), "FUTURE_TIMESTAMP"))))
    s = s.select("event_id", "freshness", "errors")

    def split(rows, batch):
        good, bad = so.split_quarantine(rows)
        good.write.mode("overwrite").parquet(f"{path}/good/batch={batch}")
        bad.write.mode("overwrite").parquet(f"{path}/bad/batch={batch}")

    so.run_available(s.writeStream.foreachBatch(split), f"{path}/checkpoint")
    read = lambda n: t.spark.read.schema(s.schema).parquet(f"{path}/{n}/batch=*")
    return read("good").withColumn("quarantined", F.lit(False)).unionByName(read("bad").withColumn("quarantined", F.lit(True))).drop("errors")


@query("str_07_schedule_status", needs=("obs", "schedules"), oracle="""
SELECT schedule_id, event_id AS observation_id, status, CASE WHEN NOT valid THEN 'bad ' || cast(k as varchar) END AS last_error
FROM (SELECT s.schedule_id, o.*, row_number() OVER (PARTITION BY s.schedule_id ORDER BY o.fetched_at DESC, o.event_id DESC) AS rn FROM obs o JOIN schedules s ON s.train_code = 'T' || cast(o.event_id as varchar)) x WHERE rn = 1""")
def _(t):
    state.keyed_states(t.spark)
    path = scratch(t)
    rows = streamed(t)("obs").select(c("event_id").alias("observation_id"), F.concat(F.lit("T"), c("event_id").cast("string")).alias("train_code"), "fetched_at", "status", "valid",
                                     F.array(F.concat(F.lit("bad "), c("k").cast("string"))).alias("errors"))
    state.keep_states(so.schedule_states(rows, t.schedules), f"{path}/checkpoint")
    kind = "schedule_id bigint, observation_id bigint, status string, last_error string"
    return state.newest_stored(t.spark, f"{path}/checkpoint", T._parse_datatype_string(kind)).select("schedule_id", "observation_id", "status", "last_error")


@query("str_08_event_feed", needs=("obs",), oracle="SELECT event_id, event_type FROM obs WHERE user_id % 10 = 3 OR k % 25 = 0")
def _(t):
    from ballast.operators.selections import owned

    path = scratch(t)
    feed = streamed(t)("obs").withColumn("owner", F.when(c("k") % 25 != 0, c("user_id") % 10))
    s = owned(feed, F.lit(3), shared=True, column="owner").select("event_id", "event_type")
    so.run_available(s.writeStream.format("parquet").option("path", f"{path}/out"), f"{path}/checkpoint")
    return t.spark.read.schema(s.schema).parquet(f"{path}/out")


# --- models ------------------------------------------------------------------------------------------------

@query("mlo_01_training_protocol")
def _(t):
    """Test errors of the chosen model and of the formula."""
    r = models.train(t.features, hour_slot("observation_time", 24))
    return r["test"].select("rule", "rows", "mae", "rmse", "median_ae", "r2").withColumn("winner", F.lit(r["winner"]))


@query("mlo_02_guarded_scoring")
def _(t):
    r = models.train(t.features, hour_slot("observation_time", 24))
    gates = r["gates"].first().asDict()
    s = models.score(t.features, r["model"], r["bounds"], models.approved_gates({k: v for k, v in gates.items() if k != "eligible"}), "PRODUCTION")
    return s.select("row_id", "formula_minutes", "ml_minutes", "operational_minutes", "fallback", "reason")


@query("mlo_03_registry_rows", needs=("predictions",), oracle="""
SELECT DISTINCT model_name, model_version FROM predictions WHERE (model_name, model_version) NOT IN (SELECT (model_name, model_version) FROM predictions WHERE model_version < '1.3')""")
def _(t):
    known = t.predictions.where("model_version < '1.3'").select("model_name", "model_version").distinct()
    return models.unregistered(t.predictions.select("model_name", "model_version"), known, ["model_name", "model_version"])
