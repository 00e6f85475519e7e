"""Parsing of landed provider messages, one JSON text per row, batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions.common import blank_to_null
from ballast.functions.vocab import NAV_UNDEFINED

POSITION = (
    "struct<MessageType:string,Message:struct<PositionReport:struct<UserID:bigint,Latitude:double,Longitude:double,"
    "NavigationalStatus:int,Sog:double>>,MetaData:struct<MMSI:bigint,ShipName:string,latitude:double,longitude:double,time_utc:string>>"
)


def vessel_positions(messages: DataFrame, text: str = "text") -> DataFrame:
    """Usable position reports; other messages and 'unavailable' positions are left out."""
    # keys that differ only in case must stay apart
    d = F.from_json(text, POSITION, {"caseSensitive": "true"})
    m = messages.withColumn("_d", d).where("_d.MessageType = 'PositionReport'")
    r, meta = F.col("_d.Message.PositionReport"), F.col("_d.MetaData")
    name = F.trim(F.rtrim(F.trim(meta["ShipName"]), F.lit("@")))
    out = m.withColumns({
        "vessel_id": F.coalesce(F.nullif(r["UserID"], F.lit(0)), meta["MMSI"]), "name": F.nullif(name, F.lit("")),
        "lat": F.coalesce(r["Latitude"], meta["latitude"]), "lon": F.coalesce(r["Longitude"], meta["longitude"]),
        "nav_status": F.coalesce(r["NavigationalStatus"], F.lit(NAV_UNDEFINED)), "sog": F.coalesce(r["Sog"], F.lit(0.0)),
    })
    return out.where("vessel_id is not null and abs(lat) <= 90 and abs(lon) <= 180").drop("_d", text)


TRAIN = "struct<train:struct<number:string,name:string>,live:struct<type:string,delayMinutes:double,platform:string>>"
BOARD = f"struct<success:boolean,data:struct<trains:array<{TRAIN}>>,error:struct<message:string>>"


def station_boards(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Board summary per document: a missing train list is UNAVAILABLE, an empty one is LIVE with no trains."""
    d = docs.withColumn("_d", F.from_json(text, BOARD))
    trains = F.col("_d.data.trains")
    ok = F.coalesce(F.col("_d.success"), F.lit(False)) & trains.isNotNull()
    delays = F.filter(F.transform(trains, lambda x: x["live"]["delayMinutes"].cast("int")), lambda x: x.isNotNull())
    n = F.size(delays)
    # a board lists the trains of a few hours, so its arrays are short
    total = F.aggregate(delays, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return d.select(
        *keys, F.when(ok, "LIVE").otherwise("UNAVAILABLE").alias("source"),
        F.when(ok, F.size(trains)).otherwise(0).alias("trains"),
        F.when(ok & (n > 0), F.round(total / n, 1)).otherwise(0.0).alias("mean_delay"),
        F.when(ok & (n > 0), F.array_max(delays)).otherwise(0).alias("max_delay"),
        F.when(ok, F.size(F.filter(trains, lambda x: x["live"]["type"] == "at-station"))).otherwise(0).alias("at_station"),
        F.when(~F.coalesce(F.col("_d.success"), F.lit(False)), F.coalesce("_d.error.message", F.lit("unknown error")))
        .when(trains.isNull(), "Malformed response: no train list").when(F.size(trains) == 0, "No trains in window").alias("detail"),
    )


def board_trains(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per listed train with its live type and delay."""
    d = docs.withColumn("_d", F.from_json(text, BOARD)).where("_d.success")
    return d.select(*keys, F.explode("_d.data.trains").alias("t")).select(
        *keys, F.col("t.train.number").alias("number"), F.col("t.live.type").alias("live_type"), F.col("t.live.delayMinutes").cast("int").alias("delay"))


ZONED = r"(Z|[+-]\d{2}:?\d{2})$"


def zoned_time(text: Column) -> Column:
    """Instant of a text that states its offset, else null."""
    return F.when(F.trim(text).rlike(ZONED), F.try_to_timestamp(F.trim(text)))


def authorized_corridors(docs: DataFrame, keys: list[str], stations: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Corridor scores fanned out to their stations, and rejected documents with a code."""
    d = docs.withColumn("_d", F.from_json(text, "struct<congestion_score:double,observed_at:string>"))
    score, at = F.col("_d.congestion_score"), zoned_time(F.col("_d.observed_at"))
    code = (
        F.when(score.isNull(), "NO_SCORE").when(~score.between(0, 100), "SCORE_RANGE")
        .when(blank_to_null(F.col("_d.observed_at")).isNull(), "NO_TIME").when(at.isNull(), "BAD_TIME")
    )
    judged = d.withColumns({"_code": code, "score": score, "observed_at": at})
    good = judged.where("_code is null").select(*keys, "score", "observed_at", F.explode(stations).alias("station_code"), F.lit("LIVE").alias("source"))
    return good, judged.where("_code is not null").select(*keys, F.col("_code").alias("code"))


CURRENT = (
    "struct<time:string,temperature_2m:double,relative_humidity_2m:double,precipitation:double,rain:double,weather_code:int,"
    "wind_speed_10m:double,wind_gusts_10m:double,visibility:double>"
)


def weather_observations(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Current-weather documents that carry a time, temperature, weather code and wind."""
    c = docs.select(*keys, F.from_json(text, f"struct<current:{CURRENT}>")["current"].alias("c")).select(*keys, "c.*")
    at = F.coalesce(zoned_time(F.col("time")), F.try_to_timestamp(F.col("time")))
    return c.where("time is not null and temperature_2m is not null and weather_code is not null and wind_speed_10m is not null").withColumn(
        "observed_at", at).drop("time").where("observed_at is not null")


def kp_latest(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Last row of each space-weather product, given as an object or as a list; Kp must lie in 0..9."""
    last = F.try_element_at(F.from_json(text, "array<string>"), F.lit(-1))
    obj, lst = F.from_json(last, "struct<time_tag:string,Kp:string>"), F.from_json(last, "array<string>")
    is_list = F.trim(last).startswith("[")
    at = F.when(is_list, F.get(lst, 0)).otherwise(obj["time_tag"])
    kp = F.when(is_list, F.get(lst, 1)).otherwise(obj["Kp"]).try_cast("double")
    d = docs.select(*keys, F.try_to_timestamp(at).alias("observed_at"), kp.alias("_kp")).where("observed_at is not null and _kp between 0 and 9")
    whole = F.floor("_kp").cast("int")
    return d.select(*keys, "observed_at", whole.alias("kp_index"), F.when(whole >= 7, "WARNING").otherwise("NONE").alias("alert_level"))


ROUTE_FIELDS = (
    "temperature_2m", "apparent_temperature", "relative_humidity_2m", "weather_code", "wind_speed_10m",
    "wind_direction_10m", "visibility", "uv_index", "precipitation",
)


def route_weather(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Nine fields per point; a point that lacks one is kept as unavailable with no values."""
    kind = ",".join(f"{f}:double" for f in ROUTE_FIELDS)
    c = F.from_json(text, f"struct<current:struct<{kind}>>")["current"]
    d = docs.select(*keys, c.alias("c"))
    have = F.lit(True)
    for f in ROUTE_FIELDS:
        have = have & F.col(f"c.{f}").isNotNull()
    return d.select(*keys, have.alias("available"), *[F.when(have, F.col(f"c.{f}")).alias(f) for f in ROUTE_FIELDS])


STATUS = (
    "struct<observed_at:string,updated_at:string,last_updated:string,delay_minutes:double,delay:double,latitude:double,lat:double,"
    "longitude:double,lon:double,running_status:string,status:string,current_station:string,station_code:string,scheduled_arrival:string,estimated_arrival:string>"
)


def passenger_status(docs: DataFrame, keys: list[str], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Listed fields of a partner's train status with its fallbacks, and rejected documents with a code.

    The status may stand at the root or under ``data``; unlisted fields are dropped.
    Texts are kept whole.
    """
    root = F.from_json(text, f"struct<data:{STATUS}>")["data"]
    d = docs.select(*keys, F.coalesce(root, F.from_json(text, STATUS)).alias("d"))
    c = lambda n: F.col(f"d.{n}")
    stamp = F.coalesce(*[F.nullif(c(n), F.lit("")) for n in ("observed_at", "updated_at", "last_updated")])
    at = F.coalesce(zoned_time(stamp), F.try_to_timestamp(stamp))
    rows = d.select(
        *keys, at.alias("observed_at"), F.coalesce(c("running_status"), c("status")).alias("running_status"),
        c("current_station").alias("current_station"), c("station_code").alias("station_code"),
        F.coalesce(c("delay_minutes"), c("delay")).alias("delay_minutes"), F.coalesce(c("latitude"), c("lat")).alias("latitude"),
        F.coalesce(c("longitude"), c("lon")).alias("longitude"), c("scheduled_arrival").alias("scheduled_arrival"),
        c("estimated_arrival").alias("estimated_arrival"),
    )
    code = (
        F.when(F.col("observed_at").isNull(), "NO_TIME").when(~F.col("delay_minutes").between(-240, 10000), "DELAY_RANGE")
        .when(~F.col("latitude").between(-90, 90), "LATITUDE_RANGE").when(~F.col("longitude").between(-180, 180), "LONGITUDE_RANGE")
    )
    judged = rows.withColumn("code", code)
    return judged.where("code is null").drop("code"), judged.where("code is not null").select(*keys, "code")
