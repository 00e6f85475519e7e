"""Timetable files: static table sets, strict CSV, realtime documents and open-data exports."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.functions.clock import from_unix, schedule_value, service_seconds
from ballast.functions.common import blank_to_null, codes, once
from ballast.functions.vocab import TIMETABLE_ALIASES
from ballast.operators.contracts import snake
from ballast.operators.ordered import Step, number_slot, scan
from ballast.session import cut

# Members of a static timetable, with the columns each must have.
REQUIRED_MEMBERS = {
    "stops": ("stop_id", "stop_name"),
    "routes": ("route_id",),
    "trips": ("route_id", "service_id", "trip_id"),
    "stop_times": ("trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time"),
}
CALENDARS = ("calendar", "calendar_dates")
CORRUPT = "_corrupt"
FIELDS = "_fields"


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first line; blank or repeated names are refused."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    if not first:
        raise ValueError(f"{path} has no header")
    names = [n.strip() for n in next(csv.reader([first[0][0].lstrip("\ufeff")], skipinitialspace=True))]
    if any(not n for n in names) or len(set(names)) != len(names):
        raise ValueError(f"{path} has a blank or repeated column name")
    return names


def _lines(spark: SparkSession, path: str, multiline: bool = False) -> tuple[list[str], DataFrame]:
    """Header names and the text rows that are not blank, each with its number of fields (null: as many as the header or fewer) and raw line."""
    names = header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(CORRUPT, T.StringType())])
    raw = (
        spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", multiline)
        .option("columnPruning", False)  # else a row's width would be that of the columns in use
        .option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    )
    text = raw.select(*[blank_to_null(F.col(f"`{n}`")).alias(n) for n in names], CORRUPT)
    bare = F.regexp_replace(CORRUPT, '"([^"]|"")*"', "")
    width = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    rows = text.withColumn(FIELDS, width)
    return names, rows.where(F.coalesce(*[F.col(f"`{n}`") for n in names]).isNotNull() | (F.col(FIELDS) > len(names)))


def strict_csv(spark: SparkSession, path: str, max_rows: int | None = None, multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """Text rows of a CSV with header, and its violations (code, n).

    Values are trimmed, all-blank rows are dropped, short rows are filled with
    nulls, rows wider than the header are reported and left out; ``refused_rows``
    lists them. Every file below ``path`` begins with the header. With
    ``multiline`` quoted values may hold line breaks; files are then not split.
    """
    names, rows = _lines(spark, path, multiline)
    width = F.col(FIELDS)
    counts = rows.agg(F.count_if(width > len(names)).alias("BAD_ROW"), F.count("*").alias("_n"))
    tests = [F.struct(F.lit("BAD_ROW").alias("code"), F.col("BAD_ROW").alias("n"))]
    if max_rows is not None:
        tests.append(F.struct(F.lit("TOO_MANY_ROWS").alias("code"), F.greatest(F.col("_n") - max_rows, F.lit(0)).alias("n")))
    bad = counts.select(F.explode(F.array(*tests)).alias("x")).select("x.*").where("n > 0")
    return rows.where(F.coalesce(width <= len(names), F.lit(True))).drop(CORRUPT, FIELDS), bad


def refused_rows(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Rows wider than the header: (key, code, fields, line). The key is the first column's value."""
    names, rows = _lines(spark, path, multiline)
    return rows.where(F.col(FIELDS) > len(names)).select(
        F.col(f"`{names[0]}`").alias("key"), F.lit("BAD_ROW").alias("code"), F.col(FIELDS).alias("fields"), F.col(CORRUPT).alias("line"))


def read_static(spark: SparkSession, folder: str, members: list[str]) -> dict[str, DataFrame]:
    """Raw tables of an unpacked static timetable; required members must be among ``members``."""
    lacking = [m for m in REQUIRED_MEMBERS if m not in members]
    if lacking or not any(c in members for c in CALENDARS):
        raise ValueError(f"missing members: {lacking or list(CALENDARS)}")
    out = {}
    for m in members:
        rows, _ = strict_csv(spark, f"{folder}/{m}.txt")
        gone = [c for c in REQUIRED_MEMBERS.get(m, ()) if c not in rows.columns]
        if gone:
            raise ValueError(f"{m}.txt lacks {gone}")
        out[m] = rows
    return out


def static_violations(raw: dict[str, DataFrame]) -> DataFrame:
    """Faults of a static timetable as rows (member, key, field, code, n); a timetable without any may be used.

    The key is the id of the faulty row (trip and sequence for stop times), for a
    reference to nothing the id that is missing; n counts the rows. Ids may be
    neither blank nor repeated, references must exist, times be service times that
    don't run backwards within a trip, integers whole and not negative, and a
    trip's sequence numbers differ. Rows are ordered by sequence, as files have no
    order once they are split.
    """
    def faults(df: DataFrame, member: str, key: Column, *tests: tuple[str, str, Column]) -> DataFrame:
        each = codes(*[(hit, f"{f}|{code}") for f, code, hit in tests])
        found = df.select(F.lit(member).alias("member"), F.coalesce(key, F.lit("")).alias("key"), F.explode(each).alias("x"))
        return found.select("member", "key", *[F.substring_index("x", "|", i).alias(n) for i, n in ((1, "field"), (-1, "code"))], F.lit(1).cast("long").alias("n"))

    def whole(df: DataFrame, field: str) -> tuple[str, str, Column]:
        v = df[field] if field in df.columns else F.lit(None).cast("string")
        return field, "BAD_VALUE", v.isNotNull() & ~(v.rlike(r"^[+]?[0-9]+$") & v.try_cast("int").isNotNull())

    def absent(df: DataFrame, member: str, field: str, other: str) -> DataFrame:
        # values first: a frequent one is a single row before the join
        used = df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("key")).agg(F.count("*").alias("n"))
        return used.join(raw[other].select(F.col(field).alias("key")), "key", "left_anti").select(
            F.lit(member).alias("member"), "key", F.lit(field).alias("field"), F.lit("BAD_REFERENCE").alias("code"), "n")

    parts = []
    for member, field in (("stops", "stop_id"), ("routes", "route_id"), ("trips", "trip_id")):
        df = raw[member]
        parts.append(faults(df, member, F.col(field), (field, "MISSING_FIELD", F.col(field).isNull())))
        parts.append(df.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("key")).agg(F.count("*").alias("n")).where("n > 1").select(
            F.lit(member).alias("member"), "key", F.lit(field).alias("field"), F.lit("DUPLICATE_ID").alias("code"), "n"))
    for member, field in (("routes", "route_type"), ("trips", "direction_id")):
        parts.append(faults(raw[member], member, F.col(REQUIRED_MEMBERS[member][-1]), whole(raw[member], field)))
    trips, times = raw["trips"], raw["stop_times"]
    needed = REQUIRED_MEMBERS["stop_times"]
    # every stop time is parsed once for the searches below
    a, d = service_seconds(F.col("arrival_time")), service_seconds(F.col("departure_time"))
    kept = [f for f in times.columns if f in (*needed, "pickup_type", "drop_off_type")]
    times = cut(times.select(*kept, a.alias("_a"), d.alias("_d")))
    parts.append(faults(trips, "trips", F.col("trip_id"), ("route_id", "MISSING_FIELD", F.col("route_id").isNull())))
    parts.append(absent(trips, "trips", "route_id", "routes"))
    parts += [absent(times, "stop_times", "trip_id", "trips"), absent(times, "stop_times", "stop_id", "stops")]

    at = F.concat_ws("|", F.coalesce("trip_id", F.lit("")), F.coalesce("stop_sequence", F.lit("")))
    a, d = F.col("_a"), F.col("_d")
    parts.append(faults(
        times, "stop_times", at, *[(f, "MISSING_FIELD", F.col(f).isNull()) for f in needed],
        *[whole(times, f) for f in ("stop_sequence", "pickup_type", "drop_off_type")],
        ("arrival_time", "BAD_TIME", F.col("arrival_time").isNotNull() & a.isNull()), ("departure_time", "BAD_TIME", F.col("departure_time").isNotNull() & d.isNull()),
        ("departure_time", "BAD_TIME", d < a)))
    placed = times.select("trip_id", F.col("stop_sequence").try_cast("int").alias("seq"), a.alias("a"), d.alias("d")).where("trip_id is not null and seq is not null and a is not null and d is not null")
    # of equal numbers one row goes on, so that a trip's slot holds its numbers only
    stops = placed.groupBy("trip_id", "seq").agg(F.count("*").alias("n"), F.min("a").alias("a"), F.max("d").alias("d"))
    after = scan(stops, ["trip_id"], ["seq"], number_slot("seq", 4096), [Step("before", "lag", F.col("d"))])
    key = F.concat_ws("|", "trip_id", "seq").alias("key")
    order = lambda df, field, n: df.select(F.lit("stop_times").alias("member"), key, F.lit(field).alias("field"), F.lit("BAD_ORDER").alias("code"), n.alias("n"))
    parts.append(order(stops.where("n > 1"), "stop_sequence", F.col("n")))
    parts.append(order(after.where("a < before"), "arrival_time", F.lit(1).cast("long")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("member", "key", "field", "code").agg(F.sum("n").alias("n"))


def typed_static(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Named, typed columns of the static tables; calendars stay text."""
    def pick(df: DataFrame, *cols: str, ints: tuple[str, ...] = ()) -> DataFrame:
        have = set(df.columns)
        out = []
        for c in cols:
            v = blank_to_null(F.col(c)) if c in have else F.lit(None).cast("string")
            out.append((v.try_cast("int") if c in ints else v).alias(c))
        return df.select(*out)

    res = {
        "stops": pick(raw["stops"], "stop_id", "stop_name", "stop_code", "stop_timezone"),
        "routes": pick(raw["routes"], "route_id", "route_short_name", "route_long_name", "route_type", ints=("route_type",)),
        "trips": pick(raw["trips"], "trip_id", "route_id", "service_id", "trip_headsign", "direction_id", ints=("direction_id",)),
        "stop_times": pick(
            raw["stop_times"], "trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time", "pickup_type", "drop_off_type",
            ints=("stop_sequence", "pickup_type", "drop_off_type"),
        ).withColumns({"arrival_s": service_seconds(F.col("arrival_time")), "departure_s": service_seconds(F.col("departure_time"))}),
    }
    for c in CALENDARS:
        if c in raw:
            res[c] = raw[c]
    return res


def member_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per member; a member without rows fails the feed."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(m).alias("member"), "rows") for m, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("ok", F.col("rows") > 0)


# --- realtime documents ----------------------------------------------------------------

_EVENT = "struct<time:bigint,delay:int>"
_TEXT = "struct<translation:array<struct<text:string,language:string>>>"
REALTIME = (
    "struct<header:struct<gtfs_realtime_version:string,timestamp:bigint,incrementality:string>,"
    "entity:array<struct<id:string,"
    f"trip_update:struct<trip:struct<trip_id:string,route_id:string,start_date:string,schedule_relationship:string>,stop_time_update:array<struct<stop_id:string,stop_sequence:int,arrival:{_EVENT},departure:{_EVENT}>>>,"
    "vehicle:struct<trip:struct<trip_id:string>,vehicle:struct<id:string>,position:struct<latitude:double,longitude:double,speed:double>,timestamp:bigint>,"
    f"alert:struct<cause:string,effect:string,header_text:{_TEXT},description_text:{_TEXT}>>>>"
)


def realtime_tables(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> dict[str, DataFrame]:
    """Trip updates, vehicle positions, alerts and violations of realtime JSON documents."""
    # nine searches read the documents; each is parsed once
    d = cut(docs.select(doc_id, F.from_json(text, REALTIME).alias("d")))
    e = d.select(doc_id, F.explode("d.entity").alias("e")).select(doc_id, "e.*")
    eid = blank_to_null(F.col("id"))

    def stamped(side):
        return F.when(side.isNotNull(), F.struct(side["time"].alias("time"), side["delay"].alias("delay"), F.timestamp_seconds(side["time"]).alias("at")))

    updates = F.transform("trip_update.stop_time_update", lambda u: F.struct(
        u["stop_id"].alias("stop_id"), u["stop_sequence"].alias("stop_sequence"), stamped(u["arrival"]).alias("arrival"), stamped(u["departure"]).alias("departure")))
    trips = e.where("trip_update is not null").select(
        doc_id, eid.alias("entity_id"), *[blank_to_null(F.col(f"trip_update.trip.{c}")).alias(c) for c in ("trip_id", "route_id", "start_date", "schedule_relationship")],
        updates.alias("stop_time_updates"))
    p = F.col("vehicle.position")
    vehicles = e.where("vehicle is not null").select(
        doc_id, eid.alias("entity_id"), blank_to_null(F.col("vehicle.vehicle.id")).alias("vehicle_id"), blank_to_null(F.col("vehicle.trip.trip_id")).alias("trip_id"),
        p["latitude"].alias("latitude"), p["longitude"].alias("longitude"), p["speed"].alias("speed_mps"), F.timestamp_seconds("vehicle.timestamp").alias("observed_at"))
    words = lambda c: F.nullif(F.get(F.col(f"alert.{c}.translation"), 0)["text"], F.lit(""))
    alerts = e.where("alert is not null").select(
        doc_id, eid.alias("alert_id"), blank_to_null(F.col("alert.cause")).alias("cause"), blank_to_null(F.col("alert.effect")).alias("effect"),
        words("header_text").alias("header_text"), words("description_text").alias("description_text"))

    def bad(df, cond, code):
        return df.where(cond).select(doc_id, F.lit(code).alias("code"))

    twice = e.where(eid.isNotNull()).groupBy(doc_id, eid.alias("entity_id")).agg(F.count("*").alias("n"))
    wrong = [
        bad(d, F.col("d.header").isNull() | blank_to_null(F.col("d.header.gtfs_realtime_version")).isNull(), "NO_VERSION"),
        bad(e, eid.isNull(), "NO_ENTITY_ID"), bad(twice, F.col("n") > 1, "DUPLICATE_ENTITY_ID"),
        bad(trips, F.col("trip_id").isNull(), "NO_TRIP_ID"),
        bad(vehicles, ~F.col("latitude").between(-90, 90) | ~F.col("longitude").between(-180, 180), "POSITION_RANGE"),
        bad(vehicles, F.col("speed_mps") < 0, "SPEED_RANGE"),
    ]
    out = wrong[0]
    for w in wrong[1:]:
        out = out.unionByName(w)
    return {"trip_updates": trips, "vehicle_positions": vehicles, "alerts": alerts, "violations": out}


# --- open-data exports ---------------------------------------------------------------------

_ROWS = "array<map<string,string>>"


def open_data_records(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Records of JSON exports, either a bare list or the first non-empty of three envelope lists."""
    env = F.from_json(text, f"struct<records:{_ROWS},data:{_ROWS},results:{_ROWS}>")
    bare = F.from_json(text, _ROWS)
    filled = lambda a: F.when(F.size(a) > 0, a)
    listed = F.when(F.trim(F.col(text)).startswith("["), bare).otherwise(
        F.coalesce(filled(env["records"]), filled(env["data"]), filled(env["results"])))
    return docs.select(doc_id, F.posexplode(listed).alias("record_no", "record"))


def _snake_key(k: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(k)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def open_data_timetable(records: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Seven canonical columns from whichever names a release uses, and rows that lack a required one.

    ``records`` have a ``record`` map of text values. Violations name the missing
    fields and the fields that were there.
    """
    named = once(records, {"_m": F.transform_keys("record", lambda k, v: _snake_key(k))})
    canon = {
        field: F.coalesce(*[blank_to_null(F.col("_m")[a]) for a in aliases]) for field, aliases in TIMETABLE_ALIASES.items()
    }
    rows = once(named, canon).select(*keys, "_m", *canon)
    need = [f for f in TIMETABLE_ALIASES if f != "service_date"]
    lost = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in need]))
    dep, arr = schedule_value(F.col("scheduled_departure")), schedule_value(F.col("scheduled_arrival"))
    rows = once(rows, {"_dep": dep, "_arr": arr})
    dep, arr = F.col("_dep"), F.col("_arr")
    date = F.coalesce(F.col("service_date"), dep["date"], arr["date"])
    dated = date.isNull() | date.rlike(r"^\d{4}-\d{2}-\d{2}$")
    code = (
        F.when(F.size(lost) > 0, "MISSING_FIELD").when(dep.isNull() | arr.isNull(), "BAD_TIME").when(~dated, "BAD_DATE")
    )
    judged = rows.withColumns({"_lost": lost, "_code": code})
    good = judged.where("_code is null").select(
        *keys, "train_code", "train_name", "source_station_code", "dest_station_code",
        dep["time"].alias("scheduled_departure"), arr["time"].alias("scheduled_arrival"), date.alias("service_date"))
    bad = judged.where("_code is not null").select(
        *keys, F.col("_code").alias("code"), F.array_join("_lost", ", ").alias("missing"),
        F.array_join(F.array_sort(F.map_keys("_m")), ", ").alias("available"))
    return good, bad


def open_data_csv(rows: DataFrame) -> DataFrame:
    """CSV rows in the record form of the JSON exports."""
    pairs = [x for c in rows.columns for x in (F.lit(snake(c)), F.col(f"`{c}`").cast("string"))]
    return rows.select("*", F.create_map(*pairs).alias("record"))


__all__ = [
    "header", "strict_csv", "read_static", "typed_static", "member_counts", "realtime_tables",
    "open_data_records", "open_data_timetable", "open_data_csv", "from_unix",
]
