"""Domain tables derived from the supplied ones, so that queries have inputs.

Each derivation is one SELECT in the SQL that Spark and DuckDB share; the few
functions that differ come from a small dialect object. Spark builds a frame
from it, the check SQL uses it as a WITH entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ballast.session import fan_out, size_shuffles, stored_bytes, table

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Dialect:
    def __init__(self, us: str, at: str, sha: str, json: str, num: str):
        self._us, self._at, self._sha, self._json, self._num = us, at, sha, json, num

    def us(self, ts: str) -> str:
        return self._us.format(ts)

    def at(self, micros: str) -> str:
        return self._at.format(micros)

    def plus(self, ts: str, seconds: str) -> str:
        return self.at(f"{self.us(ts)} + cast(floor(({seconds}) * 1e6) as bigint)")

    def sha(self, text: str) -> str:
        return self._sha.format(text)

    def prop(self, col: str, key: str) -> str:
        return self._json.format(col, key)

    def glued(self, text: str) -> str:
        """All values of a group in order, as one text."""
        return self._num.format(text)


SPARK = Dialect(
    "unix_micros({})", "timestamp_micros({})", "sha2({}, 256)",
    "get_json_object({}, '$.{}')", "array_join(array_sort(collect_list({0})), '')",
)
DUCK = Dialect(
    "epoch_us({})", "make_timestamp({})", "sha256({})",
    "json_extract_string({}, '$.{}')", "string_agg({0}, '' ORDER BY {0})",
)

TABLES: dict[str, tuple[tuple[str, ...], object]] = {}


def derived(name: str, *needs: str):
    def register(fn):
        TABLES[name] = (needs, fn)
        return fn

    return register


# inputs that make many or costly rows of a decision: their decisions are dealt evenly beforehand. They are not
# written, so that a query derives the columns it reads and no others
DEALT = ("ev_records", "ev_edges")
BY_DECISION = "spark.sql.requireAllClusterKeysForCoPartition"


class Tables:
    """Lazy access to the supplied and derived tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made, self._read = spark, folder, {}, 0
        size_shuffles(spark, 0)
        spark.conf.unset(BY_DECISION)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("__"):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = table(self.spark, self.folder, name)
                self._read += stored_bytes(self.spark, f"{self.folder}/{name}.parquet")
                size_shuffles(self.spark, self._read)
            elif name in TABLES:
                self._made[name] = self._derive(name)
            else:
                raise AttributeError(name)
        return self._made[name]

    def _derive(self, name: str) -> DataFrame:
        needs, fn = TABLES[name]
        frames = {n: getattr(self, n) for n in needs}
        if name in DEALT:
            frames = {n: self._dealt(n) for n in frames}
        return self.spark.sql(fn(SPARK), **frames)

    def _dealt(self, name: str) -> DataFrame:
        key = f"{name} by decision"
        if key not in self._made:
            self._made[key] = fan_out(getattr(self, name), "snapshot_id")
            # joins by decision and record go on within a decision's task
            self.spark.conf.set(BY_DECISION, "false")
        return self._made[key]


def with_tables(names: tuple[str, ...], select: str) -> str:
    ordered: list[str] = []

    def visit(n: str) -> None:
        if n in BASE or n in ordered:
            return
        for m in TABLES[n][0]:
            visit(m)
        ordered.append(n)

    for n in names:
        visit(n)
    if not ordered:
        return select.strip()
    parts = []
    for n in ordered:
        needs, fn = TABLES[n]
        parts.append(f"{n} AS (" + fn(DUCK).format(**{m: m for m in needs}).strip() + ")")
    body = select.strip()
    head = "WITH RECURSIVE" if body.upper().startswith("WITH RECURSIVE") else "WITH"
    if body.upper().startswith("WITH "):
        body = body[len(head):].strip()
        return f"{head} " + ",\n".join(parts) + ",\n" + body
    return "WITH " + ",\n".join(parts) + "\n" + body


# --- network ---------------------------------------------------------------


@derived("stations", "nation")
def _(d):
    return """
    SELECT n_nationkey AS station_id, 'N' || cast(n_nationkey as string) AS code, n_name AS name,
           8 + (n_nationkey * 37) % 28 + (n_nationkey % 10) / 1e1 AS lat,
           68 + (n_nationkey * 53) % 29 + (n_nationkey % 7) / 1e1 AS lon
    FROM {nation}"""


@derived("segments", "orders", "customer")
def _(d):
    # directed edges between the nations of neighbouring orders
    return """
    SELECT src * 100 + dst AS seg_id, src, dst,
           'N' || cast(src as string) AS src_code, 'N' || cast(dst as string) AS dst_code,
           1 + (n % 80) / 1e2 AS factor, (cents % 300) / 1e2 AS delay_h,
           4 + (cents % 7) / 1e1 AS max_h, 3 + (cents % 5) / 1e1 AS max_w,
           cast(80 + cents % 60 as double) AS max_t
    FROM (SELECT c1.c_nationkey AS src, c2.c_nationkey AS dst, count(*) AS n,
                 cast(sum(cast(round(o1.o_totalprice * 100) as bigint)) as bigint) AS cents
          FROM {orders} o1 JOIN {orders} o2 ON o2.o_orderkey = o1.o_orderkey + 1
          JOIN {customer} c1 ON c1.c_custkey = o1.o_custkey
          JOIN {customer} c2 ON c2.c_custkey = o2.o_custkey
          WHERE (c2.c_nationkey - c1.c_nationkey + 25) % 25 IN (1, 2, 3)
          GROUP BY c1.c_nationkey, c2.c_nationkey) e"""


@derived("segment_points", "segments", "stations")
def _(d):
    # three points per segment: both ends and a bowed middle
    return """
    SELECT s.seg_id, p.pos,
           CASE p.pos WHEN 0 THEN a.lat WHEN 1 THEN (a.lat + b.lat) / 2 + 0.25e0 ELSE b.lat END AS lat,
           CASE p.pos WHEN 0 THEN a.lon WHEN 1 THEN (a.lon + b.lon) / 2 - 0.25e0 ELSE b.lon END AS lon
    FROM {segments} s JOIN {stations} a ON a.station_id = s.src JOIN {stations} b ON b.station_id = s.dst
    CROSS JOIN (SELECT 0 AS pos UNION ALL SELECT 1 UNION ALL SELECT 2) p"""


@derived("route_legs", "orders", "customer", "segments")
def _(d):
    # one stored route per order: the segments leaving its customer's nation, in order
    return """
    SELECT o.o_orderkey AS route_id, o.o_custkey AS user_id, s.seg_id,
           (s.dst - s.src + 25) % 25 AS seq, s.src_code, s.dst_code, s.factor, s.delay_h,
           s.max_h, s.max_w, s.max_t,
           4 + (o.o_orderkey % 8) / 1e1 AS cargo_h, 3 + (o.o_orderkey % 5) / 1e1 AS cargo_w,
           cast(70 + o.o_orderkey % 50 as double) AS cargo_t
    FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
    JOIN {segments} s ON s.src = c.c_nationkey
    WHERE o.o_orderkey % 11 <> 0"""


@derived("routes", "orders", "customer")
def _(d):
    return f"""
    SELECT o.o_orderkey AS route_id, o.o_custkey AS user_id, o.o_orderdate AS created_at,
           'N' || cast(c.c_nationkey as string) AS source_code,
           CASE WHEN o.o_orderkey % 9 = 0 THEN 'JNPT'
                ELSE 'N' || cast((c.c_nationkey + 1 + o.o_orderkey % 12) % 25 as string) END AS dest_code,
           cast(cast(round(o.o_totalprice * 100) as bigint) % 101 as int) AS reliability_score,
           CASE WHEN o.o_orderkey % 6 = 0 THEN NULL ELSE (o.o_orderkey % 1000) / 1e1 END AS weather_score,
           CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE (o.o_orderkey % 97) / 1e0 END AS port_score,
           (o.o_orderkey % 83) + 0.5e0 AS congestion_score, (o.o_orderkey % 71) + 0.25e0 AS historical_score,
           o.o_orderkey % 13 = 0 AS clearance_failed,
           CASE WHEN o.o_orderkey % 7 = 0 THEN NULL ELSE 10 + (o.o_orderkey % 300) / 1e1 END AS estimated_hours
    FROM {{orders}} o JOIN {{customer}} c ON c.c_custkey = o.o_custkey"""


# --- schedules and occupation ------------------------------------------------


@derived("schedules", "orders", "customer")
def _(d):
    arr = d.plus("o.o_orderdate", "(1 + o.o_orderkey % 40) * 21600")
    return f"""
    SELECT o.o_orderkey AS schedule_id, 'T' || cast(o.o_orderkey as string) AS train_code,
           o.o_custkey AS user_id, 'N' || cast(c.c_nationkey as string) AS dest_code,
           o.o_orderdate AS departs_at, {arr} AS arrives_at,
           CASE WHEN o.o_orderkey % 4 = 0 THEN {d.plus('o.o_orderdate', '(o.o_orderkey % 30) * 21600')} END AS berth_start,
           CASE WHEN o.o_orderkey % 4 = 0 THEN {d.plus('o.o_orderdate', '(5 + o.o_orderkey % 40) * 21600')} END AS berth_end,
           CASE WHEN o.o_orderstatus = 'P' AND o.o_orderpriority = '5-LOW' THEN 'CANCELLED'
                WHEN o.o_orderstatus = 'F' THEN 'COMPLETED' ELSE 'PLANNED' END AS status
    FROM {{orders}} o JOIN {{customer}} c ON c.c_custkey = o.o_custkey"""


@derived("windows", "lineitem")
def _(d):
    return f"""
    SELECT w.*, {d.plus('entry_at', 'days * 86400')} AS exit_at,
           CASE WHEN supp % 41 = 0 THEN 'none' ELSE {d.sha('window_id')} END AS source_checksum,
           entry_at AS observed_at, {d.plus('entry_at', '(supp % 7 - 1) * 60')} AS fetched_at
    FROM (SELECT cast(l_orderkey as string) || '-' || cast(l_linenumber as string) || '-' ||
                 cast(l_partkey as string) || '-' || cast(l_suppkey as string) || '-' ||
                 cast(cast(round(l_extendedprice * 100) as bigint) as string) AS window_id,
                 l_orderkey AS schedule_id, l_partkey AS section_id, l_linenumber - 1 AS seq,
                 l_shipdate AS entry_at, l_quantity AS days, l_suppkey AS supp,
                 CASE WHEN l_linestatus = 'F' THEN 'FORWARD' ELSE 'REVERSE' END AS direction,
                 CASE WHEN l_suppkey % 50 = 7 THEN 'REPLAYED_SNAPSHOT' WHEN l_suppkey % 50 = 9 THEN 'SIMULATED'
                      WHEN l_returnflag = 'A' THEN 'AUTHORIZED_FEED' WHEN l_returnflag = 'R' THEN 'OPERATOR_INPUT'
                      ELSE 'IMPORTED_DOCUMENT' END AS source_type,
                 CASE WHEN l_suppkey % 37 = 0 THEN 'x' ELSE 'sheet ' || cast(l_suppkey as string) END AS source_reference,
                 CASE WHEN l_tax > 0.07 THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS verification_state,
                 cast(10 + l_partkey % 8 as double) AS train_length_m
          FROM {{lineitem}}) w"""


@derived("policies", "part")
def _(d):
    return f"""
    SELECT p_partkey AS section_id, p_size % 2 = 0 AS single_track,
           CASE WHEN p_size % 7 = 0 THEN NULL ELSE cast(p_size * 3600 as double) END AS headway_s,
           CASE WHEN p_partkey % 19 = 0 THEN 'REAL_HISTORICAL' ELSE 'AUTHORIZED_FEED' END AS source_type,
           'rulebook ' || p_brand AS source_reference, {d.sha('p_name')} AS source_checksum,
           CASE WHEN p_partkey % 23 = 0 THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS verification_state,
           timestamp '1992-01-01 00:00:00' AS observed_at, timestamp '1992-01-02 00:00:00' AS fetched_at
    FROM {{part}} WHERE p_size % 5 <> 0"""


@derived("carriages", "lineitem")
def _(d):
    return """
    SELECT l_orderkey AS consist_id, l_linenumber AS position,
           'C' || cast(l_partkey as string) AS identifier, 20 + (l_partkey % 50) / 1e1 AS tare_t,
           l_quantity AS cargo_t,
           20 + (l_partkey % 50) / 1e1 + l_quantity + CASE WHEN l_suppkey % 20 = 0 THEN 0.5e0 ELSE 0e0 END AS gross_t,
           10 + (l_partkey % 80) / 1e1 AS length_m, 3 + (l_suppkey % 10) / 1e1 AS width_m,
           3.5e0 + (l_suppkey % 12) / 1e1 AS height_m, cast(4 + (l_suppkey % 2) * 2 as int) AS axles,
           cast(round(l_extendedprice * 100) as bigint) AS tie
    FROM {lineitem}"""


# --- observations --------------------------------------------------------------


@derived("obs", "events")
def _(d):
    k = f"cast({d.prop('props', 'k')} as int)"
    return f"""
    SELECT e.*, CASE WHEN event_type = 'error' THEN NULL ELSE seen END AS observed_at,
           {d.plus('seen', '(k % 40) * 30')} AS fetched_at,
           CASE user_id % 3 WHEN 0 THEN 'open_meteo' WHEN 1 THEN 'noaa_swpc' ELSE 'railradar' END AS provider_key,
           CASE WHEN event_type = 'error' THEN 'UNAVAILABLE' WHEN event_type = 'view' AND k > 80 THEN 'STALE'
                WHEN event_type = 'signup' THEN 'CACHED' ELSE 'LIVE' END AS status,
           event_type <> 'error' AND k <> 13 AS valid,
           CASE WHEN k % 17 = 0 THEN NULL ELSE -95 + ((event_id * 7919) % 1900) / 1e1 END AS lat,
           CASE WHEN k % 19 = 0 THEN NULL ELSE -185 + ((event_id * 104729) % 3700) / 1e1 END AS lon
    FROM (SELECT event_id, user_id, event_type, value, ts AS seen, {k} AS k FROM {{events}}) e"""


@derived("weather", "obs")
def _(d):
    # a current-weather reading per event
    return """
    SELECT event_id AS point_id, user_id AS route_id, seen, valid,
           cast((event_id * 31) % 100 as int) AS weather_code,
           -5 + ((event_id * 17) % 500) / 1e1 AS temperature_2m,
           cast((event_id * 13) % 101 as double) AS relative_humidity_2m,
           ((event_id * 11) % 300) / 1e1 AS wind_speed_10m,
           CASE WHEN event_id % 23 = 0 THEN NULL ELSE (event_id * 7) % 9000 + 0.25e0 END AS visibility,
           ((event_id * 5) % 120) / 1e1 AS uv_index, ((event_id * 3) % 90) / 1e1 AS precipitation,
           8 + ((event_id * 41) % 2800) / 1e2 AS lat, 68 + ((event_id * 43) % 2900) / 1e2 AS lon
    FROM {obs}"""


@derived("positions", "events")
def _(d):
    k = f"cast({d.prop('props', 'k')} as int)"
    return f"""
    SELECT event_id AS position_id, user_id AS shipment_id, ts AS observed_at,
           {d.plus('ts', f'({k} % 30) * 10')} AS received_at, value AS speed,
           CASE event_type WHEN 'error' THEN 'SIMULATED' WHEN 'click' THEN 'GPS' ELSE 'OPERATOR_INPUT' END AS source_type,
           18.80e0 + ((event_id * 41) % 300) / 1e3 AS lat, 72.80e0 + ((event_id * 43) % 300) / 1e3 AS lon,
           cast(CASE {k} % 6 WHEN 0 THEN 1 WHEN 1 THEN 5 WHEN 2 THEN 5 WHEN 3 THEN 0 WHEN 4 THEN 0 ELSE 15 END as int) AS nav_status
    FROM {{events}}"""


# --- model rows ----------------------------------------------------------------


@derived("features", "orders", "customer", "lineitem")
def _(d):
    # the 19 model inputs and the target, one row per order
    return f"""
    SELECT o_orderkey AS row_id, o_orderdate AS observation_time,
           CASE WHEN o_orderkey % 10 < 6 THEN 'REAL_HISTORICAL' WHEN o_orderkey % 10 = 6 THEN 'SIMULATED'
                WHEN o_orderkey % 10 = 7 THEN 'SEEDED' WHEN o_orderkey % 10 = 8 THEN 'OPERATOR_CONFIRMED'
                ELSE 'REAL_LIVE' END AS data_class,
           cast(o_custkey as string) AS route_id,
           'N' || cast(c_nationkey as string) || '-JNPT' AS corridor,
           f.*, CASE WHEN raw < 0 THEN 0e0 ELSE raw END AS remaining_delay_minutes
    FROM (SELECT o_orderkey, o_orderdate, o_custkey, c_nationkey,
             100 + (o_orderkey * 13) % 900 + 0e0 AS route_distance, cast(n as double) AS segment_count,
             cast((o_orderkey * 7) % 24 as double) AS departure_hour, cast((o_orderkey * 3) % 7 as double) AS day_of_week,
             cast(1 + (o_orderkey * 5) % 12 as double) AS month, ((o_orderkey * 17) % 400) / 1e1 + 0.0012345e0 AS current_delay,
             ((o_orderkey * 29) % 100) / 1e2 AS journey_progress, 45 + ((o_orderkey * 31) % 550) / 1e1 AS weather_score,
             ((o_orderkey * 37) % 120) / 1e1 AS rainfall, 14 + ((o_orderkey * 41) % 270) / 1e1 AS temperature,
             ((o_orderkey * 43) % 380) / 1e1 AS wind_speed, cast(1200 + (o_orderkey * 47) % 13800 as double) AS visibility,
             5 + ((o_orderkey * 53) % 800) / 1e1 AS corridor_congestion, 5 + ((o_orderkey * 59) % 850) / 1e1 AS station_pressure,
             10 + ((o_orderkey * 61) % 800) / 1e1 AS historical_delay, cast((o_orderkey * 67) % 3 as double) AS schedule_conflicts,
             10 + ((o_orderkey * 71) % 850) / 1e1 AS port_pressure, -180 + cast((o_orderkey * 73) % 660 as double) AS loading_window_delta,
             40 + q AS cargo_weight,
             10 + ((o_orderkey * 79) % 1500) / 1e1 + q / 10 AS raw
          FROM {{orders}} JOIN {{customer}} ON c_custkey = o_custkey
          JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS q FROM {{lineitem}} GROUP BY l_orderkey) l
            ON l_orderkey = o_orderkey) f"""


@derived("predictions", "orders", "customer")
def _(d):
    det = "5 + ((o_orderkey * 19) % 900) / 1e1"
    return f"""
    SELECT o_orderkey AS prediction_id, o_custkey AS user_id, o_custkey AS route_id,
           'delay_predictor' AS model_name, '1.' || cast(c_nationkey % 5 as string) AS model_version,
           o_orderdate AS predicted_at, {det} AS deterministic_value,
           CASE WHEN o_orderkey % 3 = 0 THEN {det} ELSE {det} + (o_orderkey % 21) - 10 END AS predicted_value,
           CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE {det} + ((o_orderkey * 23) % 260) / 1e1 - 12 END AS actual_value,
           CASE WHEN c_nationkey % 5 = 2 AND o_orderkey % 50 = 1 THEN 'SIMULATED' ELSE 'OPERATOR_CONFIRMED' END AS outcome_class
    FROM {{orders}} JOIN {{customer}} ON c_custkey = o_custkey"""


# --- classifier outcomes -----------------------------------------------------------


@derived("outcomes", "orders")
def _(d):
    # one judged case per order with six rules' answers and times
    return """
    SELECT o_orderkey AS case_id, 'fault_' || cast(o_orderkey % 9 as string) AS fault_type,
           o_orderkey % 5 = 0 AS expected_admissible,
           o_orderkey % 5 = 0 OR o_orderkey % 7 < 5 AS b0, o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 AS b1,
           (o_orderkey % 5 = 0 AND o_orderkey % 11 <> 0) OR o_orderkey % 4 = 1 AS b2,
           o_orderkey % 5 = 0 AND o_orderkey % 13 <> 0 AS b3, o_orderkey % 2 = 0 AS b4,
           o_orderkey % 5 = 0 AS full_gate,
           cast(round(o_totalprice * 100) as bigint) % 9973 / 1e3 AS latency_ms,
           CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN 'EVIDENCE_STALE|CHECKSUM_INVALID'
                ELSE 'EVIDENCE_STALE' END AS reason_codes
    FROM {orders}"""


# --- multimodal plans --------------------------------------------------------------


@derived("legs", "lineitem", "supplier")
def _(d):
    return """
    SELECT l_orderkey AS plan_id, l_linenumber AS seq, cast(round(l_extendedprice * 100) as bigint) AS tie,
           CASE l_suppkey % 3 WHEN 0 THEN 'RAIL' WHEN 1 THEN 'ROAD' ELSE 'SEA' END AS mode,
           'n' || cast((s_nationkey + l_linenumber) % 5 as string) AS origin,
           'N' || cast((s_nationkey + l_linenumber + 1 + (l_suppkey % 2) * (l_partkey % 3)) % 5 as string) AS destination,
           l_quantity * 10 AS distance_km, cast(l_quantity * 15 as int) AS minutes,
           CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE l_extendedprice END AS cost_amount,
           CASE WHEN l_suppkey % 6 = 0 THEN CASE WHEN l_partkey % 9 = 0 THEN 'OPERATOR_INPUT' ELSE 'UNAVAILABLE' END
                WHEN l_suppkey % 2 = 0 THEN 'VERIFIED_TARIFF' ELSE 'OPERATOR_INPUT' END AS cost_source_type,
           CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE cast(l_partkey % 90 as double) END AS risk_score,
           CASE WHEN l_partkey % 10 = 0 THEN 'UNAVAILABLE' WHEN l_partkey % 3 = 0 THEN 'LIVE_PROVIDER'
                WHEN l_partkey % 3 = 1 THEN 'OPERATOR_INPUT' ELSE 'DERIVED' END AS risk_source_type,
           CASE l_partkey % 40 WHEN 0 THEN 'BLOCKED' WHEN 1 THEN 'MANUAL_REVIEW' WHEN 2 THEN 'NOT_ASSESSED'
                WHEN 3 THEN 'WARNING' ELSE 'PASSED' END AS compliance_status,
           CASE WHEN l_suppkey % 4 = 3 THEN NULL ELSE l_partkey END AS check_id,
           CASE l_suppkey % 30 WHEN 0 THEN 'HARD_BLOCKED' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'WARNING'
                ELSE 'PASSED' END AS constraint_status,
           CASE WHEN l_suppkey % 25 = 0 THEN NULL ELSE 'carrier' END AS source_provider, 'tariff' AS source_dataset,
           CASE WHEN l_partkey % 31 = 0 THEN NULL ELSE 'ref' END AS source_reference,
           CASE WHEN l_partkey % 21 = 0 THEN NULL ELSE l_shipdate END AS source_observed_at
    FROM {lineitem} JOIN {supplier} ON s_suppkey = l_suppkey"""


@derived("checks", "part")
def _(d):
    return """
    SELECT p_partkey AS check_id, CASE p_size % 6 WHEN 0 THEN 'BLOCKED' WHEN 1 THEN 'WARNING'
           WHEN 2 THEN 'MANUAL_REVIEW' WHEN 3 THEN 'ODD' ELSE 'PASS' END AS overall_status
    FROM {part}"""


# --- texts as feeds carry them -------------------------------------------------------


@derived("clock_texts", "obs")
def _(d):
    two = "lpad(cast({} as string), 2, '0')".format
    hms = f"{two('k % 24')} || ':' || {two('k % 60')} || ':' || {two('event_id % 60')}"
    return f"""
    SELECT event_id, k,
           CASE event_id % 7 WHEN 0 THEN {hms} WHEN 1 THEN cast(k * 2 as string) || ':' || {two('k % 60')}
                WHEN 2 THEN '12:75' WHEN 3 THEN '2024-01-' || {two('1 + k % 28')} || 'T' || {hms} || '+05:30'
                WHEN 4 THEN '2024-02-' || {two('1 + k % 28')} || ' ' || {hms} || 'Z'
                WHEN 5 THEN '168:00:00' ELSE ' 9:05 ' END AS text
    FROM {{obs}}"""


@derived("evidence_times", "obs")
def _(d):
    # sources, observation times and expiries around a fixed moment
    keys = ["open_meteo", "noaa_swpc", "railradar", "aisstream", "maritime_feed", "ixigo_partner", "operator_input"]
    pick = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(keys))
    types = ["LIVE_PROVIDER", "OPERATOR_INPUT", "REPLAYED_SNAPSHOT", "CACHED_PROVIDER", "IMPORTED_DOCUMENT", "UNAVAILABLE"]
    tpick = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(types))
    base = "timestamp '2024-01-20 00:00:00'"
    return f"""
    SELECT event_id, CASE k % 8 {pick} ELSE NULL END AS source_key, CASE event_id % 6 {tpick} END AS source_type,
           CASE WHEN event_id % 11 = 0 THEN NULL ELSE {d.plus(base, '-((event_id * 37) % 40000) + 500')} END AS observed_at,
           {d.plus(base, '-((event_id * 37) % 40000) + 560')} AS fetched_at,
           CASE WHEN event_id % 3 = 0 THEN {d.plus(base, '(event_id * 13) % 9000 - 3000')} END AS valid_until,
           CASE k % 4 WHEN 0 THEN 'fresh' WHEN 1 THEN 'STALE' WHEN 2 THEN NULL ELSE 'AGING' END AS stored
    FROM {{obs}}"""


@derived("boards", "obs")
def _(d):
    # trains on station boards: a station per user, a board per day
    return """
    SELECT event_id, user_id AS corridor, user_id % 40 AS station, k % 3 AS reading,
           CASE WHEN event_type = 'error' THEN NULL ELSE cast(floor(value) as int) END AS delay,
           CASE WHEN event_type = 'click' THEN 'at-station' WHEN event_type = 'view' THEN NULL ELSE 'running' END AS live_type,
           CASE k % 9 WHEN 0 THEN 'UNAVAILABLE' WHEN 1 THEN 'CACHED' WHEN 2 THEN 'CACHED' ELSE 'LIVE' END AS source, observed_at
    FROM {obs}"""


@derived("readings", "boards")
def _(d):
    return """
    SELECT event_id, corridor, source, observed_at, cast(event_id % 9 as bigint) AS trains,
           coalesce(delay, 0) * 1e0 AS mean_delay, coalesce(delay, 0) AS max_delay
    FROM {boards}"""


@derived("trace_records", "lineitem")
def _(d):
    roles = ["CLEARANCE_DECISION", "WEATHER", "PORT_ALIGNMENT", "CONGESTION", "HISTORICAL_DELAY"]
    pick = " ".join(f"WHEN {i + 1} THEN '{r}'" for i, r in enumerate(roles))
    return f"""
    SELECT l_orderkey AS decision_id, l_orderkey * 1000 + l_linenumber * 100 + l_suppkey % 100 AS record_id,
           CASE l_linenumber {pick} ELSE NULL END AS role,
           CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE l_suppkey END AS source_id,
           CASE l_suppkey % 5 WHEN 0 THEN 'UNAVAILABLE' WHEN 1 THEN 'OPERATOR_INPUT' WHEN 2 THEN 'DERIVED' ELSE 'LIVE_PROVIDER' END AS source_type,
           CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE l_shipdate END AS fetched_at, l_partkey % 13 <> 0 AS has_value,
           CASE l_partkey % 5 WHEN 0 THEN 'FRESH' WHEN 1 THEN 'AGING' WHEN 2 THEN 'STALE' WHEN 3 THEN 'UNKNOWN' ELSE 'NOT_APPLICABLE' END AS freshness,
           CASE WHEN l_partkey % 7 = 0 THEN 'excluded' WHEN l_partkey % 11 = 0 THEN 'odd' END AS decision_use,
           l_returnflag <> 'N' AS used, CASE WHEN l_suppkey % 3 = 0 THEN 'stale input' END AS excluded_reason
    FROM {{lineitem}}"""


@derived("journey_legs", "lineitem", "routes")
def _(d):
    # journeys made of stored routes
    return """
    SELECT l.l_orderkey AS journey_id, l.l_linenumber * 1000000 + l.l_partkey AS leg_no, r.route_id, r.reliability_score,
           CASE l.l_partkey % 50 WHEN 0 THEN 'HARD_BLOCKED' WHEN 1 THEN 'UNAVAILABLE' WHEN 2 THEN 'ODD' WHEN 3 THEN 'HOLD' ELSE 'READY' END AS decision_state,
           CASE l.l_partkey % 50 WHEN 0 THEN 'HARD_BLOCKED' WHEN 7 THEN 'CAUTION' ELSE 'APPROVED' END AS status,
           r.estimated_hours,
           CASE WHEN l.l_partkey % 31 = 0 THEN NULL WHEN l.l_partkey % 6 = 0 THEN 'DEGRADED' ELSE 'HOT' END AS kit_status,
           CASE WHEN l.l_partkey % 31 = 0 THEN 0 ELSE 5 - l.l_partkey % 3 END AS traced,
           CASE WHEN l.l_partkey % 31 = 0 THEN 0 ELSE 5 END AS total
    FROM {lineitem} l JOIN {routes} r ON r.route_id = l.l_orderkey"""


@derived("lineage", "lineitem")
def _(d):
    # record n of an order feeds record n + 1
    rec = "{0}.l_orderkey * 1000 + {0}.l_linenumber * 100 + {0}.l_suppkey % 100".format
    return f"""
    SELECT DISTINCT {rec('a')} AS parent, {rec('b')} AS child,
           CASE a.l_partkey % 7 WHEN 0 THEN 'REFERENCES' WHEN 1 THEN 'EXCLUDED_FROM' WHEN 2 THEN 'INPUT_TO' WHEN 3 THEN 'VALIDATES'
                WHEN 4 THEN 'OVERRIDES' ELSE 'DERIVED_FROM' END AS relation
    FROM {{lineitem}} a JOIN {{lineitem}} b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"""


@derived("members", "trace_records")
def _(d):
    return "SELECT DISTINCT record_id, decision_id % 150 AS user_id FROM {trace_records} WHERE record_id % 4 <> 1"


@derived("sources", "supplier")
def _(d):
    return f"""
    SELECT s_suppkey AS source_id, 'src' || cast(s_suppkey as string) AS source_key, s_name AS display_name,
           s_suppkey % 12 <> 5 AS enabled, {d.sha("s_name || ':' || cast(s_nationkey as string)")} AS source_digest
    FROM {{supplier}} WHERE s_suppkey % 10 <> 9"""


@derived("chains", "legs")
def _(d):
    return """
    SELECT plan_id, min(origin) AS plan_origin, max(destination) AS plan_destination, min(tie) AS created_key FROM {legs} GROUP BY plan_id"""


# --- evidence of route decisions ------------------------------------------------------
# One decision per order and nine records per decision; the order's key modulo 40 picks one fault or none.

NOW = "timestamp '2024-01-20 00:00:00'"


@derived("ev_snapshots", "orders")
def _(d):
    return """
    SELECT o_orderkey AS snapshot_id, o_orderkey AS route_id, o_custkey AS user_id, 'R' || cast(o_orderkey as string) AS request_id,
           CASE o_orderkey % 40 WHEN 6 THEN 'HARD_BLOCKED' WHEN 26 THEN 'PENDING' ELSE 'APPROVED' END AS clearance_state,
           cast(round(o_totalprice * 100) as bigint) % 101 AS reliability_score,
           cast(50 + o_orderkey % 50 as double) AS weather, cast(40 + o_orderkey % 60 as double) AS port,
           cast(30 + o_orderkey % 70 as double) AS congestion, cast(20 + o_orderkey % 80 as double) AS historical,
           4 + (o_orderkey % 8) / 1e1 AS height, 3 + (o_orderkey % 5) / 1e1 AS width, cast(70 + o_orderkey % 50 as double) AS weight,
           's' || cast(o_orderkey % 7 as string) || ',s' || cast(10 + o_orderkey % 7 as string) AS segment_ids,
           'NGP' AS source_code, 'JNPT' AS destination_code
    FROM {orders}"""


def _value(d):
    t = "cast({} as string)".format
    day = f"'2024-01-19T23:55:00Z'"
    seg = (
        "'‹\"id\":\"' || {0} || '\",\"max_height\":6.5,\"max_width\":4.5,\"max_weight\":150,\"source_reference\":\"doc\",\"certified_by\":\"issuer\","
        "\"certified_at\":\"2024-01-01T00:00:00Z\",\"verified\":true,\"declared_checksum\":\"a\",\"computed_checksum\":\"a\",\"source_code\":\"' || {1} || '\",\"destination_code\":\"' || {2} || '\"›'"
    ).format
    s1 = seg("'s' || " + t("k % 7"), "'NGP'", "'MID'")
    s2 = seg("'s' || " + t("10 + k % 7"), "'MID'", "'JNPT'")
    num = lambda x: t(f"cast({x} as decimal(10,1))")
    return f"""CASE WHEN f = 25 AND no = 9 THEN '‹›'
      WHEN no = 1 THEN '‹"height":' || {num('height')} || ',"width":' || {num('width')} || ',"weight":' || {num('CASE WHEN f = 15 THEN weight + 1 ELSE weight END')} || '›'
      WHEN no = 2 THEN '‹"certification":"VERIFIED","segments":[' || {s1} || ',' || {s2} || ']›'
      WHEN no = 3 THEN '‹"status":"' || CASE WHEN f = 6 THEN 'HARD_BLOCKED' ELSE 'APPROVED' END || '"›'
      WHEN no = 4 THEN '‹"wind":‹"speed":' || {t('k % 30')} || '›,"main":‹"visibility":' || {t('1000 + k % 9000')} || '›,"weather":[‹"id":' || {t('200 + k % 600')} || '›]›'
      WHEN no IN (0, 5) THEN '‹"score":' || {num('weather')} || ',"provider_unavailable":false›'
      WHEN no = 6 THEN '‹"score":' || {num('CASE WHEN f = 24 THEN 150e0 ELSE port END')} || ',"available":true,"aligned":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END ||
           ',"port_id":"JNPT","vessel_id":"V' || {t('k % 90')} || '","evaluated_at":"2024-01-19T23:00:00Z","train_arrival_hours":' || {t('k % 40')} || ',"loading_window":‹"start":"2024-01-20T00:00:00Z","end":"2024-01-21T00:00:00Z"››'
      WHEN no = 7 THEN '‹"score":' || {num('congestion')} || ',"stations_live":' || {t('k % 4')} || ',"stations_total":4›'
      WHEN no = 8 THEN '‹"score":' || {num('CASE WHEN f = 20 THEN congestion + 1 ELSE congestion END')} || ',"static_score":55.5›'
      ELSE '‹"score":' || {num('historical')} || ',"segment_delay_hours":[0.5,' || {t('k % 3')} || ']›' END"""


def envelope(quote: str = "replace({0}, '\"', '\\\"')") -> str:
    """Canonical text of the 27 trust fields of a record, as the digest functions write it."""
    q = lambda c: f"coalesce('\"' || {quote.format(c)} || '\"', 'null')"
    n = lambda c: f"coalesce(cast({c} as string), 'null')"
    dec = lambda c: n(f"cast({c} as decimal(38,6))")
    fields = {
        "availability_state": q("availability"), "cache_hit": n("cache_hit"), "canonical_source_type": q("source_type"),
        "completeness": dec("completeness"), "confidence": dec("confidence"), "decision_input_role": q("role"),
        "decision_snapshot_id": n("snapshot_id"), "entity_key": q("entity_key"), "entity_type": q("entity_type"),
        "excluded_reason": q("excluded_reason"), "fetched_at": n("fetched_us"), "formula_reference": q("formula_reference"),
        "freshness_state_at_capture": q("freshness_state"), "id": n("record_id"), "metadata": q("metadata"),
        "observed_at": n("observed_us"), "raw_source_state": q("raw_state"), "request_id": q("request_id"),
        "route_id": n("route_id"), "source_id": q("source_id"), "transform_name": q("transform_name"),
        "transform_version": q("transform_version"), "used_in_decision": n("used"), "user_id": n("user_id"),
        "valid_until": n("valid_us"), "value_checksum": q("checksum"), "value_summary": q("value"),
    }
    return "'‹' || " + " || ',' || ".join(f"'\"{k}\":' || {v}" for k, v in fields.items()) + " || '›'"


def braced(sql: str) -> str:
    return sql.replace("‹", "{{").replace("›", "}}")


@derived("ev_records", "ev_snapshots")
def _(d):
    kinds = [
        (0, "WEATHER_SCORE", "'WEATHER'", "derived_engine", "DERIVED"), (1, "CARGO_DECLARATION", "NULL", "operator_input", "OPERATOR_INPUT"),
        (2, "ENGINEERING_LIMITS", "NULL", "imported_engineering", "IMPORTED_DOCUMENT"), (3, "CLEARANCE_RESULT", "'CLEARANCE_DECISION'", "derived_engine", "DERIVED"),
        (4, "WEATHER_OBSERVATION", "NULL", "open_meteo", "LIVE_PROVIDER"), (5, "WEATHER_SCORE", "'WEATHER'", "derived_engine", "DERIVED"),
        (6, "PORT_ALIGNMENT_SCORE", "'PORT_ALIGNMENT'", "maritime_feed", "LIVE_PROVIDER"), (7, "RAIL_CONGESTION_SIGNAL", "NULL", "railradar", "LIVE_PROVIDER"),
        (8, "CONGESTION_SCORE", "'CONGESTION'", "derived_engine", "DERIVED"), (9, "HISTORICAL_DELAY_SCORE", "'HISTORICAL_DELAY'", "derived_engine", "DERIVED"),
    ]
    rows = " UNION ALL ".join(
        f"SELECT {n} AS no, '{e}' AS entity_type, cast({r} as string) AS role, '{s}' AS src, '{t}' AS typ" for n, e, r, s, t in kinds)
    us = d.us(NOW)
    base = f"""
    SELECT k * 10 + no AS record_id, k AS snapshot_id, no, f, route_id, CASE WHEN f = 14 AND no = 5 THEN user_id + 1 ELSE user_id END AS user_id, request_id,
      CASE WHEN f = 12 AND no = 7 THEN 'x9' WHEN f = 13 AND no = 1 THEN NULL ELSE src END AS source_id, entity_type, entity_type || ':' || cast(k as string) AS entity_key, role,
      CASE WHEN f = 5 AND no = 3 THEN 'SEEDED_BASELINE' WHEN f = 21 AND no = 6 THEN 'OPERATOR_INPUT' ELSE typ END AS source_type,
      CASE WHEN typ = 'LIVE_PROVIDER' THEN 'LIVE' ELSE typ END AS raw_state,
      CASE WHEN f = 30 AND no = 4 THEN NULL WHEN f = 2 AND no = 4 THEN {us} - 5000000000 WHEN f = 29 AND no = 4 THEN {us} - 1500000000 ELSE {us} - 300000000 END AS observed_us,
      CASE WHEN f = 7 AND no = 4 THEN {us} + 900000000 ELSE {us} - 60000000 END AS fetched_us,
      CASE WHEN f = 27 AND no = 6 THEN {us} - 100000000 WHEN no = 6 THEN {us} + 3600000000 END AS valid_us,
      CASE WHEN typ = 'LIVE_PROVIDER' THEN 'FRESH' ELSE 'NOT_APPLICABLE' END AS freshness_state, false AS cache_hit, NOT (f = 11 AND no = 2) AS used,
      CASE WHEN f = 11 AND no = 2 THEN 'operator said so' END AS excluded_reason, CASE WHEN f = 9 AND no = 6 THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END AS availability,
      cast(NULL as double) AS confidence, CASE WHEN f = 10 AND no = 7 THEN 0.5e0 ELSE 1e0 END AS completeness, CASE WHEN typ = 'DERIVED' THEN 'engine' END AS transform_name,
      CASE WHEN typ = 'DERIVED' THEN '1.0.0' END AS transform_version, cast(NULL as string) AS formula_reference,
      CASE WHEN no = 2 AND f <> 28 THEN '‹"verified":true,"signature_verified":true,"issuer_authentication":"DETACHED_SIGNATURE"›' ELSE '‹›' END AS metadata,
      {_value(d)} AS value
    FROM (SELECT s.*, snapshot_id AS k, snapshot_id % 40 AS f, kinds.* FROM {{ev_snapshots}} s CROSS JOIN ({rows}) kinds) x
    WHERE NOT (f = 1 AND no = 5) AND (no <> 0 OR f = 8)"""
    sealed = f"SELECT b.*, {d.sha('value')} AS sealed_digest FROM ({base}) b"
    summed = f"SELECT c.*, CASE WHEN f = 3 AND no = 5 THEN 'tampered' ELSE sealed_digest END AS checksum FROM ({sealed}) c"
    quote = "replace({0}, '\"', '\\\\\"')" if d is SPARK else "replace({0}, '\"', '\\\"')"
    digests = f"SELECT e.*, {d.sha(envelope(quote))} AS envelope_digest FROM ({summed}) e"
    return braced(f"""
    SELECT g.*, CASE WHEN f = 4 AND no = 8 THEN 'tampered' ELSE envelope_digest END AS integrity_checksum,
      {d.at('observed_us')} AS observed_at, {d.at('fetched_us')} AS fetched_at, {d.at('valid_us')} AS valid_until FROM ({digests}) g""")


@derived("ev_edges", "ev_snapshots")
def _(d):
    rules = [
        (1, 3, "INPUT_TO", "true"), (2, 3, "VALIDATES", "f <> 16"), (4, 5, "DERIVED_FROM", "f <> 1"), (7, 8, "DERIVED_FROM", "true"), (2, 9, "DERIVED_FROM", "true"),
        (5, 4, "INPUT_TO", "f = 17"), (8, 8, "DERIVED_FROM", "f = 18"), (77, 9, "INPUT_TO", "f = 19"), (6, 9, "REFERENCES", "true"), (4, 0, "DERIVED_FROM", "f = 8"),
    ]
    # one pass over the decisions, each beside the fixed rules
    listed = " UNION ALL ".join(f"SELECT {i} AS i, {p} AS p, {c} AS c, '{r}' AS relation" for i, (p, c, r, _) in enumerate(rules))
    held = " ".join(f"WHEN {i} THEN {w}" for i, (*_, w) in enumerate(rules) if w != "true")
    return f"""
    SELECT snapshot_id, snapshot_id * 10 + p AS parent, snapshot_id * 10 + c AS child, relation
    FROM (SELECT snapshot_id, snapshot_id % 40 AS f FROM {{ev_snapshots}}) s CROSS JOIN ({listed}) rules WHERE CASE i {held} ELSE true END"""


@derived("ev_roots", "ev_records", "ev_edges")
def _(d):
    # digests of digests: per five leading hex digits, then per decision
    def tree(src, digest):
        leaf = f"SELECT snapshot_id, {d.sha(d.glued('dg'))} AS lf FROM (SELECT snapshot_id, {digest} AS dg FROM {src}) z GROUP BY snapshot_id, substring(dg, 1, 5)"
        return f"SELECT snapshot_id, {d.sha(d.glued('lf'))} AS top FROM ({leaf}) y GROUP BY snapshot_id"

    edge = d.sha("cast(parent as string) || '>' || cast(child as string) || ':' || relation")
    return f"""
    SELECT r.snapshot_id, CASE r.snapshot_id % 40 WHEN 22 THEN NULL WHEN 23 THEN 'tampered' ELSE {d.sha("r.top || coalesce(e.top, '')")} END AS root_checksum,
      {d.sha("r.top || coalesce(e.top, '')")} AS computed_root
    FROM ({tree('{ev_records}', 'envelope_digest')}) r LEFT JOIN ({tree('{ev_edges}', edge)}) e ON e.snapshot_id = r.snapshot_id"""


@derived("ev_sources", "supplier")
def _(d):
    # the source catalogue; one entry is switched off
    keys = ["open_meteo", "maritime_feed", "railradar", "operator_input", "imported_engineering", "derived_engine"]
    pick = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(keys))
    return f"SELECT CASE i {pick} END AS source_id, CASE i {pick} END AS catalogue_key, enabled FROM (SELECT s_suppkey % 6 AS i, s_suppkey % 6 <> 2 AS enabled FROM {{supplier}} GROUP BY s_suppkey % 6) g"


@derived("case_rows", "ev_records")
def _(d):
    return """
    SELECT snapshot_id AS case_id, record_id, f, no, user_id, source_id, entity_type,
           CASE WHEN snapshot_id % 6 = 1 AND no IN (1, 7) THEN 'SHARED' ELSE coalesce(role, entity_type) END AS role,
           CASE WHEN snapshot_id % 6 = 1 AND no IN (1, 7) THEN 'SHARED' WHEN f = 31 AND no = 3 THEN 'OTHER' ELSE coalesce(role, entity_type) END AS record_role,
           no IN (3, 6) AS link_required, source_type, used, excluded_reason,
           CASE source_type WHEN 'LIVE_PROVIDER' THEN CASE WHEN f = 13 AND no = 7 THEN 'LIVE' ELSE 'AUTHENTICATED_CONNECTOR' END WHEN 'IMPORTED_DOCUMENT' THEN 'AUTHENTICATED_IMPORT' ELSE raw_state END AS raw_state,
           NOT (f = 32 AND no = 4) AS connector_authenticated, f <> 28 AS signature_verified,
           CASE WHEN f = 33 THEN cast(snapshot_id + 1 as string) WHEN f = 34 THEN '' ELSE cast(snapshot_id as string) END AS bound_case_id,
           'ROUTE' AS bound_subject_type, CASE WHEN f = 35 AND no = 5 THEN 'other' ELSE request_id END AS bound_subject_key, 'ctx' AS bound_context_digest,
           integrity_checksum, envelope_digest, observed_at, fetched_at, valid_until, freshness_state, availability, completeness, value NOT IN ('{{}}', '') AS has_value,
           VALUE_DIGEST AS value_digest, CASE WHEN snapshot_id % 6 = 1 AND no IN (1, 7) THEN 'k' ELSE entity_key END AS entity_key,
           CASE WHEN source_id <> 'x9' THEN source_id END AS catalogue_id, NOT (f = 36 AND no = 6) AS enabled,
           CASE WHEN f = 37 THEN NULL WHEN source_type = 'LIVE_PROVIDER' THEN 3600 END AS stale_after_s,
           CASE WHEN snapshot_id % 6 = 1 AND no IN (1, 7) THEN 'X' ELSE entity_type END AS entity_kind
    FROM {ev_records} WHERE NOT (f = 38)""".replace("VALUE_DIGEST", d.sha("value"))


@derived("judged_cases", "ev_snapshots")
def _(d):
    return """
    SELECT snapshot_id AS case_id, CASE WHEN snapshot_id % 40 = 14 THEN user_id + 5 ELSE user_id END AS owner_id, 'ROUTE' AS subject_type, request_id AS subject_key, 'ctx' AS context_digest
    FROM {ev_snapshots}"""


@derived("documents_in", "lineitem")
def _(d):
    # shipment documents: one per order line
    return """
    SELECT l_orderkey AS check_id, cast(l_linenumber as bigint) * 1000000000 + cast(round(l_extendedprice * 100) as bigint) AS doc_no,
           CASE l_partkey % 6 WHEN 0 THEN 'permit' WHEN 1 THEN 'INSURANCE ' WHEN 2 THEN 'CARGO_DECLARATION' WHEN 3 THEN 'PERMIT' WHEN 4 THEN 'INSURANCE' ELSE 'OTHER' END AS document_type,
           CASE WHEN l_suppkey % 3 = 0 THEN 'n1' ELSE '' END AS document_number, CASE WHEN l_suppkey % 7 = 0 THEN 'c' END AS checksum,
           CASE WHEN l_suppkey % 5 = 0 THEN 's3' END AS storage_reference, CASE WHEN l_suppkey % 4 <> 1 THEN l_shipdate END AS expires_at,
           CASE WHEN l_suppkey % 11 = 0 THEN 'UNVERIFIED' ELSE 'VERIFIED' END AS verification_state
    FROM {lineitem}"""


@derived("speed_rows", "lineitem")
def _(d):
    kinds = ["ROUTE_LIMIT", "HEADWAY", "TRACK_GEOMETRY", "ENVIRONMENT", "ROUTE_LIMIT", "HEADWAY"]
    pick = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds))
    return f"""
    SELECT l_orderkey AS request_id, cast(l_linenumber as bigint) * 1000000000 + cast(round(l_extendedprice * 100) as bigint) AS constraint_no,
           CASE WHEN l_partkey % 29 = 0 THEN 'BRAKING' ELSE CASE l_linenumber % 6 {pick} END END AS category, 'limit ' || cast(l_linenumber as string) AS label,
           l_quantity * 4 + CASE WHEN l_suppkey % 47 = 0 THEN 600 ELSE 0 END AS limit_kph,
           CASE WHEN l_partkey % 31 = 0 THEN 'OPERATOR_INPUT' WHEN l_partkey % 37 = 0 THEN 'REPLAYED_SNAPSHOT' WHEN l_partkey % 2 = 0 THEN 'IMPORTED_DOCUMENT' ELSE 'AUTHORIZED_FEED' END AS source_type,
           CASE WHEN l_suppkey % 23 = 0 THEN 'SUPPLEMENTARY' ELSE 'AUTHORITATIVE' END AS authority_level,
           CASE WHEN l_suppkey % 43 = 0 THEN 'x' ELSE 'gazette' END AS source_reference, CASE WHEN l_suppkey % 41 = 0 THEN 'bad' ELSE {d.sha('l_returnflag')} END AS checksum,
           l_shipdate AS observed_at, {d.plus('l_shipdate', '(l_partkey % 50 - 1) * 60')} AS fetched_at,
           CASE WHEN l_suppkey % 53 = 0 THEN NULL ELSE {d.plus('l_shipdate', '(300 + l_suppkey) * 86400 * 10')} END AS valid_until
    FROM {{lineitem}}"""
