"""Row and table contracts. Each returns violation codes, never an exception, so that whole tables are judged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.functions.common import codes, finite, seconds_between
from ballast.functions.digest import REDACTED, is_sensitive
from ballast.functions.vocab import (
    FEATURES,
    RAW_STATES,
    SENSITIVE_FRAGMENTS,
    SENSITIVE_KEYS,
    SENSITIVE_PARAMETERS,
)

# --- names and redaction -----------------------------------------------------------


def snake(name: str) -> str:
    out = "".join(ch if ch.isascii() and (ch.isalnum()) else " " for ch in name.strip().casefold())
    return "_".join(out.split())


def _snake_type(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(snake(f.name), _snake_type(f.dataType), f.nullable) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_snake_type(kind.elementType), kind.containsNull)
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _snake_type(kind.valueType), kind.valueContainsNull)
    return kind


def snake_columns(df: DataFrame) -> DataFrame:
    """All column names, nested ones too, in snake case."""
    return df.select(*[
        F.col(f"`{f.name}`").cast(_snake_type(f.dataType)).alias(snake(f.name)) for f in df.schema.fields
    ])


def _redacted(value: Column, kind: T.DataType, hides, hides_key, leaf) -> Column:
    if isinstance(kind, T.StructType):
        fields = [
            (F.when(value[f.name].isNotNull(), F.lit(REDACTED)) if hides(f.name)
             else _redacted(value[f.name], f.dataType, hides, hides_key, leaf)).alias(f.name)
            for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _redacted(x, kind.elementType, hides, hides_key, leaf))
    if isinstance(kind, T.MapType):
        if isinstance(kind.valueType, T.StringType):
            return F.transform_values(value, lambda k, v: F.when(hides_key(k), F.lit(REDACTED)).otherwise(leaf(v, kind.valueType)))
        # other values cannot carry the mark: they are dropped to null under a hidden key
        return F.transform_values(value, lambda k, v: F.when(~hides_key(k), _redacted(v, kind.valueType, hides, hides_key, leaf)))
    return leaf(value, kind)


def redact_exact(df: DataFrame) -> DataFrame:
    """Values under exactly named credential keys (after snake casing) replaced, at any depth."""
    hides = lambda n: snake(n) in SENSITIVE_KEYS
    plain = lambda k: F.regexp_replace(F.regexp_replace(F.lower(F.trim(k)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    hides_key = lambda k: plain(k).isin(*SENSITIVE_KEYS)
    return df.select(*[
        (F.lit(REDACTED) if hides(f.name) else _redacted(F.col(f"`{f.name}`"), f.dataType, hides, hides_key, lambda v, k: v)).alias(f.name)
        for f in df.schema.fields
    ])


def redact_fragments(df: DataFrame) -> DataFrame:
    """Values under keys that contain a credential word replaced; doubles to 6 places, dates and decimals as text."""
    pattern = "(?i)" + "|".join(SENSITIVE_FRAGMENTS)

    def leaf(v, kind):
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.round(v, 6)
        if isinstance(kind, (T.TimestampType, T.DateType, T.DecimalType)):
            return v.cast("string")
        return v

    return df.select(*[
        (F.lit(REDACTED) if is_sensitive(f.name)
         else _redacted(F.col(f"`{f.name}`"), f.dataType, is_sensitive, lambda k: k.rlike(pattern), leaf)).alias(f.name)
        for f in df.schema.fields
    ])


def redact_url(url: Column) -> Column:
    """Credential parameters of a URL's query masked; everything else is kept."""
    names = "|".join(p.replace("-", "[-]") for p in SENSITIVE_PARAMETERS)
    return F.regexp_replace(url, rf"(?i)([?&](?:{names})=)[^&#]*", "$1%5BREDACTED%5D")


def source_state(raw: Column) -> Column:
    """Canonical source type of a provider's raw state."""
    text = F.upper(F.coalesce(raw, F.lit("")))
    out = F.lit("DERIVED")
    for kind, states in RAW_STATES.items():
        out = F.when(text.isin(*states), kind).otherwise(out)
    return out


# --- observations --------------------------------------------------------------------


def observation_codes(asof: Column, numbers: list[str]) -> Column:
    c = F.col
    return codes(
        (seconds_between(c("observed_at"), asof) > 300, "FUTURE_TIMESTAMP"),
        (~c("lat").between(-90, 90), "LATITUDE_RANGE"), (~c("lon").between(-180, 180), "LONGITUDE_RANGE"),
        *[(c(n).isNotNull() & ~finite(c(n)), f"NOT_FINITE:{n}") for n in numbers],
    )


def scoring_codes(wind: Column, visibility: Column, weather: Column) -> Column:
    ok = lambda x: F.coalesce(finite(x) & (x >= 0), F.lit(False))
    listed = weather.isNotNull() & (F.size(weather) > 0) & F.forall(weather, lambda x: x >= 0)
    return codes((~ok(wind), "WIND"), (~ok(visibility), "VISIBILITY"), (~F.coalesce(listed, F.lit(False)), "CONDITIONS"))


# Fields a current-weather reading must have, with their range.
CURRENT_FIELDS = {
    "weather_code": (0, 99), "temperature_2m": (None, None), "relative_humidity_2m": (0, 100),
    "wind_speed_10m": (0, None), "visibility": (0, None), "uv_index": (0, None),
}


def current_weather_codes() -> Column:
    """Missing, non-numeric and out-of-range fields of a reading whose fields are text or numbers."""
    out = []
    for name, (low, high) in CURRENT_FIELDS.items():
        raw, v = F.col(name), F.col(name).try_cast("double")
        out += [(raw.isNull(), f"MISSING:{name}"), (raw.isNotNull() & ~F.coalesce(finite(v), F.lit(False)), f"NOT_NUMERIC:{name}")]
        if low is not None:
            out.append((v < low, f"RANGE:{name}"))
        if high is not None:
            out.append((v > high, f"RANGE:{name}"))
    return codes(*out)


# --- JSON bounds ---------------------------------------------------------------------

MAX_BYTES, MAX_DEPTH, MAX_NODES = 65_536, 16, 4_096


def json_bounds(text: Column, max_bytes: int = MAX_BYTES, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> Column:
    """Why a JSON text may not be stored, or null.

    NOT_JSON (null and empty texts too), NOT_FINITE, NOT_OBJECT, TOO_MANY_NODES,
    TOO_DEEP, TOO_LARGE: the first that holds. Nodes are the root, every key and
    every value; the root is at depth 0. Bytes are those of the text as written,
    without white space between tokens.
    """
    # the text as the only element of an array: nothing may follow it
    boxed = F.concat(F.lit("["), text, F.lit("]"))
    parsed = lambda finite_only: F.from_json(boxed, "array<string>", {"allowNonNumericNumbers": str(not finite_only).lower(), "allowSingleQuotes": "false"})
    space = r"[ \t\r\n]+"
    # every string becomes one letter; escapes go first, so that no quote is left inside
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\[\s\S]", ""), '"[^"]*"', "s"), space, "")
    single = lambda x: F.coalesce(F.size(x) == 1, F.lit(False)) & (F.get(x, F.lit(0)).isNotNull() | (bare == "null"))
    strings = F.regexp_extract_all(F.regexp_replace(text, r"\\[\s\S]", "ee"), F.lit('"[^"]*"'), F.lit(0))
    size = F.octet_length(bare) + F.aggregate(strings, F.lit(0), lambda n, x: n + F.octet_length(x) - 1)
    full = F.regexp_replace(bare, r"\[\]|\{\}", "s")
    step = lambda x: F.when(x.isin("[", "{"), 1).otherwise(-1)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("most"), F.lit(0).alias("least"))

    def walk(brackets):
        marks = F.filter(F.split(F.regexp_replace(brackets, r"[^\[\]{}]", ""), ""), lambda x: x != "")
        return F.aggregate(marks, start, lambda s, x: F.struct(
            (s["at"] + step(x)).alias("at"), F.greatest(s["most"], s["at"] + step(x)).alias("most"), F.least(s["least"], s["at"] + step(x)).alias("least")))

    count = lambda where, letters: F.length(where) - F.length(F.translate(where, letters, ""))
    # a container with c commas of its own holds c + 1 children, an empty one is a letter by now
    nodes = 1 + count(full, ",") + count(full, "[{") + count(full, ":")
    huge = F.exists(F.regexp_extract_all(bare, F.lit(r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"), F.lit(0)), lambda x: x.rlike("[.eE]") & ~finite(x.try_cast("double")))
    closed = walk(bare)["least"] >= 0
    return F.coalesce(
        F.when(~F.coalesce(single(parsed(False)) & closed, F.lit(False)), "NOT_JSON")
        .when(~single(parsed(True)) | huge, "NOT_FINITE").when(~bare.startswith("{"), "NOT_OBJECT")
        .when(nodes > max_nodes, "TOO_MANY_NODES").when(walk(full)["most"] > max_depth, "TOO_DEEP").when(size > max_bytes, "TOO_LARGE"))


# --- keys, consists, occupation --------------------------------------------------------


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Missing and repeated values of a key that must be unique."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    code = F.when(F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == "", "MISSING").when(F.col("n") > 1, "DUPLICATE")
    return n.select(F.col(key).cast("string").alias("key"), "n", code.alias("code")).where("code is not null")


def carriage_codes() -> Column:
    c = F.col
    return codes(
        (F.abs(c("gross_t") - c("tare_t") - c("cargo_t")) > 0.001 + 1e-9, "GROSS_MISMATCH"),
        ((c("tare_t") <= 0) | (c("gross_t") <= 0) | (c("cargo_t") < 0), "WEIGHT_RANGE"),
        ((c("length_m") <= 0) | (c("width_m") <= 0) | (c("height_m") <= 0), "SIZE_RANGE"),
        (~c("axles").between(1, 64), "AXLE_RANGE"), (~c("position").between(1, 4096), "POSITION_RANGE"),
        (F.coalesce(F.trim("identifier"), F.lit("")) == "", "IDENTIFIER_MISSING"),
    )


def manifest_violations(carriages: DataFrame, declared: DataFrame) -> DataFrame:
    """Breaches of each consist's carriage list: (consist_id, code)."""
    g = carriages.groupBy("consist_id").agg(
        F.count("*").alias("n"), F.count_distinct("identifier").alias("ids"), F.count_distinct("position").alias("places"),
        F.min("position").alias("lo"), F.max("position").alias("hi"),
        F.bool_or(F.size(carriage_codes()) > 0).alias("bad"),
    )
    c = F.col
    return declared.join(g, "consist_id").select("consist_id", F.explode(codes(
        (c("bad"), "CARRIAGE_INVALID"), (c("ids") < c("n"), "IDENTIFIER_REPEATED"), (c("places") < c("n"), "POSITION_REPEATED"),
        ((c("places") == c("n")) & ((c("lo") != 1) | (c("hi") != c("n"))), "POSITIONS_NOT_CONTIGUOUS"), (c("n") != c("declared"), "COUNT_MISMATCH"),
    )).alias("code"))


def occupation_violations(windows: DataFrame, consists: DataFrame) -> DataFrame:
    """Breaches of each schedule's occupation windows: (schedule_id, code).

    ``consists`` give each schedule's summed carriage length.
    """
    c = F.col
    g = windows.join(consists, "schedule_id", "left").groupBy("schedule_id").agg(
        F.bool_or(~(c("exit_at") > c("entry_at"))).alias("times"), F.bool_or(c("fetched_at") < c("observed_at")).alias("fetched"),
        F.count("*").alias("n"), F.count_distinct("seq").alias("k"), F.min("seq").alias("lo"), F.max("seq").alias("hi"),
        F.bool_or(F.abs(c("train_length_m") - c("consist_length_m")) > 0.001 + 1e-9).alias("length"),
        F.bool_or(c("consist_length_m").isNull()).alias("unknown"),
    )
    return g.select("schedule_id", F.explode(codes(
        (c("times"), "EXIT_NOT_AFTER_ENTRY"), (c("fetched"), "FETCHED_BEFORE_OBSERVED"), (c("k") < c("n"), "SEQUENCE_REPEATED"),
        ((c("k") == c("n")) & ((c("lo") != 0) | (c("hi") != c("n") - 1)), "SEQUENCE_NOT_CONTIGUOUS"),
        (c("length"), "TRAIN_LENGTH_MISMATCH"), (c("unknown"), "CONSIST_MISSING"),
    )).alias("code"))


def policy_codes() -> Column:
    c = F.col
    return codes(
        (c("single_track") & c("headway_s").isNull(), "SINGLE_TRACK_WITHOUT_HEADWAY"), (c("headway_s") < 0, "HEADWAY_RANGE"),
        (c("fetched_at") < c("observed_at"), "FETCHED_BEFORE_OBSERVED"),
    )


def certification_codes(asof: Column, issuers: list[str]) -> Column:
    """``certified_by`` against an explicit list and ``certified_at`` (text with an offset) against the clock."""
    names = [i.strip().casefold() for i in issuers if i.strip()]
    if not names:
        raise ValueError("trusted issuers must be named")
    zoned = F.trim("certified_at").rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    at = F.when(zoned, F.try_to_timestamp(F.trim("certified_at")))
    return codes(
        (~F.coalesce(F.lower(F.trim("certified_by")).isin(*names), F.lit(False)), "ISSUER_NOT_ALLOWED"),
        (at.isNull(), "CERTIFIED_AT_INVALID"), (at > asof, "CERTIFIED_IN_FUTURE"),
    )


# --- models ------------------------------------------------------------------------------


def out_of_range(rows: DataFrame, bounds: DataFrame, features=FEATURES) -> DataFrame:
    """Rows with the names of features outside the fitted range; empty where a prediction may be used.

    ``bounds`` has one row per feature, so its one-row form is at most a few numbers.
    """
    wide = bounds.groupBy().pivot("feature", list(features)).agg(F.first("low").alias("lo"), F.first("high").alias("hi"))
    j = rows.crossJoin(F.broadcast(wide))
    tests = [
        F.when((F.col(f) < F.col(f"{f}_lo")) | (F.col(f) > F.col(f"{f}_hi")), F.lit(f)) for f in features
    ]
    return j.withColumn("outliers", F.array_compact(F.array(*tests))).drop(*[f"{f}_{s}" for f in features for s in ("lo", "hi")])


# --- plans and constraints ------------------------------------------------------------------


def leg_codes() -> Column:
    c = F.col
    full = c("source_provider").isNotNull() & c("source_dataset").isNotNull() & c("source_reference").isNotNull()
    evidenced = c("risk_source_type").isin(
        "LIVE_PROVIDER", "PUBLIC_OPEN_DATA", "CACHED_PROVIDER", "SEEDED_BASELINE", "DERIVED", "SIMULATED")
    timed = c("risk_source_type").isin("LIVE_PROVIDER", "PUBLIC_OPEN_DATA", "CACHED_PROVIDER")
    no_cost, no_risk = c("cost_source_type") == "UNAVAILABLE", c("risk_source_type") == "UNAVAILABLE"
    return codes(
        (no_cost & c("cost_amount").isNotNull(), "COST_WITHOUT_SOURCE"), (~no_cost & c("cost_amount").isNull(), "COST_SOURCE_WITHOUT_COST"),
        (no_risk & c("risk_score").isNotNull(), "RISK_WITHOUT_SOURCE"), (~no_risk & c("risk_score").isNull(), "RISK_SOURCE_WITHOUT_RISK"),
        (c("compliance_status").isin("PASSED", "WARNING", "BLOCKED") & c("check_id").isNull(), "STATUS_WITHOUT_CHECK"),
        ((c("cost_source_type") == "VERIFIED_TARIFF") & ~full, "TARIFF_REFERENCE_MISSING"),
        (evidenced & ~full, "RISK_REFERENCE_MISSING"), (timed & c("source_observed_at").isNull(), "RISK_TIME_MISSING"),
    )


def constraint_codes() -> Column:
    """Evidence behind a speed constraint or, with category BRAKING, behind brake performance."""
    c = F.col
    authoritative = c("authority_level") == "AUTHORITATIVE"
    brakes = c("category") == "BRAKING"
    return codes(
        (~F.coalesce(c("checksum").rlike("^[A-Fa-f0-9]{64}$"), F.lit(False)), "CHECKSUM_INVALID"),
        (F.coalesce(F.length("source_reference"), F.lit(0)) < 3, "REFERENCE_MISSING"),
        (c("observed_at").isNull() | c("fetched_at").isNull() | c("valid_until").isNull(), "TIME_MISSING"),
        (c("observed_at") > c("fetched_at"), "OBSERVED_AFTER_FETCHED"),
        (c("source_type").isin("PUBLIC_OPEN_DATA", "CACHED_PROVIDER", "OPERATOR_INPUT") & authoritative, "AUTHORITY_NOT_ALLOWED"),
        (brakes & ~authoritative, "BRAKES_NOT_AUTHORITATIVE"),
        (brakes & ~c("source_type").isin("AUTHORIZED_FEED", "IMPORTED_DOCUMENT"), "BRAKE_SOURCE_NOT_ALLOWED"),
        (~brakes & ~((c("limit_kph") > 0) & (c("limit_kph") <= 500)), "LIMIT_RANGE"),
    )


def violations(df: DataFrame, keys: list[str], found: Column) -> DataFrame:
    """One row per code of a code column."""
    return df.select(*keys, F.explode(found).alias("code"))


def run_violations(rows: DataFrame, classifiers: list[str], source_digest: str, expected_rows: int) -> DataFrame:
    """Checks of a judged run's text rows in one pass: (code, n)."""
    c = F.col
    flags = reduce(lambda a, b: a | b, [~c(k).isin("True", "False") for k in classifiers])
    per = rows.groupBy("case_fingerprint_sha256").agg(
        F.count("*").alias("k"), F.count_if(F.length("case_fingerprint_sha256") != 64).alias("odd"),
        F.count_if(c("source_snapshot_manifest_sha256") != source_digest).alias("src"),
        F.count_if(~c("expected_admissible").isin("True", "False")).alias("lab"), F.count_if(flags).alias("cls"),
    ).agg(F.sum("odd").alias("FINGERPRINT_INVALID"), F.sum(c("k") - 1).alias("FINGERPRINT_REPEATED"), F.sum("src").alias("SOURCE_DIGEST_MISMATCH"),
          F.sum("lab").alias("LABEL_INVALID"), F.sum("cls").alias("CLASSIFIER_INVALID"), F.abs(F.sum("k") - expected_rows).alias("CASE_COUNT_MISMATCH"))
    names = ["FINGERPRINT_INVALID", "FINGERPRINT_REPEATED", "SOURCE_DIGEST_MISMATCH", "LABEL_INVALID", "CLASSIFIER_INVALID", "CASE_COUNT_MISMATCH"]
    each = F.array(*[F.struct(F.lit(n).alias("code"), c(n).alias("n")) for n in names])
    return per.select(F.explode(each).alias("x")).select("x.*").where("n > 0")
