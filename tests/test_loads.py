"""Loads that are refused as a whole, and the rows that tell why."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ballast.operators import checks
from ballast.operators import statistics as st
from ballast.sources import files, timetables

GOOD = ("a", "b", "5", "4", "100", "1.5", "0.25", "[[1,2],[3,4]]", "operator_input", "ref", "Issuer", "2024-01-01T00:00:00+05:30")
COLUMNS = ["source_code", "destination_code", "max_height", "max_width", "max_weight", "congestion_factor", "historical_delay_hours",
           "geometry_lon_lat", "source_type", "source_reference", "certified_by", "certified_at"]


def load(spark, *rows):
    segments = spark.createDataFrame([("A", "B", 1.0, 1.0, 1.0, 1.0, 0.0), ("C", "D", 2.0, 2.0, 2.0, 1.0, 0.0)], "src_code string, dst_code string, max_h double, max_w double, max_t double, factor double, delay_h double")
    frame = spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in COLUMNS))
    out, bad = files.load_engineering(segments, frame, F.lit("2025-01-01T00:00:00Z").cast("timestamp"), ["ISSUER"])
    return {r.src_code: (r.max_h, r.factor, r.engineering_digest is not None) for r in out.collect()}, sorted((r.segment, r.code) for r in bad.collect())


def test_load_without_faults_is_applied(spark):
    assert load(spark, GOOD) == ({"A": (5.0, 1.5, True), "C": (2.0, 1.0, False)}, [])


@pytest.mark.parametrize("at, value, code", [
    (1, "z", "UNKNOWN_SEGMENT"), (2, "-1", "LIMIT_NOT_POSITIVE"), (3, "NaN", "LIMIT_NOT_POSITIVE"), (5, "x", "NUMBER_INVALID"), (6, "Infinity", "NUMBER_INVALID"),
    (7, "[[1,2]]", "TOO_FEW_POINTS"), (7, "[[1,2],[3]]", "POINT_INVALID"), (8, "guess", "UNTRUSTED_SOURCE_TYPE"), (9, " ", "CERTIFICATION_MISSING"), (10, "Other", "ISSUER_NOT_ALLOWED"),
    (11, "2024-01-01T00:00:00", "CERTIFIED_AT_INVALID"), (11, "2026-01-01T00:00:00Z", "CERTIFIED_IN_FUTURE")])
def test_one_fault_leaves_all_segments(spark, at, value, code):
    wrong = (*GOOD[:at], value, *GOOD[at + 1 :])
    sound = ("C", "D", *GOOD[2:])
    segments, bad = load(spark, sound, wrong)
    assert segments == {"A": (1.0, 1.0, False), "C": (2.0, 1.0, False)}
    assert code in {c for _, c in bad}


def test_repeated_and_empty_loads(spark):
    old = {"A": (1.0, 1.0, False), "C": (2.0, 1.0, False)}
    assert load(spark, GOOD, GOOD) == (old, [("A->B", "DUPLICATE_SEGMENT")])
    segments, bad = load(spark)
    assert (segments, bad) == (old, [("", "NO_ROWS")])


def test_csv_rows_through_quotes(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('"id, of it",name\n1,"two\nlines, ""quoted"""\n2,x,y\n3\n,\n', encoding="utf-8-sig")
    rows, bad = timetables.strict_csv(spark, str(path), multiline=True)
    assert rows.columns == ["id, of it", "name"]
    assert sorted((r[0], r[1]) for r in rows.collect()) == [("1", 'two\nlines, "quoted"'), ("3", None)]
    # a wide row stays refused when only some columns are read
    assert sorted(r[0] for r in rows.select("`id, of it`").collect()) == ["1", "3"]
    assert [(r.code, r.n) for r in bad.collect()] == [("BAD_ROW", 1)]
    assert [(r.key, r.code, r.fields, r.line.strip()) for r in timetables.refused_rows(spark, str(path), multiline=True).collect()] == [("2", "BAD_ROW", 3, "2,x,y")]


def test_static_violations(spark):
    table = lambda rows, cols: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols.split()))
    raw = {
        "stops": table([("s1", "a"), ("s2", "b"), ("s2", "b"), (None, "c")], "stop_id stop_name"),
        "routes": table([("r1", "3"), ("r2", "-3")], "route_id route_type"),
        "trips": table([("r1", "w", "t1"), ("r9", "w", "t2"), (None, "w", "t3")], "route_id service_id trip_id"),
        "stop_times": table([
            ("t1", "s1", "1", "8:00", "8:05"), ("t1", "s2", "2", "8:04", "8:10"), ("t1", "s2", "2", "8:30", "8:30"), ("t1", "s1", "3", "9:00", "8:59"), ("t2", "s1", "1", "168:00", "8:05"),
            ("t9", "s9", "1", "25:00", "26:00"), ("t2", "s1", "x", "8:00", None)], "trip_id stop_id stop_sequence arrival_time departure_time"),
    }
    got = sorted((r.member, r.key, r.field, r.code, r.n) for r in timetables.static_violations(raw).collect())
    assert got == sorted([
        ("stops", "", "stop_id", "MISSING_FIELD", 1), ("stops", "s2", "stop_id", "DUPLICATE_ID", 2), ("routes", "r2", "route_type", "BAD_VALUE", 1),
        ("trips", "r9", "route_id", "BAD_REFERENCE", 1), ("trips", "t3", "route_id", "MISSING_FIELD", 1),
        ("stop_times", "t9", "trip_id", "BAD_REFERENCE", 1), ("stop_times", "s9", "stop_id", "BAD_REFERENCE", 1),
        ("stop_times", "t1|2", "stop_sequence", "BAD_ORDER", 2), ("stop_times", "t1|2", "arrival_time", "BAD_ORDER", 1), ("stop_times", "t1|3", "departure_time", "BAD_TIME", 1),
        ("stop_times", "t2|1", "arrival_time", "BAD_TIME", 1), ("stop_times", "t2|x", "stop_sequence", "BAD_VALUE", 1), ("stop_times", "t2|x", "departure_time", "MISSING_FIELD", 1)])
    empty = {k: v.limit(0) for k, v in raw.items()}
    assert timetables.static_violations(empty).count() == 0


def test_withheld_reasons_of_a_request_without_anything(spark):
    times = "observed_at timestamp, fetched_at timestamp, valid_until timestamp, source_type string"
    requests = spark.sql("select 1L as request_id, timestamp'2024-01-01' as evaluation_at")
    constraints = spark.createDataFrame([], f"request_id long, constraint_no long, category string, label string, limit_kph double, authority_level string, {times}")
    brakes = spark.createDataFrame([], f"request_id long, reaction_s double, deceleration double, margin_m double, {times}")
    got = sorted((r.kind, r.label or "", r.code) for r in checks.withheld_reasons(requests, constraints, brakes).collect())
    assert got == [("REASON", "", "BRAKING_MISSING"), ("REASON", "", "NO_CONSTRAINTS"), ("REASON", "HEADWAY", "CATEGORY_MISSING"), ("REASON", "ROUTE_LIMIT", "CATEGORY_MISSING")]


def test_missing_gates(spark):
    frame = spark.sql("select map('minimum_real_rows', true, 'minimum_corridors', false, 'minimum_coverage_days', cast(null as boolean)) as g")
    assert frame.select(st.missing_gates(F.col("g"))).first()[0] == [
        "minimum_corridors", "minimum_coverage_days", "missing:beats_deterministic_by_10_pct", "missing:no_forbidden_feature_leakage", "missing:no_synthetic_test_rows"]


def recorded(spark, folder, feeds, authority="NONE", pin=None):
    text = json.dumps({"operational_authority": authority, "feeds": feeds}).encode()
    (folder / "manifest.json").write_bytes(text)
    rows = files.inspect_recorded(spark, str(folder), "manifest.json", pin or hashlib.sha256(text).hexdigest().upper()).collect()
    return {r.local_filename: (r.manifest_valid, r.checksum_valid, r.codes) for r in rows}


def test_recorded_bytes_against_a_pinned_manifest(spark, tmp_path):
    def feed(name, body=None, **other):
        if body is not None:
            (tmp_path / name).write_bytes(body)
        known = body if body is not None else b"lost"
        return {"source_key": "k", "local_filename": name, "byte_length": len(known), "sha256": hashlib.sha256(known).hexdigest(), **other}

    sound = [feed("a.bin", b"\x00\xff" * 5000), feed("empty", b"")]
    assert recorded(spark, tmp_path, sound) == {"a.bin": (True, True, ""), "empty": (True, False, "")}
    assert recorded(spark, tmp_path, sound, pin="0" * 64)["a.bin"] == (False, False, "")
    assert recorded(spark, tmp_path, sound, authority="SIGNALLING")["a.bin"] == (True, False, "AUTHORITY_CLAIMED")
    wrong = [feed("gone"), feed("b.bin", b"b", byte_length=2), feed("c.bin", b"c", sha256="0" * 64), feed("d.bin", b"d", sha256="x"), {**feed("a.bin", b"a"), "local_filename": "../a.bin"}]
    assert recorded(spark, tmp_path, wrong) == {
        "gone": (True, False, ""), "b.bin": (True, False, ""), "c.bin": (True, False, ""), "d.bin": (True, False, "DIGEST_FORM"), "../a.bin": (True, False, "UNSAFE_NAME")}
    assert recorded(spark, tmp_path, []) == {None: (True, False, "FEED_COUNT")}
    assert {r.codes for r in files.inspect_recorded(spark, str(tmp_path), "other.json", "0" * 64).collect()} == {"MANIFEST_MISSING"}
