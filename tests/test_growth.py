"""A task's share does not grow with the input, and closures and cases write narrow rows once."""

from pyspark.sql import functions as F

from ballast import session
from ballast.operators import cases, evidence, graph
from ballast.plans import stand_ins

FOLDER = "/root/testdata/sf0.001"
START = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_dealt_to_more_tasks_when_there_are_more(spark, monkeypatch):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert session.fan_out(spark.range(100), "id").rdd.getNumPartitions() == least
    monkeypatch.setattr(session, "FAN_ROWS", 5)
    assert session.fan_out(spark.range(100), "id").rdd.getNumPartitions() == 20


def test_a_task_gets_no_more_shuffled_bytes_than_named(spark):
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    try:
        for named, want in (("64MB", f"{session.TASK_BYTES}b"), ("8m", "8m")):
            spark.conf.set(key, named)
            stand_ins.Tables(spark, FOLDER)
            assert spark.conf.get(key) == want
    finally:
        spark.conf.set(key, before)


def test_shuffles_start_from_more_partitions_for_larger_tables(spark, monkeypatch):
    least = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(session, "PART_BYTES", 1000)
    t = stand_ins.Tables(spark, FOLDER)
    assert spark.conf.get(START) == least
    t.orders  # noqa: B018
    few = int(spark.conf.get(START))
    t.lineitem  # noqa: B018
    assert int(least) < few < int(spark.conf.get(START))
    stand_ins.Tables(spark, FOLDER)
    assert spark.conf.get(START) == least


def edges_of(spark, pairs):
    return spark.createDataFrame([(g, p, c, "DERIVED_FROM") for g, p, c in pairs], "group int, parent int, child int, relation string")


def test_closures_compute_their_seed_once(spark, monkeypatch):
    steps = graph.powers(edges_of(spark, [(1, i, i + 1) for i in range(9)] + [(2, 1, 1)]), "parent", "child")[0]
    written = []
    monkeypatch.setattr(graph, "cut", lambda df: written.append(df) or df)
    seed = spark.createDataFrame([(1, "a", 0), (1, "b", 7), (2, "a", 1), (3, "a", 5)], "group int, role string, record_id int")
    out = graph.reached(seed, steps[:3], "parent", "child")
    assert plan(out).count("LogicalRDD") == 1 and len(written) == 1
    assert {tuple(r) for r in out.collect()} == {(1, "a", i) for i in range(8)} | {(1, "b", 7), (1, "b", 8), (1, "b", 9), (2, "a", 1), (3, "a", 5)}


def test_failures_are_spread_by_one_closure(spark, monkeypatch):
    calls, powers = [], graph.powers
    monkeypatch.setattr(graph, "powers", lambda *a: calls.append(a) or powers(*a))
    e = edges_of(spark, [(1, 1, 2), (1, 2, 3), (1, 3, 4), (2, 1, 2)])
    bad = spark.createDataFrame([(1, 1)], "group int, record_id int")
    derived = spark.createDataFrame([(1, 2), (1, 3), (2, 2)], "group int, record_id int")
    out = {tuple(r) for r in graph.tainted_by(bad, e, derived).select("record_id", "ancestor").collect()}
    assert out == {(2, 1), (3, 1), (3, 2)} and len(calls) == 1


def test_joins_within_a_decision_need_no_shuffle(spark):
    t = stand_ins.Tables(spark, FOLDER)
    j = t.ev_edges.join(t.ev_records.select("snapshot_id", F.col("record_id").alias("parent")).hint("merge"), ["snapshot_id", "parent"], "left_semi")
    text = j._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "ENSURE_REQUIREMENTS" not in text
    stand_ins.Tables(spark, FOLDER)
    assert spark.conf.get(stand_ins.BY_DECISION) == "true"


def test_fingerprints_are_computed_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(evidence, "cut", lambda df: written.append(df) or session.cut(df))
    s = spark.createDataFrame([(1,), (2,), (2,)], "snapshot_id int")
    r = spark.createDataFrame([(1, "a", "a"), (2, "b", None)], "snapshot_id int, root_checksum string, computed_root string")
    out = evidence.bundle_fingerprints(s, r, F.lit("none"))
    assert sorted((x.snapshot_id, x.cases) for x in out.collect()) == [(1, 1), (2, 2), (2, 2)] and len(written) == 1


def test_judged_records_of_cases_leave_digests_behind(spark, monkeypatch):
    from ballast.plans import checked

    written = []
    monkeypatch.setattr(cases, "cut", lambda df: written.append(df.columns) or session.cut(df))
    checked.assessed(stand_ins.Tables(spark, FOLDER))
    assert not any(c.endswith(("digest", "checksum")) for cols in written for c in cols)


def test_realtime_documents_are_parsed_once(spark, monkeypatch):
    from ballast.sources import timetables

    docs = spark.createDataFrame([
        (1, '{"header":{"gtfs_realtime_version":"2.0"},"entity":[{"id":"a","vehicle":{"position":{"latitude":95.0,"longitude":1.0}}},{"id":"a","alert":{}}]}'),
        (2, "no json"), (3, None)], "doc_id int, text string")
    out = timetables.realtime_tables(docs)
    assert not any("from_json" in plan(df) for df in out.values())
    assert sorted(tuple(r) for r in out["violations"].collect()) == [(1, "DUPLICATE_ENTITY_ID"), (1, "POSITION_RANGE"), (2, "NO_VERSION"), (3, "NO_VERSION")]
    assert out["vehicle_positions"].count() == 1 and out["alerts"].count() == 1 and out["trip_updates"].count() == 0


def test_stop_times_are_parsed_once(spark, monkeypatch):
    from ballast.sources import timetables

    calls, seconds = [], timetables.service_seconds
    monkeypatch.setattr(timetables, "service_seconds", lambda x: calls.append(1) or seconds(x))
    one = lambda values, cols: spark.createDataFrame(values, ", ".join(f"{c} string" for c in cols.split()))
    raw = {
        "stops": one([("s", "S")], "stop_id stop_name"), "routes": one([("r",)], "route_id"), "trips": one([("r", "w", "t")], "route_id service_id trip_id"),
        "stop_times": one([("t", "s", "1", "7:00", "7:01"), ("t", "s", "2", "6:00", "x"), ("t", "s", "3", "8:00", "7:59")], "trip_id stop_id stop_sequence arrival_time departure_time")}
    found = timetables.static_violations(raw)
    assert "regexp_extract" not in plan(found) and "lambda" not in plan(found)
    assert sorted((r.key, r.field, r.code, r.n) for r in found.collect()) == [("t|2", "departure_time", "BAD_TIME", 1), ("t|3", "departure_time", "BAD_TIME", 1)]


def test_only_edges_that_go_on_are_squared(spark, monkeypatch):
    written, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(cut(df)) or written[-1])
    # many short lineages, one chain and one ring
    pairs = [(g, 0, c) for g in range(50) for c in (1, 2)] + [(99, 0, 1), (99, 1, 2), (99, 2, 3), (98, 0, 1), (98, 1, 0), (98, 1, 5)]
    e = edges_of(spark, pairs)
    ids = spark.createDataFrame([(g, n) for g in (*range(50), 98, 99) for n in range(6)], "group int, record_id int")
    direct = spark.createDataFrame([(g, "r", 2) for g in range(50)] + [(99, "r", 3)], "group int, role string, record_id int")
    got = {tuple(r) for r in graph.ancestors(direct, e, ids).collect()}
    assert got == {(g, "r", n) for g in range(50) for n in (0, 2)} | {(99, "r", n) for n in range(4)}
    assert {tuple(r) for r in graph.unpeeled(e).collect()} == {(98, 0), (98, 1), (98, 5)}
    bad = spark.createDataFrame([(1, 0), (99, 0)], "group int, record_id int")
    assert {tuple(r) for r in graph.tainted(bad, e, ids).collect()} == {(1, 1), (1, 2), (99, 1), (99, 2), (99, 3)}
    squared = [df.count() for df in written if set(df.columns) == {"group", "parent", "child"}]
    assert max(squared) < 10


def test_findings_write_records_once(spark, monkeypatch):
    from ballast.plans import checked

    written = []
    monkeypatch.setattr(cases, "cut", lambda df: written.append(df.columns) or session.cut(df))
    found = checked.assessed(stand_ins.Tables(spark, FOLDER))[2]
    assert len(written) == 4 and sum("record_id" in cols and "role" in cols for cols in written) == 2
    assert plan(found).count("Relation ") == 1


def test_payloads_that_no_rule_reads_are_not_parsed(spark):
    from ballast.plans import decisions

    t = stand_ins.Tables(spark, FOLDER)
    text = plan(decisions.rows(t, evidence.CONTEXT_KINDS).select("record_id", "v"))
    assert "CASE WHEN entity_type" in text.split("from_json")[0].splitlines()[-1]
    r = spark.createDataFrame([
        (1, "CLEARANCE_DECISION", 1, '{"status":"APPROVED"}'), (1, "WEATHER", 2, '{"status":"APPROVED"}'), (2, "CLEARANCE_DECISION", 3, "no"), (2, None, 4, None)],
        "snapshot_id int, role string, record_id int, value string")
    r = r.selectExpr(
        "*", "timestamp '2024-01-01' fetched_at", "timestamp '2024-01-01' observed_at", "timestamp '2030-01-01' valid_until", "sha2(value, 256) checksum", "1d completeness",
        "'AVAILABLE' availability", "'FRESH' freshness_state", "'LIVE_PROVIDER' source_type", "true used", "cast(null as string) excluded_reason")
    s = spark.createDataFrame([(1, 70), (2, 70), (3, 70)], "snapshot_id int, reliability_score int")
    seen = []
    cut, evidence.cut = evidence.cut, lambda df: seen.append(plan(df)) or cut(df)
    try:
        out = evidence.baselines(s, r, F.lit("2024-01-20").cast("timestamp"), quorum=2)
    finally:
        evidence.cut = cut
    assert {x.snapshot_id: (x.b2, x.b4) for x in out.collect()} == {1: (True, True), 2: (False, False), 3: (False, False)}
    assert "CASE WHEN (role" in seen[0].split("from_json")[0].splitlines()[-1]
