"""Inputs are derived, not written; searches get only the rows that they need."""

from pyspark.sql import functions as F

from ballast.functions.common import codes
from ballast.operators import conflicts
from ballast.plans import stand_ins

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_roles_are_derived_without_payloads(spark, monkeypatch):
    written = []
    monkeypatch.setattr(stand_ins, "cut", lambda df: written.append(df) or df, raising=False)
    t = stand_ins.Tables(spark, FOLDER)
    text = plan(t.ev_records.select("snapshot_id", "record_id", "role"))
    assert not written and "sha2" not in text and "segments" not in text


def test_edges_read_the_decisions_once(spark):
    text = plan(stand_ins.Tables(spark, FOLDER).ev_edges)
    assert text.count("Relation ") == 1


def test_codes_need_no_lambda(spark):
    x = F.col("x")
    df = spark.createDataFrame([(1,), (-1,), (None,)], "x int").select("x", codes((x > 0, "UP"), (x != 5, "OTHER, ONE"), (x < 0, "DOWN")).alias("c"))
    assert "lambda" not in plan(df)
    assert {r.x: r.c for r in df.collect()} == {1: ["UP", "OTHER, ONE"], -1: ["OTHER, ONE", "DOWN"], None: []}


def test_lone_trains_are_not_placed_in_blocks(spark, monkeypatch):
    seen, search = [], conflicts.least_partner
    monkeypatch.setattr(conflicts, "least_partner", lambda a, b, *x, **k: seen.append((a.count(), sorted(a.columns))) or search(a, b, *x, **k))
    src = "'IMPORTED_DOCUMENT' source_type, 'sheet' source_reference, sha2('x', 256) source_checksum, 'VERIFIED' verification_state, timestamp '2024-01-01' observed_at, timestamp '2024-01-01' fetched_at"
    at = "timestamp '2024-01-0{} 00:00:00'".format
    rows = [(1, 7, 1, 3), (1, 7, 2, 4), (2, 7, 2, 5), (3, 8, 1, 2), (4, None, 1, 2), (5, 9, 3, 4)]
    w = spark.sql(" union all ".join(
        f"select {s} schedule_id, cast({'null' if k is None else k} as bigint) section_id, 'forward' direction, {at(a)} entry_at, {at(b)} exit_at, {src}" for s, k, a, b in rows))
    s = spark.sql("select id schedule_id, 1 user_id, 'PLANNED' status from range(1, 7)")
    p = spark.sql(f"select id section_id, true single_track, 60d headway_s, {src} from range(7, 10)")
    out = {r.schedule_id: r for r in conflicts.schedule_statuses(s, w, p, "user_id").collect()}
    assert {k for k, r in out.items() if r.status == "BLOCKED"} == {1, 2}
    assert {(r.assessed_windows, r.assessed_schedules) for r in out.values()} == {(6, 6)}
    assert [n for n, _ in seen] == [3, 3]
