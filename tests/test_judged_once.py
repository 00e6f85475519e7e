"""Decisions and cases are judged where asked and written once, on tables made here."""

import datetime

import pytest

from ballast import session
from ballast.operators import cases, evidence, graph
from ballast.plans import checked, stand_ins
from ballast.plans.registry import QUERIES


@pytest.fixture
def folder(spark, tmp_path):
    """Eighty orders, two of them sought by customers, who also name one that is not there."""
    at = datetime.datetime(2024, 1, 1)
    put = lambda rows, cols, name: spark.createDataFrame(rows, cols).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    put([(k, k % 7, "O", k * 3.25, at, "1") for k in range(1, 81)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string", "orders")
    put([(k, "c", 1, 0.0, "m") for k in (2, 3, 3, 99, None)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", "customer")
    put([(k, f"s{k}", 1, 0.0) for k in range(1, 13)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double", "supplier")
    return str(tmp_path)


def test_only_requested_decisions_are_judged(spark, folder, monkeypatch):
    whole = {r.snapshot_id: (r.decision_state, r.kit_status, r.reason_codes) for r in QUERIES["evd_01_decision_gate"](spark, folder).collect()}
    written = []
    monkeypatch.setattr(evidence, "cut", lambda df: written.append(session.cut(df)) or written[-1])
    got = sorted(((r.request_no, (r.decision_state, r.kit_status, r.reason_codes)) for r in QUERIES["evd_01_requested_decisions"](spark, folder).collect()), key=str)
    gone = ("UNAVAILABLE", "UNAVAILABLE", "NO_STORED_DECISION_EVIDENCE")
    assert got == [(2, whole[22]), (3, whole[33]), (3, whole[33]), (99, gone), (None, gone)]
    assert {r.snapshot_id for r in written[0].collect()} == {22, 33}


def test_lines_of_cases_are_written_once(spark, folder, monkeypatch):
    written = []
    monkeypatch.setattr(cases, "cut", lambda df: written.append(session.cut(df)) or written[-1])
    found = checked.assessed(stand_ins.Tables(spark, folder))[2]
    lines = [df for df in written if {"parent", "child"} <= set(df.columns)]
    assert len(lines) == 1 and not {"value_digest", "role"} & set(lines[0].columns)
    cyclic = {r.record_id for r in found.where("code = 'DERIVED_LINEAGE_CYCLE'").collect()}
    assert cyclic == {174, 175, 188, 574, 575, 588}
    # what rests on a cycle is not also said to rest on an invalid record
    assert not cyclic & {r.record_id for r in found.where("code = 'DERIVED_LINEAGE_INVALID'").collect()}


def test_failures_pass_along_edges_that_all_lead_to_derived_records(spark):
    e = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 4), (2, 1, 2)], "group int, parent int, child int")
    bad = spark.createDataFrame([(1, 1)], "group int, record_id int")
    assert {tuple(r) for r in graph.tainted(bad, e.where("child < 4")).collect()} == {(1, 2), (1, 3)}


def test_seals_share_what_was_judged(spark, folder, monkeypatch):
    written = []
    monkeypatch.setattr(checked, "cut", lambda df: written.append(df.columns) or session.cut(df))
    monkeypatch.setattr(cases, "cut", lambda df: written.append(df.columns) or session.cut(df))
    out = {r.case_id: r.code for r in QUERIES["evd_14_verified_seals"](spark, folder).collect()}
    assert sum("severity" in cols for cols in written) == 1 and sum({"_r", "_f"} <= set(cols) for cols in written) == 1
    code = lambda k: "UNSEALED" if k % 13 == 5 else "ALTERED" if k % 9 == 4 and k % 40 != 38 else "SEALED"
    assert out == {k: code(k) for k in range(1, 81)}
