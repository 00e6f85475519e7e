"""Operators on small hand-made inputs: fixed vectors, brute force, skew and repeats."""

import bisect
import datetime as dt
import heapq
import json
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ballast.functions import clock, scoring
from ballast.operators import aggregates as agg
from ballast.operators import graph, intervals, nearest, ordered, statistics, windows
from ballast.sources import feeds, sinks, timetables
from ballast.streaming import observations as so

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize(
    "w,p,c,h,blocked,port,want",
    [
        (80, 90, 70, 60, False, True, 79), (100, 100, 100, 100, False, True, 100), (0, 0, 0, 0, False, True, 0),
        (100, 100, 100, 100, True, True, 0), (80, 0, 70, 60, False, False, 74), (55, 40, 90, 20, False, True, 51),
        (55, 40, 90, 20, False, False, 55),
    ],
)
def test_reliability_vectors(spark, w, p, c, h, blocked, port, want):
    port_col = F.lit(float(p)) if port else F.lit(None).cast("double")
    got = spark.range(1).select(scoring.reliability(F.lit(float(w)), port_col, F.lit(float(c)), F.lit(float(h)), F.lit(blocked))).first()[0]
    assert got == want


def test_clearance_passes_at_the_limit_and_blocks_above(spark):
    legs = spark.createDataFrame(
        [(1, 10, 0, 5.0, 3.0, 90.0, 5.0, 3.0, 90.0), (2, 20, 1, 5.001, 3.0, 90.0, 5.0, 3.0, 90.0), (2, 10, 0, 5.0, 3.0, 90.0, 5.0, 3.0, 90.0)],
        "route_id int, seg_id int, seq int, cargo_h double, cargo_w double, cargo_t double, max_h double, max_w double, max_t double")
    got = {r["route_id"]: (r["status"], r["blocking_segment"]) for r in agg.clearance(legs).collect()}
    assert got == {1: ("APPROVED", None), 2: ("HARD_BLOCKED", 20)}


def test_station_board_fixture(spark):
    trains = [{"live": {"type": k, "delayMinutes": d}} for k, d in (("at-station", 0), ("running", 45), ("running", 60), ("running", 15))]
    docs = spark.createDataFrame([("A", json.dumps({"success": True, "data": {"trains": trains}})), ("B", json.dumps({"success": False, "error": {"message": "slow down"}}))], "station string, text string")
    got = {r["station"]: r for r in feeds.station_boards(docs, ["station"]).collect()}
    assert (got["A"]["trains"], got["A"]["mean_delay"], got["A"]["max_delay"], got["A"]["at_station"]) == (4, 30.0, 60, 1)
    assert (got["B"]["source"], got["B"]["detail"]) == ("UNAVAILABLE", "slow down")


def test_service_times(spark):
    rows = [("25:10:00", 90600), ("7:05", 25500), ("168:00", None), ("12:60", None), (" 09:00:01 ", 32401)]
    df = spark.createDataFrame([(a,) for a, _ in rows], "t string")
    assert [r[0] for r in df.select(clock.service_seconds(F.col("t"))).collect()] == [b for _, b in rows]


# --- ordered computations -----------------------------------------------------------------


def skewed(n=4000, seed=3):
    rng = random.Random(seed)
    # one key holds a third of the rows
    return [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", rng.randrange(10_000), i, rng.choice([None, rng.randrange(50)])) for i in range(n)]


def test_scan_matches_a_plain_walk(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "k string, t int, i int, v int")
    steps = [ordered.Step("rank", "rank"), ordered.Step("run", "sum", F.coalesce("v", F.lit(0))), ordered.Step("top", "max", F.col("v")),
             ordered.Step("prev", "lag", F.col("v")), ordered.Step("last", "last", F.col("v"))]
    got = {r["i"]: r for r in ordered.scan(df, ["k"], ["t", "i"], ordered.number_slot("t", 500), steps).collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        run, top, prev, last = 0, None, None, None
        for n, (_, _, i, v) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])), 1):
            run += v or 0
            top = v if top is None else (top if v is None else max(top, v))
            last = last if v is None else v
            g = got[i]
            assert (g["rank"], g["run"], g["top"], g["prev"], g["last"]) == (n, run, top, prev, last)
            prev = v


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_percentiles_are_exact(spark, method):
    rng = random.Random(5)
    vals = [("hot", rng.choice([0.0, -3.5, 1e6, rng.gauss(0, 100)])) for _ in range(3001)] + [("one", 4.25)] + [("few", float(x)) for x in (3, 1, 2, 2)]
    df = spark.createDataFrame(vals, "k string, v double")
    got = {r["k"]: r for r in ordered.percentiles(df, ["k"], "v", {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}, method).collect()}
    for k in ("hot", "one", "few"):
        xs = sorted(v for g, v in vals if g == k)
        for name, p in (("a", 0.5), ("b", 0.95), ("c", 0.0), ("d", 1.0)):
            want = np.quantile(xs, p) if method == "linear" else xs[round((len(xs) - 1) * p)]
            assert math.isclose(got[k][name], want, rel_tol=1e-12, abs_tol=1e-12)


@pytest.mark.parametrize("method", ["linear", "nearest"])
def test_percentiles_of_crowded_values(spark, monkeypatch, method):
    """Values very near one another, very small ones, many equal ones and very large ones."""
    monkeypatch.setattr(ordered, "CELL_ROWS", 50)
    rng = np.random.default_rng(3)
    groups = {
        "near": 1000 + rng.random(20_000) * 1e-6, "small": rng.random(5_000) / 5000 - 1e-4, "tiny": 10.0 ** -rng.integers(3, 30, 3000).astype(float),
        "equal": np.concatenate((np.full(9_000, 7.25), 7.25 + rng.random(600) * 1e-9)), "wide": rng.normal(size=4000) * 10.0 ** rng.integers(-5, 200, 4000), "one": np.array([3.0]),
    }
    df = spark.createDataFrame([(k, float(x)) for k, xs in groups.items() for x in xs] + [("one", None), ("none", None)], "k string, v double")
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["k"]: r for r in ordered.percentiles(df, ["k"], "v", probs, method).collect()}
    assert set(got) == set(groups)
    for k, xs in groups.items():
        xs = np.sort(xs)
        for name, p in probs.items():
            at = (len(xs) - 1) * p
            low, high = int(np.floor(at)), int(np.ceil(at))
            want = xs[low] * (1 - (at - low)) + xs[high] * (at - low) if method == "linear" else xs[round(at)]
            assert math.isclose(got[k][name], want, rel_tol=1e-12), (k, name)


def test_quota_of_a_hot_key(spark):
    """A key with many stretches of stretches, beside small ones; all at the same time but for the id."""
    ordered.STRETCH_BITS, bits = 3, ordered.STRETCH_BITS
    try:
        rng = random.Random(6)
        rows = [("hot", T0, i, rng.choice(["spend", "spend", "refund"])) for i in range(5000)] + [(f"k{i % 7}", T0, 9000 + i, rng.choice(["spend", "refund"])) for i in range(60)]
        df = spark.createDataFrame(rows, "p string, at timestamp, i int, kind string")
        got = {r["i"]: (r["admitted"], r["used"]) for r in windows.quota_ledger(df, ["p"], ["at", "i"], 12).collect()}
    finally:
        ordered.STRETCH_BITS = bits
    use, want = {}, {}
    for p, _, i, kind in rows:
        u = use.get(p, 0)
        ok = kind == "refund" or u < 12
        use[p] = max(0, u - 1) if kind == "refund" else min(12, u + 1)
        want[i] = (ok, use[p])
    assert got == want
    assert windows.quota_ledger(df.limit(0), ["p"], ["at", "i"], 12).count() == 0


def test_balanced_rank(spark):
    df = spark.range(20000).selectExpr("case when id % 3 > 0 then 0 else id % 50 end k", "cast(hash(id) as long) t", "id")
    got = ordered.balanced_rank(df, ["k"], ["t", "id"], "n").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.k, r.t, r.id)):
        by[r.k] = by.get(r.k, 0) + 1
        assert r.n == by[r.k]
    assert len(got) == 20000


def test_quota_walk(spark):
    rng = random.Random(9)
    rows = [("p", T0 + dt.timedelta(minutes=i), i, "refund" if rng.random() < 0.4 else "spend") for i in range(600)]
    df = spark.createDataFrame(rows, "p string, at timestamp, i int, kind string")
    got = {r["i"]: (r["admitted"], r["used"]) for r in windows.quota_ledger(df, ["p"], ["at", "i"], 5).collect()}
    used = 0
    for _, _, i, kind in rows:
        ok = kind == "refund" or used < 5
        used = max(0, used - 1) if kind == "refund" else min(5, used + 1)
        assert got[i] == (ok, used)


# --- intervals --------------------------------------------------------------------------------


def random_intervals(seed, n=160):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        start = rng.randrange(0, 100_000)
        length = rng.choice([1, 30, 600, 5_000, 90_000])
        out.append(("hot" if i % 3 else "b", i % 60, i, start, start + length))
    return out


def test_overlap_join_finds_each_pair_once(spark):
    rows = random_intervals(1)
    df = spark.createDataFrame([(k, s, i, T0 + dt.timedelta(seconds=a), T0 + dt.timedelta(seconds=b)) for k, s, i, a, b in rows], "k string, s int, i int, lo timestamp, hi timestamp")
    got = intervals.overlap_join(df, df, ["k"], F.col("l.i") < F.col("r.i")).select("l.i", "r.i").collect()
    want = {(x[2], y[2]) for x in rows for y in rows if x[0] == y[0] and x[2] < y[2] and x[3] < y[4] and y[3] < x[4]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_least_partner_matches_brute_force(spark):
    rows = random_intervals(2)
    df = spark.createDataFrame([(k, i, T0 + dt.timedelta(seconds=a), T0 + dt.timedelta(seconds=b)) for k, _, i, a, b in rows], "k string, id int, lo timestamp, hi timestamp")
    got = {r["id"]: r["partner"] for r in intervals.least_partner(df, df, ["k"]).collect()}
    for k, _, i, a, b in rows:
        others = [y[2] for y in rows if y[0] == k and y[2] != i and a < y[4] and y[3] < b]
        assert got[i] == (min(others) if others else None)


def test_nearest_place_far_and_near(spark):
    rng = random.Random(4)
    places = [(i, rng.uniform(-60, 60), rng.uniform(-170, 170)) for i in range(40)]
    points = [(i, rng.uniform(-80, 80), rng.uniform(-175, 175)) for i in range(60)]
    p = spark.createDataFrame(points, "pid int, lat double, lon double")
    s = spark.createDataFrame(places, "sid int, lat double, lon double")
    got = {r["pid"]: r["sid"] for r in nearest.nearest_place(p, "pid", s, "sid", cell=1.0).collect()}

    def km(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(h))

    for a in points:
        best = min(places, key=lambda b: km(a, b))
        mine = next(b for b in places if b[0] == got[a[0]])
        # lines do not cross the date line, so only points nearer to their own side are compared
        if abs(best[2] - a[2]) < 180 and abs(mine[2] - a[2]) < 180:
            assert math.isclose(km(a, mine), km(a, best), rel_tol=1e-9)


# --- graphs -------------------------------------------------------------------------------------


def test_least_cost_paths_on_a_chain_with_shortcuts(spark):
    rng = random.Random(7)
    n = 60
    edges = [(i, i + 1, i, 1.0 + i % 3) for i in range(n - 1)] + [(a, b, 1000 + j, float(rng.randrange(2, 40))) for j, (a, b) in enumerate({tuple(sorted(rng.sample(range(n), 2))) for _ in range(90)})]
    df = spark.createDataFrame(edges, "src int, dst int, seg_id int, cost double")
    got = {r["dest"]: r["cost"] for r in graph.paths_from(df, spark.createDataFrame([(0,)], "source int")).collect()}
    dist, heap = {0: 0.0}, [(0.0, 0)]
    while heap:
        d, u = heapq.heappop(heap)
        for a, b, _, w in edges:
            if a == u and d + w < dist.get(b, math.inf):
                dist[b] = d + w
                heapq.heappush(heap, (d + w, b))
    assert got == {k: v for k, v in dist.items() if k}


def test_cycles_and_what_hangs_on_them(spark):
    e = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("g", 3, 2), ("g", 3, 4), ("h", 1, 2)], "group string, parent int, child int")
    assert {tuple(r) for r in graph.unpeeled(e).collect()} == {("g", 2), ("g", 3), ("g", 4)}


def test_failures_spread_only_through_derived_records(spark):
    e = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("g", 3, 4), ("g", 4, 5)], "group string, parent int, child int")
    bad = spark.createDataFrame([("g", 1)], "group string, record_id int")
    derived = spark.createDataFrame([("g", 2), ("g", 3), ("g", 5)], "group string, record_id int")
    assert {tuple(r) for r in graph.tainted_by(bad, e, derived).collect()} == {("g", 2, 1), ("g", 3, 1), ("g", 3, 2)}


# --- statistics ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("left,right", [(0, 0), (3, 5), (913, 40), (5, 200), (4000, 3900), (60_000, 59_700)])
def test_mcnemar_equals_integer_arithmetic(spark, left, right):
    df = spark.createDataFrame([("p", left, right)], "pair string, left_only bigint, right_only bigint")
    got = statistics.exact_mcnemar(df).first()
    n, tail = left + right, min(left, right)
    if n == 0:
        assert got["p"] == 1.0 and got["log10_p"] == 0.0
        return
    term = total = math.comb(n, tail)
    for k in range(tail, 0, -1):
        term = term * k // (n - k + 1)
        total += term
        if term == 0:
            break
    num, den = 2 * total, 1 << n
    want = 0.0 if num >= den else (math.log10(num) - n * math.log10(2))
    assert abs(got["log10_p"] - want) < 2e-6
    if want > -12:
        assert abs(got["p"] - min(1.0, float(Fraction(num, den)))) < 1e-9


def test_wilson_without_trials(spark):
    r = spark.range(1).select(statistics.wilson(F.lit(0).cast("bigint"), F.lit(0).cast("bigint")).alias("w")).first()["w"]
    assert (r["low"], r["high"]) == (0.0, 0.0)


# --- files and streams -----------------------------------------------------------------------------------


def test_strict_csv(spark, tmp_path):
    f = tmp_path / "stops.txt"
    f.write_text('﻿stop_id, stop_name \nA,"Halt, old"\n,\nB\nC,x,extra\n', encoding="utf-8")
    rows, bad = timetables.strict_csv(spark, str(f))
    assert rows.columns == ["stop_id", "stop_name"]
    assert [tuple(r) for r in rows.orderBy("stop_id").collect()] == [("A", "Halt, old"), ("B", None)]
    assert [tuple(r) for r in bad.collect()] == [("BAD_ROW", 1)]


def test_repeated_header_is_refused(spark, tmp_path):
    f = tmp_path / "x.txt"
    f.write_text("a,a\n1,2\n")
    with pytest.raises(ValueError):
        timetables.strict_csv(spark, str(f))


def test_reading_grows_stale_one_way(spark):
    from ballast.functions.freshness import evidence_freshness

    order = ["FRESH", "AGING", "STALE"]
    df = spark.range(0, 40_000, 700).select(evidence_freshness(F.timestamp_seconds(F.col("id") + 1_700_000_000), F.lit("noaa_swpc"), F.timestamp_seconds(F.lit(1_700_000_000))).alias("s"), "id")
    seen = [order.index(r["s"]) for r in df.orderBy("id").collect()]
    assert seen == sorted(seen) and bisect.bisect_left(seen, 2) < len(seen)


def test_stress_keeps_every_scenario(spark):
    routes = spark.createDataFrame([(1, 80), (2, 60)], "route_id int, reliability_score int")
    scenarios = spark.range(1500).selectExpr("id scenario", "cast(id % 2 as double) storm", "cast(id % 9 as double) kp", "cast(id % 3 as double) port")
    assert agg.stress_every_route(routes, scenarios).count() == 3000


def test_condition_report_covers_all_points(spark):
    points = spark.range(20).selectExpr("1 report", "cast(id as int) pos", "id < 10 valid", "0.0 lat", "0.0 lon")
    none = spark.createDataFrame([], "report int, pos int, type string")
    kp = spark.createDataFrame([(1, 2)], "report int, kp int")
    assert agg.condition_report(points, none, kp, "report").first().failures == 10
    assert agg.condition_report(points, none, kp, "report", first_points=8).first().failures == 0


def test_nearest_place_around_the_globe(spark):
    rng = random.Random(7)
    spots = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)] + [(100, 0.0, -179.95), (101, 0.0, 178.9), (102, 89.9, 10.0), (103, -89.9, -170.0)]
    asked = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(80)] + [(200, 0.0, 179.95), (201, 89.95, -171.0), (202, -89.8, 12.0), (203, 0.0, 180.0), (204, 0.0, -180.0)]

    def km(a, b):
        x, y, p, q = map(math.radians, (a[1], a[2], b[1], b[2]))
        h = math.sin((p - x) / 2) ** 2 + math.cos(x) * math.cos(p) * math.sin((q - y) / 2) ** 2
        return 2 * math.asin(math.sqrt(min(1, h)))

    p = spark.createDataFrame(asked, "pid int, lat double, lon double")
    s = spark.createDataFrame(spots, "sid int, lat double, lon double")
    for cell in (2.0, 7.0):
        got = {r.pid: r.sid for r in nearest.nearest_place(p, "pid", s, "sid", cell=cell).collect()}
        assert got == {a[0]: min(spots, key=lambda b: (km(a, b), b[0]))[0] for a in asked}


def test_untrusted_corridors(spark):
    rows = [(c, k, float(i), 0.0) for c, k, n in (("real", "REAL_LIVE", 30), ("few", "REAL_LIVE", 29), ("made", "REAL_LIVE", 30), ("made", "SYNTHETIC", 1)) for i in range(n)]
    got = statistics.residual_p90(spark.createDataFrame(rows, "corridor string, data_class string, y double, p double"), ["corridor"], "y", "p")
    assert {(r.corridor, r.rows, r.trusted) for r in got.collect()} == {("real", 30, True), ("few", 29, False), ("made", 31, False)}
