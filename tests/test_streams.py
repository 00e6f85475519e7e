"""Keyed stream state, daily tables and the ingest cycle: order, repeats, restarts and expiry."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from ballast.sources import sinks
from ballast.streaming import observations as so
from ballast.streaming import state

T0 = dt.datetime(2024, 1, 1)
BIG = 2**53 + 1


@pytest.fixture(autouse=True)
def rocks(spark):
    state.keyed_states(spark)


def put(spark, rows, form, path, files=1):
    df = spark.createDataFrame(rows, form)
    (df.repartition(files) if files > 1 else df.coalesce(1)).write.mode("append").parquet(path)


MESSAGES = "message_id long, vessel_id string, seen_at timestamp, note string"


def newest(rows, since=None):
    best = {}
    for r in rows:
        if r[2] is not None:
            best[r[1]] = max(best.get(r[1], (dt.datetime.min, -1, 0)), (r[2], r[0], r[3] or ""))
    return {(k, m, n) for k, (at, m, n) in best.items() if since is None or at > since}


def run(spark, folder, expiry=None, delay="30 days"):
    rows = so.file_stream(spark, f"{folder}/in", maxFilesPerTrigger="1")
    changes = state.newest_states(rows, ["vessel_id"], "seen_at", "message_id", expiry, delay)
    state.keep_states(changes, f"{folder}/cp")
    return {(r.vessel_id, r.message_id, r.note or "") for r in state.newest_stored(spark, f"{folder}/cp", rows.schema).collect()}


def messages(seed, n=300):
    rng = random.Random(seed)
    rows = [(seed * 1000 + i, f"v{rng.randrange(9)}", T0 + dt.timedelta(seconds=rng.randrange(5000)), rng.choice([None, "a", 'q"uote'])) for i in range(n)]
    return rows + [(BIG + seed, "big", T0 + dt.timedelta(seconds=seed, microseconds=7), None), (BIG + seed + 1, "big", T0 + dt.timedelta(seconds=seed, microseconds=7), None), (5, None, T0, None)]


def test_newest_rows_in_many_batches_with_a_restart_and_a_repeated_batch(spark, tmp_path):
    folder = str(tmp_path)
    first, second = messages(1), messages(2)
    put(spark, first, MESSAGES, f"{folder}/in", 4)
    assert run(spark, folder) == newest(first)
    put(spark, second, MESSAGES, f"{folder}/in", 3)
    assert run(spark, folder) == newest(first + second)
    commits = sorted((n for n in os.listdir(f"{folder}/cp/commits") if n.isdigit()), key=int)
    for name in (commits[-1], f".{commits[-1]}.crc"):  # as if the last batch had failed before its commit
        os.rename(f"{folder}/cp/commits/{name}", f"{folder}/lost{name}")
    assert run(spark, folder) == newest(first + second)


def test_newest_rows_without_an_expiry_need_no_python(spark, tmp_path):
    put(spark, messages(1), MESSAGES, f"{tmp_path}/in")
    rows = so.file_stream(spark, f"{tmp_path}/in")
    plan = lambda expiry: state.newest_states(rows, ["vessel_id"], "seen_at", "message_id", expiry)._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan(None) and "TransformWithState" in plan(60)


def test_silent_vessels_leave_the_state(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(i, f"v{i % 5}", T0 + dt.timedelta(minutes=i), None) for i in range(300)] + [(1000, "old", T0, None), (1001, "back", T0, None)]
    put(spark, rows, MESSAGES, f"{folder}/in")
    last = T0 + dt.timedelta(minutes=299)
    assert run(spark, folder, 45 * 60, "10 minutes") == newest(rows, last - dt.timedelta(minutes=55))
    more = [(2000, "back", T0 + dt.timedelta(minutes=400), None)]
    put(spark, more, MESSAGES, f"{folder}/in")
    assert run(spark, folder, 45 * 60, "10 minutes") == {("back", 2000, "")}


@pytest.mark.parametrize("order", ["forward", "backward", "mixed"])
def test_breakers_do_not_depend_on_the_order_of_batches(spark, tmp_path, order):
    rng = random.Random(13)
    rows = [(f"p{i % 3}", T0 + dt.timedelta(seconds=i), i, rng.random() < 0.15, f"S{i}") for i in range(120)]
    want = {}
    for p, at, _, ok, status in rows:
        n, opened, good, bad, _ = want.get(p, (0, None, None, None, None))
        want[p] = (0, None, at, bad, status) if ok else (n + 1, at, good, at, status)
    batches = [rows[i : i + 40] for i in range(0, 120, 40)]
    batches = {"forward": batches, "backward": batches[::-1], "mixed": [rows[1::2], rows[0::2]]}[order]
    for part in batches:
        put(spark, part, "provider_key string, at timestamp, seq int, ok boolean, status string", f"{tmp_path}/in")
        state.keep_states(state.breakers(so.file_stream(spark, f"{tmp_path}/in")), f"{tmp_path}/cp")
    got = {r.provider_key: (r.failures, r.opened_at, r.last_success_at, r.last_failure_at, r.status) for r in state.runtime_stored(spark, f"{tmp_path}/cp", 3).collect()}
    assert got == {p: (n, opened if n >= 3 else None, good, bad, status) for p, (n, opened, good, bad, status) in want.items()}


def test_breaker_states(spark):
    rows = spark.createDataFrame([("a", T0, "LIVE"), ("b", None, "RATE_LIMITED")], "provider_key string, opened_at timestamp, status string")
    at = lambda s: {r.provider_key: (r.state, r.next_attempt_at, r.rate_limited) for r in so.breaker_states(rows, F.lit(T0 + dt.timedelta(seconds=s))).collect()}
    assert at(119) == {"a": ("OPEN", T0 + dt.timedelta(seconds=120), False), "b": ("CLOSED", None, True)}
    assert at(120)["a"] == ("HALF_OPEN", None, False)


def daily(spark, tmp_path, rows):
    table = sinks.DailyTable(spark, str(tmp_path / "daily"), "at")
    for batch, part in enumerate(rows):
        table.append(spark.createDataFrame(part, "id long, at timestamp"), batch)
    return table


def test_daily_table_purges_to_the_second(spark, tmp_path):
    rows = [[(100 * b + i, T0 + dt.timedelta(hours=5 * i + b)) for i in range(60)] + [(1000 + b, None)] for b in range(3)]
    table = daily(spark, tmp_path, rows)
    table.append(spark.createDataFrame(rows[1], "id long, at timestamp"), 1)  # repeated
    flat = [r for part in rows for r in part]
    assert sorted(r.id for r in table.read().collect()) == sorted(i for i, _ in flat)
    now = T0 + dt.timedelta(days=9, hours=7)
    limit = now - dt.timedelta(days=5)
    old = [i for i, at in flat if at is not None and at < limit]
    assert table.purge(now, 5) == len(old) and table.purge(now, 5) == 0
    assert sorted(r.id for r in table.read().collect()) == sorted(i for i, _ in flat if i not in old)
    assert sorted(n for n in os.listdir(tmp_path / "daily") if n.startswith("day="))[0] == "day=2024-01-05"


def test_reading_days_opens_only_their_folders(spark, tmp_path):
    table = daily(spark, tmp_path, [[(i, T0 + dt.timedelta(days=i % 6)) for i in range(30)] + [(99, None)]])
    some = table.read([dt.date(2024, 1, 2), None], before=1)
    assert sorted(r.id for r in some.collect()) == [1, 7, 13, 19, 25, 99]
    files = some.inputFiles()
    assert {f.split("day=")[1].split("/")[0] for f in some.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]} == {"2024-01-02", "__HIVE_DEFAULT_PARTITION__"} and files
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert sinks.DailyTable(spark, str(tmp_path / "none"), "at").read() is None


OBS = "observation_id long, provider_key string, observation_type string, entity_id string, observed_at timestamp, fetched_at timestamp, status string, valid boolean, lat double, lon double, rain double, visibility double, wind_gusts_10m double"


def observation(i, minute, failed=False, day=0, rain=0.0):
    at = T0 + dt.timedelta(days=day, minutes=minute)
    return (i, "open_meteo", "WEATHER", None if i % 2 else "x", None if failed else at, at + dt.timedelta(minutes=1), "UNAVAILABLE" if failed else "LIVE", not failed, 1.0, 1.0, rain, 9000.0, 0.0)


def test_ingest_cycle(spark, tmp_path):
    cycle = so.IngestCycle(spark, str(tmp_path), ["rain"], ["provider_key", "observation_type", "entity_id"], ["observation_id"], days=5)
    batch = lambda *rows: spark.createDataFrame(list(rows), OBS)
    first = batch(observation(1, 0), observation(3, 0), observation(2, 0), observation(5, 3, failed=True), observation(7, 4, failed=True), observation(9, 9, rain=8.0))
    second = batch(observation(11, 0), observation(13, 60), observation(15, 4, failed=True), observation(17, 6, failed=True))
    for _ in range(2):  # a repeated batch changes nothing
        cycle(first, 0)
    for _ in range(2):
        cycle(second, 1)
    held = lambda: sorted(r.observation_id for r in cycle.observations.read().collect())
    assert held() == [1, 2, 5, 7, 9, 13, 17]  # the same reading once, each outage, the same outage once
    tally = [(r.stored, r.invalid, r.events, r.failures, r.expired) for r in cycle.counters().orderBy("batch").collect()]
    assert tally == [(5, 2, 3, 2, 0), (2, 1, 1, 2, 0)]
    cycle(batch(observation(21, 2, day=5)), 2)
    assert held() == [5, 7, 9, 13, 17, 21]  # five days before the last fetch
    assert cycle.counters().where("batch = 2").first().expired == 2
    plan = cycle.known([dt.date(2024, 1, 6)], 3)._jdf.queryExecution().executedPlan().toString()
    assert "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    cycle(batch(), 3)
    assert held() == [5, 7, 9, 13, 17, 21]


def test_a_batch_that_outlives_its_own_oldest_rows_is_counted_whole(spark, tmp_path):
    cycle = so.IngestCycle(spark, str(tmp_path), ["rain"], ["provider_key", "observation_type", "entity_id"], ["observation_id"], days=5)
    for _ in range(2):
        cycle(spark.createDataFrame([observation(i, i) for i in range(1, 8)] + [observation(9, 4, day=6), observation(11, 9, day=20)], OBS), 0)
    r = cycle.counters().first()
    assert (r.stored, r.events, r.expired) == (9, 0, 8)
    assert [x.observation_id for x in cycle.observations.read().collect()] == [11]
