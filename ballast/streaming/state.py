"""Keyed state of streams: newest rows that expire with event time, and breakers of providers.

State lives in Spark's state store, so a micro-batch touches only the keys that it
holds, and a batch that is repeated after a failure starts from the state before
it. ``stored`` reads the state of a stopped or running stream as a table.

Rows travel as (order, tie, payload): two integers and a text, none of them null,
so that no value changes on its way through Python.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# the processors travel whole: the workers of a stream need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STATE = "at long, tie long, payload string"
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_NEVER = -(2**62)


def keyed_states(spark: SparkSession) -> None:
    """The state store that keeps large state on disk and has timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def key_of(columns: list[str]) -> Column:
    """The key as one text; null parts equal null parts."""
    return F.to_json(F.struct(*columns), {**_TIMES, "ignoreNullFields": "false"})


def carried(rows: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """Rows (key, event_time, at, tie, payload) for a processor; a row without a time is older than any other."""
    return rows.select(
        key_of(keys).alias("key"), F.col(time).cast("timestamp").alias("event_time"), F.coalesce(F.unix_micros(F.col(time).cast("timestamp")), F.lit(_NEVER)).alias("at"),
        F.coalesce(F.col(tie).cast("long"), F.lit(_NEVER)).alias("tie"), F.to_json(F.struct(*rows.columns), _TIMES).alias("payload"))


def restored(found: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows that ``carried`` packed."""
    return found.select(*[c for c in found.columns if c != "payload"], F.from_json("payload", schema, _TIMES).alias("_row")).select(
        *[c for c in found.columns if c != "payload"], "_row.*")


class Newest(StatefulProcessor):
    """Keeps each key's newest row and emits it when it changes.

    A key whose newest row lies further behind the watermark than the expiry
    leaves the state, and its row is emitted once more, marked as gone.
    """

    def __init__(self, expiry_s: int):
        self.expiry_ms = expiry_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = best = tuple(self.newest.get()) if self.newest.exists() else None
        for frame in rows:
            frame = frame[frame["at"] == frame["at"].max()]
            frame = frame[frame["tie"] == frame["tie"].max()]
            top = (int(frame["at"].iloc[0]), int(frame["tie"].iloc[0]), frame["payload"].max())
            best = top if best is None else max(best, top)
        if best == before:
            return
        if before is not None:
            self.handle.deleteTimer(self.due(before))
        self.handle.registerTimer(self.due(best))
        self.newest.update(best)
        yield self.row(key, best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.newest.exists():
            last = tuple(self.newest.get())
            self.newest.clear()
            yield self.row(key, last, True)

    def due(self, row: tuple) -> int:
        return max(0, row[0] // 1000 + self.expiry_ms)

    @staticmethod
    def row(key, row: tuple, gone: bool) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "at": [row[0]], "tie": [row[1]], "payload": [row[2]], "gone": [gone]})


def newest_states(rows: DataFrame, keys: list[str], time: str, tie: str, expiry_s: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """Stream of changes (key, at, tie, payload, gone) of the newest row per key, by time and then tie.

    ``delay`` is how late a row may come; with an expiry later ones are left out.
    Without an expiry the state is that of Spark's own aggregate, kept on the JVM;
    then a key's newest row comes with every batch that holds rows of the key.
    """
    packed = carried(rows, keys, time, tie)
    if expiry_s is None:
        newest = packed.groupBy("key").agg(F.max(F.struct("at", "tie", "payload")).alias("newest"))
        return newest.select("key", "newest.*", F.lit(False).alias("gone"))
    return packed.withWatermark("event_time", delay).groupBy("key").transformWithStateInPandas(
        Newest(expiry_s), "key string, at long, tie long, payload string, gone boolean", "Update", "EventTime")


class Breaker(StatefulProcessor):
    """A provider's failures since its last success, its last outcomes and its last status.

    The failures are kept one by one until a success is later than they are, so
    that attempts may come in any order. A success ends the list.
    """

    STATE = "failures long, failed_at long, success_at long, success_tie long, failure_at long, status_at long, status_tie long, status string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runtime = handle.getValueState("runtime", self.STATE)
        self.open = handle.getListState("open", "at long, tie long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, failed_at, s_at, s_tie, f_at, *last = tuple(self.runtime.get()) if self.runtime.exists() else (0, _NEVER, _NEVER, _NEVER, _NEVER, _NEVER, _NEVER, "")
        before, last, failed = (s_at, s_tie), tuple(last), []
        success = before
        for frame in rows:
            good = frame["payload"].str.startswith("1")
            pairs = list(zip(frame["at"].tolist(), frame["tie"].tolist(), strict=True))
            success = max([success, *(p for p, ok in zip(pairs, good, strict=True) if ok)])
            failed = [p for p in failed if p > success] + [p for p, ok in zip(pairs, good, strict=True) if not ok and p > success]
            f_at = max([f_at, *frame["at"][~good].tolist()])
            last = max([last, *((*p, x[1:]) for p, x in zip(pairs, frame["payload"], strict=True))])
        failed = [p for p in failed if p > success]
        if success > before:  # a late success may stand before failures already known
            failed += [p for p in (tuple(x) for x in self.open.get()) if p > success]
            failures, failed_at = 0, _NEVER
            self.open.clear()
        if failed:
            self.open.appendList(failed)
        state = (failures + len(failed), max([failed_at, *(at for at, _ in failed)]), *success, f_at, *last)
        self.runtime.update(state)
        yield pd.DataFrame([(key[0], *state)], columns=["key", "failures", "failed_at", "success_at", "success_tie", "failure_at", "status_at", "status_tie", "status"])


def breakers(attempts: DataFrame) -> DataFrame:
    """Stream of changes of each provider's runtime, from attempts (provider_key, at, seq, ok, status)."""
    mark = F.when(F.col("ok"), "1").otherwise("0")
    packed = attempts.select(F.col("provider_key").alias("key"), F.unix_micros("at").alias("at"), F.col("seq").cast("long").alias("tie"), F.concat(mark, F.coalesce("status", F.lit(""))).alias("payload"))
    return packed.groupBy("key").transformWithStateInPandas(Breaker(), f"key string, {Breaker.STATE}", "Update", "None")


def keep_states(changes: DataFrame, checkpoint: str) -> None:
    """Run a stream whose state alone is wanted on everything that has arrived, and stop."""
    q = changes.writeStream.format("noop").outputMode("update").trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
    q.awaitTermination()


def stored(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """The state of a stream as rows (key, columns of the state)."""
    held = spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)
    return held.select("key.key", "value.*")


def newest_stored(spark: SparkSession, checkpoint: str, schema: T.StructType) -> DataFrame:
    """The rows that ``newest_states`` holds, with the key's text."""
    kind = spark.read.format("state-metadata").load(checkpoint).select("operatorName").first()[0]
    if kind.startswith("transformWithState"):
        return restored(stored(spark, checkpoint, "newest"), schema)
    held = spark.read.format("statestore").load(checkpoint)  # the one value of a key is the greatest (at, tie, payload)
    return restored(held.select("key.key", F.col("value")[held.schema["value"].dataType.names[0]].alias("_newest")).select("key", "_newest.*"), schema)


def runtime_stored(spark: SparkSession, checkpoint: str, threshold: int) -> DataFrame:
    """Rows (provider_key, failures, opened_at, last_success_at, last_failure_at, status) that ``breakers`` holds."""
    time = lambda c: F.when(F.col(c) != _NEVER, F.timestamp_micros(F.col(c)))
    return stored(spark, checkpoint, "runtime").select(
        F.col("key").alias("provider_key"), "failures", F.when(F.col("failures") >= threshold, time("failed_at")).alias("opened_at"),
        time("success_at").alias("last_success_at"), time("failure_at").alias("last_failure_at"), "status")
