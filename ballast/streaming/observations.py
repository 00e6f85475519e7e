"""Observation streams: labelling, quarantine, de-duplication, events and the ingest cycle.

Streams run as micro-batches whose outputs are keyed by batch number, so a
batch that is repeated after a failure overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.functions.common import codes
from ballast.functions.freshness import observation_age, observation_freshness
from ballast.operators.contracts import observation_codes
from ballast.session import zoned
from ballast.sources.sinks import RETENTION_DAYS, DailyTable
from ballast.streaming import state

# Fresh and stale limits in seconds of the polled providers.
PROVIDER_LIMITS = {"open_meteo": (900, 3600), "noaa_swpc": (1800, 10800)}
DEFAULT_PROVIDER_LIMITS = (900, 3600)
# Breaker threshold and pause.
THRESHOLD, COOLDOWN_S = 3, 120


def file_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream over the Parquet files of a table, present and to come."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    # as a glob the path may name a folder of files or a single file
    return zoned(reader.parquet(f"{path[:-1]}[{path[-1]}]"))


def run_available(writer, checkpoint: str) -> None:
    """Process everything that has arrived and stop."""
    q = writer.trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
    q.awaitTermination()


def labelled(obs: DataFrame, asof: Column | None = None) -> DataFrame:
    """Freshness label and age of each observation, judged at ``asof`` or when it was fetched."""
    now = F.col("fetched_at") if asof is None else asof
    fresh, stale = F.lit(DEFAULT_PROVIDER_LIMITS[0]), F.lit(DEFAULT_PROVIDER_LIMITS[1])
    for key, (f, s) in PROVIDER_LIMITS.items():
        fresh = F.when(F.col("provider_key") == key, f).otherwise(fresh)
        stale = F.when(F.col("provider_key") == key, s).otherwise(stale)
    o = F.col("observed_at")
    return obs.withColumns({
        "freshness": observation_freshness(now, o, fresh, stale),
        "age_s": F.when(o.isNotNull(), observation_age(now, o)),
    })


def judged(obs: DataFrame, numbers: list[str], asof: Column | None = None) -> DataFrame:
    """Labelled observations with their error codes; late rows stay, rows from the future do not."""
    now = F.col("fetched_at") if asof is None else asof
    return labelled(obs, asof).withColumn("errors", observation_codes(now, numbers))


def split_quarantine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where(F.size("errors") == 0), rows.where(F.size("errors") > 0)


def observation_key(fields: list[str]) -> Column:
    """Digest of what makes two observations the same; null parts equal null parts.

    A failure has no observation time: its fetch time stands in, so that each outage is kept.
    """
    stamp = F.coalesce(F.unix_micros("observed_at"), -F.unix_micros("fetched_at"), F.lit(0))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in fields]
    return F.sha2(F.concat_ws("\u0001", stamp.cast("string"), *parts), 256)


def unseen_in_stream(stream: DataFrame, keys: list[str], delay: str, time: str = "fetched_at") -> DataFrame:
    """First of each repeated observation; state is dropped once the watermark has passed by ``delay``."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def unseen_in_batch(rows: DataFrame, stored: DataFrame | None, keys: list[str], order: list[str]) -> DataFrame:
    """Rows that the stored table lacks, each key once (the earliest); null keys equal null keys."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"))
    one = first.select(*keys, *[F.col("_f")[c].alias(c) for c in rest])
    if stored is None:
        return one
    old = stored.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return one.join(old, cond, "left_anti")


def observation_events(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Zero or more events per observation: (keys, event_type, severity)."""
    c = F.col
    weather = (c("provider_key") == "open_meteo") & F.coalesce(c("valid"), F.lit(False))
    seen = F.coalesce(c("visibility"), F.lit(10000.0))
    found = codes(
        (c("status") == "STALE", "PROVIDER_STALE"),
        (c("status").isin("UNAVAILABLE", "INVALID", "RATE_LIMITED"), "PROVIDER_UNAVAILABLE"),
        (weather & (F.coalesce(c("rain"), F.lit(0.0)) >= 7.5), "HEAVY_RAIN"),
        (weather & (seen > 0) & (seen < 2000), "LOW_VISIBILITY"),
        (weather & (F.coalesce(c("wind_gusts_10m"), F.lit(0.0)) >= 50), "HIGH_WIND"),
    )
    return rows.select(*keys, F.explode(found).alias("event_type")).withColumn(
        "severity", F.when(F.col("event_type").startswith("PROVIDER"), "MEDIUM").otherwise("HIGH"))


def breaker_states(runtime: DataFrame, asof: Column) -> DataFrame:
    """State of each breaker at ``asof`` and, of an open one, when it is tried again."""
    retry = F.timestamp_micros(F.unix_micros("opened_at") + COOLDOWN_S * 1_000_000)
    state = F.when(F.col("opened_at").isNull(), "CLOSED").when(asof >= retry, "HALF_OPEN").otherwise("OPEN")
    return runtime.withColumns({"state": state, "next_attempt_at": F.when(state == "OPEN", retry), "rate_limited": F.col("status") == "RATE_LIMITED"})


FAILED = ("UNAVAILABLE", "INVALID", "RATE_LIMITED")


class IngestCycle:
    """One micro-batch of the ingest job: store new observations and their events, then let old days go.

    Observations lie in a folder per day of the time that is part of their key,
    so the search for known ones reads only the days that the batch holds. Every
    output is keyed by the batch, which overwrites itself when it is repeated.
    """

    def __init__(self, spark: SparkSession, path: str, numbers: list[str], keys: list[str], order: list[str], days: int = RETENTION_DAYS["observations"]):
        self.spark, self.path, self.numbers, self.keys, self.order, self.days = spark, path.rstrip("/"), numbers, keys, order, days
        self.observations = DailyTable(spark, f"{self.path}/observations", "stamp_at")

    def _put(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        target = f"{self.path}/{name}/batch={batch}"
        df.write.mode("overwrite").parquet(target)
        return self.spark.read.schema(df.schema).parquet(target)

    def known(self, days: list, batch: int) -> DataFrame | None:
        """Keys stored by earlier batches on these days."""
        stored = self.observations.read(days, before=batch)
        return None if stored is None else stored.select("observation_key")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        checked = judged(rows, self.numbers).withColumns({
            "valid": F.col("valid") & (F.size("errors") == 0), "observation_key": observation_key(self.keys), "stamp_at": F.coalesce("observed_at", "fetched_at")})
        seen = checked.agg(F.max("fetched_at").alias("now"), F.collect_set(F.to_date("stamp_at")).alias("days"), F.count_if(F.col("status").isin(*FAILED)).alias("failures")).first()
        new = unseen_in_batch(checked, self.known(seen["days"], batch), ["observation_key"], self.order)
        new = self.observations.append(new.select(*checked.columns), batch)
        events = self._put(observation_events(new, ["observation_id"]), "events", batch)
        # counted before retention lets go of files that this batch has just written
        held = new.agg(F.count("*").alias("stored"), F.count_if(~F.col("valid")).alias("invalid")).first()
        expired = self.observations.purge(seen["now"], self.days) if seen["now"] is not None else 0
        number = lambda n, name: F.lit(n).cast("long").alias(name)
        tally = events.agg(F.count("*").alias("events")).select(
            number(held["stored"], "stored"), number(held["invalid"], "invalid"), "events", F.lit(seen["failures"]).alias("failures"), number(expired, "expired"))
        self._put(tally, "counters", batch)

    def counters(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/counters").parquet(f"{self.path}/counters")


def schedule_states(messages: DataFrame, schedules: DataFrame) -> DataFrame:
    """Stream of changes of the newest status per schedule, from provider messages joined to the schedules."""
    j = messages.join(schedules.select("schedule_id", "train_code"), "train_code").withColumn("last_error", F.when(~F.col("valid"), F.array_join("errors", "; ")))
    return state.newest_states(j.drop("errors"), ["schedule_id"], "fetched_at", "observation_id")


#: Minutes after which a silent vessel leaves the state.
VESSEL_EXPIRY_MIN = 45


def vessel_states(messages: DataFrame, delay: str, expiry_min: int = VESSEL_EXPIRY_MIN) -> DataFrame:
    """Stream of changes of each vessel's newest message; vessels silent for longer than the expiry leave the state."""
    return state.newest_states(messages, ["vessel_id"], "seen_at", "message_id", expiry_min * 60, delay)


def fresh_vessels(vessels: DataFrame, asof: Column, expiry_min: int = VESSEL_EXPIRY_MIN) -> DataFrame:
    """Vessels of the state that are not yet silent for too long at ``asof``."""
    return vessels.where(F.unix_micros("seen_at") >= F.unix_micros(asof) - expiry_min * 60_000_000)
