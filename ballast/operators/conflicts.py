"""Occupation conflicts of trains on sections, and what evidence is missing to rule them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.functions.common import codes, plus_seconds
from ballast.functions.vocab import HISTORICAL_TYPES, REAL_TYPES
from ballast.operators.intervals import least_partner, overlap_join
from ballast.session import cut, sent_if_few


def source_errors() -> Column:
    """Attribution error codes of a row with the usual source columns."""
    c = F.col
    return codes(
        (~F.coalesce(F.upper("source_type").isin(*REAL_TYPES), F.lit(False)), "SOURCE_NOT_REAL"),
        (F.coalesce(F.length(F.trim("source_reference")), F.lit(0)) < 3, "SOURCE_REFERENCE_MISSING"),
        (~F.coalesce(c("source_checksum").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), "SOURCE_CHECKSUM_INVALID"),
        (F.coalesce(F.upper("verification_state"), F.lit("")) != "VERIFIED", "SOURCE_AUTHENTICATION_UNVERIFIED"),
        (c("observed_at").isNull(), "OBSERVED_AT_INVALID"),
        (c("fetched_at").isNull(), "FETCHED_AT_INVALID"),
        (c("fetched_at") < c("observed_at"), "FETCHED_BEFORE_OBSERVED"),
    )


def _sound(windows: DataFrame) -> DataFrame:
    return windows.where("section_id is not null and exit_at > entry_at")


def _both_ways(pairs: DataFrame, kind: Column, start: Column, end: Column, keys: list[str]) -> DataFrame:
    side = lambda a, b: F.struct(F.col(f"{a}.schedule_id").alias("candidate"), F.col(f"{b}.schedule_id").alias("other"))
    return pairs.select(
        *keys, kind.alias("conflict_type"), start.alias("conflict_start"), end.alias("conflict_end"),
        F.explode(F.array(side("l", "r"), side("r", "l"))).alias("s"),
    ).select(*keys, "conflict_type", "s.candidate", "s.other", "conflict_start", "conflict_end")


def overlap_conflicts(windows: DataFrame, policies: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Different trains in one section at one time: one row per side, type, other train and section.

    The earliest instance of a repeated conflict is kept.
    """
    keys = keys or ["section_id"]
    rule = policies.select("section_id", "single_track")
    w = _sound(windows).join(sent_if_few(rule), "section_id", "left").select(
        *keys, "schedule_id", F.upper("direction").alias("direction"),
        F.coalesce("single_track", F.lit(False)).alias("single_track"),
        F.col("entry_at").alias("lo"), F.col("exit_at").alias("hi"),
    )
    # each unordered pair once, then both directions
    pairs = overlap_join(w, w, keys, F.col("l.schedule_id") < F.col("r.schedule_id"))
    opposing = F.col("l.single_track") & (F.col("l.direction") != F.col("r.direction"))
    rows = _both_ways(
        pairs, F.when(opposing, "OPPOSING_SINGLE_TRACK").otherwise("SAME_SECTION_OVERLAP"),
        F.greatest("l.lo", "r.lo"), F.least("l.hi", "r.hi"), keys,
    )
    return _earliest(rows, keys)


def headway_conflicts(windows: DataFrame, policies: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Entries closer than the section's headway, same direction or single track.

    Entries are closer than h exactly when [entry, entry + h) overlap.
    """
    keys = keys or ["section_id"]
    rule = policies.where("headway_s > 0").select("section_id", "single_track", "headway_s")
    w = _sound(windows).join(rule, "section_id").select(
        *keys, "schedule_id", F.upper("direction").alias("direction"), "single_track",
        F.col("entry_at").alias("lo"), plus_seconds(F.col("entry_at"), F.col("headway_s")).alias("hi"),
    )
    near = (F.col("l.schedule_id") < F.col("r.schedule_id")) & (
        F.col("l.single_track") | (F.col("l.direction") == F.col("r.direction"))
    )
    pairs = overlap_join(w, w, keys, near)
    rows = _both_ways(pairs, F.lit("MINIMUM_HEADWAY"), F.least("l.lo", "r.lo"), F.greatest("l.lo", "r.lo"), keys)
    return _earliest(rows, keys)


def _earliest(rows: DataFrame, keys: list[str]) -> DataFrame:
    first = F.min(F.struct("conflict_start", "conflict_end")).alias("f")
    return rows.groupBy(*keys, "conflict_type", "candidate", "other").agg(first).select(
        *keys, "conflict_type", "candidate", "other", "f.conflict_start", "f.conflict_end"
    )


def coverage_gaps(schedules: DataFrame, windows: DataFrame, policies: DataFrame) -> DataFrame:
    """Evidence whose absence forbids a clear answer: (schedule_id, code, detail)."""
    active = schedules.where("status <> 'CANCELLED'")
    no_windows = active.join(windows.select("schedule_id").distinct(), "schedule_id", "left_anti").select(
        "schedule_id", F.lit("OCCUPATION_WINDOWS_MISSING").alias("code"), F.lit(None).cast("bigint").alias("section_id")
    )
    used = windows.select("schedule_id", "section_id").distinct()
    no_policy = used.join(policies, "section_id", "left_anti").select(
        "schedule_id", F.lit("TRACK_POLICY_MISSING").alias("code"), "section_id"
    )
    no_headway = used.join(policies.where("headway_s is null"), "section_id", "left_semi").select(
        "schedule_id", F.lit("MINIMUM_HEADWAY_POLICY_MISSING").alias("code"), "section_id"
    )
    return no_windows.unionByName(no_policy).unionByName(no_headway)


def _partnered(windows: DataFrame, keys: list[str]) -> DataFrame:
    w = windows.select(*keys, F.col("schedule_id").alias("id"), "lo", "hi")
    # one train alone has no partner: only keys of several go on to the blocks, which hold a row many times
    several = w.groupBy(*keys).agg(F.min("id").alias("_a"), F.max("id").alias("_b")).where("_a < _b").select(*keys)
    w = cut(w.join(several, keys, "left_semi"))
    return least_partner(w, w, keys, any_partner=True).where("partner is not null").select(F.col("id").alias("schedule_id")).distinct()


def schedule_statuses(schedules: DataFrame, windows: DataFrame, policies: DataFrame, network: str) -> DataFrame:
    """BLOCKED, UNAVAILABLE or CLEAR for every active schedule against its network.

    Whether a conflict exists is read from pre-aggregated blocks, so no pair of
    windows is formed here.
    """
    active = schedules.where("status <> 'CANCELLED'").select("schedule_id", network)
    # what is asked of a window's source is answered before the join, so that only narrow rows are dealt; all searches read them
    bad_window = (F.size(source_errors()) > 0) | ~(F.col("exit_at") > F.col("entry_at"))
    replay = F.upper("source_type").isin(*HISTORICAL_TYPES)
    narrow = windows.select(
        "section_id", "schedule_id", F.upper("direction").alias("direction"), "entry_at", "exit_at", bad_window.alias("_bad"), replay.alias("_old"))
    w = cut(narrow.join(active, "schedule_id"))
    sound = _sound(w)
    overlapping = _partnered(sound.withColumns({"lo": F.col("entry_at"), "hi": F.col("exit_at")}), [network, "section_id"])
    ruled = sound.join(policies.where("headway_s > 0").select("section_id", "single_track", "headway_s"), "section_id")
    lane = F.when(F.col("single_track"), F.lit("*")).otherwise(F.col("direction"))
    close = _partnered(
        ruled.withColumns({
            "lane": lane, "lo": F.col("entry_at"), "hi": plus_seconds(F.col("entry_at"), F.col("headway_s")),
        }), [network, "section_id", "lane"],
    )
    blocked = overlapping.union(close).distinct().withColumn("conflict", F.lit(True))

    per_net = (
        active.join(w.groupBy("schedule_id").agg(
            F.count("*").alias("_w"), F.bool_or(F.col("_bad") | F.col("_old")).alias("_bad"), F.bool_or("_old").alias("_old"),
        ), "schedule_id", "left")
        .groupBy(network)
        .agg(
            F.count("*").alias("assessed_schedules"), F.coalesce(F.sum("_w"), F.lit(0)).alias("assessed_windows"),
            F.bool_or(F.coalesce("_bad", F.lit(False)) | F.col("_w").isNull()).alias("net_missing"),
            F.bool_or(F.coalesce("_old", F.lit(False))).alias("net_old"),
        )
    )
    p = policies.select(
        "section_id", F.lit(True).alias("_has"), replay.alias("_pold"),
        ((F.size(source_errors()) > 0) | F.col("headway_s").isNull() | replay).alias("_pbad"),
    )
    own = (
        w.select("schedule_id", "section_id").distinct().join(p, "section_id", "left")
        .groupBy("schedule_id")
        .agg(F.bool_or(F.col("_has").isNull() | F.col("_pbad")).alias("own_missing"),
             F.bool_or(F.coalesce("_pold", F.lit(False))).alias("own_old"))
    )
    j = active.join(per_net, network).join(own, "schedule_id", "left").join(blocked, "schedule_id", "left")
    no = F.lit(False)
    conflict = F.coalesce("conflict", no)
    missing = F.col("net_missing") | F.coalesce("own_missing", no)
    old = F.col("net_old") | F.coalesce("own_old", no)
    return j.select(
        "schedule_id", network,
        F.when(conflict, "BLOCKED").when(old | missing, "UNAVAILABLE").otherwise("CLEAR").alias("status"),
        F.when(old, "HISTORICAL_REPLAY").when(missing, "INCOMPLETE").otherwise("CURRENT_REAL").alias("evidence_state"),
        "assessed_windows", "assessed_schedules",
    )


def coarse_slots(schedules: DataFrame) -> DataFrame:
    """Berth-window and same-destination checks: WARNING or CLEAR, with the first other train."""
    slots = schedules.select("dest_code", F.col("schedule_id").alias("id"), F.col("departs_at").alias("lo"), F.col("arrives_at").alias("hi"))
    others = schedules.where("status <> 'CANCELLED'").select("schedule_id")
    hit = least_partner(slots, slots.join(others, F.col("id") == F.col("schedule_id"), "left_semi"), ["dest_code"])
    j = schedules.join(hit.select(F.col("id").alias("schedule_id"), "partner"), "schedule_id", "left")
    miss = F.coalesce(~F.col("arrives_at").between(F.col("berth_start"), F.col("berth_end")), F.lit(False))
    return j.select(
        "schedule_id",
        F.when(miss | F.col("partner").isNotNull(), "WARNING").otherwise("CLEAR").alias("status"),
        F.when(miss, "OUTSIDE_BERTH_WINDOW").when(F.col("partner").isNotNull(), "SLOT_OVERLAP").alias("reason"),
        F.when(~miss, F.col("partner")).alias("other"),
    )
