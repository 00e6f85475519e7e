"""Filters, listings, top-k reports, unions and set comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ballast.functions.geo import great_circle_km
from ballast.operators.ordered import ranked

EVENT_STATES = ("OPEN", "ACKNOWLEDGED", "RESOLVED", "DISMISSED")


def owned(df: DataFrame, user: Column | str, shared: bool = False, column: str = "user_id") -> DataFrame:
    """Rows of one owner; with ``shared`` also rows nobody owns."""
    mine = F.col(column) == user
    return df.where(mine | F.col(column).isNull() if shared else mine)


def in_state(events: DataFrame, state: str) -> DataFrame:
    if state not in EVENT_STATES:
        raise ValueError(f"state must be one of {EVENT_STATES}")
    return events.where(F.col("state") == state)


def name_search(df: DataFrame, text: str, limit: int = 10, column: str = "name") -> DataFrame:
    """First rows whose name contains the text, ignoring case; short texts find nothing."""
    if len(text.strip()) < 2:
        return df.limit(0)
    return df.where(F.lower(column).contains(text.lower())).orderBy(column).limit(limit)


def visible_cases(cases: DataFrame, user: Column | str) -> DataFrame:
    mine = (F.col("owner_id") == user) | F.coalesce(F.col("reviewer_id") == user, F.lit(False))
    return cases.where(mine).orderBy(F.desc("updated_at"), F.desc("case_id"))


def newest_rows(df: DataFrame, time: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(time), F.desc(tie)).limit(n)


def page(df: DataFrame, order: list[Column | str], limit: int, offset: int) -> DataFrame:
    """One page; ``order`` must be total."""
    return df.orderBy(*order).offset(offset).limit(limit)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """Best k rows per key. Spark prunes to k rows per key and partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_alternates(paths: DataFrame, request: str, k: int = 2) -> DataFrame:
    """The k highest-scored alternates of each request that are not blocked."""
    return top_k(paths.where("not blocked"), [request], [F.desc("score"), F.asc("path_id")], k)


def enabled_sources(catalogue: DataFrame) -> DataFrame:
    return catalogue.where("enabled").orderBy("display_name")


def labeled_predictions(predictions: DataFrame, n: int) -> DataFrame:
    return newest_rows(predictions.where("actual_value is not null"), "predicted_at", "prediction_id", n)


def unioned(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def audit_rows(kind: str, df: DataFrame, rid: str, time: str, *attributes: str) -> DataFrame:
    """Rows of one kind in the shared audit shape; attributes keep their names."""
    return df.select(
        F.lit(kind).alias("type"), F.col(rid).cast("string").alias("id"), F.col(time).alias("created_at"),
        *[F.col(a).cast("string").alias(a) for a in attributes],
    )


def same_members(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: whether two frames hold the same multiset of rows, with the surplus on each side."""
    cols = left.columns
    both = left.select(*cols, F.lit(1).alias("_d")).union(right.select(*cols, F.lit(-1)))
    net = both.groupBy(*cols).agg(F.sum("_d").alias("_d"))
    return net.agg(
        F.coalesce(F.sum(F.greatest("_d", F.lit(0))), F.lit(0)).alias("left_only"),
        F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)).alias("right_only"),
    ).withColumn("equal", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def missing_kinds(rows: DataFrame, parents: DataFrame, key: str, kind: str, required: tuple[str, ...]) -> DataFrame:
    """Required kinds that a parent has no row of; the kinds gathered are a closed set."""
    have = rows.where(F.col(kind).isin(*required)).groupBy(key).agg(F.collect_set(kind).alias("_h"))
    need = F.array(*[F.lit(r) for r in required])
    return parents.select(key).join(have, key, "left").select(
        key, F.explode(F.array_except(need, F.coalesce("_h", F.array().cast("array<string>")))).alias("missing")
    )


def distinct_stations(stations: DataFrame, lat: float, lon: float) -> DataFrame:
    """One station per lower-cased name and hundredth of a degree, then by distance to the point."""
    km = F.round(great_circle_km(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon)), 1)
    rest = [c for c in stations.columns]
    keyed = stations.withColumns({
        "_n": F.lower(F.trim("name")), "_y": F.format_string("%.2f", "lat"), "_x": F.format_string("%.2f", "lon"),
    })
    first = keyed.groupBy("_n", "_y", "_x").agg(F.min_by(F.struct(*rest), "station_id").alias("s"))
    return first.select("s.*").withColumn("km", km).orderBy("km", "station_id")


def nearest_per_name(stations: DataFrame, lat: float, lon: float) -> DataFrame:
    """The nearest of all stations that share a name, distance to 2 places, then by distance."""
    km = great_circle_km(F.col("lat"), F.col("lon"), F.lit(lat), F.lit(lon))
    rows = stations.withColumn("km", km)
    rest = [c for c in rows.columns if c != "name"]
    best = rows.groupBy("name").agg(F.min_by(F.struct(*rest), F.struct("km", "station_id")).alias("s"))
    return best.select("name", "s.*").withColumn("km", F.round("km", 2)).orderBy("km", "station_id")


def ordered_points(points: DataFrame, line: str, slot_width: float, ends: tuple[str, str, str, str]) -> DataFrame:
    """Corridor points once per thousandth of a degree, placed along the straight from→to line.

    Points further than 1.6 times the end distance from either end are dropped.
    """
    f_lat, f_lon, t_lat, t_lon = (F.col(c) for c in ends)
    keyed = points.withColumns({"_y": F.format_string("%.3f", "lat"), "_x": F.format_string("%.3f", "lon")})
    rest = [c for c in points.columns if c != line]
    first = keyed.groupBy(line, "_y", "_x").agg(F.min_by(F.struct(*rest), "point_id").alias("p")).select(line, "p.*")
    v_lat, v_lon = t_lat - f_lat, t_lon - f_lon
    length = F.sqrt(v_lat * v_lat + v_lon * v_lon)
    length = F.when(length == 0, 1.0).otherwise(length)
    along = ((F.col("lat") - f_lat) * v_lat + (F.col("lon") - f_lon) * v_lon) / length
    span = great_circle_km(f_lat, f_lon, t_lat, t_lon) * 1.6
    kept = first.where(
        (great_circle_km(f_lat, f_lon, F.col("lat"), F.col("lon")) < span)
        & (great_circle_km(t_lat, t_lon, F.col("lat"), F.col("lon")) < span)
    ).withColumn("along", F.round(along, 9))
    slot = F.floor(F.col("along") / slot_width)
    return ranked(kept, [line], ["along", "point_id"], slot, out="position")
