"""Nearest line or place of each point, found in widening grid neighbourhoods."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.functions.geo import along, great_circle_km
from ballast.operators.ordered import Step, number_slot, scan
from ballast.session import cut, fan_out

KM_PER_DEGREE = 111.0
LAST_CELL = 180.0


def line_pieces(points: DataFrame, line: str, pos: str = "pos") -> DataFrame:
    """Straight pieces of each line with the planar distance from its start."""
    lagged = scan(points, [line], [pos], number_slot(pos, 4096), [Step("_p", "lag", F.struct("lat", "lon"))])
    length = F.sqrt(F.pow(F.col("lat") - F.col("_p.lat"), 2) + F.pow(F.col("lon") - F.col("_p.lon"), 2))
    pieces = lagged.where("_p is not null").select(
        line, F.col(pos).alias("piece"), F.col("_p.lat").alias("a_lat"), F.col("_p.lon").alias("a_lon"),
        F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), length.alias("len"),
    )
    return scan(pieces, [line], ["piece"], number_slot("piece", 4096), [Step("upto", "sum", F.col("len"))])


def _cells(lat_lo, lat_hi, lon_lo, lon_hi, size):
    """Cells of a box. Those of longitude close to a ring of whole cells: the last is followed by the first."""
    ys = F.sequence(F.floor(lat_lo / size), F.floor(lat_hi / size))
    xs = F.sequence(F.floor((lon_lo + 180) / size), F.floor((lon_hi + 180) / size))
    ring = F.round(F.lit(360.0) / size).cast("bigint")
    return F.array_distinct(F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(y.alias("y"), F.pmod(x, ring).alias("x"))))))


def _search(points: DataFrame, places: DataFrame, pid: str, measure, cell: float) -> DataFrame:
    """Best place per point. ``places`` has gid and a bounding box; ``measure`` adds ``km``.

    A round looks at the 3×3 cells around a point. Everything nearer than the
    cell's smaller side lies in them, so an answer within that distance is final;
    the other points go on with cells four times as wide.
    """
    rounds, todo, size = [], fan_out(points, pid), cell
    while True:
        last = size >= LAST_CELL
        size = LAST_CELL if last else 360.0 / math.ceil(360.0 / size)
        grid = places.select(
            "gid", F.explode(_cells(F.col("lat_lo"), F.col("lat_hi"), F.col("lon_lo"), F.col("lon_hi"), F.lit(size))).alias("c")
        ).select("gid", "c.y", "c.x")
        near = todo.select(
            pid, "lat", "lon",
            F.explode(_cells(F.col("lat") - size, F.col("lat") + size, F.col("lon") - size, F.col("lon") + size, F.lit(size))).alias("c"),
        ).select(pid, "lat", "lon", "c.y", "c.x")
        seen = near.join(grid, ["y", "x"]).select(pid, "lat", "lon", "gid").distinct()
        best = measure(seen).groupBy(pid).agg(F.min_by(F.struct("*"), F.struct("rank_km", "gid")).alias("m")).select("m.*")
        if last:
            rounds.append(best)
            break
        reach = F.lit(size * KM_PER_DEGREE) * F.cos(F.radians(F.least(F.abs(F.col("lat")) + size, F.lit(89.9))))
        best = cut(best)
        done = best.where(F.col("km") + 0.01 <= reach)
        rounds.append(done)
        todo = cut(todo.join(done.select(pid), pid, "left_anti"))
        if todo.isEmpty():
            break
        size *= 4
    return reduce(DataFrame.unionByName, rounds)


def nearest_line(points: DataFrame, pid: str, line_points: DataFrame, line: str, cell: float = 2.0) -> DataFrame:
    """Line, fraction along it, snapped position and offset in km (2 places) of each point.

    On each line the nearest place is found in the plane; lines are then compared
    by rounded great-circle offset, the smaller id winning ties.
    """
    pieces = cut(line_pieces(line_points, line)).withColumnRenamed(line, "gid")
    total = pieces.groupBy("gid").agg(F.sum("len").alias("total"))
    places = pieces.select(
        "gid", F.least("a_lat", "b_lat").alias("lat_lo"), F.greatest("a_lat", "b_lat").alias("lat_hi"),
        F.least("a_lon", "b_lon").alias("lon_lo"), F.greatest("a_lon", "b_lon").alias("lon_hi"),
    )

    def measure(seen: DataFrame) -> DataFrame:
        j = seen.join(pieces, "gid")
        t = along(F.col("lat"), F.col("lon"), F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
        j = j.withColumn("t", t)
        s_lat = F.col("a_lat") + (F.col("b_lat") - F.col("a_lat")) * F.col("t")
        s_lon = F.col("a_lon") + (F.col("b_lon") - F.col("a_lon")) * F.col("t")
        j = j.withColumns({"s_lat": s_lat, "s_lon": s_lon, "d": F.col("upto") - F.col("len") + F.col("t") * F.col("len")})
        flat = F.pow(F.col("s_lat") - F.col("lat"), 2) + F.pow(F.col("s_lon") - F.col("lon"), 2)
        per = j.groupBy(pid, "lat", "lon", "gid").agg(
            F.min_by(F.struct("s_lat", "s_lon", "d"), F.struct(flat, F.col("piece"))).alias("s")
        ).join(total, "gid")
        km = great_circle_km(F.col("lat"), F.col("lon"), F.col("s.s_lat"), F.col("s.s_lon"))
        return per.select(
            pid, "lat", "lon", "gid", F.col("s.s_lat").alias("s_lat"), F.col("s.s_lon").alias("s_lon"),
            F.coalesce(F.col("s.d") / F.nullif("total", F.lit(0.0)), F.lit(0.0)).alias("fraction"), km.alias("km"),
            F.round(km, 2).alias("rank_km"),
        )

    out = _search(points.select(pid, "lat", "lon"), places, pid, measure, cell)
    return out.select(pid, F.col("gid").alias(line), "fraction", "s_lat", "s_lon", F.col("rank_km").alias("offset_km"))


def nearest_place(points: DataFrame, pid: str, stations: DataFrame, sid: str, cell: float = 2.0) -> DataFrame:
    """Nearest station of each point by great-circle distance, to 0.1 km."""
    spots = stations.select(F.col(sid).alias("gid"), F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"))
    places = spots.select("gid", F.col("g_lat").alias("lat_lo"), F.col("g_lat").alias("lat_hi"),
                          F.col("g_lon").alias("lon_lo"), F.col("g_lon").alias("lon_hi"))

    def measure(seen: DataFrame) -> DataFrame:
        km = great_circle_km(F.col("lat"), F.col("lon"), F.col("g_lat"), F.col("g_lon"))
        return seen.join(spots, "gid").select(pid, "lat", "lon", "gid", km.alias("km"), F.round(km, 9).alias("rank_km"))

    out = _search(points.select(pid, "lat", "lon"), places, pid, measure, cell)
    return out.select(pid, F.col("gid").alias(sid), F.round("km", 1).alias("km"))


def resolved_positions(snapped: DataFrame, lines: DataFrame, line: str) -> DataFrame:
    """Train positions on track: label, next station and the piece still ahead when under 95 %."""
    ahead = F.col("fraction") < 0.95
    return snapped.join(lines.select(line, "src_code", "dst_code", "end_lat", "end_lon"), line).select(
        *snapped.columns, F.concat_ws("→", "src_code", "dst_code").alias("snapped_track"),
        F.col("dst_code").alias("routing_start"),
        F.when(ahead, F.struct("s_lat", "s_lon", "end_lat", "end_lon")).alias("remaining"),
    )


def at_stations(requests: DataFrame, stations: DataFrame) -> DataFrame:
    """Positions given by station code: the station itself, on its yard track."""
    return requests.withColumn("code", F.upper("station_code")).join(stations, "code").select(
        *requests.columns, "lat", "lon", F.concat("code", F.lit(" yard")).alias("snapped_track"),
        F.lit(0.0).alias("offset_km"), F.col("code").alias("routing_start"),
    )
