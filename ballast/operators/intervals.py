"""Overlaps of half-open time intervals without comparing every pair of a group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.session import fan_out

MINUTE_US = 60_000_000


def _lengths(df: DataFrame, base_us: int) -> DataFrame:
    lo, hi = F.unix_micros("lo"), F.unix_micros("hi")
    size = F.greatest(hi - lo, F.lit(1)) / F.lit(float(base_us))
    level = F.greatest(F.lit(0), F.ceil(F.log(size) / math.log(4) - 1e-9)).cast("int")
    return df.withColumns({"_a": lo, "_b": hi, "_level": level}).where("_a < _b")


def _placed(df: DataFrame, levels: list[int], base_us: int) -> DataFrame:
    """One row per level at or above the interval's own and per time cell it touches there."""
    at = F.explode(F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v >= F.col("_level")))
    out = df.withColumn("_at", at)
    width = (F.pow(F.lit(4.0), F.col("_at")) * base_us).cast("bigint")
    cells = F.sequence(F.floor(F.col("_a") / width), F.floor((F.col("_b") - 1) / width))
    return out.withColumn("_width", width).withColumn("_cell", F.explode(cells))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], residual=None, base_us: int = MINUTE_US) -> DataFrame:
    """Pairs with equal ``keys`` whose intervals [lo, hi) share an instant.

    Both frames have timestamp columns ``lo`` and ``hi``. An interval is placed
    in time cells about as wide as itself, so it touches two or three of them
    whatever its length, and is also shown to the wider classes in use. A pair
    meets only at the wider of its two classes, in the cell holding the later
    start. Cells hold little but true overlaps, so a key with very many
    intervals is spread over its cells. Returns the keys and structs l and r.
    """
    left, right = _lengths(left, base_us), _lengths(right, base_us)
    # at most a few dozen distinct class numbers
    found = left.select("_level").union(right.select("_level")).distinct().collect()
    levels = sorted(r[0] for r in found) or [0]
    a, b = _placed(left, levels, base_us), _placed(right, levels, base_us)
    extra = ["_a", "_b", "_level", "_at", "_width", "_cell"]
    pack = lambda df, n: df.select(
        *keys, "_at", "_cell",
        F.struct(*[c for c in df.columns if c not in extra], "_a", "_b", "_level", "_width").alias(n),
    )
    l, r = pack(a, "l"), pack(b, "r")
    pairs = l.join(r, [*keys, "_at", "_cell"])
    start = F.greatest("l._a", "r._a")
    hit = (
        ((F.col("l._level") == F.col("_at")) | (F.col("r._level") == F.col("_at")))
        & (F.col("l._a") < F.col("r._b")) & (F.col("r._a") < F.col("l._b"))
        & (F.floor(start / F.col("l._width")) == F.col("_cell"))
    )
    if residual is not None:
        hit = hit & residual
    return pairs.where(hit).select(*keys, "l", "r")


# --- least overlapping partner, without forming pairs ---------------------------------

RADIX = 4


def _per_level(df: DataFrame, top: int) -> DataFrame:
    """One row per block level with the block size of this level and of the next."""
    sizes = F.array(*[F.lit(RADIX**k).cast("bigint") for k in range(top + 2)])
    rows = df.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    return rows.withColumns({"_s": F.get(sizes, F.col("level")), "_t": F.get(sizes, F.col("level") + 1)})


def _point_nodes(df: DataFrame, point: str, top: int) -> DataFrame:
    return _per_level(df, top).withColumn("node", F.floor(F.col(point) / F.col("_s"))).drop("_s", "_t")


def _range_nodes(df: DataFrame, lo: str, hi: str, top: int) -> DataFrame:
    """The few aligned blocks that exactly fill [lo, hi)."""
    rows = _per_level(df, top).withColumns({
        "_a": F.ceil(F.col(lo) / F.col("_s")), "_b": F.floor(F.col(hi) / F.col("_s")),
        "_c": F.ceil(F.col(lo) / F.col("_t")) * RADIX, "_d": F.floor(F.col(hi) / F.col("_t")) * RADIX,
    }).where("_a < _b")

    def run(x, y):
        return F.when(F.col(x) < F.col(y), F.sequence(F.col(x), F.col(y) - 1)).otherwise(F.array().cast("array<bigint>"))

    # blocks of the next level are left to it, except at the top
    wider = (F.col("_c") < F.col("_d")) & (F.col("level") < top)
    blocks = F.when(wider, F.concat(run("_a", "_c"), run("_d", "_b"))).otherwise(run("_a", "_b"))
    return rows.withColumn("node", F.explode(blocks)).drop("_s", "_t", "_a", "_b", "_c", "_d")


def _two_least(nodes: DataFrame, at: list[str]) -> DataFrame:
    """The two smallest distinct ids per node."""
    first = nodes.groupBy(*at).agg(F.min("id").alias("m1"))
    second = nodes.join(first, at).where("id > m1").groupBy(*at).agg(F.min("id").alias("m2"))
    return first.join(second, at, "left")


def _ends(nodes: DataFrame, at: list[str]) -> DataFrame:
    """Smallest and greatest id per node: enough to know whether another id is there."""
    return nodes.groupBy(*at).agg(F.min("id").alias("m1"), F.max("id").alias("m2"))


# coarser units need fewer block levels; the coarsest that every bound is a whole number of is used
UNITS_US = (86_400_000_000, 3_600_000_000, MINUTE_US, 1_000_000, 1_000, 1)


def least_partner(items: DataFrame, others: DataFrame, keys: list[str], any_partner: bool = False) -> DataFrame:
    """For each item the smallest id of another's interval that overlaps it, null if none.

    With ``any_partner`` it may be any such id, which is cheaper to find.

    ``items`` and ``others`` have the keys, ``id`` and timestamps ``lo`` < ``hi``.
    Two intervals overlap exactly when one starts inside the other, so each item
    asks two questions of pre-aggregated blocks: the least id starting inside it,
    and the least id whose interval contains its start. No pair is formed, so the
    cost does not grow with the overlaps.
    """
    def bounds(df):
        return df.select(*keys, "id", F.unix_micros("lo").alias("a"), F.unix_micros("hi").alias("b")).where("a < b")

    mine, theirs = bounds(items), bounds(others)
    both = mine.select("a", "b").union(theirs.select("a", "b"))
    whole = lambda u: F.bool_and((F.pmod("a", F.lit(u)) == 0) & (F.pmod("b", F.lit(u)) == 0))
    facts = both.agg(F.max(F.col("b") - F.col("a")).alias("span"), *[whole(u).alias(f"u{u}") for u in UNITS_US]).first()
    unit = next((u for u in UNITS_US if facts[f"u{u}"]), 1)
    top = max(0, math.ceil(math.log(max(1, (facts["span"] or 1) // unit), RADIX)))

    def scaled(df):
        return fan_out(df.withColumns({c: F.floor(F.col(c) / F.lit(unit)) for c in ("a", "b")}), "id")

    mine, theirs = scaled(mine), scaled(theirs)
    at = [*keys, "level", "node"]
    summary = _ends if any_partner else _two_least
    starts = summary(_point_nodes(theirs, "a", top).select(*at, "id"), at)
    covers = summary(_range_nodes(theirs, "a", "b", top).select(*at, "id"), at)
    inside = _range_nodes(mine, "a", "b", top).join(starts, at)
    around = _point_nodes(mine, "a", top).join(covers, at)
    best = F.when(F.col("m1") != F.col("id"), F.col("m1")).when(F.col("m2") != F.col("id"), F.col("m2"))
    hits = inside.unionByName(around).groupBy(*keys, "id", "a", "b").agg(F.min(best).alias("partner"))
    res = mine.join(hits, [*keys, "id", "a", "b"], "left")
    return res.groupBy(*keys, "id").agg(F.min("partner").alias("partner"))
