"""Ordered computations that never hold a whole key group in one task.

A plain window partitioned by a business key puts every row of that key into
one task. Here the order is first sliced by ``slot``, an expression that never
falls as the order rises (an hour of a timestamp, a range of sequence numbers).
One row per (key, slot) is summarised with map-side combine, those few rows are
scanned to learn what each slot inherits, and rows are then finished inside
(key, slot). A key that holds a third of all rows is spread over its slots.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ballast.session import cut

SLOT = "_slot"


@dataclass(frozen=True)
class Step:
    """One running value. ``kind``: rank, sum, max, lag or last (last non-null)."""

    out: str
    kind: str
    value: Column | None = None


def hour_slot(ts: str, hours: float = 1.0) -> Column:
    return F.floor(F.unix_micros(F.col(ts)) / F.lit(int(hours * 3_600_000_000)))


def number_slot(col: str, width: int) -> Column:
    return F.floor(F.col(col) / F.lit(width))


def scan(
    df: DataFrame, keys: list[str], order: list[str], slot: Column, steps: list[Step]
) -> DataFrame:
    """Add each step's running value; ``sum`` and ``max`` include the current row.

    ``keys`` may be empty for one order over the whole frame. Key values must
    not be null. ``order`` must be total within a key for repeatable results.
    """
    rows = df.withColumn(SLOT, slot)
    carry = {}
    for s in steps:
        rows = rows.withColumn(f"_v_{s.out}", F.lit(1) if s.value is None else s.value)
    for s in steps:
        v = F.col(f"_v_{s.out}")
        if s.kind == "rank":
            carry[s.out] = F.count(F.lit(1))
        elif s.kind == "sum":
            carry[s.out] = F.sum(v)
        elif s.kind == "max":
            carry[s.out] = F.max(v)
        elif s.kind == "lag":
            # wrapped so that a null value still counts as the previous row
            carry[s.out] = F.max_by(F.struct(v.alias("v")), F.struct(*order))
        elif s.kind == "last":
            carry[s.out] = F.max_by(v, F.when(v.isNotNull(), F.struct(*order)))
        else:
            raise ValueError(s.kind)
    parts = rows.groupBy(*keys, SLOT).agg(
        *[c.alias(f"_c_{name}") for name, c in carry.items()]
    )
    before = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    inherited = []
    for s in steps:
        c = F.col(f"_c_{s.out}")
        if s.kind in ("rank", "sum"):
            inherited.append(F.sum(c).over(before).alias(f"_i_{s.out}"))
        elif s.kind == "max":
            inherited.append(F.max(c).over(before).alias(f"_i_{s.out}"))
        else:
            inherited.append(F.last(c, ignorenulls=True).over(before).alias(f"_i_{s.out}"))
    inherits = parts.select(*keys, SLOT, *inherited)

    joined = rows.join(inherits, [*keys, SLOT])
    inner = Window.partitionBy(*keys, SLOT).orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for s in steps:
        v, i = F.col(f"_v_{s.out}"), F.col(f"_i_{s.out}")
        if s.kind == "rank":
            out[s.out] = F.row_number().over(inner) + F.coalesce(i, F.lit(0))
        elif s.kind == "sum":
            here = F.sum(v).over(upto)
            out[s.out] = F.when(i.isNull(), here).when(here.isNull(), i).otherwise(here + i)
        elif s.kind == "max":
            out[s.out] = F.greatest(F.max(v).over(upto), i)
        elif s.kind == "lag":
            here = F.lag(F.struct(v.alias("v"))).over(inner)
            out[s.out] = F.coalesce(here, i)["v"]
        else:
            out[s.out] = F.coalesce(F.last(v, ignorenulls=True).over(upto), i)
    spare = [SLOT] + [f"_v_{s.out}" for s in steps] + [f"_i_{s.out}" for s in steps]
    return joined.withColumns(out).drop(*spare)


def ranked(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    slot: Column,
    out: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """1-based position in each key group, and on request the group's size."""
    res = scan(df, keys, order, slot, [Step(out, "rank")])
    if total is None:
        return res
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(total))
    return res.join(sizes, keys) if keys else res.crossJoin(F.broadcast(sizes))


def balanced_rank(df: DataFrame, keys: list[str], order: list[str], out: str = "rank") -> DataFrame:
    """1-based position in each key group, from slices of equal row counts.

    The rows are dealt by ranges of (keys, order), so a hot key is cut into as
    many slices as its rows need, wherever in the order they lie.
    """
    cols = [*keys, *order]
    rows = cut(df.repartitionByRange(*cols).withColumn(SLOT, F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    first = rows.groupBy(*keys, SLOT).agg(F.count(F.lit(1)).alias("_n")).select(*keys, SLOT, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    place = F.row_number().over(Window.partitionBy(*keys, SLOT).orderBy(*order))
    return rows.join(first, [*keys, SLOT]).withColumn(out, place + F.col("_b")).drop(SLOT, "_b")


#: Rows of a stretch within which clamped steps are composed, as a power of two.
STRETCH_BITS = 8


def clamped(f: Column, u: Column) -> Column:
    """A step u -> min(max(u + shift, low), high) applied to ``u``."""
    return F.least(f["high"], F.greatest(f["low"], u + f["shift"]))


def composed(first: Column, then: Column) -> Column:
    """One step that does ``first`` and ``then``; a null first step does nothing."""
    both = F.struct((first["shift"] + then["shift"]).alias("shift"), clamped(then, first["low"]).alias("low"), clamped(then, first["high"]).alias("high"))
    return F.when(first.isNull(), then).otherwise(both)


def compose_clamped(rows: DataFrame, keys: list[str], place: str, step: str) -> DataFrame:
    """Add ``upto`` and ``before``: all clamped steps of a key up to each row, with it and without it.

    ``place`` counts a key's rows from 0. Within a stretch steps are composed by
    doubling distances; the stretches' own steps are composed in the same way, so
    no task or row ever holds a key's steps. ``before`` is null at a key's first row.
    """
    width = 1 << STRETCH_BITS
    within = Window.partitionBy(*keys, SLOT).orderBy(place)
    held = rows.withColumns({SLOT: F.floor(F.col(place) / width), "upto": F.col(step)})
    for bit in range(STRETCH_BITS):
        held = held.withColumn("upto", composed(F.lag("upto", 1 << bit).over(within), F.col("upto")))
    held = cut(held.withColumn("before", F.lag("upto").over(within)))
    ends = held.groupBy(*keys, SLOT).agg(F.max_by("upto", place).alias(step))
    if ends.where(F.col(SLOT) > 0).isEmpty():
        return held.drop(SLOT)
    above = compose_clamped(ends.withColumnRenamed(SLOT, "_place"), keys, "_place", step)
    opening = above.select(*keys, (F.col("_place") + 1).alias(SLOT), F.col("upto").alias("_open"))
    joined = held.join(opening, [*keys, SLOT], "left")
    return joined.withColumns({
        "upto": composed(F.col("_open"), F.col("upto")),
        "before": F.when(F.col("before").isNull(), F.col("_open")).otherwise(composed(F.col("_open"), F.col("before"))),
    }).drop(SLOT, "_open")


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, as a map-side-combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    top = F.max_by(F.struct(*rest), F.struct(*order)).alias("_top")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col("_top")[c].alias(c) for c in rest])


def percentiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    method: str = "linear",
) -> DataFrame:
    """Exact percentiles per group without gathering a group's values.

    Values are counted on a logarithmic grid (about 0.02 % wide cells), and the
    cells holding the wanted ranks are found from those counts. A cell with many
    different values is split evenly between its least and greatest value, again
    and again, until each wanted rank lies in a cell of one value or of few
    enough to rank. ``linear`` interpolates between the two neighbours of
    ``(n-1)*p``; ``nearest`` takes the half-even rounded index.
    """
    cell = F.floor(F.signum("_v") * F.log1p(F.abs(F.col("_v"))) * 4096).cast("bigint")
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null").withColumn("_path", F.array(cell))
    tally = [F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max")]
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_path").rowsBetween(Window.unboundedPreceding, 0)
    counts = rows.groupBy(*keys, "_path").agg(*tally).withColumns({"_hi": F.sum("_n").over(upto), "_total": F.sum("_n").over(whole)}).withColumn("_lo", F.col("_hi") - F.col("_n"))

    wants = []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        ranks = {"a": F.floor(pos), "b": F.ceil(pos)} if method == "linear" else {"a": F.bround(pos).cast("bigint")}
        for side, r in ranks.items():
            wants.append(F.struct(F.lit(f"{name}:{side}").alias("name"), (r + 1).cast("bigint").alias("rank"), (pos - F.floor(pos)).alias("frac")))
    inside = F.filter(F.array(*wants), lambda w: (w["rank"] > F.col("_lo")) & (w["rank"] <= F.col("_hi")))
    wanted = cut(counts.withColumn("_w", F.explode(inside)).drop("_hi", "_total"))

    hits = None
    while True:
        mixed = F.col("_min") < F.col("_max")
        here = wanted.where(~mixed).select(*keys, "_w", F.col("_min").alias("_v")).unionByName(
            _ranked_in_cells(rows, wanted.where(mixed & (F.col("_n") <= CELL_ROWS)), keys))
        hits = here if hits is None else hits.unionByName(here)
        wide = wanted.where(mixed & (F.col("_n") > CELL_ROWS))
        if wide.isEmpty():
            break
        place = F.least(F.lit(CELL_PARTS - 1), F.floor((F.col("_v") - F.col("_min")) / (F.col("_max") - F.col("_min")) * CELL_PARTS))
        cells = wide.select(*keys, "_path", "_min", "_max").distinct()
        rows = cut(rows.join(cells, [*keys, "_path"]).select(*keys, "_v", F.concat("_path", F.array(place.cast("bigint"))).alias("_path")))
        parent = F.slice("_path", F.lit(1), F.size("_path") - 1)
        below = Window.partitionBy(*keys, "_in").orderBy("_path").rowsBetween(Window.unboundedPreceding, 0)
        parts = rows.groupBy(*keys, "_path").agg(*tally).withColumn("_in", parent).withColumn("_to", F.sum("_n").over(below))
        old = wide.select(*keys, F.col("_path").alias("_in"), F.col("_lo").alias("_from"), "_w")
        found = parts.join(old, [*keys, "_in"]).withColumns({"_lo": F.col("_from") + F.col("_to") - F.col("_n"), "_hi": F.col("_from") + F.col("_to")})
        wanted = cut(found.where((F.col("_w.rank") > F.col("_lo")) & (F.col("_w.rank") <= F.col("_hi"))).select(*keys, "_path", "_n", "_min", "_max", "_lo", "_w"))

    out = {}
    for name in probs:
        a = F.max(F.when(F.col("_w.name") == f"{name}:a", F.col("_v")))
        if method == "linear":
            b = F.max(F.when(F.col("_w.name") == f"{name}:b", F.col("_v")))
            frac = F.max(F.when(F.col("_w.name") == f"{name}:a", F.col("_w.frac")))
            out[name] = a * (1 - frac) + b * frac
        else:
            out[name] = a
    return hits.groupBy(*keys).agg(*[c.alias(n) for n, c in out.items()])


#: Values that are ranked in one task; parts into which a cell with more is split.
CELL_ROWS, CELL_PARTS = 20_000, 4096


def _ranked_in_cells(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The values of the wanted ranks (keys, _w, _v), in cells of few values."""
    cells = wanted.select(*keys, "_path", "_lo").distinct()
    within = Window.partitionBy(*keys, "_path").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    values = rows.join(cells, [*keys, "_path"]).groupBy(*keys, "_path", "_lo", "_v").agg(F.count(F.lit(1)).alias("_k")).withColumn("_upto", F.col("_lo") + F.sum("_k").over(within))
    hit = values.drop("_lo").join(wanted.select(*keys, "_path", "_w"), [*keys, "_path"])
    return hit.where((F.col("_w.rank") <= F.col("_upto")) & (F.col("_w.rank") > F.col("_upto") - F.col("_k"))).select(*keys, "_w", "_v")
