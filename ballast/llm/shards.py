"""Minimax contiguous partition of atomic groups into shards of near equal bytes.

Documents of equal text form one group that is never split. Groups are ordered
by the hash of their text, so a cut between two groups is one hash value. The
smallest capacity with which a greedy left-to-right filling needs no more than
``shards`` shards is found by binary search; the shards are then cut where that
filling stops. No other contiguous cutting in this order has a smaller largest
shard.

Only DataFrame operations. The driver sees sums over stretches of the hash range,
the few groups larger than a mean stretch and the cut keys; a group may hold any share of the rows, as it is one row of
summed sizes.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ballast.llm.common import Shelf

SHARDS = 16
#: First stretches of the hash range, and parts into which one is split further on, as powers of two.
FIRST_BITS, MORE_BITS = 12, 4
#: Cells per shard within which rows are numbered.
CELLS = 1024


@dataclass
class Cells:
    """Stretches of the hash range in order: ``low`` and ``high`` are their hashes, ``end`` is the running
    sum of sizes up to and with a stretch, ``last`` its largest hash, ``single`` whether it is one group."""

    low: list[int]
    high: list[int]
    end: np.ndarray
    last: list[int]
    single: np.ndarray

    @staticmethod
    def of(rows: list[tuple]) -> Cells:
        """From (low, high, size, groups, last) of each stretch."""
        low, high, size, groups, last = zip(*sorted(rows), strict=True)
        return Cells(list(low), list(high), np.cumsum(np.array(size, np.int64)), list(last), np.array(groups) == 1)

    def rows(self, chosen: np.ndarray) -> list[tuple]:
        size = np.diff(self.end, prepend=0)
        return [(self.low[i], self.high[i], int(size[i]), 1 if self.single[i] else 2, self.last[i]) for i in np.flatnonzero(chosen)]

    def filled(self, capacity: int, shards: int) -> list[int]:
        """Greedy filling with whole stretches: the number of stretches in front of each shard's end."""
        ends, at = [], 0
        for _ in range(shards):
            before = int(self.end[at - 1]) if at else 0
            at = int(np.searchsorted(self.end, before + capacity, "right"))
            ends.append(at)
        return ends

    def flowing(self, capacity: int, shards: int) -> list[int]:
        """Greedy filling where a stretch of several groups may be cut anywhere: the size in front of each shard's end.

        No filling with whole groups gets further with this capacity.
        """
        ends, at = [], 0
        for _ in range(shards):
            at += capacity
            i = int(np.searchsorted(self.end, at, "right"))
            if i == len(self.end):
                at = int(self.end[-1])
            elif self.single[i]:
                at = int(self.end[i - 1]) if i else 0
            ends.append(at)
        return ends

    def smallest(self, low: int, fits: Callable[[int], bool]) -> int:
        """The least capacity from ``low`` on that fits, by binary search."""
        high = max(low, int(self.end[-1]))
        while low < high:
            middle = (low + high) // 2
            if fits(middle):
                high = middle
            else:
                low = middle + 1
        return low

    def bounds(self, least: int, shards: int) -> tuple[int, int]:
        """Capacities between which the smallest for whole groups lies: less would not do even if stretches
        could be cut anywhere, more is not needed even if they could not be cut at all."""
        total = int(self.end[-1])
        low = self.smallest(least, lambda c: self.flowing(c, shards)[-1] == total)
        return low, self.smallest(low, lambda c: self.filled(c, shards)[-1] == len(self.end))

    def undecided(self, low: int, high: int, shards: int) -> np.ndarray:
        """Stretches of several groups in which a filling of whole groups with a capacity of low to high may end a shard."""
        out = np.zeros(len(self.end), bool)
        for a, b in zip(self.filled(low, shards), self.flowing(high, shards), strict=True):
            out[a : int(np.searchsorted(self.end, b, "right")) + 1] = True
        return out & ~self.single


def held(spark: SparkSession, rows: list[dict], form: str) -> DataFrame:
    """A few rows as a literal table, to broadcast."""
    return F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{form}>>"))))


def summed(parts: DataFrame, by: list[str]) -> list:
    return parts.groupBy(*by).agg(F.sum("size").alias("size"), F.count("*").alias("groups"), F.max("h").alias("last")).collect()


def first_cells(groups: DataFrame, total: int) -> Cells:
    """Stretches of equal width, cut around every group larger than a mean stretch. At most three times as many as stretches."""
    shift, many = 64 - FIRST_BITS, 1 << FIRST_BITS
    large = sorted((r["h"], r["size"]) for r in groups.where(F.col("size") > total // many).collect())  # fewer than ``many``
    by: dict[int, list[int]] = {}
    for h, _ in large:
        by.setdefault(h >> shift, []).append(h)
    rest = groups.where(F.col("size") <= total // many).withColumn("key", F.shiftright("h", shift))
    marks = held(groups.sparkSession, [{"key": k, "marks": v} for k, v in by.items()], "key:bigint,marks:array<bigint>")
    piece = F.when(F.col("marks").isNull(), 0).otherwise(F.size(F.filter("marks", lambda m: m < F.col("h"))))
    cells = [(h, h, size, 1, h) for h, size in large]
    for r in summed(rest.join(marks, "key", "left").withColumn("piece", piece), ["key", "piece"]):
        edges = [(r["key"] << shift) - 1, *by.get(r["key"], []), ((r["key"] + 1) << shift)]
        cells.append((edges[r["piece"]] + 1, edges[r["piece"] + 1] - 1, r["size"], r["groups"], r["last"]))
    return Cells.of(cells)


def finer(groups: DataFrame, cells: Cells, chosen: np.ndarray) -> Cells:
    """``cells`` with the chosen ones split into parts of equal width."""
    shift, spans = 64 - FIRST_BITS, []
    for i in np.flatnonzero(chosen):
        low, high = cells.low[i], cells.high[i]
        spans.append({"key": low >> shift, "low": low, "high": high, "width": max(1, -(-(high - low + 1) >> MORE_BITS))})
    inside = groups.withColumn("key", F.shiftright("h", shift)).join(held(groups.sparkSession, spans, "key:bigint,low:bigint,high:bigint,width:bigint"), "key").where("h between low and high")
    part = F.expr("(h - low) div width")
    found = [
        (a := r["low"] + r["part"] * r["width"], min(r["high"], a + r["width"] - 1), r["size"], r["groups"], r["last"])
        for r in summed(inside.withColumn("part", part), ["low", "high", "width", "part"])]
    return Cells.of(cells.rows(~chosen) + found)


def cut_keys(groups: DataFrame, shards: int) -> list[int]:
    """The last hash of each shard but the last one, of groups (h, size).

    The hash range is summed up in stretches; those in which a shard may end are
    split until no smaller capacity could be found by splitting further. About
    2k stretches are open for the k-th shard, so that a round collects some
    ``shards``**2 times sixteen rows, however many groups there are.
    """
    total, largest = groups.agg(F.sum("size"), F.max("size")).first()
    if not total:
        return []
    cells = first_cells(groups, total)
    while True:
        low, high = cells.bounds(max(-(-total // shards), largest), shards)
        open_ = cells.undecided(low, high, shards)
        if low == high or not open_.any():
            break
        cells = finer(groups, cells, open_)
    ends = cells.filled(high, shards)
    return [cells.last[e - 1] for e in dict.fromkeys(ends) if 0 < e < len(cells.end)]


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot) of every row of ``docs``.

    ``size`` is the UTF-8 length plus one; a null text has size one and the
    checksum of the empty text, and all null texts are one group, apart from the
    group of empty texts. Repeated rows are kept, each with its own slot. Slots
    count from 0 without gaps in each shard. An empty table gives no rows. A
    null ``doc_id`` is kept. Other columns are not read. A group larger than the
    mean shard is a shard of its own size, as groups are atomic.
    """
    shelf = Shelf(docs.sparkSession)
    text = F.col("text")
    facts = shelf.put(docs.select(
        "doc_id",
        F.when(text.isNull(), F.lit(-(2**63))).otherwise(F.xxhash64(text)).alias("h"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    ))
    groups = shelf.put(facts.groupBy("h").agg(F.sum("size").alias("size")))
    keys = cut_keys(groups, shards)
    shelf.drop(groups)
    shard = F.lit(0)
    for key in sorted(keys):
        shard = shard + F.when(F.col("h") > key, 1).otherwise(0)
    placed = facts.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).alias("cell"))
    # shards * CELLS rows at most
    before = (
        placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(W.partitionBy("shard").orderBy("cell")) - F.col("n"))
        .select("shard", "cell", "before")
    )
    at = F.row_number().over(W.partitionBy("shard", "cell").orderBy("doc_id", "size", "text_crc32"))
    return (
        placed.withColumn("at", at).join(F.broadcast(before), ["shard", "cell"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at") - 1).alias("slot"))
    )
