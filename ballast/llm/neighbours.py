"""Approximate nearest neighbours by a permutation index.

Pivots are a few vectors of the table. Every vector is represented by its
nearest pivots in order. Vectors near the same first pivot lie together, in
blocks of bounded size, and each block holds one posting list per pivot: the
vectors that have it among theirs, with its place. A query goes to the blocks of
the first pivots of its own order; there the lists of its pivots are added up to
the footrule distance of both orders, the best share of the block by that
distance is compared by the vectors themselves, and the best of all blocks are
merged.

How many pivots' blocks a query must visit depends on the data: vectors that
spread evenly over all directions need most of them, grouped ones few. So it is
fitted on a sample of bounded size, to a recall over the one that is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ballast.llm.common import Shelf

NEAREST = 10
#: Rows that pivots are taken from and that the visited pivots are fitted on; sample queries.
SAMPLE, TRIED = 8192, 128
#: Pivots: two to the power nearest to the root of the rows, between these.
LEAST_PIVOTS, MOST_PIVOTS = 256, 16384
#: Pivots in a vector's order, at most.
ORDER = 128
#: Vectors and queries that meet in one group.
BLOCK, QUERIES = 8192, 16384
#: Share of a block that is compared by the vectors, and the recall wanted on the sample.
COMPARED, RECALL = 0.25, 0.97


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def orders(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each vector in order, ties to the smaller number."""
    apart = (pivots**2).sum(axis=1)[None, :] - 2 * (vectors @ pivots.T)
    if length < len(pivots):
        near = np.sort(np.argpartition(apart, length - 1, axis=1)[:, :length], axis=1)
    else:
        near = np.broadcast_to(np.arange(len(pivots)), apart.shape)
    return np.take_along_axis(near, np.argsort(np.take_along_axis(apart, near, axis=1), axis=1, kind="stable"), axis=1).astype("<u2")


class Block:
    """Posting lists of a block of vectors: for each pivot the vectors that have it, with its place."""

    def __init__(self, order: np.ndarray):
        self.size, self.length = order.shape
        flat = order.ravel()
        by = np.argsort(flat, kind="stable")
        self.vector, self.place = by // self.length, by % self.length
        self.pivot = flat[by]

    def shared(self, query: np.ndarray) -> np.ndarray:
        """What each vector's footrule distance to the query's order falls short of the greatest, halved.

        A pivot that one order lacks stands behind its end, so that only shared
        pivots count: each takes off twice its distance from the end in the
        order where it comes later.
        """
        start, stop = np.searchsorted(self.pivot, query, "left"), np.searchsorted(self.pivot, query, "right")
        size = stop - start
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - start, size)
        gain = self.length - np.maximum(self.place[at], np.repeat(np.arange(self.length), size))
        return np.bincount(self.vector[at], gain, self.size)


def closest(block: Block, vectors: np.ndarray, ids: np.ndarray, order: np.ndarray, query: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the ``keep`` nearest vectors among the best by footrule, ties to the smaller id."""
    most = max(4 * keep, int(block.size * COMPARED))
    best = np.arange(block.size)
    if most < block.size:
        best = np.argpartition(-block.shared(order), most - 1)[:most]
    apart = np.sqrt(((vectors[best] - query) ** 2).sum(axis=1))
    near = np.lexsort((ids[best], apart))
    if len(np.unique(ids[best[near[:keep]]])) < min(keep, len(near)):  # an id with several vectors counts once
        near = near[np.sort(np.unique(ids[best[near]], return_index=True)[1])]
    return best[near[:keep]], apart[near[:keep]]


def visited(sample: np.ndarray, pivots: np.ndarray, length: int, keep: int) -> int:
    """How many pivots of its order a query must visit to find RECALL of its neighbours in the sample."""
    order = orders(sample, pivots, len(pivots))
    tried = np.arange(0, len(sample), -(-len(sample) // TRIED))
    first = order[:, 0]
    block = Block(order[:, :length])
    needed = []
    for q in tried:
        apart = ((sample - sample[q]) ** 2).sum(axis=1)
        apart[q] = np.inf
        true = np.argsort(apart, kind="stable")[:keep]
        place = np.empty(len(pivots), np.int64)
        place[order[q]] = np.arange(len(pivots))
        rank = place[first[true]]
        shared = block.shared(order[q, :length])
        for t, r in zip(true, rank, strict=True):  # lost to the footrule whatever is visited
            mates = first == first[t]
            if (shared[mates] > shared[t]).sum() >= max(4 * keep, int(mates.sum() * COMPARED)):
                r = len(pivots)
            needed.append(r + 1)
    if not needed:
        return len(pivots)
    return int(min(len(pivots), np.sort(needed)[min(len(needed) - 1, int(len(needed) * RECALL))]))


def usable(rows: DataFrame) -> DataFrame:
    """Rows (vec_id, vector) that take part: an id, and a vector of finite components, not all zero, of the most common length."""
    kind = rows.schema["embedding"].dataType.elementType
    v = F.col("vector")
    fit = rows.select("vec_id", F.col("embedding").cast(T.ArrayType(kind if isinstance(kind, (T.FloatType, T.DoubleType)) else T.DoubleType())).alias("vector")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & F.exists(v, lambda x: x != 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    common = fit.groupBy(F.size("vector").alias("n")).count().orderBy(F.col("count").desc(), "n").first()
    return fit.where(F.size("vector") == (common["n"] if common else 0))


def nearest(rows: DataFrame, every: int = 100, keep: int = NEAREST) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``keep`` nearest found of each query, by Euclidean distance.

    Queries are the rows whose vec_id is divisible by ``every``; all rows but
    those of the query's own id are candidates. Ties go to the smaller vec_id.
    Rows without an id, and vectors that are null, empty, zero, of another length
    than most, or hold null or non-finite components take no part. Repeated rows
    count once; an id with several vectors is as near as the nearest of them. A
    query with too few candidates gets all of them; an empty table, or one
    without queries, gives no rows. Other columns are not read.
    """
    spark, shelf = rows.sparkSession, Shelf(rows.sparkSession)
    key = rows.schema["vec_id"].dataType.simpleString()
    fit = usable(rows).withColumn("h", F.xxhash64("vector"))
    form = fit.schema["vector"].dataType.simpleString()
    # of equal vectors only the smallest ids can be answers, and one search serves all their queries
    ranked = F.dense_rank().over(W.partitionBy("h", "vector").orderBy("vec_id"))
    held = shelf.put(fit.withColumn("copy", ranked).where(F.col("copy") <= keep + 1).dropDuplicates(["h", "vector", "vec_id"]).drop("copy"))
    queries = shelf.put(fit.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("h", "vector").agg(F.min("vec_id").alias("class"), F.count("*").alias("n")))
    count = held.count()
    form_out = f"query_id {key}, rank int, vec_id {key}, score double"
    if not count:
        return spark.createDataFrame([], form_out)
    # the sample: SAMPLE rows of smallest hash
    sample = matrix(pa.array([r["vector"] for r in held.select("vector", "vec_id").orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(SAMPLE).collect()]))
    sample = sample[np.sort(np.unique(sample, axis=0, return_index=True)[1])]
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, 1 << round(np.log2(count) / 2)))
    pivots = sample[: max(1, min(wanted, len(sample) // 2))]
    length = min(ORDER, max(1, len(pivots) // 2))
    visit = visited(sample, pivots, length, keep)
    shared = spark.sparkContext.broadcast(pivots)

    def place(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            if frame.num_rows:
                order = orders(matrix(frame.column("vector")), shared.value, length)
                raw = pa.array([x.tobytes() for x in order], pa.binary())
                yield pa.RecordBatch.from_arrays([*frame.columns, raw, pa.array(order[:, 0].astype(np.int32))], names=[*frame.schema.names, "order", "cell"])

    def route(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            if frame.num_rows:
                order = orders(matrix(frame.column("vector")), shared.value, max(visit, length))
                raw = pa.array([x[:length].tobytes() for x in order], pa.binary())
                cells = pa.array(order[:, :visit].astype(np.int32).tolist(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*frame.columns, raw, cells], names=[*frame.schema.names, "order", "cells"])

    placed = shelf.put(held.select("vec_id", "vector").mapInArrow(place, f"vec_id {key}, vector {form}, order binary, cell int"))
    routed = shelf.put(queries.select("class", "vector").mapInArrow(route, f"class {key}, vector {form}, order binary, cells array<int>"))
    # one row per pivot: into how many blocks its vectors and its queries are dealt
    asked = routed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("query_parts"))
    parts = shelf.put(placed.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).join(asked, "cell"))
    dealt = lambda by, n: F.pmod(F.xxhash64(by), F.col(n)).cast("int")
    every_part = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    blocks = placed.join(F.broadcast(parts), "cell").select("cell", dealt("vec_id", "parts").alias("part"), every_part("query_parts").alias("query_part"), "vec_id", "vector", "order")
    sent = routed.select("class", "vector", "order", F.explode("cells").alias("cell")).join(F.broadcast(parts), "cell").select(
        "cell", every_part("parts").alias("part"), dealt("class", "query_parts").alias("query_part"), "class", "vector", "order")

    def meet(here: pa.Table, asking: pa.Table) -> pa.Table:
        if not here.num_rows or not asking.num_rows:
            return pa.table({"class": asking.column("class").slice(0, 0), "vec_id": here.column("vec_id").slice(0, 0), "score": pa.array([], pa.float64())})
        read = lambda t: np.frombuffer(b"".join(t.column("order").to_pylist()), "<u2").reshape(t.num_rows, -1)
        vectors, ids = matrix(here.column("vector").combine_chunks()), here.column("vec_id").to_numpy()
        block, found, apart, query = Block(read(here)), [], [], []
        for i, (order, vector) in enumerate(zip(read(asking), matrix(asking.column("vector").combine_chunks()), strict=True)):
            at, d = closest(block, vectors, ids, order, vector, keep + 1)
            found.append(at)
            apart.append(d)
            query.append(np.full(len(at), i))
        return pa.table({"class": asking.column("class").take(pa.array(np.concatenate(query))), "vec_id": here.column("vec_id").take(pa.array(np.concatenate(found))), "score": np.concatenate(apart)})

    met = blocks.groupBy("cell", "part", "query_part").cogroup(sent.groupBy("cell", "part", "query_part")).applyInArrow(meet, f"class {key}, vec_id {key}, score double")
    at = F.row_number().over(W.partitionBy("class").orderBy("score", "vec_id"))
    # a class's answers are few, so they travel as one row and each of its queries leaves itself out
    best = met.groupBy("class", "vec_id").agg(F.min("score").alias("score")).withColumn("at", at).where(F.col("at") <= keep + 1)
    answers = shelf.put(best.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("found")).join(queries.select("class", "h", "vector"), "class"))
    each = fit.where(F.pmod("vec_id", F.lit(every)) == 0).select("h", "vector", F.col("vec_id").alias("query_id")).distinct().join(answers, ["h", "vector"])
    found = each.select("query_id", F.explode(F.filter("found", lambda x: x["vec_id"] != F.col("query_id"))).alias("hit"))
    score = found.groupBy("query_id", F.col("hit.vec_id").alias("vec_id")).agg(F.min("hit.score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    out = score.withColumn("rank", rank).where(F.col("rank") <= keep).select("query_id", "rank", "vec_id", "score")
    out = shelf.put(out)
    shelf.drop(held, queries, placed, routed, parts, answers)
    return out
