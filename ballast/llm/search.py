"""Ranked lexical search by Block-Max MaxScore over a sharded inverted index.

``build_index`` cuts the documents into shards of bounded size. Of each shard it
keeps, per term, the postings (document, frequency) in blocks, delta-coded into
variable-length bytes, and beside them a head per block: last document, bytes,
greatest frequency and least document length. ``search`` needs nothing else.

In a shard the terms of an item are taken by falling bound. As long as a
document unseen so far could still reach the heap, lists are essential and read
whole. From then on the remaining lists only add to documents already met: the
heads of their blocks bound what each of those can still gain, and a block is
decoded only where some document survives that bound. The heaps of the shards
are merged, first within slices of shards, then per item.

Scores are 64-bit integers. Terms are known by 64-bit hashes, so equality is
exact up to collisions.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ballast.llm.common import Shelf
from ballast.llm.text import Batch, slices

TOP = 20
#: A shard ends after so many term occurrences or documents; a longer text is a shard of its own.
SHARD_TOKENS, SHARD_DOCS = 2_000_000, 60_000
#: Postings in a block.
BLOCK = 128
#: Items searched for in one pass over the index.
ITEMS = 500
#: Head of a block: last document, end of its bytes, greatest frequency, least document length.
HEAD = np.dtype([("last", "<u4"), ("end", "<u4"), ("tf", "<u4"), ("n", "<u4")])


def terms_of(texts: list[bytes | None]) -> Batch:
    """The terms of texts: runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z in lower case."""
    return Batch([t or b"" for t in texts], letters=True)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variable-length bytes of non-negative values, seven bits each, the last byte without the high bit; and how many each takes."""
    size = 1 + sum((values >> (7 * k) > 0).astype(np.int64) for k in range(1, 5))
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(5):
        here = size > k
        out[at[here] + k] = ((values[here] >> (7 * k)) & 127) | np.where(size[here] > k + 1, 128, 0)
    return out, size


def unpacked(raw: np.ndarray) -> np.ndarray:
    first = np.flatnonzero(np.concatenate(([True], raw[:-1] < 128)))
    place = np.arange(len(raw)) - np.repeat(first, np.diff(first, append=len(raw)))
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), first)


class Shard:
    """Documents gathered by one task, until they are written as index rows."""

    def __init__(self):
        self.terms: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.ids: list[pa.Array] = []
        self.tokens = self.count = 0

    def add(self, ids: pa.Array, batch: Batch) -> None:
        self.terms.append(batch.hashes().view(np.int64))
        self.docs.append(batch.doc + self.count)
        self.lengths.append(np.diff(batch.first))
        self.ids.append(ids)
        self.tokens += len(batch.doc)
        self.count += len(ids)

    def rows(self, number: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """One row per term, then one of all documents."""
        lengths = np.concatenate(self.lengths)
        if self.tokens:
            yield self._lists(number, lengths, schema)
        ids = pa.concat_arrays(self.ids)
        held = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        yield pa.RecordBatch.from_arrays([
            pa.array([number]), pa.array([None], pa.int64()), pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())]),
            pa.array([None], pa.binary()), pa.array([lengths.astype("<u4").tobytes()], pa.binary()), held,
        ], schema=schema)

    def _lists(self, number: int, lengths: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
        terms, docs = np.concatenate(self.terms), np.concatenate(self.docs)
        order = np.argsort(terms, kind="stable")  # documents stay in order within a term
        terms, docs = terms[order], docs[order]
        new_term = np.diff(terms, prepend=terms[0]) != 0
        new_term[0] = True
        posting = np.flatnonzero(new_term | (np.diff(docs, prepend=-1) != 0))
        tf = np.diff(posting, append=len(terms))
        terms, docs, new_term = terms[posting], docs[posting], new_term[posting]
        start = np.flatnonzero(new_term)
        df = np.diff(start, append=len(terms))
        inner = np.arange(len(terms)) - np.repeat(start, df)
        head = np.flatnonzero(inner % BLOCK == 0)
        gap = np.diff(docs, prepend=0)
        gap[head] = docs[head]
        data, size = packed(np.stack([gap, tf], axis=1).ravel())
        size = size[0::2] + size[1::2]
        stop = np.append(head[1:], len(terms)) - 1
        ends = np.cumsum(size)
        base = np.repeat(ends[start] - size[start], -(-df // BLOCK))
        heads = np.zeros(len(head), HEAD)
        heads["last"], heads["end"] = docs[stop], ends[stop] - base
        heads["tf"], heads["n"] = np.maximum.reduceat(tf, head), np.minimum.reduceat(lengths[docs], head)
        blocks = np.concatenate(([0], np.cumsum(-(-df // BLOCK)))) * HEAD.itemsize
        edges = np.concatenate(([0], ends[np.append(start[1:], len(terms)) - 1]))
        rows = len(start)
        binary = lambda at, raw: pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(at.astype("<i4").tobytes()), pa.py_buffer(raw.tobytes())])
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(rows, number)), pa.array(terms[start]), pa.array(df.astype(np.int64)), pa.array(np.zeros(rows, np.int64)),
            binary(blocks, heads), binary(edges, data), pa.nulls(rows, schema.field("ids").type),
        ], schema=schema)


def build_index(docs: DataFrame, shelf: Shelf) -> DataFrame:
    """Index rows (shard, term, df, tokens, heads, data, ids) of all documents.

    A row without a term holds a shard's documents: in ``df`` those with a term,
    in ``tokens`` all their terms, in ``data`` the lengths, in ``ids`` the ids.
    """
    key = docs.schema["doc_id"].dataType.simpleString()

    def index(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, shard = TaskContext.get().partitionId(), 0, Shard()
        schema = None
        for frame in frames:
            ids, texts = frame.column("doc_id"), frame.column("text").cast(pa.binary()).to_pylist()
            schema = schema or pa.schema([
                ("shard", pa.int64()), ("term", pa.int64()), ("df", pa.int64()), ("tokens", pa.int64()),
                ("heads", pa.binary()), ("data", pa.binary()), ("ids", pa.list_(ids.type))])
            for a, b in slices(texts, 4 << 20):
                shard.add(ids.slice(a, b - a), terms_of(texts[a:b]))
                if shard.tokens >= SHARD_TOKENS or shard.count >= SHARD_DOCS:
                    yield from shard.rows((part << 32) + made, schema)
                    made, shard = made + 1, Shard()
        if shard.count:
            yield from shard.rows((part << 32) + made, schema)

    return shelf.put(docs.select("doc_id", "text").mapInArrow(
        index, f"shard long, term long, df long, tokens long, heads binary, data binary, ids array<{key}>"))


class Lists:
    """The lists of one shard that the items of a pass ask for, and the work of one item on them."""

    def __init__(self, table: pa.Table, docs: int, total: int):
        terms = table.column("term").to_pylist()
        at = terms.index(None)
        self.lengths = np.frombuffer(table.column("data")[at].as_py(), "<u4").astype(np.int64)
        self.ids = table.column("ids").combine_chunks().slice(at, 1).flatten()
        self.rank = np.empty(len(self.ids), np.int64)
        self.rank[pc.sort_indices(self.ids, null_placement="at_end").to_numpy()] = np.arange(len(self.ids))
        self.m = 75 + 25 * self.lengths * docs // max(total, 1)
        self.norm = lambda n: 75 + 25 * n * docs // max(total, 1)
        self.row = {t: i for i, t in enumerate(terms) if t is not None}
        self.heads = [np.frombuffer(x, HEAD) if x is not None else None for x in table.column("heads").to_pylist()]
        self.data = table.column("data").to_pylist()
        self.most = [None if h is None else self.gain(h["tf"].astype(np.int64), self.norm(h["n"].astype(np.int64))) for h in self.heads]
        self.decoded = 0

    @staticmethod
    def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        return 1_000_000_000 * tf // (1000 * tf + 12 * m)

    def read(self, row: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and gains of a list's blocks ``first`` to ``last``."""
        heads = self.heads[row]
        ends = heads["end"]
        pairs = unpacked(np.frombuffer(self.data[row], np.uint8)[int(ends[first - 1]) if first else 0 : int(ends[last])])
        docs, tf = pairs[0::2].copy(), pairs[1::2]
        begin = np.arange(0, len(docs), BLOCK)  # only a list's last block may be short
        total = np.cumsum(docs)
        docs = total - np.repeat(total[begin] - docs[begin], np.diff(begin, append=len(docs)))
        self.decoded += last - first + 1
        return docs, self.gain(tf, self.m[docs])

    def best(self, weights: dict[int, int], top: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the item's ``top`` documents in this shard, in no order.

        ``weights`` holds each term's weight times its repeats in the item.
        """
        lists = sorted(((w * int(self.most[r].max()), w, r) for t, w in weights.items() if w > 0 and (r := self.row.get(t)) is not None), reverse=True)
        rest = np.cumsum([0, *(x[0] for x in reversed(lists))])[::-1]  # what the lists from here on can add
        score, least = np.zeros(len(self.lengths), np.int64), 1
        at = 0
        while at < len(lists) and rest[at] >= least:  # essential: a document met only from here on may still enter
            _, w, r = lists[at]
            docs, gain = self.read(r, 0, len(self.heads[r]) - 1)
            score[docs] += w * gain
            least = max(least, self._floor(score, top))
            at += 1
        live = np.flatnonzero((score > 0) & (score + rest[at] >= least))
        places, bounds = [], []
        for _, w, r in lists[at:]:
            block = np.searchsorted(self.heads[r]["last"], live)
            there = block < len(self.heads[r])
            places.append(np.where(there, block, -1))
            bounds.append(np.where(there, w * self.most[r][np.minimum(block, len(self.heads[r]) - 1)], 0))
        left = sum(bounds, np.zeros(len(live), np.int64))
        keep = np.arange(len(live))
        for (_, w, r), block, bound in zip(lists[at:], places, bounds, strict=True):
            keep = keep[score[live[keep]] + left[keep] >= least]
            for b in np.unique(block[keep]):
                if b >= 0:
                    docs, gain = self.read(r, b, b)
                    score[docs] += w * gain  # documents given up get part of their score and are never returned
            left -= bound
            least = max(least, self._floor(score[live[keep]], top))
        keep = live[keep]
        keep = keep[score[keep] >= least]
        if len(keep) > top:
            keep = keep[np.lexsort((self.rank[keep], -score[keep]))[:top]]
        return keep, score[keep]

    @staticmethod
    def _floor(score: np.ndarray, top: int) -> int:
        return int(np.partition(score, -top)[-top]) if len(score) >= top else 0


def heaps(sought: Broadcast, docs: int, total: int, top: int) -> Callable[[pa.Table], pa.Table]:
    """Of the lists of one shard the rows (item, doc_id, score) of each item's heap."""
    def of_shard(table: pa.Table) -> pa.Table:
        lists = Lists(table, docs, total)
        item, place, score = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, weights in enumerate(sought.value):
            p, s = lists.best(weights, top)
            item.append(np.full(len(p), i, np.int32))
            place.append(p)
            score.append(s)
        return pa.table({"item": np.concatenate(item), "doc_id": lists.ids.take(pa.array(np.concatenate(place))), "score": np.concatenate(score)})

    return of_shard


def search(items: DataFrame, docs: DataFrame, top: int = TOP) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): of each item the ``top`` documents of highest score over 0.

    Equal scores go by ascending doc_id, null ids last. Null, empty and termless
    texts of documents are found by no item and count neither in the number of
    documents nor in their length; such items get no rows. Every row is a
    document of its own, so repeated rows are found and ranked each. Equal
    (item_id, text) rows are one item; one id with several texts is several
    items. Empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    shelf = Shelf(spark)
    key, item_key = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    index = build_index(docs, shelf)
    shards, lists = index.where("term is null"), index.where("term is not null")
    docs_n, total = (int(x or 0) for x in shards.agg(F.sum("df"), F.sum("tokens")).first())
    asked = items.select("item_id", "text").where("text is not null").distinct()
    passes = -(-asked.count() // ITEMS)
    found = []
    for n in range(passes):
        block = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == n).collect()  # about ITEMS rows
        batch = terms_of([r["text"].encode() for r in block])
        words = batch.hashes().view(np.int64)
        repeats = [Counter(words[a:b].tolist()) for a, b in zip(batch.first[:-1], batch.first[1:], strict=True)]
        terms = spark.createDataFrame([(t,) for t in sorted(set().union(*repeats))], "term long")
        wanted = lists.join(F.broadcast(terms), "term", "left_semi")
        df = {r["term"]: r["df"] for r in wanted.groupBy("term").agg(F.sum("df").alias("df")).collect()}
        weight = {t: math.floor(1000 * math.log((2 * docs_n + 2) / (2 * x + 1))) for t, x in df.items()}
        sought = spark.sparkContext.broadcast([{t: weight[t] * k for t, k in own.items() if t in weight} for own in repeats])
        best = wanted.unionByName(shards).groupBy("shard").applyInArrow(heaps(sought, docs_n, total, top), f"item int, doc_id {key}, score long")
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        # heaps of a slice of documents first, so that no task merges all of an item's
        sliced = best.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
        for by in (["item", "slice"], ["item"]):
            sliced = sliced.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item int, item_id {item_key}")
        found.append(shelf.put(sliced.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")))
    shelf.drop(index)
    out = found[0] if found else spark.createDataFrame([], f"item_id {item_key}, rank int, doc_id {key}, score long")
    for more in found[1:]:
        out = out.unionByName(more)
    return out
