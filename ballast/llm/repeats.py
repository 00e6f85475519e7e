"""Repeated byte strings of a corpus, found by suffix sorting of shards.

Which strings can repeat at all is settled first. Of all short grams in a string
of ``size`` bytes the one of smallest hash is the string's anchor; equal strings
have equal anchors, so only strings whose anchor occurs twice are looked at, and
the strings around one anchor form a segment of text. Equal segments are counted,
not compared. Different segments of one anchor go to one shard, once each, where
external induced sorting (see ``induced``) finds the strings that they share as
neighbours with a long common prefix. Anchors with so many different segments
that a shard would grow beyond bounds are dealt out string by string instead and
counted there.

Texts are known by two 64-bit hashes and their length; copies are read once. No
text, and no group of equal anchors, meets in one place as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import Shelf
from ballast.llm.induced import suffix_array
from ballast.llm.text import U64, batches, mix

SIZE = 200
#: Bytes of the grams among which anchors are chosen.
GRAM = 32
#: Mean bytes of the segments that one task sorts.
SHARD_BYTES = 6 << 20
#: An anchor with more different segments than fill a shard is dealt out string by string.
CROWD = SHARD_BYTES // 300
#: Bytes of one text that are looked at together; stretches overlap, so that nothing is lost.
STRETCH = 1 << 23


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all grams of ``gram`` bytes (8, 16, 32, ...), one per starting byte."""
    x = raw.astype(U64)
    width = 1
    while width < 8:
        x = (x[:-width] << U64(8 * width)) | x[width:]
        width *= 2
    while width < gram:
        x = x[:-width] * U64(0x9E3779B97F4A7C15) + x[width:]
        width *= 2
    return mix(x)


def anchors(text: bytes, size: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first, count, spot): the strings that start at first .. first+count-1 have their anchor at spot."""
    parts = [_anchors(text[a : a + STRETCH + size - 1], size, gram, a) for a in range(0, max(1, len(text) - size + 1), STRETCH)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors(text: bytes, size: int, gram: int, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(text) - size + 1
    if n < 1:
        return np.zeros(0, U64), *[np.zeros(0, np.int64)] * 3
    value = gram_hashes(np.frombuffer(text, np.uint8), gram)
    # the smallest hash decides, of equal ones the leftmost
    low = (value & ~U64(STRETCH * 2 - 1)) | np.arange(len(value), dtype=U64)
    width, among = 1, size - gram + 1
    while 2 * width <= among:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < among:
        low = np.minimum(low[: len(low) - (among - width)], low[among - width :])
    at = (low & U64(STRETCH * 2 - 1)).astype(np.int64)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return value[at[first]], first + base, np.diff(first, append=n), at[first] + base


def span_key(text: bytes, first: np.ndarray, count: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit value of each segment text[first : first + count + size - 1]."""
    raw = np.frombuffer(text, np.uint8)
    # polynomial values of all beginnings; the value of a stretch is a difference scaled to its place
    power, inverse = _powers(len(raw))
    power = power[: len(raw)]
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * power, out=total[1:])
    end = first + count + size - 1
    return mix((total[end] - total[first]) * inverse[first] + count.astype(U64))


_TABLES: list[np.ndarray] = [np.zeros(0, U64), np.zeros(0, U64)]
_ODD = 0xD1342543DE82EF95


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and their inverses modulo 2^64."""
    if len(_TABLES[0]) < n + 1:
        n = max(n + 1, 1 << 16)
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            table = np.full(n, base, U64)
            table[0] = 1
            _TABLES[k] = np.cumprod(table, dtype=U64)
    return _TABLES[0], _TABLES[1]


def shared_strings(segments: list[bytes], counts: np.ndarray, spots: np.ndarray, size: int) -> np.ndarray:
    """Which of the first ``count`` strings of each segment, one after another, also start elsewhere in the segments.

    Equal strings have equal anchors at equal places, so that all segments can be
    cut into blocks from their anchors' places (``spots``) on: the blocks are the
    symbols that are sorted. Strings that share all their whole blocks are
    neighbours with a common prefix of that many blocks; among them the bytes in
    front of the first and behind the last block are compared.
    """
    block = 32 if size >= 128 else 8
    blocks = (size - block + 1) // block  # whole blocks of a string, wherever it begins
    length = np.fromiter(map(len, segments), np.int64, len(segments))
    base = np.cumsum(length) - length
    eight, width = np.frombuffer(b"".join(segments), np.uint8).astype(U64), 1
    while width < 8:  # the eight bytes from each place on
        eight = eight[:-width] | (eight[width:] << U64(8 * width))
        width *= 2
    offset = spots % block
    made = (length - offset) // block
    of = np.repeat(np.arange(len(segments)), made)
    place = offset[of] + block * (np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made))  # of each block in its segment
    words = [eight[base[of] + place + k] for k in range(0, block, 8)]
    rank = np.lexsort(words)
    fresh = np.zeros(len(of), bool)
    for x in words:
        fresh[1:] |= x[rank[1:]] != x[rank[:-1]]
    names = np.empty(len(of), np.int64)
    names[rank] = np.cumsum(fresh) + 1
    wall = int(names.max()) + 1
    text = np.full(len(of) + len(segments) + 1, wall, np.int64)
    at = np.arange(len(of)) + of
    text[at], text[-1] = names, 0
    order, lcp = suffix_array(text, wall + 1, blocks, wall)
    group = np.empty(len(text), np.int64)
    group[order] = np.cumsum(lcp < blocks)
    group = group[at]
    some = np.flatnonzero(np.bincount(group)[group] > 1)
    out, first = np.zeros(counts.sum(), bool), np.cumsum(counts) - counts
    for left in range(block):
        begin = place[some] - left
        inside = (begin >= 0) & (begin < counts[of[some]])
        own, begin = some[inside], begin[inside]
        where = base[of[own]] + begin
        # eight bytes at a time; what of them lies in the blocks is equal anyway
        front = [eight[where + k] for k in range(0, left, 8)]
        behind = [eight[where + size - 8 - k] for k in range(0, size - blocks * block - left, 8)]
        keys = [*front, *behind, group[own]]
        rank = np.lexsort(keys)
        same = np.ones(max(0, len(own) - 1), bool)
        for x in keys:
            same &= x[rank[1:]] == x[rank[:-1]]
        string = first[of[own]] + begin
        out[string[rank[1:][same]]] = True
        out[string[rank[:-1][same]]] = True
    return out


def runs_of(marked: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, from, to) of each run of marks; runs end with their segment."""
    of = np.repeat(np.arange(len(counts)), counts)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    begins = marked & ~(np.concatenate(([False], marked[:-1])) & (inner > 0))
    ends = marked & ~(np.concatenate((marked[1:], [False])) & (inner < counts[of] - 1))
    return of[begins], inner[begins], inner[ends] + 1


def _keys() -> tuple[Column, Column]:
    return F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(17), "text", F.octet_length("text")).alias("k2")


def repeated_spans(docs: DataFrame, shelf: Shelf, size: int = SIZE) -> DataFrame:
    """Rows (k1, k2, spans): of each text with repeats the covered stretches of bytes, in order."""
    facts = shelf.put(docs.where(F.octet_length("text") >= size).select(*_keys(), F.octet_length("text").alias("n_bytes")).groupBy("k1", "k2", "n_bytes").agg(F.count("*").alias("rows")))
    whole = facts.where("rows > 1").select("k1", "k2", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").cast("long").alias("end"))).alias("spans"))

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, texts in batches(frames):
            found = [anchors(x, size) for x in texts]
            n = [len(x[0]) for x in found]
            yield pd.DataFrame({
                "h": np.concatenate([x[0] for x in found]).view(np.int64), "at": np.concatenate([x[1] for x in found]),
                "k1": np.repeat(frame["k1"].to_numpy(), n), "k2": np.repeat(frame["k2"].to_numpy(), n),
            })

    keyed = docs.where(F.octet_length("text") >= size).select(*_keys(), "text")
    found = shelf.put(keyed.mapInPandas(choose, "h long, at long, k1 long, k2 long"))
    # an anchor in two texts, or at two places of one; copies of a text are one text
    shared = found.groupBy("h").agg(*[f(c).alias(f"{f.__name__}_{c}") for c in ("k1", "k2", "at") for f in (F.min, F.max)]).where("min_k1 <> max_k1 or min_k2 <> max_k2 or min_at <> max_at").select("h")
    wanted = shelf.put(found.select("h", "k1", "k2").join(shared, "h").distinct().groupBy("k1", "k2").agg(F.collect_list("h").alias("anchors")))  # a text's own
    shelf.drop(found)
    texts = shelf.put(keyed.join(wanted.select("k1", "k2"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).join(wanted, ["k1", "k2"]))
    shelf.drop(wanted)

    def segment(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, raw in batches(frames):
            rows, n = [], []
            for own, x in zip(frame["anchors"], raw, strict=True):
                h, first, count, spot = anchors(x, size)
                keep = np.flatnonzero(np.isin(h, np.asarray(own, np.int64).view(U64)))
                h, first, count, spot = h[keep], first[keep], count[keep], spot[keep]
                rows.append((h.view(np.int64), span_key(x, first, count, size).view(np.int64), first, count, spot - first))
                n.append(len(keep))
            columns = dict(zip(("h", "segment", "first", "n", "spot"), map(np.concatenate, zip(*rows, strict=True)), strict=True))
            yield pd.DataFrame({**columns, "k1": np.repeat(frame["k1"].to_numpy(), n), "k2": np.repeat(frame["k2"].to_numpy(), n)})

    places = shelf.put(texts.mapInPandas(segment, "h long, segment long, first long, n long, spot long, k1 long, k2 long"))
    kinds = shelf.put(places.groupBy("h", "segment").agg(F.count("*").alias("rows"), F.min(F.struct("k1", "k2", "first", "n", "spot")).alias("one")))
    crowds = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    mixed = shelf.put(kinds.join(crowds, "h").select("h", "segment", "kinds", (F.col("rows") == 1).alias("alone"), "one.*"))
    shards = max(1, -(-int(mixed.where(F.col("kinds") <= CROWD).agg(F.sum(F.col("n") + size)).first()[0] or 0) // SHARD_BYTES))

    def spell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, raw in batches(frames):
            rows = [(a["h"], a["segment"], a["alone"], a["n"], a["spot"], x[a["first"] : a["first"] + a["n"] + size - 1]) for asked, x in zip(frame["asked"], raw, strict=True) for a in asked]
            yield pd.DataFrame(rows, columns=["h", "segment", "alone", "n", "spot", "bytes"])

    of_text = lambda rows: texts.drop("anchors").join(rows.groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "segment", "alone", "first", "n", "spot")).alias("asked")), ["k1", "k2"])
    form = "h long, segment long, alone boolean, n long, spot long, bytes binary"

    def sort_shard(frame: pd.DataFrame) -> pd.DataFrame:
        counts = frame["n"].to_numpy()
        of, a, b = runs_of(shared_strings(frame["bytes"].tolist(), counts, frame["spot"].to_numpy(), size), counts)
        alone = frame["alone"].to_numpy()[of]
        return pd.DataFrame({"h": frame["h"].to_numpy()[of], "segment": frame["segment"].to_numpy()[of], "a": a, "b": b})[alone]

    runs = "h long, segment long, a long, b long"
    sorted_runs = of_text(mixed.where(F.col("kinds") <= CROWD)).mapInPandas(spell, form) \
        .withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards))).groupBy("shard").applyInPandas(sort_shard, runs)

    def strings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n = frame["n"].to_numpy()
            at = [np.arange(x) for x in n]
            w = [span_key(x, a, np.ones(len(a), np.int64), size) for x, a in zip(frame["bytes"], at, strict=True)]
            if len(n):
                yield pd.DataFrame({**{c: np.repeat(frame[c].to_numpy(), n) for c in ("h", "segment", "alone")}, "a": np.concatenate(at), "w": np.concatenate(w).view(np.int64)})

    single = of_text(mixed.where(F.col("kinds") > CROWD)).mapInPandas(spell, form).mapInPandas(strings, "h long, segment long, alone boolean, a long, w long")
    # two different strings of one anchor have different values; a string's places differ in segment or start
    counted = single.groupBy("h", "w").agg(F.count("*").alias("rows")).where("rows > 1").select("h", "w")
    crowded_runs = single.where("alone").join(counted, ["h", "w"]).select("h", "segment", "a", (F.col("a") + 1).alias("b"))
    equal_runs = kinds.where("rows > 1").select("h", "segment", F.lit(0).cast("long").alias("a"), F.col("one.n").alias("b"))
    spans = shelf.put(
        places.join(equal_runs.unionByName(sorted_runs).unionByName(crowded_runs), ["h", "segment"])
        .select("k1", "k2", (F.col("first") + F.col("a")).alias("start"), (F.col("first") + F.col("b") - 1 + size).alias("end")))
    shelf.drop(texts, places, kinds, mixed)
    # stretches of one text, at most as many as its anchors and edges; each ends after those before it
    merged = spans.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("s")).select("k1", "k2", F.zip_with(
        F.filter("s", lambda x, i: (i == 0) | (x["start"] > F.get("s", i - 1)["end"])),
        F.filter("s", lambda x, i: (i == F.size("s") - 1) | (F.get("s", i + 1)["start"] > x["end"])),
        lambda x, y: F.struct(x["start"].alias("start"), y["end"].alias("end"))).alias("spans"))
    out = shelf.put(merged.join(whole.select("k1", "k2"), ["k1", "k2"], "left_anti").unionByName(whole))
    shelf.drop(spans, facts)
    return out


def inside_character(data: Column, at: Column) -> Column:
    """Whether a byte, counted from 0, continues a character."""
    return F.coalesce(F.hex(F.substring(data, at.cast("int") + 1, F.lit(1))).between("80", "BF"), F.lit(False))


def whole_characters(data: Column, span: Column) -> Column:
    """The part of a span that holds whole characters only."""
    def steps(at: Column, way: int) -> Column:
        out = F.when(~inside_character(data, at), 0)
        for k in (1, 2):
            out = out.when(~inside_character(data, at + way * k), k)
        return out.otherwise(3)

    start, end = span["start"], span["end"]
    first = start + steps(start, 1)
    return F.struct(first.alias("start"), F.greatest(first, end - steps(end, -1)).alias("end"))


def without_repeats(docs: DataFrame, size: int = SIZE, characters: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with ``spans`` (start, end of each covered stretch of UTF-8 bytes) and ``kept`` (the other bytes).

    Every byte is covered that lies in a string of ``size`` bytes which also
    starts elsewhere, in the same text or another. A null text counts as empty,
    as do texts shorter than ``size`` for this purpose: nothing is covered.
    With ``characters`` a character that is covered in part stays whole.
    Repeated rows cover each other. An empty table gives no rows. Columns of
    ``docs`` named spans or kept are replaced.
    """
    shelf = Shelf(docs.sparkSession)
    docs = docs.drop("spans", "kept")
    spans = repeated_spans(docs.select("text"), shelf, size).withColumnsRenamed({"k1": "text_key_1", "k2": "text_key_2"})
    k1, k2 = _keys()
    # nulls hash like anything else, but have no row in ``spans``
    joined = docs.select("*", k1.alias("own_key_1"), k2.alias("own_key_2")).join(spans, (F.col("own_key_1") == F.col("text_key_1")) & (F.col("own_key_2") == F.col("text_key_2")), "left") \
        .drop("own_key_1", "own_key_2", "text_key_1", "text_key_2")
    bytes_of = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    spans_or = F.coalesce("spans", none)
    if characters:
        spans_or = F.transform(spans_or, lambda s: whole_characters(bytes_of, s))
    # what lies between the spans: bytes are cut in the binary form
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans_or, lambda s: s["end"]))
    ends = F.concat(F.transform(spans_or, lambda s: s["start"]), F.array(F.octet_length(bytes_of).cast("long")))
    pieces = F.zip_with(starts, ends, lambda a, b: F.hex(F.substring(bytes_of, (a + 1).cast("int"), (b - a).cast("int"))))
    kept = F.when(F.size(spans_or) == 0, bytes_of).otherwise(F.unhex(F.array_join(pieces, "")))
    return joined.withColumn("kept", kept).withColumn("spans", spans_or)
