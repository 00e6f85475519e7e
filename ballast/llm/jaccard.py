"""Connected near duplicates by an n-gram Jaccard join.

Every text becomes the set of its distinct word n-grams. Equal sets are one
class at once. The n-grams of the rest are put in one order, rare ones first,
and each class is indexed by the beginning of its ordered set that is long
enough for two sets over the threshold to share an n-gram of it. Pairs that meet
at such an n-gram must pass the length filter, the positional filter (what is
left after the shared n-gram in both orders must suffice) and the suffix filter
(the n-grams of both sets, counted by range of the order, must not differ too
much). What remains is verified once per pair by the sets themselves.

A frequent n-gram would pair all its classes with one another. So the join goes
in two steps: first each class is paired with the smallest class at the n-gram
only, and the verified links are closed to components. Then only pairs of
different components are formed, one side being outside the largest component at
the n-gram. Links within a component change nothing, so no component is lost.

Rarity is estimated by a count sketch of fixed size; any order is exact, a
better one only indexes less frequent n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ballast.llm.common import Shelf, text_ids, typed_ids
from ballast.llm.text import U64, Batch, batches, mix, shingles

WIDTH = 5
THRESHOLD_PERCENT = 80
#: Counters of the frequency sketch, as a power of two; four bytes each in a task, one when shared.
SKETCH_BITS = 19
#: Ranges of the order that the suffix filter counts.
RANGES = 64


def text_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The distinct n-grams of each text as sorted 64-bit values; letters A-Z count as lower case."""
    batch = Batch(texts)
    grams, ends = shingles(batch.hashes(), batch.first, width)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield np.unique(grams[a:b])


def components(links: DataFrame, shelf: Shelf) -> DataFrame:
    """Rows (node, component): the smallest node that links (a, b) lead to. Nodes without a link are left out.

    Each round takes the smallest label among a node and its neighbours and then
    the label of that label, so that rounds grow with the logarithm of a chain.
    """
    both = shelf.put(links.select(F.col("a").alias("node"), F.col("b").alias("near")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("near"))))
    label = shelf.put(both.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("component")))
    while True:
        near = both.join(label.select(F.col("node").alias("near"), F.col("component").alias("c")), "near").groupBy("node").agg(F.min("c").alias("c"))
        step = label.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "c").alias("component"))
        far = label.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = shelf.put(step.join(far, "component").select("node", "was", F.col("further").alias("component")))
        shelf.drop(label)
        if not new.where("component <> was").limit(1).count():
            shelf.drop(both)
            return new.select("node", "component")
        label = new.select("node", "component")


def could_reach(percent: int, n: Column, m: Column, at: Column, at_m: Column) -> Column:
    """Length and positional filter for sets of n and m whose first shared n-gram, in order, has these places.

    Both must have enough n-grams from there on. Shared n-grams that are not the
    pair's first one may be dropped by this as well.
    """
    least = -F.floor(-(percent * (n + m)) / F.lit(100 + percent))  # of shared n-grams
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (n - at >= least) & (m - at_m >= least)


def bitmap(ids: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of hashed ids, eight to sixteen bits an id and 16 MB at most, and its number of bits."""
    bits = 1 << min(27, max(15, (8 * ids.count()).bit_length()))
    spot = spot_of(bits)
    rows = ids.groupBy(F.floor(spot / 32768).alias("block")).agg(F.bitmap_construct_agg(spot % 32768).alias("bits")).collect()
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for r in rows:
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return out.ravel(), bits


def spot_of(bits: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(bits))


def verified(pairs: DataFrame, docs: DataFrame, ranges: DataFrame, width: int, percent: int, shelf: Shelf) -> DataFrame:
    """Of distinct pairs (a, b) those over the threshold: suffix filter, then the sets themselves."""
    key = docs.schema["doc_id"].dataType.simpleString()
    of = lambda side: ranges.select(F.col("doc_id").alias(side), F.col("n").alias(f"n_{side}"), F.col("ranges").alias(f"r_{side}"))
    apart = F.aggregate(F.zip_with("r_a", "r_b", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda x, y: x + y)
    most = (F.col("n_a") + F.col("n_b") - apart) / 2
    asked = shelf.put(
        pairs.join(of("a"), "a").join(of("b"), "b").where(100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)).select("a", "b"))
    wanted = shelf.put(asked.select(F.col("a").alias("doc_id")).unionByName(asked.select(F.col("b").alias("doc_id"))).distinct())

    marks, bits = bitmap(wanted)
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def spell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            spot = frame["spot"].to_numpy()
            for part, texts in batches([frame[(shared.value[spot >> 3] >> (spot & 7)) & 1 > 0]]):
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "grams": [s.tobytes() for s in text_sets(texts, width)]})

    # the bitmap spares most texts the way through a shuffle; the join is exact
    spelled = docs.where("doc_id is not null").select("doc_id", "text", spot_of(bits).alias("spot")).mapInPandas(spell, f"doc_id {key}, grams binary")
    sets = shelf.put(spelled.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"]))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            holds = []
            for x, y in zip(frame["x"], frame["y"], strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                shared = len(x) + len(y) - len(np.union1d(x, y))
                holds.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield frame.loc[holds, ["a", "b"]]

    filled = asked.join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("y")), "b")
    links = shelf.put(filled.mapInPandas(compare, f"a {key}, b {key}"))
    shelf.drop(asked, wanted, sets)
    return links


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id) for every row of ``docs``.

    A text without words, or null, has no shingles and is linked with nothing;
    one with fewer words than ``width`` is a single shingle. A null doc_id gets
    its size and itself, null, as component, and links with nothing. Repeated
    rows of an id are one document if their texts are equal; ids with several
    different texts are one node, linked by any of them. An empty table gives no
    rows. Columns other than doc_id and text are not read.
    """
    shelf = Shelf(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()
    cells, blocks = 1 << SKETCH_BITS, 64

    def survey(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(cells, np.int64)
        for frame, texts in batches(frames):
            out = {"n": [], "set_key": [], "ranges": []}
            held = []
            for s in text_sets(texts, width):
                held.append(s)
                out["n"].append(len(s))
                out["set_key"].append(s.sum(dtype=U64).tobytes() + mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).tobytes())
                out["ranges"].append(np.minimum(np.bincount((mix(s) >> U64(65 - RANGES.bit_length())).astype(np.int64), minlength=RANGES), 32767))
            total += np.bincount((np.concatenate(held) >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=cells)
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, **out, "block": None, "counts": None})
        if total.any():
            yield pd.DataFrame({"doc_id": None, "n": None, "set_key": None, "ranges": None, "block": range(blocks), "counts": [x.astype("<u4").tobytes() for x in total.reshape(blocks, -1)]})

    # sizes of the sets and each task's share of the sketch, from one pass over the texts
    found = text_ids(docs.select("doc_id", "text"), "doc_id").mapInPandas(survey, "doc_id string, n int, set_key binary, ranges array<smallint>, block int, counts binary")
    both = shelf.put(typed_ids(found, docs, "doc_id"))
    facts = both.where("block is null").drop("block", "counts")
    ranges = shelf.put(
        facts.where("n > 0 and doc_id is not null").groupBy("doc_id")
        .agg(F.first("n").alias("n"), F.first("ranges").alias("ranges"), (F.min("set_key") < F.max("set_key")).alias("several")))
    if ranges.where("several").limit(1).count():
        out = _by_text(docs, facts, width, percent, shelf)
        shelf.drop(both, ranges)
        return out
    sketch = docs.sparkSession.sparkContext.broadcast(_rarity(both.where("block is not null").select("block", "counts"), cells, blocks))

    sets = facts.where("n > 0 and doc_id is not null")
    classes = sets.groupBy("set_key").agg(F.min("doc_id").alias("a"), F.count("*").alias("rows"))
    copies = shelf.put(sets.select("set_key", F.col("doc_id").alias("b")).join(classes.where("rows > 1").drop("rows"), "set_key").where("a <> b").select("a", "b").distinct())

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rarity = sketch.value
        for frame, texts in batches(frames):
            gram, at, n, doc = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [], []
            for i, s in enumerate(text_sets(texts, width)):
                # sets over the threshold share all but this many of the larger one
                length = len(s) - -(-len(s) * percent // 100) + 1 if len(s) else 0
                order = np.lexsort((s, rarity[(s >> U64(64 - SKETCH_BITS)).astype(np.int64)]))[:length]
                gram.append(s[order])
                at.append(np.arange(length))
                n.append(len(s))
                doc.append(length)
            where = np.repeat(np.arange(len(texts)), doc)
            yield pd.DataFrame({"gram": np.concatenate(gram).view(np.int64), "doc_id": frame["doc_id"].to_numpy()[where], "n": np.array(n, np.int64)[where], "at": np.concatenate(at)})

    own = docs.select("doc_id", "text").where("doc_id is not null").join(copies.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_anti")
    indexed = shelf.put(own.mapInPandas(index, f"gram long, doc_id {key}, n int, at int"))
    met = indexed.groupBy("gram").agg(F.count("*").alias("rows")).where("rows > 1").select("gram")
    by_doc = W.partitionBy("doc_id")
    entries = shelf.put(
        indexed.join(met, "gram")
        .withColumn("score", F.count("*").over(by_doc) / F.col("n")))
    shelf.drop(indexed)

    lead = F.struct("score", "n", (-F.col("doc_id") if key in ("bigint", "int") else F.col("doc_id")).alias("tie"), F.col("doc_id").alias("a"), F.col("at").alias("at_a"))
    heads = entries.groupBy("gram").agg(F.max(lead).alias("lead")).select("gram", "lead.a", F.col("lead.n").alias("n_a"), "lead.at_a")
    star = shelf.put(
        entries.withColumnRenamed("doc_id", "b").join(heads, "gram").where("a <> b")
        .where(could_reach(percent, F.col("n"), F.col("n_a"), F.col("at"), F.col("at_a")))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    first = verified(star, docs, ranges, width, percent, shelf)
    label = components(first, shelf)

    # what is left: pairs of different components, one of them not the n-gram's largest
    placed = shelf.put(
        entries.drop("score").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")))
    most = placed.groupBy("gram", "component").agg(F.count("*").alias("rows")).groupBy("gram").agg(F.count("*").alias("kinds"), F.max_by("component", F.struct("rows", "component")).alias("main")).where("kinds > 1")
    mixed = placed.join(most.select("gram", "main"), "gram")
    right = mixed.select("gram", *[F.col(c).alias(f"{c}_b") for c in ("doc_id", "n", "at", "component")])
    rest = mixed.where("component <> main").join(right, "gram").where("component <> component_b and (component_b = main or doc_id < doc_id_b)").where(
        could_reach(percent, F.col("n"), F.col("n_b"), F.col("at"), F.col("at_b"))
    ).select(F.least("doc_id", "doc_id_b").alias("a"), F.greatest("doc_id", "doc_id_b").alias("b")).distinct().join(star, ["a", "b"], "left_anti")
    second = verified(rest, docs, ranges, width, percent, shelf)
    final = components(first.unionByName(second).unionByName(copies), shelf)
    out = shelf.put(
        facts.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))
    shelf.drop(both, copies, ranges, entries, star, first, placed, second)
    return out


def _by_text(docs: DataFrame, facts: DataFrame, width: int, percent: int, shelf: Shelf) -> DataFrame:
    """As ``near_duplicates``, where some ids have several sets: each text of an id is joined as a node of its own.

    The id and a digest of the text name the node; afterwards the nodes of an id
    and the ids of a component are closed together.
    """
    node = F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256))
    own = docs.where("doc_id is not null and text is not null").select("doc_id", node.alias("node"), "text")
    names = shelf.put(own.select("doc_id", "node").distinct())
    parts = near_duplicates(own.select(F.col("node").alias("doc_id"), "text"), width, percent)
    # nodes without words link with nothing, other than by their id
    placed = shelf.put(parts.where("n_shingles > 0").select(F.col("doc_id").alias("node"), "component_id").distinct().join(names, "node").select("doc_id", "component_id").distinct())
    least = placed.groupBy("component_id").agg(F.min("doc_id").alias("a"))
    links = shelf.put(placed.join(least, "component_id").where("a <> doc_id").select("a", F.col("doc_id").alias("b")).distinct())
    final = components(links, shelf)
    out = shelf.put(
        facts.select("doc_id", F.col("n").cast("long").alias("n_shingles")).join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))
    shelf.drop(names, placed, links)
    return out


def _rarity(counts: DataFrame, cells: int, blocks: int) -> np.ndarray:
    """Of each cell eighths of powers of two in its count: 4 MB of sums reach the driver at any input."""
    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(cells // blocks, np.int64)
        for x in frame["counts"]:
            total += np.frombuffer(x, "<u4")
        return pd.DataFrame({"block": frame["block"][:1], "counts": [total.tobytes()]})

    total = np.zeros((blocks, cells // blocks), np.int64)
    for r in counts.groupBy("block").applyInPandas(add, "block int, counts binary").collect():
        total[r.block] = np.frombuffer(r.counts, np.int64)
    return np.minimum(255, np.round(8 * np.log2(total.ravel() + 1))).astype(np.uint8)
