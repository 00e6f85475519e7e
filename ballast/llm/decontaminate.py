"""Benchmark items inside documents, by size-partitioned MinHash containment search.

Items are short and documents long, so the Jaccard similarity of the two says
little; what counts is the share of an item's word shingles that a document
holds. Items are partitioned by the power of two of their number of shingles.
Each partition keeps a bottom-k MinHash sketch of its items, with k just above
the number of shingles that an item of the partition may miss at the wanted
containment. A document that holds enough of an item therefore holds at least
one sketch shingle: no such pair is lost, and documents are asked for few
values. Candidate pairs are then verified by the exact shingles, as text.

Only DataFrame operations. Sketches go to a written table, so that Spark
broadcasts them if their size on disk allows and shuffles both sides otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ballast.llm.common import Shelf, let, words_of

WIDTH = 5
CONTAINMENT = 0.8


def shingles(words: Column, width: int, as_text: bool) -> Column:
    """The ``width``-word shingles of an array of words, as text or as 64-bit values."""
    def all_of(w: Column) -> Column:
        def one(i: Column) -> Column:
            part = F.slice(w, i + 1, width)
            return F.array_join(part, " ") if as_text else F.xxhash64(*[F.get(w, i + k) for k in range(width)])

        return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), one))

    return let(words, all_of)


def item_shingles(items: DataFrame, width: int) -> DataFrame:
    """Distinct shingles (item_id, n_words, shingle, h); an item of fewer words is one shingle of its own width."""
    words = items.where(F.col("text").isNotNull()).select("item_id", words_of(F.lower("text")).alias("w")).where(F.size("w") > 0)
    wide = words.where(F.size("w") >= width).select("item_id", F.lit(width).alias("width"), F.explode(shingles(F.col("w"), width, True)).alias("shingle"))
    short = words.where(F.size("w") < width).select("item_id", F.size("w").alias("width"), F.array_join("w", " ").alias("shingle"))
    return wide.unionByName(short).distinct().withColumn("parts", F.split("shingle", " ")).withColumn(
        "h", F.coalesce(*[F.when(F.col("width") == k, F.xxhash64(*[F.get("parts", F.lit(i)) for i in range(k)])) for k in range(1, width + 1)])
    ).drop("parts")


def sketches(shingled: DataFrame, containment: float) -> DataFrame:
    """The bottom-k sketch rows (h, width, item_id, need) by size partition.

    ``need`` is the least number of sketch values that a document with enough of
    the item holds.
    """
    n = F.col("n")
    sized = shingled.withColumn("n", F.count("*").over(W.partitionBy("item_id")))
    largest = F.pow(F.lit(2.0), F.floor(F.log2(n)) + 1) - 1  # of the item's partition
    missable = lambda x: F.floor(x * (1 - containment) + 1e-9).cast("long")
    k = F.least(missable(largest) + 1, n)
    rank = F.row_number().over(W.partitionBy("item_id").orderBy("h", "shingle"))
    return sized.withColumn("k", k).withColumn("rank", rank).where("rank <= k").select(
        "h", "width", "item_id", (F.col("k") - missable(n)).alias("need"))


def contained_items(docs: DataFrame, items: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared, containment) with enough containment.

    Words are lower-cased. An item with fewer words than ``width`` counts as one
    shingle of its own length. Null and empty texts on either side match
    nothing, nor do rows without an id; repeated items and documents of equal id
    count once each. Empty tables give no rows. Columns other than doc_id, item_id and text are not read.
    """
    shelf = Shelf(docs.sparkSession)
    shingled = shelf.put(item_shingles(items.select("item_id", "text"), width))
    sketch = shelf.put(sketches(shingled, containment))
    widths = [r.width for r in sketch.select("width").distinct().collect()]  # at most ``width`` values
    docs = docs.select("doc_id", "text").where("text is not null and doc_id is not null")
    hits = None
    for size in sorted(widths):
        held = docs.select("doc_id", F.explode(shingles(words_of(F.lower("text")), size, False)).alias("h"))
        part = held.join(sketch.where(F.col("width") == size), "h").select("doc_id", "item_id", "h", "need")
        hits = part if hits is None else hits.unionByName(part)
    schema = docs.select("doc_id").crossJoin(items.select("item_id").limit(0)).limit(0)
    if hits is None:
        return schema.select("doc_id", "item_id", *[F.lit(0).cast("long").alias(c) for c in ("n_item", "n_shared")], F.lit(0.0).alias("containment"))
    candidates = shelf.put(
        hits.groupBy("doc_id", "item_id").agg(F.count_distinct("h").alias("found"), F.max("need").alias("need"))
        .where("found >= need").select("doc_id", "item_id"))
    asked = docs.join(candidates.select("doc_id").distinct(), "doc_id", "left_semi")
    exact = None
    for size in sorted(widths):
        held = asked.select("doc_id", F.explode(F.array_distinct(shingles(words_of(F.lower("text")), size, True))).alias("shingle"))
        part = held.join(shingled.where(F.col("width") == size).select("item_id", "shingle"), "shingle")
        exact = part if exact is None else exact.unionByName(part)
    sizes = shingled.groupBy("item_id").agg(F.count("*").alias("n_item"))
    return (
        exact.join(candidates, ["doc_id", "item_id"], "left_semi")
        .groupBy("doc_id", "item_id").agg(F.count_distinct("shingle").alias("n_shared"))
        .join(sizes, "item_id")
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))
        .where(F.col("n_shared") >= F.lit(containment) * F.col("n_item") - 1e-9)
        .select("doc_id", "item_id", "n_item", "n_shared", "containment")
    )
