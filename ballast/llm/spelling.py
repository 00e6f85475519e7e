"""Spelling variants: words one edit apart, found by a frontier over a distributed trie.

The trie of all words is a table of edges (node, label, child). Chains without a
branch are one edge with a longer label, so that its depth is the number of
branchings, not of letters. A state (word, position, node, edits) says that the
word's letters up to the position lead to the node with so many edits. Each
round joins the states with the edges of their nodes: without an edit so far a
state follows its own letters, or replaces one, or leaves one out; with one edit
it must follow the rest of its letters exactly. A state that ends with one edit
on a word is a pair. A pair is found once: from the word whose replaced letter
is the smaller one, or that has one letter more.

Nodes are known by 64-bit hashes of their letters; every pair is compared
letter by letter at the end, so a collision cannot make one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import Shelf
from ballast.llm.text import U64, mix

#: Least code points and occurrences of a word; how much more frequent a form is.
LETTERS, OCCURRENCES, TIMES = 6, 5, 5
#: One run in so many loses a letter.
DELETED = 199
#: Counted words that a task holds before it hands them on.
HELD = 400_000
#: Words below a node of the trie for which one part of a join serves.
PART = 20_000
#: Nodes of at most this depth are at most 90 + 90 * 90, as runs know 90 lower-case letters.
SHALLOW = 2
#: Every letter of a run in lower case, everything else a blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_ROOT = int(mix(np.zeros(1, U64)).view(np.int64)[0])


def runs(text: str) -> Counter:
    """How often each lower-cased run of letters, as Latin-1 bytes, stands in a text."""
    return Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())


def word_of(run: bytes, seed: int) -> bytes:
    """The run, or what is left of it where its checksum asks for a deletion."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    if h % DELETED:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def count_words(docs: DataFrame) -> DataFrame:
    """Rows (word, n) of the words with enough letters and occurrences."""
    def counted(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held]), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for frame in frames:
            for i, text in zip(frame.column("id").to_pylist(), frame.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                seed = zlib.crc32(f"{i}:".encode())
                for run, n in runs(text).items():
                    if len(run) >= LETTERS and len(word := word_of(run, seed)) >= LETTERS:
                        held[word] += n
                if len(held) >= HELD:
                    yield handed()
                    held.clear()
        if held:
            yield handed()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text").mapInArrow(counted, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def prefixes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every prefix of every word, the empty one and the word included: word, depth, node and next letter (0 at the end)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8).astype(U64)
    first = np.cumsum(size) - size
    inner = np.arange(size.sum()) - np.repeat(first, size)
    power = np.cumprod(np.full(int(size.max(initial=0)) + 1, 0x9E3779B97F4A7C15, U64), dtype=U64)
    total = np.concatenate((np.zeros(1, U64), np.cumsum((letters + U64(1)) * power[inner], dtype=U64)))
    word = np.repeat(np.arange(len(words)), size + 1)
    depth = np.arange(len(word)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
    at = np.repeat(first, size + 1) + depth
    node = mix(total[at] - total[first[word]] + depth.astype(U64))
    follow = np.where(depth < size[word], np.append(letters, U64(0))[at], 0).astype(np.int32)
    return word, depth, node.view(np.int64), follow


def build_trie(words: DataFrame, shelf: Shelf) -> DataFrame:
    """Edges (node, label, child, own, parts, firsts) of the trie of ``words``.

    ``own`` is the word that ends at the child, ``parts`` into how many parts the
    child's edges are copied, ``firsts`` the letters that go on from there; null
    at a leaf.
    """
    def spread(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            texts = frame.column("word").to_pylist()
            word, depth, node, follow = prefixes(texts)
            yield pa.RecordBatch.from_arrays([frame.column("word").take(pa.array(word)), pa.array(depth.astype(np.int32)), pa.array(node), pa.array(follow)], names=["word", "depth", "node", "follow"])

    points = words.select("word").mapInArrow(spread, "word string, depth int, node long, follow int")
    ends = F.col("follow") == 0
    nodes = shelf.put(
        points.where("depth > 0").groupBy("node").agg(
            F.first("depth").alias("depth"), F.min("word").alias("sample"), F.count("*").alias("below"),
            F.max(F.when(ends, F.col("word"))).alias("own"), F.min("follow").alias("least"), F.max("follow").alias("most"))
        .where("own is not null or least < most")
        .select("node", "depth", F.expr("substring(sample, 1, depth)").alias("letters"), "below", "own"))

    def above(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            word, depth, node, follow = prefixes(frame.column("letters").to_pylist())
            inside = (depth > 0) & (follow > 0)
            yield pa.RecordBatch.from_arrays([frame.column("node").take(pa.array(word[inside])), pa.array(node[inside])], names=["child", "node"])

    # the nearest node on the way up; the root where there is none
    up = nodes.select("node", "letters").mapInArrow(above, "child long, node long")
    ends_at = nodes.select("node", "depth")
    shallow = up.join(F.broadcast(ends_at.where(F.col("depth") <= SHALLOW)), "node")
    deep = up.join(ends_at.where(F.col("depth") > SHALLOW), "node")
    parent = shallow.unionByName(deep).groupBy("child").agg(F.max_by("node", "depth").alias("node"), F.max("depth").alias("from"))
    edges = shelf.put(
        nodes.withColumnRenamed("node", "child").join(parent, "child", "left").select(
            F.coalesce("node", F.lit(_ROOT)).alias("node"), F.expr("substring(letters, coalesce(from, 0) + 1)").alias("label"), "child", "own",
            F.ceil(F.col("below") / PART).cast("int").alias("parts")))
    # at most 90 letters a node
    firsts = edges.groupBy(F.col("node").alias("child")).agg(F.concat_ws("", F.collect_set(F.substring("label", 1, 1))).alias("firsts"))
    return shelf.put(edges.join(firsts, "child", "left"))


def one_edit_pairs(words: DataFrame, shelf: Shelf) -> DataFrame:
    """Rows (word, near) of all words one inserted, deleted or replaced letter apart, each pair once."""
    count = words.count()
    edges = build_trie(words, shelf)
    copies = edges.groupBy("child").agg(F.first("parts").alias("copies")).withColumnRenamed("child", "node")
    root = -(-count // PART)
    # the edges of a node below which many words lie are copied, and its states dealt to the copies
    dealt = shelf.put(
        edges.join(copies, "node", "left").withColumn("copies", F.coalesce("copies", F.lit(max(1, root))))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        .select("node", "part", "label", "child", "own", "parts", "firsts"))
    whole = F.length("word")
    states = words.select("word", F.lit(0).alias("at"), F.lit(_ROOT).alias("node"), F.lit(0).alias("edits"), F.lit(False).alias("end"), F.lit(max(1, root)).alias("parts"))
    rounds, tables = [], []
    here, after = F.expr("substring(word, at + 1, 1)"), F.expr("substring(word, at + 2, 1)")
    while True:
        # leaving out a letter: of equal letters in a row the last
        shorter = states.where((F.col("edits") == 0) & (F.col("at") < whole) & (here != after)).withColumn("at", F.col("at") + 1).withColumn("edits", F.lit(1))
        done = shorter.where((F.col("at") == whole) & F.col("end")).select("word", F.expr("substring(word, 1, at - 1)").alias("near"))
        going = states.unionByName(shorter).where(F.col("at") < whole).withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")).drop("parts", "end")
        length = F.length("label")
        same = F.expr("substring(word, at + 1, length(label))") == F.col("label")
        other = (F.col("edits") == 0) & (F.substring("label", 1, 1) > here) & (F.expr("substring(word, at + 2, length(label) - 1)") == F.expr("substring(label, 2)"))
        moved = going.join(dealt, ["node", "part"]).where(same | other).select(
            "word", (F.col("at") + length).alias("at"), F.col("child").alias("node"), F.when(same, F.col("edits")).otherwise(1).alias("edits"),
            F.col("own").isNotNull().alias("end"), "parts", "own", "firsts")
        met = (F.col("edits") == 1) & (F.col("at") == whole) & F.col("own").isNotNull()
        goes_on = (F.col("at") < whole) & F.col("firsts").isNotNull() & ((F.col("edits") == 0) | F.expr("instr(firsts, substring(word, at + 1, 1)) > 0"))
        step = shelf.put(
            moved.select("word", "at", "node", "edits", "end", "parts", F.when(met, F.col("own")).alias("near"), "firsts")
            .where(F.col("near").isNotNull() | goes_on).drop("firsts")
            .unionByName(done.select("word", F.lit(0).alias("at"), F.lit(0).cast("long").alias("node"), F.lit(1).alias("edits"), F.lit(False).alias("end"), F.lit(1).alias("parts"), "near")))
        tables.append(step)
        rounds.append(step.where("near is not null").select("word", "near"))
        states = step.where(F.col("near").isNull()).drop("near")
        if states.isEmpty():
            break
    pairs = rounds[0]
    for more in rounds[1:]:
        pairs = pairs.unionByName(more)
    out = shelf.put(pairs.where(F.levenshtein("word", "near", 1) == 1).distinct())
    shelf.drop(edges, dealt, *tables)
    return out


def group_variants(docs: DataFrame) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n) of every word of at least six letters and five occurrences.

    ``form`` is the most frequent word one edit away (ties: the smallest) if it
    is at least five times as frequent, else null; ``root`` the last word that
    forms lead to, or the word itself. A null text has no words, a null doc_id
    counts as the empty text in the checksum that deletes letters, and repeated
    rows count each. Very long runs are words like others. An empty table gives
    no rows. Other columns are not read.
    """
    shelf = Shelf(docs.sparkSession)
    words = shelf.put(count_words(docs))
    pairs = one_edit_pairs(words, shelf)
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))
    best = both.join(words.withColumnRenamed("word", "near").withColumnRenamed("n", "near_n"), "near").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    held = -F.col("best.less") >= TIMES * F.col("n")
    found = shelf.put(
        words.join(best, "word", "left").select(
            "word", F.when(held, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(held, -F.col("best.less")).alias("form_n")))
    # a form is five times as frequent, so chains are short; each round doubles the way taken
    way = shelf.put(found.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        far = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = shelf.put(way.join(far, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        shelf.drop(way)
        way = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    out = shelf.put(found.join(way, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
    shelf.drop(words, pairs, found, step)
    return out
