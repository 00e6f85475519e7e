"""Quality rules: decision lists learned by sequential covering.

Whole-text statistics are computed once for every document and written. The
labelled ones teach an ordered list of rules that reject: each rule is a
conjunction of thresholds, grown by information gain on two thirds of the
labelled rows, pruned back on the other third, and the rows it covers are set
aside before the next is grown. The list becomes one ordered Spark conditional.

Only DataFrame operations. One aggregation per growing step returns the counts
of all candidate thresholds, a fixed number of values, to the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import Shelf, fold, let, words_of

#: Candidate thresholds per statistic: this many quantiles of the labelled rows.
CUTS = 24
MAX_RULES = 12
MAX_CONDITIONS = 4
#: A rule is kept if this share of the held-back rows that it covers is of low quality.
LEAST_PRECISION = 0.9


def statistics(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_marks.

    A null text counts as an empty one and has zeros throughout.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return docs.select(
        "doc_id",
        let(words_of(F.col("text")), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        )).alias("w"),
        let(lines, lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )).alias("l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit(r"[!?.,;:]")).cast("long").alias("n_marks"),
    ).select("doc_id", "w.*", "l.*", "n_symbols", "n_upper", "n_marks")


def repeated_words(w: Column) -> Column:
    """How many words lie in three-word windows that the text holds twice or more.

    Window hashes and positions are packed into sorted numbers, so that equal
    windows become neighbours; neighbours with equal hashes are compared by
    their words.
    """
    bits = F.length(F.bin(F.size(w).cast("long")))
    packed = F.when(F.size(w) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: _pack(w, i, bits),
    )).otherwise(F.array().cast("array<bigint>"))  # no nulls in either: sorted as primitive values

    def covered(sorted_windows: Column) -> Column:
        def place(x: Column) -> Column:
            return (x.bitwiseAND(_ones(bits))).cast("int")

        def same(x: Column, y: Column) -> Column:
            equal = F.call_function("shiftright", x, bits) == F.call_function("shiftright", y, bits)
            for k in range(3):
                equal = equal & (F.get(w, place(x) + k) == F.get(w, place(y) + k))
            return F.coalesce(equal, F.lit(False))

        twice = F.filter(sorted_windows, lambda x, i: same(x, F.get(sorted_windows, i - 1)) | same(x, F.get(sorted_windows, i + 1)))
        at = F.sort_array(F.transform(twice, place))
        return let(at, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))

    return let(F.sort_array(packed), covered)


def _ones(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits) - F.lit(1).cast("long")


def _pack(w: Column, i: Column, bits: Column) -> Column:
    window = F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    return F.call_function("shiftleft", window, bits).bitwiseOR(i.cast("long"))


def ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def features() -> dict[str, Column]:
    """What the rules may ask for."""
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": ratio("word_chars", "n_words"),
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "duplicate_lines": ratio("n_dup_lines", "n_lines"),
        "repeated_words": ratio("n_repeat_words", "n_words"),
        "upper_share": ratio("n_upper", "word_chars"),
        "marks_per_word": ratio("n_marks", "n_words"),
        "words_per_line": ratio("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float
    bin: int  # rows in bins over this one are above

    def holds(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def in_bins(self) -> Column:
        value = F.col(f"bin_{self.feature}")
        return value > self.bin if self.above else value <= self.bin


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    covered: int
    precision: float

    def holds(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.holds()
        return out

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.threshold:.6g}" for c in self.conditions)


def learn(labelled: DataFrame, shelf: Shelf) -> list[Rule]:
    """Rules for rows (doc_id, statistics, bad boolean). No rows, or one class only, give no rules."""
    names = list(features())
    marks = labelled.agg(*[F.percentile_approx(features()[f], [k / CUTS for k in range(1, CUTS)], 10000).alias(f) for f in names]).first()
    cuts = {f: sorted(set(marks[f] or [])) for f in names}
    binned = shelf.put(labelled.select(
        (fold(F.col("doc_id"), 3) == 0).alias("held"), F.col("bad").cast("long").alias("bad"),
        *[F.size(F.filter(F.array(*[F.lit(c) for c in cuts[f]]).cast("array<double>"), _under(features()[f]))).alias(f"bin_{f}") for f in names],
    ).groupBy("held", "bad", *[f"bin_{f}" for f in names]).agg(F.count("*").alias("n")))
    rules: list[Rule] = []
    left = binned
    for _ in range(MAX_RULES):
        rule = _prune(left, _grow(left, names, cuts))
        if rule is None:
            break
        rules.append(rule)
        hit = F.lit(True)
        for c in rule.conditions:
            hit = hit & c.in_bins()
        left = left.where(~hit)
    shelf.drop(binned)
    return rules


def _under(value: Column):
    return lambda cut: cut < value


def _grow(left: DataFrame, names: list[str], cuts: dict[str, list[float]]) -> list[Condition]:
    """Add the condition of greatest FOIL gain until no row of good quality is covered."""
    rows, chosen = left.where(~F.col("held")), []
    for _ in range(MAX_CONDITIONS):
        counts = rows.select("bad", "n", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"bin_{f}").alias("b")) for f in names])).alias("x")) \
            .groupBy("x.f", "x.b").agg(F.sum(F.col("bad") * F.col("n")).alias("p"), F.sum((1 - F.col("bad")) * F.col("n")).alias("q")).collect()  # names * CUTS rows
        by: dict[str, dict[int, tuple[int, int]]] = {}
        for r in counts:
            by.setdefault(r.f, {})[r.b] = (r.p, r.q)
        if not by:
            break
        any_feature = next(iter(by.values()))
        p0, q0 = (sum(v[k] for v in any_feature.values()) for k in (0, 1))
        if not p0 or not q0:
            break
        base, best = math.log2(p0 / (p0 + q0)), (1e-9, None)
        for f in names:
            p = q = 0
            for b, cut in enumerate(cuts[f]):
                p, q = p + by[f].get(b, (0, 0))[0], q + by[f].get(b, (0, 0))[1]
                for above, (x, y) in ((False, (p, q)), (True, (p0 - p, q0 - q))):
                    if x:
                        gain = x * (math.log2(x / (x + y)) - base)
                        if gain > best[0]:
                            best = (gain, Condition(f, above, cut, b))
        if best[1] is None:
            break
        chosen.append(best[1])
        rows = rows.where(best[1].in_bins())
    return chosen


def _prune(left: DataFrame, conditions: list[Condition]) -> Rule | None:
    """The beginning of the conjunction that is best on the rows held back."""
    if not conditions:
        return None
    held, sums, hit = left.where(F.col("held")), [], F.lit(True)
    for k, c in enumerate(conditions):
        hit = hit & c.in_bins()
        sums += [F.sum(F.when(hit, F.col("bad") * F.col("n"))).alias(f"p{k}"), F.sum(F.when(hit, F.col("n"))).alias(f"n{k}")]
    found = held.agg(*sums).first()
    scored = [((2 * (found[f"p{k}"] or 0) - (found[f"n{k}"] or 0)) / found[f"n{k}"] if found[f"n{k}"] else -1.0, -k) for k in range(len(conditions))]
    worth, k = max(scored)
    k = -k
    precision = (worth + 1) / 2
    if precision < LEAST_PRECISION:
        return None
    return Rule(tuple(conditions[: k + 1]), found[f"n{k}"], precision)


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: false for the first rule that holds, else true."""
    if not rules:
        return F.lit(True)
    out = F.when(rules[0].holds(), False)
    for rule in rules[1:]:
        out = out.when(rule.holds(), False)
    return out.otherwise(True)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of every row of ``docs`` with ``base_failed`` and ``kept``.

    ``labels`` has doc_id and quality (1 good, 0 bad); repeated labels of a
    document count by their lowest value, null ones not at all, as do labels
    without a document and documents without a label. A null text counts as
    empty, which fails the base rule. Repeated rows are kept. Empty tables give
    no rows or, for labels, no learned rules.
    """
    shelf = Shelf(docs.sparkSession)
    facts = shelf.put(statistics(docs.select("doc_id", "text")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    marks = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") < 1).alias("bad"))
    labelled = shelf.put(facts.where(~failed).join(marks, "doc_id"))
    rules = learn(labelled, shelf)
    out = facts.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))
