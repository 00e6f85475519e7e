"""Language identification by bit-sliced Bloom filters over letter n-grams.

One filter per language answers whether the language knows an n-gram. The
filters share their hash functions and are stored side by side: cell i holds bit
i of every language's filter, one bit per language. Looking an n-gram up is the
AND of a few cells, whose set bits are all the languages that know it. A
language's score in a text is the share of n-grams whose answer has its bit,
less what its filter would answer by chance, over what chance leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import Shelf, fold, text_ids, typed_ids
from ballast.llm.text import U64, batches, mix

#: Bytes of an n-gram; letters A-Z count as lower case, runs of anything else as one blank.
WIDTH = 5
#: Cells of the filters, as a power of two, and cells asked per n-gram.
CELL_BITS = 22
ASKED = 3
#: Texts per language to learn from: this many on average, chosen by the hash of their id.
TEXTS = 3000
#: An n-gram is known to a language if this many of its texts have it.
LEAST_TEXTS = 2
UNKNOWN = "und"

_FORM = np.full(256, 32, np.uint8)
_FORM[[*range(97, 123), *range(128, 256)]] = [*range(97, 123), *range(128, 256)]
_FORM[65:91] = np.arange(97, 123)


def letter_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, and how many each text has. Blanks in a row count once."""
    raw = _FORM[np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    doc = np.repeat(np.arange(len(texts) + 1), [1, *sizes])
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    raw, doc = raw[keep], doc[keep]
    if len(raw) < WIDTH:
        return np.zeros(0, U64), np.zeros(len(texts), np.int64)
    n = len(raw) - WIDTH + 1
    value = np.zeros(n, U64)
    for k in range(WIDTH):
        value = (value << U64(8)) | raw[k : k + n]
    # a text owns the blank behind it; the blank in front of its first letter is the text before's
    owner = doc[1 : n + 1]
    own = (owner == doc[WIDTH - 1 :]) & ((owner == doc[:n]) | (raw[:n] == 32))
    return mix(value[own]), np.bincount(owner[own], minlength=len(texts) + 1)[1:]


def cells_of(grams: np.ndarray) -> list[np.ndarray]:
    mask = U64((1 << CELL_BITS) - 1)
    step = (grams >> U64(40)) | U64(1)
    return [((grams + U64(k) * step) & mask).astype(np.int64) for k in range(ASKED)]


@dataclass
class Filters:
    """``cells`` has a column of 64 languages per word; ``chance`` is each filter's share of false answers."""

    languages: list[str]
    cells: np.ndarray
    chance: np.ndarray

    def answers(self, grams: np.ndarray) -> np.ndarray:
        first, *others = cells_of(grams)
        mask = self.cells[first]
        for at in others:
            mask &= self.cells[at]
        return mask

    def scores(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One row per text, one column per language: the corrected share of known n-grams."""
        ends = np.concatenate(([0], np.cumsum(counts)))
        mask, out = self.answers(grams), np.zeros((len(counts), len(self.languages)))
        for k in range(len(self.languages)):
            bit = (mask[:, k // self.cells.dtype.itemsize // 8] >> (k % (8 * self.cells.dtype.itemsize))) & 1
            known = np.concatenate(([0], np.cumsum(bit)))
            share = (known[ends[1:]] - known[ends[:-1]]) / np.maximum(counts, 1)
            out[:, k] = (share - self.chance[k]) / max(1e-9, 1 - self.chance[k])
        return np.clip(out, 0, 1)


def learn(texts: DataFrame, least: int = LEAST_TEXTS, wanted: int = TEXTS) -> Filters:
    """Filters from rows (doc_id, text, lang). Rows without a language or text teach nothing.

    Of each language about ``wanted`` texts are used, chosen by hash; a language
    with fewer is used whole. n-grams of fewer than ``least`` texts are left out
    where a language has more than a hundred texts.
    """
    shelf = Shelf(texts.sparkSession)
    texts = texts.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    sizes = shelf.put(texts.groupBy("lang").agg(F.count("*").alias("rows")))
    languages = sorted(r.lang for r in sizes.select("lang").collect())  # one row per language
    if not languages:
        return Filters([], np.zeros((1 << CELL_BITS, 1), np.uint8), np.zeros(0))
    share = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) / 1_000_000
    chosen = texts.join(F.broadcast(sizes), "lang").where(share * F.col("rows") < wanted)

    def spell(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, batch in batches(frames):
            grams, counts = letter_grams(batch)
            ends = np.concatenate(([0], np.cumsum(counts)))
            for lang, rows in pd.Series(np.arange(len(batch))).groupby(frame["lang"].to_numpy()):
                found = np.concatenate([np.unique(grams[ends[i] : ends[i + 1]]) for i in rows])
                value, n = np.unique(found, return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": value.view(np.int64), "n": n})

    known = chosen.select("text", "lang").mapInPandas(spell, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    known = known.join(F.broadcast(sizes), "lang").where((F.col("n") >= least) | (F.col("rows") <= 100))
    wide = np.uint8 if len(languages) <= 8 else np.uint64
    bits = 8 * np.dtype(wide).itemsize
    blocks = 64

    # each block of cells is built in a task of its own; the filters have a fixed size
    def slots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = {x: k for k, x in enumerate(languages)}
        for frame in frames:
            at = np.concatenate(cells_of(frame["gram"].to_numpy().view(U64)))
            yield pd.DataFrame({"block": at >> (CELL_BITS - 6), "cell": at & ((1 << (CELL_BITS - 6)) - 1), "lang": np.tile(frame["lang"].map(place), ASKED)})

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        cells = np.zeros((1 << (CELL_BITS - 6), -(-len(languages) // bits)), wide)
        for lang, part in frame.groupby("lang"):
            cells[part["cell"].unique(), lang // bits] |= wide(1 << (lang % bits))
        return pd.DataFrame({"block": frame["block"][:1], "cells": [cells.tobytes()]})

    rows = known.select("lang", "gram").mapInPandas(slots, "block long, cell long, lang long").distinct().groupBy("block").applyInPandas(build, "block long, cells binary").collect()
    cells = np.zeros((blocks, 1 << (CELL_BITS - 6), -(-len(languages) // bits)), wide)
    for r in rows:
        cells[r.block] = np.frombuffer(r.cells, wide).reshape(cells.shape[1:])
    cells = cells.reshape(1 << CELL_BITS, -1)
    filled = np.array([((cells[:, k // bits] >> wide(k % bits)) & wide(1)).mean() for k in range(len(languages))])
    shelf.drop(sizes)
    return Filters(languages, cells, filled**ASKED)


def identify(docs: DataFrame, filters: Filters) -> DataFrame:
    """Rows (doc_id, lang_pred, score) for every row of ``docs``.

    The best score decides; of equals the language that sorts first. A text that
    is null or has no letter is ``und`` with score 0, as is any text if nothing
    was learned. ``score`` is the winner's corrected share of known n-grams.
    Repeated rows are kept; an empty table gives no rows. Columns other than
    doc_id and text are not read.
    """
    Shelf(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # of fixed size

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        names = np.array([*known.languages, UNKNOWN], object)
        for frame, texts in batches(frames):
            grams, counts = letter_grams(texts)
            lettered = np.array([isinstance(x, str) and any(map(str.isalpha, x)) for x in frame["text"]])
            scores = known.scores(grams, counts) if known.languages else np.zeros((len(texts), 1))
            best = scores.argmax(axis=1)
            some = lettered & bool(known.languages)
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "lang_pred": names[np.where(some, best, -1)], "score": np.where(some, scores[np.arange(len(best)), best], 0.0)})

    rows = text_ids(docs.select("doc_id", F.col("text").cast("string").alias("text")), "doc_id")
    return typed_ids(rows.mapInPandas(decide, "doc_id string, lang_pred string, score double"), docs, "doc_id")


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold(F.col("doc_id"), 3) != 1)
