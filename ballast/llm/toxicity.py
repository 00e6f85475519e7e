"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as the sum of a word vector and vectors of its character pieces
(two beginnings and an ending), so that inflected forms of a known stem are met
as well. The network reads windows of words in both directions, pools the states
by attention and gives each window a logit. Windows overlap by half and cover
the whole text; a document is as toxic as its worst window.

Training is numpy on the driver, over a bounded sample of labelled documents.
Labels speak of documents, not of places: each round the currently worst window
of every sampled document stands for it, and the network is fitted to those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import Shelf, fold, text_ids, typed_ids
from ballast.llm.text import U64, Batch, batches, mix, slices

#: Labelled documents to learn from: of each class about this many, chosen by the hash of their id.
SAMPLE = {1: 1500, 0: 3000}
#: Words and character pieces with a vector of their own.
VOCABULARY = 6000
WINDOW, STRIDE = 32, 16
WORD, PIECE, HIDDEN, ATTENTION = 8, 8, 8, 8
ROUNDS, EPOCHS, BATCH, RATE = 3, 4, 64, 0.01
PIECES = (("prefix", 4), ("prefix", 5), ("suffix", 4))


def word_features(batch: Batch) -> np.ndarray:
    """One row per input of a word (the word itself, then its pieces), as 64-bit values."""
    rows = [batch.hashes()]
    for k, (kind, n) in enumerate(PIECES):
        value = batch.prefix_hashes(n) if kind == "prefix" else batch.suffix_hashes(n)
        rows.append(mix(value + U64(k + 1)))
    return np.stack(rows)


def windows_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Beginning, length and document of each window; a document without words has none."""
    counts = np.diff(first)
    made = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(counts)), made)
    start = first[:-1][doc] + STRIDE * (np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made))
    return start, np.minimum(first[1:][doc] - start, WINDOW), doc


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Network:
    """``keys`` are the sorted known feature values; entry 0 of a table of vectors stands for all others."""

    keys: list[np.ndarray] = field(default_factory=lambda: [np.zeros(0, U64)] * 2)
    p: dict[str, np.ndarray] = field(default_factory=dict)
    wordless: float = 0.0  # logit of a text without words

    @staticmethod
    def new(keys: list[np.ndarray], weights: list[np.ndarray], seed: int = 1) -> Network:
        """Vectors are random but for their first place, which holds the given weight of the feature."""
        rng, put = np.random.default_rng(seed), {}
        for name, k, w, size in (("word", keys[0], weights[0], WORD), ("piece", keys[1], weights[1], PIECE)):
            put[name] = rng.normal(0, 0.1, (len(k) + 1, size))
            put[name][0] = 0
            put[name][1:, 0] = w
        width = WORD + PIECE
        put["wx"] = rng.normal(0, width**-0.5, (2, width, 3 * HIDDEN))
        put["wh"] = rng.normal(0, HIDDEN**-0.5, (2, HIDDEN, 3 * HIDDEN))
        put["b"] = np.zeros((2, 1, 3 * HIDDEN))
        put["wa"], put["ba"], put["va"] = rng.normal(0, (2 * HIDDEN) ** -0.5, (2 * HIDDEN, ATTENTION)), np.zeros(ATTENTION), rng.normal(0, 0.3, ATTENTION)
        put["u"], put["c"] = rng.normal(0, 0.3, 2 * HIDDEN), np.zeros(1)
        return Network(keys, {k: v.astype(np.float32) for k, v in put.items()})

    def ids(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros(features.shape, np.int32)
        for k, row in enumerate(features):
            keys = self.keys[min(k, 1)]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, row), len(keys) - 1)
                out[k] = np.where(keys[at] == row, at + 1, 0)
        return out

    def forward(self, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows: ids (inputs, time, windows), mask (time, windows)."""
        p, h = self.p, HIDDEN
        x = np.concatenate((p["word"][ids[0]], p["piece"][ids[1:]].sum(axis=0)), axis=-1)
        time, n, kind = *mask.shape, p["u"].dtype
        both = np.stack((x, x[::-1])), np.stack((mask, mask[::-1]))[..., None]
        gates = (both[0].reshape(2, time * n, -1) @ p["wx"] + p["b"]).reshape(2, time, n, 3 * h)
        state, states, kept = np.zeros((2, n, h), kind), np.empty((2, time, n, h), kind), []
        for t in range(time):
            own = state @ p["wh"]
            rz = sigmoid(gates[:, t, :, : 2 * h] + own[..., : 2 * h])
            r, z = rz[..., :h], rz[..., h:]
            new = np.tanh(gates[:, t, :, 2 * h :] + r * own[..., 2 * h :])
            before = state
            state = state + both[1][:, t] * ((1 - z) * (new - state))
            states[:, t] = state
            if keep:
                kept.append((before, own, r, z, new))
        hidden = np.concatenate((states[0], states[1, ::-1]), axis=-1)
        look = np.tanh(hidden @ p["wa"] + p["ba"])
        weight = look @ p["va"] + np.where(mask > 0, 0, -1e9).astype(kind)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[..., None] * hidden).sum(axis=0)
        logit = pooled @ p["u"] + p["c"]
        return (logit, (x, both, kept, hidden, look, weight, pooled)) if keep else logit

    def gradients(self, ids: np.ndarray, mask: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy and its gradients."""
        p, h, n = self.p, HIDDEN, mask.shape[1]
        logit, (x, (both_x, both_m), kept, hidden, look, weight, pooled) = self.forward(ids, mask, keep=True)
        loss = float(np.mean(np.logaddexp(0, logit) - target * logit))
        d_logit = (sigmoid(logit) - target) / n
        g = {"u": pooled.T @ d_logit, "c": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * p["u"]
        d_weight = (hidden * d_pooled).sum(axis=-1)
        d_hidden = weight[..., None] * d_pooled
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["va"] = np.tensordot(d_score, look, 2)
        d_look = d_score[..., None] * p["va"] * (1 - look**2)
        g["wa"], g["ba"] = np.tensordot(hidden, d_look, ((0, 1), (0, 1))), d_look.sum(axis=(0, 1))
        d_hidden = d_hidden + d_look @ p["wa"].T
        d_states = np.stack((d_hidden[..., :h], d_hidden[::-1, :, h:]))
        g["wh"], d_gates, d_state = np.zeros_like(p["wh"]), np.zeros((2, *mask.shape, 3 * h), p["u"].dtype), np.zeros((2, n, h), p["u"].dtype)
        for t in range(mask.shape[0] - 1, -1, -1):
            before, own, r, z, new = kept[t]
            d_state = d_state + d_states[:, t]
            m = both_m[:, t]
            d_new = d_state * m * (1 - z) * (1 - new**2)
            d_z = d_state * m * (before - new) * z * (1 - z)
            d_r = d_new * own[..., 2 * h :] * r * (1 - r)
            d_gates[:, t] = np.concatenate((d_r, d_z, d_new), axis=-1)
            d_own = np.concatenate((d_r, d_z, d_new * r), axis=-1)
            g["wh"] += before.transpose(0, 2, 1) @ d_own
            d_state = d_state * (1 - m * (1 - z)) + d_own @ p["wh"].transpose(0, 2, 1)
        flat = d_gates.reshape(2, -1, 3 * h)
        g["wx"], g["b"] = both_x.reshape(2, flat.shape[1], -1).transpose(0, 2, 1) @ flat, flat.sum(axis=1, keepdims=True)
        d_x = (flat @ p["wx"].transpose(0, 2, 1)).reshape(2, *x.shape)
        d_x = d_x[0] + d_x[1, ::-1]
        g["word"], g["piece"] = np.zeros_like(p["word"]), np.zeros_like(p["piece"])
        np.add.at(g["word"], ids[0], d_x[..., :WORD])
        for k in range(len(PIECES)):
            np.add.at(g["piece"], ids[k + 1], d_x[..., WORD:])
        return loss, g

    def window_logits(self, ids: np.ndarray, start: np.ndarray, length: np.ndarray, step: int = 2048) -> np.ndarray:
        out = np.empty(len(start), np.float32)
        for a in range(0, len(start), step):
            out[a : a + step] = self.forward(*windowed(ids, start[a : a + step], length[a : a + step]))
        return out


def windowed(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = start + np.arange(WINDOW)[:, None]
    mask = np.arange(WINDOW)[:, None] < length
    return ids[:, np.minimum(at, ids.shape[1] - 1)] * mask, mask.astype(np.float32)


def vocabularies(features: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The features that tell the classes best apart, of words and of pieces, with their weights of evidence."""
    def counted(row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each value with the number of documents that have it, and of toxic ones."""
        _, at = np.unique(mix(row ^ mix(doc.astype(U64) + U64(1))), return_index=True)
        value, which = np.unique(row[at], return_inverse=True)
        return value, np.bincount(which), np.bincount(which, weights=toxic[doc[at]])

    keys, weights = [], []
    pos, neg = toxic.sum(), len(toxic) - toxic.sum()
    for rows in (features[:1], features[1:]):
        value, n, hits = (np.concatenate(x) for x in zip(*map(counted, rows), strict=True))
        weight = np.log((hits + 0.5) / (pos + 1)) - np.log((n - hits + 0.5) / (neg + 1))
        worth = np.where(n >= 3, np.abs(weight) * np.sqrt(n), 0)
        chosen = np.argsort(-worth, kind="stable")[: min(VOCABULARY, int((worth > 0).sum()))]
        chosen = chosen[np.argsort(value[chosen])]
        keys.append(value[chosen])
        weights.append(np.clip(weight[chosen] / 4, -2, 2))
    return keys, weights


def train(texts: list[bytes], toxic: np.ndarray, seed: int = 1) -> Network:
    """A network from texts and their 0/1 labels; its logit 0 separates the two best on them."""
    # a part of the texts at a time: their byte-wise arrays are large
    parts, counts = [], []
    for low in range(0, len(texts), 100):
        batch = Batch(texts[low : low + 100], letters=True)
        parts.append(word_features(batch))
        counts.append(np.diff(batch.first))
    counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    start, length, owner = windows_of(np.concatenate(([0], np.cumsum(counts))))
    if not len(start) or toxic.min() == toxic.max():
        net = Network.new([np.zeros(0, U64)] * 2, [np.zeros(0)] * 2)
        net.wordless = 4.0 if len(toxic) and toxic.min() else -4.0
        net.p["u"][:], net.p["c"][:] = 0, net.wordless
        return net
    features = np.concatenate(parts, axis=1)
    del parts
    keys, weights = vocabularies(features, np.repeat(np.arange(len(texts)), counts), toxic.astype(np.int64))
    net = Network.new(keys, weights, seed)
    ids, rng = net.ids(features), np.random.default_rng(seed)
    del features
    net.wordless = float(np.log(toxic.sum() / (len(toxic) - toxic.sum())))
    evidence = net.p["word"][ids[0], 0] + net.p["piece"][ids[1:], 0].max(axis=0)
    score = np.array([evidence[a : a + n].max() for a, n in zip(start, length, strict=True)])
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for _ in range(ROUNDS):
        worst = worst_windows(score, owner)
        other = rng.choice(len(start), len(start))[: len(worst)]
        other = other[toxic[owner[other]] == 0]  # any window of a clean document is clean
        chosen = np.concatenate((worst, other))
        for _ in range(EPOCHS):
            rng.shuffle(chosen)
            for a in range(0, len(chosen), BATCH):
                part = chosen[a : a + BATCH]
                _, g = net.gradients(*windowed(ids, start[part], length[part]), toxic[owner[part]].astype(np.float32))
                step += 1
                for k, d in g.items():
                    m, v = moment[k]
                    m += 0.1 * (d - m)
                    v += 0.001 * (d * d - v)
                    net.p[k] -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        score = net.window_logits(ids, start, length)
    worst = worst_windows(score, owner)
    net.p["c"] -= np.float32(best_cut(score[worst], toxic[owner[worst]]))
    return net


def worst_windows(score: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The index of each document's highest window, documents in order."""
    order = np.lexsort((-score, owner))
    return order[np.flatnonzero(np.diff(owner[order], prepend=-1))]


def best_cut(score: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the gap with fewest errors on both sides."""
    order = np.argsort(score, kind="stable")
    s, t = score[order], toxic[order]
    errors = np.concatenate(([0], np.cumsum(t))) + np.concatenate((np.cumsum((1 - t)[::-1])[::-1], [0]))
    edges = np.concatenate(([s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]))
    gaps = np.concatenate(([0], s[1:] - s[:-1], [0]))
    best = np.flatnonzero(errors == errors.min())
    return float(edges[best[gaps[best].argmax()]])


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> Network:
    """A network from a bounded sample of ``labels`` (doc_id, toxic) and their texts in ``docs``.

    Null labels and those without a document are left out; a document with
    several labels is toxic if one of them says so. Without both classes every
    document gets the same score, near 0 or 1.
    """
    wanted = sample or SAMPLE
    shelf = Shelf(docs.sparkSession)
    marks = shelf.put(labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    sizes = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / 1_000_000
    chosen = shelf.put(marks.where(share < F.when(F.col("toxic") == 1, min(1.0, wanted[1] / max(1, sizes.get(1, 1)))).otherwise(min(1.0, wanted[0] / max(1, sizes.get(0, 1))))))
    rows = docs.select("doc_id", "text").where("text is not null").join(chosen, "doc_id").orderBy("doc_id").collect()  # the bounded sample
    shelf.drop(marks, chosen)
    return train([r.text.encode("utf-8", "surrogatepass") for r in rows], np.array([r.toxic for r in rows], np.int64))


def judge(net: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the score, the number of windows and the bytes of the highest one (-1 without words)."""
    batch = Batch(texts, letters=True)
    start, length, owner = windows_of(batch.first)
    logit, low, high = np.full(len(texts), net.wordless), np.full(len(texts), -1), np.full(len(texts), -1)
    if len(start):
        found = net.window_logits(net.ids(word_features(batch)), start, length)
        worst = worst_windows(found, owner)
        at = owner[worst]
        logit[at] = found[worst]
        low[at] = batch.start[start[worst]] - batch.offset[at]
        high[at] = batch.end[start[worst] + length[worst] - 1] - batch.offset[at]
    return sigmoid(logit.astype(np.float64)), np.bincount(owner, minlength=len(texts)), low, high


def score_documents(docs: DataFrame, net: Network) -> DataFrame:
    """Rows (doc_id, score, predicted, windows, worst_start, worst_end) for every row of ``docs``.

    ``worst_start``/``worst_end`` are bytes of the highest window in the text's
    UTF-8 form, null without words. Null and wordless texts get the share of
    toxic documents among the sampled ones. Repeated rows are kept; an empty table gives no rows. Columns
    other than doc_id and text are not read.
    """
    Shelf(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, texts in batches(frames, limit=1 << 20):
            score, windows, low, high = judge(shared.value, texts)
            yield pd.DataFrame({
                "doc_id": frame["doc_id"].array, "score": score, "predicted": (score >= 0.5).astype(np.int32), "windows": windows,
                "worst_start": pd.array(np.where(low < 0, None, low), "Int64"), "worst_end": pd.array(np.where(low < 0, None, high), "Int64"),
            })

    found = text_ids(docs.select("doc_id", "text"), "doc_id").mapInPandas(rows, "doc_id string, score double, predicted int, windows long, worst_start long, worst_end long")
    return typed_ids(found, docs, "doc_id")


def without_toxic(docs: DataFrame, net: Network) -> DataFrame:
    """The rows of ``docs`` that score under a half, all columns as they are."""
    Shelf(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def rows(frames):
        for frame in frames:
            for low, high in slices(frame.column("text").to_pylist(), 1 << 20):
                part = frame.slice(low, high - low)
                texts = [b"" if x is None else x.encode("utf-8", "surrogatepass") for x in part.column("text").to_pylist()]
                yield part.filter(pa.array(judge(shared.value, texts)[0] < 0.5))

    return docs.mapInArrow(rows, docs.schema)


def learning_labels(labels: DataFrame) -> DataFrame:
    return labels.where(fold(F.col("doc_id"), 5) != 0)
