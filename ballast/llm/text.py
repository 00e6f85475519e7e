"""Words of a batch of texts as numpy arrays, for operators that work inside tasks.

Everything here is a pass over the bytes of a whole batch; no Python loop runs
over words or characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_POWER = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15 | 1, U64), dtype=U64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Letters and digits of ASCII, and every byte of a longer UTF-8 sequence.
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Batch:
    """Texts laid out one after another, each followed by one blank byte.

    ``start``/``end`` are byte positions of words, ``doc`` the text of each word,
    ``first`` the index of each text's first word (one more entry at the end).
    """

    def __init__(self, texts: list[bytes], letters: bool = False, lower: bool = True):
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offset = np.concatenate(([0], np.cumsum(sizes)))
        self.raw = _LOWER[raw] if lower else raw
        inside = _LETTER[raw] if letters else ~_BLANK[raw]
        inside[self.offset[1:] - 1] = False
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.offset)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit value of each word."""
        return spans_hash(self.raw, self.start, self.end)

    def prefix_hashes(self, n: int) -> np.ndarray:
        """A 64-bit value of each word's first ``n`` bytes."""
        return short_hash(self.raw, self.start, np.minimum(self.end, self.start + n), n)

    def suffix_hashes(self, n: int) -> np.ndarray:
        return short_hash(self.raw, np.maximum(self.start, self.end - n), self.end, n)


def short_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit value of spans of at most ``n`` bytes (n up to 8), their length included."""
    value = np.zeros(len(start), U64)
    for k in range(n):
        at = start + k
        value = (value << U64(8)) | np.where(at < end, raw[np.minimum(at, len(raw) - 1)], 0).astype(U64)
    return mix(value + np.full(1, n, U64) * U64(0xD6E8FEB86659FD93))


def spans_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial value of each byte span; spans do not overlap and none is empty."""
    if not len(start):
        return np.zeros(0, U64)
    length = end - start
    longest = int(length.max())
    power = _POWER if longest <= len(_POWER) else np.cumprod(np.full(longest, _POWER[0], U64), dtype=U64)
    total = int(length.sum())
    inner = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
    at = inner + np.repeat(start, length)
    terms = (raw[at].astype(U64) + U64(1)) * power[inner]
    return mix(np.add.reduceat(terms, np.cumsum(length) - length) + length.astype(U64))


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows and where each text's begin; a text of fewer words is one window."""
    counts = np.diff(first)
    made = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    ends = np.concatenate(([0], np.cumsum(made)))
    if not ends[-1]:
        return np.zeros(0, U64), ends
    at = np.arange(ends[-1]) - np.repeat(ends[:-1] - first[:-1], made)
    last = np.repeat(first[1:], made)
    value = np.zeros(len(at), U64)
    for k in range(n):
        here = at + k
        word = np.where(here < last, words[np.minimum(here, len(words) - 1)], U64(0))
        value = mix(value * U64(0x9E3779B97F4A7C15) + word + U64(1))
    return value, ends


def batches(frames: Iterator, column: str = "text", limit: int = 4 << 20) -> Iterator[tuple[object, list[bytes]]]:
    """Slices of Arrow or pandas batches with at most ``limit`` bytes of text, or one text if it is longer."""
    for frame in frames:
        texts = [b"" if not isinstance(x, str) else x.encode("utf-8", "surrogatepass") for x in frame[column]]
        at = size = 0
        for i, x in enumerate(texts):
            if size and size + len(x) > limit:
                yield frame.iloc[at:i], texts[at:i]
                at, size = i, 0
            size += len(x)
        if at < len(texts):
            yield frame.iloc[at:], texts[at:]


def slices(texts: list[str | None], limit: int) -> Iterator[tuple[int, int]]:
    """Stretches of texts with at most ``limit`` characters, or one text if it is longer."""
    at = size = 0
    for i, x in enumerate(texts):
        n = len(x) if x else 0
        if size and size + n > limit:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)
