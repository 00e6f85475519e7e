"""Sum-of-squares packing of tokenized documents into training sequences.

A document becomes its token ids and an end id. Documents longer than a
sequence are cut into full pieces, the first being what is left over. Pieces are
dealt into groups of a set mean size and each group is packed in one task, longest first: of the
open sequences with room a piece goes where the sum of the squared numbers of
open sequences per fill level becomes smallest, which keeps all levels in stock,
so that a fitting one is there for whatever comes next; a new one is opened where
none has room. Groups grow in number with the data, never in size, and the waste
is a few open sequences in each.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import Shelf, text_ids, typed_ids

LENGTH = 1024
END_ID = 2
#: Pieces that one task packs, on average.
GROUP = 60_000
#: Folder of the vocabulary files; None takes those of the installed public_tokenizers.
TOKENIZERS: str | None = None
VOCABULARY = "byte_bpe_50k"

_CODECS: dict[tuple[str, str], object] = {}


class Codec:
    """Ids of byte-level BPE as ``{vocabulary}.json`` gives them, without added tokens.

    The same merges are applied by the faster library that reads the rank file
    beside it. Texts with a special token's own spelling go to the first one.
    """

    def __init__(self, folder: str | None, vocabulary: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = public_tokenizers.path if folder is None else lambda name: os.path.join(folder, name)
        self.exact = Tokenizer.from_file(path(f"{vocabulary}.json"))
        self.special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        with open(path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # of the byte-level splitter
        self.fast = tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(x in text for x in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, disallowed_special=())


def codec(folder: str | None, vocabulary: str) -> Codec:
    """One per worker process."""
    if (folder, vocabulary) not in _CODECS:
        _CODECS[folder, vocabulary] = Codec(folder, vocabulary)
    return _CODECS[folder, vocabulary]


def token_pieces(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, folder: str | None = TOKENIZERS, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, deal[, ids]); a null text is an empty one, of the end id alone."""
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, row = codec(folder, vocabulary), 0
        for frame in frames:
            for low in range(0, len(frame), 256):
                part, out = frame.iloc[low : low + 256], []
                for doc, text in zip(part["doc_id"].tolist(), part["text"], strict=True):
                    ids = np.append(coder.ids(text) if isinstance(text, str) else np.zeros(0, np.uint32), [end_id]).astype("<u4")
                    first = len(ids) % length or length
                    for k, (a, b) in enumerate(zip([0, *range(first, len(ids), length)], range(first, len(ids) + 1, length), strict=True)):
                        out.append((doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), row, *([ids[a:b].astype(np.int64)] if with_ids else [])))
                        row += 1
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "deal", *["ids"] * with_ids]
                yield pd.DataFrame(out, columns=names)

    found = text_ids(docs.select("doc_id", "text"), "doc_id").mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long, deal long" + ", ids array<long>" * with_ids)
    return typed_ids(found, docs, "doc_id")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the place in it of each length, taken in the given order."""
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open bins by level; full ones are not counted
    held: list[list[int]] = [[] for _ in range(capacity)]
    made = 0
    for i, s in enumerate(lengths.tolist()):
        level = 0
        if s < capacity:
            now = count[1 : capacity - s + 1]
            change = 2 * (count[s + 1 :] - now) + 2
            change[-1] -= 1  # the bin becomes full
            change[now == 0] = 1 << 40
            best = len(change) - 1 - int(change[::-1].argmin())  # of equals the fullest
            if change[best] < 1 << 40:  # a new bin only where none fits: the set is finite
                level = best + 1
        if level:
            chosen = held[level].pop()
            count[level] -= 1
        else:
            chosen, made = made, made + 1
        bins[i], places[i] = chosen, level
        if level + s < capacity:
            held[level + s].append(chosen)
            count[level + s] += 1
    return bins, places


def pack(docs: DataFrame, length: int = LENGTH, group: int = GROUP, **tokens) -> DataFrame:
    """Every piece of ``docs`` with its ``sequence_id`` and ``offset``.

    Null and empty texts are one-token documents. Repeated rows and null ids are
    packed like any other. An empty table gives no rows. Columns other than
    doc_id and text are not read. ``group`` is the mean number of pieces per
    packing task.
    """
    shelf = Shelf(docs.sparkSession)
    pieces = shelf.put(token_pieces(docs, length, **tokens))
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "deal"), F.lit(groups)))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.iloc[np.lexsort((frame["piece"], frame["doc_id"].fillna("").to_numpy(str), frame["ids_crc32"]))].reset_index(drop=True)
        order = np.argsort(-frame["length"].to_numpy(), kind="stable")
        bins, places = sum_of_squares(frame["length"].to_numpy()[order], length)
        out = frame.iloc[order].reset_index(drop=True)
        out["sequence_id"], out["offset"] = bins + (out["deal"].to_numpy() << 32), places
        return out.drop(columns="deal")

    packed = text_ids(dealt, "doc_id").groupBy("deal").applyInPandas(
        fill, "doc_id string, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * ("ids" in pieces.columns) + ", sequence_id long, offset long")
    return typed_ids(packed, docs, "doc_id")
