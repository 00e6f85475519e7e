"""License texts in documents: common words or word k-grams pick candidates, alignment confirms them.

Words are runs of letters and digits in lower case. An inverted index leads from
the winnowed k-grams of a template to their places; a shared fingerprint makes a
candidate, whose stretch of the document is aligned with the template within a
band around the diagonal. k and the window follow from the longest run of common
words that a stretch of the coverage must have (``winnow``), so no candidate is
lost; from 66 words on at a coverage of 0.8 there is such a run. A shorter
template is found exactly: whatever reaches the coverage holds one of its few
rarest words, and around these the tightest stretches are searched, with at most
BAND words put in. Reported are the share of template words matched in order and
the span of the document.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ballast.llm.common import Shelf, text_ids, typed_ids
from ballast.llm.text import Batch, batches, shingles

#: Most words of a fingerprint, and how many of which one is kept where nothing else is said.
K, W = 3, 3
#: In templates of fewer words all numbers and names that tell licenses apart must match.
SHORT = 66
#: Words by which an alignment may leave its diagonal at most, and the least share of template words matched.
BAND, COVERAGE = 12, 0.8
#: The index is sent to all tasks; more template words than this are refused.
MOST_WORDS = 1_000_000

# Words too common to look for.
COMMON = frozenset("a an and any are as at be by for from in is it may not of on or that the this to under use was with without work you".split())
# Words that tell related licenses apart. A stretch must have those of the template and may not have others of APART.
APART = frozenset("affero lesser nc nd noderivatives noderivs noncommercial sa sharealike".split())
TELLING = APART | frozenset("agpl apache attribution bsd by cc cc0 gnu gpl isc lgpl library mit mozilla mpl only later unlicense zlib".split())

# Parts of Creative Commons names by their short form.
CC_PARTS = {"BY": "Attribution", "NC": "NonCommercial", "ND": "NoDerivatives", "SA": "ShareAlike"}
CC_KINDS = ("BY", "BY-SA", "BY-NC", "BY-NC-SA", "BY-ND", "BY-NC-ND")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
GNU_NAMES = {
    "GPL-1.0": ("General", "1"), "GPL-2.0": ("General", "2"), "GPL-3.0": ("General", "3"), "LGPL-2.0": ("Library General", "2"),
    "LGPL-2.1": ("Lesser General", "2.1"), "LGPL-3.0": ("Lesser General", "3"), "AGPL-3.0": ("Affero General", "3"),
}
SPDX = (
    *"MIT MIT-0 ISC Zlib Unlicense CC0-1.0 BSL-1.0 Apache-1.1 Apache-2.0 BSD-2-Clause BSD-3-Clause MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0".split(),
    *(f"{x}-{y}" for x in GNU_NAMES for y in ("only", "or-later")), *(f"CC-{k}-{v}" for k in CC_KINDS for v in CC_VERSIONS),
)
BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
the following disclaimer in the documentation and/or other materials provided with the distribution. """
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission. """
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN
NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def gnu_header(thing: str, name: str, version: str) -> str:
    return f"""This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License
as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This
{thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more details."""


# Public license notices and texts.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "ISC-notice": "Released under the ISC License.",
    "Zlib-notice": "Released under the zlib License.",
    "BSD-notice": "Released under the BSD License.",
    "BSD-2-Clause-notice": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "Unlicense-notice": "Released into the public domain under the Unlicense.",
    **{f"Apache-{v}-line": f"Licensed under the Apache License, Version {v}." for v in ("1.0", "1.1", "2.0")},
    **{f"MPL-{v}-notice": f"Released under the Mozilla Public License, Version {v}." for v in ("1.0", "1.1", "2.0")},
    **{f"{x}-line": f"This work is licensed under the GNU {name} Public License, version {v}." for x, (name, v) in GNU_NAMES.items()},
    **{f"{x}-notice": f"Released under the GNU {name} Public License, version {v}." for x, (name, v) in GNU_NAMES.items()},
    **{f"{x}-header": gnu_header("program", name, v) for x, (name, v) in GNU_NAMES.items()},
    **{f"{x}-library-header": gnu_header("library", name, v) for x, (name, v) in GNU_NAMES.items() if x[0] == "L"},
    **{f"CC-{k}-{v}-line": f"Licensed under CC {k} {v}." for k in CC_KINDS for v in CC_VERSIONS},
    **{
        f"CC-{k}-{v}-notice": f"This work is licensed under a Creative Commons {'-'.join(CC_PARTS[x] for x in k.split('-'))} {v} License."
        for k in CC_KINDS for v in CC_VERSIONS
    },
    "CC0-1.0-line": "Released under CC0 1.0.",
    "CC0-1.0-notice": "Released under the CC0 1.0 Universal Public Domain Dedication.",
    **{f"{x}-spdx": f"SPDX-License-Identifier: {x}" for x in SPDX},
    "BSD-2-Clause": BSD_START + BSD_END,
    "BSD-3-Clause": BSD_START + BSD_NAMES + BSD_END,
    "MPL-2.0-header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The
origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source
versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be
removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate
any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at
large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
perpetuity of all present and future rights to this software under copyright law.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required
by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions
and limitations under the License.""",
}


def fingerprints(words: np.ndarray, first: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, text, word place) of each text's winnowed k-grams; a text of fewer than k words has one of them all."""
    grams, ends = shingles(words, first, k)
    text = np.repeat(np.arange(len(first) - 1), np.diff(ends))
    kept = np.zeros(len(grams), bool)
    for lag in range(-w + 1, 1):
        # the window of w grams that begins ``lag`` from here, as far as it lies in the text
        low = np.full(len(grams), True)
        for d in range(w):
            at = np.arange(len(grams)) + lag + d
            inside = (at >= ends[:-1][text]) & (at < ends[1:][text])
            other = grams[np.clip(at, 0, max(0, len(grams) - 1))]
            low &= ~inside | (other >= grams)
        whole = (np.arange(len(grams)) + lag >= ends[:-1][text]) & (np.arange(len(grams)) + lag + w <= ends[1:][text])
        short = np.diff(ends)[text] < w
        kept |= low & (whole | short)
    at = np.flatnonzero(kept)
    return grams[at], text[at], at - ends[:-1][text[at]]


@dataclass
class Index:
    """``grams`` hold for each (k, window) the sorted fingerprints, the bounds of their lists and the lists of (template, word place).

    ``plain`` are the words of each template, ``must`` tells which may not be missing.
    """

    names: list[str]
    words: list[np.ndarray]
    grams: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]
    plain: list[list[str]]
    must: list[np.ndarray]
    apart: np.ndarray

    def candidates(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows (text, template, diagonal) of shared fingerprints, each once, in order."""
        found = [np.zeros((0, 3), np.int64)]
        for (k, w), (keys, bounds, places) in self.grams.items():
            prints, text, at = fingerprints(words, first, k, w)
            spot = np.minimum(np.searchsorted(keys, prints), len(keys) - 1)
            hit = np.flatnonzero(keys[spot] == prints)
            many = (bounds[1:] - bounds[:-1])[spot[hit]]
            own = np.repeat(np.arange(len(hit)), many)
            place = places[np.repeat(bounds[spot[hit]] - np.cumsum(many) + many, many) + np.arange(len(own))]
            found.append(np.stack([text[hit][own], place[:, 0], at[hit][own] - place[:, 1]], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def rare(self, t: int, coverage: float) -> np.ndarray:
        """Hashes of words of which every stretch that reaches the coverage holds one."""
        spared = len(self.words[t]) - least(len(self.words[t]), coverage) + 1
        order = sorted(range(len(self.words[t])), key=lambda i: (self.plain[t][i] in COMMON, -len(self.plain[t][i]), i))
        return np.unique(self.words[t][order[:spared]])

    @staticmethod
    def of(templates: dict[str, str], coverage: float = COVERAGE) -> Index:
        names = sorted(x for x in templates if templates[x])
        batch = Batch([templates[x].encode() for x in names], letters=True) if names else Batch([b""], letters=True)
        if len(batch.start) > MOST_WORDS:
            raise ValueError(f"templates have {len(batch.start)} words; at most {MOST_WORDS} can be sent to every task")
        hashes = batch.hashes()
        cuts = list(zip(batch.first[:-1], batch.first[1:], strict=True))[: len(names)]
        plain = [bytes(batch.raw[a:b]).decode("utf-8", "replace").lower() for a, b in zip(batch.start, batch.end, strict=True)]
        grams = {}
        forms = [winnow(int(b - a), coverage) for a, b in cuts]
        for form in sorted({x for x in forms if x}):
            prints, t, at = fingerprints(hashes, batch.first, *form)
            mine = np.array([x == form for x in forms])[t]
            order = np.argsort(prints[mine], kind="stable")
            keys, counts = np.unique(prints[mine], return_counts=True)
            grams[form] = keys, np.concatenate(([0], np.cumsum(counts))), np.stack([t[mine][order], at[mine][order]], axis=1)
        return Index(names, [hashes[a:b] for a, b in cuts], grams, [plain[a:b] for a, b in cuts], [needed(plain[a:b]) for a, b in cuts], Batch([x.encode() for x in sorted(APART)], letters=True).hashes())


def needed(words: list[str]) -> np.ndarray:
    """Which words may not be missing: version numbers, in short templates all numbers and names that tell licenses apart."""
    must = np.zeros(len(words), bool)
    for i, w in enumerate(words):
        if len(words) < SHORT:
            must[i] = w.isdigit() or w in TELLING
        else:
            must[i] = w in APART or w.isdigit() and i > 0 and (words[i - 1] in ("version", "v") or words[i - 1].isdigit() and bool(must[i - 1]))
    return must


def least(size: int, coverage: float) -> int:
    """Words that must match, at least one."""
    return max(1, math.ceil(coverage * size - 1e-9))


def winnow(size: int, coverage: float) -> tuple[int, int] | None:
    """k and window for a template of ``size`` words, None if it has to be sought by its rarest words.

    A stretch of the coverage lacks at most size - least words and has at most BAND
    words put in besides; between these breaks the longest of its runs of common
    words has at least the mean length. Two texts that share k + window - 1 words
    in a row share a fingerprint.
    """
    matched = least(size, coverage)
    run = -(-matched // (size - matched + BAND + 1))
    k = min(K, run - 1)
    return (k, run - k + 1) if k > 1 else None


def tightest(template: np.ndarray, must: np.ndarray, words: np.ndarray, need: int, begin: int, stop: int) -> list[tuple[int, int, int]]:
    """(matched, first word, end word) of stretches between two places with ``need`` words of a short template in order.

    For each end and number of matched words the latest first word is taken. No word of ``must`` is left out.
    """
    m = len(template)
    cuts = [0, *(np.flatnonzero(must) + 1).tolist(), m + 1]
    at = defaultdict(list)
    for i, w in enumerate(template.tolist()):
        at[w].append(i + 1)
    # latest[i, k]: where the last k matches within i template words begin
    latest = np.full((m + 1, m + 1), -1, np.int64)
    found = []
    for p in range(begin, stop):
        mine = at.get(int(words[p]))
        if not mine:
            continue
        before = latest.copy()
        for i in mine:
            latest[i, 1:] = np.maximum(latest[i, 1:], before[i - 1, :-1])
            if not must[: i - 1].any():
                latest[i, 1] = p
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            latest[a:b] = np.maximum.accumulate(latest[a:b], axis=0)
        for k in range(need, m + 1):
            if latest[m, k] > before[m, k] and p + 1 - latest[m, k] - k <= BAND:
                found.append((k, int(latest[m, k]), p + 1))
    return found


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND, must: np.ndarray | None = None) -> tuple[int, int, int]:
    """Most template words matched in order near the diagonal, and the words of the text from the first match to after the last.

    Cell (i, j) stands for i template words against text words up to
    diagonal + i - band + j. No word of ``must`` is left out; -1 words match where one would be.
    """
    must = np.zeros(len(template), bool) if must is None else must
    m, width = len(template), 2 * band + 1
    best = np.zeros((m + 1, width + 1), np.int32)
    for i in range(1, m + 1):
        at = diagonal + i - 1 - band + np.arange(width)
        inside = (at >= 0) & (at < len(text))
        match = inside & (text[np.clip(at, 0, len(text) - 1)] == template[i - 1])
        # diagonal step, or a template word left out (one place further right in the row above)
        before = best[i - 1, :width]
        row = np.where(match & (before >= 0), before + 1, -1) if must[i - 1] else np.maximum(np.where(before >= 0, before + match, -1), best[i - 1, 1:])
        best[i, width] = -1 if must[i - 1] else best[i - 1, width]
        best[i, :width] = np.maximum.accumulate(row)  # or text words left out
    matched = int(best[m].max())
    i, j, low, high = m, int(best[m, :width].argmax()), -1, -1
    while i and best[i, j] > 0:
        if j and best[i, j - 1] == best[i, j]:
            j -= 1
        elif not must[i - 1] and best[i - 1, j + 1] == best[i, j]:
            i, j = i - 1, j + 1
        else:
            low = diagonal + i - 1 - band + j
            high = low + 1 if high < 0 else high
            i -= 1
    return matched, low, high


def scan_text(words: np.ndarray, hits: list[tuple[int, int]], rare: list[tuple[int, int]], index: Index, coverage: float) -> list[tuple[str, int, int, int]]:
    """(template, matched, first word, end word) found in one text.

    ``hits`` are (template, diagonal) of shared fingerprints in order, ``rare`` are
    (short template, text place) of its rarest words.
    """
    found = defaultdict(list)
    band, of, last, known = BAND + BAND // 2, None, None, None
    for t, d in hits:
        template = index.words[t]
        if t != of:
            of, last, known = t, None, np.concatenate(([0], np.cumsum(np.isin(words, template))))
        if last is not None and d - last <= BAND // 2:
            continue  # within BAND of it the candidate before has looked
        # the words that the band reaches must hold enough of the template's
        low, high = (min(max(x, 0), len(words)) for x in (d - band, d + len(template) + band))
        if known[high] - known[low] < least(len(template), coverage):
            continue
        last = d
        matched, low, high = align(template, words, d, band, index.must[t])
        if matched >= least(len(template), coverage):
            found[t].append((matched, low, high))
    spots = defaultdict(list)
    for t, b in rare:
        spots[t].append(b)
    for t, places in spots.items():
        template = index.words[t]
        need, reach = least(len(template), coverage), len(template) + BAND
        known = np.concatenate(([0], np.cumsum(np.isin(words, template))))
        stretches: list[list[int]] = []
        for b in sorted(places):
            begin, stop = max(0, b - reach), min(len(words), b + reach)
            if known[stop] - known[begin] < need:
                continue
            if stretches and begin <= stretches[-1][1]:
                stretches[-1][1] = stop
            else:
                stretches.append([begin, stop])
        for begin, stop in stretches:
            found[t] += tightest(template, index.must[t], words, need, begin, stop)
    ranked = []
    for t, own in found.items():
        size, other = len(index.words[t]), np.setdiff1d(index.apart, index.words[t])
        ranked += [(size - 2 * m, -m / size, high - low, low, t, m, high) for m, low, high in own if not np.isin(words[low:high], other).any()]
    # of alignments that overlap the one with most matched words, missing ones taken off, stays, of equals that with the larger share, then the shortest
    taken: list[tuple[int, int, int, int]] = []
    for _, _, _, low, t, matched, high in sorted(ranked):
        if all(high <= a or b <= low for _, _, a, b in taken):
            taken.append((t, matched, low, high))
    return [(index.names[t], matched, low, high) for t, matched, low, high in sorted(taken, key=lambda x: x[::2])]


def license_spans(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """Rows (doc_id, license, matched, template_words, coverage, span_start, span_end), one per occurrence.

    Spans are bytes of the text's UTF-8 form. Null and empty texts and templates
    match nothing; repeated rows are reported each. Of occurrences
    that overlap, of one or of different templates, the best is reported. Version
    numbers (in templates of fewer than SHORT words all numbers and the words of
    TELLING) must match.
    No templates or an empty table give no rows. Columns other than doc_id and
    text are not read.
    """
    Shelf(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Index.of(TEMPLATES if templates is None else templates, coverage))
    names = ["doc_id", "license", "matched", "template_words", "coverage", "span_start", "span_end"]

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        sizes = dict(zip(index.names, map(len, index.words), strict=True))
        seeds = defaultdict(list)
        for t, own in enumerate(index.words):
            if len(own) and not winnow(len(own), coverage):
                for h in index.rare(t, coverage).tolist():
                    seeds[h].append(t)
        seed_keys = np.array(sorted(seeds), np.uint64)
        for frame, texts in batches(frames):
            batch = Batch(texts, letters=True)
            words = batch.hashes()
            by_text = defaultdict(list)
            for i, t, d in index.candidates(words, batch.first).tolist():
                by_text[i].append((t, d))
            of_words = defaultdict(list)
            for p in np.flatnonzero(np.isin(words, seed_keys)).tolist():
                i = int(np.searchsorted(batch.first, p, "right")) - 1
                of_words[i] += [(t, p - int(batch.first[i])) for t in seeds[int(words[p])]]
            rows, ids = [], frame["doc_id"].tolist()
            for i in sorted(by_text.keys() | of_words.keys()):
                own = slice(batch.first[i], batch.first[i + 1])
                for name, matched, low, high in scan_text(words[own], by_text[i], of_words[i], index, coverage):
                    a, b = batch.start[own][low] - batch.offset[i], batch.end[own][high - 1] - batch.offset[i]
                    rows.append((ids[i], name, matched, sizes[name], matched / sizes[name], int(a), int(b)))
            yield pd.DataFrame(rows, columns=names)

    found = text_ids(docs.select("doc_id", "text"), "doc_id").mapInPandas(scan, "doc_id string, license string, matched long, template_words long, coverage double, span_start long, span_end long")
    return typed_ids(found, docs, "doc_id")
