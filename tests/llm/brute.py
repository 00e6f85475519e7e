"""Plain versions of the corpus operators, for comparison on small tables."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def grams(text, width):
    w = WORD.findall(lower(text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def near_duplicates(rows, width, percent):
    """(doc_id, n, component) of rows (doc_id, text) by comparing all pairs that share an n-gram."""
    sets = [(i, grams(t, width)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    at = defaultdict(list)
    for k, (i, s) in enumerate(sets):
        if i is None:
            continue
        shared = Counter(j for g in s for j in at[g])
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = sorted((root(i), root(sets[j][0])))
                parent[b] = a
        for g in s:
            at[g].append(k)
    return [(i, len(s), None if i is None else root(i)) for i, s in sets]


def covered(texts, size):
    """For each byte string the marks of bytes covered by a string of ``size`` bytes that starts anywhere else too."""
    starts = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if starts[t[i : i + size]] > 1:
                mark[i : i + size] = b"\1" * size
        out.append(mark)
    return out


def statistics(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)
