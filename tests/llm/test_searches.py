"""Spelling variants, nearest vectors and ranked search by brute force, and on odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ballast.llm import neighbours, search, spelling
from ballast.llm.common import Shelf
from ballast.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
TERM = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
BIG = 2**53 + 1


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, "w") for i, t in rows], "doc_id long, text string, word string, n int, term int, score int, node string")


def word_counts(rows):
    n = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 5}


def apart(a, b):
    """Whether exactly one letter is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants(rows):
    n = word_counts(rows)
    near = {w: [v for v in n if apart(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 5 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return [(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n]


def spelled(spark, rows):
    found = spelling.group_variants(documents(spark, rows))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert key(found.collect()) == key(variants(rows))


def test_variants_of_odd_rows(spark):
    long = "abcdefghij" * 400
    rows = [
        (1, "receive " * 130 + "recieve recive receivé " * 5), (2, "recieves " * 5 + "receives " * 26), (None, "RECEIVE receive"), (None, None), (3, None), (4, ""),
        (5, " \n"), (6, "aaaaaa aaaaaaa aaaaaaaa " * 6), (7, "Élèves élèves élevas ×÷×÷×÷ " * 7), (8, f"{long} {long}x {long[:2000]}y{long[2000:]} " * 5),
        (9, "中文word中letters €letter letter5letters " * 5), (9, "letters " * 3), (9, "letters " * 3), (BIG, "receive receive"), (10, "abcdef abcdeg abcdeh bbcdef abdef abcdeff " * 5),
    ]
    spelled(spark, rows)
    assert spelling.group_variants(documents(spark, [])).count() == 0
    assert spelling.group_variants(documents(spark, [(1, "short words only")])).count() == 0


def test_variants_of_many_words_with_copied_edges(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PART", 7)  # shared beginnings are hot nodes then
    draw = random.Random(3)
    words = ["pre" + "".join(draw.choices("abc", k=draw.randint(3, 6))) for _ in range(300)]
    rows = [(i, " ".join(draw.choices(words, [1 / (1 + k) for k in range(300)], k=400))) for i in range(40)]
    spelled(spark, rows)


def test_trie_has_no_unbranched_inner_nodes(spark):
    words = ["receive", "receiver", "recital", "zebras"]
    table = spark.createDataFrame([(w,) for w in words], "word string")
    edges = spelling.build_trie(table, Shelf(spark)).collect()
    assert sorted(e.label for e in edges) == ["eive", "ital", "r", "rec", "zebras"]
    assert {e.own for e in edges if e.own} == set(words)


def search_oracle(items, docs, top=20):
    held = [(k, i, TERM.findall(lower(t or ""))) for k, (i, t) in enumerate(docs)]
    held = [x for x in held if x[2]]
    total = sum(len(t) for *_, t in held)
    df = Counter(t for *_, own in held for t in set(own))
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        asked = Counter(TERM.findall(lower(text or "")))
        for _, i, own in held:
            tf, m = Counter(own), 75 + 25 * len(own) * len(held) // total
            score = sum(k * math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t, k in asked.items() if t in tf)
            if score > 0:
                scores.append((-score, i is None, i if i is not None else 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return out


@pytest.mark.parametrize("tokens, block", [(2_000_000, 128), (300, 4)])
def test_search_by_brute_force(spark, monkeypatch, tokens, block):
    monkeypatch.setattr(search, "SHARD_TOKENS", tokens)
    monkeypatch.setattr(search, "BLOCK", block)
    draw = random.Random(1)
    words = [f"w{k}" for k in range(150)]
    pick = lambda n: " ".join(draw.choices(words, [1 / (1 + k) for k in range(150)], k=n))
    rows = [(i, pick(draw.randint(1, 80))) for i in range(300)] + [(1000 + i, "same text w1 w77") for i in range(40)]
    rows += [(None, "w1 w77 null"), (None, None), (5000, None), (5001, ""), (5002, " .,- "), (BIG, "w77 w78"), (BIG + 1, "w77 w78"), (7, rows[7][1]), (5003, "Été 中文 W77"), (5004, pick(20000))]
    items = [(i, pick(12)) for i in range(20)] + [(20, "w1 w1 w77 unknown"), (21, None), (22, ""), (23, "nowhere"), (None, "Été 中文"), (20, "w1 w1 w77 unknown"), (24, "w140")]
    asked = spark.createDataFrame([(*x, 1, 2) for x in items], "item_id long, text string, rank int, doc_id long")
    got = search.search(asked, documents(spark, rows))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert key(got.collect()) == key(search_oracle(items, rows))
    assert search.search(asked.limit(0), documents(spark, rows)).count() == 0
    assert search.search(asked, documents(spark, [])).count() == 0


def test_several_passes_over_the_items(spark, monkeypatch):
    monkeypatch.setattr(search, "ITEMS", 3)
    rows = [(i, f"a{i % 7} b{i % 5} c{i % 3}") for i in range(60)]
    items = [(i, f"a{i % 7} c{i % 2}") for i in range(10)]
    got = search.search(spark.createDataFrame(items, "item_id long, text string"), documents(spark, rows), top=4)
    assert key(got.collect()) == key(search_oracle(items, rows, top=4))


def test_block_maxima_spare_blocks():
    """Of a frequent term's list only the blocks of documents that the rare term made candidates are decoded."""
    import pyarrow as pa

    shard = search.Shard()
    texts = [b"common" + (b" rare rare rare" if k % 1000 == 5 else b" filler") for k in range(20000)]
    shard.add(pa.array(range(20000), pa.int64()), search.terms_of(texts))
    schema = pa.schema([("shard", pa.int64()), ("term", pa.int64()), ("df", pa.int64()), ("tokens", pa.int64()), ("heads", pa.binary()), ("data", pa.binary()), ("ids", pa.list_(pa.int64()))])
    lists = search.Lists(pa.Table.from_batches(list(shard.rows(0, schema))), 20000, shard.tokens)
    common, rare = search.terms_of([b"common rare"]).hashes().view(np.int64).tolist()
    places, scores = lists.best({common: 1, rare: 3000}, 20)
    assert sorted(places) == list(range(5, 20000, 1000)) and len(set(scores)) == 1
    assert lists.decoded == 1 + 20 < -(-20000 // search.BLOCK)


def test_bytes_of_variable_length():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**28 - 1, 2**28, 2**32 - 1])
    raw, size = search.packed(values)
    assert size.tolist() == [1, 1, 1, 2, 2, 3, 4, 5, 5] and search.unpacked(raw).tolist() == values.tolist()


FORM = "vec_id long, embedding array<float>, vector int, cell int, label string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "x") for i, v in rows], FORM)


def nearest_oracle(rows, every=100, keep=10):
    """From rows (id, vector): of each query id the other ids by their nearest vectors."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = []
    for q in sorted({i for i in ids if i % every == 0}):
        d = np.min([np.sqrt(((x - x[k]) ** 2).sum(axis=1)) for k in np.flatnonzero(ids == q)], axis=0)
        best = {}
        for i, s in zip(ids.tolist(), d.tolist()):
            if i != q:
                best[i] = min(s, best.get(i, s))
        out += [(int(q), r + 1, i, s) for r, (s, i) in enumerate(sorted((s, i) for i, s in best.items())[:keep])]
    return out


def test_few_vectors_are_found_exactly(spark):
    draw = np.random.default_rng(0)
    plain = [(i, draw.normal(size=4).astype(np.float32).tolist()) for i in range(30)]
    plain += [(100 + i, plain[3][1]) for i in range(30)] + [(BIG, plain[4][1]), (200, plain[5][1]), (200, plain[6][1]), (300, plain[3][1]), (300, plain[3][1])]
    odd = [(400, None), (500, [0, 0, 0, 0]), (600, [1, None, 1, 1]), (700, [float("nan"), 1, 1, 1]), (800, [float("inf"), 1, 1, 1]), (900, [1, 2]), (1000, []), (None, [1, 1, 1, 1])]
    got = neighbours.nearest(vectors(spark, plain + odd)).collect()
    want = nearest_oracle(plain)
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got)] == [w[:3] for w in want]
    assert np.allclose([r.score for r in sorted(got)], [w[3] for w in want], rtol=1e-12)
    assert neighbours.nearest(vectors(spark, [])).count() == 0 == neighbours.nearest(vectors(spark, odd)).count() == neighbours.nearest(vectors(spark, [(0, [1, 2])])).count()
    assert [tuple(r) for r in neighbours.nearest(vectors(spark, [(0, [1, 2]), (7, [1, 3])])).collect()] == [(0, 1, 7, 1.0)]


def test_a_hot_vector_and_grouped_vectors(spark):
    """A third of the rows are one vector; the rest lie in groups. Small blocks are dealt over several parts."""
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.1 * draw.normal(size=16)).astype(np.float32).tolist()) for i in range(4000)]
    rows += [(10000 + i, rows[1][1]) for i in range(2000)]
    got = neighbours.nearest(vectors(spark, rows))
    want = nearest_oracle(rows)
    pairs = {(r.query_id, r.vec_id): r.score for r in got.collect()}
    assert len(pairs) == len(want) and len({q for q, _ in pairs}) == len({w[0] for w in want})
    assert sum((w[0], w[2]) in pairs for w in want) >= 0.95 * len(want)
    hot = [w for w in want if w[0] == 10100]
    assert [pairs[w[0], w[2]] for w in hot] == [0.0] * 10


def test_parts_of_blocks_and_queries(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    monkeypatch.setattr(neighbours, "QUERIES", 3)
    draw = np.random.default_rng(2)
    rows = [(i, draw.normal(size=8).astype(np.float32).tolist()) for i in range(1500)]
    got = {(r.query_id, r.vec_id) for r in neighbours.nearest(vectors(spark, rows), every=10).collect()}
    want = {(w[0], w[2]) for w in nearest_oracle(rows, every=10)}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_registered_searches(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    got, want = {(r.query_id, r.vec_id) for r in QUERIES["op12_permutation_index"](spark, FOLDER).collect()}, {(w[0], w[2]) for w in nearest_oracle(rows)}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    n = word_counts(docs)
    gaps = defaultdict(set)
    for w in n:
        for k in range(len(w)):
            gaps[w[:k] + "*" + w[k + 1 :]].add(w)
    pairs = {(a, b) for group in gaps.values() for a in group for b in group if a != b}
    pairs |= {p for w in n for k in range(len(w)) if (v := w[:k] + w[k + 1 :]) in n for p in ((v, w), (w, v))}
    near = Counter(a for a, _ in pairs)
    assert {(r.word, r.n, r.n_near) for r in QUERIES["op11_spelling_variants"](spark, FOLDER).collect()} == {(w, k, near[w]) for w, k in n.items()}
