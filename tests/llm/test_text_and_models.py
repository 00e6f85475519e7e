"""Word arrays, the recurrent network, suffix sorting, packing and merging, without Spark."""

import random

import numpy as np
import pytest
from brute import covered, grams

from ballast.llm.induced import suffix_array
from ballast.llm.language import letter_grams
from ballast.llm.licenses import BAND, Index, align, fingerprints, least, scan_text, winnow
from ballast.llm.packing import END_ID, Codec, sum_of_squares
from ballast.llm.repeats import anchors, runs_of, shared_strings, span_key
from ballast.llm.shards import Cells
from ballast.llm.text import Batch, shingles
from ballast.llm.toxicity import HIDDEN, Network, judge, train, windowed, windows_of
from ballast.llm.warc import LoserTree

TEXTS = ["", "one", " a\tb\x0bc  d ", "Ünï çode Wörter über alles", "x" * 9000 + " y", "same same same same same same", "a b c d e f g", "A B C D E F G"]


def test_words_and_shingles():
    batch = Batch([t.encode() for t in TEXTS])
    words, first = batch.hashes(), batch.first
    assert np.diff(first).tolist() == [len(t.split()) for t in TEXTS]
    for width in (1, 3, 5):
        made, ends = shingles(words, first, width)
        sizes = [len(set(made[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:])]
        assert sizes == [len(grams(t, width)) for t in TEXTS]
        assert made[ends[-3] : ends[-2]].tolist() == made[ends[-2] :].tolist()  # case of A-Z only
    one, two = Batch(["Ä".encode()]), Batch(["ä".encode()])
    assert one.hashes()[0] != two.hashes()[0]


def test_letter_grams_stay_in_their_text():
    parts = [letter_grams([t.encode()]) for t in TEXTS]
    together, counts = letter_grams([t.encode() for t in TEXTS])
    assert counts.tolist() == [c[0] for _, c in parts]
    assert together.tolist() == [x for g, _ in parts for x in g.tolist()]


def test_gradients():
    rng = np.random.default_rng(0)
    net = Network.new([np.arange(1, 6, dtype=np.uint64)] * 2, [np.ones(5)] * 2)
    net.p = {k: rng.normal(0, 0.5, v.shape) for k, v in net.p.items()}  # as doubles
    ids, mask = rng.integers(0, 6, (4, 7, 5)), (np.arange(7)[:, None] < np.array([7, 3, 1, 5, 7])).astype(float)
    target = np.array([1.0, 0, 1, 0, 1])
    _, g = net.gradients(ids, mask, target)
    for name, value in net.p.items():
        for at in rng.integers(0, value.size, 6):
            flat, step = value.reshape(-1), 1e-5
            kept = flat[at]
            ends = []
            for x in (kept + step, kept - step):
                flat[at] = x
                ends.append(net.gradients(ids, mask, target)[0])
            flat[at] = kept
            assert abs((ends[0] - ends[1]) / (2 * step) - np.asarray(g[name]).reshape(-1)[at]) < 1e-4, name


def test_windows_cover_every_word():
    first = np.array([0, 0, 1, 33, 133, 1133])
    start, length, owner = windows_of(first)
    for d in range(5):
        own = {w for s, n, o in zip(start, length, owner) if o == d for w in range(s, s + n)}
        assert own == set(range(first[d], first[d + 1]))
    assert (np.diff(start[owner == 4]) < length[owner == 4][:-1]).all()  # neighbours overlap


def test_training_separates_inflected_words():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abdefgiklmnorstu") for _ in range(rng.randint(2, 7)))
    texts, toxic = [], []
    for i in range(500):
        words = [word() for _ in range(rng.randint(5, 150))]
        bad = i % 4 == 0
        for _ in range(2 * bad):
            words.insert(rng.randrange(len(words)), "zworg" + word()[:3])
        texts.append(" ".join(words).encode())
        toxic.append(int(bad))
    net = train(texts[:350], np.array(toxic[:350]))
    score = judge(net, texts[350:])[0]
    assert np.mean((score >= 0.5) == np.array(toxic[350:])) > 0.95
    score, windows, low, high = judge(net, [b"", b"...", texts[352]])
    assert (windows[:2] == 0).all() and (low[:2] == -1).all() and (score[:2] < 0.5).all()
    assert b"zworg" in texts[352][low[2] : high[2]]


def test_training_without_both_classes():
    assert judge(train([b"a b"], np.array([0])), [b"x"])[0][0] < 0.1
    assert judge(train([b"a b"], np.array([1])), [b"x"])[0][0] > 0.9
    assert judge(train([], np.zeros(0, np.int64)), [b"x"])[0][0] < 0.1


def naive(text, cap, wall):
    n, t = len(text), text.tolist()
    order, lcp = sorted(range(n), key=lambda i: t[i:]), [0] * n
    for k in range(1, n):
        a, b = order[k - 1], order[k]
        while a + lcp[k] < n and b + lcp[k] < n and t[a + lcp[k]] == t[b + lcp[k]] != wall and lcp[k] < cap:
            lcp[k] += 1
    return order, lcp


@pytest.mark.parametrize("memory", [8, 1 << 20])
def test_suffix_array(memory):
    """A memory of 8 tuples sends almost everything through files."""
    rng = np.random.default_rng(0)
    for trial in range(150):
        symbols = int(rng.integers(1, 6))
        text = rng.integers(1, symbols + 1, int(rng.integers(1, 90)))
        text = np.append(np.tile(text, 3) if trial % 3 == 0 else text, 0)
        cap, wall = int(rng.choice([5, 200, 300])), symbols if trial % 2 else -1
        order, lcp = suffix_array(text, symbols + 1, cap, wall, memory)
        assert (order.tolist(), lcp.tolist()) == naive(text, cap, wall)
    runs = np.append(np.full(3000, 2), 0)
    order, lcp = suffix_array(runs, 3, 200)
    assert order.tolist() == list(range(3000, -1, -1)) and lcp.max() == 200


@pytest.mark.parametrize("size", [40, 45, 200])
def test_shared_strings(size):
    """Segments are aligned at their anchors, as those of equal strings are."""
    rng = random.Random(size)
    part = lambda n: bytes(rng.choice(b"abc") for _ in range(n))
    texts = []
    common = part(3 * size)
    for _ in range(25):
        a = rng.randrange(size)
        texts.append(part(rng.randrange(size)) + common[a : a + rng.randrange(3 * size)] + part(rng.randrange(size)))
    texts += [b"z" * 3 * size, b"q" * size + b"z" * 2 * size]
    segments, counts, spots, owner = [], [], [], []
    for i, x in enumerate(texts):
        for _, f, n, s in zip(*(y.tolist() for y in anchors(x, size, 8 if size < 64 else 32))):
            segments.append(x[f : f + n + size - 1])
            counts.append(n)
            spots.append(s - f)
            owner.append((i, f))
    got = shared_strings(segments, np.array(counts), np.array(spots), size)
    of, a, b = runs_of(got, np.array(counts))
    marks = [bytearray(len(t)) for t in texts]
    for k, x, y in zip(of.tolist(), a.tolist(), b.tolist()):
        i, f = owner[k]
        marks[i][f + x : f + y - 1 + size] = b"\1" * (y - x - 1 + size)
    assert marks == covered(texts, size)


def test_anchors_depend_on_the_string_alone():
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcd ") for _ in range(3000))
    h, first, count, spot = anchors(text, 200)
    assert ((spot >= first + count - 1) & (spot <= first + 168)).all()
    assert first[0] == 0 and (first[1:] == first[:-1] + count[:-1]).all() and first[-1] + count[-1] == len(text) - 199
    of = np.repeat(h, count)
    for at in (0, 17, 1234, 2800):
        assert anchors(text[at : at + 200], 200)[0].tolist() == [of[at]]
    assert len(anchors(b"a" * 199, 200)[0]) == 0
    a, n = np.array([5, 700, 5]), np.array([10, 10, 11])
    keys = span_key(text + text, np.append(a, a[:1] + 3000), np.append(n, n[:1]), 200)
    assert keys[0] == keys[3] and len(set(keys.tolist())) == 3


def best_fit(lengths, capacity):
    """Sequences that best fit in decreasing order needs."""
    left = np.zeros(capacity + 1, np.int64)
    made = 0
    for n in np.sort(lengths)[::-1].tolist():
        open_ = np.flatnonzero(left[n:])
        gap = n + int(open_[0]) if len(open_) else capacity
        made += not len(open_)
        left[gap] -= len(open_) > 0
        left[gap - n] += gap > n
    return made


def test_sum_of_squares():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 1025, 4000)
    order = np.argsort(-lengths)
    bins, places = sum_of_squares(lengths[order], 1024)
    fill = np.zeros(bins.max() + 1, np.int64)
    for b, p, n in sorted(zip(bins.tolist(), places.tolist(), lengths[order].tolist())):
        assert fill[b] == p  # gapless
        fill[b] += n
    assert fill.max() <= 1024 and len(fill) <= 1.01 * best_fit(lengths, 1024)
    # a piece goes where the squared counts become smallest
    assert sum_of_squares(np.array([512, 512, 300, 300, 724]), 1024)[0].tolist() == [0, 0, 1, 1, 2]
    assert len(sum_of_squares(np.zeros(0, np.int64), 1024)[0]) == 0


def test_codec_gives_the_ids_of_the_named_file():
    codec = Codec("/opt/tokenizers", "byte_bpe_50k")
    odd = ["", " ", "a  b\n\n c\t\r\n", "don't 123 x=1;", "naïve – ½ 日本語 🙂", "x" * 3000, "<|endoftext|> inside", "\x00\x7f    y", "I'll we've 'S 'LL"]
    for text in odd + TEXTS:
        assert codec.ids(text).tolist() == codec.exact.encode(text, add_special_tokens=False).ids
    assert END_ID == 2


@pytest.mark.parametrize("runs", [[], [[]], [[1, 4], [], [2, 2, 9], [0], [3]], [[5, 6, 7]]])
def test_loser_tree(runs):
    assert list(LoserTree([list(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_fingerprints_and_alignment():
    index = Index.of({"a": "The quick brown fox jumps over the lazy dog today", "none": "", "short": "two words"})
    assert index.names == ["a", "short"]
    batch = Batch([b"x y the quick brown red fox jumps the lazy dog today z"], letters=True)
    words = batch.hashes()
    assert align(index.words[0], words, 2) == (9, 2, 12)  # "over" is missing, "red" is new
    # any K + W - 1 common words share a fingerprint
    rng = random.Random(0)
    for _ in range(50):
        own = [str(rng.randint(0, 9)) for _ in range(5)]
        one, two = ([str(rng.randint(10, 99)) for _ in range(8)] for _ in range(2))
        batch = Batch([" ".join(one[:4] + own + one[4:]).encode(), " ".join(two[:2] + own + two[2:]).encode()], letters=True)
        prints, text, _ = fingerprints(batch.hashes(), batch.first)
        assert set(prints[text == 0].tolist()) & set(prints[text == 1].tolist())


@pytest.mark.parametrize("size, coverage", [(66, 0.8), (100, 0.8), (195, 0.8), (200, 0.8), (300, 0.95), (80, 0.9)])
def test_no_stretch_of_the_coverage_is_lost_by_winnowing(size, coverage):
    """Texts with as many words replaced and put in as allowed, evenly and at random, share a fingerprint near their diagonal."""
    rng = random.Random(size)
    own = [f"w{rng.randint(0, 60)}" for _ in range(size)]
    index = Index.of({"t": " ".join(own)}, coverage)
    assert winnow(size, coverage) in index.grams and sum(winnow(size, coverage)) > 3
    gone = size - least(size, coverage)
    for trial in range(40):
        breaks = gone + BAND
        at = [round((i + 1) * size / (breaks + 1)) for i in range(breaks)] if trial < 20 else sorted(rng.sample(range(1, size), breaks))
        put = set(rng.sample(range(breaks), BAND))
        text, rest = [], iter(range(size))
        for i in rest:
            if i in at:
                text.append("x")
                if at.index(i) not in put:
                    continue
            text.append(own[i])
        batch = Batch([" ".join(["z"] * trial + text).encode()], letters=True)
        found = index.candidates(batch.hashes(), batch.first).tolist()
        assert any(abs(d - trial) <= BAND for _, _, d in found), trial
        assert scan_text(batch.hashes(), [(t, d) for _, t, d in found], [], index, coverage)[0][1] >= least(size, coverage)


def test_smallest_capacity():
    """Stretches bound the capacity that a search over single groups gives, and splitting the open ones finds it."""
    rng = np.random.default_rng(0)
    for _ in range(200):
        size = rng.integers(1, 50, int(rng.integers(1, 120)))
        if rng.random() < 0.3:
            size[rng.integers(len(size))] = size.sum() * rng.random() + 1
        shards, n = int(rng.integers(1, 9)), len(size)
        single = Cells.of([(i, i, int(x), 1, i) for i, x in enumerate(size)])
        least = max(-(-int(size.sum()) // shards), int(size.max()))
        fits = lambda c: single.filled(c, shards)[-1] == n
        best = single.smallest(least, fits)
        assert fits(best) and (best == least or not fits(best - 1))
        cuts = sorted({0, *rng.integers(0, n, 10).tolist(), n})
        cells = Cells.of([(a, b - 1, int(size[a:b].sum()), b - a, b - 1) for a, b in zip(cuts, cuts[1:])])
        while True:
            low, high = cells.bounds(least, shards)
            assert low <= best <= high
            open_ = cells.undecided(low, high, shards)
            if low == high or not open_.any():
                break
            parts = []
            for a, b, _, _, _ in cells.rows(open_):
                m = (a + b) // 2
                parts += [(x, y, int(size[x : y + 1].sum()), y - x + 1, y) for x, y in ((a, m), (m + 1, b))]
            cells = Cells.of(cells.rows(~open_) + parts)
        assert high == best and cells.filled(high, shards)[-1] == len(cells.end)


def test_state_is_small():
    assert HIDDEN <= 16 and windowed(np.zeros((4, 3), np.int32), np.array([0]), np.array([3]))[1].sum() == 3
