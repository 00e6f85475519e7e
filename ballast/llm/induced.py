"""Suffix sorting with common-prefix lengths by external induced sorting.

The text is a sequence of numbers that ends with its only zero. Suffixes are of
type L or S as they are larger or smaller than the next one. The order of the
leftmost S suffixes (found by naming the stretches between them and recursion on
the names) induces that of all L suffixes in one ascending sweep, and those the
order of all S suffixes in one descending sweep. A sweep takes tuples (first
symbol, suffix, place of its inducer) out of a priority queue and puts those of
the preceding suffixes in. The common prefix of two neighbours is one more than
the least one between their inducers, so it travels along; it is capped.

The queue keeps its tuples by ranges of symbols, in memory up to a limit and
beyond that in an unnamed file that ends with the task. A sweep takes as many
symbols at once as have no tuple put among them, so that each step works on
arrays.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Tuples of a range that are sorted at once, and those kept in memory altogether.
RANGE, MEMORY = 1 << 13, 1 << 22
#: Stretches between leftmost S suffixes are sorted as tuples where none is longer, otherwise by two sweeps.
SHORT = 16


class TupleQueue:
    """Tuples (key, suffix, inducer) that come out by key and, of equal keys, in the order put in."""

    def __init__(self, counts: np.ndarray, memory: int = MEMORY, size: int = RANGE):
        """``counts`` tells how many tuples each key will get, so that ranges hold about ``size``."""
        self.upper = np.searchsorted(np.arange(1, counts.sum() // size + 2) * size, np.cumsum(counts), "left")
        self.parts: dict[int, list[np.ndarray]] = {}
        self.files: dict[int, object] = {}
        self.held, self.memory = 0, memory

    def range_of(self, key):
        return self.upper[key]

    def put(self, tuples: np.ndarray) -> None:
        if not tuples.shape[1]:
            return
        where = self.upper[tuples[0]]
        order = np.argsort(where, kind="stable")
        where, tuples = where[order], tuples[:, order]
        edges = np.flatnonzero(np.diff(where, prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            self.parts.setdefault(int(where[a]), []).append(tuples[:, a:b])
        self.held += tuples.shape[1]
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        for k, parts in self.parts.items():
            if k not in self.files:
                self.files[k] = tempfile.TemporaryFile()
            for x in parts:
                self.files[k].write(np.ascontiguousarray(x.T).tobytes())
        self.parts, self.held = {}, 0

    def take(self, k: int) -> np.ndarray:
        """All tuples of range ``k`` so far, in the order put in."""
        out = []
        if k in self.files:
            f = self.files.pop(k)
            f.seek(0)
            out.append(np.frombuffer(f.read(), np.int64).reshape(-1, 3).T)
            f.close()
        own = self.parts.pop(k, [])
        self.held -= sum(x.shape[1] for x in own)
        return np.concatenate([*out, *own], axis=1) if out or own else np.zeros((3, 0), np.int64)


class Minima:
    """Least values over ranges of a growing sequence: level j holds the least of the 2^j values up to each place."""

    def __init__(self, size: int, kind):
        self.levels = np.zeros((max(1, size.bit_length()), size), kind)
        self.n = 0

    def append(self, values: np.ndarray) -> None:
        a, b = self.n, self.n + len(values)
        self.levels[0, a:b] = values
        for j in range(1, len(self.levels)):
            half = 1 << (j - 1)
            if b < 2 * half:
                break
            low = max(a, half)
            self.levels[j, a:low] = 0
            self.levels[j, low:b] = np.minimum(self.levels[j - 1, low:b], self.levels[j - 1, low - half : b - half])
        self.n = b

    def between(self, after: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Least of the places after+1 .. upto."""
        length = upto - after
        j = np.frexp(length.astype(np.float64))[1] - 1
        return np.minimum(self.levels[j, upto], self.levels[j, after + (1 << j)])


def sweep(text: np.ndarray, induced: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray | None, symbols: int, down: bool, runs: np.ndarray | None, cap: int, wall: int, memory: int):
    """The scan of seeds and induced suffixes in order, with common prefixes of neighbours.

    ``seeds`` come in scan order. Upwards L suffixes are induced, downwards S
    suffixes; in both, those of a symbol are scanned before its seeds.
    """
    key_of = (lambda at: symbols - 1 - text[at]) if down else (lambda at: text[at])
    counts = np.bincount(key_of(np.flatnonzero(induced)), minlength=symbols)
    queue = TupleQueue(counts, memory)
    total = len(seeds) + int(counts.sum())
    scan = np.empty(total, np.int64)
    least = Minima(total, np.uint8 if cap < 256 else np.uint16) if seed_lcp is not None else None
    seed_key = key_of(seeds)
    seed_from = np.searchsorted(seed_key, np.arange(symbols + 1))
    done = 0
    last = [-1, 0]  # key and inducer of the induced suffix scanned last
    wall_key = (symbols - 1 - wall) if down else wall

    def emit(items: np.ndarray, first_seed: int, end_seed: int) -> np.ndarray:
        """Scan induced tuples (sorted) and the seeds of the same keys; returns what they induce."""
        nonlocal done
        at, key = items[1], items[0]
        n, m = len(at), end_seed - first_seed
        if m:
            keys = np.concatenate((key, seed_key[first_seed:end_seed]))
            order = np.argsort(keys, kind="stable")
            keys, spots = keys[order], np.concatenate((at, seeds[first_seed:end_seed]))[order]
        else:
            keys, spots, order = key, at, None
        if least is not None:
            lcp = np.zeros(n + m, np.int64)
            own = np.zeros(n, np.int64)
            if n:
                before_key, before_x = np.concatenate(([last[0]], key[:-1])), np.concatenate(([last[1]], items[2, :-1]))
                same = (before_key == key) & (key != wall_key)
                own[same] = 1 + least.between(before_x[same], items[2][same]).astype(np.int64)
                last[:] = [int(key[-1]), int(items[2, -1])]
            if m:
                of_seeds = np.zeros(m, np.int64)
                inner = np.arange(first_seed, end_seed)
                follows = (inner > 0) & (seed_key[np.maximum(inner - 1, 0)] == seed_key[inner])
                of_seeds[follows] = seed_lcp[inner[follows]]
                lcp[:] = np.concatenate((own, of_seeds))[order]
                # a symbol's first seed after its last induced suffix: both begin with a run of the symbol
                is_seed = order >= n
                edge = is_seed & np.concatenate(([done > 0 and bool(last_is_induced[0])], ~is_seed[:-1])) & (keys == np.concatenate(([last_key[0]], keys[:-1]))) & (keys != wall_key)
                where = np.flatnonzero(edge)
                previous = np.where(where > 0, spots[where - 1], scan[done - 1] if done else 0)
                lcp[where] = np.minimum(runs[spots[where]], runs[previous])
                last_is_induced[0] = not is_seed[-1]
            elif n:
                lcp[:] = own
                last_is_induced[0] = True
            least.append(np.minimum(lcp, cap))
            if n + m:
                last_key[0] = int(keys[-1])
        scan[done : done + n + m] = spots
        x = np.arange(done, done + n + m)
        done += n + m
        some = spots > 0
        some[some] = induced[spots[some] - 1]
        made = spots[some] - 1
        return np.stack((key_of(made), made, x[some]))

    last_key, last_is_induced = [-1], [False]
    ranges = int(queue.upper[-1]) + 1 if symbols else 0
    bounds = np.searchsorted(queue.upper, np.arange(ranges + 1))
    look = 1024
    for k in range(ranges):
        low, high = int(bounds[k]), int(bounds[k + 1])  # keys low .. high - 1
        waiting = queue.take(k)
        waiting = waiting[:, np.argsort(waiting[0], kind="stable")]
        while low < high:
            if not waiting.shape[1] and seed_from[low] == seed_from[high]:
                break
            was = done
            # of the next keys, as many as twice the last step took: the largest up to which nothing is put in
            begin = int(seed_from[low])
            ahead = int(waiting[0, look]) if waiting.shape[1] > look else high - 1
            if begin + look < seed_from[high]:
                ahead = min(ahead, int(seed_key[begin + look]))
            end, near = int(seed_from[ahead + 1]), int(np.searchsorted(waiting[0], ahead, "right"))
            spots = np.concatenate((waiting[1, :near], seeds[begin:end]))
            keys = np.concatenate((waiting[0, :near], seed_key[begin:end]))
            goal = np.full(len(spots), symbols)
            some = spots > 0
            some[some] = induced[spots[some] - 1]
            goal[some] = key_of(spots[some] - 1)
            order = np.argsort(keys, kind="stable")
            keys, goal = keys[order], np.minimum.accumulate(goal[order])
            ends = np.flatnonzero(np.diff(keys, append=-1))
            free = ends[goal[ends] > keys[ends]]
            if keys[ends[0]] < goal[ends[0]]:
                # goals only fall and keys only rise along ``ends``
                stop = int(keys[free[-1]]) + 1
                taken = int(np.searchsorted(waiting[0], stop))
                new = emit(waiting[:, :taken], int(begin), int(seed_from[stop]))
                waiting = waiting[:, taken:]
            else:
                # the first key puts tuples among its own: rounds of them, then its seeds
                stop = int(keys[0]) + 1
                taken = int(np.searchsorted(waiting[0], stop))
                now, waiting, later = waiting[:, :taken], waiting[:, taken:], []
                while now.shape[1]:
                    new = emit(now, int(begin), int(begin))
                    own = new[0] == stop - 1
                    later.append(new[:, ~own])
                    now = new[:, own]
                if seed_from[stop] > begin:
                    later.append(emit(now, int(begin), int(seed_from[stop])))
                new = np.concatenate(later, axis=1) if later else np.zeros((3, 0), np.int64)
            look = max(256, 2 * (done - was))
            here = new[0] < high
            queue.put(new[:, ~here])
            if here.any():
                waiting = np.concatenate((waiting, new[:, here]), axis=1)
                waiting = waiting[:, np.argsort(waiting[0], kind="stable")]
            low = stop
    return scan[:done], least


def suffix_array(text: np.ndarray, symbols: int, cap: int, wall: int = -1, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order and each one's common prefix with the one before, up to ``cap``.

    ``text`` has values 0 .. symbols-1, and 0 at its end only. A common prefix
    ends before the symbol ``wall``.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    text = text.astype(np.int64)
    change = np.flatnonzero(np.diff(text))
    # of each position the end of its run of equal symbols decides its type
    run_end = change[np.minimum(np.searchsorted(change, np.arange(n)), len(change) - 1)]
    run_end[n - 1] = n - 1
    smaller = np.zeros(n, bool)
    smaller[:-1] = text[run_end[:-1]] < text[run_end[:-1] + 1]
    smaller[-1] = True
    runs = run_end + 1 - np.arange(n)
    left = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1  # leftmost S suffixes in text order, the last is the end

    def both_sweeps(seeds: np.ndarray, lcp: np.ndarray | None):
        up, least = sweep(text, ~smaller, seeds, lcp, symbols, False, runs, cap, wall, memory)
        large = np.flatnonzero(~smaller[up])
        down_seeds, down_lcp = up[large][::-1], None
        if lcp is not None:
            down_lcp = np.zeros(len(large), np.int64)
            down_lcp[1:] = least.between(large[:-1], large[1:])[::-1]
        del least
        inner = smaller.copy()
        inner[-1] = False  # the end is no one's predecessor's heir: it stands first
        down, least = sweep(text, inner, down_seeds, down_lcp, symbols, True, runs, cap, wall, memory)
        order = np.concatenate(([n - 1], down[::-1]))
        if lcp is None:
            return order, None
        out = np.zeros(n, np.int64)
        out[2:] = least.levels[0, 1 : len(down)][::-1]
        return order, out

    if len(left) > 1:
        following = np.append(left[1:], n - 1)
        length = following - left
        if length.max() <= SHORT:
            # one that ends where another goes on ends in an S suffix, which is the larger
            columns = [np.where(length >= k, text[np.minimum(left + k, n - 1)], symbols) for k in range(int(length.max()) + 1)]
            sorted_left = left[np.lexsort(columns[::-1])]
        else:
            order, _ = both_sweeps(left[np.argsort(text[left], kind="stable")], None)
            is_left = np.zeros(n, bool)
            is_left[left] = True
            sorted_left = order[is_left[order]]
        rank = np.zeros(n, np.int64)
        rank[left] = np.arange(len(left))
        fresh = ~equal_stretches(text, sorted_left[:-1], sorted_left[1:], length[rank[sorted_left]])
        names = np.concatenate(([0], np.cumsum(fresh)))
        reduced = np.zeros(len(left), np.int64)
        reduced[rank[sorted_left]] = names
        if names[-1] + 1 == len(left):
            seeds, shared = sorted_left, np.zeros(len(left), np.int64)
        else:
            own, shared = suffix_array(reduced, int(names[-1]) + 1, cap, -1, memory)
            seeds = left[own]
        lcp = expand(text, seeds, shared, rank, left, cap, wall)
    else:
        seeds, lcp = left, np.zeros(1, np.int64)
    return both_sweeps(seeds, lcp)


def equal_stretches(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether neighbours' stretches, first symbol of the next one included, are equal."""
    out = length[:-1] == length[1:]
    open_, size, k = np.flatnonzero(out), length[1:], 0
    while len(open_):
        x, y = a[open_] + k, b[open_] + k
        same = text[np.minimum(x, len(text) - 1)] == text[np.minimum(y, len(text) - 1)]
        out[open_[~same]] = False
        k += 1
        open_ = open_[same & (size[open_] >= k)]
    return out


def expand(text: np.ndarray, seeds: np.ndarray, shared: np.ndarray, rank: np.ndarray, left: np.ndarray, cap: int, wall: int) -> np.ndarray:
    """Common prefixes in symbols from those in names: whole stretches, then symbol by symbol."""
    n, out = len(text), np.zeros(len(seeds), np.int64)
    if len(seeds) < 2:
        return out
    p, q = seeds[:-1], seeds[1:]
    known = left[np.minimum(rank[p] + shared[1:], len(left) - 1)] - p
    known = np.minimum(known, cap)
    free = np.full(len(p), n)
    if wall >= 0:
        walls = np.append(np.flatnonzero(text == wall), n)
        free = walls[np.searchsorted(walls, p)] - p
        known = np.minimum(known, free)
    open_ = np.flatnonzero((known < cap) & (known < free))
    while len(open_):
        x, y = p[open_] + known[open_], q[open_] + known[open_]
        inside = (x < n) & (y < n)
        same = np.zeros(len(open_), bool)
        same[inside] = (text[x[inside]] == text[y[inside]]) & (text[x[inside]] != wall)
        open_ = open_[same]
        known[open_] += 1
        open_ = open_[known[open_] < cap]
    out[1:] = known
    return out
