"""Periodic runs: stretches of words that repeat with one period at least three times.

The maximal pairs of a text are places (i, j) whose words agree for exactly l words: the
words before i and j differ, and so do the words after. With q = j - i and l >= 2q such a
pair is the stretch of l + q words from i with period q that no neighbour extends, so
maximal pairs of this kind are the runs, and nothing is extended afterwards. (The pair at a
multiple of the period spans the same stretch; the smallest distance is kept.)

They are enumerated bottom-up over the tree of LCP intervals. A suffix order of the words
is made by prefix doubling in numpy, for all texts of a batch at once, and the LCP of
neighbours is read from the ranks of each doubling. l >= 2q and l + q >= ``least`` need
l >= 2/3 of ``least``, so the tree is cut below the largest power of two of that size (16):
words outside of any repeat of that length never reach it. Each node holds its places
in lists by the word to their left; where two children of depth l meet, the smaller
child's places are set against the lists of other left words only. The lists are
kept by blocks wider than l / 2 places, the greatest distance that counts, and sorted
anew into smaller blocks as l halves on the way up. Places of one node within
l / 2 of each other are an arithmetic progression, whose members but for the first have
one left word, so that a block has few lists and a place few partners.

Defined results: a null or empty text has no words and no runs; repeated rows each get
their own row; equal exponents go to the smallest start, then period. Texts are taken
whole; one text is the work of one task, in memory that grows as its number of words times
the logarithm of its longest repeat. An empty table gives no rows. Only the two named columns are read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import map_texts, plain_words

Run = tuple[int, int, int]


def _ranks(texts: list[list[bytes]], cut: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]], np.ndarray]:
    """(codes of all words, end of each word's text, (h, ranks of h words) for h = 1, 2, 4, ...,
    places whose ``cut`` words stand elsewhere in their text too, in the order of suffixes)."""
    sizes = np.array([len(w) for w in texts], dtype=np.int64)
    code: dict[bytes, int] = defaultdict(count().__next__)
    codes = np.fromiter((c for w in texts for c in map(code.__getitem__, w)), dtype=np.int64, count=int(sizes.sum()))
    ends = np.repeat(np.cumsum(sizes), sizes)
    n, places = len(codes), np.arange(len(codes))

    def after(rank: np.ndarray, at: np.ndarray, h: int) -> np.ndarray:
        """Rank + 1 of the place h words on, 0 beyond the end of the text."""
        to = at + h
        return np.where(to < ends[at], rank[np.minimum(to, n - 1)] + 1, 0)

    rank = np.unique(np.repeat(np.arange(len(texts)), sizes) * len(code) + codes, return_inverse=True)[1]
    levels, h = [(1, rank.astype(np.int32))], 1
    while h < cut:
        rank = np.unique(rank * (n + 1) + after(rank, places, h), return_inverse=True)[1]
        h *= 2
        levels.append((h, rank.astype(np.int32)))
    alike = np.bincount(rank, minlength=1)
    rank = (np.cumsum(alike) - alike)[rank]  # the number of places before this group of equal ones
    repeated = open_ = np.flatnonzero(alike[levels[-1][1]] > 1)
    while len(open_):  # only groups that are still equal are cut further
        key = rank[open_] * (n + 1) + after(rank, open_, h)
        order = np.argsort(key, kind="stable")
        key, at, old = key[order], open_[order], rank[open_][order]
        index = np.arange(len(at))
        fresh = np.append(True, key[1:] != key[:-1])
        first = np.append(True, old[1:] != old[:-1])
        begins = np.maximum.accumulate(np.where(fresh, index, 0))
        rank = rank.copy()
        rank[at] = old + begins - np.maximum.accumulate(np.where(first, index, 0))
        h *= 2
        levels.append((h, rank.astype(np.int32)))
        alone = fresh & np.append(fresh[1:], True)
        open_ = np.sort(at[~alone])
    return codes, ends, levels, repeated[np.argsort(rank[repeated])]


def _common(levels: list[tuple[int, np.ndarray]], ends: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of words that the suffixes at x and y have in common."""
    n, long = len(ends), np.zeros(len(x), dtype=np.int64)
    for h, rank in reversed(levels):
        a, b = x + long, y + long
        inside = (a < ends[x]) & (b < ends[y])
        long[inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])] += h
    return long


class _Lists:
    """The places of a node: block of places -> left word -> places."""

    __slots__ = ("blocks", "shift", "size")

    def __init__(self, shift: int):
        self.shift, self.size, self.blocks = shift, 0, {}

    def add(self, place: int, left: list[int]) -> None:
        self.blocks.setdefault(place >> self.shift, {}).setdefault(left[place], []).append(place)
        self.size += 1

    def places(self) -> list[int]:
        return [p for lists in self.blocks.values() for ps in lists.values() for p in ps]

    def narrowed(self, shift: int, left: list[int]) -> _Lists:
        if shift == self.shift:
            return self
        out = _Lists(shift)
        for p in self.places():
            out.add(p, left)
        return out

    def pairs(self, place: int, depth: int, left: list[int], least: int, power: int, out: list[Run]) -> None:
        """Maximal pairs of depth ``depth`` of a place in another child with places of other left words."""
        own, block, reach = left[place], place >> self.shift, depth // (power - 1)
        for b in (block - 1, block, block + 1):
            for word, places in self.blocks.get(b, {}).items():
                if word != own:
                    for other in places:
                        q = abs(place - other)
                        if q <= reach and depth + q >= least:
                            out.append((min(place, other), depth + q, q))


def maximal_pairs(order: list[int], depth: list[int], left: list[int], least: int, power: int) -> list[Run]:
    """(place, length of the stretch, distance) of all maximal pairs that are runs.

    ``order``: places in the order of suffixes; ``depth[k]``: words in common of the places
    k - 1 and k, 0 where the tree is cut."""
    found: list[Run] = []

    def meet(a, b, d: int):
        """Two children of a node of depth d become one."""
        shift = (d // (power - 1)).bit_length()
        if isinstance(a, int) or not isinstance(b, int) and a.size < b.size:
            a, b = b, a
        if isinstance(a, int):
            lists = _Lists(shift)
            lists.add(a, left)
        else:
            lists = a.narrowed(shift, left)
        smaller = [b] if isinstance(b, int) else b.places()
        for p in smaller:
            lists.pairs(p, d, left, least, power, found)
        for p in smaller:
            lists.add(p, left)
        return lists

    path: list[tuple[int, int | _Lists]] = []  # nodes that are open, the deepest last: (depth, children so far)
    for k, place in enumerate(order):
        child, d = place, depth[k + 1] if k + 1 < len(order) else 0
        while path and path[-1][0] > d:
            at, before = path.pop()
            child = meet(before, child, at)
        if path and path[-1][0] == d:
            path[-1] = (d, meet(path[-1][1], child, d))
        elif d:
            path.append((d, child))
    return found


def find_runs(texts: list[list[bytes]], least: int = 24, power: int = 3) -> list[list[Run]]:
    """The runs (start, length, period) of each text, a list of words, by start, then period."""
    runs: list[list[Run]] = [[] for _ in texts]
    cut = 1 << ((least * (power - 1) + power - 1) // power).bit_length() - 1
    if not any(map(len, texts)):
        return runs
    codes, ends, levels, order = _ranks(texts, cut)
    if not len(order):
        return runs
    depth = np.append(0, _common(levels, ends, order[:-1], order[1:]))
    depth[depth < cut] = 0
    begins = np.cumsum([0, *map(len, texts)])
    left = np.append(-1, codes[:-1])
    left[begins[:-1][np.diff(begins) > 0]] = -1
    periods: dict[tuple[int, int], int] = {}
    for start, length, q in maximal_pairs(order.tolist(), depth.tolist(), left.tolist(), least, power):
        periods[start, length] = min(q, periods.get((start, length), q))
    for (start, length), q in sorted(periods.items(), key=lambda x: (x[0][0], x[1])):
        text = int(np.searchsorted(begins, start, "right")) - 1
        runs[text].append((start - int(begins[text]), length, q))
    return runs


def strongest(runs: list[Run]) -> Run | None:
    """The run of greatest length / period; ties: the smallest start, then period."""
    best = None
    for r in runs:  # by start, then period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, q in runs:
        change[start + q] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def document_runs(
    docs: DataFrame, rewrite: Callable[[object, list[bytes]], list[bytes]] | None = None, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_words, runs (array of start, length, period), best (the
    strongest run or null), collapsed (the text's kept words, joined by blanks). ``rewrite``
    changes the words of a text before, by its id."""

    def make():
        def call(ids: list, texts: list[bytes]) -> dict[str, list]:
            words = [plain_words(t) for t in texts]
            if rewrite:
                words = [rewrite(i, w) for i, w in zip(ids, words)]
            runs = find_runs(words)
            as_row = lambda r: r and dict(zip(("start", "length", "period"), r))
            return {
                "doc_id": ids, "n_words": [len(w) for w in words], "runs": [[as_row(r) for r in rs] for rs in runs],
                "best": [as_row(strongest(rs)) for rs in runs],
                "collapsed": [b" ".join(collapse(w, rs)).decode(errors="replace") for w, rs in zip(words, runs)],
            }

        return call

    run = "struct<start: long, length: long, period: long>"
    return map_texts(docs, make, f"doc_id long, n_words long, runs array<{run}>, best {run}, collapsed string", id_col, text_col)


def made_periodic(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The rewriting that op12 asks for: a tenth of all ids get a periodic end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def run_digests(docs: DataFrame) -> DataFrame:
    """op12: doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    found = document_runs(docs, made_periodic)
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
