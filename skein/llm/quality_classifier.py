"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text are computed in the tasks. The trees are fitted on a bounded
sample of labelled rows (``sample`` rows of least hash), whose statistics alone come
to the driver; they are complete binary trees kept in flat arrays, and a batch of rows
descends all trees at once in numpy. Every row is scored, without a shuffle.

Defined results: null or empty text is scored from zero statistics; rows with a null
id count as held out; label rows without an id or a label are left out, repeated
ones count each; without labelled rows the score is 0.5; repeated rows get a row each.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import change_rows, map_texts, plain_words

#: Most labelled rows that the trees are fitted on.
SAMPLE = 20_000
FEATURES = (
    "log_bytes", "log_words", "word_length", "symbols", "marks", "capitals", "digits", "non_ascii",
    "distinct", "repeated_next", "duplicate_lines", "line_words", "top_word", "shouts", "short_words",
)
_LINE_WORD = re.compile(rb"[^\s]")
_CAPITALS = bytes(range(65, 91))
_SMALL = bytes(range(97, 123))


def _share(text: bytes, chars: bytes) -> float:
    return (len(text) - len(text.translate(None, chars))) / max(1, len(text))


def statistics(text: bytes) -> list[float]:
    """The statistics named in FEATURES; all 0 for a text without words."""
    words = plain_words(text)
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:])))
    capitals, small = _share(text, _CAPITALS), _share(text, _SMALL)
    return [
        math.log1p(len(text)), math.log1p(n), sum(map(len, words)) / n,
        _share(text, b"#*$%&|<>"), _share(text, b".,;:!?\"'()-"), capitals / max(1e-9, capitals + small),
        _share(text, b"0123456789"), _share(text, bytes(range(128, 256))),
        len(counts) / n, 1 - pairs / max(1, n - 1), 1 - len(set(lines)) / max(1, len(lines)),
        min(200.0, n / max(1, len(lines))), max(counts.values()) / n,
        text.count(b"!!") / n, sum(len(w) < 3 for w in words) / n,
    ]


class Forest:
    """Boosted complete binary trees in flat arrays."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        rows, trees = len(x), len(self.feature)
        if not rows:
            return np.empty(0)
        inner = self.feature.shape[1] if trees else 0
        at, every = np.zeros((rows, trees), np.int64), np.arange(trees)[None, :]
        for _ in range(int(math.log2(inner + 1)) if trees else 0):
            f = self.feature[every, at]
            at = 2 * at + 1 + (x[np.arange(rows)[:, None], f] > self.cut[every, at])
        total = self.base + (self.leaf[every, at - inner].sum(axis=1) if trees else 0.0)
        return 1 / (1 + np.exp(-np.broadcast_to(total, (rows,))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0) -> Forest:
    """Fit by histograms: features are cut into at most ``bins`` bins once, and each
    level of a tree takes the best split of every node from sums per bin."""
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y) or y.min() == y.max():
        p = min(max(y.mean(), 0.01), 0.99) if len(y) else 0.5
        return Forest(math.log(p / (1 - p)), np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    p = y.mean()
    margin = np.full(len(y), math.log(p / (1 - p)))
    feature, cut, leaf = (np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    for t in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, h = y - q, q * (1 - q)
        node = np.zeros(len(y), int)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                slot = (node - first) * bins + binned[:, f]
                gs = np.bincount(slot, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(slot, h, width * bins).reshape(width, bins).cumsum(axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (ga - gs) ** 2 / (ha - hs + l2) - ga**2 / (ha + l2)
                gain[(hs < 1) | (ha - hs < 1)] = -1
                k = gain[:, : len(e)].argmax(axis=1)
                got = gain[np.arange(width), k]
                for w in np.flatnonzero(got > best):
                    best[w], feature[t, first + w], cut[t, first + w] = got[w], f, e[k[w]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > cut[t, node])
        gs, hs = np.bincount(node - inner, g, leaves), np.bincount(node - inner, h, leaves)
        leaf[t] = rate * gs / (hs + l2)
        margin += leaf[t, node - inner]
    return Forest(math.log(p / (1 - p)), feature, cut, leaf)


def remainder(id_col: str, divisor: int):
    """crc32 of the id as text, modulo divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor


def train(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Forest:
    """Trees from the labelled rows outside the held-out fold, ``sample`` at most."""
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("long").alias("_label"))
        .where(F.col("_id").isNotNull() & F.col("_label").isNotNull() & (remainder("_id", folds) != 0))
        .orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample)
    )
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def make():
        return lambda ids, texts: {"y": ids, "x": [statistics(t) for t in texts]}

    got = map_texts(rows, make, "y long, x array<double>", "_label", "_text").toPandas()  # sample rows at most, but for repeated ids
    if got.empty:
        return fit(np.empty((0, len(FEATURES))), np.empty(0))
    x, y = np.array(got.x.tolist()), got.y.to_numpy(float)
    order = np.lexsort((*x.T, y))  # the same trees, however the rows arrive
    return fit(x[order], y[order])


def classify(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, folds: int = 5, cut: float = 0.3,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= cut) of every row."""
    forest = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, folds, id_col, text_col, label_col))

    def make():
        def call(ids: list, texts: list[bytes]) -> dict[str, list]:
            return {"doc_id": ids, "score": forest.value.score(np.array([statistics(t) for t in texts]))}

        return call

    scored = map_texts(docs, make, "doc_id long, score double", id_col, text_col)
    return scored.select(
        "doc_id", (remainder("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, cut: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of docs that the classifier doesn't reject; all columns stay."""
    forest = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample, text_col=text_col))

    def make():
        return lambda texts: ((forest.value.score(np.array([statistics(t.encode()) for t in texts])) >= cut).tolist(), None)

    return change_rows(docs, make, text_col)
