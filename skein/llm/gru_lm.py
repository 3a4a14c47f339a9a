"""A gated recurrent language model, trained and applied to whole documents.

Words (lower-cased A-Z, cut at ASCII white space, then one end) are counted over all
training documents; the ``most_words`` most frequent, at most as many as 16-bit numbers
tell apart, become the model's vocabulary, the rest one unknown word. The network is a
GRU with a class-factored softmax in three levels: p(word) = p(group | state) *
p(class in group | state) * p(word in class | state); a class holds PER_CLASS words of
neighbouring frequency, a group about as many classes as there are groups, and the
unknown word is a group of its own. An unknown word further shares its probability by
corpus counts, (c + 1) / (N' + V' + 1), so every text has a probability.

Documents are packed into lanes that run side by side; within a lane the state is
carried from window to window and reset at each document, so a document's score is
that of its complete text. Training is truncated backpropagation: gradients end at
the window, the state does not. The training documents are dealt by a hash of their row
to shards of SHARD tokens, whatever the cluster; every shard is trained on from the same
start, in the order of the hash, and the models are averaged by their numbers of tokens,
in groups of a bounded size; that is one round. So scores depend on the rows alone (but
for rounding in the last digits).

Word counts can have any number of distinct words: the most frequent ones (a bounded
table) are looked up in the tasks, the rest is joined by Spark. Words are known by a
64-bit hash.

Defined results: null or empty text has one token, the end; rows with a null id count
as training rows; without training rows N and V are 0 and scores are those of the
untrained model; repeated rows are counted and scored each; a very long text is a lane
of its own, and memory follows the number of tokens held at a time.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import give_back, keep_memory, map_texts, plain_words, stash

#: Words of the broadcast count table (16 MB); words of a class; hidden units.
TABLE, PER_CLASS, HIDDEN = 1 << 20, 64, 16
#: Words of the vocabulary at most: the unknown word's number, behind whole classes, has to fit 16 bits.
MOST_WORDS = ((1 << 15) - 1) // PER_CLASS * PER_CLASS
#: Models that are averaged at a time; tokens of a class up to which classes are worked on together.
MODELS, FEW = 8, 128
#: Tokens of a block of large classes; rows of a word up to which words are added together; parameters changed at a time.
BLOCK, OFTEN, SOME = 1024, 32, 1 << 15
#: Steps of a window; lanes at most; tokens held at a time; tokens of a shard.
WINDOW, LANES, CHUNK, SHARD = 32, 640, 4_000_000, 4_000_000
#: Tokens trained on at a time: a shard whole, though the hash makes it somewhat larger than SHARD,
#: as a small rest would be many narrow windows, which cost more a token and teach less.
HOLD = SHARD * 5 // 4
#: Numbers of tokens up to which small classes are filled.
FILLED = np.array([2, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128])
END = 0x2545F4914F6CDD1D  # the hash that stands for the end
NEVER = -1e30  # the bias of a place without a class


def held_out(doc_id, divisor: int = 7, rest: int = 2) -> bool:
    return zlib.crc32(str(doc_id).encode() if doc_id is not None else b"") % divisor == rest


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the tokens of all texts one after another, tokens of each text)."""
    import xxhash

    words = [plain_words(t.lower()) for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words)) + 1
    out = np.empty(int(counts.sum()), np.uint64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(counts) - 1] = False
    out[inner] = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, len(out) - len(texts))
    out[~inner] = END
    return out, counts


def word_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """word (hash), c: counts over all training documents."""

    def make():
        held: list[np.ndarray] = []

        def flush() -> dict:
            got, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            held.clear()
            return {"word": got.view(np.int64), "c": counts}

        def call(ids: list, texts: list[bytes]) -> dict:
            if train := [t for i, t in zip(ids, texts) if not held_out(i)]:
                held.append(token_hashes(train)[0])
            return flush() if sum(map(len, held)) > 4_000_000 else {"word": [], "c": []}

        call.finish = lambda: [flush()]
        return call

    found = map_texts(docs, make, "word long, c long", id_col, text_col)
    return found.groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int = TABLE) -> tuple[np.ndarray, np.ndarray]:
    """(words, counts), sorted by word: all that are as frequent as to fit ``most``."""
    steps = counts.groupBy(F.floor(16 * F.log2("c")).alias("s")).count().orderBy(F.desc("s")).collect()  # 1024 rows at most
    least, room = 1 << 30, most
    for row in steps:
        room -= row["count"]
        if room < 0:
            break
        least = row["s"]
    table = counts.where(F.floor(16 * F.log2("c")) >= least).toArrow()
    words = table.column("word").to_numpy().view(np.uint64)
    order = np.argsort(words)
    return words[order], table.column("c").to_numpy()[order]


def blocks(sets: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, list]]:
    """(first token, end, [(set, first token, end)]): the tokens of these sets in runs of BLOCK at most."""
    start = stop = 0
    runs: list[tuple[int, int, int]] = []
    for c, at, end in zip(sets.tolist(), ends[sets].tolist(), ends[sets + 1].tolist()):
        while at < end:
            if runs and (at != stop or stop - start == BLOCK):
                yield start, stop, runs
                runs = []
            if not runs:
                start = at
            stop = min(end, start + BLOCK)
            runs.append((c, at, stop))
            at = stop
    if runs:
        yield start, stop, runs


def level(w: np.ndarray, k: np.ndarray, y: np.ndarray, s: np.ndarray, logp: np.ndarray, ds: np.ndarray | None) -> np.ndarray | None:
    """Adds the log-probabilities of members y within sets k (sorted; those beyond the last
    set are left out) under the states s [tokens, units and a one] to logp, and the gradients
    by s to ds, if it is given; gives those by w [sets, members, weights and a bias] then.
    Large sets are worked on by themselves, in blocks of tokens that stay in the cache, small
    ones with others of about as many tokens, filled up to equal numbers."""
    members, wide = w.shape[1:]
    ends = np.searchsorted(k, np.arange(len(w) + 1))
    sizes, ones, known = np.diff(ends), np.ones(members, w.dtype), int(ends[-1])
    hit = np.arange(0, known * members, members) + y[:known]
    found, total = np.empty(known, w.dtype), np.empty(known, w.dtype)
    grad = np.zeros_like(w) if ds is not None else None
    room = np.empty((BLOCK, members), w.dtype)
    # logits that can't overflow needn't be moved: if not by the largest state and weights, each block is looked at
    near = known == 0 or max(s.max(), -s.min()) * wide * max(w.max(), -w.min()) <= 80
    for start, stop, runs in blocks(np.flatnonzero(sizes > FEW), ends):
        e, part = room[: stop - start], slice(start, stop)
        for c, at, end in runs:
            np.matmul(s[at:end], w[c].T, out=e[at - start : end - start])
        if not near and (e.max() > 80 or e.min() < -80):
            e -= e.max(axis=1, keepdims=True)
        flat, place = e.reshape(-1), hit[part] - start * members
        found[part] = flat[place]
        np.exp(e, out=e)
        sums = np.matmul(e, ones, out=total[part])
        if grad is not None:
            flat[place] -= sums  # over the sums, these are the gradients by the logits
            over = 1 / sums[:, None]
            own, back = s[part] * over, np.empty((stop - start, wide), w.dtype)
            for c, at, end in runs:
                own_e = e[at - start : end - start]
                grad[c] += own_e.T @ own[at - start : end - start]
                np.matmul(own_e, w[c], out=back[at - start : end - start])
            ds[part] += np.multiply(back, over, out=back)
    small = np.flatnonzero((sizes > 0) & (sizes <= FEW))
    fill = FILLED[np.searchsorted(FILLED, sizes[small])]
    for most in sorted(set(fill.tolist())):
        sets = small[fill == most]
        place = ends[sets][:, None] + np.arange(most)
        there = place < ends[sets + 1][:, None]
        at, own, of = place[there], s[np.where(there, place, 0)], w[sets]
        e = own @ of.transpose(0, 2, 1)
        flat, place = e.reshape(-1), np.flatnonzero(there)
        if not near and (e.max() > 80 or e.min() < -80):
            e -= e.max(axis=2, keepdims=True)
        to = place * members + y[at]
        found[at] = flat[to]
        np.exp(e, out=e)
        sums = e.reshape(-1, members) @ ones
        total[at] = sums[place]
        if grad is not None:
            flat[to] -= sums[place]
            over = np.where(there, 1 / sums.reshape(there.shape), 0)[:, :, None].astype(w.dtype, copy=False)  # what fills up has no gradient
            own *= over
            grad[sets] = e.transpose(0, 2, 1) @ own
            back = e @ of
            back *= over
            ds[at] += back.reshape(-1, wide)[place]
    found -= np.log(total)
    logp[:known] += found
    return grad


def sums_by(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct ids, the most frequent first, the sum of the rows of each)."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    begin = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    times = np.diff(np.append(begin, len(ids)))
    by = np.argsort(-times, kind="stable")
    begin, times = begin[by], times[by]
    out, often = rows.take(order[begin], axis=0), int((times > OFTEN).sum())
    ones = np.ones(times[0], rows.dtype)
    for k in range(often):
        np.matmul(ones[: times[k]], rows.take(order[begin[k] : begin[k] + times[k]], axis=0), out=out[k])
    for nth in range(1, OFTEN):  # the second row of each, the third, ...
        more = slice(often, int((times > nth).sum()))
        if more.start >= more.stop:
            break
        out[more] += rows.take(order[begin[more] + nth], axis=0)
    return ids[begin], out


class GRU:
    """Parameters and passes of the network; arrays are float32. Words are numbered by
    rank; the unknown word comes after the last class."""

    def __init__(self, classes: int, p: dict[str, np.ndarray]):
        self.classes, self.p = classes, p

    @staticmethod
    def shapes(classes: int, hidden: int) -> dict[str, tuple]:
        groups, per = GRU.grouped(classes)
        return {
            "w": (classes * PER_CLASS + 1, 3 * hidden), "u": (hidden, 3 * hidden), "c": (1, groups + 1, hidden + 1),
            "g": (groups, per, hidden + 1), "o": (classes, PER_CLASS, hidden + 1),
        }

    @staticmethod
    def grouped(classes: int) -> tuple[int, int]:
        """(groups, classes of a group)."""
        per = math.isqrt(classes - 1) + 1
        return -(-classes // per), per

    @classmethod
    def start(cls, counts: np.ndarray, unknown: float, hidden: int = HIDDEN) -> GRU:
        """Small random weights; the biases give the corpus frequencies of the words, whose
        number is a multiple of PER_CLASS, and of the unknown word."""
        rng, classes = np.random.default_rng(7), len(counts) // PER_CLASS
        groups, per = cls.grouped(classes)
        p = {}
        for k, s in cls.shapes(classes, hidden).items():
            drawn = (rng.standard_normal(math.prod(s)) * 0.1).astype(np.float32)
            if len(s) == 3:  # the levels: each member's weights, then its bias, which is set below
                of = drawn[: -s[0] * s[1]] * np.float32(0.1)
                p[k] = np.zeros(s, np.float32)
                p[k][:, :, :-1] = of.reshape(hidden, s[1]).T if k == "c" else of.reshape(*s[:2], hidden)
            else:
                p[k] = drawn.reshape(s)
        by_class = np.maximum(counts, 0.01).reshape(classes, PER_CLASS)
        by_group = np.zeros(groups * per)  # places without a class stay impossible
        by_group[:classes] = by_class.sum(axis=1)
        by_group = by_group.reshape(groups, per)
        shares = np.append(by_group.sum(axis=1), max(unknown, 0.01))
        p["c"][0, :, -1] = np.log(shares / shares.sum())
        with np.errstate(divide="ignore"):
            p["g"][:, :, -1] = np.maximum(np.log(by_group / by_group.sum(axis=1, keepdims=True)), NEVER)
        p["o"][:, :, -1] = np.log(by_class / by_class.sum(axis=1, keepdims=True))
        return cls(classes, p)

    def flat(self) -> bytes:
        return np.concatenate([x.ravel() for x in self.p.values()]).astype(np.float32).tobytes()

    @classmethod
    def load(cls, data: bytes, classes: int, hidden: int = HIDDEN) -> GRU:
        flat, at, p = np.frombuffer(data, np.float32), 0, {}
        for k, s in cls.shapes(classes, hidden).items():
            n = math.prod(s)
            p[k] = flat[at : at + n].reshape(s).copy()
            at += n
        return cls(classes, p)

    # Inside, units come before lanes or tokens, so that every step works on whole blocks.

    @np.errstate(over="ignore")
    def window(self, before: np.ndarray, first: np.ndarray, h: np.ndarray, keep: bool) -> tuple[np.ndarray, tuple]:
        """States [steps, units, lanes] after each step, and what backpropagation needs:
        the states before each step, the recurrent part of the candidate, gates and
        candidates. before [steps, lanes]: the words fed; first: whether a document
        starts; h [units, lanes]: the carried state, updated in place."""
        n, m, starts = len(h), 2 * len(h), first.any(axis=1).tolist()
        ut = self.p["u"].T.copy()
        ut[:m] *= -1  # the gates' part, see below
        zr = np.ascontiguousarray(self.p["w"][before].transpose(0, 2, 1))  # the input's part, then the gates and candidates
        states = np.empty((len(before), *h.shape), h.dtype)
        recurrent, olds = (np.empty_like(states), np.empty_like(states)) if keep else (None, None)
        for t, x in enumerate(zr):
            if starts[t]:
                h[:, first[t]] = 0
            a = ut @ h
            g, c, am = x[:m], x[m:], a[m:]
            if keep:
                recurrent[t], olds[t] = am, h
            np.subtract(a[:m], g, out=g)  # the logistic function, 1 / (1 + exp(-x)); where exp overflows, it is 0
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            am *= g[n:]
            c += am
            np.tanh(c, out=c)
            h -= c
            h *= g[:n]
            h += c
            states[t] = h
        return states, (olds, recurrent, zr)

    @staticmethod
    def at(states: np.ndarray, real: np.ndarray) -> np.ndarray:
        """[units, tokens]: the states of the real places."""
        flat = states.transpose(1, 0, 2).reshape(states.shape[1], -1)
        return flat if real.all() else flat[:, np.flatnonzero(real)]

    def outputs(self, s: np.ndarray, target: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-probabilities of the targets under the states s [units, tokens], and the
        gradients by s if ``grad`` is given, which gets those of the parameters."""
        n, k = s.shape[1], (target // PER_CLASS).astype(np.int16)
        groups, per = self.grouped(self.classes)
        order = np.argsort(k, kind="stable")
        rows = np.ones((n, len(s) + 1), s.dtype)
        rows[:, :-1] = s.T
        rows, k, y, by_level = rows[order], k[order], (target % PER_CLASS)[order], np.zeros(n, s.dtype)
        inner = np.zeros_like(rows) if grad is not None else None
        group = np.where(k < self.classes, k // per, groups)  # the unknown word is the only one of its group
        for name, sets, members in (("c", np.zeros_like(k), group), ("g", group, k % per), ("o", k, y)):
            by_w = level(self.p[name], sets, members, rows, by_level, inner)
            if grad is not None:
                grad[name] = by_w
        logp = np.empty_like(by_level)
        logp[order] = by_level
        if grad is None:
            return logp, None
        back = np.empty_like(inner)
        back[order] = inner
        return logp, back[:, :-1].T

    def gradients(self, before, first, target, real, h) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
        """(gradients of the summed loss but for the input words', the input words used,
        their gradients, log-probabilities) of a window, by backpropagation within it."""
        states, (olds, recurrent, zr) = self.window(before, first, h, True)
        grad: dict[str, np.ndarray] = {}
        logp, ds = self.outputs(self.at(states, real), target[real], grad)
        steps, n, lanes = states.shape
        into = np.zeros((n, steps * lanes), states.dtype)
        into[:, slice(None) if real.all() else np.flatnonzero(real)] = ds
        into = into.reshape(n, steps, lanes).transpose(1, 0, 2)
        u, m = self.p["u"], 2 * n
        z, r, c = zr[:, :n], zr[:, n:m], zr[:, m:]
        rest, by_c, by_z, by_r = 1 - z, c * c, olds - c, 1 - r
        np.subtract(1, by_c, out=by_c)  # (1 - z) * (1 - c * c)
        by_c *= rest
        by_z *= z  # (old - c) * z * (1 - z)
        by_z *= rest
        by_r *= r  # recurrent * r * (1 - r)
        by_r *= recurrent
        gx, ga = np.empty_like(zr), np.empty_like(zr)
        back, starts = np.zeros_like(h), first.any(axis=1).tolist()
        for t in range(steps - 1, -1, -1):
            back += into[t]
            g, a = gx[t], ga[t]
            dc = np.multiply(back, by_c[t], out=g[m:])
            np.multiply(back, by_z[t], out=g[:n])
            np.multiply(dc, by_r[t], out=g[n:m])
            a[:m] = g[:m]
            np.multiply(dc, r[t], out=a[m:])
            back *= z[t]
            back += u @ a
            if starts[t]:
                back[:, first[t]] = 0
        grad["u"] = (olds @ ga.transpose(0, 2, 1)).sum(axis=0)
        return grad, *sums_by(before.ravel(), gx.transpose(0, 2, 1).reshape(-1, 3 * n)), logp

    def learn(self, before, first, target, real, h, cache: dict, rate: float, full: int) -> None:
        """One step of truncated backpropagation over a window, with Adagrad. full: tokens
        of a window with all lanes; a window with few weighs as little."""
        grad, used, rows, _ = self.gradients(before, first, target, real, h)
        scale = np.float32(1 / full)
        for k, g in grad.items():
            if k not in cache:
                cache[k] = np.zeros_like(g)
            g, acc, p = g.reshape(-1), cache[k].reshape(-1), self.p[k].reshape(-1)
            for at in range(0, len(g), SOME):  # parts that stay in the cache
                part = slice(at, at + SOME)
                step = g[part]
                if step.max() == 0 == step.min():
                    continue  # nothing changes
                step *= scale
                root = step * step
                acc[part] += root
                np.sqrt(acc[part], out=root)
                root += 1e-6
                step /= root
                step *= rate
                p[part] -= step
        rows *= scale
        if "w" not in cache:
            cache["w"] = np.zeros_like(self.p["w"])
        acc = cache["w"][used]
        acc += rows * rows
        cache["w"][used] = acc
        np.sqrt(acc, out=acc)
        acc += 1e-6
        rows /= acc
        rows *= rate
        self.p["w"][used] -= rows


class Lanes:
    """Documents side by side: the longest first, each to the shortest lane. Tokens are
    kept one after another, so memory follows their number, whatever the lengths."""

    def __init__(self, docs: list[np.ndarray], end_id: int, most: int = LANES):
        import heapq

        lengths = np.fromiter(map(len, docs), np.int64, len(docs))
        count = max(1, min(most, len(docs), int(lengths.sum()) // 1024))
        heap, lanes = [(0, k) for k in range(count)], [[] for _ in range(count)]
        for d in np.argsort(-lengths, kind="stable").tolist():
            size, k = heapq.heappop(heap)
            lanes[k].append(d)
            heapq.heappush(heap, (size + int(lengths[d]), k))
        lanes.sort(key=lambda ds: -int(lengths[ds].sum()))
        self.sizes = np.array([int(lengths[ds].sum()) for ds in lanes])
        self.offset = np.cumsum(self.sizes) - self.sizes
        order = np.fromiter(chain.from_iterable(lanes), np.int64, len(docs))
        self.target = np.concatenate([docs[d] for d in order] or [np.empty(0, np.int16)])
        self.doc = np.repeat(order.astype(np.int32), lengths[order])
        self.first = np.zeros(len(self.target), bool)
        self.first[np.cumsum(lengths[order]) - lengths[order]] = True
        self.fed = np.concatenate([self.target[:1], self.target[:-1]])
        self.fed[self.first] = end_id

    def windows(self, size: int = WINDOW) -> Iterator[tuple]:
        """(words fed, document starts, targets, real places, documents) of each window."""
        for at in range(0, int(self.sizes[0]), size):
            steps = np.arange(at, min(at + size, int(self.sizes[0])))[:, None]
            own = slice(0, int((self.sizes > at).sum()))
            real = steps < self.sizes[own]
            place = np.where(real, steps + self.offset[own], 0)
            yield self.fed[place], self.first[place] & real, self.target[place].astype(np.int64), real, self.doc[place]


def trained(coded: DataFrame, start: bytes, classes: int, end_id: int, tokens: int, rounds: int, rate: float) -> bytes:
    """Parameters after some rounds of training in shards and averaging."""
    row = F.xxhash64("doc_id", "ids")
    shard = F.pmod(F.xxhash64(row), F.lit(max(1, round(tokens / SHARD)))).alias("shard")
    docs = coded.where("not held_out").select("ids", shard, row.alias("place"))
    context = coded.sparkSession.sparkContext
    for _ in range(rounds):
        now = context.broadcast(start)

        def run(batches):
            import pyarrow as pa

            net, cache, tokens, held, size, shard = None, {}, 0, [], 0, None
            keep_memory()

            def fit(docs):
                lanes = Lanes(docs, end_id)
                h = np.zeros((HIDDEN, len(lanes.sizes)), np.float32)
                for before, first, target, real, _ in lanes.windows():
                    h = np.ascontiguousarray(h[:, : before.shape[1]])
                    net.learn(before, first, target, real, h, cache, rate, WINDOW * len(lanes.sizes))

            for batch in batches:
                for raw, of in zip(batch.column(0), batch.column(1).to_pylist()):
                    if of != shard or size >= HOLD:
                        if held:
                            fit(held)
                            tokens, held, size = tokens + size, [], 0
                        if of != shard:
                            if tokens:
                                yield pa.RecordBatch.from_pydict({"part": [shard], "tokens": [tokens], "p": [net.flat()]})
                            net, cache, tokens, shard = GRU.load(now.value, classes), {}, 0, of
                    held.append(np.frombuffer(raw.as_buffer(), np.int16).copy())
                    size += len(held[-1])
            if held:
                fit(held)
                yield pa.RecordBatch.from_pydict({"part": [shard], "tokens": [tokens + size], "p": [net.flat()]})
            give_back()

        dealt = docs.repartition("shard").sortWithinPartitions("shard", "place")
        models = stash(dealt.mapInArrow(run, "part long, tokens long, p binary"), "models")

        def mean(frame):
            import pandas as pd

            frame = frame.sort_values("part")
            weight = frame.tokens.to_numpy(float)
            total = sum(w * np.frombuffer(p, np.float32).astype(float) for w, p in zip(weight, frame.p))
            p = (total / weight.sum()).astype(np.float32).tobytes()
            return pd.DataFrame({"part": [frame.part.iloc[0]], "tokens": [int(weight.sum())], "p": [p]})

        count = models.count()
        while count > 1:  # some models a group, until one is left
            ranked = models.withColumn("g", F.expr(f"part div {MODELS}")).withColumn("part", F.col("g"))
            models = stash(ranked.groupBy("g").applyInPandas(lambda f: mean(f.drop(columns="g")), "part long, tokens long, p binary"), "models")
            count = models.count()
        best = models.first()
        start = bytes(best.p) if best else start
    return start


def coder(table):
    """The function that numbers the words of texts, for map_texts: see CODED. table:
    (words, log10(c + 1), number of each word, number of the unknown word)."""

    def make():
        from pyspark import TaskContext

        words, logs, ids_of, unknown = table.value
        part = TaskContext.get().partitionId() << 40
        given: dict[int, int] = {}
        state = {"next": 0}

        def call(doc_ids: list, texts: list[bytes]) -> dict[str, list]:
            h, counts = token_hashes(texts)
            starts = np.cumsum(counts) - counts
            order = np.argsort(h)
            sorted_h = h[order]
            place = np.minimum(np.searchsorted(words, sorted_h), max(0, len(words) - 1))
            there = words[place] == sorted_h if len(words) else np.zeros(len(h), bool)
            ids, log, hit = np.full(len(h), unknown, np.int16), np.zeros(len(h)), np.zeros(len(h), bool)
            found = order[there]
            ids[found], log[found], hit[found] = ids_of[place[there]], logs[place[there]], True
            per = lambda x: np.add.reduceat(x, starts) if len(x) else x
            text = np.repeat(np.arange(len(texts), dtype=np.int16), counts)[order[~there]]
            by = np.argsort(text, kind="stable")
            text, rest = text[by], sorted_h[~there][by]
            new = np.ones(len(rest), bool)
            new[1:] = (rest[1:] != rest[:-1]) | (text[1:] != text[:-1])
            at = np.flatnonzero(new)
            times, text, rest = np.diff(np.append(at, len(rest))), text[at], rest[at].view(np.int64)
            ends = np.searchsorted(text, np.arange(len(texts) + 1))
            link, rests, many, raw = [], [], [], []
            for k, (a, n) in enumerate(zip(starts.tolist(), counts.tolist())):
                raw.append(ids[a : a + n].tobytes())
                x, y = ends[k], ends[k + 1]
                number = None
                if x < y:
                    key = hash(h[a : a + n].tobytes())
                    if len(given) > 100_000:
                        given.clear()
                    if emit := key not in given:
                        given[key] = part + state["next"]
                        state["next"] += 1
                    number = given[key]
                rests.append(rest[x:y] if x < y and emit else None)
                many.append(times[x:y] if x < y and emit else None)
                link.append(number)
            odd = ids == unknown
            return {
                "doc_id": doc_ids, "held_out": list(map(held_out, doc_ids)), "n_tokens": counts, "n_known": per(hit.astype(np.int64)),
                "log_all": per(log), "log_unknown": per(np.where(odd, log, 0.0)), "n_unknown": per(odd.astype(np.int64)),
                "link": link, "rest": rests, "times": many, "ids": raw,
            }

        return call

    return make


_KNOWN = "doc_id long, held_out boolean, n_tokens long, n_known long, log_all double, log_unknown double, n_unknown long, link long"
#: Of a text: sums over the words of the table, and the words outside it (once for equal texts of a task, by link).
CODED = f"{_KNOWN}, rest array<long>, times array<long>, ids binary"


def score_documents(
    docs: DataFrame, rounds: int = 1, rate: float = 0.05, most_words: int = MOST_WORDS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    context = docs.sparkSession.sparkContext
    counts = stash(word_counts(docs, id_col, text_col), "counts")
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    words, c = frequent(counts)
    ranked = np.lexsort((words, -c))
    top = ranked[: min(most_words, MOST_WORDS)]
    classes = max(1, -(-len(top) // PER_CLASS))
    unknown = classes * PER_CLASS
    ids = np.full(len(words), unknown, np.int16)
    ids[top] = np.arange(len(top), dtype=np.int16)
    shown = np.zeros(unknown)
    shown[: len(top)] = c[top]
    other_n, other_v = whole.n - int(c[top].sum()), whole.v - len(top)
    at = np.searchsorted(words, np.uint64(END))
    end_id = int(ids[at]) if at < len(words) and words[at] == np.uint64(END) else unknown
    table = context.broadcast((words, np.log10(c + 1.0), ids, unknown))
    coded = stash(map_texts(docs, coder(table), CODED, id_col, text_col), "coded")
    start = GRU.start(shown, other_n).flat()
    model = context.broadcast(trained(coded, start, classes, end_id, whole.n, rounds, rate))

    def run(batches):
        import pyarrow as pa

        net, rows, docs, size = GRU.load(model.value, classes), [], [], 0

        def score():
            total = np.zeros(len(docs))
            lanes = Lanes(docs, end_id)
            h = np.zeros((HIDDEN, len(lanes.sizes)), np.float32)
            for before, first, target, real, doc in lanes.windows():
                h = np.ascontiguousarray(h[:, : before.shape[1]])
                states, _ = net.window(before, first, h, False)
                logp, _ = net.outputs(net.at(states, real), target[real])
                total += np.bincount(doc[real], logp, len(docs))
            at = 0
            for part in rows:
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(total[at : at + part.num_rows])], names=[*part.schema.names, "ln_p"])
                at += part.num_rows

        for batch in batches:
            start = 0
            for k, raw in enumerate(batch.column(8)):
                docs.append(np.frombuffer(raw.as_buffer(), np.int16).copy())
                size += len(docs[-1])
                if size >= CHUNK:
                    rows.append(batch.select(range(8)).slice(start, k + 1 - start))
                    yield from score()
                    rows, docs, size, start = [], [], 0, k + 1
            if start < batch.num_rows:
                rows.append(batch.select(range(8)).slice(start))
        if rows:
            yield from score()
        del rows, docs
        give_back()

    plain = coded.select("doc_id", "held_out", "n_tokens", "n_known", "log_all", "log_unknown", "n_unknown", "link", "ids")
    scored = stash(plain.mapInArrow(run, f"{_KNOWN}, ln_p double"), "scored")

    rest = coded.where("rest is not null").select("link", F.explode(F.arrays_zip("rest", "times")).alias("r"))
    rest = rest.select("link", F.col("r.rest").alias("word"), F.col("r.times").alias("times"))
    rest = rest.join(counts, "word").groupBy("link").agg(
        F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("logs")
    )
    alone = scored.where("link is null").select("*", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("logs"))
    every = scored.where("link is not null").join(rest, "link", "left").select(*alone.columns).unionByName(alone)  # no join on one null
    known, logs = F.coalesce("known", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    share, inner = math.log10(whole.n + whole.v + 1), math.log10(other_n + other_v + 1)
    return every.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(int(whole.n)).cast("long").alias("train_tokens"),
        (F.col("log_all") + logs - F.col("n_tokens") * share).alias("base_score"),
        (F.col("ln_p") / math.log(10) + F.col("log_unknown") + logs - F.col("n_unknown") * inner).alias("score"),
    )
