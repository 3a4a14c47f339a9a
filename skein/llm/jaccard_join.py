"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document's set holds the distinct shingles of ``width`` words (fewer words: the
whole sequence as one). Two sets link when 100 * |x & y| >= percent * |x | y|. All
sets are ordered alike, rare shingles first. With t = ceil(percent * |x| / 100), the
l-prefix of x has |x| - t + l shingles; linked sets share l shingles of their
l-prefixes at least, for every l up to t. Each document has a prefix of its own length:
it is lengthened, up to ``most`` steps, to the l whose estimated cost is least (entries
of the index, and candidates, of which each takes up l shared shingles). A pair of
documents with l and k must then share min(l, k) prefix shingles before it is looked at.

Steps: (1) one pass finds, for each document, a key of its word sequence, its set size
and a parity bitmap of its set (a bit a shingle), and counts the shingles that are
frequent in some task; the most frequent, a bounded number, give the order. (2) One pass
counts the shingles of the prefixes under this order exactly, and a second, with those
counts, emits the prefixes, each distinct text once per task; one shuffle by shingle
drops those that one text only has. (3) The text that shares most prefix shingles with
others is the pivot of a shingle's list; each text is compared with the one pivot that it
shares most of them with. A group of thousands of near copies costs a pair for each member.
(4) Pairs of a list that are still in different components are joined with prefix,
length and positional filters, a bitmap of bounded size, and the count of shared prefix
shingles; long lists are joined block by block. Bitmaps bound the overlap from above (the sets differ in a shingle
at least for each bit that differs), and only what they can't exclude is compared text
by text; so no link between components is lost. (5) Components follow.

Sets are compared by 64-bit hashes; two different shingles or word sequences are taken
for equal with a chance of 2^-64 a pair.

Defined results: null, empty and blank texts have size 0 and their own id as
component; rows with a null id take part, and get the least id of their component or
null; repeated rows each get their row; an empty table gives an empty result; very long
texts are handled whole, one at a time.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import give_back, map_texts, pieces, plain_words, stash
from skein.llm.components import components

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
#: Shingles whose counts give the order: 9 MB at most as arrays.
FREQUENT = 1 << 20
#: Shingles that a task gathers before it counts them, and its least count that is reported.
CHUNK, LOCAL_LEAST = 2_000_000, 4
#: Cost of a candidate against that of an entry of the index.
VERIFY = 1.0
#: Words of the bitmap that tells which keys are looked for: 2 MB.
BITMAP = 1 << 18
#: Bits of the small parity bitmap that candidates are compared by within the join.
SKETCH = 512
#: A shingle's list is joined in blocks of about so many texts.
LIST_BLOCK = 256


def word_key(words: list[bytes]) -> int:
    """Signed 64-bit key of a word sequence."""
    import xxhash

    k = xxhash.xxh3_64_intdigest(b" ".join(words))
    return k - (1 << 64) if k >> 63 else k


def ordered_sets(words: list[list[bytes]], width: int, table=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, token, step) of the distinct shingles of at most 32,767 texts, by text, then
    step, then token. A token's step is that of the table of frequent tokens, or 0."""
    import xxhash

    counts = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(words)), np.uint64, int(counts.sum()))
    text = np.repeat(np.arange(len(words), dtype=np.int16), counts)
    m = max(0, len(h) - width + 1)
    g = np.zeros(m, np.uint64)
    h ^= h >> np.uint64(29)
    for k in range(width):
        g *= _MIX[0]
        g += h[k : k + m] * _MIX[1 + k % 3]
    g ^= g >> np.uint64(32)
    g *= _MIX[2]
    inside = text[:m] == text[width - 1 :]
    token, text = g[inside], text[:m][inside]
    short = [k for k, w in enumerate(words) if 0 < len(w) < width]
    if short:
        token = np.concatenate([token, np.array([xxhash.xxh3_64_intdigest(b" ".join(words[k])) for k in short], np.uint64)])
        text = np.concatenate([text, np.array(short, np.int16)])
    order = np.argsort(token)
    token, text = token[order], text[order]
    step = np.zeros(len(token), np.uint8)
    if table is not None and len(table[0]):
        known, steps = table
        place = np.minimum(np.searchsorted(known, token), len(known) - 1)
        hit = known[place] == token
        step[hit] = steps[place[hit]]
        order = np.argsort(step, kind="stable")
        token, text, step = token[order], text[order], step[order]
    order = np.argsort(text, kind="stable")
    token, text, step = token[order], text[order], step[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (text[1:] != text[:-1])
    return text[new], token[new], step[new]


def shingles(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct hashes of a word sequence's shingles."""
    return ordered_sets([words], width)[1]


def parity(tokens: np.ndarray, bits: int | None = None) -> bytes:
    """Bit k is 1 if an odd number of tokens fall on it; as many bits as tokens, about, if not told."""
    bits = bits or 1 << max(6, int(len(tokens)).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> int:
    """A parity bitmap, folded to ``size`` bits: the parity of fewer, larger groups."""
    value, width = int.from_bytes(bits, "little"), 8 * len(bits)
    while width > size:
        width //= 2
        value = (value >> width) ^ (value & ((1 << width) - 1))
    return value


def most_shared(n: int, m: int, x: bytes, y: bytes) -> int:
    """Upper bound of |x & y| from the sizes and parity bitmaps of two sets."""
    size = 8 * min(len(x), len(y))
    return (n + m - (folded(x, size) ^ folded(y, size)).bit_count()) // 2


class Seen:
    """Texts that a task has had, as far as a bounded table tells."""

    def __init__(self, most: int = 200_000):
        self.most, self.keys = most, set()

    def first(self, key: int) -> bool:
        if key in self.keys:
            return False
        if len(self.keys) >= self.most:
            self.keys.clear()
        self.keys.add(key)
        return True


def survey(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (doc_id, key, n, and bits and sketch where the task meets the text
    first; count null) and of shingles that are frequent in a part of a task (token, count)."""
    names = ("doc_id", "key", "n", "bits", "sketch", "token", "count")

    def make():
        held, sizes = [], {}

        def flush() -> dict[str, list]:
            every = np.concatenate(held) if held else np.empty(0, np.uint64)
            held.clear()
            every.sort()
            got = np.unique(every[LOCAL_LEAST - 1 :][every[LOCAL_LEAST - 1 :] == every[: max(len(every) - LOCAL_LEAST + 1, 0)]])
            counts = np.searchsorted(every, got, "right") - np.searchsorted(every, got, "left")
            none = [None] * len(got)
            return {"doc_id": none, "key": none, "n": none, "bits": none, "sketch": none, "token": got.view(np.int64).tolist(), "count": counts.tolist()}

        def call(ids: list, texts: list[bytes]) -> dict[str, list]:
            if len(sizes) > 200_000:  # this task's texts, as far as a bounded table tells
                sizes.clear()
            words = [plain_words(t.lower()) for t in texts]
            keys, new = [word_key(w) if w else None for w in words], []
            for k, key in enumerate(keys):
                if key is not None and key not in sizes:
                    sizes[key] = 0
                    new.append(k)
            of, token, _ = ordered_sets([words[k] for k in new], width)
            ends = np.searchsorted(of, np.arange(len(new) + 1))
            bits, sketch = [None] * len(ids), [None] * len(ids)
            for j, k in enumerate(new):
                own = token[ends[j] : ends[j + 1]]
                sizes[keys[k]], bits[k], sketch[k] = len(own), parity(own), np.frombuffer(parity(own, SKETCH), np.int64)
            held.append(token)
            none = [None] * len(ids)
            out = {"doc_id": ids, "key": keys, "n": [sizes[k] if k is not None else 0 for k in keys], "bits": bits, "sketch": sketch, "token": none, "count": none}
            if sum(map(len, held)) > CHUNK:
                more = flush()
                out = {c: [*out[c], *more[c]] for c in names}
            return out

        call.finish = lambda: [flush()]
        return call

    return map_texts(docs, make, "doc_id long, key long, n long, bits binary, sketch array<long>, token long, count long", id_col, text_col)


def frequent_tokens(found: DataFrame, most: int = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, steps), sorted by token: the most frequent ones, a bounded number; a step
    is a quarter of a power of two."""
    totals = found.groupBy("token").agg(F.max("count").alias("c"))
    totals = stash(totals.select("token", F.floor(4 * F.log2("c")).cast("int").alias("step")), "frequent")
    least, room = None, most
    for row in totals.groupBy("step").count().orderBy(F.desc("step")).collect():  # 256 rows at most
        room -= row["count"]
        if room < 0:
            break
        least = row["step"]
    if least is None:
        return np.empty(0, np.uint64), np.empty(0, np.uint8)
    table = totals.where(F.col("step") >= least).toArrow()
    tokens = table.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.minimum(table.column("step").to_numpy()[order], 255).astype(np.uint8)


def prefix_steps(n: np.ndarray, step: np.ndarray, percent: int, most: int, verify: float = VERIFY) -> tuple[np.ndarray, np.ndarray]:
    """(l, prefix length) of sets of n tokens, whose steps stand one after another."""
    start = np.cumsum(n) - n
    need = -(-percent * n // 100)
    others = np.concatenate([[0.0], np.cumsum(2.0 ** (step / 4.0) - 1)])
    best, least = np.ones(len(n), np.int64), np.full(len(n), np.inf)
    for k in range(1, most + 1):
        size = np.minimum(n, n - need + k)
        cost = size + verify * (others[start + size] - others[start]) / k
        better = (cost < least) & ((k <= need) | (k == 1))
        best[better], least[better] = k, cost[better]
    return best, np.minimum(n, n - need + best)


def prefixes(
    docs: DataFrame, tokens, percent: int, width: int, most: int, id_col: str, text_col: str, places: bool = True
) -> DataFrame:
    """token, key, n, at (place in the text's order), l: the prefix of each text; of
    them token only unless ``places``."""

    def make():
        seen, table = Seen(), tokens.value

        def call(ids: list, texts: list[bytes]) -> dict:
            words, keys = [], []
            for text in texts:
                w = plain_words(text.lower())
                if w and seen.first(key := word_key(w)):
                    words.append(w)
                    keys.append(key)
            of, token, step = ordered_sets(words, width, table)
            n = np.bincount(of, minlength=len(words)).astype(np.int64)
            l, size = prefix_steps(n, step, percent, most)
            at = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
            keep = at < np.repeat(size, n)
            if not places:
                return {"token": token[keep].view(np.int64)}
            return {
                "token": token[keep].view(np.int64), "key": np.repeat(np.array(keys, np.int64), size),
                "n": np.repeat(n.astype(np.int32), size), "at": at[keep].astype(np.int32), "l": np.repeat(l.astype(np.int8), size),
            }

        return call

    return map_texts(docs, make, "token long, key long, n int, at int, l byte" if places else "token long", id_col, text_col)


def key_bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of bounded size in which the bit of every key is set."""
    slot = F.expr(f"cast(pmod(key, {BITMAP}) as int)")
    bit = F.expr("shiftleft(1L, cast(pmod(shiftright(key, 18), 64) as int))")
    rows = keys.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()  # BITMAP rows at most
    bitmap = np.zeros(BITMAP, np.int64)
    bitmap[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy()
    return bitmap


def marked(bitmap: np.ndarray, key: int) -> bool:
    return bool(int(bitmap[key % BITMAP]) >> ((key >> 18) % 64) & 1)


def texts_of(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, body of the texts with these keys, and perhaps of some others."""
    shared = docs.sparkSession.sparkContext.broadcast(key_bitmap(keys))

    def make():
        seen, marks = Seen(), shared.value

        def call(ids: list, texts: list[bytes]) -> dict[str, list]:
            out = {"key": [], "body": []}
            for text in texts:
                words = plain_words(text.lower())
                if words and marked(marks, key := word_key(words)) and seen.first(key):
                    out["key"].append(key)
                    out["body"].append(text)
            return out

        return call

    found = map_texts(docs, make, "key long, body binary", id_col, text_col)
    return stash(found.groupBy("key").agg(F.first("body").alias("body")), "bodies")


def possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows (a, b) of pairs that the bitmaps of their sets don't exclude."""
    side = lambda key, n, bits: sets.select(F.col("key").alias(key), F.col("n").alias(n), F.col("bits").alias(bits))
    rows = pairs.select("a", "b").join(side("b", "m", "y"), "b").join(side("a", "n", "x"), "a").select("a", "b", "n", "m", "x", "y")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(c.to_pylist() for c in batch.columns[2:])):
                both = most_shared(n, m, x, y)
                keep.append(100 * both >= percent * (n + m - both))
            yield batch.select([0, 1]).filter(pa.array(keep, type=pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, percent: int, width: int, id_col: str, text_col: str) -> DataFrame:
    """The rows (a, b) of pairs that link; only the texts in them are read."""
    keys = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    texts = texts_of(docs, keys, id_col, text_col)
    rows = pairs.join(texts.select(F.col("key").alias("b"), F.col("body").alias("y")), "b")
    rows = rows.join(texts.select(F.col("key").alias("a"), F.col("body").alias("x")), "a").select("a", "b", "x", "y")

    def run(batches):
        import pyarrow as pa

        @lru_cache(maxsize=64)
        def of(text: bytes) -> np.ndarray:
            return shingles(plain_words(text.lower()), width)

        for whole in batches:
            for batch in pieces(whole, 3):
                keep = []
                for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                    x, y = of(x), shingles(plain_words(y.lower()), width)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * both >= percent * (len(x) + len(y) - both))
                yield batch.select([0, 1]).filter(pa.array(keep, type=pa.bool_()))
        give_back()

    return rows.mapInArrow(run, "a long, b long")


def meetings(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, l and k of both) for each prefix shingle that two texts in different
    components c share, unless sizes, places or sketches exclude a link.

    A list of n texts is dealt into n / LIST_BLOCK blocks, and each pair of blocks is a
    key of its own in the join; both sides of the join are the same rows."""
    blocks = F.ceil(F.count("*").over(Window.partitionBy("token")) / LIST_BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.expr("cast(pmod(xxhash64(key), blocks) as int)"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "key", "n", "at", "l", "c", "sketch")
    left = rows.toDF("token", "i", "j", "o", "b", "n", "at", "l", "c", "x")
    right = rows.toDF("token", "i", "j", "p", "a", "m", "by", "k", "d", "y")
    need = f"ceil({percent}.0D * (n + m) / {100 + percent} - 1e-9)"
    prefix = lambda n, at: f"{at} < {n} - ceil({percent}.0D * {n} / 100 - 1e-9) + least(l, k)"
    differ = " + ".join(f"bit_count(x[{w}] ^ y[{w}])" for w in range(SKETCH // 64))
    return (
        left.join(right, ["token", "i", "j"])
        .where("b > a and c <> d and least(o, p) = i and greatest(o, p) = j")
        .where(f"100 * least(n, m) >= {percent} * greatest(n, m) and least(n - at, m - by) + least(l, k) - 1 >= {need}")
        .where(f"{prefix('n', 'at')} and {prefix('m', 'by')} and {differ} <= n + m - 2 * {need}")
        .select("a", "b", F.expr("least(l, k)").alias("l"))
    )


def list_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) of texts in different components that share enough prefix shingles."""
    met = meetings(rows, percent).groupBy("a", "b").agg(F.count("*").alias("n_shared"), F.first("l").alias("l"))
    return met.where("n_shared >= l").select("a", "b")


def near_groups(
    docs: DataFrame,
    percent: int = 85,
    width: int = 4,
    most: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, key (null without words), n; texts: key, id (least), times (rows
    of this key and id), n_rows, component (of keys), component_id), both stored."""
    context = docs.sparkSession.sparkContext
    found = stash(survey(docs, width, id_col, text_col), "survey")
    local = found.where("count is not null").groupBy("token").agg(F.sum("count").alias("count"))
    tokens = context.broadcast(frequent_tokens(local))
    # what stands in prefixes now is counted exactly, and ordered anew where it isn't rare
    again = prefixes(docs, tokens, percent, width, most, id_col, text_col, places=False).groupBy("token").agg(F.count("*").alias("count")).where("count > 1")
    tokens = context.broadcast(frequent_tokens(local.unionByName(again)))

    index = prefixes(docs, tokens, percent, width, most, id_col, text_col)
    per_token = Window.partitionBy("token")
    shared = stash(index.repartition("token").distinct().withColumn("of", F.count("*").over(per_token)).where("of > 1"), "shared")
    # the text with most partners, such as the one that others were copied from, is the pivot of its lists
    hubs = shared.groupBy("key").agg(F.sum(F.col("of") - 1).alias("degree"))
    ranked = shared.join(hubs, "key").withColumn("pivot", F.max(F.struct("degree", "key", "n", "at")).over(per_token))

    sets = found.where("bits is not null").join(shared.select("key").distinct(), "key", "left_semi")
    sets = stash(sets.groupBy("key").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("sketch").alias("sketch")), "sets")
    need = f"ceil({percent}.0D * (n + pivot.n) / {100 + percent} - 1e-9)"
    star = (
        ranked.where(f"key <> pivot.key and 100 * least(n, pivot.n) >= {percent} * greatest(n, pivot.n) and least(n - at, pivot.n - pivot.at) >= {need}")
        .groupBy(F.col("pivot.key").alias("a"), F.col("key").alias("b")).count()
        .groupBy("b").agg(F.min_by("a", F.struct(-F.col("count"), "a")).alias("a"))
    )
    star = stash(possible(star, sets, percent), "star")
    links = stash(verified(star, docs, percent, width, id_col, text_col), "links")
    groups = components(links)

    rows = shared.drop("of").join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("c", F.coalesce("component", "key")).drop("component")
    rows = rows.repartition("token").withColumn("lo", F.min("c").over(per_token)).withColumn("hi", F.max("c").over(per_token)).where("lo < hi").drop("lo", "hi")
    rows = rows.join(sets.select("key", "sketch"), "key")
    pairs = list_pairs(rows, percent).join(star, ["a", "b"], "left_anti")
    pairs = stash(possible(pairs, sets, percent), "pairs")
    if not pairs.isEmpty():
        late = stash(verified(pairs, docs, percent, width, id_col, text_col), "late")
        groups = components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(late))

    documents = found.where("count is null").select("doc_id", "key", "n")
    texts = documents.where("key is not null").groupBy("key", "doc_id").agg(F.count("*").alias("times"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "times"))
    texts = texts.groupBy("key").agg(first.alias("f"), F.sum("times").alias("n_rows"))
    texts = texts.select("key", F.col("f.doc_id").alias("id"), F.col("f.times").alias("times"), "n_rows")
    every = groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())
    members = stash(texts.join(every.withColumnRenamed("node", "key"), "key", "left"), "members")
    least = stash(members.where("component is not null").groupBy("component").agg(F.min("id").alias("least_id")), "least")
    linked = members.where("component is not null").join(least, "component").select("key", "id", "times", "n_rows", "component", F.col("least_id").alias("component_id"))
    single = members.where("component is null").select("key", "id", "times", "n_rows", F.lit(None).cast("long").alias("component"), F.col("id").alias("component_id"))
    return documents, stash(linked.unionByName(single), "texts")


def jaccard_join(docs: DataFrame, **parameters) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id that links lead to) of every row."""
    documents, texts = near_groups(docs, **parameters)
    empty = documents.where("key is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    rows = documents.where("key is not null").join(texts.select("key", "component_id"), "key")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(empty)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """docs with one row of each component: that of the least id (no ids: the least key).

    Rows without words are linked with nothing and stay; of repeated rows one stays. Only
    rows of a component of several rows are shuffled, and of keys with more than a
    thousandth of all rows (a thousand keys at most) only those that stay.
    """
    documents, texts = near_groups(docs, id_col=id_col, text_col=text_col, **parameters)
    group = F.coalesce("component", "key")
    best = F.min(F.when(F.col("id").eqNullSafe(F.col("component_id")), F.col("key")))
    firsts = texts.groupBy(group.alias("g")).agg(best.alias("_key")).select("_key")
    stays = stash(texts.join(firsts, texts["key"] == firsts["_key"]).select("_key", F.col("component_id").alias("_id")), "stays")
    several = key_bitmap(texts.where("n_rows > 1 or component is not null").select("key"))
    total = documents.count()
    hot = texts.where(F.col("n_rows") > max(1, total // 1000)).join(stays, texts["key"] == stays["_key"], "left").select("key", "_key", "_id").collect()
    shared = docs.sparkSession.sparkContext.broadcast((several, {r.key: (r._key is not None, r._id) for r in hot}))

    names, kept = docs.columns, [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*kept)  # the columns may have any names
    i, t = kept[names.index(id_col)], kept[names.index(text_col)]
    schema = plain.withColumn("_k", F.lit(None).cast("long")).schema
    at, of = kept.index(t), kept.index(i)

    def keyed(alone: bool) -> DataFrame:
        """The rows that are certainly alone, or the others, with their key as _k."""

        def run(batches):
            import pyarrow as pa

            marks, hot_keys = shared.value
            for whole in batches:
                for batch in pieces(whole, at):
                    keys, keep = [], []
                    for doc_id, text in zip(batch.column(of).to_pylist(), batch.column(at).to_pylist()):
                        words = plain_words((text or "").encode().lower())
                        key = word_key(words) if words else None
                        if key is not None and not marked(marks, key):
                            key = None
                        stay, first = hot_keys.get(key, (True, doc_id))
                        keep.append((key is None) == alone and stay and first == doc_id)
                        keys.append(key)
                    yield batch.append_column("_k", pa.array(keys, type=pa.int64())).filter(pa.array(keep, type=pa.bool_()))
            give_back()

        return plain.mapInArrow(run, schema)

    linked = keyed(False).join(stays, (F.col("_k") == F.col("_key")) & F.col(i).eqNullSafe(F.col("_id")), "left_semi")
    return linked.dropDuplicates(["_k", i]).unionByName(keyed(True)).drop("_k").toDF(*names)
