"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash of a place is the sum of table values of the last 32 bytes, each shifted
left by its distance. A chunk ends where the hash's top bits are 0, but not before
``least`` bytes and at ``most`` bytes at the latest, so an insertion moves no cut
beyond its surroundings. Chunks are deduplicated by a 64-bit digest (different chunks
fall together with a chance of 2^-64 a pair).

Chunks found in one document only never leave the first join. What is left of a
document are stretches of consecutive chunks; in these, the shortest windows of
consecutive chunks with ``least_run`` bytes or more are taken from each chunk on and
up to each chunk, and known by a hash of their chunks' digests. A window found in two
documents or more is repeated, whoever else holds its chunks. So every stretch of
``least_run`` bytes of whole chunks that two documents share is found, all of it, and
chance repeats of a few words aren't. Windows that touch make one run. The partner of
a window is its first holder (that of the first holder its last one), chosen last.

Defined results: null or empty text has no chunk and no row; documents are known by
their id (a row without id by its text, reported with a null id; rows with the same
id count as one document); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import map_texts, stash

BITS, LEAST, MOST, LEAST_RUN = 5, 16, 256, 96


def gear_table() -> np.ndarray:
    """256 pseudo-random values, from a multiplicative rule."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte, by doubling the window five times."""
    h = GEAR[data]
    for k in range(5):
        w = 1 << k
        older = h[:-w] << np.uint32(w)
        h = h.copy()
        h[w:] += older
    return h


def cuts(text: bytes, bits: int = BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of a text."""
    n = len(text)
    if not n:
        return []
    marks = np.flatnonzero(gear_hashes(np.frombuffer(text, np.uint8)) >> np.uint32(32 - bits) == 0) + 1
    out, at = [], 0
    for m in marks.tolist():
        while m - at > most:
            at += most
            out.append(at)
        if m - at >= least:
            at = m
            out.append(at)
    while n - at > most:
        at += most
        out.append(at)
    if at < n:
        out.append(n)
    return out


def text_hash(text: bytes) -> int:
    """Tells apart the texts of rows with the same id."""
    import xxhash

    return xxhash.xxh3_64_intdigest(text) >> 33


def chunks(docs: DataFrame, bits: int, least: int, most: int, id_col: str, text_col: str) -> DataFrame:
    """digest, d (document), text (a hash of it), seq, start, size (bytes) of every chunk."""

    def make():
        import xxhash

        def call(ids: list, texts: list[bytes]) -> dict:
            digest, sizes, starts, counts, keys, hashes = [], [], [], [], [], []
            for i, text in zip(ids, texts):
                ends = cuts(text, bits, least, most)
                begin = [0, *ends[:-1]] if ends else []
                digest += [xxhash.xxh3_64_intdigest(text[a:b]) for a, b in zip(begin, ends)]
                starts.append(np.array(begin, np.int64))
                sizes.append(np.array(ends, np.int64) - starts[-1])
                counts.append(len(ends))
                hashes.append(text_hash(text))
                keys.append(i if i is not None else -(1 << 62) - (xxhash.xxh3_64_intdigest(text) >> 3))
            return {
                "digest": np.array(digest, np.uint64).view(np.int64),
                "d": np.repeat(np.array(keys, np.int64), counts),
                "text": np.repeat(np.array(hashes, np.int32), counts),
                "seq": np.concatenate([np.arange(c, dtype=np.int32) for c in counts] or [np.empty(0, np.int32)]),
                "start": np.concatenate(starts or [np.empty(0, np.int64)]).astype(np.int32),
                "size": np.concatenate(sizes or [np.empty(0, np.int64)]).astype(np.int16),
            }

        return call

    return map_texts(docs, make, "digest long, d long, text int, seq int, start int, size short", id_col, text_col)


def window_ends(doc: np.ndarray, seq: np.ndarray, size: np.ndarray, least_run: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the shortest windows of consecutive chunks with least_run
    bytes or more, from each chunk on and up to each chunk. Chunks are sorted."""
    n = len(seq)
    at = np.arange(n)
    new = np.ones(n, bool)
    new[1:] = (doc[1:] != doc[:-1]) | (seq[1:] != seq[:-1] + 1)
    heads = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    first, stop = heads[of], np.append(heads[1:], n)[of]
    after = np.cumsum(size)
    before = after - size
    on = np.searchsorted(after, before + least_run)
    up = np.searchsorted(before, after - least_run, side="right") - 1
    good, well = on < stop, up >= first
    both = np.unique(np.concatenate([at[good] * n + on[good], up[well] * n + at[well]]))
    return both // max(1, n), both % max(1, n)


def windows(shared: DataFrame, least_run: int) -> DataFrame:
    """w (hash), d, text, first, last (seq), start, stop (bytes) of the windows of repeated chunks."""
    per = shared.groupBy("d", "text").agg(F.sort_array(F.collect_set(F.struct("seq", "start", "size", "digest"))).alias("c"))
    base = 0x9E3779B97F4A7C15
    back = pow(base, -1, 1 << 64)

    def powers(b: int, n: int) -> np.ndarray:
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                lists = batch.column(2)
                doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                seq, start, size, digest = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
                seq, start, size = seq.astype(np.int64), start.astype(np.int64), size.astype(np.int64)
                i, j = window_ends(doc, seq, size, least_run)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(digest.view(np.uint64) * powers(base, len(seq))[:-1], dtype=np.uint64)])
                w = (sums[j + 1] - sums[i]) * powers(back, len(seq))[i]
                d, text = batch.column(0).to_numpy(zero_copy_only=False)[doc[i]], batch.column(1).to_numpy(zero_copy_only=False)[doc[i]]
                out = (w.view(np.int64), d, text, seq[i].astype(np.int32), seq[j].astype(np.int32), start[i].astype(np.int32), (start[j] + size[j]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["w", "d", "text", "first", "last", "start", "stop"])

    return per.mapInArrow(run, "w long, d long, text int, first int, last int, start int, stop int")


def repeated_windows(
    docs: DataFrame, bits: int = BITS, least: int = LEAST, most: int = MOST, least_run: int = LEAST_RUN,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """d, text, partner, first, last, start, stop, later (whether an earlier document
    holds it) of each window of chunks that another document holds too."""
    every = stash(chunks(docs, bits, least, most, id_col, text_col), "chunks")
    spread = every.groupBy("digest").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi").select("digest")
    found = stash(windows(every.join(spread, "digest"), least_run), "windows")
    ends = found.groupBy("w").agg(F.min("d").alias("lo"), F.max("d").alias("hi")).where("lo < hi")
    return found.join(ends, "w").select(
        "d", "text", F.expr("if(lo = d, hi, lo)").alias("partner"), "first", "last",
        F.col("start").cast("long"), F.col("stop").cast("long"), (F.col("lo") < F.col("d")).alias("later"),
    )


def repeated_documents(docs: DataFrame, **parameters) -> DataFrame:
    """One row per document with a repeated run: doc_id, n_runs, n_chunks, n_bytes,
    removable_bytes (those that an earlier document holds), partner_id (least)."""
    past = Window.partitionBy("d", "text").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    rows = repeated_windows(docs, **parameters).select(
        "*", F.max("stop").over(past).alias("_stop"), F.max("last").over(past).alias("_last"),
        F.max(F.when(F.col("later"), F.col("stop"))).over(past).alias("_later"),
    )
    more = lambda to, since: F.sum(F.expr(f"greatest(0, {to} - {since})")).cast("long")
    per = rows.groupBy("d").agg(
        F.count(F.expr("if(start <= _stop, null, 1)")).alias("n_runs"),
        more("last", "greatest(first - 1, coalesce(_last, -1))").alias("n_chunks"),
        more("stop", "greatest(start, coalesce(_stop, 0))").alias("n_bytes"),
        more("if(later, stop, 0)", "greatest(start, coalesce(_later, 0))").alias("removable_bytes"),
        F.min("partner").alias("partner"),
    )
    as_id = lambda c: f"if({c} <= {-(1 << 62)}, null, {c})"
    return per.select(F.expr(as_id("d")).alias("doc_id"), "n_runs", "n_chunks", "n_bytes", "removable_bytes", F.expr(as_id("partner")).alias("partner_id"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """docs without the byte spans that an earlier document holds; rows and columns stay."""
    spans = repeated_windows(docs, id_col=id_col, text_col=text_col, **parameters).where("later")
    spans = spans.groupBy(F.col("d").alias("_d")).agg(F.sort_array(F.collect_list(F.struct("start", "stop", "text"))).alias("_spans"))
    names, kept = docs.columns, [f"c{k}" for k in range(len(docs.columns))]
    plain = docs.toDF(*kept)
    i, t = kept[names.index(id_col)], kept[names.index(text_col)]
    rows = plain.join(spans, plain[i] == spans["_d"], "left").drop("_d")
    at, sp = rows.columns.index(t), rows.columns.index("_spans")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, found in zip(batch.column(at).to_pylist(), batch.column(sp).to_pylist()):
                if found:
                    raw, parts, last = text.encode(), [], 0
                    own = text_hash(raw)
                    for s in found:
                        if s["text"] != own:
                            continue
                        parts.append(raw[last : max(last, s["start"])])
                        last = max(last, s["stop"])
                    text = b"".join([*parts, raw[last:]]).decode(errors="ignore")
                out.append(text)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(out, type=batch.schema.field(at).type))
            yield batch.select([k for k in range(batch.num_columns) if k != sp])

    return rows.mapInArrow(run, plain.schema).toDF(*names)
