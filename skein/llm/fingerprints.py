"""Document fingerprints: one-permutation MinHash, in DataFrame functions only.

Each shingle (``width`` consecutive words; a shorter text is one shingle as a whole) is
hashed once. The top bits of the hash name one of ``BINS`` bins, and a bin keeps its least
hash. Bins without a shingle are filled by optimal densification: each takes the value of
the first bin with a shingle in an order of all bins that is its own, drawn by a hash of
the two bins and the same for all texts. Of each value the four lowest bits are stored, one
hexadecimal digit a bin. Two fingerprints of texts with likeness J agree in a bin with
chance J + (1 - J) / 16, so ``likeness`` takes the share of chance agreement off.

A text meets the text of its neighbour in one shuffle: a narrow pass ranges (id, hash of
the text) into blocks and keeps the first row of each (``MOST_BLOCKS`` at most, whatever
the size of the table); a row finds its block by a binary search in these, and the first
row of a block is also sent to the block before, where it closes the last row's gap.

Defined results: a null text is empty; a text without words has the empty fingerprint,
which is like itself (1) and unlike any other (0). Repeated ids are ordered by the hash of
their text; a null id comes last. Equal rows are each other's neighbours. Texts of any
length are taken whole. An empty table gives no rows. Columns other than the two named
ones are not read, so their names don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, BITS = 128, 4
#: Rows of a block, until there are MOST_BLOCKS of them.
BLOCK_ROWS, MOST_BLOCKS = 256, 1 << 16
_SPACE = " \t\n\x0b\f\r"
_NONE = -(1 << 63)


def words_of(text: Column) -> Column:
    """The words of a text; none: an empty array."""
    inner = F.btrim(text, F.lit(_SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[\\x20\\x09-\\x0D]+"))


def shingle_hashes(words: Column, width: int = 5) -> Column:
    """The hashes of all shingles in order, of the array of the words' hashes."""
    from_here = F.transform(words, lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, width))))
    return F.slice(from_here, F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(1)))


def _bin(h: Column, bins: int) -> Column:
    """The bin of a hash, in the order of sorted hashes."""
    return (F.shiftright(h, 64 - (bins.bit_length() - 1)) + bins // 2).cast("int")


def least_of_bins(hashes: Column, bins: int = BINS) -> Column:
    """Of sorted hashes, the least of each bin that has any."""
    return F.filter(hashes, lambda h, i: (i == 0) | (_bin(h, bins) != _bin(F.get(hashes, i - 1), bins)))


def spread(least: Column, filled: Column) -> Column:
    """The values at the places of their bins, null in the bins before and between them."""
    gap = lambda i: F.get(filled, i) - F.coalesce(F.get(filled, i - 1), F.lit(-1)) - 1
    return F.flatten(F.transform(least, lambda h, i: F.concat(F.array_repeat(F.lit(None).cast("long"), gap(i)), F.array(h))))


def packed(values: Column, filled: Column, bins: int = BINS) -> Column:
    """The stored digits: empty bins take the value of the first filled bin in their own order
    (by hash, with the bin's number in its lowest bits); then the lowest bits of each value."""

    def drawn(k: Column) -> Column:
        turns = F.transform(filled, lambda b: F.xxhash64(k, b).bitwiseAND(F.lit(-bins)).bitwiseOR(b.cast("long")))
        return F.array_min(turns).bitwiseAND(F.lit(bins - 1)).cast("int")

    digits = F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda k: F.hex(F.coalesce(F.get(values, k), F.get(values, drawn(k))).bitwiseAND(F.lit((1 << BITS) - 1))),
    )
    return F.when(F.size(filled) == 0, "").otherwise(F.lower(F.array_join(digits, "")))


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """The estimated Jaccard likeness of two fingerprints, 0 to 1, corrected for the bits left
    off: eight digits at a time are numbers, whose unequal digits are counted as bits."""

    def unequal(at: int) -> Column:
        x, y = (F.conv(F.substring(f, at, 8), 16, 10).cast("long") for f in (a, b))
        bits = x.bitwiseXOR(y)
        for shift in (2, 1):
            bits = bits.bitwiseOR(F.shiftright(bits, shift))
        return F.bit_count(bits.bitwiseAND(F.lit(0x11111111)))

    chance = 2.0**-BITS
    same = 1 - sum((unequal(at) for at in range(1, bins, 8)), F.lit(0)) / F.lit(float(bins))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def with_fingerprint(df: DataFrame, text: str, name: str, width: int = 5) -> DataFrame:
    """df with the fingerprint of a text column, one step a projection so that each is computed once.

    The last step is a generator of one row: filters on the fingerprint stop there, as their
    conditions would grow manifold on their way through the steps."""
    w, h, v, b = (f"__{x}_{name}" for x in "whvb")
    df = df.withColumn(w, F.transform(words_of(F.col(text)), lambda x: F.xxhash64(x)))
    df = df.withColumn(h, F.sort_array(shingle_hashes(F.col(w), width))).drop(w)
    df = df.withColumn(v, least_of_bins(F.col(h))).drop(h)
    df = df.withColumn(b, F.transform(v, lambda x: _bin(x, BINS)))
    df = df.withColumn(v, spread(F.col(v), F.col(b)))
    return df.withColumn(name, F.explode(F.array(packed(F.col(v), F.col(b))))).drop(v, b)


def _blocks(rows: DataFrame) -> tuple[list[int], list[int]]:
    """(ids, hashes) of the first rows of all blocks, in descending order of ids."""
    count = rows.count()
    blocks = min(MOST_BLOCKS, max(1, math.ceil(count / BLOCK_ROWS)))
    ranged = rows.select("__d", "__h").repartitionByRange(blocks, F.col("__d").desc(), F.col("__h"))
    firsts = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(F.bitwise_not("__d").alias("d"), F.col("__h").alias("h"))).alias("k"))
    found = sorted((r["d"], r["h"]) for r in firsts.select("k.d", "k.h").collect())
    return [~d for d, _ in found], [h for _, h in found]


def next_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(doc_id, text, next_text) and, for each column that ``more`` adds, its own and the next row's value.

    Next is in descending order of ids, then of the text's hash ascending; the last row's
    next is the first. The rows of a block are gathered once and sorted there."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"__d": F.coalesce("doc_id", F.lit(_NONE)), "__h": F.xxhash64("text")})
    ids, hashes = _blocks(rows)
    n, plain = len(ids), rows.columns
    rows = more(rows) if more else rows
    added = [c for c in rows.columns if c not in plain]
    if not n:
        return rows.withColumn("next_text", F.col("text")).select("doc_id", "text", "next_text", *added, *(F.col(m).alias(f"next_{m}") for m in added))
    known_ids, known_hashes = F.lit(np.array(ids, dtype=np.int64)), F.lit(np.array(hashes, dtype=np.int64))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length()))))

    def forward(at: Column, step: Column) -> Column:
        d, h = F.get(known_ids, at + step - 1), F.get(known_hashes, at + step - 1)
        return F.when((d > F.col("__d")) | ((d == F.col("__d")) & (h <= F.col("__h"))), at + step).otherwise(at)

    rows = rows.withColumn("__b", F.aggregate(steps, F.lit(0), forward) - 1)
    first = (F.get(known_ids, F.col("__b")) == F.col("__d")) & (F.get(known_hashes, F.col("__b")) == F.col("__h"))
    own = F.struct(F.col("__b").alias("b"), F.lit(False).alias("sent"))
    before = F.struct(((F.col("__b") + (n - 1)) % n).alias("b"), F.lit(True).alias("sent"))
    rows = rows.withColumn("__to", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own))))
    rows = rows.select("doc_id", "text", *added, "__d", "__h", F.col("__to.b").alias("__b"), F.col("__to.sent").alias("__sent"))
    line = Window.partitionBy("__b").orderBy("__sent", F.col("__d").desc(), "__h")
    seen = rows.withColumns({"next_text": F.lead("text").over(line), **{f"next_{m}": F.lead(m).over(line) for m in added}})
    return seen.where(~F.col("__sent")).select("doc_id", "text", "next_text", *added, *(f"next_{m}" for m in added))


def fingerprint_documents(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of the code points (rounded down) replaced by the
    first as many of the next document, or by all that it has."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    pairs = next_texts(narrow, more=lambda rows: with_fingerprint(rows, "text", "fingerprint", width))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half))
    pairs = pairs.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited).drop("text", "next_text")
    both = with_fingerprint(pairs, "edited", "edited_fingerprint", width)
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
