"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the windows of ``window`` consecutive words of each benchmark item (an
item of fewer words is one shorter window). Patterns of one length form a table:

* SHIFT: for each block of two words that stands in a pattern, how far its last place
  is from the pattern's end; any other block lets the scan jump length - 1 words;
* buckets: where the shift is 0, the block (the pattern's suffix) selects a bucket,
  the two words before the window's other end select in it, and
* the words of the window are compared with the pattern itself.

The benchmark goes to the driver and the tasks one block of a bounded number of words at
a time; each block is scanned over all documents. A benchmark of one block takes one scan
and no shuffle; with more, each scan's hits are stored and then merged by document, so a
benchmark of any size takes the memory of one block (an item longer than a block is cut
into blocks that overlap by a window).

Defined results: null, empty or word-free texts have no words and no hits; items
without words have no window; hits of an item without id count as hit words, but the
item isn't listed; repeated items of one id count as one item; empty benchmark: no
hits. Repeated documents each get their own row; very long texts are searched whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import change_rows, folded_words, map_texts, stash

#: Most words of benchmark text in one broadcast block: some 20 MB as Python objects.
BLOCK_WORDS = 100_000


class WuManber:
    """Finds all windows of a set of items in a list of words."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int):
        patterns: dict[int, dict[tuple, set]] = {}
        for name, words in items:
            size = min(window, len(words))
            for s in range(len(words) - size + 1 if size else 0):
                patterns.setdefault(size, {}).setdefault(tuple(words[s : s + size]), set()).add(name)
        self.tables = [self._table(size, found) for size, found in sorted(patterns.items())]

    @staticmethod
    def _table(size: int, patterns: dict[tuple, set]) -> tuple:
        block = min(2, size)
        shift: dict[tuple, int] = {}
        buckets: dict[tuple, dict[tuple, list]] = {}
        for words, names in patterns.items():
            for end in range(block, size + 1):
                key = words[end - block : end]
                shift[key] = min(shift.get(key, size), size - end)
            buckets.setdefault(words[-block:], {}).setdefault(words[:block], []).append((list(words), names))
        return size, block, size - block + 1, shift, buckets

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, set]]:
        """(start, end, item ids) of each place of each pattern."""
        n = len(words)
        for size, block, jump, shift, buckets in self.tables:
            at, get = size, shift.get
            while at <= n:
                key = tuple(words[at - block : at])
                far = get(key, jump)
                if far:
                    at += far
                    continue
                start = at - size
                for pattern, names in buckets[key].get(tuple(words[start : start + block]), ()):
                    if words[start:at] == pattern:
                        yield start, at, names
                at += 1


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, most: int = BLOCK_WORDS) -> Iterator[list]:
    """The benchmark's (id, words), in blocks of a bounded number of words; one at least."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    block, size, given = [], 0, False
    for row in rows.toLocalIterator():
        words = folded_words((row.t or "").encode())
        for start in range(0, max(1, len(words) - window + 1), most):
            part = words[start : start + most + window - 1]
            if block and size + len(part) > most:
                yield block
                block, size, given = [], 0, True
            if part:
                block.append((row.i, part))
                size += len(part)
    if block or not given:
        yield block


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places as spans that don't touch, sorted."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def digest_columns(n_words: list[int], spans: list, names: list[set]) -> dict[str, list]:
    hits = [sum(e - s for s, e in merged(x)) for x in spans]
    listed = [",".join(sorted(x for x in n if x is not None)) for n in names]
    return {
        "n_words": n_words, "n_hit": hits, "n_items": [len(n - {None}) for n in names],
        "items_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in listed], "contaminated": [h > 0 for h in hits], "item_ids": listed,
    }


_RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids string"


def search(words: list[bytes], engine: WuManber) -> tuple[list, set]:
    spans, names = [], set()
    for start, end, found in engine.find(words):
        spans.append((start, end))
        names |= found
    return spans, names


def text_key(text: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) >> 1


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256,
    contaminated, item_ids (sorted as strings, comma-joined)."""
    context = docs.sparkSession.sparkContext
    blocks = item_blocks(benchmark, item_id_col, item_text_col, window, block_words)
    first, second = next(blocks), next(blocks, None)

    if second is None:
        shared = context.broadcast(first)

        def make():
            engine = WuManber(shared.value, window)

            def call(ids: list, texts: list[bytes]) -> dict[str, list]:
                words = list(map(folded_words, texts))
                found = [search(w, engine) for w in words]
                return {"doc_id": ids, **digest_columns(list(map(len, words)), [s for s, _ in found], [n for _, n in found])}

            return call

        return map_texts(docs, make, _RESULT, id_col, text_col)

    def hits(block: list) -> DataFrame:
        """key (of the text), spans (flat starts and ends), names of the texts that the block hits."""
        shared = context.broadcast(block)

        def make():
            engine = WuManber(shared.value, window)

            def call(ids: list, texts: list[bytes]) -> dict[str, list]:
                out = {"key": [], "spans": [], "names": []}
                for text in texts:
                    spans, names = search(folded_words(text), engine)
                    if spans:
                        out["key"].append(text_key(text))
                        out["spans"].append([x for span in merged(spans) for x in span])
                        out["names"].append(list(names))
                return out

            return call

        found = stash(map_texts(docs, make, "key long, spans array<long>, names array<string>", id_col, text_col), "hits")
        shared.destroy()
        return found

    found = hits(first)
    for block in chain([second], blocks):
        found = found.unionByName(hits(block))
    # a text stands in as many rows as there are blocks that hit it and copies of it in their tasks
    found = found.groupBy("key").agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("names"))).alias("names"))

    def counted():
        def call(ids: list, texts: list[bytes]) -> dict[str, list]:
            return {"doc_id": ids, "n_words": [len(folded_words(t)) for t in texts], "key": list(map(text_key, texts))}

        return call

    rows = map_texts(docs, counted, "doc_id long, n_words long, key long", id_col, text_col).join(found, "key", "left")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, n_words, spans, names = (c.to_pylist() for c in batch.columns)
            pairs = [list(zip(x[::2], x[1::2])) if x else [] for x in spans]
            out = {"doc_id": ids, **digest_columns(n_words, pairs, [set(x or ()) for x in names])}
            yield pa.RecordBatch.from_pydict(out)

    return rows.select("doc_id", "n_words", "spans", "names").mapInArrow(run, _RESULT)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """The rows of docs without any occurrence of a benchmark window; all columns stay.
    A benchmark of several blocks takes a stored pass for each but the last."""
    context = docs.sparkSession.sparkContext

    def without(rows: DataFrame, block: list) -> DataFrame:
        shared = context.broadcast(block)

        def make():
            engine = WuManber(shared.value, window)
            return lambda texts: ([next(engine.find(folded_words(t.encode())), None) is None for t in texts], None)

        return change_rows(rows, make, text_col)

    blocks = item_blocks(benchmark, item_id_col, item_text_col, window, block_words)
    block = next(blocks)
    for after in blocks:
        docs, block = stash(without(docs, block), "clean"), after
    return without(docs, block)
