"""Token counts of whole texts by overlap resynchronisation.

A text of more than ``chunk`` characters is encoded in overlapping chunks, each by itself,
with the offsets of its tokens. Two neighbouring chunks are spliced at a position inside
their overlap at which both encodings have a token boundary and which is *proven
stable*: a character that is not white space stands before it and white space after it.
The byte-level pre-tokenizer of the vocabulary has no alternative that crosses such a
place and only looks forward, special strings hold no white space, and merges stay inside
a pre-token; so what stands on either side is encoded as in the whole text. If the two
encodings have no such boundary in common, the overlap is doubled; once it spans the
chunk, the chunk itself is doubled. Shorter texts are one chunk: there is nothing to
splice, and they are encoded whole.

Defined results: null or empty text has 0 bytes and 0 tokens; repeated rows each get
their own result; an empty table gives an empty result; a very long text without white
space is encoded as one chunk in the end.

Stable places also cut each chunk into parts (white space and what follows it up to the
next), which the vocabulary encodes by themselves. Words repeat, so a worker keeps what
the library gave for a bounded number of short parts and has it encode the others.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from skein.llm.common import map_texts

# The white space characters of the pre-tokenizer's regular expressions.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WHITE = re.compile(f"[{WHITE}]")
#: The parts of a text between its stable places: every character is in one of them.
_PARTS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Parts that a worker keeps, and characters of the longest one that it keeps.
KEPT, LONGEST = 1 << 18, 64


def stable(text: str, p: int) -> bool:
    """Whether no pre-token of any encoding can cross position p."""
    return 0 < p < len(text) and not _WHITE.match(text[p - 1]) and bool(_WHITE.match(text[p]))


def splice(text: str, start: int, ends: np.ndarray, begin: int, next_ends: np.ndarray, after: int) -> int | None:
    """A stable boundary behind ``after`` that two chunks, at start and begin, have in
    common, about in the middle of their overlap; ends are the offsets at which their
    tokens end, in the chunk."""
    common = np.intersect1d(ends + start, next_ends + begin)
    common = common[(common > max(after, begin)) & (common < start + ends[-1])].tolist() if len(ends) else []
    middle = len(common) // 2
    nearest = (p for k in range(len(common)) for p in common[middle - k - 1 : middle - k] + common[middle + k : middle + k + 1])
    return next((p for p in nearest if stable(text, p)), None)


def spliced_count(text: str, encode: Callable[[str], np.ndarray], chunk: int, overlap: int) -> tuple[int, int]:
    """(tokens of a text, chunks encoded). ``encode`` gives the end of each token."""
    start, end, done, total, skip, times = 0, min(len(text), chunk), 0, 0, 0, 1
    ends = encode(text[:end])
    while end < len(text):
        wide = overlap
        while True:
            begin = max(start, end - wide)
            stop = min(len(text), max(end + 1, begin + chunk))
            next_ends, times = encode(text[begin:stop]), times + 1
            place = splice(text, start, ends, begin, next_ends, done)
            if place is not None or begin == start:
                break
            wide *= 2
        if place is None:  # no common boundary in the whole chunk: make it longer
            end = min(len(text), end + (end - start))
            ends, times = encode(text[start:end]), times + 1
            continue
        # skip: tokens of the chunk that were counted with the one before
        total += int(np.searchsorted(ends, place - start, "right")) - skip
        skip, done = int(np.searchsorted(next_ends, place - begin, "right")), place
        start, end, ends = begin, stop, next_ends
    return total + len(ends) - skip, times


def _remembered(encode_batch: Callable, measure: Callable) -> Callable[[list[list[str]]], list[list]]:
    """A function that measures the encodings of the parts of texts and keeps what it has measured."""
    kept: dict = {}

    def measured(cut: list[list[str]]) -> list[list]:
        if len(kept) > KEPT:
            kept.clear()
        new = [p for p in set(chain.from_iterable(cut)) if p not in kept]
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            kept.update(zip(some, map(measure, encode_batch(some, add_special_tokens=False))))
        found = [list(map(kept.__getitem__, parts)) for parts in cut]
        for p in new:
            if len(p) > LONGEST:
                del kept[p]
        return found

    return measured


@lru_cache(maxsize=1)  # a worker's next task goes on with it
def _loader(path: str):
    if path.endswith(".json"):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()

        sizes = _remembered(t.encode_batch_fast, len)
        places = _remembered(t.encode_batch, lambda x: tuple(e for _, e in x.offsets))

        def counts(texts: list[str]) -> list[int]:
            return [sum(found) for found in sizes(list(map(_PARTS.findall, texts)))]

        def ends(text: str) -> np.ndarray:
            parts = _PARTS.findall(text)
            (found,) = places([parts])
            lengths, tokens = (np.fromiter(map(len, x), np.int64, len(parts)) for x in (parts, found))
            inner = np.fromiter(chain.from_iterable(found), np.int64, int(tokens.sum()))
            return inner + np.repeat(np.cumsum(lengths) - lengths, tokens)

        return counts, ends
    raise ValueError(f"the stable places are proven for byte-level .json vocabularies only, not {path}")


def count_tokens(
    docs: DataFrame,
    vocabulary: str,
    limit: int = 512,
    chunk: int = 16_384,
    overlap: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) and n_chunks (chunks that
    were encoded) of every row.

    ``vocabulary`` is the name of a file of the installed public tokenizers.
    """

    def make():
        import public_tokenizers

        counts, ends = _loader(public_tokenizers.path(vocabulary))

        def call(ids: list, texts: list[str]) -> dict[str, list]:
            found = [spliced_count(t, ends, chunk, overlap) if len(t) > chunk else None for t in texts]
            short = iter(counts([t for t, f in zip(texts, found) if f is None]))
            found = [f or (next(short), 1) for f in found]
            return {
                "doc_id": ids,
                "n_bytes": [len(t.encode()) for t in texts],
                "n_tokens": [n for n, _ in found],
                "over_limit": [n > limit for n, _ in found],
                "n_chunks": [k for _, k in found],
            }

        return call

    return map_texts(
        docs, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks long",
        id_col, text_col, as_bytes=False,
    )
