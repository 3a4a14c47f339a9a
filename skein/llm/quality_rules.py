"""Quality rules: word statistics and bands of the zstandard ratio.

The ratio is bytes / compressed bytes, of the whole text and of chunks of a fixed
number of bytes. Repetitive text compresses too well, random or encoded text hardly
at all; both lie outside the band of the text's length. Short texts compress badly
whatever they hold, so bands depend on the length.

Defined results: null or empty text has no words, fails the base rules and isn't kept;
repeated rows each get their own result.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame

from skein.llm.common import map_texts, plain_words

#: (length in bytes below which the band holds, lowest and highest ratio of the whole text).
BANDS = [(256, 0.5, 6.0), (1024, 1.05, 8.0), (8192, 1.2, 12.0), (1 << 62, 1.2, 16.0)]
#: Band of each chunk, and the share of chunks that may lie outside.
CHUNK_BYTES, CHUNK_BAND, CHUNK_SHARE = 4096, (1.1, 14.0), 0.34
_SYMBOLS = re.compile(rb"[#*$%&|<>]")


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in 3-word windows found twice or more, the first included."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n:
        return 0
    counts, covered, reach = Counter(windows), 0, 0
    for start, w in enumerate(windows):
        if counts[w] > 1:
            covered += start + 3 - max(start, reach)
            reach = start + 3
    return covered


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def within_bands(
    text: bytes, compress, bands=BANDS, chunk: int = CHUNK_BYTES, chunk_band=CHUNK_BAND, share: float = CHUNK_SHARE
) -> tuple[float, int, bool]:
    """(ratio of the whole text, chunks outside their band, verdict)."""
    if not text:
        return 0.0, 0, False
    ratio = len(text) / len(compress(text))
    low, high = next((lo, hi) for most, lo, hi in bands if len(text) < most)
    full = range(0, len(text) - chunk + 1, chunk)
    outside = 0
    if len(full) > 1:  # a text of one chunk has been judged as a whole
        ratios = [chunk / len(compress(text[s : s + chunk])) for s in full]
        outside = sum(not chunk_band[0] <= r <= chunk_band[1] for r in ratios)
    return ratio, outside, low <= ratio <= high and outside <= share * max(1, len(full))


def quality_rules(
    docs: DataFrame, level: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, ratio, n_chunks_outside."""

    def make():
        import zstandard

        compress = zstandard.ZstdCompressor(level=level).compress

        def one(text: bytes) -> tuple:
            words = plain_words(text)
            n, repeats = len(words), repeated_words(words)
            failed = n < 50 or 100 * repeats > 50 * n
            ratio, outside, fine = within_bands(text, compress)
            return (
                n, len(b"".join(words).decode(errors="replace")), len(_SYMBOLS.findall(text)),
                duplicate_lines(text), repeats, failed, fine and not failed, ratio, outside,
            )

        def call(ids: list, texts: list[bytes]) -> dict[str, list]:
            cols = list(zip(*map(one, texts))) or [()] * 9
            out = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_chunks_outside")
            return {"doc_id": ids, **{n: list(c) for n, c in zip(out, cols)}}

        return call

    return map_texts(
        docs, make,
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks_outside long",
        id_col, text_col,
    )
