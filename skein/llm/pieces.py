"""SentencePiece encoding by forward filtering and backward sampling, and decoding.

A text is cut at places that no piece of the vocabulary crosses: before a run of word
marks (blanks become the mark U+2581) and around line feeds and characters without a
piece. Within such a segment the lattice of pieces is filtered forward once: the mass
of a place is the sum over the pieces that end there. A segmentation is then sampled
backward from the end, each piece with its share of the mass; this draws from the
exact distribution, in which a segmentation weighs the product of its pieces' weights.
The weight of a piece of rank r in the vocabulary is (r + 2) ** -alpha.

The texts of a batch are handled together: equal segments are filtered once, and all
occurrences are sampled side by side. A draw depends on the row's key and the place in
the text alone, so a row gets the same pieces on any cluster, in any order.

Characters without a piece, and the mark itself, are encoded as byte pieces, so
decoding gives back exactly the text.

Defined results: null or empty text gives no pieces; a null id seeds by the text;
repeated rows get equal pieces.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from skein.llm.common import map_texts

MARK = "▁"


class _Mark:
    """The mark as a character of the text: a segment of its own, without a piece."""

    def __len__(self) -> int:
        return 1

    def __getitem__(self, k) -> str:
        return ""

    def encode(self) -> bytes:
        return MARK.encode()


class _Numbers(dict):
    """Numbers keys in the order in which they come."""

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        return n


NOT_BLANK = _Mark()


class Pieces:
    """The vocabulary: weights, ids, and the cut into segments."""

    def __init__(self, model_file: str, alpha: float):
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=model_file)
        size = m.get_piece_size()
        self.text: list[str] = [""] * size
        self.byte_ids: list[int] = [0] * 256
        self.raw: list[int] = [-1] * size
        self.weight: dict[str, tuple[float, int]] = {}
        normal = []
        for i in range(size):
            if m.is_byte(i):
                value = int(m.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], self.raw[i] = i, value
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                self.text[i] = m.id_to_piece(i)
                normal.append((-m.get_score(i), i))
        for rank, (_, i) in enumerate(sorted(normal)):
            self.weight[self.text[i]] = ((rank + 2.0) ** -alpha, i)
        if any(re.search(f"[^{MARK}]{MARK}", p) or "\n" in p for p in self.weight):
            raise ValueError("a piece of this vocabulary crosses a place at which segments are cut")
        self.longest = max(map(len, self.weight))
        known = "".join(sorted(p for p in self.weight if len(p) == 1 and p not in (MARK, "\n")))
        k = re.escape(known)
        self.segment = re.compile(f"{MARK}*[{k}]+|{MARK}+|[^{k}{MARK}]+")

    def cut(self, text: str) -> list[str]:
        """The segments; a mark that stands in the text itself comes as NOT_BLANK."""
        if MARK not in text:
            return self.segment.findall(text.replace(" ", MARK))
        found = []
        for block in re.split(f"({MARK}+)", text):
            if block.startswith(MARK):
                found += [NOT_BLANK] * len(block)
            else:
                found += self.segment.findall(block.replace(" ", MARK))
        return found

    def table(self, segment: str) -> list:
        """For each end in a segment: (shares summed up but the last, starts, ids)."""
        n, get, longest = len(segment), self.weight.get, self.longest
        mass, out = [1.0] + [0.0] * n, [None] * (n + 1)
        for end in range(1, n + 1):
            total, sums, starts, ids = 0.0, [], [], []
            for start in range(max(0, end - longest), end):
                found = get(segment[start:end])
                if found and mass[start]:
                    total += mass[start] * found[0]
                    sums.append(total)
                    starts.append(start)
                    ids.append(found[1])
            mass[end] = total
            if len(ids) > 1:
                out[end] = ([s / total for s in sums[:-1]], starts, ids)
            elif ids:
                out[end] = (None, starts[0], ids[0])
            if total < 1e-200:  # keep long segments in range: only ratios matter
                for j in range(max(0, end - longest), end + 1):
                    mass[j] *= 1e200
        return out


def uniform(seed: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on a row's seed and a place in its text alone."""
    x = seed + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Prefixes:
    """All prefixes of the pieces in a hash table: finds the pieces at many places at once."""

    SLOTS = 20

    def __init__(self, pieces: Pieces):
        chars = sorted({c for p in pieces.weight for c in p})
        self.code = np.zeros(0x110000, np.uint64)
        for k, c in enumerate(chars, 1):
            self.code[ord(c)] = k
        ids: dict[int, int] = {}
        for piece, (_, i) in pieces.weight.items():
            h = 0
            for k, c in enumerate(piece):
                h = (h * 0x9E3779B97F4A7C15 + int(self.code[ord(c)])) & (1 << 64) - 1
                ids[h] = i if k == len(piece) - 1 else ids.get(h, 0)
        keys, found = np.array(list(ids), np.uint64), np.array(list(ids.values()), np.int32)
        self.tables = []
        while len(keys):  # what finds its slot taken goes to the next, smaller table
            bits = self.SLOTS if not self.tables else 14
            key, value = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
            slot = keys * np.uint64(0xD6E8FEB86659FD93 + 2 * len(self.tables)) >> np.uint64(64 - bits)
            _, first = np.unique(slot, return_index=True)
            key[slot[first]], value[slot[first]] = keys[first], found[first]
            self.tables.append((np.uint64(64 - bits), np.uint64(0xD6E8FEB86659FD93 + 2 * len(self.tables)), key, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, found = keys[rest], found[rest]

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a prefix, id of the piece or 0) of each hash."""
        there, ids = np.zeros(len(h), bool), np.zeros(len(h), np.int32)
        for shift, factor, key, value in self.tables:
            slot = h * factor >> shift
            hit = key[slot] == h
            there |= hit
            ids = np.where(hit, value[slot], ids)
        return there, ids

    def arcs(self, codes: np.ndarray, room: np.ndarray, longest: int) -> np.ndarray:
        """[length - 1, place]: id of the piece of this length that starts at the place, or 0."""
        out = np.zeros((longest, len(codes)), np.int32)
        alive, h = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        for k in range(longest):
            if k:
                inside = room[alive] > k
                alive, h = alive[inside], h[inside]
            if not len(alive):
                break
            h = h * np.uint64(0x9E3779B97F4A7C15) + codes[alive + k]
            there, ids = self.look_up(h)
            alive, h, ids = alive[there], h[there], ids[there]
            out[k, alive] = ids
        return out


class Sampler:
    """Samples segmentations of many texts at once, each distinct segment filtered once."""

    def __init__(self, pieces: Pieces, alpha: float):
        self.pieces, self.prefixes = pieces, Prefixes(pieces)
        self.short = max(1, int(64 / max(alpha, 1.0)))  # so long a segment's mass can't underflow
        self.w = np.zeros(len(pieces.text))
        for w, i in pieces.weight.values():
            self.w[i] = w
        self.raw = np.array(pieces.raw)
        self.plain = [t.replace(MARK, " ") for t in pieces.text]

    def _one(self, segment: str, seed: np.uint64, place: int) -> list[int]:
        """A long segment, or characters without a piece."""
        p = self.pieces
        if segment[-1] not in p.weight:
            return [p.byte_ids[b] for b in segment.encode()]
        table, end, out = p.table(segment), len(segment), []
        draws = uniform(np.full(end + 1, seed), place + np.arange(end + 1))
        while end:
            shares, starts, found = table[end]
            k = 0 if shares is None else bisect(shares, draws[end])
            out.append(found if shares is None else found[k])
            end = starts if shares is None else starts[k]
        return out[::-1]

    def encode(self, texts: list[str], seeds: list[int]) -> list[np.ndarray]:
        """Piece ids of each text."""
        p, number = self.pieces, _Numbers()
        which, counts = [], []
        for text in texts:
            found = p.cut(text)
            counts.append(len(found))
            which += map(number.__getitem__, found)
        segments = list(number)
        which, counts = np.array(which, np.int64), np.array(counts, np.int64)
        lengths = np.array(list(map(len, segments)), np.int64)
        fast = np.array([n <= self.short and x[-1] in p.weight for x, n in zip(segments, lengths.tolist())], bool)
        doc = np.repeat(np.arange(len(texts)), counts)
        seeds = np.array(seeds, np.uint64)[doc]
        sizes = lengths[which]
        chars = np.concatenate([[0], np.cumsum(sizes)])
        first = np.cumsum(counts) - counts
        places = chars[:-1] - chars[first[doc]]
        odd = {k: self._one(segments[which[k]], seeds[k], int(places[k])) for k in np.flatnonzero(~fast[which]).tolist()}
        for k, found in odd.items():
            sizes[k] = len(found)
        new = np.cumsum(fast) - 1  # numbers among the fast ones
        which = np.where(fast[which], new[which], -1)
        ids = self._sample([x for x, f in zip(segments, fast) if f], which, sizes, seeds, places, odd)
        slots = np.concatenate([[0], np.cumsum(sizes)])
        filled = np.concatenate([[0], np.cumsum(ids > 0)])[slots[np.concatenate([first, [len(which)]])]]
        ids = ids[ids > 0]
        return [ids[a:b] for a, b in zip(filled[:-1], filled[1:])]

    def _sample(self, segments, which, sizes, seeds, places, odd) -> np.ndarray:
        """Slots of all characters (or bytes), with the ids of the pieces that start there, else 0."""
        begin = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.int32)
        for k, found in odd.items():
            out[begin[k] : begin[k] + len(found)] = found
        if not segments:
            return out
        lengths = np.array(list(map(len, segments)), np.int64)
        at = np.cumsum(lengths) - lengths
        codes = self.prefixes.code[np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32)]
        room = np.repeat(at + lengths, lengths) - np.arange(len(codes))
        arcs = self.prefixes.arcs(codes, room, self.pieces.longest)

        order = np.argsort(-lengths, kind="stable")
        a, m = at[order], (at + np.arange(len(at)))[order]  # first character, first place of the mass
        count = len(order) - np.searchsorted(np.sort(lengths), np.arange(lengths.max() + 2))
        mass = np.zeros(len(codes) + len(at))
        mass[m] = 1.0
        for end in range(1, int(lengths.max()) + 1):
            k = int(count[end])
            total = np.zeros(k)
            for n in range(1, min(end, len(arcs)) + 1):
                total += self.w[arcs[n - 1, a[:k] + end - n]] * mass[m[:k] + end - n]
            mass[m[:k] + end] = total

        room_back = np.arange(len(mass)) - np.repeat(at + np.arange(len(at)), lengths + 1)  # characters before each place

        live = np.flatnonzero(which >= 0)
        base, shift = at[which[live]], which[live]
        end = lengths[shift]
        while len(live):
            target = uniform(seeds[live], places[live] + end) * mass[base + shift + end]
            step = np.zeros(len(live), np.int64)
            todo, left, at, to = np.arange(len(live)), target, base + end, shift
            for n in range(1, len(arcs) + 1):
                ids = arcs[n - 1].take(at - n)
                got = self.w.take(ids) * mass.take(at + to - n)
                hit = ids > 0
                step[todo[hit]] = n  # the last arc stays, should rounding pass them all
                left = left - got
                on = (left >= 0) & (room_back.take(at + to) > n)
                if not on.all():
                    todo, left, at, to = todo[on], left[on], at[on], to[on]
                if not len(todo):
                    break
            end = end - step
            out[begin[live] + end] = arcs[step - 1, base + end]
            more = end > 0
            live, base, shift, end = live[more], base[more], shift[more], end[more]
        return out

    def decode(self, ids: np.ndarray) -> str:
        if not (self.raw[ids] >= 0).any():
            return "".join(map(self.plain.__getitem__, ids.tolist()))
        out, held = [], bytearray()
        for i in ids.tolist():
            if self.pieces.raw[i] >= 0:
                held.append(self.pieces.raw[i])
                continue
            if held:
                out.append(held.decode())
                held.clear()
            out.append(self.plain[i])
        return "".join([*out, held.decode()])


@lru_cache(maxsize=2)
def sampler(vocabulary: str, alpha: float) -> Sampler:
    """One a worker process."""
    import public_tokenizers

    return Sampler(Pieces(public_tokenizers.path(vocabulary), alpha), alpha)


def row_seed(key, text: str, seed: int) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(str(key) if key is not None else "text:" + text, seed)


def encode_documents(
    docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", alpha: float = 1.0, seed: int = 0, with_ids: bool = True,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, pieces (ids, unless with_ids is off), n_pieces, pieces_sha256 (of the ids as
    32-bit little-endian numbers) and lossless (decoding gave the text) of every row."""

    def make():
        s = sampler(vocabulary, alpha)

        def call(ids: list, texts: list[str]) -> dict[str, list]:
            got = []
            for k in range(0, len(texts), 400):  # some 1.5 million characters of usual texts
                part = texts[k : k + 400]
                got += s.encode(part, [row_seed(i, t, seed) for i, t in zip(ids[k : k + 400], part)])
            return {
                "doc_id": ids,
                "pieces": got if with_ids else [None] * len(got),
                "n_pieces": list(map(len, got)),
                "pieces_sha256": [hashlib.sha256(g.astype("<i4").tobytes()).hexdigest() for g in got],
                "lossless": [s.decode(g) == t for g, t in zip(got, texts)],
            }

        return call

    out = map_texts(
        docs, make, "doc_id long, pieces array<int>, n_pieces long, pieces_sha256 string, lossless boolean", id_col, text_col, as_bytes=False
    )
    return out if with_ids else out.drop("pieces")


def decode_pieces(
    coded: DataFrame, vocabulary: str = "piece_bpe_32k.model", id_col: str = "doc_id", pieces_col: str = "pieces"
) -> DataFrame:
    """doc_id and text of rows of piece ids; null pieces give a null text."""

    def run(batches):
        import pyarrow as pa

        s = sampler(vocabulary, 1.0)
        for batch in batches:
            texts = [None if p is None else s.decode(np.array(p, np.int64)) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    from pyspark.sql import functions as F

    rows = coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(pieces_col).cast("array<int>").alias("p"))
    return rows.mapInArrow(run, "doc_id long, text string")
