"""License scan: places of base phrases, and an exact set-similarity join.

Text blocks are joined with license templates by containment: |template words in the
block| / |template words| >= threshold, all sets of distinct words. The blocks of a
template are all runs of ``reach`` times as many words as it has, at every place of
the text and over line ends: a wrapped notice is seen whole, and words scattered over
a long text don't add up.

The words of the templates are ordered by their document frequency over the whole
corpus, rarest first. With t = ceil(threshold * |T|) needed words,

* prefix filter: a text with such a block holds one of the first |T| - t + 1 words of T;
* length filter: it has at least t distinct words;
* positional filter: if the first shared word stands at place i of T, at most
  |T| - i words can be shared.

What passes is verified exactly, block by block, so every qualifying block is found. The frequencies
come from one pass that counts only template words, a bounded set; the templates are
a fixed parameter and so may be broadcast.

Defined results: null, empty or word-free text has no words, labels '' and score 0;
repeated rows each get their own result; ties between templates report all labels; an
empty table gives an empty result; very long texts are scanned whole.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import folded_words, map_texts

# Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices by which a license is usually declared, and texts of short licenses, with labels.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("""permission is hereby granted free of charge to any person obtaining a copy of this software and associated
    documentation files the software to deal in the software without restriction including without limitation the rights to
    use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
    software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
    shall be included in all copies or substantial portions of the software the software is provided as is without warranty
    of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular
    purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other
    liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or
    the use or other dealings in the software""", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("you may not use this file except in compliance with the license", "apache"),
    ("""licensed under the apache license version 2 0 the license you may not use this file except in compliance with the
    license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable
    law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties
    or conditions of any kind either express or implied see the license for the specific language governing permissions and
    limitations under the license""", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("distributed under the terms of the gnu general public license", "gpl"),
    ("""this program is free software you can redistribute it and or modify it under the terms of the gnu general public
    license as published by the free software foundation either version 3 of the license or at your option any later version
    this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty
    of merchantability or fitness for a particular purpose see the gnu general public license for more details you should
    have received a copy of the gnu general public license along with this program""", "gpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("""redistribution and use in source and binary forms with or without modification are permitted provided that the
    following conditions are met redistributions of source code must retain the above copyright notice this list of
    conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this
    list of conditions and the following disclaimer in the documentation and or other materials provided with the
    distribution this software is provided by the copyright holders and contributors as is and any express or implied
    warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose
    are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental
    special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss
    of use data or profits or business interruption however caused and on any theory of liability whether in contract strict
    liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of
    the possibility of such damage""", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("""this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
    distributed with this file you can obtain one at http mozilla org mpl 2 0""", "mpl"),
    ("this work is licensed under a creative commons attribution license", "cc-by"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("""permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
    provided that the above copyright notice and this permission notice appear in all copies the software is provided as is
    and the author disclaims all warranties with regard to this software including all implied warranties of merchantability
    and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages
    whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action
    arising out of or in connection with the use or performance of this software""", "isc"),
    ("""this software is provided as is without any express or implied warranty in no event will the authors be held liable
    for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose
    including commercial applications and to alter it and redistribute it freely subject to the following restrictions the
    origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this
    software in a product an acknowledgment in the product documentation would be appreciated but is not required altered
    source versions must be plainly marked as such and must not be misrepresented as being the original software this notice
    may not be removed or altered from any source distribution""", "zlib"),
]


def template_sets(templates: list[tuple[str, str]]) -> list[tuple[frozenset, str]]:
    return [(frozenset(folded_words(text.encode())), label) for text, label in templates]


def word_frequencies(docs: DataFrame, vocabulary: frozenset, text_col: str = "text") -> DataFrame:
    """word, n: how many texts hold each word of a bounded vocabulary."""

    def make():
        counts = dict.fromkeys(vocabulary, 0)

        def call(ids: list, texts: list[bytes]) -> dict[str, list]:
            for text in texts:
                for word in vocabulary.intersection(folded_words(text)):
                    counts[word] += 1
            return {"word": [], "n": []}

        call.finish = lambda: [{"word": list(counts), "n": list(counts.values())}]
        return call

    found = map_texts(docs, make, "word binary, n long", text_col, text_col)
    return found.groupBy("word").agg(F.sum("n").alias("n"))


class Matcher:
    """Joins the blocks of a text with the templates."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float, reach: float):
        self.sides = []
        for (text, _), (words, label) in zip(templates, template_sets(templates)):
            order = sorted(words, key=lambda w: (frequency.get(w, 0), w))
            need = math.ceil(threshold * len(order) - 1e-9)
            self.sides.append((order, words, need, label, int(reach * len(folded_words(text.encode())))))
        self.by_prefix: dict[bytes, list[tuple[int, int]]] = {}
        for k, (order, _, need, _, _) in enumerate(self.sides):
            for place, word in enumerate(order[: len(order) - need + 1]):
                self.by_prefix.setdefault(word, []).append((place, k))
        self.starts = frozenset(self.by_prefix)

    def blocks(self, words: list[bytes], have: set) -> list[tuple[str, float]]:
        """(label, highest containment) of each template, once for each of its places:
        qualifying blocks that don't overlap, each taken as early as possible."""
        found = []
        first: dict[int, int] = {}
        for word in self.starts.intersection(have):
            for place, k in self.by_prefix[word]:
                first[k] = min(place, first.get(k, place))
        for k, place in first.items():
            order, whole, need, label, width = self.sides[k]
            if len(have) >= need and len(order) - place >= need and len(whole & have) >= need:
                hits = [(p, w) for p, w in enumerate(words) if w in whole]
                most, _ = shared_words(hits, width, len(order) + 1)
                if most >= need:
                    found += [(label, most / len(order))] * shared_words(hits, width, need)[1]
        return found


def shared_words(hits: list[tuple[int, bytes]], width: int, need: int) -> tuple[int, int]:
    """The most distinct words in ``width`` places, and how often ``need`` are met; what
    has met them isn't looked at again."""
    held: dict[bytes, int] = {}
    most = times = low = 0
    for high, (at, word) in enumerate(hits):
        held[word] = held.get(word, 0) + 1
        while hits[low][0] <= at - width:
            old = hits[low][1]
            held[old] -= 1
            if not held[old]:
                del held[old]
            low += 1
        most = max(most, len(held))
        if len(held) >= need:
            times, low, held = times + 1, high + 1, {}
    return most, times


def phrase_places(words: list[bytes], phrases: list[list[bytes]]) -> dict[int, list[int]]:
    """Starts, in words, of every place of each phrase; places may overlap."""
    found: dict[int, list[int]] = {}
    for k, phrase in enumerate(phrases):
        at = -1
        while True:
            try:
                at = words.index(phrase[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(phrase)] == phrase:
                found.setdefault(k, []).append(at)
    return found


def scan_licenses(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    threshold: float = 0.8,
    reach: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, n_blocks (places of templates) and score
    (the highest containment of a template; a base phrase counts as contained whole).
    """
    sets = template_sets(templates)
    vocabulary = frozenset().union(*(w for w, _ in sets))
    frequency = {bytes(r.word): r.n for r in word_frequencies(docs, vocabulary, text_col).collect()}  # bounded by the templates
    names, cut = list(phrases.values()), [p.encode().split() for p in phrases]

    def make():
        matcher = Matcher(templates, frequency, threshold, reach)
        hints = {p[-1] for p in cut}

        def one(text: bytes) -> tuple:
            words = folded_words(text)
            distinct = set(words)
            places = {} if hints.isdisjoint(distinct) else phrase_places(words, cut)
            starts = [s for v in places.values() for s in v]
            base = {names[k] for k in places}
            more = matcher.blocks(words, distinct)
            return (
                len(words), len(starts), min(starts, default=None), max(starts, default=None),
                ",".join(sorted(base)), ",".join(sorted(base | {x for x, _ in more})),
                len(more), max([s for _, s in more] + [1.0] * bool(starts), default=0.0),
            )

        def call(ids: list, texts: list[bytes]) -> dict[str, list]:
            cols = list(zip(*map(one, texts))) or [()] * 8
            names_out = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "n_blocks", "score")
            return {"doc_id": ids, **{n: list(c) for n, c in zip(names_out, cols)}}

        return call

    return map_texts(
        docs, make,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, n_blocks long, score double",
        id_col, text_col,
    )
