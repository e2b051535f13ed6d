"""Licence scan by a positional rare-token index of licence templates.

Postings map a word to the (template, place) pairs that hold it. A file's own licence words are looked up
rarest first (by inverse document frequency in the corpus), until each template has met its VOTERS of them.
Each place of such a word votes, through the word's postings, for the starts at which a template would have it
there. Votes are intersected by relative position: a start stands if two different words agree on it and hold
half of the weight of all that voted for the template. There the template's other words are met at their
places, and its mandatory key phrases must stand.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.common import to_bytes

# Phrases whose every place is reported, with their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

VOTERS = 6  # rarest words of a file that vote for a template
LEAST_VOTES = 0.5  # of the weight of a template's voters that must agree on a start
LEAST_SHARE = 0.4  # of a template's weight that must stand at its places
NEAR = (4, 8)  # words before and after a template's place in which its mandatory phrases may stand

# Texts and customary notices of licences (in the words of the licences), and the phrases that must be there.
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "apache-2.0": ("licensed under the apache license version 2 0", ("apache license", "2 0")),
    "apache-2.0-notice": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ("apache license", "as is basis"),
    ),
    "mit": ("released under the mit license", ("mit license",)),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        ("permission is hereby granted", "free of charge"),
    ),
    "bsd-3-clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ("redistribution and use", "source and binary forms", "neither the name"),
    ),
    "bsd-2-clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        ("redistribution and use", "source and binary forms"),
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
        ("with or without fee",),
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
        ("must not be misrepresented",),
    ),
    "gpl-2.0": ("licensed under the gnu general public license version 2", ("general public license version 2",)),
    "gpl-3.0": ("licensed under the gnu general public license version 3", ("general public license version 3",)),
    "gpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program",
        ("gnu general public license", "any later version"),
    ),
    "lgpl": ("licensed under the gnu lesser general public license", ("lesser general public license",)),
    "agpl": ("licensed under the gnu affero general public license", ("affero general public license",)),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license",)),
    "epl-2.0": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", ("eclipse public license",)),
    "lgpl-notice": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
        ("gnu lesser general public license", "this library is free software"),
    ),
    "agpl-notice": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details",
        ("gnu affero general public license", "this program is free software"),
    ),
    "cc-by-4.0-notice": (
        "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this license visit http creativecommons org licenses by 4 0 or send a letter to creative commons po box 1866 mountain view ca 94042 usa",
        ("creative commons attribution 4 0",),
    ),
    "cc-by-sa-4.0-notice": (
        "this work is licensed under the creative commons attribution sharealike 4 0 international license to view a copy of this license visit http creativecommons org licenses by sa 4 0 or send a letter to creative commons po box 1866 mountain view ca 94042 usa",
        ("creative commons attribution sharealike 4 0",),
    ),
    "cc0-deed": (
        "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law including all related and neighboring rights to the extent allowed by law you can copy modify distribute and perform the work even for commercial purposes all without asking permission",
        ("public domain", "associated a work with this deed"),
    ),
    "bsl-1.0-text": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor",
        ("person or organization obtaining a copy", "machine executable object code"),
    ),
    "bsl-1.0": ("distributed under the boost software license version 1 0", ("boost software license",)),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("unencumbered software", "public domain"),
    ),
    "cc-by-4.0": ("licensed under cc by 4 0", ("cc by 4 0",)),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    "cc-by-nd-4.0": ("licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    "cc0": ("licensed under cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    "proprietary": ("all rights reserved no part may be reproduced without permission", ("all rights reserved", "without permission")),
}

# A-Z to a-z; digits, letters and all bytes of other scripts stay; everything else parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Index:
    """Postings word -> (template, place), with the words' inverse document frequencies.

    Base phrases are templates too; every place of theirs is found through their rarest word's postings.
    """

    def __init__(self, templates: dict, frequencies: dict[str, int], documents: int):
        self.names = [*BASE_PHRASES.values(), *templates]
        self.n_base = len(BASE_PHRASES)
        self.texts = [p.encode().split() for p in [*BASE_PHRASES, *(t for t, _ in templates.values())]]
        self.phrases = [[t] for t in self.texts[: self.n_base]] + [[p.encode().split() for p in ps] for _, ps in templates.values()]
        vocabulary = sorted({w for t in self.texts for w in t} | {w for ps in self.phrases for p in ps for w in p})
        self.idf = {w: math.log((1 + documents) / (1 + frequencies.get(w.decode(), 0))) + 1 for w in vocabulary}
        self.weight = [sum(self.idf[w] for w in t) for t in self.texts]
        self.anchors = {k: max(sorted(set(t)), key=lambda w: self.idf[w]) for k, t in enumerate(self.texts[: self.n_base])}
        self.postings: dict[bytes, dict[int, list[int]]] = {}
        for k, text in enumerate(self.texts):
            for i, w in enumerate(text):
                self.postings.setdefault(w, {}).setdefault(k, []).append(i)
        self.order = {w: n for n, w in enumerate(sorted(self.postings, key=lambda w: (-self.idf[w], w)))}
        self.lookup = frozenset(self.postings)
        # A text without one of a template's key words cannot hold its phrases.
        self.keys = [frozenset(w for p in ps for w in p) for ps in self.phrases]

    def starts(self, found: list[bytes]) -> list[tuple[int, int]]:
        """(template, start) pairs that enough of the file's rarest words of the template agree on."""
        here = self.lookup.intersection(found)
        wanted = {k for k in range(len(self.texts)) if self.keys[k] <= here}
        if not wanted:
            return []
        base = [k for k in wanted if k < self.n_base]
        met: dict[int, list[bytes]] = {k: [] for k in wanted if k >= self.n_base}
        open_ = set(met)
        for w in sorted(here, key=self.order.__getitem__):  # rarest first
            for k in self.postings[w].keys() & open_:
                met[k].append(w)
                if len(met[k]) == VOTERS:
                    open_.discard(k)
            if not open_:
                break
        places: dict[bytes, list[int]] = {w: [] for w in [self.anchors[k] for k in base] + [w for voters in met.values() for w in voters]}
        for i, w in enumerate(found):
            if w in places:
                places[w].append(i)
        out = [(k, i - at) for k in base for at in self.postings[self.anchors[k]][k] for i in places[self.anchors[k]]]
        for k, voters in met.items():
            votes: dict[int, list[float]] = {}
            for w in voters:
                for start in {i - at for at in self.postings[w][k] for i in places[w]}:
                    votes.setdefault(start, []).append(self.idf[w])
            least = LEAST_VOTES * sum(self.idf[w] for w in voters) - 1e-9
            out += [(k, start) for start, ws in votes.items() if len(ws) >= 2 and sum(ws) >= least]
        return out

    def scan(self, found: list[bytes]) -> tuple[list[int], set[str], float]:
        """Starts of the base phrases, all labels, and the best share of a template's weight."""
        places, labels, best = [], set(), 0.0
        for k, start in self.starts(found):
            text = self.texts[k]
            if k < self.n_base:
                if start >= 0 and found[start : start + len(text)] == text:
                    places.append(start)
                    labels.add(self.names[k])
                    best = max(best, 0.5)
                continue
            met = sum(self.idf[w] for j, w in enumerate(text) if 0 <= start + j < len(found) and found[start + j] == w)
            share = met / self.weight[k]
            if share < LEAST_SHARE:
                continue
            near = found[max(0, start - NEAR[0]) : max(0, start + len(text) + NEAR[1])]
            if all(any(near[j : j + len(p)] == p for j in range(len(near))) for p in self.phrases[k]):
                labels.add(self.names[k])
                best = max(best, min(1.0, share))
        return places, labels, best


def word_frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[dict[str, int], int]:
    """How many documents hold each licence word, and how many documents there are; counted over whole texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        n = 0
        for b in batches:
            n += b.num_rows
            for text in to_bytes(b.column(0)):
                total.update(vocabulary.intersection(words(text)))
        rows = [("", n), *((w.decode(), c) for w, c in total.items())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64())], names=["w", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n")).collect()  # one row per word of the templates
    counts = {r[0]: r[1] for r in rows}
    return counts, counts.pop("", 0)


def scan(docs: DataFrame, templates: dict | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of `docs`.

    Words are runs of digits, letters and non-ASCII bytes, A-Z lower-cased. Base phrases are found at
    every place where their words stand in a row. For a template the file's six rarest words of it vote; it
    counts at a start on which two of them or more, with half of their weight, agree, where its words in place
    hold 40 % of its IDF weight, and all its mandatory phrases stand there or a few words off. score: the largest such share; 0.5 for base
    phrases alone; 0 without a label; equal shares score alike. Texts are read whole; null texts count as
    empty; repeated rows and null ids come back as they are; an empty table gives no rows; other columns
    are ignored.
    """
    templates = TEMPLATES if templates is None else templates
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    vocabulary = {w for t in [*BASE_PHRASES, *(t for t, _ in templates.values()), *(p for _, ps in templates.values() for p in ps)] for w in t.encode().split()}
    frequencies, n = word_frequencies(texts, vocabulary)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, frequencies, n)
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for text in to_bytes(b.column(1)):
                found = words(text)
                places, labels, best = index.scan(found)
                base = sorted(labels & set(BASE_PHRASES.values()))
                row = (len(found), len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted(labels)), best)
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return texts.mapInArrow(label, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
