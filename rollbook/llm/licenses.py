"""License scans: an exact containment join of the word windows of all texts with license templates.

A block contains a template if at least the share ``containment`` of the template's distinct words are in it.
Blocks are all windows of REACH times as many words as the template has, across line ends: notices that wrap are
found, and a long line does not contain a template just because it has its words somewhere.
The words of all templates are put in one global order, rarest in the corpus first. A window that reaches the
threshold must hold one of a template's first n - ceil(share * n) + 1 words (prefix), so only stretches around such
words are looked at; they must hold enough template words at all (length); and the window that slides over a stretch
counts the distinct words within reach of each other (position) before it is one that contains.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.words import NOT_ALNUM, Words, slices, text_buffer

CONTAINMENT = 0.95
#: Words of a window, as a multiple of a template's: room for comment marks, names and words put in.
REACH = 2
#: Phrases whose every place counts, with their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: What texts state their license with, from one sentence to a whole license, with their labels.
NOTICES = (
    ("Licensed under the Apache License, Version 2.0", "apache"),
    ("you may not use this file except in compliance with the License", "apache"),
    (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.", "apache",
    ),
    ("this work is licensed under the GNU General Public License version 3", "gpl"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lgpl"),
    ("under the terms of the GNU Affero General Public License", "agpl"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR "
        "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.", "mit",
    ),
    ("released under the MIT License", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
        "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.", "bsd",
    ),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY "
        "SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.", "isc",
    ),
    (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must "
        "not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.", "zlib",
    ),
    ("Boost Software License - Version 1.0", "boost"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    (
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "unlicense",
    ),
    ("Eclipse Public License v 2.0", "epl"),
    ("licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution International License", "cc-by"),
    ("This work is licensed under a Creative Commons Attribution NonCommercial International License", "cc-by-nc"),
    ("This work is licensed under a Creative Commons Attribution ShareAlike International License", "cc-by-sa"),
    ("has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "cc0"),
)
TEMPLATES = tuple((" ".join(_WORD.findall(text.lower())), label) for text, label in NOTICES)


class Templates:
    """Templates as sets of word numbers, numbered by the global order; frequency: how often each word is in the corpus."""

    def __init__(self, templates: tuple[tuple[str, str], ...], frequency: dict[str, int], containment: float) -> None:
        words = vocabulary(templates)
        self.order = {w: i for i, w in enumerate(sorted(words, key=lambda w: (frequency.get(w, 0), w)))}
        self.labels = [label for _, label in templates]
        self.sets = [sorted({self.order[w] for w in text.split()}) for text, _ in templates]
        self.reach = [REACH * len(text.split()) for text, _ in templates]
        self.need = [math.ceil(round(containment * len(s), 9)) for s in self.sets]


def most_shared(places: list[int], words: list[int], reach: int) -> int:
    """The most distinct words that any ``reach`` places in a row hold; places ascend."""
    held, left, best = Counter(), 0, 0
    for p, w in zip(places, words, strict=True):
        held[w] += 1
        while places[left] <= p - reach:
            held[words[left]] -= 1
            if not held[words[left]]:
                del held[words[left]]
            left += 1
        best = max(best, len(held))
    return best


def shortest(places: list[int], words: list[int], reach: int, need: int) -> Iterator[tuple[int, int]]:
    """First and last place of each run within reach that holds ``need`` distinct words and none when cut at either end."""
    held, left = Counter(), 0
    for p, w in zip(places, words, strict=True):
        held[w] += 1
        while len(held) >= need:
            if held[words[left]] == 1 and len(held) == need and places[left] > p - reach:
                yield places[left], p
            held[words[left]] -= 1
            if not held[words[left]]:
                del held[words[left]]
            left += 1


def vocabulary(templates: tuple[tuple[str, str], ...]) -> list[str]:
    return sorted({w for text, _ in templates for w in text.split()} | {w for text, _ in PHRASES for w in text.split()})


class Vocabulary:
    """Numbers of a few words, found in a batch's words by hash."""

    def __init__(self, words: list[str]) -> None:
        own = Words(pa.array([" ".join(words)]))
        hashes = own.hashes()
        self.order = np.argsort(hashes)
        self.keys = hashes[self.order]

    def numbers(self, words: Words) -> np.ndarray:
        """For each word its number, or -1."""
        hashes = words.hashes()
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.order[at], -1)


def word_counts(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """How often each of a few words occurs in all texts."""
    numbers = Vocabulary(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(words) + 1, np.int64)
        for batch in slices(batches):
            total += np.bincount(numbers.numbers(Words(batch["text"], fold=True, separators=NOT_ALNUM)) + 1, minlength=len(words) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(total[1:])], names=["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


def _stretches(places: np.ndarray, rare: np.ndarray, reach: int, need: int) -> Iterator[tuple[int, int]]:
    """Ranges of the places that lie within reach of a rare one, joined where they overlap, and are ``need`` at least."""
    chosen = places[rare]
    a, b = np.searchsorted(places, chosen - reach, "right"), np.searchsorted(places, chosen + reach)
    if not len(a):
        return
    cut = np.flatnonzero(a[1:] >= b[:-1])
    for x, y in zip(a[np.append(0, cut + 1)].tolist(), b[np.append(cut, len(b) - 1)].tolist(), strict=True):
        if y - x >= need:
            yield x, y


_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("lines", pa.list_(pa.string()))])
_FOUND_DDL = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, lines array<string>"


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """The license labels of every text.

    docs needs doc_id and text; other columns are ignored. Per row: doc_id, n_words, n_base (places of PHRASES,
    overlapping ones too), first_word and last_word (the smallest and largest of their starts, null without
    one), base_labels, labels (theirs and the templates'; distinct, sorted, comma-joined, else empty), score
    (the largest containment found, 1 with a phrase, 0 with nothing) and lines (the runs of lines that contain a
    template, distinct, by template and place). A null text has no words. Null and repeated ids give a row each; very
    long texts and lines are taken whole; an empty table gives no rows. Lines are cut at \\n.
    """
    words = vocabulary(templates)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    wanted = Templates(templates, word_counts(docs, words), containment)
    numbers, place = Vocabulary(words), {w: i for i, w in enumerate(words)}
    rank = np.array([wanted.order.get(w, -1) for w in words] + [-1])
    prefix, member = np.zeros((2, len(templates), len(words) + 1), bool)  # the last column is for other words, number -1
    for t, ranks in enumerate(wanted.sets):
        member[t] = np.isin(rank, ranks)
        prefix[t] = np.isin(rank, ranks[: len(ranks) - wanted.need[t] + 1])
    phrases = [([place[w] for w in text.split()], label) for text, label in PHRASES]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = Words(batch["text"], fold=True, separators=NOT_ALNUM)
            raw, number = text_buffer(batch["text"])[0], numbers.numbers(text)
            base = [Counter() for _ in range(batch.num_rows)]
            first, last = {}, {}
            for phrase, label in phrases:
                starts = np.flatnonzero(number == phrase[0])
                starts = starts[np.searchsorted(text.first, starts, "right") == np.searchsorted(text.first, starts + len(phrase) - 1, "right")]
                starts = starts[starts + len(phrase) <= len(number)]
                for k, w in enumerate(phrase):
                    starts = starts[number[starts + k] == w]
                for s in starts.tolist():
                    d = int(np.searchsorted(text.first, s, "right")) - 1
                    at = s - int(text.first[d])
                    base[d][label] += 1
                    first[d], last[d] = min(first.get(d, at), at), max(last.get(d, at), at)
            best, labels, lines = [0.0] * batch.num_rows, [set(c) for c in base], [{} for _ in base]
            breaks = np.flatnonzero(text.data == 10)
            lo = np.sort(np.concatenate([text.offsets[:-1], breaks + 1]))  # every text and every line starts one
            near = np.flatnonzero(number >= 0)
            here = np.searchsorted(lo, text.starts[near], "right") - 1
            owner = np.searchsorted(text.first, near, "right") - 1
            for t, reach in enumerate(wanted.reach):
                mine = np.flatnonzero(member[t][number[near]])
                at, docs_at = near[mine], owner[mine]
                keyed = at + docs_at * reach  # texts lie a reach apart, so that no window spans two
                for a, b in _stretches(keyed, prefix[t][number[at]], reach, wanted.need[t]):
                    places, ranks = keyed[a:b].tolist(), rank[number[at[a:b]]].tolist()
                    most = most_shared(places, ranks, reach)
                    if most < wanted.need[t]:
                        continue
                    d = int(docs_at[a])
                    labels[d].add(wanted.labels[t])
                    best[d] = max(best[d], most / len(wanted.sets[t]))
                    after = -1
                    for first_place, last_place in shortest(places, ranks, reach, wanted.need[t]):
                        i, j = (int(here[mine[a + bisect_left(places, p)]]) for p in (first_place, last_place))
                        if i > after:
                            end = int(lo[j + 1]) if j + 1 < len(lo) else len(text.data)
                            lines[d][raw[int(lo[i]) : end].tobytes().decode().strip("\n")] = None
                            after = j
            score = [1.0 if c else s for c, s in zip(base, best, strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"], pa.array(text.n), pa.array([sum(c.values()) for c in base], pa.int64()), *(pa.array([x.get(d) for d in range(batch.num_rows)], pa.int64()) for x in (first, last)),
                pa.array([",".join(sorted(c)) for c in base], pa.string()), pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array(score, pa.float64()), pa.array([list(x) for x in lines], pa.list_(pa.string())),
            ], schema=_FOUND)

    return docs.mapInArrow(search, _FOUND_DDL)
