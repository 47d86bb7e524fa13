"""Licence scans with a generalised suffix automaton over the words of licence templates.

The automaton knows every run of words that any template contains. Streaming a file through it gives,
for each word, the longest run ending there that some template holds (the matching statistics). Where
such a run cannot be continued and is long, it is kept; kept runs that follow each other in file and
template alike are chained, and a chain that covers enough of its template marks the file's span.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_bytes, slices

# The phrases that count as base findings, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Sentences of public licences and notices, by label.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "This code is released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "licensed CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]

#: ASCII letters in lower case; every other ASCII character that is no digit becomes a blank.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(raw: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other non-ASCII characters, A-Z in lower case."""
    return raw.translate(FOLD).split()


class SuffixAutomaton:
    """A generalised suffix automaton of word sequences, grown one word at a time."""

    def __init__(self, sequences: list[list[bytes]]):
        self.go: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for t, words in enumerate(sequences):
            last = 0
            for place, word in enumerate(words):
                last = self.add(last, word, ends)
                ends[last].append((t, place))
        #: for each state, where its runs end: (template, place of the last word)
        self.ends: list[set[tuple[int, int]]] = [set(e) for e in ends]
        for state in sorted(range(1, len(self.go)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]
        self.vocabulary = {w for s in sequences for w in s}

    def state(self, length: int, ends: list, go: dict | None = None, link: int = 0) -> int:
        self.go.append(dict(go or {}))
        self.link.append(link)
        self.length.append(length)
        ends.append([])
        return len(self.go) - 1

    def split(self, source: int, word: bytes, target: int, ends: list) -> int:
        """Give the runs that fit behind ``source`` a state of their own."""
        twin = self.state(self.length[source] + 1, ends, self.go[target], self.link[target])
        self.link[target] = twin
        while source >= 0 and self.go[source].get(word) == target:
            self.go[source][word] = twin
            source = self.link[source]
        return twin

    def add(self, last: int, word: bytes, ends: list) -> int:
        if (there := self.go[last].get(word)) is not None:
            return there if self.length[there] == self.length[last] + 1 else self.split(last, word, there, ends)
        new = self.state(self.length[last] + 1, ends)
        while last >= 0 and word not in self.go[last]:
            self.go[last][word] = new
            last = self.link[last]
        if last >= 0:
            target = self.go[last][word]
            self.link[new] = target if self.length[target] == self.length[last] + 1 else self.split(last, word, target, ends)
        return new

    def walk(self, words: list[bytes]) -> int:
        state = 0
        for w in words:
            state = self.go[state][w]
        return state

    def statistics(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(place, state, length) of the longest known run that ends at each place, where there is one."""
        go, link, lengths = self.go, self.link, self.length
        state = length = 0
        for place, word in enumerate(words):
            if word in go[state]:
                state, length = go[state][word], length + 1
            elif word not in go[0]:
                state = length = 0
                continue
            else:
                while word not in go[state]:
                    state = link[state]
                length = lengths[state] + 1
                state = go[state][word]
            yield place, state, length


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]], min_run: int, max_gap: int, min_cover: float):
        self.phrases = [(words_of(p.encode()), label) for p, label in phrases.items()]
        self.templates = [(words_of(t.encode()), label) for label, t in templates]
        self.auto = SuffixAutomaton([w for w, _ in self.phrases] + [w for w, _ in self.templates])
        self.min_run, self.max_gap, self.min_cover = min_run, max_gap, min_cover
        home: dict[int, list[tuple[int, str]]] = {}
        for words, label in self.phrases:
            home.setdefault(self.auto.walk(words), []).append((len(words), label))
        #: for each state, the phrases that its longest run ends with
        self.phrase_at: list[list[tuple[int, str]]] = [[] for _ in self.auto.go]
        for state in sorted(range(1, len(self.auto.go)), key=self.auto.length.__getitem__):
            self.phrase_at[state] = self.phrase_at[self.auto.link[state]] + home.get(state, [])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int]], list[tuple[str, int, int, float]]]:
        """Base places (label, first word), and covered template spans (label, first, last, share)."""
        base, runs, before = [], [], None
        phrase_at, least = self.phrase_at, self.min_run
        for place, state, length in self.auto.statistics(words):
            for n, label in phrase_at[state]:
                if n <= length:
                    base.append((label, place - n + 1))
            if before and before[2] >= least and (place, length) != (before[0] + 1, before[2] + 1):
                runs.append(before)
            before = (place, state, length)
        if before and before[2] >= least:
            runs.append(before)
        return base, self.chain(runs)

    def chain(self, runs: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Join runs that follow each other in file and template, by template."""
        skip, open_, done = len(self.phrases), {}, []
        for place, state, length in runs:
            for t, end in self.auto.ends[state]:
                if t < skip:
                    continue
                best = None
                for c in open_.get(t, []):
                    if place - length - c["last"] <= self.max_gap and end > c["end"]:
                        gain = min(length, end - c["end"], place - c["last"])
                        if gain > 0 and (best is None or c["covered"] + gain > best[0]):
                            best = (c["covered"] + gain, c["first"])
                covered, first = max(best or (0, 0), (length, place - length + 1))
                mine = [c for c in open_.get(t, []) if place - c["last"] <= self.max_gap + len(self.templates[t - skip][0])]
                open_[t] = [*mine, {"first": first, "last": place, "end": end, "covered": covered}]
                words, label = self.templates[t - skip]
                if covered >= self.min_cover * len(words):
                    done.append((label, first, place, covered / len(words)))
        kept: list[tuple[str, int, int, float]] = []
        taken: dict[str, list[tuple[int, int]]] = {}
        for span in sorted(done, key=lambda s: (s[1] - s[2], s)):
            own = taken.setdefault(span[0], [])  # never overlapping, by first word
            at = bisect.bisect(own, (span[2], span[2]))
            if not at or own[at - 1][1] < span[1]:
                bisect.insort(own, (span[1], span[2]))
                kept.append(span)
        return sorted(kept, key=lambda s: (s[1], s[2], s[0]))


SCHEMA = "n_words long, base array<struct<label: string, word: long>>, spans array<struct<label: string, first: long, last: long, covered: double>>"
BASE_TYPE = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
SPAN_TYPE = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))


def scanning(phrases: dict, templates: list, settings: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates, *settings)
        for piece in slices(batches):
            n, base, spans = [], [], []
            for raw in piece.column("text").to_pylist():
                words = words_of(raw)
                places, covered = scanner.scan(words)
                n.append(len(words))
                base.append([{"label": label, "word": w} for label, w in places])
                spans.append([dict(zip(("label", "first", "last", "covered"), s, strict=True)) for s in covered])
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(n, pa.int64()), pa.array(base, BASE_TYPE), pa.array(spans, SPAN_TYPE)], ["doc_id", "n_words", "base", "spans"])

    return run


def scan_licenses(df: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None, min_run: int = 4, max_gap: int = 12, min_cover: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find licence phrases and covered spans of licence templates in each row's whole text.

    Returns a row per input row: the id, ``n_words``, ``base`` (label and first word of every place of
    a phrase, places may overlap) and ``spans`` (label, first and last word, share of the template
    covered; of overlapping spans with one label the longest stays). A run counts from ``min_run``
    words; ``max_gap`` other words may part two runs of a chain; a chain counts from a share of
    ``min_cover``. Null and empty texts give no words and empty lists; a null id stays null; repeated
    rows repeat; an empty table gives no rows. Texts of any length are scanned whole, within one row. Of
    equally long overlapping spans with one label the first by place stays.
    """
    run = scanning(BASE_PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates, (min_run, max_gap, min_cover))
    kind = df.schema[id_col].dataType.simpleString()
    return id_and_bytes(df, id_col, text_col).mapInArrow(run, f"doc_id {kind}, {SCHEMA}")


def report(scanned: DataFrame) -> DataFrame:
    """Counts, labels and the strongest finding of each row; a base phrase is found whole, so it scores 1."""
    words, base = F.transform("base", lambda b: b["word"]), F.transform("base", lambda b: b["label"])
    spans = F.transform("spans", lambda s: s["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    covered = F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"])), F.lit(0.0))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(words).alias("first_word"),
        F.array_max(words).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, spans)).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.least(covered, F.lit(1.0))).alias("score"),
    )
