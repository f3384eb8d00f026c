"""License scan: a positional index of rare words of licence notices.

A notice is found around a place of its key phrase, where at least ``share`` of
its words stand in order, none further out of its place than ``slack`` of the
notice's length: words may be changed, left out or put in.  All but
``n - ceil(share n)`` words of a notice of n are then there, so of two words
more than those may be missing, two at least must be: only as many of its
rarest are indexed, with their places.  Rarity is how few documents have the
word, counted over all documents.

In a file the indexed words that it has are looked up, the rarest first.  Each
occurrence says where its notices would start; the postings of a notice are
intersected by these starts, and a notice is a candidate where the starts of
two different words agree, but for twice the slack.  Where one word's postings
meet no other's, nothing is read again.  Candidates must then hold the key
phrase, and their words are aligned.

Besides, four base phrases are counted wherever their words follow each other.
score is the largest share found of a notice, or 0.5 where there is only a base
phrase, or 0.

Edge cases: null and empty texts have no words, no labels and score 0.  Of
equally rare words the first in the notice is taken.  Texts may have any
length.  Repeated rows each get a row; a null doc_id stays null; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.llm._base import table

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

# Phrases and labels of the base.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public licence notices and the phrase that each must hold.
NOTICES = {
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "permission is hereby granted free of charge",
    ),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
        "redistribution and use in source and binary forms",
    ),
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "apache license version 2 0",
    ),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "gnu general public license as published by the free software foundation",
    ),
    "lgpl-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at "
        "your option) any later version.",
        "gnu lesser general public license",
    ),
    "agpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version.",
        "gnu affero general public license",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "mozilla public license v 2 0",
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "for any purpose with or without fee is hereby granted",
    ),
    "zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely",
        "including commercial applications and to alter it and redistribute it freely",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
        "unencumbered software released into the public domain",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "waived all copyright and related or neighboring rights",
    ),
    "cc-by-4.0": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this "
        "license, visit http://creativecommons.org/licenses/by/4.0/",
        "creative commons attribution 4 0",
    ),
}


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


def document_frequencies(docs: DataFrame, words: set[bytes]) -> dict[bytes, int]:
    """In how many documents each of the given words stands; as many numbers as words."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for b in batches:
            for text in b["text"]:
                seen.update(words.intersection(words_of(text)))
        if seen:  # Arrow does not take a frame without rows
            yield pd.DataFrame({"word": [w.decode() for w in seen], "n": list(seen.values())})

    rows = docs.select("text").mapInPandas(each, "word string, n long").groupBy("word").agg(F.sum("n")).collect()
    return {w.encode(): n for w, n in rows}


def aligned(own: list[bytes], at: int, words: list[bytes], i: int, slack: int) -> int:
    """Most words of a notice that stand in a text in order, word ``at`` at place i and each within slack of where that puts it."""
    best = [0] * (2 * slack + 2)  # by shift, for the words up to here; the last stays 0
    low = i - at - slack
    for j, word in enumerate(own):
        before, left = best, 0
        best = [0] * (2 * slack + 2)
        for d in range(2 * slack + 1):
            p = low + j + d  # the place of this word at this shift; it moves on by one with each word
            here = before[d] + 1 if 0 <= p < len(words) and words[p] == word else 0
            left = best[d] = max(here, left, before[d + 1])
    return max(best)


class Index:
    """Notices, their rarest words by place, and how to look them up in a text."""

    def __init__(self, notices: dict[str, tuple[str, str]], phrases: dict[str, str], rarity: dict[bytes, int], share: float, slack: float):
        self.labels = list(notices)
        self.words = [words_of(text) for text, _ in notices.values()]
        self.least = [math.ceil(share * len(w)) for w in self.words]
        self.slack = [math.ceil(slack * len(w)) for w in self.words]
        keys = [words_of(key) for _, key in notices.values()]
        self.keys = [(self._place(w, k), k) for w, k in zip(self.words, keys, strict=True)]
        self.rarity = rarity
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, w in enumerate(self.words):
            rare = sorted(range(len(w)), key=lambda i: (rarity.get(w[i], 0), i))  # noqa: B023
            for i in rare[: len(w) - self.least[t] + 2]:
                self.postings.setdefault(w[i], []).append((t, i))
        self.phrases: dict[bytes, list[tuple[list[bytes], str]]] = {}
        for text, label in phrases.items():
            p = words_of(text)
            self.phrases.setdefault(p[0], []).append((p, label))
        self.watched = frozenset(self.postings) | frozenset(self.phrases)

    @staticmethod
    def _place(words: list[bytes], key: list[bytes]) -> int:
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)

    def candidates(self, places: dict[bytes, list[int]]) -> dict[int, list[tuple[int, int]]]:
        """By notice, the runs (first, last) of starts on which two of its rarest words agree; places: those of a file's watched words."""
        starts: dict[int, list[tuple[int, int]]] = {}
        for w in sorted(places, key=lambda w: (self.rarity.get(w, 0), w)):  # the file's rarest first
            for t, at in self.postings.get(w, ()):
                starts.setdefault(t, []).extend((i - at, at) for i in places[w])
        out: dict[int, list[tuple[int, int]]] = {}
        for t, all_ in starts.items():
            all_.sort()
            for (a, x), (b, y) in zip(all_, all_[1:], strict=False):
                # neighbours that are one word at two places agree on nothing by themselves
                if b - a <= 2 * self.slack[t] and (x != y or self.least[t] < 2):
                    runs = out.setdefault(t, [])
                    if runs and a <= runs[-1][1]:
                        runs[-1] = (runs[-1][0], b)
                    else:
                        runs.append((a, b))
        return out

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[str, int, float]]]:
        """Base phrases (start, label); notices (label, start, share of their words that stand there)."""
        base, places = [], {}
        watched = self.watched
        for i in [i for i, w in enumerate(words) if w in watched]:
            for p, label in self.phrases.get(words[i], ()):
                if words[i : i + len(p)] == p:
                    base.append((i, label))
            if words[i] in self.postings:
                places.setdefault(words[i], []).append(i)
        found = []
        for t, runs in self.candidates(places).items():
            (at, key), own, slack = self.keys[t], self.words[t], self.slack[t]
            done = -1
            for first, last in runs:
                # the key phrase stands in its place, but for the slack either way
                for i in range(max(first + at - 2 * slack, done + 1, 0), last + at + 2 * slack + 1):
                    done = max(done, i)
                    if words[i : i + len(key)] == key:
                        same = aligned(own, at, words, i, slack)
                        if same >= self.least[t]:
                            found.append((self.labels[t], i - at, same / len(own)))
        return base, sorted(found)


def scan_licenses(
    docs: DataFrame,
    *,
    notices: dict[str, tuple[str, str]] = NOTICES,
    phrases: dict[str, str] = PHRASES,
    share: float = 0.7,
    slack: float = 0.1,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and notices (label, start, share)."""
    vocabulary = {w for text, _ in notices.values() for w in words_of(text)}
    index = Index(notices, phrases, document_frequencies(docs, vocabulary), share, slack)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                words = words_of(text)
                base, found = index.scan(words)
                own = sorted({label for _, label in base})
                every = sorted({*own, *(label for label, _, _ in found)})
                score = max((s for _, _, s in found), default=0.5 if base else 0.0)
                first, last = (min(base)[0], max(base)[0]) if base else (None, None)
                spans = json.dumps([{"label": x, "start": s, "share": y} for x, s, y in found])
                rows.append((doc_id, len(words), len(base), first, last, ",".join(own), ",".join(every), score, spans))
            out = pd.DataFrame(rows, columns=columns)
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})

    columns = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "notices"]
    d = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    out = d.mapInPandas(
        each,
        "doc_id string, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, notices string",
    )
    out = out.withColumn("notices", F.from_json("notices", "array<struct<label: string, start: long, share: double>>"))
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("notices")
