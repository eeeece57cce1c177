"""Licences in texts: a positional index of template words, looked up by the rarest of them.

A template is a licence's notice, with the key phrases that it must hold. The index has the places of each word in each
template. Over all documents it is counted in how many of them each template word stands; the rarest words of a
template's key phrases are its rare ones, so a file's licence words of highest inverse document frequency are looked up
and common words never. Each place of such a word in a file says where a template would begin; the places that all
rare words of a template agree on, within its slack, are its candidates. There every key phrase must stand whole, within
the slack of its own place, and the template's words must be found around it up to its share.

Phrases of a few words are templates without slack whose only key phrase is the phrase, so the same lookup gives every
place where one stands. Words are runs of letters and digits after lower-casing A-Z; all characters beyond ASCII count
as letters. Texts are read in pieces of ``PIECE`` bytes, each with the words before it that a template may reach back to.

Cases: null and empty texts have no words and no matches. Overlapping places of a phrase all count; of a notice the first is told. A text of any length is read
whole, in bounded memory but for the list of its matches. Repeated rows each have a result, and a document counts as
often as its row is repeated. Words that no document holds are the rarest. Ties of rarity go to the word that comes
first in the alphabet. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterframe.llm.blocks import column_bytes, sliced

#: Words of a template that are looked up.
RARE = 3
#: The share of a notice's words that must be found around a candidate.
SHARE = 0.8
#: Words that may be added or left out before a place in a notice: names, years, comment marks.
SLACK = 12
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


@dataclass(frozen=True)
class Template:
    """``base``: a phrase that is told wherever it stands; else a notice whose ``keys`` must stand in it."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False
    words: tuple[bytes, ...] = field(init=False)
    phrases: tuple[tuple[int, tuple[bytes, ...]], ...] = field(init=False)

    def __post_init__(self) -> None:
        own = tuple(words(self.text.encode()))
        phrases = []
        for key in self.keys or (self.text,):
            phrase = tuple(words(key.encode()))
            at = next((i for i in range(len(own) - len(phrase) + 1) if own[i : i + len(phrase)] == phrase), None)
            if at is None or not phrase:
                raise ValueError(f"the key phrase {key!r} does not stand in the template of {self.label}")
            phrases.append((at, phrase))
        object.__setattr__(self, "words", own)
        object.__setattr__(self, "phrases", tuple(phrases))

    @property
    def slack(self) -> int:
        return 0 if not self.keys else SLACK


#: The phrases that are told wherever they stand.
PHRASES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
)

#: The notices by which licences are declared, as their authors word them, and short forms of them.
NOTICES = (
    Template("gpl-3.0", "GNU General Public License, version 3"),
    Template("gpl-3.0", "GNU General Public License v3"),
    Template("gpl-2.0", "GNU General Public License, version 2"),
    Template("gpl-2.0", "GNU General Public License v2"),
    Template("lgpl", "GNU Lesser General Public License"),
    Template("agpl", "GNU Affero General Public License"),
    Template("apache-2.0", "Apache License, Version 2.0"),
    Template("cc-by-4.0", "CC BY 4.0"),
    Template("cc-by-sa", "CC BY-SA"),
    Template("cc-by-nc", "CC BY-NC"),
    Template("cc-by-nd", "CC BY-ND"),
    Template("cc-by-nc-4.0", "CC BY-NC 4.0"),
    Template("cc-by-sa-4.0", "CC BY-SA 4.0"),
    Template("cc0", "CC0 1.0 Universal"),
    Template("mpl-2.0", "Mozilla Public License, v. 2.0"),
    Template("mit", "SPDX-License-Identifier: MIT"),
    Template("apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    Template("bsd", "BSD 3-Clause License"),
    Template("bsd", "BSD 2-Clause License"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction", "sublicense and or sell copies"),
    ),
    Template(
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        ("apache license version 2 0", "you may not use this file except in compliance with the license"),
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        ("this program is free software", "gnu general public license", "any later version"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies",
        ("distribute this software for any purpose with or without fee is hereby granted", "this permission notice appear in all copies"),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        ("redistribution and use in source and binary forms", "are permitted provided that the following conditions are met"),
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/",
        ("subject to the terms of the mozilla public license", "if a copy of the mpl was not distributed with this file"),
    ),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software",
        ("free and unencumbered software released into the public domain",),
    ),
)
TEMPLATES = PHRASES + NOTICES


class Index:
    """The places of template words, and the rare words of each template by the documents that hold a word."""

    def __init__(self, templates: tuple[Template, ...], held: dict[bytes, int]):
        self.templates = templates
        self.postings: dict[bytes, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for t, template in enumerate(templates):
            for place, word in enumerate(template.words):
                self.postings[word][t].append(place)
        rank = lambda word: (held.get(word, 0), word)
        self.needed = [frozenset(w for _, phrase in t.phrases for w in phrase) for t in templates]
        self.rare = [sorted(words, key=rank)[:RARE] for words in self.needed]
        #: The templates that a word is the rarest of, and these words by rarity.
        self.by_rarest: dict[bytes, list[int]] = defaultdict(list)
        for t, rare in enumerate(self.rare):
            self.by_rarest[rare[0]].append(t)
        self.order = sorted(self.by_rarest, key=rank)
        self.reach = max((len(t.words) + 2 * t.slack for t in templates), default=0)

    def candidates(self, text: list[bytes]) -> dict[int, np.ndarray]:
        """Where each template may begin in a file of these words: places that all its rare words agree on."""
        there = set(text)
        open_ = [t for word in self.order if word in there for t in self.by_rarest[word] if self.needed[t] <= there]
        if not open_:
            return {}
        looked = {word for t in open_ for word in self.rare[t]}
        places: dict[bytes, list[int]] = {word: [] for word in looked}
        for i, word in enumerate(text):
            if word in looked:
                places[word].append(i)
        return {t: starts for t in open_ if len(starts := self._agreed(t, places))}

    def _agreed(self, t: int, places: dict[bytes, list[int]]) -> np.ndarray:
        """The places of the rarest word's beginnings that every other rare word has a beginning near to."""
        slack, found = self.templates[t].slack, None
        for word in self.rare[t]:
            starts = np.unique(np.concatenate([np.array(places[word], np.int64) - place for place in self.postings[word][t]]))
            if found is None:
                found = starts
                continue
            near = np.searchsorted(starts, found - slack)
            found = found[(near < len(starts)) & (starts[np.minimum(near, len(starts) - 1)] <= found + slack)]
        return found

    def verified(self, t: int, starts: np.ndarray, text: list[bytes]) -> Iterator[tuple[int, int, float]]:
        """(first word, words, share) of each candidate whose key phrases stand in their places."""
        template, after = self.templates[t], -1
        size = len(template.words)
        for start in starts.tolist():
            if not template.slack:
                if start >= 0 and tuple(text[start : start + size]) == template.words:
                    yield start, size, 1.0
                continue
            if start < after:
                continue  # another view of the match before
            ends = []
            for at, phrase in template.phrases:
                near = range(max(0, start + at - template.slack), min(len(text) - len(phrase), start + at + template.slack) + 1)
                ends.append(next((i for i in sorted(near, key=lambda i: abs(i - start - at)) if tuple(text[i : i + len(phrase)]) == phrase), None))
            if None in ends:
                continue
            around = Counter(text[max(0, start - template.slack) : max(0, start) + size + template.slack])
            share = (Counter(template.words) & around).total() / size
            if share >= SHARE:
                first = max(0, min(start, *ends))
                after = start + size
                yield first, size, share

    def matches(self, text: bytes) -> tuple[int, list[tuple[int, int, int, float]]]:
        """(number of words, matches (template, first word, words, share)) of a whole text."""
        total, tail = 0, []
        found: dict[tuple[int, int], tuple[int, float]] = {}
        for piece in pieces(text):
            fresh = words(piece)
            own, before = [*tail, *fresh], total - len(tail)
            for t, starts in self.candidates(own).items():
                for first, size, share in self.verified(t, starts, own):
                    name = (t, before + first)
                    found[name] = max(found.get(name, (size, 0.0)), (size, share))
            total += len(fresh)
            tail = own[len(own) - self.reach :] if len(own) > self.reach else own
        told, last = [], {}
        for (t, first), (size, share) in sorted(found.items(), key=lambda x: (x[0][1], x[0][0])):
            if self.templates[t].slack and first < last.get(t, 0):
                continue  # a view from the next piece
            last[t] = first + size
            told.append((t, first, size, share))
        return total, told


def pieces(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``PIECE`` bytes, cut between words."""
    at = 0
    while len(text) - at > PIECE:
        cut = _BREAK.search(text, at + PIECE)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


_BREAK = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def word_documents(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[bytes, int]:
    """In how many of all documents each template word stands; no more numbers than template words reach the driver."""
    known = sorted({word for t in templates for word in t.words})
    number = {word: i for i, word in enumerate(known)}
    vocabulary = frozenset(known)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(known), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in column_bytes(batch.column(0).slice(at, 256)):
                    there: set[bytes] = set()
                    for piece in pieces(text):
                        there |= vocabulary.intersection(words(piece))
                    for word in there:
                        held[number[word]] += 1
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at], pa.int64())], ["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {known[word]: n for word, n in counted.collect()}


_MATCHES = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first_word", pa.int64()), ("words", pa.int32()), ("share", pa.float64())]))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, matches array of (label, base, first_word, words, share)) of every document, in the order of the text."""
    index = Index(templates, word_documents(docs, templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = [], []
            for text in column_bytes(batch.column(1)):
                n, matches = index.matches(text)
                counts.append(n)
                found.append([{"label": templates[t].label, "base": templates[t].base, "first_word": first, "words": size, "share": share} for t, first, size, share in matches])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, _MATCHES)], ["doc_id", "n_words", "matches"])

    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return whole.mapInArrow(sliced(run, 256), "doc_id long, n_words long, matches array<struct<label string, base boolean, first_word long, words int, share double>>")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of the rows of ``scan``."""
    base = F.filter("matches", lambda m: m.base)
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: m.label))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m.first_word)).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m.first_word)).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m.share)), F.lit(0.0)).alias("score"),
    )
