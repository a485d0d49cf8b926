"""Licence scans by a positional index of rare tokens.

Notices of well-known licences are the templates. A first pass counts, over all documents, in how many of them each template
word occurs (one row per word and task, one group-by); what reaches the driver is one number per template word, bounded
by the templates. The second pass looks up, in each file, the words of highest inverse document frequency that a template
has, as many per template as ``RAREST`` and the rarest word of each of its key phrases in any case. Every occurrence,
less the places of that word in the template, says where the notice would begin; places of neighbouring begin (``DRIFT`` words or
less apart, for words put in or left out) are one candidate. It is a find if every mandatory key phrase of the template
stands within that drift of its place. No candidate is dropped: a notice with its key phrases has at least their rarest
words looked up.

A find's share is the frequency-weighted part of the template's words that stand within the drift of their places. A
document's score is the best share of its finds, 0 without any. Base phrases are looked for on their own, wherever they
stand.

Edge cases: a null or empty text has no words, labels or score; repeated rows give a row each; a null doc_id is an
ordinary document; other columns are ignored; an empty table gives no rows. With no documents all words weigh alike.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.llm.common import plain_words, slices

RAREST, DRIFT = 6, 5

# Phrases that label a text wherever they stand.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Fixed values: (label, wording of the public licence's notice, its mandatory key phrases).
TEMPLATES = (
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
            "publish, distribute, sublicense, and/or sell copies of the Software",
     ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("apache", "Licensed under the Apache License", ("apache license",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0", ("not use this file except in compliance with the license", "apache org licenses license 2 0")),
    ("gpl", "This work is licensed under the GNU General Public License", ("general public license",)),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("general public license version 3",)),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ("general public license version 2",)),
    ("gpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
                "Foundation, either version 3 of the License, or (at your option) any later version",
     ("under the terms of the gnu general public license", "either version 3 of the license")),
    ("gpl-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
                "Foundation; either version 2 of the License, or (at your option) any later version",
     ("under the terms of the gnu general public license", "either version 2 of the license")),
    ("lgpl", "licensed under the GNU Lesser General Public License", ("lesser general public license",)),
    ("agpl", "licensed under the GNU Affero General Public License", ("affero general public license",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license v 2 0",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
     ("redistribution and use in source and binary forms", "following conditions are met")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
            "above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee", "appear in all copies")),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("cc0-1.0", "released under CC0 1.0 Universal", ("cc0 1 0",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-nc-4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial 4 0",)),
    ("all-rights-reserved", "All rights reserved", ("all rights reserved",)),
)


def _words(text: str) -> list[bytes]:
    return plain_words(text.encode())


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where *phrase* stands in *words*, overlaps included."""
    out, at, size = [], -1, len(phrase)
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at:at + size] == phrase:
                out.append(at)
    except ValueError:
        return out


@dataclass
class Template:
    label: str
    words: list[bytes]
    #: (phrase, its place in the template)
    keys: list[tuple[list[bytes], int]]
    needed: frozenset[bytes] = field(init=False)
    places: dict[bytes, list[int]] = field(init=False)

    def __post_init__(self):
        self.needed = frozenset(word for key, _ in self.keys for word in key)
        self.places = defaultdict(list)
        for at, word in enumerate(self.words):
            self.places[word].append(at)


def template(label: str, text: str, keys: tuple[str, ...]) -> Template:
    words, found = _words(text), []
    for key in map(_words, keys):
        at = places(words, key)
        if not at:
            raise ValueError(f"{label}: a key phrase has to be part of its template")
        found.append((key, at[0]))
    return Template(label, words, found)


class Scanner:
    """Finds templates in a file's words. *idf* gives a template word's inverse document frequency."""

    def __init__(self, templates: list[Template], idf: dict[bytes, float], rarest: int = RAREST, drift: int = DRIFT):
        self.templates, self.idf, self.rarest, self.drift = templates, idf, rarest, drift
        self.vocabulary = frozenset(word for x in templates for word in x.words)
        self.totals = [sum(idf[word] for word in x.words) for x in templates]

    def _looked_up(self, of: Template, present: frozenset[bytes]) -> set[bytes]:
        """The file's rarest words of a template, and the rarest of each of its key phrases."""
        rank = lambda word: (-self.idf[word], word)
        held = sorted(present.intersection(of.places), key=rank)
        return {*held[:self.rarest], *(min(key, key=rank) for key, _ in of.keys)}

    def _share(self, of: Template, total: float, where: dict[bytes, list[int]], low: int, high: int) -> float:
        """Weighted part of the template's words within the drift of where they belong."""
        found = 0.0
        for at, word in enumerate(of.words):
            if any(low + at - self.drift <= place <= high + at + self.drift for place in where.get(word, ())):
                found += self.idf[word]
        return min(found / total, 1.0) if total else 0.0

    def finds(self, words: list[bytes]) -> list[tuple[str, int, float]]:
        """(label, where the notice would begin, share) of each find."""
        present = self.vocabulary.intersection(words)
        alive = [number for number, x in enumerate(self.templates) if x.needed <= present]
        if not alive:
            return []
        wanted = {word for number in alive for word in self.templates[number].places}
        where: dict[bytes, list[int]] = defaultdict(list)
        for at, word in enumerate(words):
            if word in wanted:
                where[word].append(at)
        out = []
        for number in alive:
            of = self.templates[number]
            keys = [places(words, key) for key, _ in of.keys]
            if not all(keys):
                continue
            begins = sorted({place - at for word in self._looked_up(of, present) for place in where[word] for at in of.places[word]})
            low = high = begins[0]
            for begin in [*begins[1:], None]:
                if begin is not None and begin - high <= self.drift:
                    high = begin
                    continue
                if all(any(low + at - self.drift <= place <= high + at + self.drift for place in found)
                       for found, (_, at) in zip(keys, of.keys, strict=True)):
                    out.append((of.label, low, self._share(of, self.totals[number], where, low, high)))
                if begin is not None:
                    low = high = begin
        return out


def _documents_with(vocabulary: frozenset[bytes]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: Counter[bytes] = Counter()
        for batch in (part for whole in batches for part in slices(whole)):
            for data in batch.column("data").to_pylist():
                times.update(vocabulary.intersection(plain_words(data or b"")))
                times[b""] += 1  # no word: all documents
        yield pa.record_batch({"word": pa.array(list(times), pa.binary()), "n": pa.array(list(times.values()), pa.int64())})

    return count


def frequencies(docs: DataFrame, templates: list[Template]) -> dict[bytes, float]:
    """Inverse document frequency of every word of *templates* over all documents."""
    vocabulary = frozenset(word for x in templates for word in x.words)
    counted = docs.select(F.col("text").cast("binary").alias("data")).mapInArrow(_documents_with(vocabulary), "word binary, n long")
    times = {bytes(r.word): r.n for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = times.get(b"", 0)
    return {word: math.log((total + 2) / (times.get(word, 0) + 1)) for word in sorted(vocabulary)}


FINDS = pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int64()), ("share", pa.float64())]))
SCHEMA = ("doc_id long, n_words long, base array<struct<label: string, place: long>>, "
          "finds array<struct<label: string, begin: long, share: double>>")


def _scanned(scanner: Scanner, base: dict[str, str]):
    phrases = [(_words(phrase), label) for phrase, label in base.items()]
    pairs = pa.list_(pa.struct([("label", pa.string()), ("place", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            counts, bases, finds = [], [], []
            for data in batch.column("data").to_pylist():
                words = plain_words(data or b"")
                counts.append(len(words))
                bases.append([{"label": label, "place": at} for phrase, label in phrases for at in places(words, phrase)])
                finds.append([{"label": label, "begin": begin, "share": share} for label, begin, share in scanner.finds(words)])
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": pa.array(counts, pa.int64()),
                                   "base": pa.array(bases, pairs), "finds": pa.array(finds, FINDS)})

    return scan


def scan_licenses(docs: DataFrame, templates: tuple = TEMPLATES, base: dict[str, str] | None = None, rarest: int = RAREST, drift: int = DRIFT) -> DataFrame:
    """(doc_id, n_words, base, finds): places of base phrases, and notices found with where they begin and their share."""
    made = [template(*x) for x in templates]
    scanner = Scanner(made, frequencies(docs, made), rarest, drift)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    return texts.mapInArrow(_scanned(scanner, BASE if base is None else base), SCHEMA)
