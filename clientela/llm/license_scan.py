"""Licences in texts, found by their rarest words and where these stand.

An index holds, for every word of some licence texts, the templates and places it
has there. How rare a word is, the corpus says. A text looks up the rarest words
that it shares with a template; each occurrence votes for the place where the
template would begin, and where enough different words agree, mandatory phrases
of the template are verified word by word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from clientela.llm.batches import as_batch, text_chunks, texts_of

# Share of a template's weight in words that a text must have to be looked at,
# and that a place must have to count.
LEAST_SHARE = 0.6
# Rarest shared words that are looked up, and the share of them that must agree.
LOOKED_UP = 8
AGREEING = 0.5
# Words by which places in a text may shift against the template.
DRIFT = 12


@dataclass(frozen=True)
class Template:
    """Text of a licence, and phrases without which a text does not have it.

    A phrase is a template that is its own mandatory phrase: all words must stand
    as they do there.
    """

    label: str
    text: str
    mandatory: tuple[str, ...] = ()
    base: bool = False

    @property
    def is_phrase(self) -> bool:
        return not self.mandatory


# Phrases that name a licence, with its label.
PHRASES = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
)

# Well-known wordings of public licences and of the notices that refer to them.
TEMPLATES = (
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and"
        " associated documentation files the software to deal in the software without restriction including"
        " without limitation the rights to use copy modify merge publish distribute sublicense and or sell"
        " copies of the software and to permit persons to whom the software is furnished to do so",
        ("permission is hereby granted free of charge", "deal in the software without restriction"),
    ),
    Template(
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided"
        " that the following conditions are met redistributions of source code must retain the above copyright"
        " notice this list of conditions and the following disclaimer redistributions in binary form must"
        " reproduce the above copyright notice",
        ("redistribution and use in source and binary forms", "redistributions of source code must retain"),
    ),
    Template(
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is"
        " hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("permission to use copy modify", "with or without fee is hereby granted"),
    ),
    Template(
        "zlib-text",
        "this software is provided as is without any express or implied warranty in no event will the authors be"
        " held liable for any damages arising from the use of this software permission is granted to anyone to"
        " use this software for any purpose including commercial applications and to alter it and redistribute it freely",
        ("in no event will the authors be held liable", "alter it and redistribute it freely"),
    ),
    Template(
        "unlicense-text",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify"
        " publish use compile sell or distribute this software",
        ("free and unencumbered software", "released into the public domain"),
    ),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in"
        " compliance with the license you may obtain a copy of the license at",
        ("under the apache license version 2 0", "except in compliance with the license"),
    ),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template(
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu"
        " general public license as published by the free software foundation",
        ("redistribute it and or modify it under the terms of the gnu", "published by the free software foundation"),
    ),
    Template(
        "gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)
    ),
    Template(
        "gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)
    ),
    Template(
        "lgpl",
        "it under the terms of the gnu lesser general public license as published by the free software foundation",
        ("gnu lesser general public license",),
    ),
    Template(
        "mpl-2.0",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl"
        " was not distributed with this file you can obtain one at",
        ("subject to the terms of the mozilla public license",),
    ),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template(
        "cc-by-text", "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution 4 0",),
    ),
    Template("mit-notice", "released under the mit license", ("under the mit license",)),
)

# Bytes that separate words; letters become lower case.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and everything beyond ASCII, A-Z in lower case."""
    return text.translate(_WORDS).split()


@dataclass
class _Indexed:
    template: Template
    words: list[bytes]
    # Places of each word, rarest word first.
    places: dict[bytes, list[int]]
    weight: float
    mandatory: list[list[bytes]]


@dataclass
class LicenseIndex:
    """Templates by word and place, and the weight of their words."""

    idf: dict[bytes, float]
    templates: list[_Indexed]
    # What a text must share with a template at least for it to be looked at.
    postings: dict[bytes, list[int]] = field(default_factory=dict)

    def weight(self, words) -> float:
        return sum(self.idf[w] for w in sorted(words))


def build_index(
    frequencies: Mapping[bytes, int], documents: int, templates: Sequence[Template] = (*PHRASES, *TEMPLATES)
) -> LicenseIndex:
    """Index of ``templates``, words weighted by how few of the ``documents`` have them."""
    split = [words_of(t.text.encode()) for t in templates]
    vocabulary = sorted(set().union(*split)) if split else []
    idf = {w: log((documents + 2) / (frequencies.get(w, 0) + 1)) for w in vocabulary}
    index = LicenseIndex(idf, [])
    for template, words in zip(templates, split, strict=True):
        rarest = sorted(set(words), key=lambda w: (-idf[w], w))
        places = {w: [i for i, x in enumerate(words) if x == w] for w in rarest}
        mandatory = [words_of(m.encode()) for m in template.mandatory]
        number = len(index.templates)
        index.templates.append(_Indexed(template, words, places, index.weight(places), mandatory))
        # A text with the template has its rarest word, or the rarest mandatory one.
        needed = rarest if template.is_phrase else sorted(set().union(*mandatory), key=lambda w: (-idf[w], w))
        index.postings.setdefault(needed[0], []).append(number)
    return index


@dataclass(frozen=True)
class Place:
    """A licence in a text: label, first word, number of words, share of the
    template's weight that stands there, whether it is a base phrase."""

    label: str
    start: int
    length: int
    share: float
    base: bool


def find_licenses(words: list[bytes], index: LicenseIndex) -> list[Place]:
    """All places of all templates, by first word and label."""
    shared = index.idf.keys() & set(words)
    possible = [index.templates[n] for word in index.postings.keys() & shared for n in index.postings[word]]
    wanted = []
    for entry in possible:
        present = [w for w in entry.places if w in shared]
        if entry.template.is_phrase and len(present) < len(entry.places):
            continue
        if index.weight(present) >= LEAST_SHARE * entry.weight:
            wanted.append((entry, present[:LOOKED_UP]))
    if not wanted:
        return []
    looked_up = {w for _, present in wanted for w in present}
    at: dict[bytes, list[int]] = {w: [] for w in looked_up}
    for i, word in enumerate(words):
        if word in looked_up:
            at[word].append(i)
    found: set[Place] = set()
    for entry, present in wanted:
        look = _phrases if entry.template.is_phrase else _wordings
        found.update(look(entry, present, at, words, index))
    return sorted(found, key=lambda p: (p.start, p.label, p.length))


def _votes(entry: _Indexed, present: list[bytes], at: dict[bytes, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Where the template would begin, by each occurrence of each word, in order."""
    starts, voters = [], []
    for n, word in enumerate(present):
        for place in entry.places[word]:
            starts.append(np.array(at[word], np.int64) - place)
            voters.append(np.full(len(at[word]), n, np.int64))
    start, voter = np.concatenate(starts), np.concatenate(voters)
    order = np.argsort(start, kind="stable")
    return start[order], voter[order]


def _phrases(entry, present, at, words, index) -> Iterator[Place]:
    start, voter = _votes(entry, present, at)
    pairs = np.unique(np.stack([start, voter]), axis=1)
    begins, agreeing = np.unique(pairs[0], return_counts=True)
    size = len(entry.words)
    for begin in begins[agreeing == len(present)].tolist():
        if begin >= 0 and words[begin : begin + size] == entry.words:
            yield Place(entry.template.label, begin, size, 1.0, entry.template.base)


def _wordings(entry, present, at, words, index) -> Iterator[Place]:
    """Places where enough words agree within ``DRIFT`` and all mandatory phrases stand.

    Votes that follow each other within ``DRIFT`` are one group, and a group of
    enough different words is one place: its text reaches from the first vote to
    the template's length after the last, ``DRIFT`` words wider on both sides.
    """
    start, voter = _votes(entry, present, at)
    need = ceil(AGREEING * len(present))
    opens = np.flatnonzero(np.diff(start, prepend=start[0] - DRIFT - 1) > DRIFT)
    for a, b in zip(opens.tolist(), np.append(opens[1:], len(start)).tolist(), strict=True):
        if len(set(voter[a:b].tolist())) < need:
            continue
        low = max(0, int(start[a]) - DRIFT)
        high = min(len(words), int(start[b - 1]) + len(entry.words) + DRIFT)
        around = words[low:high]
        if not all(_contains(around, phrase) for phrase in entry.mandatory):
            continue
        have = entry.places.keys() & set(around)
        share = index.weight(have) / entry.weight if entry.weight else 1.0
        if share >= LEAST_SHARE:
            begin = max(0, int(start[a]))
            end = min(len(words), int(start[b - 1]) + len(entry.words))
            yield Place(entry.template.label, begin, end - begin, min(1.0, share), entry.template.base)


def _contains(words: list[bytes], phrase: list[bytes]) -> bool:
    size, at = len(phrase), -1
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return False
        if words[at : at + size] == phrase:
            return True


def learn_index(docs: DataFrame, templates: Sequence[Template] = (*PHRASES, *TEMPLATES)) -> LicenseIndex:
    """Index whose weights come from the whole texts of all ``docs``.

    One row per batch and template word leaves the tasks, and one per template
    word, which the templates bound, reaches the driver.
    """
    vocabulary = frozenset(w for t in templates for w in words_of(t.text.encode()))
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for rows in text_chunks(batch, "text"):
                for text in texts_of(rows, "text"):
                    seen.update(vocabulary.intersection(words_of(text)))
                    seen[b""] += 1
        yield as_batch(schema, [list(seen), list(seen.values())])

    counted = docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg({"n": "sum"})
    frequencies = {bytes(word): n for word, n in counted.collect()}
    return build_index(frequencies, frequencies.pop(b"", 0), templates)


_PLACE = pa.struct(
    [("label", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("share", pa.float64()), ("base", pa.bool_())]
)
_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(_PLACE))])


def scan_licenses(docs: DataFrame, index: LicenseIndex) -> DataFrame:
    """doc_id, n_words and the places of licences in each whole text, by first word.

    Null texts are empty and have no words. Rows are not told apart by their id.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_chunks(batch, "text"):
                found = []
                for text in texts_of(rows, "text"):
                    words = words_of(text)
                    found.append((len(words), [vars(p) for p in find_licenses(words, index)]))
                yield as_batch(_FOUND, [rows["doc_id"], *(list(x) for x in zip(*found, strict=True))])

    place = "struct<label: string, start: long, length: long, share: double, base: boolean>"
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id long, n_words long, places array<{place}>")
