"""Licence texts found by a positional index of rare words.

Templates are phrases, which must stand word by word, and texts, which are found by
likeness. The index has the places of every word in the templates. Of each document
the rarest licence words (by document frequency over all documents) are looked up;
where a word stands in the document less where it stands in a template is where a copy
would begin, and the other words and the key phrases are then verified from there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import ALNUM_WORDS, chunks, text_buffer, word_bytes, word_hashes, word_spans

#: Words may stand so many places from where they should, and so much of a template's words must stand there.
SHIFT = 6
LEAST_SHARE = 0.75
#: Bytes of text that are searched at a time.
TEXT_BYTES = 4 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Template(NamedTuple):
    """A licence's label and text; with `keys`, phrases that a copy must have, it is found by likeness, else word by word."""

    label: str
    text: str
    keys: tuple[str, ...] = ()


#: Phrases that name a licence.
BASE_PHRASES = [Template("gpl", "gnu general public license"), Template("apache", "apache license"), Template("cc-by", "cc by"), Template("mit", "mit license")]

#: Notices by which works are put under a licence, with what sets each apart from the others.
TEMPLATES = [
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license", "version 3")),
    Template(
        "gpl-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
        ("gnu general public license", "version 3"),
    ),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu general public license", "version 2")),
    Template("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3.", ("gnu lesser general public license", "version 3")),
    Template("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3.", ("gnu affero general public license", "version 3")),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0.", ("apache license", "version 2 0")),
    Template(
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        ("apache license", "version 2 0"),
    ),
    Template("mit", "Released under the MIT License.", ("mit license",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ("permission is hereby granted free of charge", "without restriction"),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        ("redistribution and use", "are permitted provided that"),
    ),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee", "is hereby granted")),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license", "2 0")),
    Template("cc-by-4.0", "Licensed under CC BY 4.0.", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0.", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0.", ("cc by nc 4 0",)),
    Template("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0.", ("cc by nd 4 0",)),
]


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


class Index:
    """The words of all templates with their places. `rarity` orders the words once document frequencies are known."""

    def __init__(self, phrases: list[Template], texts: list[Template]):
        found = {w for t in (*phrases, *texts) for part in (t.text, *t.keys) for w in words_of(part)}
        self.words = sorted(found)
        self.number = {w: i for i, w in enumerate(self.words)}
        at = lambda text: np.array([self.number[w] for w in words_of(text)], np.int64)
        self.phrases = [(t.label, at(t.text)) for t in phrases if words_of(t.text)]
        self.texts = [(t.label, at(t.text), [at(k) for k in t.keys]) for t in texts if words_of(t.text)]
        joined = b" ".join(self.words)
        starts, ends, _ = word_spans(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), ALNUM_WORDS)
        self.hashes = np.sort(word_hashes(np.frombuffer(joined, np.uint8), starts, ends)) if self.words else np.zeros(0, np.uint64)
        self.rarity = np.zeros(len(self.words), np.int64)


class Hits:
    """Where the index's words stand in some texts: `at` counts words over all texts, `first` has each text's first one."""

    def __init__(self, index: Index, column: pa.Array):
        raw, offsets = text_buffer(column)
        starts, ends, self.first = word_spans(raw, offsets, ALNUM_WORDS)
        hashes = word_hashes(raw, starts, ends)
        k = np.minimum(np.searchsorted(index.hashes, hashes), max(0, len(index.hashes) - 1))
        at = np.flatnonzero(index.hashes[k] == hashes) if len(index.hashes) else np.zeros(0, np.int64)
        coded = word_bytes(raw, starts[at], ends[at]).dictionary_encode()  # by the words themselves, so that equal hashes don't matter
        number = np.array([index.number.get(w, -1) for w in coded.dictionary.to_pylist()], np.int64)
        words = number[coded.indices.to_numpy(zero_copy_only=False)] if len(at) else np.zeros(0, np.int64)
        self.at, self.words = at[words >= 0], words[words >= 0]
        self.texts = np.searchsorted(self.first, self.at, side="right") - 1

    def places(self) -> list[np.ndarray]:
        """The ascending places of each word."""
        order = np.argsort(self.words, kind="stable")
        return np.split(self.at[order], np.cumsum(np.bincount(self.words, minlength=1))[:-1]) if len(order) else []


def standing(phrase: np.ndarray, places: list[np.ndarray], rarity: np.ndarray) -> np.ndarray:
    """Where the words of a phrase follow each other: places of the rarest one, shifted, intersected with those of the others."""
    found: np.ndarray | None = None
    for i in np.argsort(rarity[phrase], kind="stable").tolist():
        own = places[phrase[i]] - i if phrase[i] < len(places) else np.zeros(0, np.int64)
        found = own if found is None else found[np.isin(found, own, assume_unique=True)]
        if not len(found):
            break
    return found if found is not None else np.zeros(0, np.int64)


def best_copy(text: np.ndarray, keys: list[np.ndarray], places: list[np.ndarray], rarity: np.ndarray) -> tuple[float, int] | None:
    """(share, place) of the likeliest copy of a text in one document, or None.

    At a place, a word of the text counts if it stands within SHIFT of where it would in a copy that begins
    there, and key phrases must stand within the copy and SHIFT around. Of the words
    that the document has, the rarest are looked up, as many as can't all be missing from a copy.
    """
    needed = int(np.ceil(LEAST_SHARE * len(text)))
    there = np.array([w < len(places) and len(places[w]) > 0 for w in text])
    spare = int(there.sum()) - needed
    if spare < 0:
        return None
    order = np.flatnonzero(there)[np.argsort(rarity[text[there]], kind="stable")][: spare + 1]
    begins = np.unique(np.concatenate([(places[text[i]] - i)[:, None] + np.arange(-SHIFT, SHIFT + 1) for i in order]).ravel())
    count = np.zeros(len(begins), np.int64)
    for i in np.flatnonzero(there).tolist():
        own, want = places[text[i]], begins + i
        right = np.minimum(np.searchsorted(own, want), len(own) - 1)
        count += np.minimum(np.abs(own[right] - want), np.abs(own[np.maximum(right - 1, 0)] - want)) <= SHIFT
    good = count >= needed
    for key in keys:
        found = standing(key, places, rarity)
        good &= np.searchsorted(found, begins + len(text) + SHIFT - len(key), "right") > np.searchsorted(found, begins - SHIFT, "left")
    if not good.any():
        return None
    begins, count = begins[good], count[good]
    k = int(np.argmax(count))
    return int(count[k]) / len(text), int(begins[k])


_OUT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "places array<struct<label: string, at: long, share: double>>"
)
_PLACES = pa.list_(pa.struct([("label", pa.string()), ("at", pa.int64()), ("share", pa.float64())]))


def search(index: Index, column: pa.Array) -> list[pa.Array]:
    """The columns of `scan` for some texts."""
    hits = Hits(index, column)
    n, first = len(column), hits.first
    base: list[dict[str, list[int]]] = [{} for _ in range(n)]
    every = hits.places()
    for label, phrase in index.phrases:
        found = standing(phrase, every, index.rarity)
        of = np.searchsorted(first, found, side="right") - 1
        for text, at in zip(of.tolist(), found.tolist()):
            if at + len(phrase) <= first[text + 1]:
                base[text].setdefault(label, []).append(at - int(first[text]))
    has = np.zeros((n, max(1, len(index.words))), bool)
    has[hits.texts, hits.words] = True
    copies: list[dict[str, tuple[float, int]]] = [{} for _ in range(n)]
    begin = np.searchsorted(hits.texts, np.arange(n + 1))
    own: dict[int, list[np.ndarray]] = {}
    for label, text, keys in index.texts:
        # only documents with enough of the words at all, and with those of the key phrases
        likely = has[:, text].sum(axis=1) >= np.ceil(LEAST_SHARE * len(text))
        for key in keys:
            likely &= has[:, key].all(axis=1)
        for i in np.flatnonzero(likely).tolist():
            if i not in own:
                words, at = hits.words[begin[i] : begin[i + 1]], hits.at[begin[i] : begin[i + 1]] - first[i]
                order = np.argsort(words, kind="stable")
                own[i] = np.split(at[order], np.cumsum(np.bincount(words))[:-1])
            got = best_copy(text, keys, own[i], index.rarity)
            if got is not None and got[0] > copies[i].get(label, (0.0, 0))[0]:
                copies[i][label] = got
    starts = [[x for xs in b.values() for x in xs] for b in base]
    places = [sorted([(label, at, 1.0) for label, xs in b.items() for at in xs] + [(label, at, share) for label, (share, at) in c.items()]) for b, c in zip(base, copies)]
    return [
        pa.array(np.diff(first), pa.int64()), pa.array([len(x) for x in starts], pa.int64()), pa.array([min(x, default=None) for x in starts], pa.int64()), pa.array([max(x, default=None) for x in starts], pa.int64()),
        pa.array([",".join(sorted(b)) for b in base]), pa.array([",".join(sorted({*b, *c})) for b, c in zip(base, copies)]), pa.array([max((x[2] for x in p), default=0.0) for p in places], pa.float64()),
        pa.array([[{"label": a, "at": b, "share": c} for a, b, c in p] for p in places], _PLACES),
    ]


def _parts(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j in chunks(text_buffer(batch[text])[1], TEXT_BYTES):
            yield batch.slice(i, j - i)


def rarity(docs: DataFrame, index: Index, text: str = "text") -> np.ndarray:
    """How many of all documents have each word of the index, summed in tasks and then by Spark; as many rows as the templates have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(index.words), np.int64)
        for batch in _parts(batches, text):
            hits = Hits(index, batch[text])
            pairs = np.unique(hits.texts * max(1, len(counts)) + hits.words)
            counts += np.bincount(pairs % max(1, len(counts)), minlength=len(counts))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], names=["word", "n"])

    out = np.zeros(len(index.words), np.int64)
    for word, n in docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n")).collect():
        out[word] = n
    return out


def scan(docs: DataFrame, phrases: list[Template], texts: list[Template], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_words, n_base, first_word, last_word, base_labels, labels, score, places) for every document.

    `n_base` places of phrases, the first and the last one's first word (from 0, else null), and their labels; `labels` has
    those of texts too. `score` is the best share of a template's words, 1 for a phrase, 0 without any; `places` has all
    phrases and the best copy of each label's texts (its place may lie outside where its begin or end is cut off). A null text is an empty one, without words or
    labels; null keys and repeated rows have a row each; an empty table gives no rows; other columns are not read.
    """
    index = Index(phrases, texts)
    index.rarity = rarity(docs, index, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, text):
            yield pa.RecordBatch.from_arrays([batch[key], *search(index, batch[text])], names=[key, *(x.split()[0] for x in _OUT.split(", ")[:7]), "places"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, {_OUT}")
