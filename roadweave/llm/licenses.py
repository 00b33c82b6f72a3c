"""Operator 12: licence scans by a positional index of rare template words.

Templates are short licence texts with key phrases. Over all documents it is counted how many hold each
template word; that gives the words' weights (inverse document frequencies). A template stands at a
place if words of at least ``COVER`` of its weight are where the place puts them, give or take ``SLACK``
words, and each of its key phrases stands within it word by word.

Such a place has at least one of the template's anchors: its heaviest words, as many as weigh more than
the rest may miss. The index has the anchors alone, with their templates and positions. A file's words
are looked up there; each hit gives the places the template would have, and only these are weighed,
with all other words of the template. So the places found are all there are (no cap on hits, places
or words).

Beside that, base phrases are counted word by word, whatever the templates say.

Defined results: null and empty texts have no words and no labels (an empty string) and score 0; the
score is that of the best place, 1 where a base phrase stands; repeated rows give repeated results;
very long texts are scanned whole; an empty table gives an empty table; other columns pass through,
but for those that have the names of outputs, which are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, portions, without

#: Least share of a template's weight, and how many words its parts may be displaced.
COVER = 0.75
SLACK = 2
#: Phrases and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Notices of public licences (label, text, key phrases).
TEMPLATES = [
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Licensed under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ["permission is hereby granted", "without restriction"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["apache org licenses license 2 0"]),
    ("gpl-2.0", "This program is licensed under the GNU General Public License, version 2", ["general public license version 2"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ["general public license version 3"]),
    ("gpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["general public license", "version 3"]),
    ("lgpl", "licensed under the GNU Lesser General Public License", ["lesser general public license"]),
    ("agpl-3.0", "licensed under the GNU Affero General Public License, version 3", ["affero general public license"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["endorse or promote products"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["unencumbered software"]),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", ["cc by nc sa 4 0"]),
    ("cc0-1.0", "Released under CC0 1.0 Universal public domain dedication", ["cc0 1 0"]),
]

_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of 0-9, a-z and everything beyond ASCII; A-Z counts as a-z."""
    return text.translate(_WORDS).split()


@dataclass
class Template:
    label: str
    words: list[bytes]
    keys: list[list[bytes]]

    @classmethod
    def of(cls, label: str, text: str, keys: Iterable[str]) -> Template:
        return cls(label, words_of(text.encode()), [words_of(k.encode()) for k in keys])


class Index:
    """Weighed templates and, for each anchor word, the templates and positions where it is an anchor."""

    def __init__(self, templates: list[tuple[str, str, list[str]]], base: list[tuple[str, str]], frequency: dict[bytes, int], documents: int):
        self.templates = [Template.of(*t) for t in templates]
        self.base = [(words_of(p.encode()), label) for p, label in base]
        self.weights = [[math.log((documents + 1) / (frequency.get(w, 0) + 1)) + 0.01 for w in t.words] for t in self.templates]
        self.anchors: dict[bytes, list[tuple[int, int]]] = {}
        for t, (template, weights) in enumerate(zip(self.templates, self.weights, strict=True)):
            # ties by position; more weight than a place may lack, with some room for rounding
            left = (1 - COVER) * sum(weights) + 1e-6
            for p in sorted(range(len(weights)), key=lambda p: (-weights[p], p)):  # noqa: B023
                self.anchors.setdefault(template.words[p], []).append((t, p))
                left -= weights[p]
                if left < 0:
                    break
        self.marks = {*self.anchors, *(phrase[-1] for phrase, _ in self.base)}
        self.known = {w for t in self.templates for w in [*t.words, *sum(t.keys, [])]} | {w for phrase, _ in self.base for w in phrase}

    def scanned(self, words: list[bytes]) -> tuple[np.ndarray, set[str], list[tuple[str, int, int, float]]]:
        """Starts of base phrases, their labels, and the best place (label, start, words, score) of each template that stands."""
        if self.marks.isdisjoint(words):
            return np.zeros(0, np.int64), set(), []
        at: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.known:
                at.setdefault(w, []).append(i)
        places = {w: np.array(i, np.int64) for w, i in at.items()}
        starts, labels = [np.zeros(0, np.int64)], set()
        for phrase, label in self.base:
            if len(found := _standing(places, phrase)):
                starts.append(found)
                labels.add(label)
        hits: dict[int, list[np.ndarray]] = {}
        for w, posts in self.anchors.items():
            if w in places:
                for t, p in posts:
                    hits.setdefault(t, []).append(places[w] - p)
        found = [one for t, at in hits.items() if (one := self._best(t, places, at))]
        return np.sort(np.concatenate(starts)), labels, sorted(found)

    def _best(self, t: int, places: dict[bytes, np.ndarray], hits: list[np.ndarray]) -> tuple[str, int, int, float] | None:
        template, weights = self.templates[t], self.weights[t]
        at = np.unique(np.add.outer(np.concatenate(hits), np.arange(-SLACK, SLACK + 1)))
        covered = np.zeros(len(at))
        for p, (w, weight) in enumerate(zip(template.words, weights, strict=True)):
            covered += weight * _within(places.get(w), at + p - SLACK, at + p + SLACK)
        covered /= sum(weights)
        ok = covered >= COVER - 1e-9
        for key in template.keys:
            if not ok.any():
                return None
            ok[ok] = _within(_standing(places, key), at[ok] - SLACK, at[ok] + len(template.words) + SLACK - len(key))
        if not ok.any():
            return None
        top = covered[ok].max()
        at = at[ok & (covered >= top - 1e-9)]
        # of displaced ones that weigh as much, the place that puts most words where they are
        exact = sum(_within(places.get(w), at + p, at + p).astype(np.int64) for p, w in enumerate(template.words))
        return template.label, max(0, int(at[exact.argmax()])), len(template.words), min(1.0, float(top))


def _standing(places: dict[bytes, np.ndarray], phrase: list[bytes]) -> np.ndarray:
    """Where the words of the phrase stand one after the other."""
    out = places.get(phrase[0], np.zeros(0, np.int64))
    for k, w in enumerate(phrase[1:], 1):
        out = out[np.isin(out + k, places.get(w, np.zeros(0, np.int64)), assume_unique=True)]
    return out


def _within(found: np.ndarray | None, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether one of the sorted places ``found`` is from low to high."""
    if found is None or not len(found):
        return np.zeros(len(low), bool)
    first = np.searchsorted(found, low)
    return (first < len(found)) & (found[np.minimum(first, len(found) - 1)] <= high)


def frequencies(docs: DataFrame, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """How many of all documents hold each word of the vocabulary, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        rows = 0
        for b in portions(batches, "text"):
            rows += b.num_rows
            for x in b.column("text"):
                for w in vocabulary.intersection(words_of(x.as_py() or b"")):
                    counts[w] = counts.get(w, 0) + 1
        yield pa.RecordBatch.from_pydict({"word": pa.array([*counts, None], pa.binary()), "n": pa.array([*counts.values(), rows], pa.int64())})

    told = docs.select(F.encode("text", "UTF-8").alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {None if r.word is None else bytes(r.word): r.n for r in told}
    return found, found.pop(None, 0)


def scan(docs: DataFrame, templates: list[tuple[str, str, list[str]]] = TEMPLATES, base: list[tuple[str, str]] = BASE) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and places (label, start, words, score)."""
    outputs = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
    outputs["places"] = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int64()), ("score", pa.float64())]))
    docs = without(docs, [*outputs])
    vocabulary = {w for t in templates for w in Template.of(*t).words}
    index = Index(templates, base, *frequencies(docs, vocabulary))
    text = fresh(docs.columns, "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, text):
            rows: list[tuple] = []
            for x in b.column(text):
                words = words_of(x.as_py() or b"")
                starts, labels, found = index.scanned(words)
                every = labels | {label for label, *_ in found}
                score = 1.0 if labels else max((one[-1] for one in found), default=0.0)
                ends = (int(starts[0]), int(starts[-1])) if len(starts) else (None, None)
                rows.append((len(words), len(starts), *ends, ",".join(sorted(labels)), ",".join(sorted(every)), score, [dict(zip(("label", "start", "words", "score"), one, strict=True)) for one in found]))
            kept = b.select([c for c in b.schema.names if c != text])
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(outputs.values())]
            yield pa.RecordBatch.from_arrays([*kept.columns, *made], names=[*kept.schema.names, *outputs])

    given = docs.select("*", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias(text))
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return given.mapInArrow(run, schema + ", n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,start:long,words:long,score:double>>")
