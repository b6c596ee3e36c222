"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from chatloom.llm.common import with_arrow

# Notices and openings of public licences by family: fixed values. They are templates for the
# comparison and the source of the training paragraphs.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "This software is licensed under the MIT license. See LICENSE for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "Released under the GNU General Public License, version 2 or later.",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
    ),
    "BSD": (
        "Released under the 3-Clause BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "Public-Domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work. Released under CC0 1.0.",
    ),
}
UNKNOWN = "unknown"
FAMILIES = (*TEMPLATES, UNKNOWN)
# At most so many distinct paragraphs of the corpus, those with the smallest hashes, train the unknown
# class; of a longer one the first HEAD characters.
BACKGROUND, HEAD = 3000, 2000
# A paragraph of a family is confirmed if it shares this much with a template.
LIKENESS = 0.6
# A paragraph without a word that names or tells of a licence is confirmed if it shares this many pairs
# of words with a template: fewer, as in "and the" or "can be found in the", are plain English.
UNNAMED_PAIRS = 8
_NAMED = re.compile(
    r"licen[cs]|copyright|permission|public domain|redistribut|warrant|waived|cc0|gnu|mozilla|creative commons"
    r"|unencumbered|\b(?:mit|bsd|apache|l?gpl|mpl|cc|by-sa|by-nc)\b",
    re.I,
)
_WORD = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def grams(text: str) -> list[str]:
    """Words and pairs of neighbouring words of a paragraph, lower-cased."""
    words = _WORD.findall(text.lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


@dataclass
class Classifier:
    """Sparse logistic regression over the families and the unknown class."""

    places: dict[str, int]
    weights: np.ndarray  # families x (grams, share of unknown grams, constant)
    warmth: float = 1.0  # divides the scores, set on held-out paragraphs

    def row(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of a paragraph's features; each counted gram weighs 1 / sqrt(all grams)."""
        words = _WORD.findall(text.lower())
        places, many, known, hits, before = self.places, max(1, 2 * len(words) - 1), set(), 0, None
        for word in words:  # a pair is known only if both of its words are
            at = places.get(word)
            if at is not None:
                known.add(at)
                hits += 1
                if before is not None and (pair := places.get(f"{before} {word}")) is not None:
                    known.add(pair)
                    hits += 1
                before = word
            else:
                before = None
        size = many**0.5
        n = len(places)
        return np.array([*sorted(known), n, n + 1]), np.array([1 / size] * len(known) + [1 - hits / many, 1.0])

    def probabilities(self, text: str) -> np.ndarray:
        at, values = self.row(text)
        scores = self.weights[:, at] @ values / self.warmth
        scores = np.exp(scores - scores.max())
        return scores / scores.sum()


def training_paragraphs(seed: int = 5, each: int = 120) -> list[tuple[str, str]]:
    """Variants of the templates: neighbours dropped, prefixed by names and years, or joined."""
    draw = np.random.default_rng(seed)
    out = []
    names = ("copyright 2021 the authors", "see the file for details", "all rights reserved", "(c) 2019 jane doe")
    for family, templates in TEMPLATES.items():
        for k in range(each):
            text = templates[k % len(templates)]
            words = text.split()
            if len(words) > 12 and draw.random() < 0.6:
                start = int(draw.integers(0, len(words) - 10))
                words = words[start : start + int(draw.integers(10, len(words) - start + 1))]
            elif draw.random() < 0.4:
                words = words + templates[int(draw.integers(len(templates)))].split()
            if draw.random() < 0.3:
                words = [w for w in words if draw.random() > 0.06]
            if draw.random() < 0.4:
                words = names[int(draw.integers(len(names)))].split() + words
            out.append((" ".join(words), family))
    # Sentences about licences that name no family.
    for text in (
        "You need a driving licence to rent a car.",
        "The license fee is due every month and the version changes.",
        "The public library is free and general terms apply to all work.",
        "Ask the author for permission before you use this work.",
        "The software was released in version 2.0 last year.",
        "A copy of the notice was distributed to the public.",
    ):
        out += [(text, UNKNOWN)] * (each // 6)
    return out


def trained(background: list[str], rounds: int = 300, decay: float = 1e-4) -> Classifier:
    """Fit the classifier by full gradient steps and set its warmth on a fifth held out."""
    labelled = training_paragraphs() + [(t, UNKNOWN) for t in background]
    places: dict[str, int] = {}
    for text, family in labelled:
        if family != UNKNOWN:
            for g in grams(text):
                places.setdefault(g, len(places))
    model = Classifier(places, np.zeros((len(FAMILIES), len(places) + 2)))
    rows = [model.row(t) for t, _ in labelled]
    target = np.array([FAMILIES.index(f) for _, f in labelled])
    dense = np.zeros((len(rows), len(places) + 2), np.float32)
    for i, (at, values) in enumerate(rows):
        dense[i, at] = values
    held = np.arange(len(rows)) % 5 == 4
    # Every family weighs alike, however many background paragraphs there are.
    weight = (1.0 / np.bincount(target[~held], minlength=len(FAMILIES)))[target]
    x, y, w = dense[~held], target[~held], weight[~held] / weight[~held].sum()
    goal = np.eye(len(FAMILIES))[y]
    speed = np.zeros_like(model.weights)
    for _ in range(rounds):
        scores = x @ model.weights.T
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        gradient = ((scores / scores.sum(axis=1, keepdims=True) - goal) * w[:, None]).T @ x + decay * model.weights
        speed = 0.9 * speed - 6.0 * gradient
        model.weights += speed
    scores = dense[held] @ model.weights.T

    def loss(warmth: float) -> float:
        s = scores / warmth
        s -= s.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), target[held]]))

    model.warmth = min((0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    return model


@cache
def _template_pairs(family: str) -> list[set[str]]:
    return [{g for g in grams(template) if " " in g} for template in TEMPLATES.get(family, ())]


def template_likeness(text: str, family: str) -> float:
    """Largest share of pairs of words that a paragraph and a template of the family have in common,
    of the shorter one's pairs."""
    own = {g for g in grams(text) if " " in g}
    best = 0.0
    for other in _template_pairs(family):
        if own and other:
            best = max(best, len(own & other) / min(len(own), len(other)))
    return best


def confirmed(text: str, family: str, likeness: float) -> bool:
    """If a paragraph is near a template of the family by more than a few common words."""
    if likeness < LIKENESS or _NAMED.search(text):
        return likeness >= LIKENESS
    own = set(grams(text))
    return any(len(own & other) >= UNNAMED_PAIRS for other in _template_pairs(family))


def background_paragraphs(docs: DataFrame, most: int = BACKGROUND) -> list[str]:
    """A bounded sample of the corpus: the distinct paragraphs with the smallest hashes that are near no template."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, str] = {}
        bound, refused = 1 << 63, set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for line in (text or "").split("\n"):
                    h = xxh3_64_intdigest(line) >> 1
                    if h >= bound or h in kept or h in refused or not line or line.isspace():
                        continue
                    if any(confirmed(line, f, template_likeness(line, f)) for f in TEMPLATES):
                        refused.add(h)
                        continue
                    kept[h] = line[:HEAD]
                    if len(kept) >= 2 * most:
                        for h in sorted(kept)[most:]:
                            bound = h if h < bound else bound
                            del kept[h]
                        refused = {h for h in refused if h < bound}
        first = sorted(kept)[:most]
        yield pa.RecordBatch.from_arrays(
            [pa.array(first, pa.int64()), pa.array([kept[h] for h in first], pa.string())], names=["h", "line"]
        )

    found = docs.select("text").mapInArrow(smallest, "h long, line string").distinct()
    return [r.line for r in found.orderBy("h", "line").limit(most).collect()]


def licence_scan(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """All rows and columns of `docs` with the licences found in their paragraphs (lines).

    n_paragraphs; family, probability and likeness of the confirmed paragraph with the highest
    probability (first wins ties; null if none); families, all confirmed ones, sorted, joined by
    commas; unknown_paragraphs, those that no family explains. Every paragraph is scored; one without
    any word of the templates is unknown whatever the weights. A prediction is confirmed if it is a family, more probable than not, and near one of its templates.

    The classifier is trained on variants of the templates and at most BACKGROUND paragraphs of
    `docs` unless one is given. Null or empty text: no paragraphs. Repeated rows are scanned alike. An empty table gives
    an empty result. Columns of `docs` named like a result are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or trained(background_paragraphs(docs)))

    def scan(texts: list) -> list:
        model = sent.value
        rows = []
        for text in texts:
            best, found, strange, many = (0.0, None, None), set(), 0, 0
            for line in (text or "").split("\n"):
                if not line or line.isspace():
                    continue
                many += 1
                odds = model.probabilities(line)
                at = int(odds.argmax())
                family = FAMILIES[at]
                near = template_likeness(line, family) if family != UNKNOWN else 0.0
                if family == UNKNOWN or odds[at] < 0.5 or not confirmed(line, family, near):
                    strange += 1
                    continue
                found.add(family)
                if odds[at] > best[0]:
                    best = (float(odds[at]), family, near)
            shown = best if best[1] else (None, None, None)
            rows.append((many, shown[1], shown[0], shown[2], ",".join(sorted(found)), strange))
        return list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]

    return with_arrow(
        docs,
        ["text"],
        "n_paragraphs long, family string, probability double, likeness double, families string, unknown_paragraphs long",
        scan,
    )
