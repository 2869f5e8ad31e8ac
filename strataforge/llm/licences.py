"""Operator 2: licence scans by a trained paragraph classifier."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.llm.arrow_text import LOWER, WORD_BYTES, gram_hashes, rows_per_batch, spans, steps, word_hashes

#: Clean paragraphs that teach the class of other text (about), copies of a template with changes, share of a template's grams that confirms it,
#: parts of the templates that are held out in turn to calibrate.
OTHER_ROWS, VARIANTS, CONFIRM, FOLDS = 4000, 40, 0.6, 3
#: Words of a paragraph, drawn by its hash, that variants are mixed with.
FILLERS = 16
# Names of licences and words before a notice's verb that make it none.
OTHER_NAMES = "EUPL Artistic Zlib OpenSSL CeCILL Ruby PHP Sleepycat Unilever Driving Fishing Broadcast Trade Hunting Premium Acme Standard Commercial Marriage Liquor".split()
DENIALS = ("not", "never", "no longer", "not yet")
#: A calibrated probability of any licence under this is unknown; families of at least ``LIKELY`` are compared with their templates.
SURE, LIKELY = 0.5, 0.05

# Notices by licence family.
TEMPLATES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at www.apache.org/licenses/LICENSE-2.0.",
        "Licensed under Apache-2.0.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc0": [
        "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain worldwide.",
        "Released into the public domain under CC0 1.0.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Licensed under GPL-2.0.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
        "This project is MIT licensed.",
        "Distributed under the MIT licence.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0.",
    ],
    "proprietary": [
        "Copyright. All rights reserved. No part of this publication may be reproduced or distributed in any form without prior written permission.",
        "All rights reserved.",
        "No part of this publication may be reproduced or distributed in any form without prior written permission.",
        "This software is confidential and proprietary; unauthorized copying is strictly prohibited.",
    ],
}

#: Lines between two parts of one notice.
GAP = 6
#: Neighbouring lines that are read as one, for notices that are wrapped: as many as the longest template has words, since each line of it has one.
LINES = max(len(t.split()) for own in TEMPLATES.values() for t in own)

_WORD = re.compile(r"[0-9a-z_\u0080-\U0010ffff]+")
_BREAK = 0x0A


def grams(text: str) -> list[str]:
    """Distinct words and word pairs."""
    w = _WORD.findall(text.translate({i: i + 32 for i in range(65, 91)}))
    return list(dict.fromkeys([*w, *map(" ".join, zip(w, w[1:], strict=False))]))


def _hashes(own: list[str]) -> np.ndarray:
    out = np.zeros(len(own), np.uint64)
    for i, g in enumerate(own):
        data = np.frombuffer(g.encode(), np.uint8)
        start, end, first = spans(data, np.array([0, len(data)]), WORD_BYTES)
        out[i] = gram_hashes(word_hashes(data, start, end), first, len(start))[0][0]
    return out


def _vocabulary() -> list[str]:
    """All grams of the templates, and the pairs of a denial and what it denies."""
    own = dict.fromkeys(g for f in sorted(TEMPLATES) for t in TEMPLATES[f] for g in grams(t))
    return [*own, *(g for d in DENIALS for v in VERBS if (g := f"{d.split()[-1]} {v}") not in own), *(w for d in DENIALS for w in d.split() if w not in own)]


VERBS = ("licensed", "released", "distributed", "covered", "available")


def denied(text: str, denial: str) -> str | None:
    """A notice with a denial before its first verb; None if it has none."""
    m = re.search(rf"(?i)\b({'|'.join(VERBS)})\b", text)
    return None if m is None else f"{text[: m.start()]}{denial} {text[m.start() :]}"


class Classifier:
    """Multinomial logistic regression over the word n-grams of the templates; class 0 is other text.

    A gram that no template has weighs nothing, so a paragraph without any
    is other text and needs no work. Probabilities are calibrated by a temperature. It is fitted on
    predictions for templates that were not learned from, each part of the templates held out in turn with all its
    variants; a family that has no other template counts as other text there. Notices of unknown licences and
    notices that are denied are other text too.

    ``others`` has, for each paragraph of other text, the places of its grams in ``_vocabulary()``.
    """

    def __init__(self, others: list[list[int]], filler: list[str], rounds: int = 300) -> None:
        rng = np.random.Generator(np.random.PCG64(11))
        self.families = sorted(TEMPLATES)
        vocabulary = _vocabulary()
        place = {g: i for i, g in enumerate(vocabulary)}
        hashes = _hashes(vocabulary)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        filler = filler or ["text"]
        draw = lambda n: [filler[i] for i in rng.integers(len(filler), size=n)]
        rows: list[list[int]] = list(others)
        label, fold = [0] * len(others), [i % FOLDS for i in range(len(others))]

        def add(text: str, c: int, part: int) -> None:
            rows.append([place[g] for g in grams(text) if g in place])
            label.append(c)
            fold.append(part)

        every = [(c, k, t) for c, f in enumerate(self.families, 1) for k, t in enumerate(TEMPLATES[f])]
        for c, k, t in every:
            for v in range(VARIANTS):
                w = t.split()
                if v:
                    w = [x for x in w if rng.random() > 0.08]
                    w = [filler[rng.integers(len(filler))] if rng.random() < 0.05 else x for x in w]
                    w = [*draw(rng.integers(0, 12)), *w, *draw(rng.integers(0, 12))]
                add(" ".join(w), c, k % FOLDS)
            for d in DENIALS:
                if text := denied(t, d):
                    for _ in range(4):
                        add(" ".join([*draw(rng.integers(0, 6)), text, *draw(rng.integers(0, 6))]), 0, k % FOLDS)
        short = [(k, t) for _, k, t in every if len(t.split()) <= 14]
        names = {w for f in self.families for t in TEMPLATES[f] for w in t.split() if w[:1].isupper() and w not in ("License", "Licence", "The", "This", "Version", "Public")}
        for k, t in short:  # notices of licences that are none of these
            for _ in range(12):
                other = OTHER_NAMES[rng.integers(len(OTHER_NAMES))]
                text = re.sub(r"\S+", lambda m, other=other: other if m[0].strip(".,()") in names else m[0], t)
                if text != t:
                    add(" ".join([*draw(rng.integers(0, 4)), text, *draw(rng.integers(0, 4))]), 0, k % FOLDS)
        words = [w for _, _, t in every for w in t.split()]
        for i in range(2000):  # other text also holds single words of notices
            w = draw(rng.integers(5, 60))
            for at in rng.integers(len(w), size=rng.integers(1, 4)):
                w[at] = words[rng.integers(len(words))]
            add(" ".join(w), 0, i % FOLDS)
        x = np.zeros((len(rows), len(vocabulary)), np.float32)
        for i, own in enumerate(rows):
            x[i, own] = 1
        label, fold = np.array(label), np.array(fold)
        y = np.eye(len(self.families) + 1, dtype=np.float32)[label]
        z, truth = [], []
        for part in range(FOLDS):
            learn = fold != part
            w, b = _fit(x[learn], y[learn], rounds // 2)
            z.append(x[~learn] @ w + b)
            truth.append(np.where(np.isin(label[~learn], label[learn]), label[~learn], 0))
        z, truth = np.concatenate(z), np.concatenate(truth)
        loss = lambda t: -float(np.mean(_softmax(z / t, log=True)[np.arange(len(z)), truth]))
        self.temperature = min((0.05 * 1.2**k for k in range(35)), key=loss)
        self.accuracy = float((z.argmax(axis=1) == truth).mean())
        w, b = _fit(x, y, rounds)
        self.weights, self.bias = w[order], b
        #: by family: positions in ``hashes`` of each template's grams, and of those that no other family's template has
        back = {g: int(np.searchsorted(self.hashes, hashes[i])) for g, i in place.items()}
        self.templates = [[frozenset(back[g] for g in grams(t)) for t in TEMPLATES[f]] for f in self.families]
        held = [frozenset().union(*own) for own in self.templates]
        self.telling = [own - frozenset().union(*(o for o in held if o is not own)) for own in held]
        #: by family and template: denials, of templates that have a verb, but for what the template itself says
        pairs = {f"{d.split()[-1]} {v}" for d in DENIALS for v in VERBS}
        spoken = lambda t: pairs - set(grams(t)) if denied(t, "not") else ()
        self.denials = [[frozenset(back[g] for g in spoken(t)) for t in TEMPLATES[f]] for f in self.families]
        #: by gram: 1 / size of each template that has it
        flat = [t for own in self.templates for t in own]
        self.parts = np.zeros((len(self.hashes), len(flat)), np.float32)
        for i, t in enumerate(flat):
            self.parts[list(t), i] = 1.0 / len(t)
        #: by gram: 1 for each template that has it if it tells of the template's family
        self.tells = np.zeros_like(self.parts)
        for i, (t, own) in enumerate((t, own) for own, ts in zip(self.telling, self.templates, strict=True) for t in ts):
            self.tells[list(t & own), i] = 1.0
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def paragraphs(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, float, float]]]:
        """By row: (paragraph number, family, probability, share of the template found) of paragraphs that are a licence notice."""
        out: list[list[tuple[int, int, float, float]]] = [[] for _ in range(len(offsets) - 1)]
        breaks = np.flatnonzero(data == _BREAK) + 1
        cuts = np.unique(np.concatenate([offsets, breaks]))
        start, end, first = spans(LOWER[data], cuts, WORD_BYTES)
        words = word_hashes(LOWER[data], start, end)
        own, feature = [], []
        for n in (1, 2):
            h, _, runs = gram_hashes(words, first, n)
            hit = np.flatnonzero(self.bits[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, h[hit]), len(self.hashes) - 1)
            good = self.hashes[at] == h[hit]
            own.append(np.searchsorted(runs, hit[good], "right") - 1)
            feature.append(at[good])
        pairs = np.unique(np.concatenate(own) * len(self.hashes) + np.concatenate(feature))
        if not len(pairs):
            return out
        paragraph, feature = np.divmod(pairs, len(self.hashes))
        heads = np.flatnonzero(np.concatenate([[True], paragraph[1:] != paragraph[:-1]]))
        z = np.add.reduceat(self.weights[feature], heads, axis=0) + self.bias
        p = _softmax(z / self.temperature)
        row = np.searchsorted(offsets, cuts[paragraph[heads]], "right") - 1
        first_of = np.searchsorted(cuts, offsets)
        lines = dict(zip(paragraph[heads].tolist(), np.split(feature, heads[1:]), strict=True))
        single, found = set(), []
        for k in np.flatnonzero(1.0 - p[:, 0] >= SURE):
            line = int(paragraph[heads[k]])
            if notice := self._confirm(set(lines[line].tolist()), p[k]):
                single.add(line)
                found.append((line, 1, notice))
        found += self._wrapped(lines, single, words, first, np.isin(cuts[:-1], offsets))
        block = np.cumsum(np.isin(cuts[:-1], offsets) | (np.diff(first) == 0))
        stop, family = -1, -1
        for line, size, notice in sorted(found):
            at = int(np.searchsorted(offsets, cuts[line], "right")) - 1
            number = line - int(first_of[at])
            if stop > 0 and 0 <= line - stop <= GAP and block[line] == block[stop - 1] and notice[0] == family:  # goes on with the lines before
                first_line, _, *best = out[at][-1]
                out[at][-1] = (first_line, family, *max(tuple(best), notice[1:]))
            else:
                out[at].append((number, *notice))
            stop, family = line + size, notice[0]
        return out

    def _confirm(self, held: set[int], p: np.ndarray) -> tuple[int, float, float] | None:
        """(family, probability, share): templates decide between families that the classifier finds likely.

        A template whose verb is denied confirms nothing. A template counts if what is held has one of its grams that tell of its family, or nine tenths of all its grams.
        """
        told = lambda c: ((len(held & t) / len(t), t) for t, no in zip(self.templates[c - 1], self.denials[c - 1], strict=True) if not held & no)
        share = lambda c: max((r for r, t in told(c) if r >= 0.9 or held & t & self.telling[c - 1]), default=0.0)
        likely = [(share(c), float(p[c]), c) for c in range(1, len(p)) if p[c] >= LIKELY]
        if not likely or max(likely)[0] < CONFIRM:
            return None
        share, _, c = max(likely)
        return c - 1, float(1.0 - p[0]), share

    def _wrapped(self, lines: dict[int, np.ndarray], single: set[int], words: np.ndarray, first: np.ndarray, heads: np.ndarray) -> list[tuple[int, int, tuple[int, float, float]]]:
        """(first line, lines, notice) of notices that run over 2 to ``LINES`` lines, none of which is one alone.

        Lines are joined up to a blank line or the end of a text. Pairs of
        words over a line's end count. The sum of the lines' shares is not less than the share
        of their union, so only runs where it confirms a template, and that have one of its family's telling grams, or where it is
        nine tenths, are scored; blocks of lines without any such run are left out first.
        """
        n = len(first) - 1
        empty = np.diff(first) == 0
        alone = empty | np.isin(np.arange(n), list(single))
        block = np.cumsum(heads | alone | np.concatenate([[False], alone[:-1]]))
        # pairs of words that stand on both sides of a line's end
        ends = np.flatnonzero(~alone[:-1] & (block[:-1] == block[1:]))
        across: dict[int, int] = {}
        if len(ends):
            last = first[ends + 1] - 1
            pair = gram_hashes(np.stack([words[last], words[last + 1]], axis=1).ravel(), np.arange(0, 2 * len(ends) + 1, 2), 2)[0]
            at = np.minimum(np.searchsorted(self.hashes, pair), len(self.hashes) - 1)
            across = {int(e): int(a) for e, a, h in zip(ends, at, pair, strict=True) if self.hashes[a] == h}
        share, tells = np.zeros((n, self.parts.shape[1]), np.float32), np.zeros((n, self.parts.shape[1]), np.float32)
        for own in (lines, {line: [at] for line, at in across.items()}):
            for line, at in own.items():
                share[line] += self.parts[at].sum(axis=0)
                tells[line] += self.tells[at].sum(axis=0)
        fits = lambda share, tells: (share >= CONFIRM - 1e-4) & ((tells > 0) | (share >= 0.9 - 1e-4))
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if n else np.zeros(0, np.int64)
        whole = fits(np.add.reduceat(share, starts, axis=0), np.add.reduceat(tells, starts, axis=0)).any(axis=1) if n else np.zeros(0, bool)
        kept = np.flatnonzero(np.repeat(whole, np.diff(np.append(starts, n))) & ~alone)
        share, tells = (np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x[kept], axis=0, dtype=np.float64)]) for x in (share, tells))
        m, found = len(kept), []
        for size in range(2, min(LINES, m) + 1):
            good = block[kept[size - 1 :]] == block[kept[: m - size + 1]]
            if not good.any():
                break
            at = np.flatnonzero(good)
            at = at[fits(share[at + size] - share[at], tells[at + size] - tells[at]).any(axis=1)]
            for i in kept[at].tolist():
                if i not in lines or (i + size - 1 not in lines):
                    continue
                held = set(np.concatenate([lines[k] for k in range(i, i + size) if k in lines]).tolist()) | {across[k] for k in range(i, i + size - 1) if k in across}
                if self.parts[list(held)].sum(axis=0).max() < CONFIRM - 1e-4:
                    continue
                z = self.weights[list(held)].sum(axis=0, keepdims=True) + self.bias
                p = _softmax(z / self.temperature)[0]
                if 1.0 - p[0] >= SURE and (notice := self._confirm(held, p)):
                    found.append((-notice[2], size, i, notice))
        taken, out = set(), []
        for _, size, i, notice in sorted(found):  # the fullest first, of equal ones the shortest
            if taken.isdisjoint(range(i, i + size)):
                taken.update(range(i, i + size))
                out.append((i, size, notice))
        return out


def _softmax(z: np.ndarray, log: bool = False) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    if log:
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    p = np.exp(z)
    return p / p.sum(axis=1, keepdims=True)


def _fit(x: np.ndarray, y: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Full-batch accelerated gradient descent with a small ridge and soft-thresholding; classes weigh alike."""
    weight = (y / np.maximum(y.sum(axis=0), 1)).sum(axis=1, keepdims=True) / y.shape[1]
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    speed_w, speed_b, rate = np.zeros_like(w), np.zeros_like(b), 2.0
    for _ in range(rounds):
        g = (_softmax(x @ w + b) - y) * weight
        speed_w = 0.9 * speed_w - rate * (x.T @ g + 1e-5 * w)
        speed_b = 0.9 * speed_b - rate * g.sum(axis=0)
        w, b = w + speed_w, b + speed_b
        w = np.sign(w) * np.maximum(np.abs(w) - 1e-5, 0)
    return w, b


FOUND = "array<struct<paragraph:int,family:string,probability:double,share:double>>"


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = OTHER_ROWS) -> Classifier:
    """Learns from the templates and from about ``rows`` paragraphs of other text, one from each of as many documents drawn by a hash of id and text, at most a tenth more.

    Of each paragraph, taken whole, the driver gets its grams that templates have, and ``FILLERS`` words.
    Paragraphs with half of a template's grams are not taken for other text.
    """
    n = docs.select(id_col).count()
    limit = int(min(1.0, rows / max(n, 1)) * (1 << 30))
    own = F.xxhash64(F.col(id_col), F.col(text_col))
    drawn = docs.where(F.col(text_col).isNotNull() & (F.pmod(F.xxhash64(F.col(id_col), F.lit(2), F.col(text_col)), F.lit(1 << 30)) < limit))
    lines = F.split(F.col(text_col), "\n")
    # rows that repeat an id and a text are one
    drawn = drawn.select(own.alias("own"), F.element_at(lines, (F.pmod(own, F.size(lines)) + 1).cast("int")).alias("one")).dropDuplicates(["own"])
    # many fewer than a tenth more than wanted are drawn; the bound holds in any case
    drawn = drawn.orderBy("own").limit(rows + rows // 10)
    vocabulary = _vocabulary()
    hashes = _hashes(vocabulary)
    order = np.argsort(hashes)
    found, kind = hashes[order], pa.struct([("own", pa.list_(pa.int32())), ("words", pa.list_(pa.string()))])

    @F.arrow_udf("struct<own:array<int>,words:array<string>>")
    def features(x: pa.Array) -> pa.Array:
        out = []
        for first, _, data, offsets in steps(x):
            low = LOWER[data]
            start, end, heads = spans(low, offsets, WORD_BYTES)
            words = word_hashes(low, start, end)
            runs = [gram_hashes(words, heads, n) for n in (1, 2)]
            for row in range(len(offsets) - 1):
                h = np.unique(np.concatenate([g[r[row] : r[row + 1]] for g, _, r in runs]))
                at = np.minimum(np.searchsorted(found, h), len(found) - 1)
                split = (x[first + row].as_py() or "").split()
                rng = np.random.Generator(np.random.PCG64(len(split)))
                some = [split[i] for i in rng.integers(len(split), size=min(FILLERS, len(split)))] if split else []
                out.append({"own": order[at[found[at] == h]].tolist(), "words": some})
        return pa.array(out, kind)

    table = drawn.select(features(F.col("one")).alias("f")).select("f.own", "f.words").collect()
    place = {g: i for i, g in enumerate(vocabulary)}
    known = [frozenset(place[g] for g in grams(t)) for f in TEMPLATES.values() for t in f]
    rows = sorted((sorted(r.own), r.words) for r in table if r.words)
    clean = [(own, words) for own, words in rows if all(len(k.intersection(own)) < 0.5 * len(k) for k in known)]
    return Classifier([own for own, _ in clean], [w for _, words in clean for w in words])


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, family, score, n_notices, families, notices)`` for each row of ``docs``.

    Every line of every text is classified, and then every run of 2 to ``LINES`` lines
    without a blank one between them, of which the first line is reported. It is unknown unless
    the calibrated probability of a licence is at least ``SURE``; of the families of probability ``LIKELY`` or more that is
    reported of which it holds the largest share of a template's grams, if that is at least ``CONFIRM``. ``family`` is that of the likeliest notice, ``unknown`` if
    there is none, as in null and empty texts; ``notices`` has paragraph numbers from 0. Of equally likely notices that
    with the larger share, then the last family by name, is told. Repeated rows and null ids are each
    scanned; texts count whole, however long; extra columns, whatever their names, are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows_per_batch(spark)
    shared = spark.sparkContext.broadcast(train(docs, id_col, text_col))
    kind = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("share", pa.float64())]))

    @F.arrow_udf(FOUND)
    def scan(x: pa.Array) -> pa.Array:
        model, out = shared.value, []
        for _, _, data, offsets in steps(x):
            for found in model.paragraphs(data, offsets):
                out.append([{"paragraph": n, "family": model.families[f], "probability": p, "share": s} for n, f, p, s in found])
        return pa.array(out, kind)

    told = docs.select(F.col(id_col).alias("doc_id"), scan(F.col(text_col)).alias("notices"))
    best = F.element_at(F.sort_array(F.transform("notices", lambda x: F.struct(x["probability"], x["share"], x["family"])), asc=False), 1)
    some = F.size("notices") > 0
    return told.select(
        "doc_id",
        F.when(some, best["family"]).otherwise(F.lit("unknown")).alias("family"),
        F.when(some, F.round(best["probability"], 6)).otherwise(F.lit(0.0)).alias("score"),
        F.size("notices").cast("bigint").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["family"]))), ",").alias("families"),
        F.transform("notices", lambda x: x["paragraph"]).alias("notices"),
    )
