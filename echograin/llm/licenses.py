"""License scans: a trained paragraph classifier over licence families, confirmed by templates.

Paragraphs stand between blank lines; wrapped lines are read as one. Features are word unigrams and bigrams that notices have
and common prose has not, each counted once a window, so that a word said over and over tells no more than once; weights of a sparse multinomial logistic regression are learned from notices, alone and
inside prose, and, as the class "unknown", from paragraphs of the corpus. Probabilities are calibrated by a temperature
and a rising curve, one for families and one for unknown, fitted to examples kept aside; the calibration error is measured on others. As logits are sums over words, those of
every window of a paragraph come from running sums, less what an n-gram adds again inside the window; the windows that tell most are taken first, so a paragraph may hold several notices.
A predicted family is confirmed if the place holds most of the word pairs of one of its templates.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
# Notices of each family and sentences of its text; {v} is a version, {h} a holder.
TEMPLATES = {
    "mit": [
        "Released under the MIT License", "Licensed under the MIT License", "This project is MIT licensed", "License: MIT", "SPDX-License-Identifier: MIT", "distributed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "isc": ["Licensed under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "apache": [
        "Licensed under the Apache License, Version {v}", "Released under the Apache License, Version {v}", "Apache License {v}", "SPDX-License-Identifier: Apache-{v}", "you may not use this file except in compliance with the Apache License",
        "Licensed under the Apache License, Version {v} (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind, either express or implied. See the License for the specific language governing permissions and limitations under the License",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version {v}", "Released under the GNU General Public License, version {v}", "GNU General Public License v{v}", "GNU General Public License, version {v}", "distributed under GPL v{v}", "licensed under the GPL version {v}", "GPL v{v} only", "SPDX-License-Identifier: GPL-{v}",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version",
        "You should have received a copy of the GNU General Public License along with this program",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version {v}", "Released under the GNU Lesser General Public License", "GNU Lesser General Public License, version {v}", "licensed under the LGPL version {v}", "distributed under LGPL v{v}", "SPDX-License-Identifier: LGPL-{v}",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version {v}", "distributed under AGPL v{v}", "SPDX-License-Identifier: AGPL-{v}",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "Released under the BSD license", "Licensed under the BSD {v}-Clause License", "distributed under a BSD-style license", "BSD {v}-Clause", "SPDX-License-Identifier: BSD-{v}-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. {v}", "Licensed under the Mozilla Public License, version {v}", "distributed under MPL v{v}", "SPDX-License-Identifier: MPL-{v}",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
    ],
    "cc-by": ["Licensed under CC BY {v}", "This work is licensed under a Creative Commons Attribution {v} International License"],
    "cc-by-sa": ["Licensed under CC BY-SA {v}", "This work is licensed under a Creative Commons Attribution-ShareAlike {v} International License"],
    "cc-by-nc": ["Licensed under CC BY-NC {v}", "This work is licensed under a Creative Commons Attribution-NonCommercial {v} International License"],
    "cc0": ["Dedicated to the public domain under CC0", "To the extent possible under law, the author has waived all copyright", "This is free and unencumbered software released into the public domain"],
    "proprietary": ["All rights reserved", "Copyright {h}. All rights reserved", "No part of this publication may be reproduced without permission", "This software is proprietary and confidential", "Unauthorized copying of this file is strictly prohibited"],
}
# Fillings of the templates.
VERSIONS = ("1.0", "2.0", "2.1", "3", "3.0", "4.0", "2", "")
HOLDERS = ("2019 the authors", "2021 Example Inc", "(c) 2020 by the contributors", "")
# What stands around a notice.
AROUND = ("", "This project is", "see the LICENSE file for details", "the software is provided as is", "Copyright 2020 Example")
# Sentences that share words with notices and are none.
UNRELATED = (
    "my driving license was lost on the way to town", "the license of the fishing boat has to be renewed", "a marriage license costs little", "they study at MIT in the spring", "er kam mit der Frau und mit dem Hund", "the general public was invited",
    "this software is easy to use", "a copy of the letter was found", "human rights and civil rights", "the apache people lived here", "the version of the story that we know", "you can read it and write it", "the author of this work is unknown",
    "permission was granted by the town", "public domain names are cheap", "the creative work of the commons", "the mozilla project", "all rights matter", "the source of the river", "with or without you", "the terms of the treaty", "free of charge on Sundays",
)

#: Corpus windows that are learned from as unknown at most, of the documents whose ids hash lowest.
MAX_UNKNOWN = 4_000
MAX_DOCUMENTS = 2_000
#: Share of the unknown windows beyond which an n-gram is common prose and no feature.
COMMON = 0.02
#: Least probability of a family that is likelier than unknown and all others.
MIN_PROBABILITY = 0.3
MIN_SIMILARITY = 0.8
#: Sizes of the windows, in words; each goes on by a quarter of itself.
WINDOWS = (8, 16, 32, 64)
#: Words between two parts of one notice, and words around it in which its template is looked for.
GAP = 4
BESIDE = 8
WORD = re.compile(r"v(?=\d)|[^\W_]+")
# Spellings that are read as one.
SPELLING = {"licence": "license", "licenced": "licensed", "licences": "licenses", "licensing": "license"}


def words_of(paragraph: str) -> list[str]:
    """Lower-case words; a v before a number stands alone, and spellings are made one."""
    get = SPELLING.get
    return [get(w, w) for w in WORD.findall(paragraph.lower())]


def _pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False)) or {(w, "") for w in words}


def template_words(template: str) -> list[str]:
    return words_of(re.sub(r"\{.\}", " ", template))


def notices() -> list[tuple[str, list[str], int]]:
    """(family, words, number of the template) of every template with fillings and surroundings."""
    found = []
    for family, templates in TEMPLATES.items():
        for number, template in enumerate(templates):
            for k in range(max(len(VERSIONS), len(AROUND))):
                text = template.format(v=VERSIONS[k % len(VERSIONS)], h=HOLDERS[k % len(HOLDERS)])
                around = AROUND[k % len(AROUND)]
                found += [(family, words_of(t), number) for t in (text, f"{text}. {around}", f"{around} {text}")]
    return found


class Classifier:
    """Multinomial logistic regression on the n-grams of a window, with a temperature, and the templates' word pairs."""

    def __init__(self, classes: list[str], vocabulary: dict[str | tuple[str, str], int], weights: np.ndarray, bias: np.ndarray, temperature: float, calibration_error: float = 0.0, curve: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))):
        self.classes, self.vocabulary, self.weights, self.bias = classes, vocabulary, weights.astype(float), bias.astype(float)
        self.temperature, self.calibration_error, self.curve = temperature, calibration_error, curve
        self.unknown = classes.index(UNKNOWN)
        self.templates = {f: [(t, _pairs(template_words(t))) for t in ts] for f, ts in TEMPLATES.items()}
        # Numbers of the words of all n-grams (other spellings included); the n-gram of a word, and of a pair of words, in order.
        self.number = {w: k for k, w in enumerate(sorted({w for g in vocabulary for w in ([g] if isinstance(g, str) else g)}))}
        single = {self.number[g]: k for g, k in vocabulary.items() if isinstance(g, str)}
        self.single = np.array([single.get(k, -1) for k in range(len(self.number))] + [-1], np.int64)
        double = sorted((self.number[g[0]] << 20 | self.number[g[1]], k) for g, k in vocabulary.items() if not isinstance(g, str))
        self.double, self.double_at = (np.array([d[k] for d in double] + [-1], np.int64) for k in (0, 1))
        self.number |= {other: self.number[w] for other, w in SPELLING.items() if w in self.number}

    def evidence(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places and numbers of the n-grams: of words, and of pairs by their second word. Whatever has none has the bias alone for a logit."""
        at = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        one = self.single[at]
        places = np.flatnonzero(one >= 0)
        pairs = np.flatnonzero((at[1:] >= 0) & (at[:-1] >= 0))
        codes = at[pairs] << 20 | at[pairs + 1]
        found = np.searchsorted(self.double[:-1], codes)
        good = self.double[found] == codes
        return places, one[places], pairs[good] + 1, self.double_at[found[good]]

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        e = np.exp(z - z.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def confirm(self, family: str, words: list[str], low: int, high: int) -> tuple[str, float, int, int]:
        """The family's template that the words from low to high, numbers left out, hold most of; the share of its word pairs, and where these stand.

        Of several that are held to MIN_SIMILARITY, the one that stands closest together, then the longest.
        """
        plain = [i for i in range(low, high) if not words[i].isdigit()]
        own = [(words[i], words[j]) for i, j in zip(plain, plain[1:], strict=False)]
        held = set(own)
        alike, template = max((len(p & held) / len(p), t) for t, p in self.templates[family])
        if alike < MIN_SIMILARITY:
            return template, alike, low, high
        found = []
        for template, pairs in self.templates[family]:
            share = len(pairs & held) / len(pairs)
            if share >= MIN_SIMILARITY:
                first, last, seen = self._stand(pairs, own)
                found.append((seen / (last - first + 1), len(pairs), share, template, plain[first], plain[last + 1] + 1))
        _, _, alike, template, begin, end = max(found)
        return template, alike, begin, end

    def _stand(self, pairs: set[tuple[str, str]], own: list[tuple[str, str]]) -> tuple[int, int, int]:
        """First and last number, and how many, of a template's pairs where most of them stand together: of the first such run, GAP apart at most, the shortest part with all that it has."""
        runs: list[list[tuple[int, tuple[str, str]]]] = []
        for k, pair in enumerate(own):
            if pair in pairs:
                if runs and k - runs[-1][-1][0] <= GAP:
                    runs[-1].append((k, pair))
                else:
                    runs.append([(k, pair)])
        run = max(runs, key=lambda r: len({p for _, p in r}))
        distinct, latest, best = len({p for _, p in run}), {}, None
        for k, pair in run:
            latest.pop(pair, None)
            latest[pair] = k  # in the order of their last places
            if len(latest) == distinct:
                first = next(iter(latest.values()))
                if best is None or k - first < best[1] - best[0]:
                    best = first, k
        return *best, distinct

    def _again(self, at: np.ndarray, ngram: np.ndarray, back: int, weight: np.ndarray, starts: np.ndarray, gaps: np.ndarray, size: int) -> np.ndarray:
        """For windows of `size` words from each of starts: the weights of n-grams (places `at`) that the window holds already; back: words of the n-gram before its place."""
        order = np.lexsort((at, ngram))
        same = np.flatnonzero(ngram[order][1:] == ngram[order][:-1])
        before, later = at[order[same]] - back, order[same + 1]
        gap = np.searchsorted(gaps[:, 0], at[later], side="right") - 1
        inside = (gap >= 0) & (at[later] < gaps[gap, 1])
        low = np.searchsorted(starts, np.maximum(at[later] - size + 1, gaps[gap, 0]))
        high = np.searchsorted(starts, before, side="right")
        good = inside & (low < high)
        change = np.zeros((len(starts) + 1, weight.shape[1]))
        np.add.at(change, low[good], weight[later[good]])
        np.subtract.at(change, high[good], weight[later[good]])
        return np.cumsum(change, axis=0)[:-1]

    def segments(self, words: list[str]) -> list[tuple[int, int, str, float, str, float]]:
        """(begin, end, family, probability, template, similarity) of disjoint places of notices.

        Windows of WINDOWS words begin wherever an n-gram does; what has no n-gram is unknown. Those that tell most of a family against
        unknown come first, each reduced to its template's place or to the words that tell; windows over words that are taken
        are left out. What lies between is then looked at by itself, until nothing is found.
        """
        at_one, one, at_two, two = self.evidence(words)
        if not len(at_one) and not len(at_two):
            return []
        ngrams = one, two
        one, two = self.weights[one], self.weights[two]
        sums, pair_sums = (np.concatenate([np.zeros((1, len(self.classes))), np.cumsum(x, axis=0)]) for x in (one, two))
        starts = np.union1d(at_one, at_two - 1)
        words = [SPELLING.get(w, w) for w in words]
        taken: list[tuple[int, int, str, float, str, float]] = []
        gaps = [(0, len(words))]
        while gaps:
            lows, highs = np.array(gaps).T
            gap = np.searchsorted(lows, starts, side="right") - 1
            some = (gap >= 0) & (starts < highs[gap])
            begin = np.repeat(starts[some], len(WINDOWS))
            end = np.minimum(begin + np.tile(WINDOWS, int(some.sum())), np.repeat(highs[gap[some]], len(WINDOWS)))
            place = lambda at, to: np.searchsorted(at, to)
            logits = self.bias + sums[place(at_one, end)] - sums[place(at_one, begin)] + pair_sums[place(at_two, end)] - pair_sums[np.minimum(place(at_two, begin + 1), place(at_two, end))]
            first = starts[some]
            again = [self._again(at_one, ngrams[0], 0, one, first, np.array(gaps), w) + self._again(at_two, ngrams[1], 1, two, first, np.array(gaps), w) for w in WINDOWS]
            logits -= np.stack(again, axis=1).reshape(logits.shape)
            best = logits.argmax(axis=1)
            good = np.flatnonzero(best != self.unknown)
            if not len(good):
                break
            p = np.interp(self.probabilities(logits[good])[np.arange(len(good)), best[good]], *self.curve)
            margin = logits[good, best[good]] - logits[good, self.unknown]
            used = np.zeros(len(words), bool)
            for b, e, *_ in taken:
                used[b:e] = True
            fresh = []
            for k in np.lexsort((end[good] - begin[good], -margin)):
                b, e, c = int(begin[good[k]]), int(end[good[k]]), best[good[k]]
                if p[k] < MIN_PROBABILITY or used[b:e].any():
                    continue
                low, high = b, e
                while low > max(0, b - BESIDE) and not used[low - 1]:
                    low -= 1
                while high < min(len(words), e + BESIDE) and not used[high]:
                    high += 1
                template, alike, first, last = self.confirm(self.classes[c], words, low, high)
                if alike < MIN_SIMILARITY:
                    tells = np.concatenate([at_one[(one[:, c] > one[:, self.unknown]) & (at_one >= b) & (at_one < e)], at_two[(two[:, c] > two[:, self.unknown]) & (at_two > b) & (at_two < e)]])
                    if not len(tells):
                        continue
                    first, last = int(tells.min()), int(tells.max()) + 1
                used[first:last] = True
                fresh.append((first, last, self.classes[c], float(p[k]), template, alike))
            taken = sorted(taken + fresh)
            ends = [0, *[e for _, e, *_ in taken]]
            gaps = [(x, y) for x, y in zip(ends, [b for b, *_ in taken] + [len(words)], strict=True) if y > x] if fresh else []
        return taken

    def find_all(self, lines: list[str]) -> list[tuple[int, int, str, float, str, float]]:
        """(first line, last line, family, probability, template, similarity) of every notice in a paragraph of several lines.

        Places of one family that follow each other are one notice, unless each holds a whole template of its own.
        """
        by_line = [WORD.findall(line.lower()) for line in lines]
        line_of = [k for k, ws in enumerate(by_line) for _ in ws]
        found: list[list] = []
        for b, e, family, p, template, alike in self.segments([w for ws in by_line for w in ws]):
            last = found[-1] if found else None
            if last and last[2] == family and b - last[1] <= GAP and not (min(alike, last[5]) >= MIN_SIMILARITY and template == last[4]):
                last[1], last[3] = e, max(last[3], p)
                last[4], last[5] = max((last[4:6], [template, alike]), key=lambda x: (x[1] >= MIN_SIMILARITY, len(x[0]) if x[1] >= MIN_SIMILARITY else x[1]))
            else:
                found.append([b, e, family, p, template, alike])
        return [(line_of[b], line_of[e - 1], family, p, template, alike) for b, e, family, p, template, alike in found]

    def find(self, paragraph: str) -> tuple[str, float, str, float] | None:
        """Family, probability, template and similarity of the likeliest notice in a paragraph, or nothing if it is unknown."""
        return max((found[2:] for found in self.find_all(paragraph.split("\n"))), key=lambda x: x[1], default=None)


def paragraphs(text: str) -> Iterator[tuple[int, list[str]]]:
    """Number of the first line, and lines, of each run of lines between blank ones."""
    start, held = 0, []
    for number, line in enumerate(text.split("\n")):
        if line.strip():
            if not held:
                start = number
            held.append(line)
        elif held:
            yield start, held
            held = []
    if held:
        yield start, held


def _grams(words: list[str]) -> set[str | tuple[str, str]]:
    return {w for w in words if not w.isdigit()} | set(zip(words, words[1:], strict=False))


class _Sparse:
    """Rows of counts by place, for products with few columns."""

    def __init__(self, rows: list[dict[int, int]], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.column = np.array([c for r in rows for c in r], np.int64)
        self.value = np.array([v for r in rows for v in r.values()], float)[:, None]
        self.order = np.argsort(self.column, kind="stable")

    def _sums(self, data: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, data.shape[1]))
        if len(groups):
            starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
            out[groups[starts]] = np.add.reduceat(data, starts, axis=0)
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return self._sums(w[self.column] * self.value, self.row, self.n)

    def turned_times(self, g: np.ndarray) -> np.ndarray:
        return self._sums((g[self.row] * self.value)[self.order], self.column[self.order], self.width)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def rising(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rising curve nearest to points (x, y), as its corners: neighbours that fall are averaged until none does."""
    steps: list[list[float]] = []  # mean, weight, first and last x
    for k in np.argsort(x, kind="stable"):
        steps.append([float(y[k]), float(weight[k]), float(x[k]), float(x[k])])
        while len(steps) > 1 and steps[-2][0] >= steps[-1][0]:
            (m, a, first, _), (n, b, _, last) = steps[-2:]
            steps[-2:] = [[(m * a + n * b) / (a + b), a + b, first, last]]
    if not steps:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    corners = sorted({(at, s[0]) for s in steps for at in s[2:]})
    return np.array([c[0] for c in corners]), np.array([c[1] for c in corners])


def calibration_error(top: np.ndarray, right: np.ndarray, weight: np.ndarray, bins: int = 10) -> float:
    """Weighted mean of the distance between the probability of the predicted class and how often it is right, over equal bins of probability."""
    at = np.minimum((top * bins).astype(int), bins - 1)
    return float(sum(abs((weight * (top - right))[at == k].sum()) for k in range(bins)) / weight.sum())


def _fit(rows: list[dict[int, int]], y: np.ndarray, classes: int, width: int, rounds: int = 200, rate: float = 0.5, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by full-batch steps with momentum; classes count alike. Equal examples are one, with their number as weight."""
    weight = 1.0 / np.bincount(y, minlength=classes)[y]
    distinct: dict[tuple, float] = {}
    for row, label, heavy in zip(rows, y.tolist(), weight, strict=True):
        key = (label, *sorted(row.items()))
        distinct[key] = distinct.get(key, 0.0) + heavy
    x = _Sparse([dict(k[1:]) for k in distinct], width)
    target = np.eye(classes)[[k[0] for k in distinct]]
    share = np.array(list(distinct.values()))[:, None]
    w, b = np.zeros((width, classes)), np.zeros(classes)
    speed_w, speed_b = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        g = (_softmax(x.times(w) + b) - target) * share
        speed_w, speed_b = 0.9 * speed_w - rate * (x.turned_times(g) + decay * w), 0.9 * speed_b - rate * g.sum(axis=0)
        w, b = w + speed_w, b + speed_b
    return w, b


def train(unknown: list[list[str]]) -> Classifier:
    """A classifier from the notices, alone and inside prose, and unknown windows.

    For the calibration a first fit leaves out every third template of a family and every third unknown window; half of what was
    left out fits the temperature and the curves, and the other half measures the calibration error. The weights are then fitted to everything.
    """
    prose = [w for w in unknown if len(w) > 8] or [[]]
    known = notices()
    inside = [(f, prose[k % len(prose)][:12] + w + prose[(k * 7 + 3) % len(prose)][-12:], n) for k, (f, w, n) in enumerate(known)]
    data = known + inside + [(UNKNOWN, w, k) for k, w in enumerate(unknown)] + [(UNKNOWN, words_of(t), k) for k, t in enumerate(UNRELATED)] * 10 + [(UNKNOWN, [], 1)] * 10
    classes = sorted({f for f, *_ in data})
    counted = Counter(g for w in unknown for g in _grams(w))
    vocabulary = {g: k for k, g in enumerate(sorted({g for _, w, _ in known for g in _grams(w) if counted[g] <= COMMON * len(unknown)}, key=str))}
    rows = [{vocabulary[g]: 1 for g in _grams(w) if g in vocabulary} for _, w, _ in data]
    y = np.array([classes.index(f) for f, *_ in data])
    aside = np.array([n % 3 == 2 for *_, n in data])
    w, b = _fit([r for r, out in zip(rows, aside, strict=True) if not out], y[~aside], len(classes), len(vocabulary))
    z = _Sparse([r for r, out in zip(rows, aside, strict=True) if out], len(vocabulary)).times(w) + b
    right = y[aside]
    heavy = 1.0 / np.bincount(right, minlength=len(classes))[right]
    half = np.arange(len(right)) % 2 == 0
    losses = [(-(heavy * np.log(_softmax(z / t)[np.arange(len(right)), right] + 1e-12))[half].sum(), t) for t in np.geomspace(0.1, 10, 60)]
    heat = float(min(losses)[1])
    p = _softmax(z / heat)
    top, named, good = p.max(axis=1), p.argmax(axis=1) != classes.index(UNKNOWN), p.argmax(axis=1) == right
    curves = [rising(top[half & (named == kind)], good[half & (named == kind)], heavy[half & (named == kind)]) for kind in (False, True)]
    top = np.where(named, np.interp(top, *curves[1]), np.interp(top, *curves[0]))
    error = calibration_error(top[~half], good[~half], heavy[~half])
    w, b = _fit(rows, y, len(classes), len(vocabulary))
    return Classifier(classes, vocabulary, w, b, heat, error, curves[1])


def classifier_of(docs: DataFrame) -> Classifier:
    """A classifier whose unknown class has windows of docs (doc_id, text): MAX_UNKNOWN at most, those with the lowest hashes, of the MAX_DOCUMENTS documents with the lowest hashes.

    Windows cover the documents' whole paragraphs; those that hold a template's word pairs to MIN_SIMILARITY are not learned from as unknown.
    """
    ids = docs.where("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_DOCUMENTS)
    size = WINDOWS[-2]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                found = []
                for _, lines in paragraphs(text.as_py() or ""):
                    words = words_of(" ".join(lines))
                    found += [" ".join(words[at : at + size]) for at in range(0, len(words), size)]
                yield pa.record_batch([pa.array(found, pa.string())], names=["window"])

    texts = docs.join(F.broadcast(ids), "doc_id", "left_semi").select(F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(windows, "window string").where("window <> ''").distinct().orderBy(F.xxhash64("window"), "window").limit(MAX_UNKNOWN).collect()
    templates = [(t, _pairs(template_words(t))) for ts in TEMPLATES.values() for t in ts]
    found = [r["window"].split(" ") for r in rows]
    return train([w for w in found if all(len(p & _pairs(w)) < MIN_SIMILARITY * len(p) for _, p in templates)])


def scan(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, paragraph (number of the line where the notice begins, from 0), family, probability, template, similarity, confirmed, last_paragraph (the line where it ends): a row for each notice.

    Defined results: null and empty texts give no rows; an id may be null or repeat, and each row is scanned for
    itself; other columns are ignored; whole texts are scanned; an empty table gives an empty table.
    """
    names = ["doc_id", "paragraph", "family", "probability", "template", "similarity", "confirmed", "last_paragraph"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.float64(), pa.bool_(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for number, lines in paragraphs(text.as_py() or ""):
                    for first, last, *found in classifier.find_all(lines):
                        out.append((doc, number + first, *found, found[3] >= MIN_SIMILARITY, number + last))
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    schema = "doc_id long, paragraph int, family string, probability double, template string, similarity double, confirmed boolean, last_paragraph int"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """scan() of the whole documents table with a classifier fitted to it; edge cases as defined there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, classifier_of(docs)).withColumn("probability", F.round("probability", 6))
