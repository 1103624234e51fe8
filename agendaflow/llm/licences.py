"""Licence scans: a trained paragraph classifier whose predictions a template comparison confirms."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B

#: Wording of public licences and of the notices that name them.
TEMPLATES: dict[str, list[str]] = {
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "GNU Affero General Public License v3.0 AGPL-3.0",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "This work is licensed under the AGPL.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Released under the Creative Commons Attribution license.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Released under the Creative Commons Attribution NonCommercial license.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal public domain dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "Released under the GPL version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Released under the LGPL version 3.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Public-Domain": [
        "This is free and unencumbered software released into the public domain.",
        "Released into the public domain under the Unlicense.",
        "This work is in the public domain.",
    ],
    "Reserved": [
        "Copyright 2020. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced or transmitted in any form without the prior written permission of the publisher.",
    ],
}
#: Short names by which notices call a family: text to learn from, as the templates are.
NAMES: dict[str, list[str]] = {
    "AGPL": ["AGPL", "AGPLv3", "AGPL-3.0", "GNU Affero"],
    "Apache": ["Apache 2.0", "Apache License", "Apache Licence", "under Apache", "Apache-style"],
    "BSD": ["BSD License", "BSD Licence", "BSD 2-Clause", "BSD 3-Clause", "under BSD", "BSD-style"],
    "CC-BY": ["CC BY 4.0", "CC BY 3.0", "CC BY 2.0", "Creative Commons Attribution 4.0", "Creative Commons Attribution 3.0", "Creative Commons Attribution License"],
    "CC-BY-NC": ["CC BY-NC", "Attribution-NonCommercial"],
    "CC-BY-SA": ["CC BY-SA", "Attribution-ShareAlike"],
    "CC0": ["CC0", "CC0 1.0"],
    "GPL": ["GPL", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0", "GNU General Public License", "GNU GPL"],
    "ISC": ["ISC License", "ISC Licence", "under ISC"],
    "LGPL": ["LGPL", "LGPLv2", "LGPLv3", "GNU Lesser General"],
    "MIT": ["MIT License", "MIT Licence", "under MIT", "under the MIT", "MIT-style"],
    "MPL": ["MPL 2.0", "MPL 1.1", "Mozilla Public License"],
    "Public-Domain": ["Unlicense", "released into the public domain", "dedicated to the public domain"],
    "Reserved": ["all rights reserved"],
}
#: Licences of no family above; with licences whose own words are left out they teach what is unknown.
OTHER_LICENCES = [
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License which accompanies this distribution.",
    "Licensed under the European Union Public Licence, version 1.2 or later.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License. You may not use this file except in compliance with the License.",
    "This library is free software; you can redistribute it under the terms of the Artistic License 2.0.",
    "This software is provided as-is, without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "Distributed under the Boost Software License, Version 1.0.",
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted.",
    "Released under the PostgreSQL License.",
    "Licensed under the Python Software Foundation License.",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Licensed under the Microsoft Public License.",
    "This software is governed by the CeCILL license under French law and abiding by the rules of distribution of free software.",
    "This database is made available under the Open Database License.",
    "This work may be distributed and/or modified under the conditions of the LaTeX Project Public License.",
    "Licensed under the Academic Free License version 3.0.",
    "Permission is granted to make and distribute verbatim copies of this manual provided the copyright notice and this permission notice are preserved on all copies.",
    "Permission is granted to copy, distribute and/or modify this document under the terms of the Free Documentation License.",
    "Licensed under the zlib license.",
    "Use of this source code is governed by a license that can be found in the accompanying file.",
    "Released under a custom license; commercial use requires a written agreement with the licensor.",
]
#: Ordinary sentences that share words with licences.
ORDINARY = [
    "He got his driving license in March and drove to the sea.",
    "The software update is free of charge and takes ten minutes.",
    "Permission to land was granted to the pilot by the tower.",
    "The general public was admitted to the museum on Sunday.",
    "She renewed the fishing licence before the season started.",
    "The version of the story that he told was not the one we knew.",
    "The rights of the workers were discussed in the second chapter.",
    "A copy of the letter was sent to the commission in Brussels.",
    "The foundation supports free education for children in the region.",
    "The terms of the agreement were published in the official journal.",
    "The source of the river lies in the hills to the north.",
    "The university of the common people opened its doors in 1901.",
    "The bar lost its license to sell beer after the complaint.",
    "This work is a study of trade in the early modern period.",
    "The creative team released the film under a new title.",
]
#: How notices bring a licence's name in.
CARRIERS = ["Licensed under {}.", "Released under the terms of {}.", "{} applies to this work.", "This is {} licensed code.", "License: {}", "Available under the {}.", "Distributed under {}, see the file LICENSE.", "The code is free to use ({}).", "{}", "{}: full text in the repository", "Terms of the {}"]
#: Names that say something else where no licence is named, and how notices name a licence by them.
BARE = {"Apache": "Apache", "BSD": "BSD", "GPL": "GNU", "ISC": "ISC", "MIT": "MIT", "MPL": "Mozilla"}
BARE_CARRIERS = ["{} licence", "License: {}", "Licence {}", "Lizenz: {}", "{} Lizenz", "Licencia {}", "licensed under {}", "the {} license", "under the {} license", "{} licensed"]
#: Notices of licences whose name nobody knows.
UNKNOWN_FORMS = ["Licensed under the {} License, version {n}.", "Released under the {} Public License.", "Distributed under the terms of the {} {} Licence {n}.", "{} License", "Use of {} is subject to the {} License Agreement.", "The {} licence applies to all files.", "This work is under the {} {} License; see the terms of the license.", "License: {}-{n}.0"]
#: Lines that go with licences and are none.
NOTICES = ["Copyright (c) {a} {} {}", "Copyright {a} The {} Authors", "(c) {a}-{b} {} {}", "Copyright (C) {a}, {b} {} <{}@example.org>", "Author: {} {}, {a}", "Copyright {}", "© {a} {} {}", "Version {a}.{b} by {}"]
#: Names and phrases of licences that mean something else where nothing is licensed.
COMMON_NAMES = ["Apache", "MIT", "BSD", "public domain", "creative", "commons", "Mozilla", "attribution", "GNU", "common", "general public", "source", "lesser", "Berkeley", "Eclipse", "free software", "copyright", "warranty", "rights", "permission"]
OTHER, UNKNOWN = "other", "unknown"
FAMILIES = [OTHER, UNKNOWN, *sorted(TEMPLATES)]
WINDOW, STRIDE = 40, 20
#: Corpus paragraphs that train the ordinary class, at most; the only sampled thing here.
TRAIN_PARAGRAPHS = 3000
#: A paragraph is a licence from this calibrated probability on; a family may be named from its own.
LICENCE, NAMED = 0.5, 0.1
#: Part of a template's word pairs (or of the paragraph's, if it is the shorter) that confirms a family,
#: together with a word or pair that no other family's templates have.
CONFIRM = 0.6
#: Where no template is near, a family with a word of its own is confirmed from that probability of a licence on
#: at which the lines that calibration holds out are right in this part of all cases.
PRECISION = 0.98
#: One template in so many of each family is kept from the first fit, which is calibrated on it.
HELD = 3
#: Words of licensing; corpus lines that hold one are not taken for ordinary ones.
_LICENSING = re.compile(r"licen[cs]|copyright|\bgpl|redistribut|warrant|public domain|rights reserved", re.I)

_TOKEN = np.zeros(256, bool)
_TOKEN[48:58] = _TOKEN[65:91] = _TOKEN[97:123] = _TOKEN[128:] = True
_PAIR = B.U(0xC2B2AE3D27D4EB4F), B.U(0x9E3779B97F4A7C15)


def _units(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a block of texts: their hashes, the hashes of the pairs that they start (0 at a line's
    end), the line of each, and the first word of each text. Lines are numbered through the block."""
    starts, ends = B.runs(_TOKEN[data], off)
    w = B.range_hashes(B.LOWER[data], starts, ends)
    breaks = np.sort(np.concatenate([np.flatnonzero(data == 10), off[1:-1]]))
    line = np.searchsorted(breaks, starts, "right")
    pair = np.zeros(len(w), np.uint64)
    if len(w) > 1:
        together = line[1:] == line[:-1]
        pair[:-1] = np.where(together, B.mix(w[:-1] * _PAIR[0] + w[1:] * _PAIR[1]), B.U(0))
    return w, pair, line, np.searchsorted(starts, off)


def _of(text: str) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(text.replace("\n", " ").encode(), np.uint8)
    w, pair, _, _ = _units(data, np.array([0, len(data)]))
    return np.unique(w), np.unique(pair[pair != 0])


class Templates:
    """The word pairs of each family's templates, and the words and pairs of its own."""

    def __init__(self) -> None:
        self.pairs = {k: [_of(t)[1] for t in v] for k, v in TEMPLATES.items()}
        seen: dict[int, set[str]] = {}
        often: Counter = Counter()
        for k, texts in [*((k, [*TEMPLATES[k], *NAMES[k]]) for k in TEMPLATES), *((t, [t]) for t in (*OTHER_LICENCES, *CARRIERS, *UNKNOWN_FORMS, *NOTICES))]:
            for t in texts:
                for x in np.concatenate(_of(t)).tolist():
                    seen.setdefault(x, set()).add(k)
                    often[x] += 1
        self.families_of = seen
        self.own = {k: np.array(sorted(x for x, f in seen.items() if f == {k}), np.uint64) for k in TEMPLATES}
        # what several of its texts have, or one of its names, not one text by chance
        called = {k: set(np.concatenate([np.concatenate(_of(n)) for n in NAMES[k]]).tolist()) for k in TEMPLATES}
        self.names = {k: np.array([x for x in v.tolist() if often[x] > 1 or x in called[k]], np.uint64) for k, v in self.own.items()}

    def is_named(self, family: str, words: np.ndarray, pairs: np.ndarray) -> bool:
        """Whether a word or pair is there that several of the family's texts have and no other licence."""
        return bool(np.isin(self.names[family], pairs).any() or np.isin(self.names[family], words).any())

    def has_own(self, family: str, words: np.ndarray, pairs: np.ndarray) -> bool:
        """Whether a word or pair that no other licence has is there."""
        return bool(np.isin(self.own[family], pairs).any() or np.isin(self.own[family], words).any())

    def overlaps(self, family: str, pairs: np.ndarray) -> bool:
        """Whether enough of one of the family's templates is there, or the text is part of one."""
        return any(len(t) and len(pairs) and len(np.intersect1d(t, pairs)) >= CONFIRM * min(len(t), len(pairs)) for t in self.pairs[family])


@functools.cache
def templates() -> Templates:
    return Templates()


class Model:
    """A sparse vocabulary of word and word-pair hashes with a weight for each class."""

    def __init__(self, vocabulary: np.ndarray, weight: np.ndarray, bias: np.ndarray, temperature: float, sure: float = 1.0):
        self.vocabulary, self.weight, self.bias, self.temperature, self.sure = vocabulary, weight, bias, temperature, sure
        self.may = np.zeros(1 << 16, bool)
        self.may[(vocabulary >> B.U(48)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the hashes that are in the vocabulary, and which features they are."""
        at = np.flatnonzero(self.may[(hashes >> B.U(48)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        same = self.vocabulary[k] == hashes[at]
        return at[same], k[same]

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = (logits - logits.max(axis=1, keepdims=True)) / self.temperature
        z = np.exp(z)
        return z / z.sum(axis=1, keepdims=True)

    def decide(self, features: np.ndarray, words: np.ndarray, pairs: np.ndarray) -> set[str]:
        """The families of one paragraph, each predicted and confirmed; ``unknown`` alone for a licence of
        no confirmed family; none for another text. ``features`` are those of the vocabulary that it
        has, ``words`` and ``pairs`` its distinct hashes.

        What is a named family's own is then left out and the rest classified again, so a line may name
        several; families of equal probability are all named."""
        found: set[str] = set()
        if not len(pairs):
            return found
        while True:
            chance = self.probabilities((self.weight[features].sum(axis=0) + self.bias)[None])[0]
            licence = 1 - chance[0] >= LICENCE
            likely = [FAMILIES[k] for k in np.flatnonzero(chance >= NAMED).tolist() if k > 1]
            own = templates()
            named = {f for f in likely if (1 - chance[0] >= self.sure and own.is_named(f, words, pairs)) or (own.has_own(f, words, pairs) and own.overlaps(f, pairs))} - found
            if not licence or not named:
                return found or ({UNKNOWN} if licence else found)
            found |= named
            theirs = np.concatenate([own.own[f] for f in named])
            features = features[~np.isin(self.vocabulary[features], theirs)]


def _examples(ordinary: list[str], held: bool | None, seed: int = 3) -> tuple[list[str], list[int]]:
    """Templates with words left out or set among ordinary ones, licences of no family, and ordinary
    paragraphs. ``held`` takes the templates kept for calibration, its opposite the rest, None all."""
    rng = np.random.default_rng(seed + bool(held))
    take = lambda k: held is None or (k % HELD == HELD - 1) == held
    pool = [w for t in [*ORDINARY, *ordinary[:300]] for w in t.split()]
    texts: list[str] = []
    labels: list[int] = []

    def add(words: list[str], label: int, copies: int) -> None:
        for copy in range(copies):
            keep = [w for w in words if rng.random() > (0.08 if copy else 0) or len(words) < 6]
            around = [pool[i] for i in rng.integers(0, len(pool), int(rng.integers(0, 16)) if copy > 4 else 0)]
            cut = int(rng.integers(0, len(around) + 1))
            texts.append(" ".join([*around[:cut], *keep, *around[cut:]]))
            labels.append(label)

    invented = lambda: "".join(rng.choice(list("bdfgklmnprstvz")) + rng.choice(list("aeiou")) for _ in range(int(rng.integers(2, 4)))).capitalize()
    year = lambda: str(int(rng.integers(1985, 2030)))
    for k, family in enumerate(FAMILIES[2:], 2):
        for j, template in enumerate(TEMPLATES[family]):
            if not take(j):
                continue
            add(template.split(), k, 12)
            # the same licence without what is its own is of no known family
            known = templates().families_of
            for _ in range(3):
                bare = [invented() if any(len(known.get(x, ())) <= 3 for x in _of(w)[0].tolist()) else w for w in template.split()]
                add(bare, 1, 1)
        for j, name in enumerate(NAMES[family]):
            if take(j):
                for carrier in CARRIERS:
                    add(carrier.format(name).split(), k, 2)
        for j, carrier in enumerate(BARE_CARRIERS if family in BARE else []):
            if take(j):
                add(carrier.format(BARE[family]).split(), k, 4)
    for j, t in enumerate(OTHER_LICENCES):
        if take(j):
            add(t.split(), 1, 12)
    for j in range(200):
        if take(j):
            add(UNKNOWN_FORMS[j % len(UNKNOWN_FORMS)].format(invented(), invented(), n=int(rng.integers(1, 9))).split(), 1, 3)
    for j in range(160):
        if take(j):
            add(NOTICES[j % len(NOTICES)].format(invented(), invented(), a=year(), b=year()).split(), 0, 2)
    for j, t in enumerate(ORDINARY):
        if take(j):
            add(t.split(), 0, 12)
    # words that licences share with other subjects, in sentences about those
    for j in range(2400):
        if take(j):
            words = ORDINARY[int(rng.integers(0, len(ORDINARY)))].split() if j % 2 or not ordinary else ordinary[int(rng.integers(0, min(len(ordinary), 300)))].split()[:30]
            for word in [COMMON_NAMES[j % len(COMMON_NAMES)], *(["licence", "license", "licensed", "terms", "under"][int(i)] for i in rng.integers(0, 5, int(rng.integers(0, 2))))]:
                at = int(rng.integers(0, len(words) + 1))
                words = [*words[:at], *word.split(), *words[at:]]
            add(words, 0, 1)
    plain = [t for j, t in enumerate(ordinary) if take(j)]
    return texts + plain, labels + [0] * len(plain)


def _rows(blank: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The (row, feature) pairs of texts, by row; every row has one at least, a feature that is always 0."""
    features = [np.append(blank.find(np.concatenate(_of(t)))[1], len(blank.vocabulary)) for t in texts]
    return np.repeat(np.arange(len(texts)), [len(f) for f in features]), np.concatenate(features)


def _fit(rows: np.ndarray, features: np.ndarray, labels: np.ndarray, size: int, steps: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on sparse rows: full-batch Adam with an L2 penalty; weights and bias."""
    n, c = len(labels), len(FAMILIES)
    goal = np.eye(c, dtype=np.float32)[labels]
    first = np.flatnonzero(np.r_[True, np.diff(rows) > 0])
    by_feature = np.argsort(features, kind="stable")
    sorted_features = features[by_feature]
    starts = np.flatnonzero(np.r_[True, np.diff(sorted_features) > 0])
    used = sorted_features[starts]
    weight, bias = np.zeros((size + 1, c), np.float32), np.zeros(c, np.float32)
    moments = [np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(bias), np.zeros_like(bias)]
    for step in range(1, steps + 1):
        z = np.add.reduceat(weight[features], first, axis=0) + bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = (z / z.sum(axis=1, keepdims=True) - goal) / n
        grad = 1e-5 * weight
        grad[used] += np.add.reduceat(d[rows[by_feature]], starts, axis=0)
        grad[size] = 0
        for k, (p, g) in enumerate(((weight, grad), (bias, d.sum(axis=0)))):
            m, v = moments[2 * k], moments[2 * k + 1]
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return weight[:size], bias


@functools.lru_cache(maxsize=4)
def _trained(ordinary: tuple[str, ...]) -> Model:
    own = templates()
    seen = np.unique(np.fromiter(own.families_of, np.uint64, len(own.families_of)))
    plain = [t for t in ordinary if t.strip() and not _LICENSING.search(t)]
    more = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.concatenate(_of(t)) for t in (*ORDINARY, *CARRIERS, *UNKNOWN_FORMS, *NOTICES, *COMMON_NAMES))]))
    blank = Model(np.union1d(seen, more), np.zeros((1, 1)), np.zeros(1), 1.0)
    size = len(blank.vocabulary)

    def fitted(held: bool | None) -> tuple[np.ndarray, np.ndarray]:
        texts, labels = _examples(plain, held)
        return _fit(*_rows(blank, texts), np.array(labels), size)

    # the temperature is that which suits templates that the first fit has not seen
    weight, bias = fitted(False)
    texts, labels = _examples(plain, True)
    rows, features = _rows(blank, texts)
    z = np.add.reduceat(np.vstack([weight, np.zeros((1, weight.shape[1]), np.float32)])[features], np.flatnonzero(np.r_[True, np.diff(rows) > 0]), axis=0) + bias

    def loss(t: float) -> float:
        q = z / t
        q = q - q.max(axis=1, keepdims=True)
        return float((np.log(np.exp(q).sum(axis=1)) - q[np.arange(len(labels)), labels]).mean())

    temperature = min((0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0), key=loss)
    # the lowest probability of a licence from which on the held-out lines are licences nearly always
    chance = 1 - Model(blank.vocabulary, weight, bias, temperature).probabilities(z)[:, 0]
    order = np.argsort(-chance, kind="stable")
    right = np.cumsum(np.array(labels)[order] != 0) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= PRECISION)
    sure = float(max(LICENCE, chance[order[good[-1]]])) if len(good) else 1.0
    return Model(blank.vocabulary, *fitted(None), temperature, sure)


def train(ordinary: list[str]) -> Model:
    """The classifier: softmax regression over distinct words and word pairs of licences. It is calibrated
    on templates that a first fit has not seen and then fitted to all; the same paragraphs give
    the same model, which is kept."""
    return _trained(tuple(ordinary))


def ordinary_paragraphs(docs: DataFrame, most: int = TRAIN_PARAGRAPHS) -> list[str]:
    """A bounded sample of the corpus's lines of up to 40 words, drawn by a hash of their text."""
    texts = docs.where("text IS NOT NULL").select("text")
    n = texts.count()
    share = min(1 << 20, -(-(1 << 20) * most // max(n, 1)))
    drawn = texts.where(F.pmod(F.xxhash64("text", F.lit("licences")), F.lit(1 << 20)) < share)
    line = drawn.select(F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> '' AND length(line) < 400").distinct()
    return [r["line"] for r in line.orderBy(F.xxhash64("line"), "line").limit(most).collect()]


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, families (sorted, distinct, ``unknown`` included), n_paragraphs (lines with words) and
    n_licence (lines that hold a licence) of every whole text.

    A line of over 40 words is read in windows of 40 words, 20 apart. Null and empty texts have no
    paragraph; repeated rows each get a result; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def block(own: Model, data: np.ndarray, off: np.ndarray):
        w, pair, line, first = _units(data, off)
        n = len(off) - 1
        families: list[set[str]] = [set() for _ in range(n)]
        licensed: list[set[int]] = [set() for _ in range(n)]
        text_of_word = np.repeat(np.arange(n), np.diff(first))
        new = np.ones(len(w), bool)
        new[1:] = line[1:] != line[:-1]
        paragraphs = np.bincount(text_of_word[new], minlength=n)
        if not len(w):
            return families, licensed, paragraphs
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], len(w))
        number = np.cumsum(new) - 1
        place = np.arange(len(w)) - begins[number]
        size = (ends - begins)[number]
        # a word belongs to the window at its stride and to the one before; the last window is full
        last = np.maximum(0, -(-(size - WINDOW) // STRIDE))
        hits = []
        for hashes, reach in ((w, 0), (pair, 1)):
            at, feature = own.find(hashes)
            for back in (0, 1):
                window = np.minimum(place[at] // STRIDE, last[at]) - back
                ok = (window >= 0) & (window * STRIDE + WINDOW > place[at] + reach)
                hits.append((number[at][ok], window[ok], feature[ok]))
        units, windows, features = (np.concatenate(x) for x in zip(*hits))
        if not len(units):
            return families, licensed, paragraphs
        code = np.unique(np.stack([units, windows, features], axis=1), axis=0)
        change = np.flatnonzero(np.r_[True, (np.diff(code[:, :2], axis=0) != 0).any(axis=1)])
        logits = np.add.reduceat(own.weight[code[:, 2]], change, axis=0) + own.bias
        chances = own.probabilities(logits)
        change = np.append(change, len(code))
        of_line: dict[int, set[str]] = {}
        for k in np.flatnonzero(1 - chances[:, 0] >= LICENCE).tolist():
            u, v = code[change[k], :2].tolist()
            a = begins[u] + v * STRIDE
            b = min(a + WINDOW, ends[u])
            pairs = np.unique(pair[a : b - 1])
            if found := own.decide(code[change[k] : change[k + 1], 2], np.unique(w[a:b]), pairs[pairs != 0]):
                of_line.setdefault(u, set()).update(found)
        for u, found in of_line.items():
            # what one part of a line names, its other parts belong to
            row = text_of_word[begins[u]]
            families[row] |= found - {UNKNOWN} or found
            licensed[row].add(u)
        return families, licensed, paragraphs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = B.column_bytes(batch["text"])
            for a, b in B.blocks(off):
                families, licensed, paragraphs = block(shared.value, data[off[a] : off[b]], off[a : b + 1] - off[a])
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].slice(a, b - a), pa.array([sorted(f) for f in families], pa.list_(pa.string())), pa.array(paragraphs.astype(np.int64)), pa.array([len(s) for s in licensed], pa.int64())],
                    ["doc_id", "families", "n_paragraphs", "n_licence"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, families array<string>, n_paragraphs long, n_licence long")


def licence_scan(docs: DataFrame) -> DataFrame:
    """``scan`` with a classifier whose ordinary class is a bounded sample of the table's own lines.

    doc_id, families, n_paragraphs and n_licence of every row: null and empty texts have none, repeated rows each
    have their result, families of equal probability are all named, an empty table gives an empty result, and
    other columns may have any names.
    """
    return scan(docs, train(ordinary_paragraphs(docs)))


def plain_mentions(text: str) -> set[str]:
    """Families whose full short notice is in a text word for word; a check for tests."""
    words = " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower()))
    return {f for f, v in TEMPLATES.items() for t in v if " ".join(re.findall(r"[a-z0-9]+", t.lower())) in words}
