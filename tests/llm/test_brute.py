"""Language mixtures and licence scans, row by row, against plain versions of the same models."""

import math
import re

import numpy as np
from pyspark.sql import functions as F

from agendaflow.llm import language, licences, mixing

from .test_operators import documents, edge, edge_rows


def buckets(text):
    """The trigram buckets of a text, byte by byte."""
    data = [b + 32 if 65 <= b <= 90 else b for b in text.encode()]
    for k in range(1, len(data)):
        if text.encode()[k - 1] == 0xC3 and 0x80 <= data[k] <= 0x9E and data[k] != 0x97:
            data[k] += 32
    out = [32]
    for b in data:
        b = b if 97 <= b <= 122 or b >= 128 else 32
        if b != 32 or out[-1] != 32:
            out.append(b)
    if out[-1] != 32:
        out.append(32)
    return [((((a << 16) | (b << 8) | c) * 2654435761) % (1 << 32)) >> 17 for a, b, c in zip(out, out[1:], out[2:])]


def mixture(rows):
    """Proportions after the rounds of expectation-maximisation, and the log likelihood."""
    k = len(rows[0])
    weight = [1.0 / k] * k
    for _ in range(60):
        total = [0.0] * k
        for r in rows:
            s = sum(p * w for p, w in zip(r, weight))
            for j in range(k):
                total[j] += r[j] * weight[j] / s
        new = [t / len(rows) for t in total]
        done = max(abs(a - b) for a, b in zip(new, weight)) < 1e-4
        weight = new
        if done:
            break
    return weight, sum(math.log(sum(p * w for p, w in zip(r, weight))) for r in rows)


def plain_language(text, langs, table):
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0, []
    logs = [[float(x) for x in table[b]] for b in buckets(text)]
    n, k = len(logs), len(langs)
    single = [sum(r[j] for r in logs) / language.OVERLAP for j in range(k)]
    best = max(range(k), key=lambda j: single[j])
    posterior = 1 / (1 + sum(math.exp(max(-60, min(0, single[j] - single[best]))) for j in range(k) if j != best))
    cost = language.PENALTY * math.log(max(n / language.OVERLAP, 2.0))
    prob = [[math.exp(x) for x in r] for r in logs]
    full, _ = mixture(prob)
    order = [best, *sorted((j for j in range(k) if j != best), key=lambda j: -full[j])]
    worth, chosen, weights = single[best] - cost, [best], [1.0]
    for size in range(2, k + 1):
        got, ll = mixture([[r[j] for j in order[:size]] for r in prob])
        if ll / language.OVERLAP - size * cost <= worth:
            break
        worth, chosen, weights, posterior = ll / language.OVERLAP - size * cost, order[:size], got, 1.0
    top = max(range(len(chosen)), key=lambda i: weights[i])
    return langs[chosen[top]], weights[top] * posterior, sorted(langs[j] for j in chosen)


def test_language_equals_the_plain_mixture(spark):
    docs = documents(spark, "sf0.01")
    langs, table = language.train(docs)
    by = {k: [r.text for r in docs.where((F.col("lang") == k) & (F.length("text") > 900)).orderBy("doc_id").limit(4).collect()] for k in langs}
    texts = [t[:300] for v in by.values() for t in v[:2]] + [a[0][:250] + " " + b[1][:n] for n in (60, 150, 250) for a in by.values() for b in by.values() if a is not b]
    texts += ["Zum", "a", "É", "12 ! 3", "", None, "the der le el", "漢字", *(r[1] for r in edge_rows() if r[0] != 5)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = language.predict(rows, langs, table).collect()
    mixed = 0
    for r in got:
        lang, score, chosen = plain_language(texts[r.doc_id], langs, table)
        assert (r["__lang_pred"], sorted(r["__lang_set"])) == (lang, chosen)
        assert abs(r["__score"] - min(1.0, score)) < 2e-3
        mixed += len(chosen) > 1
    assert mixed >= 8


def plain_licences(text, model):
    """Families, lines with words and lines with a licence, window by window."""
    families, lines, licensed = set(), 0, 0
    for line in (text or "").split("\n"):
        words = re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", line)
        lines += bool(words)
        found = set()
        for v in range(max(0, -(-(len(words) - licences.WINDOW) // licences.STRIDE)) + 1 if words else 0):
            own = licences._of(" ".join(words[v * licences.STRIDE : v * licences.STRIDE + licences.WINDOW]))
            features = np.flatnonzero(np.isin(model.vocabulary, np.concatenate(own)))
            if len(features):
                z = [sum(float(model.weight[f, c]) for f in features) + float(model.bias[c]) for c in range(len(licences.FAMILIES))]
                e = [math.exp((x - max(z)) / model.temperature) for x in z]
                if 1 - e[0] / sum(e) >= licences.LICENCE:
                    found |= model.decide(features, *own)
        families |= found - {"unknown"} or found
        licensed += bool(found)
    return sorted(families), lines, licensed


def test_licences_equal_the_plain_scan(spark):
    docs = documents(spark, "sf0.001")
    model = licences.train(licences.ordinary_paragraphs(docs))
    for given in (docs, edge(spark, True)):
        rows = given.select("doc_id", "text").collect()
        got = sorted(map(repr, (tuple(r) for r in licences.scan(given, model).collect())))
        assert got == sorted(repr((r.doc_id, *plain_licences(r.text, model))) for r in rows)


def test_licences_that_are_no_template(spark):
    docs = documents(spark, "sf0.01")
    model = licences.train(licences.ordinary_paragraphs(docs))
    assert model is licences.train(licences.ordinary_paragraphs(docs))
    mit = licences.TEMPLATES["MIT"]
    cases = {
        "Licensed under the Eclipse Public License, version 2.0.": ["unknown"],
        "This font is licensed under the Frobnicate Public License, version 7, see the terms of the license.": ["unknown"],
        "Permission is hereby granted to copy this manual provided the notice is kept.": ["unknown"],
        "Released under the Vortigern Community License 3.": ["unknown"],
        "GPLv2 or any later version": ["GPL"],
        "MIT-style licence": ["MIT"],
        "Dual licensed under MIT and Apache-2.0": ["Apache", "MIT"],
        "Available under either the GPL or the MIT licence.": ["GPL", "MIT"],
        "Licensed under CC BY-SA 4.0.": ["CC-BY-SA"],
        " ".join([mit[5], mit[3], mit[4]]): ["MIT"],
        f"{mit[0]}\nLicensed under the Eclipse Public License, version 2.0.": ["MIT", "unknown"],
        "He got his driving license in March.": [],
        "Der Hund geht mit dem Mann in den Park.": [],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    assert {t: list(r.families) for r in licences.scan(rows, model).collect() for t in [list(cases)[r.doc_id]]} == cases


def test_calibration_templates_are_unseen():
    """No template of the first fit is among those that calibrate it."""
    for family, texts in licences.TEMPLATES.items():
        held = [k for k in range(len(texts)) if k % licences.HELD == licences.HELD - 1]
        assert len(held) < len(texts) and (len(texts) < licences.HELD or held), family


def plain_targets(sizes, weights):
    """Shares by weight; whoever is over three times its size is set to that, one after another, and the rest is
    shared anew, until nobody is."""
    total, fixed = float(sum(sizes)), {}
    while True:
        left = total - sum(fixed.values())
        free = [k for k in range(len(sizes)) if k not in fixed]
        share = {k: left * weights[k] / sum(weights[j] for j in free) for k in free}
        over = [k for k in free if share[k] > 3 * sizes[k]]
        if not over:
            return [fixed.get(k, share.get(k)) for k in range(len(sizes))]
        fixed |= {k: 3.0 * sizes[k] for k in over}


def test_mixing_equals_the_plain_rules(spark):
    """Sizes, sources and targets by their definitions; takings near them by the blocks at hand; no document above
    three; the splitting tree deals each draw to one shard; and reruns agree."""
    docs = documents(spark, "sf0.01").unionByName(edge(spark, False).withColumn("doc_id", F.col("doc_id") + 1_000_000).select(*documents(spark).columns))
    rows = docs.collect()
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows]
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for r, n in zip(rows, size) if r.source == s) for s in names}
    goal = dict(zip(names, plain_targets([total[s] for s in names], [(5.0, 2.0, 1.0)[k % 3] for k in range(len(names))])))
    got = mixing.takings(docs).collect()
    key = lambda r, n: (r.doc_id is None, r.doc_id or 0, n)
    source_of = {r.doc_id: r.source for r in rows}
    assert sorted(key(r, r.size) for r in got) == sorted(key(r, n) for r, n in zip(rows, size))
    taken = dict.fromkeys(names, 0)
    for r in got:
        s = source_of[r.doc_id] if r.doc_id is not None else next(x for x in names if total[x] == r.source_size)
        assert r.source_size == total[s] and math.isclose(r.target, goal[s], rel_tol=1e-9, abs_tol=1e-6)
        assert r.taken == r["size"] * len(r.shards) and len(r.shards) <= 3 and all(0 <= x < mixing.SHARDS for x in r.shards)
        taken[s] += r.taken
    for s in names:
        largest = max([n for r, n in zip(rows, size) if r.source == s], default=0)
        assert abs(taken[s] - goal[s]) <= largest, s
    again = mixing.takings(docs.repartition(5)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_the_splitting_tree_deals_as_a_shuffled_pack():
    """Block quotas of the tree against dealing one shuffled pack of all blocks: equal means and spreads."""
    quotas, shards, draws = np.array([40, 25, 7, 0, 1]), 6, 3000
    tree = np.stack([mixing.split_quotas(quotas, shards, np.random.default_rng(k)) for k in range(draws)])
    pack, rng = np.repeat(np.arange(5), quotas), np.random.default_rng(99)
    ends = np.cumsum(tree[0].sum(axis=1))
    plain = np.zeros_like(tree)
    for k in range(draws):
        for j, hand in enumerate(np.split(rng.permutation(pack), ends[:-1])):
            plain[k, j] = np.bincount(hand, minlength=5)
    assert (tree.sum(axis=1) == quotas).all() and (tree.sum(axis=2) == tree[0].sum(axis=1)).all()
    assert np.abs(tree.mean(axis=0) - plain.mean(axis=0)).max() < 0.2
    assert np.abs(tree.std(axis=0) - plain.std(axis=0)).max() < 0.15


#: Headers and sentences that no training text quotes, and what they name.
HEADERS = {
    "This file is part of Foo. Foo is free software under the GPL version 2.": ["GPL"],
    "Code licensed Apache 2.0, docs CC BY 4.0": ["Apache", "CC-BY"],
    "@license MIT": ["MIT"],
    "// SPDX-License-Identifier: GPL-2.0-only": ["GPL"],
    "# SPDX-License-Identifier: LGPL-2.1-or-later": ["LGPL"],
    "/* SPDX-License-Identifier: BSD-3-Clause */": ["BSD"],
    "SPDX-License-Identifier: EUPL-1.2": ["unknown"],
    "SPDX-License-Identifier: WTFPL": ["unknown"],
    "Published under a Creative Commons Attribution-ShareAlike 3.0 licence": ["CC-BY-SA"],
    "Photos: Creative Commons Attribution-NonCommercial 2.0": ["CC-BY-NC"],
    "This dataset is dedicated to the public domain under CC0.": ["CC0"],
    "Distributed under the ISC license.": ["ISC"],
    "Mozilla Public License 2.0 applies": ["MPL"],
    "The library is covered by the GNU Lesser General Public License.": ["LGPL"],
    "the server part is AGPLv3": ["AGPL"],
    "Affero GPL: GNU AGPL-3.0-or-later": ["AGPL"],
    "BSD licensed, see LICENSE.txt": ["BSD"],
    "Veröffentlicht unter der MIT-Lizenz": ["MIT"],
    "You may use this under the terms of the Apache License 2.0": ["Apache"],
    "Licensed to the public under the Unlicense": ["Public-Domain"],
    "(c) 2015 by the editors. All rights reserved worldwide.": ["Reserved"],
    "Copyright (c) 2011-2014, Some Company Inc.": [],
    "Copyright 1999 Anna Schmidt": [],
    "(C) 2003 The Tree Project Contributors": [],
    "Written by Paul and Mary in 2009": [],
    "The pilot lost his licence after the accident.": [],
    "A fishing license costs ten euros a day.": [],
    "The Apache people lived in the southwest.": [],
    "MIT researchers published the study in May.": [],
    "The BSD team won the cup again.": [],
    "Mozilla hosted a party in the old town.": [],
    "The public domain is discussed in chapter four.": [],
    "The Creative Commons offices moved to a new street.": [],
    "Attribution of the painting to Rembrandt is disputed.": [],
    "Software engineers met at the conference hall.": [],
    "The terms of the peace treaty were harsh.": [],
    "Poetic licence allows the author such freedoms.": [],
    "He was granted permission to leave the country.": [],
    "The warranty on the machine has expired.": [],
    "They distribute food without charge to the poor.": [],
    "Notice of the meeting appeared in all copies of the newspaper.": [],
    "The gnu and the zebra drink at the river.": [],
    "Released under the Sleepycat License": ["unknown"],
    "This package is under the Ruby license.": ["unknown"],
    "License: Vim": ["unknown"],
    "Licensed under the Open Software License 3.0": ["unknown"],
    "Covered by the Zope Public License (ZPL) Version 2.1": ["unknown"],
    "The Artistic License applies": ["unknown"],
    "Licencia MIT": ["MIT"],
    "Dual license: MPL 1.1 or GPL 2.0": ["GPL", "MPL"],
}


def test_unseen_headers(spark):
    """Precision and recall of families on lines that training has not seen; each line alone is a document."""
    model = licences.train(licences.ordinary_paragraphs(documents(spark, "sf0.01")))
    trained = " ".join([*(t for v in licences.TEMPLATES.values() for t in v), *licences.OTHER_LICENCES, *licences.ORDINARY]).lower()
    assert not any(h.lower() in trained for h in HEADERS)
    rows = spark.createDataFrame(list(enumerate(HEADERS)), "doc_id long, text string")
    got = {list(HEADERS)[r.doc_id]: set(r.families) for r in licences.scan(rows, model).collect()}
    hit = sum(len(got[h] & set(v)) for h, v in HEADERS.items())
    assert hit >= 0.85 * sum(len(v) for v in got.values()) and hit >= 0.85 * sum(map(len, HEADERS.values()))


def test_copyright_lines_are_no_licence(spark):
    model = licences.train(licences.ordinary_paragraphs(documents(spark, "sf0.01")))
    text = "MIT License\nCopyright (c) 2024 Jane\n\n" + licences.TEMPLATES["MIT"][6]
    (r,) = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    assert r.families == ["MIT"] and r.n_licence == 2
