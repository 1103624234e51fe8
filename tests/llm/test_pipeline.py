"""The pipeline's rows against a brute-force version of every stage on what the stage before kept."""

import collections
import random
import re
import statistics

import corpus_pipeline
import numpy as np
from agendaflow.llm import language, lines, mixing
from agendaflow.llm.shared import cut
from pyspark.sql import functions as F

from .test_operators import SCHEMA, WORD, brute_components, check_packed, documents, edge, library, shingles  # noqa: F401


def test_stages(spark, library):  # noqa: F811
    rng = random.Random(2)
    menu = [(5000 + k, f"The menu of the site\n{' '.join(rng.choice(['sea', 'wind', 'hill', 'rain', 'moon']) for _ in range(30))}", "en", "site", 0) for k in range(12)]
    docs = documents(spark).unionByName(edge(spark)).unionByName(spark.createDataFrame(menu, SCHEMA))
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None

    def step(name, given):
        out = cut(stages[name](spark, given, ""), name)
        if name != "packing":
            assert out.columns == columns
        return out, out.collect()

    rows = docs.collect()
    one, got = step("language_id", docs)
    langs, table = language.train(docs.where(~language.is_held_out()))
    said = language.predict(docs, langs, table, ["doc_id", "text"]).collect()
    want = collections.Counter((r.doc_id, r.text) for r in said if r["__lang_pred"] != "und" and r["__score"] >= 0.2)
    assert collections.Counter((r.doc_id, r.text) for r in got) == want
    lettered = collections.Counter((r.doc_id, r.text) for r in rows if any(c.isalpha() for c in r.text or ""))
    assert sum(want.values()) >= 0.98 * sum(lettered.values()) and not want - lettered

    rows = got
    two, got = step("line_dedup", one)
    total = collections.Counter(r.source for r in rows if r.source is not None)
    seen = collections.Counter((r.source, x) for r in rows if r.source is not None for x in {x.strip(" ") for x in r.text.split("\n")} - {""})

    def clean(r):
        often = lambda x: total[r.source] >= lines.LEAST_PAGES and seen[(r.source, x.strip(" "))] > lines.RATIO * max(total[r.source], lines.LEAST_PAGES)
        return r.text if r.source is None else "\n".join(x for x in r.text.split("\n") if not often(x))

    assert collections.Counter((r.doc_id, r.text, r.n_chars) for r in got) == collections.Counter((r.doc_id, clean(r), len(clean(r))) for r in rows)
    assert all("menu" not in r.text for r in got if (r.doc_id or 0) >= 5000)

    rows = got
    three, got = step("near_dedup", two)
    component = brute_components(rows)
    keep = {d for d, c in component.items() if d == c}
    words = lambda t: " ".join(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)))
    # rows that repeat an id stay once for each sequence of words
    once = {(r.doc_id, words(r.text)) for r in rows if r.doc_id in keep and words(r.text)}
    blank = [(r.doc_id, "") for r in rows if r.doc_id in keep and not words(r.text)]
    assert sorted((r.doc_id, words(r.text)) for r in got if r.doc_id is not None) == sorted([*once, *blank])
    assert sum(r.doc_id is None for r in got) == sum(r.doc_id is None for r in rows)
    assert len(keep) < len(component)

    rows = got
    four, got = step("mixing", three)
    copies = collections.Counter((r.doc_id, r.text) for r in got)
    size = lambda t: len([x for x in t.translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if x])
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r.source] += size(r.text)
        largest[r.source] = max(largest[r.source], size(r.text))
    for r in got:
        taken[r.source] += size(r.text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    for s, target in zip(order, mixing.targets([sizes[s] for s in order])):
        assert abs(taken[s] - target) <= max(0.02 * target, largest[s] / 2 + 1)
    assert max(copies.values()) <= 3 * max(collections.Counter((r.doc_id, r.text) for r in rows).values())

    rows = got
    _, got = step("packing", four)
    n, least = check_packed(got, rows, library, 1024)
    assert n <= 1.05 * least + 2
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").where(F.col("length") < 1).count() == 0


def test_line_dedup_keeps_copies(spark):
    rows = [(k, f"first of a copy\nsecond of a copy{' ' * (k % 2)}", "en", "copied", 0) for k in range(20)]
    rows += [(k, f"menu\nown text {k}", "en", "copied", 0) for k in range(20, 50)]
    rows += [(60 + k, "all of a pair" if k < 2 else f"text {k}", "en", "small", 0) for k in range(5)]
    rows += [(70 + k, f"of two\ntext {k}" if k < 2 else f"text {k}", "en", "near", 0) for k in range(6)]
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert got == {k: t.removeprefix("menu\n") for k, t, *_ in rows}


def test_unlearned_language_goes(spark):
    rng = random.Random(6)
    docs = documents(spark, "sf0.01")
    gibberish = " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(2, 9))) for _ in range(60))
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."
    clean = docs.where("lang = 'en' AND doc_id > 500 AND n_chars > 2000").orderBy("doc_id").first().text
    texts = [gibberish, finnish, "Все люди рождаются свободными и равными в своем достоинстве и правах.", "That it.", clean[:40], clean[:150]]
    # ids whose crc32 keeps them from training, no label
    added = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in zip((70008, 70015, 70016, 70026, 70027, 70031), texts)], SCHEMA)
    for given in (docs, docs.withColumn("lang", F.concat("lang", (F.col("doc_id") % 8).cast("string")))):
        kept = corpus_pipeline.identify_language(spark, given.unionByName(added), "").select("doc_id", "text").collect()
        assert {r.text for r in kept if r.doc_id >= 70000} == set(texts[3:])
        assert len(kept) >= 0.99 * docs.count()


def test_medians_are_exact(spark):
    rng = random.Random(4)
    groups = {"odd": [rng.gauss(0, 1) for _ in range(1001)], "even": [rng.gauss(-9, 3) for _ in range(2000)], "pair": [1.5, -2.25], "one": [7.0], "same": [3.5] * 40}
    groups |= {"ties": [float(rng.randint(0, 3)) for _ in range(500)], "far": [10.0 ** rng.randint(-12, 12) for _ in range(300)], "halves": [0.1] * 50 + [0.2] * 50}
    rows = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v], "lang string, x double").repartition(3)
    for slots in (2, 7, language.SLOTS):
        assert language.medians(rows, "lang", "x", slots) == {k: statistics.median(v) for k, v in groups.items()}


def test_language_counts_every_document(spark):
    rng = random.Random(7)
    words = {"aa": ["sea", "wind", "hill", "rain", "moon"], "bb": ["zug", "kopf", "wurst", "quark", "jetzt"], "cc": ["oui", "chez", "noeud", "vieux"]}
    rows = [(k, " ".join(rng.choice(words[x]) for _ in range(rng.randint(3, 30))), x) for k, x in enumerate(["aa"] * 2600 + ["bb"] * 900 + ["cc"] * 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    langs, table = language.train(docs)
    sums = np.zeros((language.BUCKETS, 3))
    for _, text, lang in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        np.add.at(sums[:, langs.index(lang)], language._trigrams(data, np.array([0, len(data)]))[0], 1)
    assert langs == ["aa", "bb", "cc"] and np.allclose(table, np.log((sums + language.SMOOTHING) / (sums + language.SMOOTHING).sum(axis=0)), atol=1e-5)

    seen = [r for r in language.predict(docs, langs, table, ["lang"], fit=True).collect() if r["__lang_pred"] == r.lang]

    def usual(own):
        fits = [r["__fit"] for r in own]
        middle = statistics.median(fits)
        return middle, max(language.LEAST_SPREAD, 1.4826 * statistics.median(abs(x - middle) for x in fits)), statistics.median(r["__sd"] for r in own)

    want = {x: usual([r for r in seen if r.lang == x]) for x in ("aa", "bb")} | {"cc": usual(seen)}
    got = language.usual_fit(docs, langs, table)
    assert got.keys() == want.keys() and all(np.allclose(got[x], want[x], rtol=1e-12) for x in want)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, ""), "empty")
        assert docs.count() == 0
