"""Each operator against a brute-force version or an exact round trip, and its edge cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from agendaflow.llm import bytesops, catalog, fingerprints, language, licences, lines, mixing, neardup, neighbours, packing, sharding, token_files, tokens
from agendaflow.llm.components import components
from agendaflow.llm.shared import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns have names that operators use inside or for results.
EXTRA = SCHEMA + ", size long, shard int, host string, key string, component_id long, lang_pred string"
WORDS = "the cat sat on a mat and saw red birds over green hills near old stone walls by quiet rivers".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def edge_rows():
    rng = random.Random(4)
    long = " ".join(rng.choice(WORDS) for _ in range(20000))
    return [
        (1, None, "en", "s1", None),
        (2, "", "en", "s1", 0),
        (3, "   \n\t ", None, None, 6),
        (4, "one", "en", "s2", 3),
        (5, long, "en", "s2", len(long)),
        (6, "the cat sat on a mat", "en", None, 20),
        (6, "the cat sat on a mat", "en", None, 20),
        (None, "the cat sat on a mat", None, "s3", None),
        (None, None, None, None, None),
        (9, "12345 67", "de", "s3", 8),
        (10, "Die Katze saß auf der Matte und schlief\n\nganz ruhig. 漢字 😀", "de", "s3", 57),
    ]


def edge(spark, extra=False):
    if extra:
        return spark.createDataFrame([(*r, 1, 2, "h", "k", 3, "x") for r in edge_rows()], EXTRA)
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


# tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer_path())


def encoded(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(library):
    rng = random.Random(1)
    parts = list("ab sS'tdrevlm12.,!?\n\t  éñß—'’") + ["'s", "'re", "'ll", " '", "  ", "漢", "😀", "٣", "́", "\r\n", " ", "\xa0", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["", " ", "don't we've !'s 's\n's it''s"]
    data, off = bytesops.column_bytes(pa.array(texts))
    coder, got = tokens.encoder(tokens.default_tokenizer_path()), []
    for a, b in bytesops.blocks(off, 5000):
        ids, at = coder.encode(data[off[a] : off[b]], off[a : b + 1] - off[a])
        got += [ids[x:y].tolist() for x, y in zip(at[:-1], at[1:])]
    assert got == [encoded(library, t) for t in texts]


def test_token_files(spark, library):
    for docs in (documents(spark), edge(spark, True)):
        path = new_path(spark, "t")
        token_files.write_token_files(docs, path, file_bytes=40_000)
        table = token_files.read_token_files(spark, path)
        rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0))
        want = [(r[0], tuple(encoded(library, r[1]) + [0])) for r in rows]
        assert collections.Counter((r.doc_id, tuple(r.ids)) for r in table.collect()) == collections.Counter(want)
        got = sorted(token_files.with_crc32(table).collect(), key=lambda r: r.start)
        assert [r.doc_id for r in got] == [r[0] for r in rows]
        assert [r.start for r in got] == [0, *itertools.accumulate(r.n_tokens for r in got)][:-1]
        crc = {(k, zlib.crc32(np.array(ids, "<u4").tobytes())) for k, ids in want}
        assert {(r.doc_id, r.ids_crc32) for r in got} == crc
    some = token_files.find_documents(spark, path, [5, 10, 99])
    assert sorted(r.doc_id for r in some.collect()) == [5, 10]
    assert "doc_id" in some._jdf.queryExecution().toString().split("PushedFilters")[1][:80]
    path = new_path(spark, "t")
    token_files.write_token_files(empty(spark), path)
    assert token_files.read_token_files(spark, path).count() == 0


# packing


def check_packed(rows, docs, library, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    want = collections.Counter()
    for d in docs:
        ids = encoded(library, d.text) + [2]
        head = (len(ids) - 1) % capacity + 1 if len(ids) > capacity else len(ids)
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            want[(d.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    return len(by), -(-sum(r.length for r in rows) // capacity)


def test_packing(spark, library):
    for docs in (documents(spark), edge(spark, True)):
        n, least = check_packed(packing.pack(docs).collect(), docs.collect(), library, 1024)
        assert n <= 1.03 * least + 2
    assert packing.pack(empty(spark)).count() == 0


def test_plan_places_everything():
    rng = np.random.default_rng(0)
    for size, draw in ((20000, lambda n: rng.integers(1, 1025, n)), (4000, lambda n: rng.integers(340, 350, n)), (900, lambda n: np.full(n, 3)), (3, lambda n: np.array([1024, 1, 1023])), (0, lambda n: np.zeros(0, int))):
        counts = np.bincount(draw(size), minlength=1025)
        counts[0] = 0
        kinds = packing.plan_bins(counts)
        got = np.zeros(1025, int)
        for n, items in kinds:
            assert sum(a * m for a, m in items) <= 1024
            for a, m in items:
                got[a] += n * m
        assert (got == counts).all()
    uniform = np.bincount(rng.integers(1, 1025, 50000), minlength=1025)
    assert sum(k[0] for k in packing.plan_bins(uniform)) <= 1.012 * (uniform * np.arange(1025)).sum() / 1024


# near duplicates


def brute_components(rows):
    sets = {}
    for r in rows:
        if r.doc_id is not None:
            sets.setdefault(r.doc_id, set()).add(frozenset(shingles(r.text)))
    nodes = sorted(sets)
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        for x in sets[a]:
            for y in sets[b]:
                both = len(x & y)
                if x and y and 100 * both >= 85 * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    parent[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


def near_copies(spark, n=420):
    """A family of over a hundred texts whose pairs lie on both sides of the threshold, and others."""
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(160)]
    rows = []
    for k in range(n):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(160)] = f"x{rng.randint(0, 10**6)}"
        if k % 7 == 0:
            words = words[: rng.randint(60, 150)]
        rows.append((k, " ".join(words), "en", "s", 0))
    return spark.createDataFrame(rows, SCHEMA)


def test_near_duplicates(spark):
    for docs in (documents(spark), near_copies(spark), edge(spark, True)):
        rows = docs.collect()
        want = brute_components(rows)
        got = neardup.near_duplicates(docs).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.doc_id is not None:
                assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
        assert collections.Counter((r.doc_id, r.n_shingles) for r in got) == collections.Counter((r.doc_id, len(shingles(r.text))) for r in rows)
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_drop_near_duplicates(spark):
    docs = edge(spark, True)
    out = neardup.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 6, 9, 10]


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    ra, rb, both = neardup.registers([a, b, np.union1d(a, b)])
    assert (np.maximum(ra, rb) == both).all()
    j = 800 / 1000
    assert neardup.estimate_reaches(ra, rb[None], 900, np.array([900]), j - 0.2)[0]
    assert not neardup.estimate_reaches(ra, rb[None], 900, np.array([900]), min(j + 0.19, 0.99))[0]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: find(n) for n in list(parent)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


# language


def test_language_is_right_on_held_out(spark):
    docs = documents(spark, "sf0.01")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held = [d for d, r in got.items() if r.held_out]
    assert sum(got[d].lang_pred == truth[d] for d in held) >= 0.97 * len(held)
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * len(truth)


def test_language_mixture(spark):
    docs = documents(spark, "sf0.01")
    langs, table = language.train(docs)
    text = {k: " ".join(r.text for r in docs.where(F.col("lang") == k).limit(3).collect())[:3000] for k in ("en", "de")}
    one = spark.createDataFrame([(1, text["en"] + " " + text["de"])], "doc_id long, text string")
    r = language.predict(one, langs, table).first()
    assert set(r["__lang_set"]) == {"en", "de"} and 0.3 < r["__score"] < 0.7


def test_language_edges(spark):
    got = language.identify(edge(spark, True)).collect()
    assert len(got) == len(edge_rows())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by[k].lang_pred for k in (1, 2, 3, 9)] == ["und"] * 4 and by[1].score == 0
    assert by[10].lang_pred in ("en", "de") and by[5].lang_pred == "en"
    assert language.identify(empty(spark)).count() == 0
    kept = language.keep_identified(edge(spark, True))
    assert kept.columns == edge(spark, True).columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [4, 5, 6, 6, 10]


# lines


def test_line_dedup_brute_force(spark):
    docs = documents(spark, "sf0.01").unionByName(edge(spark))
    rows = docs.collect()
    total, seen = collections.Counter(), collections.Counter()
    for r in rows:
        if r.source is not None:
            total[r.source] += 1
            for x in {x.strip(" ") for x in (r.text or "").split("\n")} - {""}:
                seen[(r.source, x)] += 1
    ratio, least = 0.05, 5

    def clean(r):
        if r.text is None or r.source is None:
            return r.text
        bad = lambda x: x and total[r.source] >= least and seen[(r.source, x)] > ratio * total[r.source] and seen[(r.source, x)] > ratio * least
        return "\n".join(x for x in r.text.split("\n") if not bad(x.strip(" ")))

    got = lines.clean_documents(docs, ratio, least)
    assert got.columns == docs.columns
    want = collections.Counter((r.doc_id, clean(r)) for r in rows)
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == want
    assert any(clean(r) != r.text for r in rows)
    assert lines.clean_documents(empty(spark)).count() == 0
    assert lines.clean_documents(edge(spark, True)).columns == edge(spark, True).columns


def test_pages_edges(spark):
    rows = [(1, None, "<p>a</p>"), (2, "x", None), (3, "http://h/1", "<p>a</p><script>b</script>")] + [(k, f"http://h/{k}", f"<p>menu</p><b>own {k}</b>") for k in range(4, 12)]
    got = {r.page_id: r for r in lines.clean_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "a" and got[1].host is None and got[2].text is None and got[3].text == "a" and got[4].text == "own 4"


# sharding


def test_lookup_table():
    names = sharding.shard_names(16)
    table = np.array(sharding.lookup_table(names, 4099))
    loads = np.bincount(table)
    assert loads.max() - loads.min() <= 1
    fewer = np.array(sharding.lookup_table(names[:-1], 4099))
    stays = table != 15
    assert (table[stays] == fewer[stays]).mean() > 0.85
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 4096)


def test_placement(spark):
    docs = edge(spark, True).drop("shard")
    got = sharding.place(docs, F.col("doc_id"), sharding.shard_names(8), 101)
    table = sharding.lookup_table(sharding.shard_names(8), 101)
    for r in got.collect():
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 101
        assert (r.shard_slot, r.shard) == (slot, table[slot])
    assert got.count() == len(edge_rows()) and sharding.place(empty(spark), F.col("doc_id"), ["a"], 3).count() == 0
    path = new_path(spark, "sharded")
    sharding.write_sharded(docs, F.col("doc_id"), sharding.shard_names(8), path, 2)
    assert spark.read.parquet(path).count() == len(edge_rows())


# mixing


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([187.5, 75.0, 37.5])
    got = mixing.targets([10, 100, 1000])
    assert got[0] == 30 and sum(got) == pytest.approx(1110) and got[1] <= 300
    assert mixing.targets([]) == [] and sum(mixing.targets([0, 5])) == pytest.approx(5)


def test_split_quotas_is_exact():
    quotas = np.array([100, 0, 7, 993])
    got = mixing.split_quotas(quotas, 12, np.random.default_rng(0))
    assert (got.sum(axis=0) == quotas).all()
    sums = got.sum(axis=1)
    assert sums.max() - sums.min() <= 2
    means = np.mean([mixing.split_quotas(quotas, 4, np.random.default_rng(s))[0] for s in range(400)], axis=0)
    assert means == pytest.approx(quotas / 4, rel=0.1)


def test_mixing(spark):
    docs = documents(spark, "sf0.01").unionByName(edge(spark))
    got = mixing.takings(docs).collect()
    rows = docs.collect()
    size = collections.Counter()
    for r in rows:
        size[r.source] += len(WORD.findall(r.text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([size[s] for s in order])))
    source = {}
    for r in rows:
        source.setdefault((r.doc_id, len(WORD.findall(r.text or ""))), []).append(r.source)
    taken = collections.Counter()
    for r in got:
        s = next(s for s in source[(r.doc_id, r.size)] if abs(want[s] - r.target) < 1e-6)
        assert r.source_size == size[s] and r.taken <= 3 * r.size and r.taken == r.size * len(r.shards)
        taken[s] += r.taken
    for s in order:
        largest = max(len(WORD.findall(r.text or "")) for r in rows if r.source == s)
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + (largest / 2 if largest > want[s] / 4 else 30)
    again = mixing.takings(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mixing.takings(empty(spark)).count() == 0


def test_mixed_rows(spark):
    docs = edge(spark, True)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    counts = collections.Counter(r.doc_id for r in out.collect())
    want = collections.Counter()
    for r in mixing.takings(docs).collect():
        want[r.doc_id] += len(r.shards)
    assert counts == want
    assert mixing.mix(empty(spark)).count() == 0


# fingerprints


def paragraphs(text):
    return {x.strip(" ") for x in re.findall(r"[^\n]{150,}?[.!?](?= )|[^\n]+", text)} - {""}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("which", ["data", "edge"])
def test_fingerprints(spark, which):
    docs = documents(spark) if which == "data" else edge(spark, True).dropDuplicates(["doc_id"])
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    for k, (d, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[d]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(jaccard(paragraphs(text), paragraphs(edited)))
        assert r.near_next == pytest.approx(jaccard(paragraphs(text), paragraphs(after)))
    assert fingerprints.fingerprints(empty(spark)).count() == 0


def test_peeling_retries_larger(spark):
    """Hundreds of paragraphs differ: the small sketch can't be peeled, a larger one gives them all."""
    a = "\n".join(f"line {k}" for k in range(400))
    b = "\n".join(f"line {k}" for k in range(200, 600))
    row = spark.createDataFrame([(a, b)], "a string, b string").selectExpr(f"{fingerprints.keys('a')} AS x", f"{fingerprints.keys('b')} AS y")
    small = row.selectExpr(f"{fingerprints.difference('x', 'y', '24')} AS d").first().d
    large = row.selectExpr(f"{fingerprints.difference('x', 'y', '800')} AS d").first().d
    assert small is None and len(large) == 400 and sum(k > 0 for k in large) == 200
    cells = str(fingerprints.CELLS)
    near = row.selectExpr(f"{fingerprints.likeness('x', 'y', fingerprints.sketch('x', cells), fingerprints.sketch('y', cells))} AS n").first().n
    assert near == pytest.approx(200 / 600)


# neighbours


def test_neighbours(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    query = F.col("vec_id") % 20 == 0
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in table.collect()}
    ids = np.array(sorted(x))
    m = np.stack([x[k] for k in ids])
    old = neighbours.PART_ROWS
    try:
        neighbours.PART_ROWS = 250  # eight partitions
        found = neighbours.search(table, query).cache()
        rows = found.collect()
        assert neighbours.recall(found, table, query) >= 0.9
    finally:
        neighbours.PART_ROWS = old
    by = collections.defaultdict(list)
    for r in rows:
        by[r.query_id].append(r)
    hit = 0
    for q in ids[ids % 20 == 0]:
        score = (m * x[q]).sum(axis=1)
        score[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -score))[:20]])
        own = sorted(by[q], key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21)) and [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        for r in own:
            assert r.score == pytest.approx(float((x[q] * x[r.vec_id]).sum()), abs=1e-12) and r.vec_id != q
        hit += len(best & {r.vec_id for r in own})
    assert hit >= 0.9 * 20 * len(by)


def test_neighbours_edges(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [float("nan"), 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [None, 1.0]), (4, [-1.0, 0.5]), (5, [float("inf"), 0.0]), (None, [1.0, 1.0])]
    got = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 4, -1.0)]
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def test_partition_is_balanced():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1000, 8))
    label = neighbours.balanced_partition(neighbours.neighbour_graph(x), 8)
    assert np.bincount(label).tolist() == [125] * 8


# licences


def test_licences(spark):
    docs = documents(spark, "sf0.01")
    model = licences.train(licences.ordinary_paragraphs(docs))
    got = {r.doc_id: r for r in licences.scan(docs, model).collect()}
    for r in docs.collect():
        assert set(got[r.doc_id].families) == licences.plain_mentions(r.text) | ({"Reserved"} if "All rights reserved." in r.text else set())
        assert got[r.doc_id].n_paragraphs == sum(bool(re.search(r"[^\W_]", x)) for x in r.text.split("\n"))
    hidden = " ".join(WORDS * 9) + " permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files " + " ".join(WORDS * 5)
    odd = "This font is licensed under the Frobnicate Public License, version 7, see the terms of the license."
    rows = [(1, "Some words.\nLicensed under the BSD 3-Clause License.\nMore words."), (2, hidden), (3, odd), (4, "He got his driving license in March."), (5, None), (6, "")]
    out = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert out[1].families == ["BSD"] and out[2].families == ["MIT"] and out[4].families == [] and out[5].families == out[6].families == []
    assert out[3].families == ["unknown"] and out[3].n_licence == 1
    assert licences.licence_scan(edge(spark, True)).count() == len(edge_rows()) and licences.licence_scan(empty(spark)).count() == 0


# registered queries


def test_catalogue(spark):
    names = sorted(catalog.queries(), key=lambda n: int(re.match(r"op(\d+)_", n)[1]))
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    df = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert collections.Counter(map(tuple, df.select(*columns).collect())) == collections.Counter(want)
