"""Beyond every size where another way begins, results stay exact; and names and repeats that clash."""

import collections
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agendaflow.llm import fingerprints, language, lines, mixing, neardup, neighbours, packing, sharding, shared, token_files
from agendaflow.llm.components import components
from agendaflow.llm.shared import bounded_batches, free_names, join_by_key, new_path

from .test_operators import SCHEMA, brute_components, documents, edge, jaccard, near_copies, paragraphs


@pytest.mark.parametrize("few", [10, 10**6])
def test_long_paths_and_hubs(spark, few):
    edges = [(k, k + 1) for k in range(3000)] + [(10_000, 10_000 + k) for k in range(2000)] + [(20_000 + k, 30_000) for k in range(500)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long"), few).collect()}
    want = {k: 0 for k in range(3001)} | {k: 10_000 for k in range(10_000, 12_000)} | {k: 20_000 for k in (*range(20_000, 20_500), 30_000)}
    assert got == want


def test_heavy_keys_join_as_others(spark):
    rows = spark.createDataFrame([(k % 7 if k < 30 else 3, k) for k in range(5000)] + [(None, -1)], "k int, x int")
    table = spark.createDataFrame([(k, f"t{k}") for k in range(6)], "k int, t string")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("left", "inner"):
        want = collections.Counter(map(tuple, rows.join(table, "k", how).collect()))
        assert collections.Counter(map(tuple, join_by_key(rows, table, ["k"], counts, False, how).collect())) == want


def test_large_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "MOST_CLASSES", 0)
    docs = near_copies(spark, 150)
    want = brute_components(docs.collect())
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == want
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 500)
    monkeypatch.setattr(neardup, "FLUSH_BYTES", 1000)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()} == want


def test_forest_of_the_rest():
    """Edges from the rest to the others join what is linked, and are fewer than the rows."""
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 60, 40, dtype=np.uint64)
    sets = [np.unique(np.r_[base[:36], rng.integers(0, 1 << 60, 2, dtype=np.uint64)]) for _ in range(60)]
    core = np.r_[np.ones(30, int), np.zeros(30, int)]
    edges = neardup.exact_forest(np.arange(60), sets, core)
    assert len(edges) <= 59 and {a for a, _ in edges} | {b for _, b in edges} == set(range(60))


def test_fingerprints_of_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", 200)
    monkeypatch.setattr(fingerprints, "CELL_BYTES", 20)
    rng = random.Random(3)
    text = lambda: "\n".join(" ".join(rng.choice("abcdefgh") * 3 for _ in range(4)) for _ in range(rng.randint(0, 9)))
    rows = [(rng.choice([None, 5, 7, rng.randint(0, 1 << 62), -rng.randint(0, 1 << 62)]) if k % 3 else k * 1000, text(), "en", "s", 0) for k in range(3000)]
    docs = spark.createDataFrame([*rows, *rows[:5]], SCHEMA)
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == len(rows) + 5
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
    order = sorted(hashed, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h, r.text))
    want = collections.Counter()
    for k, r in enumerate(order):
        after = order[(k + 1) % len(order)].text
        half = len(r.text) // 2
        near = (jaccard(paragraphs(r.text), paragraphs(x)) for x in (r.text[: len(r.text) - half] + after[:half], after))
        want[(r.doc_id, len(r.text), *(round(x, 9) for x in near))] += 1
    assert collections.Counter((r.doc_id, r.n_chars, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want


def test_likeness_is_exact_where_nothing_peels(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "peel", lambda cells, n: f"struct(size({cells}) < 0 AS whole, array(0L) AS keys)")
    a, b = "\n".join(f"line {k}" for k in range(300)), "\n".join(f"line {k}" for k in range(100, 500))
    row = spark.createDataFrame([(a, b)], "a string, b string").selectExpr(f"{fingerprints.keys('a')} AS x", f"{fingerprints.keys('b')} AS y")
    own = lambda c: fingerprints.sketch(c, "64")
    assert row.selectExpr(f"{fingerprints.likeness('x', 'y', own('x'), own('y'))} AS n").first().n == pytest.approx(200 / 500)


def brute_neighbours(rows, k=20):
    by = {}
    for i, v in rows:
        by.setdefault(i, []).append(v)
    out = {}
    for q, own in by.items():
        if q % 20 == 0:
            x = np.array(min(own))
            near = sorted((-float((np.array(v) * x).sum()), i) for i, v in rows if i != q and len(v) == len(x))
            out[q] = [(r + 1, i, round(-s, 9)) for r, (s, i) in enumerate(near[:k])]
    return {q: v for q, v in out.items() if v}


def test_neighbours_of_repeats_and_other_lengths(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.integers(-3, 4, 4).astype(float).tolist()) for k in range(120)]
    rows = [r for r in rows if any(r[1])]
    rows += [rows[0], rows[0], rows[3], (20, [9.0, 9.0, 9.0, 9.0]), *((k, [1.0, float(k)]) for k in range(200, 230))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    assert got == brute_neighbours(rows)


def test_neighbours_reach_recall_with_the_shipped_constants(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows, index = neighbours.build_index(neighbours.vectors(table))
    assert index.first is not None and rows.select("part").distinct().count() >= 4
    found = neighbours.search(table, F.col("vec_id") % 20 == 0)
    assert neighbours.recall(found, table, F.col("vec_id") % 20 == 0) >= 0.9


def test_neighbours_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "FAN", 8)
    monkeypatch.setattr(neighbours, "PART_ROWS", 60)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    _, index = neighbours.build_index(neighbours.vectors(table))
    assert index.width > 1 and len(index.second) > 1
    found = neighbours.search(table, F.col("vec_id") % 20 == 0)
    assert neighbours.recall(found, table, F.col("vec_id") % 20 == 0) >= 0.9


def test_token_files_under_a_limit_of_records(spark):
    docs = documents(spark)
    starts = []
    for most in ("0", "7"):
        spark.conf.set("spark.sql.files.maxRecordsPerFile", most)
        try:
            path = new_path(spark, "t")
            token_files.write_token_files(docs, path, file_bytes=40_000)
        finally:
            spark.conf.unset("spark.sql.files.maxRecordsPerFile")
        starts.append(sorted((r.doc_id, r.start, r.n_tokens) for r in token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens").collect()))
    assert starts[0] == starts[1]
    at = 0
    for _, start, n in starts[0]:
        assert start == at
        at += n


def test_special_tokens_are_the_librarys(spark):
    from tokenizers import Tokenizer

    from agendaflow.llm import tokens

    plain = Tokenizer.from_file(tokens.default_tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endof", "text|> <|endoftext|><|endoftext|> it's"]
    path = new_path(spark, "t")
    token_files.write_token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path)
    got = {r.doc_id: list(r.ids) for r in token_files.read_token_files(spark, path).collect()}
    assert got == {k: [*plain.encode(t, add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}


def test_few_large_pieces_are_grouped_too():
    for lengths in ([700, 600, 500, 420, 300], [520, 504, 700, 324, 1000, 24], [513]):
        counts = np.bincount(lengths, minlength=1025)
        kinds = packing.plan_bins(counts)
        got = np.zeros(1025, int)
        for n, items in kinds:
            assert sum(a * m for a, m in items) <= 1024
            for a, m in items:
                got[a] += n * m
        assert (got == counts).all()
    assert sum(k[0] for k in packing.plan_bins(np.bincount([520, 504, 700, 324, 1000, 24], minlength=1025))) == 3


def test_mixed_rows_are_dealt_by_size(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TASK_BYTES", 2000)
    docs = documents(spark)
    out = mixing.mix(docs, with_place=True)
    assert out.rdd.getNumPartitions() > mixing.SHARDS
    rows = out.select("doc_id", "mix_shard", "mix_order").collect()
    assert [tuple(r)[1:] for r in rows] == sorted(tuple(r)[1:] for r in rows)
    want = {r.doc_id: sorted(r.shards) for r in mixing.takings(docs).collect() if r.shards}
    got = collections.defaultdict(list)
    for r in rows:
        got[r.doc_id].append(r.mix_shard)
    assert {k: sorted(v) for k, v in got.items()} == want


CLASH = ["host", "own", "common", "bad", "__host", "__text", "__common", "slot", "owner", "__slot", "__block", "block", "copy", "shard", "order", "source_key", "block_key", "words", "row", "keys", "bucket", "n", "key"]


def test_names_that_operators_use(spark, monkeypatch):
    docs = edge(spark)
    for c in CLASH:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    for out in (lines.clean_documents(docs), neardup.drop_near_duplicates(docs), mixing.mix(docs)):
        assert out.columns == docs.columns
        assert all(r[c] == f"own {c}" for r in out.collect() for c in CLASH)
    monkeypatch.setattr(lines, "MOST_BROADCAST", -1)
    assert lines.clean_documents(docs).columns == docs.columns and lines.clean_documents(docs).count() == docs.count()
    placed = sharding.place(docs.withColumn("Shard_Slot", F.lit(-5)), F.col("doc_id"), ["a", "b"], 3)
    assert set(placed.columns) == {*docs.columns, "shard_slot"} and all(r.shard in (0, 1) and r.shard_slot >= 0 and r["__slot"] == "own __slot" for r in placed.collect())
    assert free_names(["a", "_a", "B"], "a", "b", "c") == ["__a", "_b", "c"]


def test_language_takes_any_names(spark):
    docs = documents(spark)
    for c in (*language.OWN_NAMES, "___score", "__SCORE_2", "fit", "lang_pred"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in language.keep_identified(documents(spark)).select("doc_id").collect()}
    assert rows and all(r[c] == f"own {c}" for r in rows for c in docs.columns[5:])


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_clashing_names(spark, stage):
    import corpus_pipeline

    docs = documents(spark)
    names = ["__score", "__lang_pred", "__fit", "__sd", "__text", *CLASH]
    for c in names:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    out = corpus_pipeline.STAGES[stage][1](spark, docs, None)
    assert out.count() > 0 and (stage == 4 or out.columns == docs.columns)


def test_sites_of_any_size(spark, monkeypatch):
    rows = [(1, "http://one/", "<p>all</p><p>of it</p>"), (2, "http://two/a", "<p>menu</p><p>x</p>"), (3, "http://two/b", "<p>menu</p><p>y</p>")]
    rows += [(10 + k, f"http://big/{k}", f"<p>top</p><p>{k}</p>") for k in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {1: "all\nof it", 2: "x", 3: "y"} | {10 + k: str(k) for k in range(40)}
    assert {r.page_id: r.text for r in lines.clean_pages(pages).collect()} == want
    monkeypatch.setattr(lines, "MOST_BROADCAST", -1)
    assert {r.page_id: r.text for r in lines.clean_pages(pages).collect()} == want
    assert lines.clean_pages(pages.limit(0)).count() == 0


def test_repeated_ids_of_other_texts_stay(spark):
    rows = [(1, "a b c d e f g", "en", "s", 0), (1, "A b  c d e f g", "en", "s", 0), (1, "other words that are not like it", "en", "t", 0), (2, "a b c d e f g", "en", "s", 0), (3, "", "en", "s", 0), (3, " ", "en", "s", 0)]
    got = [sorted(map(tuple, neardup.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA)).select("doc_id", F.lower(F.regexp_replace("text", " +", " "))).collect())) for _ in range(2)]
    assert got[0] == got[1] == [(1, "a b c d e f g"), (1, "other words that are not like it"), (3, ""), (3, " ")]


def test_session_and_folder(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with bounded_batches(spark):
        assert int(spark.conf.get(key)) <= shared.BATCH_ROWS
    assert spark.conf.get(key) == before
    neardup.near_duplicates(documents(spark)).collect()
    assert spark.conf.get(key) == before
    scratch = shared.Scratch(spark)
    path = scratch.cut(documents(spark), "x").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    scratch.clear()
    assert scratch.paths == [] and not os.path.exists(path)


def test_routing_pays_where_vectors_cluster(spark):
    """Clusters of any scale: recall holds while at most a quarter of the pairs are compared."""
    rng = np.random.default_rng(12)
    near = rng.standard_normal((120, 32)) * 5
    rows = [(k, [float(x) for x in (near[k % 120] + rng.standard_normal(32)) * 1e3]) for k in range(24_000)]
    table, query = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0
    found = neighbours.search(table, query)
    assert neighbours.recall(found, table, query) >= 0.9
    assert neighbours.compared_share(table, query) <= 0.26
    assert found.groupBy("query_id").count().where("count = 20").count() == 1200


def test_number_of_partitions_at_every_size():
    got = [neighbours.number_of_parts(n) for n in (0, 1, 199, 200, 500, 2000, 20_000, 10**6, 10**9)]
    assert got == [1, 1, 1, 4, 4, 4, 8, 512, 1 << 19]


def test_neighbours_of_a_few_hundred(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    found = neighbours.search(table, F.col("vec_id") % 20 == 0)
    assert neighbours.recall(found, table, F.col("vec_id") % 20 == 0) >= 0.9
