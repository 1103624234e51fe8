"""Charsets, JSON values, running numbers of hot keys, and dictionaries of any size."""

import random

import pytest
from pyspark.sql import functions as F

from agendaflow.functions import charsets, json_values
from agendaflow.functions.text import simplify
from agendaflow.operators import filters, pages, places, stats
from agendaflow.plans import catalog


@pytest.mark.parametrize("label, codec", [("windows-1252", "cp1252"), ("ISO-8859-15", "iso8859_15"), ("koi8-r", "koi8_r"), ("Windows-1251", "cp1251"), ("iso-8859-2", "iso8859_2"), ("macintosh", "mac_roman"), ("ibm866", "cp866")])
def test_every_byte_of_a_charset(spark, label, codec):
    known = bytes(b for b in range(1, 256) if bytes([b]).decode(codec, "ignore"))
    row = spark.createDataFrame([(known, f"text/html; charset={label}")], "b binary, t string")
    assert row.select(charsets.decoded_or_null(F.col("b"), F.col("t")).alias("x")).first().x == known.decode(codec)


def test_content_types(spark):
    rows = [
        ("é€".encode(), None, "é€"), ("é".encode(), "text/html", "é"), ("é".encode("utf-16-le"), "a; charset=UTF-16", "é"), (b"\xfe\xff" + "é".encode("utf-16-be"), "a; charset=utf-16be", "é"),
        ("\ufeffx".encode(), 'a; charset="utf-8"', "x"), (b"a\xffb", "a; charset=utf8", "a\ufffdb"), (b"\x80", "a; CHARSET=latin1", "€"), (b"\x81", "a; charset=windows-1252", "\x81"), (b"x", "a; charset=big5", None), (None, "a", None), (b"", "a;charset=koi8-r", ""), (b"ab\x00", "a; charset=utf-16le", "\u6261"),
    ]
    table = spark.createDataFrame([(k, b, t) for k, (b, t, _) in enumerate(rows)], "k int, b binary, t string")
    got = table.select("k", charsets.decoded_or_null(F.col("b"), F.col("t")).alias("x"), charsets.charset_error(F.col("t")).alias("e")).orderBy("k").collect()
    assert [r.x for r in got] == [w for *_, w in rows]
    assert [r.e for r in got] == ["unknown charset: big5" if k == 8 else None for k in range(len(rows))]


def test_json_values(spark):
    same = [('{"b": 1.0, "a": [1, 2.50, {"y": null, "x": "é\\/"}]}', '{"a":[1.0,2.5,{"x":"\\u00e9/","y":null}],"b":1}'), (" true ", "true"), ('""', '  ""'), (None, None), ("no json", "no json")]
    other = [('{"a":1}', '{"a":"1"}'), ("[1,2]", "[2,1]"), ('{"a":null}', "{}"), (None, "null"), ("no json", "no  json"), ('{"a":1,"a":2}', '{"a":2}')]
    rows = spark.createDataFrame([(*x, True) for x in same] + [(*x, False) for x in other], "a string, b string, same boolean")
    assert all(r.got == r.same for r in rows.select("same", json_values.same_json(F.col("a"), F.col("b")).alias("got")).collect())
    table = spark.createDataFrame([(k, t) for k, t in enumerate([same[0][1], same[0][0], None, "x", "x", None, "[1]", "[ 1 ]"])], "k int, text string")
    assert sorted(r.k for r in json_values.distinct_json(table, "text", "k").collect()) == [0, 2, 3, 6]


def test_running_numbers_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(None if k % 50 == 0 else "hot" if k % 3 else f"v{k % 7}", k, rng.random() < 0.4, rng.randint(0, 5)) for k in range(4000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "venue string, at int, on boolean, size int")
    got = stats.prefix_sums(df, ["venue"], ["at"], {"n": F.col("on"), "total": F.col("size")})
    want, state = {}, {}
    for v, at, on, size in sorted(rows, key=lambda r: r[1]):
        n, total = state.get(v, (0, 0))
        state[v] = n + on, total + size
        want[at] = (v, *state[v])
    assert {r["at"]: (r.venue, r.n, r.total) for r in got.collect()} == want and got.columns == ["venue", "at", "on", "size", "n", "total"]
    # the hot key's rows lie in several tasks
    spread = df.repartitionByRange(4, F.struct("venue"), "at").where("venue = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert spread > 1
    assert [(r["at"], r.place) for r in stats.placed(df.where("at < 5").select("at"), [-F.col("at")]).orderBy("at").collect()] == [(0, 5), (1, 4), (2, 3), (3, 2), (4, 1)]
    assert stats.placed(df.limit(0), ["at"]).count() == 0


@pytest.mark.parametrize("most", [10, 60, 10**6])
def test_dictionaries_in_parts(spark, most):
    rng = random.Random(most)
    word = lambda n: "".join(rng.choice("abé-C ") for _ in range(n))
    words = [(f"s{k}", word(rng.randint(1, 5)), k) for k in range(60)] + [("null", None, 98), ("again", "ab", 99)]
    texts = [(k, word(rng.randint(0, 30))) for k in range(150)] + [(900, None), (901, "")]
    plain = lambda rows, schema, c: {tuple(r)[0]: r.p for r in spark.createDataFrame(rows, schema).withColumn("p", simplify(F.col(c))).collect()}
    w, t = plain([(k, x) for _, x, k in words], "k int, x string", "x"), plain(texts, "k int, x string", "x")
    want = {}
    for k, text in texts:
        hits = [s for s, _, n in words if w[n] is not None and t[k] is not None and w[n] in t[k]]
        want[k] = hits[-1] if hits else text
    got = places.styles_by_dictionary(spark.createDataFrame(texts, "k int, x string"), "x", spark.createDataFrame(words, "style string, word string, ord int"), most)
    assert {r.k: r.found_style for r in got.collect()} == want
    none = places.styles_by_dictionary(spark.createDataFrame(texts, "k int, x string"), "x", spark.createDataFrame([], "style string, word string, ord int"), most)
    assert {r.k: r.found_style for r in none.collect()} == dict(texts)


def test_small_operators(spark):
    place = "k int, name string, city string, country string"
    a = spark.createDataFrame([(1, "Le Bar", "Lyon", "F"), (2, "club", "Lyon", "F"), (3, None, "Lyon", "F"), (4, "LE-BAR!", "Paris", "F")], place)
    b = spark.createDataFrame([(7, "le bar", "Lyon", "F"), (5, "Le, Bar", "Lyon", "F"), (6, None, "Lyon", "F")], place.replace("k int", "o int"))
    assert sorted(map(tuple, filters.same_places(a, b, "k", "o").collect())) == [(1, 5, 2), (2, None, 0), (3, None, 0), (4, None, 0)]
    others = places.same_city_others(b.unionByName(a.withColumnRenamed("k", "o")), "city", "name").collect()
    assert {(r.o, r.n_others) for r in others} == {(7, 3), (5, 3), (1, 3), (2, 5), (3, 4), (6, 4), (4, 0)}
    values = spark.createDataFrame([("g", k) for k in range(9)] + [("h", 3), ("h", 1), ("i", 5), ("i", 6), ("i", 4)], "g string, v int")
    assert sorted(map(tuple, stats.first_and_count(values, "g", "v").collect())) == [("g", "0, 1, 2...(9 elements)"), ("h", "1, 3"), ("i", "4, 5, 6")]
    frames = spark.createDataFrame([("1", None, "s"), ("2", "n", "s"), ("3", "n", "t")], "id string, name string, src string")
    assert sorted((r.id, r.detected) for r in pages.detected(frames, frames.where("id < '3'").unionByName(frames.limit(1)), "id", "name", "src").collect()) == [("1", True), ("2", True), ("3", False)]
    venues = spark.createDataFrame([("a", "s"), ("b", "s"), ("c", "t")], "venue string, source string")
    assert sorted(map(tuple, pages.repairs_by_source(spark.createDataFrame([("a",), ("a",), ("b",), ("z",)], "venue string"), venues, "venue", "source").collect())) == [("s", 2)]


@pytest.mark.parametrize("parts", [1, 3, places.PARTS])
def test_same_city_venues_are_paired(spark, parts):
    rng = random.Random(parts)
    rows = [(k, rng.choice(["Lyon", "Lyon", "Paris", None]), rng.choice(["Le Bar", "LE-BAR!", "club", None, "Café"])) for k in range(60)] + [(None, "Lyon", "x")]
    plain = {"Le Bar": "le bar", "LE-BAR!": "le bar"}
    want = [(i, j) for i, c, x in rows for j, d, y in rows if None not in (i, j, c, x, y) and c == d and i < j and plain.get(x, x) != plain.get(y, y)]
    got = places.same_city_pairs(spark.createDataFrame(rows, "k int, city string, name string"), "k", "city", "name", parts).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_same_city_venues_query_gives_every_pair(spark):
    suppliers = [tuple(r) for r in catalog.queries()["same_city_venues"](spark, "/root/testdata/sf0.01").select("a", "b").collect()]
    city = {r.s_suppkey: r.s_nationkey for r in spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").collect()}
    assert sorted(suppliers) == sorted((a, b) for a in city for b in city if a < b and city[a] == city[b])
