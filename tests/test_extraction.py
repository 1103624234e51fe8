"""Markup trees, recipes, the extraction of a small site, merging, files and streams."""

import datetime as dt
import random
import time
import json


import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agendaflow.functions import html, maps, text
from agendaflow.functions.date_text import FRENCH
from agendaflow.operators import extract, filters, merge, pages, registry
from agendaflow.operators.graph import linked_sets
from agendaflow.sources import csv, geojson
from agendaflow.sources import pages as page_files

PAGE = """<html><body><div class="list">
<div class="item"><a href="/e/1"><h2 class="t">Alpha</h2></a><p class="d">5 janvier à 20h</p><p>Salle A</p></div>
<div class="item"><a href="/e/2"><h2 class="t">Beta &amp; co</h2></a><p class="d">du 12 au 14 janvier à 19h</p><p>Annulé</p></div>
<div class="item"><a href="/e/3"><h2 class="t">Gamma</h2></a><p class="d"></p><p>x<br>y</div>
<div class="item"><h2 class="t"></h2><p class="d"></p></div>
</div></body></html>"""


def test_paths():
    root = html.parse(PAGE)
    items = html.select(root, "html>body>div.list>div.item")
    assert len(items) == 4 and [n.text() for n in html.select(items[1], "a>h2.t")] == ["Beta & co"]
    assert html.select(items[0], "p:eq(1)")[0].text() == "Salle A"
    assert html.select(items[0], "p:not([class])")[0].text() == "Salle A"
    assert [n.text() for n in html.select(root, "h2.t:eq(2)")] == ["Gamma"]
    assert html.nearest_href(html.select(items[0], "a>h2")[0]) == "/e/1"
    assert html.extract_field(items[0], "eventURL", ["a>h2.t"]) == "/e/1" and html.extract_field(items[0], "eventName", ["a>h2.t", "p:eq(1)"]) == "Alpha, Salle A"
    assert html.absolute_path(items[2]) == "html>body>div.list>div.item:eq(2)"
    assert html.regroup_paths(["a>b:eq(0)>c", "a>b:eq(1)>c", "d"]) == ["d", "a>b>c"]
    assert html.parse("<p>a<b>c</p>d").text() == "a c d"


def test_induction():
    block, paths = html.induce_paths(PAGE, {"eventName": ["Alpha"], "eventDate": ["5 janvier"]})
    assert block == "html>body>div.list>div.item:eq(0)"
    item = html.select(html.parse(PAGE), block)[0]
    assert html.extract_field(item, "eventName", paths["eventName"]) == "Alpha" and html.extract_field(item, "eventDate", paths["eventDate"]) == "5 janvier à 20h"


def test_nodes(spark):
    html.register(spark)
    spark.createDataFrame([(1, PAGE)], "id int, html string").createOrReplaceTempView("site_pages")
    rows = spark.sql("SELECT n.* FROM site_pages, LATERAL html_nodes(html) n").collect()
    by = {r.node_id: r for r in rows}
    assert sum(r.tag == "h2" for r in rows) == 4 and all(by[r.parent_id].depth == r.depth - 1 for r in rows if r.parent_id >= 0)


def test_site(spark):
    recipe = {"eventName": ["a>h2.t", "h2.t"], "eventDate": ["p.d"], "eventURL": ["a>h2.t"]}
    venues = spark.createDataFrame([("v", "http://site.org/list/", "div.item", recipe, {"eventStyle": ["b"]})], "id string, url string, delimiter string, mainPage map<string,array<string>>, linkedPage map<string,array<string>>")
    stored = spark.createDataFrame([("v", 0, PAGE)], "venue_id string, page_no int, html string")
    linked = spark.createDataFrame([("http://site.org/e/1", "<b>Rock</b>"), ("http://site.org/e/2", "<i>none</i>")], "url string, html string")
    blocks = extract.blocks_of(stored, venues)
    events = extract.events_of(blocks, linked, ["annulé"])
    rows = {r.block_no: r for r in extract.dated(events, ["day", "month"], "long", None, dt.date(2025, 12, 1), "Europe/Paris").where("date_no IS NULL OR date_no = 0").collect()}
    assert sorted(rows) == [0, 1, 2]  # the empty one is gone
    a, b, c = (rows[k] for k in range(3))
    assert (a.eventName, a.eventStyle, a.eventURL, a.isCancelled, a.errorLog) == ("Alpha", "Rock", "http://site.org/e/1", False, None)
    assert a.unixDate == 1767639600000 and a.hasStartTime  # 5 January 2026, 20:00 in Paris
    assert b.isCancelled and b.n_possibilities == 1 and c.unixDate == -1 and c.errorLog == "no linked page: http://site.org/e/3"
    every = extract.dated(events, ["day", "month"], "long", None, dt.date(2025, 12, 1), "Europe/Paris")
    assert every.where("eventName = 'Beta & co'").count() == 3
    bad = events.withColumn("eventDate", F.lit("un jour"))
    assert {r.unixDate for r in extract.dated(bad, ["day", "month"], "long", None, dt.date(2025, 12, 1), "UTC").collect()} == {0}


def test_format_inference(spark):
    rows = [("a", "5 janvier 2026"), ("a", "le 7 mars 2026"), ("b", "05.12.25"), ("b", "06.12.25"), ("c", "3 déc"), ("c", "4 sept")]
    got = {r.v: (r.month, r.year) for r in extract.infer_date_format(spark.createDataFrame(rows, "v string, t string"), "v", "t", FRENCH).collect()}
    assert got == {"a": ("long", "long"), "b": ("numeric", "short"), "c": ("short", None)}


NAMES = st.text(alphabet="abé -B", max_size=6)


def naive_merge(rows):
    """One list for all rows, as a check of blocking."""
    out = []
    for r in rows:
        same = lambda e: merge.simple(e[0]["place"]) == merge.simple(r["place"]) and e[0]["unixDate"] // 86_400_000 == r["unixDate"] // 86_400_000 and merge.alike(merge.simple(e[0]["eventName"]), merge.simple(r["eventName"]))
        near = [e for e in out if same(e)]
        if near:
            near[0].append(r)
            for e in near[1:]:
                near[0].extend(e)
            out = [e for e in out if not any(e is x for x in near[1:])]
        else:
            out.append([r])
    return sorted(sorted(x["seq"] for x in e) for e in out)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(NAMES, st.sampled_from(["Bar", "bar!", "Club"]), st.integers(0, 2)), max_size=12))
def test_clusters(rows):
    rows = [{"seq": k, "eventName": n, "place": p, "unixDate": d * 86_400_000 + 1} for k, (n, p, d) in enumerate(rows)]
    blocks = {}
    for r in rows:
        blocks.setdefault((merge.simple(r["place"]), r["unixDate"] // 86_400_000), []).append(r)
    got = [sorted(b[k]["seq"] for k in g) for b in blocks.values() for g in merge.cluster([merge.simple(r["eventName"]) for r in b])]
    assert sorted(got) == naive_merge(rows)


def test_merge(spark):
    day = 1_764_547_200_000
    rows = [
        (1, "Jazz Night", "Bar", "Lyon", "France", "Bar", "Jazz", None, "http://bar/1", day + 72_000_000),
        (2, "JAZZ NIGHT!", "bar", "Lyon", "France", "Agenda", "Live", "x", "http://agenda/1", day + 72_000_000),
        (3, "Rock", "Bar", "Lyon", "France", "Agenda", "Rock", None, "http://agenda/2", day + 75_600_000),
        (4, "Unread", "Bar", "Lyon", "France", "Agenda", None, None, None, 0),
        (5, "A", "Club", "Lyon", "France", "S1", None, None, "u5", day + 1000),
        (6, "A", "Club", "Lyon", "France", "S2", None, None, "u6", day + 2000),
    ]
    schema = "seq long, eventName string, place string, city string, country string, source string, style string, detailedStyle string, eventURL string, unixDate long"
    events = spark.createDataFrame(rows, schema)
    groups = {}
    for r in merge.grouped(events).collect():
        groups.setdefault(r.group, []).append(r.seq)
    assert sorted(map(sorted, groups.values())) == [[1, 2], [3], [5, 6]]
    got = {r.seq: r for r in merge.merge_events(events, styles=("Jazz",)).collect()}
    assert {k: r.n_members for k, r in got.items()} == {1: 2, 3: 1, 4: 1, 5: 2}
    # a local source's addresses alone count
    assert (got[1].style, got[1].eventURL, got[1].altURLs) == ("Jazz", "http://bar/1", ["http://bar/1"])
    assert got[5].unixDate == day + 1000 and got[5].warning == "no date confirmed" and got[5].altURLs is None


def naive_events(rows, zone):
    """The merge rules in plain Python over one list."""
    import zoneinfo

    at = lambda t: dt.datetime.fromtimestamp(t / 1000, zoneinfo.ZoneInfo(zone))
    entries = []
    for r in rows:
        same = lambda e: merge.simple(e[0]["place"]) == merge.simple(r["place"]) and at(e[0]["unixDate"]).date() == at(r["unixDate"]).date() and merge.alike(merge.simple(e[0]["eventName"]), merge.simple(r["eventName"]))
        near = [e for e in entries if same(e)]
        if near:
            near[0].append(r)
            for e in near[1:]:
                near[0].extend(e)
            entries = [e for e in entries if not any(e is x for x in near[1:])]
        else:
            entries.append([r])
    out = set()
    for e in entries:
        first = e[0]
        if len(e) == 1:
            out.add((first["seq"], first["eventName"], first["unixDate"], first["eventURL"], None, 1, None))
            continue
        balance = lambda x: abs(1 + sum("A" <= c <= "Z" for c in x) - sum("a" <= c <= "z" for c in x))
        name = min((-len(r["eventName"]), -sum(c in "éèêëàâäïîöôûüøæå" for c in r["eventName"].lower()), balance(r["eventName"]), k, r["eventName"]) for k, r in enumerate(e))[-1]
        local = [r for r in e if r["place"] == r["source"]]
        used = local or e
        dates = list(dict.fromkeys(r["unixDate"] for r in used))
        if not local and len(dates) > 1:
            dates = [d for d in dates if {r["source"] for r in used if r["unixDate"] == d} & {r["source"] for r in used if r["unixDate"] != d}]
        if not dates:
            count = {r["unixDate"]: sum(x["unixDate"] == r["unixDate"] for x in used) for r in used}
            best = [d for d in count if count[d] == max(count.values())]
            if len(best) > 1:
                best = [d for d in best if at(d).hour or at(d).minute] or best
            out.add((first["seq"], name, min(best), first["eventURL"], None, len(e), "no date confirmed"))
        elif len(dates) == 1:
            out.add((first["seq"], name, dates[0], local[0]["eventURL"] if local else first["eventURL"], tuple(dict.fromkeys(r["eventURL"] for r in used)), len(e), None))
        else:
            for d in dates:
                urls = list(dict.fromkeys(r["eventURL"] for r in used if r["unixDate"] == d))
                out.add((first["seq"], name, d, urls[0], tuple(urls[1:]) or None, len(e), None))
    return out


@pytest.mark.parametrize("zone", ["UTC", "Asia/Ho_Chi_Minh"])
def test_merge_follows_the_rules(spark, zone):
    rng = random.Random(5)
    names = ["a", "A!", "ab", "b", "ba", "é", "abc", "bc", "c"]
    rows = [
        {"seq": k, "eventName": rng.choice(names), "place": rng.choice(["Bar", "bar", "Club"]), "source": rng.choice(["Bar", "S1", "S2"]), "eventURL": f"u{rng.randint(0, 60)}", "unixDate": 1_764_547_200_000 + rng.randint(0, 3) * 86_400_000 + rng.choice([0, 61_200_000, 72_000_000])}
        for k in range(400)
    ]
    schema = "seq long, eventName string, place string, city string, country string, source string, style string, detailedStyle string, eventURL string, unixDate long"
    table = spark.createDataFrame([(r["seq"], r["eventName"], r["place"], "Lyon", "France", r["source"], "x", None, r["eventURL"], r["unixDate"]) for r in rows], schema)
    got = {(r.seq, r.eventName, r.unixDate, r.eventURL, None if r.altURLs is None else tuple(r.altURLs), r.n_members, r.warning) for r in merge.merge_events(table, zone).collect()}
    assert got == naive_events(rows, zone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=4), max_size=14))
def test_repeated_names_cluster_alike(keys):
    groups = []
    for k, key in enumerate(keys):
        near = [g for g in groups if merge.alike(keys[g[0]], key)] or [[]]
        if not near[0]:
            groups.append(near[0])
        near[0].append(k)
        for g in near[1:]:
            near[0].extend(g)
        groups = [g for g in groups if not any(g is x for x in near[1:])]
    assert merge.cluster(keys) == groups


def test_merge_query_reads_all_events(spark):
    from agendaflow.plans import event_queries

    sf = "/root/testdata/sf0.001"
    merged = event_queries.merge_duplicate_events(spark, sf).select("seq", "n_members").distinct()
    assert merged.agg(F.sum("n_members")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=20))
def test_simple_is_idempotent_in_python(t):
    once = merge.simple(t)
    assert merge.simple(once).strip() == once.strip()


def test_text_columns(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.simplify(F.lit("  L'Été\n«à» Crème-Brûlée  "))) == "l ete «a» creme brulee"
    assert one(text.make_url(F.lit("/a"), F.lit("https://h.org:80/x/y/"))) == "https://h.org/a"
    assert one(text.make_url(F.lit("mailto:a"), F.lit("https://h.org/"))) == "mailto:a" and one(text.make_url(F.lit(""), F.lit("http://h/"))) is None
    assert one(text.make_url(F.lit("b.html"), text.base_url(F.lit("http://h/x/y.html?q=1")))) == "http://h/x/b.html"
    assert one(text.parse_number(F.lit("4.383333 https://x"))) == 4.383333 and one(text.parse_number(F.lit("n"))) is None
    assert one(text.append_log(F.lit(None).cast("string"), F.lit("\x1b[31mno\x1b[0m"))) == "no"
    assert one(text.strip_accents_any(F.lit("ệ đ"))) == "e đ"
    assert one(maps.wrap_longitude(F.lit(190.0), F.lit(-160.0))) == -170.0 and one(maps.in_circle(F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(4.0), F.lit(5.0)))
    assert "addedTag" in one(text.wrap_broken_lines(F.lit("<p>a<br>b</p>")))
    assert one(html.clean_attribute_classes(F.lit('<p class="a:b c">x</p>'))) == '<p class="ab c">x</p>'


def test_files(spark, tmp_path):
    folder = tmp_path / "France"
    folder.mkdir()
    (folder / "lyon_place.csv").write_text("PLACE,LATITUDE,LONGITUDE,URL\nBar, 45.7,4.8,http://bar,music\nClub,45.1,4.383333 https://club\n\n")
    places = csv.read_places(spark, str(folder / "lyon_place.csv"))
    got = {r.title: r for r in places.collect()}
    assert (got["Bar"].icon, got["Bar"].city, got["Bar"].country, got["Club"].longitude, got["Club"].url) == ("music", "lyon", "France", 4.383333, None)
    geojson.write_place_files(places, str(tmp_path / "out"))
    (value,) = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).select("value").collect()]
    assert [f["id"] for f in value["features"]] == ["Bar", "Club"] and value["features"][0]["geometry"]["coordinates"] == [4.8, 45.7]
    (tmp_path / "one.geojson").write_text(json.dumps(value))
    back = geojson.read_features(spark, str(tmp_path / "one.geojson"), "title:string,icon:string")
    assert {(r.title, r.latitude) for r in back.collect()} == {("Bar", 45.7), ("Club", 45.1)}
    events = spark.createDataFrame([("Bar", "a;b", 5, "Rock", None, "u", "no date"), ("Bar", "c", 6, "Live", "x", "v", None)], "place string, eventName string, unixDate long, style string, detailedStyle string, eventURL string, errorLog string")
    csv.write_events(events, str(tmp_path / "events"))
    assert {(r.title, r.time, r.size, r.style) for r in csv.read_events(spark, str(tmp_path / "events")).collect()} == {("a", None, 5, "100"), ("c", 6, 100, "Live")}  # not quoted: a semicolon moves what follows
    geojson.write_logs(events, "errorLog", str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).where("value = 'errorLog: no date'").count() == 1
    site = tmp_path / "web" / "France" / "Lyon" / "Bar"
    site.mkdir(parents=True)
    for k in (0, 1):
        (site / f"Bar{k}.html").write_text(f"<html><body>page {k}</body></html>")
    read = page_files.read_pages(spark, str(tmp_path / "web"))
    assert {(r.country, r.city, r.venue, r.page_no) for r in read.collect()} == {("France", "Lyon", "Bar", 0), ("France", "Lyon", "Bar", 1)}
    assert page_files.join_pages(read).first().html == "<body>page 0</body>\n<body>page 1</body>"
    assert page_files.read_pages(spark, str(tmp_path / "web"), 1).count() == 1
    (tmp_path / "tz.json").write_text('{"France":"Europe/Paris","Canada":{"Montreal":"America/Montreal"}}')
    assert {(r.country, r.city, r.tz) for r in page_files.read_zones(spark, str(tmp_path / "tz.json")).collect()} == {("France", None, "Europe/Paris"), ("Canada", "Montreal", "America/Montreal")}


def test_fetch(spark):
    def fetch(url):
        if url == "bad":
            raise OSError("down")
        return f"<p>{url}</p>"

    got = {r.url: r for r in page_files.fetch_pages(spark.createDataFrame([("a",), ("bad",)], "url string"), fetch, wait=0).collect()}
    assert got["a"].html == "<p>a</p>" and got["bad"].html is None and got["bad"].error == "down"


def test_registry_and_selection(spark):
    venues = spark.createDataFrame([("Bar|Lyon|France", "Bar", "Lyon", "France"), ("Été|Dijon|France", "Été", "Dijon", "France")], "id string, name string, city string, country string")
    assert filters.select_venues(venues, "ete", "*", None).count() == 1 and filters.find_venue(venues, "bar lyon france").count() == 1
    edited = registry.change_list(spark.createDataFrame([("France", ["french"])], "country string, languages array<string>"), "languages", ["breton", "french"], ["x"])
    assert edited.first().languages == ["french", "breton"]
    kept = registry.delete(venues, "city", ["Lyon", "Dijon"], venues.where("city = 'Lyon'").select("city"))
    assert [r.city for r in kept.collect()] == ["Lyon"]
    row = spark.createDataFrame([("v", None, "d", {"eventName": ["a"]}, None)], "id string, url string, eventsDelimiterTag string, mainPage map<string,array<string>>, linkedPage map<string,array<string>>")
    assert filters.reject_reason(row, F.lit(True)).first().reject_reason == "no url"
    assert filters.reject_reason(row.withColumn("url", F.lit("u")), F.lit(True)).first().reject_reason == "no date key"
    assert pages.sub_events(venues.select("name", "city", F.array(F.struct(F.lit("x").alias("name"), F.lit("").alias("city"))).alias("subs")), F.col("subs"), ("city",), ("name",)).where("name = 'Bar x' AND city = 'Lyon'").count() == 1


def test_streams(spark, tmp_path):
    from agendaflow.streaming import pages as stream

    src = tmp_path / "in"
    src.mkdir()
    rows = [{"url": f"u{k % 3}", "html": str(k), "fetched": f"2025-01-01T0{k}:00:00Z"} for k in range(6)]
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)))
    for name, df in (("links", stream.new_links(stream.page_stream(spark, str(src)))), ("hours", stream.pages_per_window(stream.page_stream(spark, str(src))))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "links" else "complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(90)
    assert spark.table("links").count() == 3 and spark.table("hours").count() == 6
    for _ in range(2):
        assert stream.replace_pages(stream.page_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(90)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


EVENT = "seq long, eventName string, place string, city string, country string, source string, style string, detailedStyle string, eventURL string, unixDate long"


def one_day(names):
    return [(k, n, "Bar", "Lyon", "France", "S", None, None, f"u{k}", 1_764_547_200_000) for k, n in enumerate(names)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_of_one_day_equal_the_naive_ones(spark, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(3, 8)))
    pool = [" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(120)]
    pool += [p[k : k + rng.randint(1, 12)] for p in pool for k in (0, 3, 7)] + (["", "a", None] if seed == 3 else [])
    names = [rng.choice(pool) for _ in range(700)]
    got = {}
    for r in merge.grouped(spark.createDataFrame(one_day(names), EVENT)).collect():
        got.setdefault(r.group, []).append((r.ord, r.seq))
    plain = [merge.simple(n) for n in names]
    assert sorted([k for _, k in sorted(v)] for v in got.values()) == sorted(merge.cluster(plain))
    assert len(got) > 1 or seed == 3


def test_a_hundred_thousand_names_of_one_day(spark):
    """Names in chains: each third name lies in the next one, the others stand alone."""
    names = []
    for k in range(33_000):
        names += [f"soiree {k:06d} quartet", f"la soiree {k:06d} quartet live", f"bal {k * 7:07d} des pompiers"]
    began = time.perf_counter()
    out = merge.grouped(spark.createDataFrame(one_day(names), EVENT).repartition(4))
    groups = {}
    for r in out.select("group", "seq").collect():
        groups.setdefault(r.group, []).append(r.seq)
    assert time.perf_counter() - began < 120
    assert sorted(map(sorted, groups.values())) == sorted([[3 * k, 3 * k + 1] for k in range(33_000)] + [[3 * k + 2] for k in range(33_000)])


def test_linked_sets(spark):
    links = [(k, k + 1) for k in range(300)] + [(1000, 1000 + k) for k in range(200)] + [(5, 5), (2000, 2001)]
    got = {r.node: r.root for r in linked_sets(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1200)} | {2000: 2000, 2001: 2000}
    assert linked_sets(spark.createDataFrame([], "a long, b long")).count() == 0
