"""Markup with implied ends, recipes from samples, sub-events, registries and what a run writes."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from agendaflow.functions import dates, html, maps, text
from agendaflow.operators import extract, nodes, pages, recipes
from agendaflow.sources import pages as page_files
from agendaflow.sources import registries

SITE = (
    '<div class="list"><div class="item big first"><a href="/e/1"><h3 class="t">Alpha</h3></a><p class="d">5 mai<p class="p">Bar'
    '<ul><li><b>20h</b> <i>Set one</i><li><b>22h</b> <i>Set two</i></ul></div>'
    '<div class="item big"><a href="/e/2"><h3 class="t">Beta</h3></a><p class="d">6 mai<p class="p">Club</div>'
    '<div class="item"><a href="/e/3"><h3 class="t">Gamma</h3></a><p class="d">7 mai<p class="q">Hall</div></div><footer><p>end</footer>'
)


def tree(source):
    return [(n.tag, n.depth, n.text()) for n in html.parse(source).walk()]


def test_implied_ends():
    assert tree("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == [("ul", 1, "a b c d"), ("li", 2, "a"), ("li", 2, "b c"), ("ul", 3, "c"), ("li", 4, "c"), ("li", 2, "d")]
    assert tree("<p>a<p>b<div>c</div>") == [("p", 1, "a"), ("p", 1, "b"), ("div", 1, "c")]
    assert tree("<table><tr><td>1<td>2</div><tr><th>3</table>x") == [("table", 1, "1 2 3"), ("tr", 2, "1 2"), ("td", 3, "1"), ("td", 3, "2"), ("tr", 2, "3"), ("th", 3, "3")]
    assert tree("<dl><dt>a<dd>b<dt>c</dl><select><option>1<option>2</select>") == [("dl", 1, "a b c"), ("dt", 2, "a"), ("dd", 2, "b"), ("dt", 2, "c"), ("select", 1, "1 2"), ("option", 2, "1"), ("option", 2, "2")]
    assert tree("<div><table><tr><td></div>a</td></table>b</div>")[0] == ("div", 1, "a b")
    blocks = html._descend(html.parse("<ul><li>one<li>two<li>three</ul>"), "ul>li")
    assert [n.text() for n in blocks] == ["one", "two", "three"]


def test_deep_markup(spark):
    deep = "<div>" * 10_000 + "x" + "<p>" * 1500 + "y"
    root = html.parse(deep)
    assert root.text() == "x y" and html.parse(html.outer(root)).text() == "x y" and sum(1 for _ in root.walk()) == 11_500
    assert len(html.absolute_path(list(root.walk())[-1]).split(">")) == 10_001
    html.register(spark)
    spark.createDataFrame([(deep,)], "h string").createOrReplaceTempView("deep")
    assert spark.sql("SELECT max(n.depth) AS d FROM deep, LATERAL html_nodes(h) n").first().d == 10_000


def test_sibling_index(spark):
    html.register(spark)
    spark.createDataFrame([('<p class="a"><p class="a b"><p><p class="b"><div class="a"></div>',)], "h string").createOrReplaceTempView("few")
    got = [(r.tag, r.classes, r.sib_index) for r in spark.sql("SELECT n.* FROM few, LATERAL html_nodes(h) n").orderBy("node_id").collect()]
    root, want = html.parse('<p class="a"><p class="a b"><p><p class="b"><div class="a"></div>'), []
    for n in root.walk():
        alike = [c for c in n.parent.children if c.tag == n.tag and set(c.classes) >= set(n.classes)]
        want.append((n.tag, n.classes, alike.index(n)))
    assert got == want


def test_sub_events_and_alternates():
    root = html.parse(SITE)
    first, second, third = html._descend(root, "div.item")
    recipe = {"eventName": ["a>h3"], "eventPlace": ["p.p"], "eventURL": ["a"], "eventMultiName": ["ul>li>i"], "eventMultiDate": ["ul>li>b"]}
    assert html.fields_of(first, recipe) == {"eventName": "Alpha", "eventPlace": "Bar", "eventURL": "/e/1"}
    assert html.sub_events_of(first, recipe) == [{"eventName": "Set one", "eventDate": "20h"}, {"eventName": "Set two", "eventDate": "22h"}]
    assert html.sub_events_of(second, recipe) == []
    # a field that is there is appended to, a place overwritten where it is found; on a linked page all are
    before = {"eventName": "The ", "eventPlace": "old", "eventURL": "u"}
    assert html.fields_of(third, recipe, None, before) == {"eventName": "The Gamma", "eventPlace": "old", "eventURL": "/e/3"}
    assert html.fields_of(third, {"eventName": ["a>h3"], "eventStyle": ["i"]}, None, before, True)["eventName"] == "Gamma"
    # alternates fill what is blank, and every date apart
    other = {"eventPlace": ["p.q"], "eventName": ["p.q"], "eventDate": ["p.d"]}
    assert html.fields_of(third, recipe, other) == {"eventName": "Gamma", "eventPlace": "Hall", "eventURL": "/e/3", "altEventDate": "7 mai"}
    assert html.common_prefix(["a>b>c", "a>b>d>e"]) == "a>b" and html.common_prefix(["a", "b"]) == ""


def test_links_of_recipes():
    root = html.parse(SITE)
    assert html.links_of(root, "div.item", {"eventURL": ["a>h3"]}) == ["/e/1", "/e/2", "/e/3"]
    assert html.links_of(root, "div.item>a", {}) == ["/e/1", "/e/2", "/e/3"]
    subs = html.parse('<ul><li><p><a class="x" href="/1">1</a><a class="x" href="/2">2</a></ul>')
    assert html.links_of(subs, "ul>li", {"eventMultiURL": ["p>a.x:eq(1)"]}) == ["/2"]


def test_tree_tools():
    root = html.parse(SITE)
    h3 = [n for n in root.walk() if n.tag == "h3"]
    assert html.with_link(h3[0]).tag == "a" and html.with_link(root.children[0]) is root.children[0]
    assert html.chain_end(root, "Gamma").tag == "h3" and html.chain_end(root, "nowhere") is None
    assert html.common_ancestor(h3).classes == ["list"] and html.common_ancestor(h3[:1]) is h3[0] and html.common_ancestor([]) is None
    assert html.is_ancestor(root, h3[0]) and not html.is_ancestor(h3[0], root)
    assert html.shorten(root, "div.list>div.item:eq(1)>a>h3.t") in ("a>h3.t", "div.item:eq(1)>a>h3.t")
    assert [n.text() for n in html.leaf_texts(html.parse("<div>own<p>a <b>b</b> c</p><ul><li>d</ul></div>"))] == ["own a b c d", "a b c", "d"]


def test_whole_induction(spark):
    samples = {"eventName": ["Alpha"], "eventDate": ["5 mai"]}
    got = html.analyse(SITE, samples)
    assert got == {"delimiter": "div.item", "mainPage": {"eventName": ["a>h3.t"], "eventDate": ["p.d"]}, "events": 3, "dates": ["5 mai", "6 mai", "7 mai"]}
    assert html.count_events(html.parse(SITE), "div.item.big.first", got["mainPage"]) == 1
    assert html.loosen(html.parse(SITE), "div.list>div.item.big.first", got["mainPage"]) == ("div.list>div.item", 3)
    assert html.analyse(SITE, {"eventName": ["missing"]})["delimiter"] is None
    main, other = html.revise(SITE, "div.item", {"eventPlace": ["p.p"]}, {"eventPlace": ["Hall"]})
    assert (main, other) == ({"eventPlace": ["p.p"]}, {"eventPlace": ["p.q"]})
    rows = spark.createDataFrame([(SITE, samples), (None, {})], "h string, s map<string,array<string>>")
    assert [r.r.events for r in rows.select(html.analyse_pages(F.col("h"), F.col("s"), F.lit(True)).alias("r")).collect()] == [3, 0]


def test_events_with_sub_events(spark):
    recipe = {"eventName": ["a>h3"], "eventDate": ["p.d"], "eventURL": ["a"], "eventMultiName": ["ul>li>i"], "eventMultiDate": ["ul>li>b"]}
    venues = spark.createDataFrame([("v", "http://s/list", "div.item", recipe, {"eventPlace": ["h1"], "eventName": ["h9"]}, {"eventPlace": ["h2"]})], "id string, url string, delimiter string, mainPage map<string,array<string>>, linkedPage map<string,array<string>>, alternates map<string,array<string>>")
    stored = spark.createDataFrame([("v", 0, SITE)], "venue_id string, page_no int, html string")
    linked = spark.createDataFrame([("http://s/e/2", "<h1>Big hall</h1>"), ("http://s/e/3", "<h2>Other hall</h2>")], "url string, html string")
    got = {(r.block_no, r.sub_no): r for r in extract.events_of(extract.blocks_of(stored, venues), linked).collect()}
    assert [(r.eventName, r.eventDate, r.eventPlace, r.errorLog) for _, r in sorted(got.items())] == [
        ("Alpha Set one", "5 mai 20h", None, "no linked page: http://s/e/1"), ("Alpha Set two", "5 mai 22h", None, "no linked page: http://s/e/1"),
        ("Beta", "6 mai", "Big hall", None), ("Gamma", "7 mai", "Other hall", None),
    ]


def test_dates_by_row(spark):
    form = lambda month: {"order": ["day", "month", "year"], "month": month, "year": "long"}
    rows = [
        (1, "5 mai 2026 à 20h", None, [form("long")], [], "Europe/Paris", "french"),
        (2, "05.06.2026", None, [form("long"), form("numeric")], [], "Asia/Ho_Chi_Minh", "french"),
        (3, "soon", "7 mai 2026", [form("long")], [form("long")], "UTC", "french"),
        (4, "soon", "later", [form("long")], [form("long")], "UTC", "french"),
        (5, "5 mai 2026", None, [form("long")], [], "UTC", "english"),
        (6, None, None, [form("long")], [], "UTC", "french"),
        (7, "5 mai 2026", None, [form("long")], [], None, "french"),
        (8, "5 mai 2026", None, None, None, "UTC", None),
    ]
    events = spark.createDataFrame([(*r, None) for r in rows], f"id int, eventDate string, altEventDate string, f array<{extract.FORMAT}>, a array<{extract.FORMAT}>, zone string, language string, errorLog string")
    got = {r.id: (r.unixDate, r.n_possibilities, r.errorLog) for r in extract.dated_by(events, F.col("f"), F.lit("2025-12-01").cast("date"), F.col("zone"), F.col("language"), F.col("a")).collect()}
    ms = lambda d, zone: spark.sql(f"SELECT unix_millis(to_utc_timestamp(timestamp'{d}', '{zone}')) AS m").first().m
    assert got == {
        1: (ms("2026-05-05 20:00:00", "Europe/Paris"), 1, None), 2: (ms("2026-06-05 00:00:00", "Asia/Ho_Chi_Minh"), 1, None), 3: (ms("2026-05-07 00:00:00", "UTC"), 1, None),
        4: (0, 0, "unreadable date"), 5: (0, 0, "unreadable date"), 6: (-1, 0, None), 7: (0, 1, "no time zone"), 8: (0, 0, "unreadable date"),
    }


def test_registries(spark, tmp_path):
    words = {"french": {"dayDict": {"monday": ["lun", "lundi", "lundis"]}, "monthsDict": {"mai": [], "juin": []}, "rangeDelimiters": [["du", "au"]], "rightRangeDelimiters": ["jusqu'au"], "timeMarkers": {"minuit": "24:00"}, "specialMarkers": {"today": ["ce soir"], "tomorrow": ["demain"], "exception": ["sauf"]}, "cancellationKeywords": ["annulé"], "styles": {"Rock": ["ROCK", "Punk"], "": ["Unknown"]}}, "English": {"cancellationKeywords": ["cancelled"]}}
    (tmp_path / "d.json").write_text(json.dumps(words))
    d = registries.read_dictionary(spark, str(tmp_path / "d.json"))
    assert {(r.language, r.word) for r in registries.keywords_of(d).collect()} == {("french", "annulé"), ("english", "cancelled")}
    assert {(r.style, r.ord, r.word) for r in registries.styles_of(d).collect()} == {("Rock", 0, "ROCK"), ("Rock", 0, "Punk"), ("", 1, "Unknown")}
    assert registries.read_dictionary(spark, str(tmp_path / "d.json"), "ENGLISH").count() == 1
    own = registries.date_words(d)
    assert set(own) == {"french"} and own["french"]["weekdays"] == [["lundi", "lundis", "lun"]] and own["french"]["months"] == [["mai"], ["juin"]] and own["french"]["to"] == ["au", "jusqu'au"]
    form = F.array(F.struct(F.array(F.lit("day"), F.lit("month")).alias("order"), F.lit("long").alias("month"), F.lit(None).cast("string").alias("year")))
    shown = spark.createDataFrame([("5 juin", ""), ("5 juillet", "")], "eventDate string, errorLog string")
    read = extract.dated_by(shown, form, F.lit("2026-01-01").cast("date"), F.lit("UTC"), F.lit("french"), dictionaries=own)
    assert {r.eventDate: r.unixDate > 0 for r in read.collect()} == {"5 juin": True, "5 juillet": False}
    (tmp_path / "c.json").write_text('{"France": {"languages": ["french"], "cities": ["Lyon", "Paris"]}}')
    assert [tuple(r) for r in registries.read_countries(spark, str(tmp_path / "c.json")).collect()] == [("France", ["french"], ["Lyon", "Paris"])]
    hints = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    registries.write_map(hints, "key", "value", str(tmp_path / "m"))
    assert sorted(map(tuple, registries.read_map_lines(spark, str(tmp_path / "m")).collect())) == [("a", "1"), ("b", "2")]
    registries.write_registry(hints, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_written_runs(spark, tmp_path):
    events = spark.createDataFrame([("a", None), ("b", "no date")], "eventName string, errorLog string")
    registries.write_events(events, str(tmp_path / "e"))
    assert spark.read.option("wholetext", True).text(str(tmp_path / "e" / "all")).count() >= 1
    back = registries.read_error_log(spark, str(tmp_path / "e" / "errors"), "eventName string, errorLog string")
    assert [tuple(r) for r in back.collect()] == [("b", "no date")]
    page = lambda venue, n, h: ("France", "Lyon", venue, n, h)
    schema, out = "country string, city string, venue string, page_no int, html string", str(tmp_path / "p")
    registries.write_pages(spark.createDataFrame([page("Bar", 0, "x"), page("Bar", 1, "y"), page("Club", 0, "z")], schema), out)
    registries.write_pages(spark.createDataFrame([page("Bar", 0, "new")], schema), out)
    assert {(r.venue, r.html) for r in spark.read.parquet(out).collect()} == {("Bar", "new"), ("Club", "z")}
    registries.write_minimal_copies(spark.createDataFrame([page("Bar", 0, '<head>h</head><a href="/x" style="s">t</a><img src="i">')], schema), str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).first().html == '<a href="/x" >t</a>'
    urls = spark.createDataFrame([("good",), ("bad",)], "url string")
    fetch = lambda u: "<html><body class='x'><script>1</script>  <p>hi</p>\n</body></html>" if u == "good" else "no body here"
    got = {r.url: r for r in registries.fetch_linked_pages(urls, fetch).collect()}
    assert "<p" in got["good"].html and "script" not in got["good"].html and got["good"].error is None and got["bad"].html is None and got["bad"].error == "no body"
    body = spark.createDataFrame([("é".encode("latin-1"), "text/html; charset=ISO-8859-1"), ("é".encode(), "text/html"), ("é".encode("latin-1"), "text/html; charset=windows-1252")], "b binary, t string")
    assert [r.x for r in body.select(registries.decoded(F.col("b"), F.col("t")).alias("x")).collect()] == ["é"] * 3
    assert page_files.read_pages is not None


def test_small_functions(spark):
    row = lambda **c: spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
    broken = F.lit('<p>one<br>two<br>three<i>x</i></p>')
    r = row(
        br=text.wrap_broken_lines(broken), filled=text.fill_message(F.lit("%s of %s"), F.lit("a$1"), F.lit("b")), url=dates.pattern_url(F.lit("http://x/{index}"), F.lit("yyyy-M"), F.lit("2025-11-30").cast("date"), F.lit(2)),
        rest=recipes.combinations_without(F.array(*map(F.lit, "abc")), 2), same=recipes.same_record(F.struct(F.lit(None).cast("int").alias("a")), F.struct(F.lit(None).cast("int").alias("a"))),
        samples=recipes.recipe_of_answer(F.lit('Here: {"eventName": "A", "eventDate": ["1", "2"]}')), short=text.shown_element(F.lit("<b>" + "x" * 60 + "</b>"), F.lit("b"), 10),
        prefix=pages.common_prefix(F.array(F.lit("a>b"), F.lit("a>c"))), end=dates.french_date(F.timestamp_millis(F.lit(0)), "UTC", F.timestamp_millis(F.lit(3600000))),
        label=dates.chart_label(F.lit("2025-03-09").cast("date")), rock=maps.style_colour(F.lit("Rock"), F.lit("Lyon")), art=maps.style_colour(F.lit("Art"), F.lit("hanoi"), 0.8), none=maps.style_colour(F.lit("Art"), F.lit("Lyon")),
    )
    assert r.br == '<p><p class="addedTag">one</p><p class="addedTag">two</p><p class="addedTag">three</p><i>x</i></p>'
    assert r.filled == "a$1 of b" and r.url == "http://x/2026-1" and sorted(map(tuple, r.rest)) == [("a",), ("b",), ("c",)] and r.same
    assert r.samples == {"eventName": ["A"], "eventDate": ["1", "2"]} and r.short == "b: xxxxxxxxxx…" and r.prefix == "a"
    assert r.end == "Le jeudi 1 janvier 1970 à 00:00 → Le jeudi 1 janvier 1970 à 01:00"
    assert (r.label, r.rock, r.art, r.none) == ("9/3", "rgba(230, 0, 30, 0.5)", "rgba(23, 128, 251, 0.8)", "rgba(0, 0, 0, 0.5)")


@pytest.mark.parametrize("query, want", [("?day=3&city=x", 3), ("?day=-2x", -2), ("?time=1741651200000", 2), ("?day=9&date=20250312", 3), ("?date=2025&day=4", 4), ("?day=x", 0), ("", 0)])
def test_addresses(spark, query, want):
    today = F.unix_millis(F.lit("2025-03-09 00:00:00").cast("timestamp"))
    assert spark.range(1).select(dates.address_offset(F.lit("http://map/" + query), today).alias("d")).first().d == want


def test_node_joins_equal_the_tree(spark):
    rng = random.Random(9)

    def markup(depth):
        inner = "".join(markup(depth + 1) for _ in range(rng.randint(0, 3))) if depth < 4 else "x"
        tag, own = rng.choice(["div", "ul", "li", "p", "b"]), rng.choice(["", ' class="a"', ' class="a b"'])
        return f"<{tag}{own}>{rng.randint(0, 9)}{inner}" + (f"</{tag}>" if rng.random() < 0.7 else "")

    sites = {k: "".join(markup(0) for _ in range(4)) for k in range(12)}
    table = nodes.page_nodes(spark.createDataFrame(list(sites.items()), "page int, html string")).cache()
    for path in ("div", "div>p", "div.a>li>b", "p.a.b", "li:eq(1)", "div>b:eq(0)", "div:eq(0)>p:not([class])", "*:not([class])", "div:eq(1)>li:eq(0)>p:eq(0)"):
        want = set()
        for k, source in sites.items():
            root = html.parse(source)
            place = {id(n): i for i, n in enumerate(root.walk())}
            want |= {(k, place[id(n)]) for n in html._descend(root, path)}
        assert {(r.page, r.node_id) for r in nodes.select_path(table, path, "page").select("page", "node_id").collect()} == want, path
    shown = nodes.blocks_and_fields(nodes.page_nodes(spark.createDataFrame([(1, SITE)], "page int, html string")), "div.item", {"eventName": "a>h3", "eventDate": "p.d", "eventPlace": "p.p"}, "page")
    assert sorted(map(tuple, shown.collect())) == [(1, 0, "Alpha", "5 mai", "Bar"), (1, 1, "Beta", "6 mai", "Club"), (1, 2, "Gamma", "7 mai", None)]


def linked_markup(rng, depth=0):
    inner = "".join(linked_markup(rng, depth + 1) for _ in range(rng.randint(0, 3))) if depth < 5 else "x"
    tag, own = rng.choice(["div", "ul", "li", "p", "a"]), rng.choice(["", ' class="a"', ' class="a b"'])
    own += f' href="/{rng.randint(0, 99)}"' if tag == "a" or rng.random() < 0.1 else ""
    return f"<{tag}{own}>{rng.randint(0, 9)}{inner}</{tag}>"


def test_fields_by_joins_equal_the_tree(spark):
    """Blocks inside blocks, numbers, several paths a key, paths at any depth, the block itself, and addresses
    on the element, above it (outside of the block too) and inside it."""
    rng = random.Random(4)
    sites = {k: "".join(linked_markup(rng) for _ in range(3)) for k in range(10)} | {90: "", 91: "plain"}
    recipe = {"eventName": ["li:eq(0)", "p>a"], "eventStyle": "p", "eventDate": ["li:eq(1)>p:eq(0)", "div.a"], "eventPlace": [":not([class])>p:eq(0)"], "eventText": "", "eventURL": ["li"], "otherURL": ["p:eq(0)"], "ownURL": "", "noURL": "table"}
    table = nodes.page_nodes(spark.createDataFrame(list(sites.items()), "page int, html string")).cache()
    for delimiter in ("div", "ul>li"):
        want = set()
        for k, source in sites.items():
            root = html.parse(source)
            place = {id(n): i for i, n in enumerate(root.walk())}
            for n, block in enumerate(sorted(html._descend(root, delimiter), key=lambda x: place[id(x)])):
                want.add((k, n, *(html.extract_field(block, key, [p] if isinstance(p, str) else p) or None for key, p in recipe.items())))
        got = nodes.blocks_and_fields(table, delimiter, recipe, "page").select("page", "block_no", *recipe)
        assert {tuple(r) for r in got.collect()} == want, delimiter


def test_a_page_of_a_hundred_thousand_elements(spark):
    """Blocks and what they hold in time that follows the page's elements, not elements times blocks."""
    page = "<ul>" + "".join(f'<li class="e"><a href="/{k}"><b>n{k}</b></a><p>d{k}</p>' for k in range(25_000)) + "</ul>"
    table = nodes.page_nodes(spark.createDataFrame([(1, page)], "page int, html string")).cache()
    assert table.count() == 100_001
    began = time.perf_counter()
    got = nodes.blocks_and_fields(table, "ul>li.e", {"eventName": "a>b", "eventDate": "p", "eventURL": "a>b"}, "page").agg(F.count("*").alias("n"), F.sum(F.when((F.col("eventName") == F.concat(F.lit("n"), "block_no")) & (F.col("eventURL") == F.concat(F.lit("/"), "block_no")) & (F.col("eventDate") == F.concat(F.lit("d"), "block_no")), 1)).alias("right")).first()
    assert (got.n, got.right) == (25_000, 25_000) and time.perf_counter() - began < 90


def test_paths_number_like_siblings():
    """Against comparing every sibling, and on a list of 20,000 entries in little time."""
    rng = random.Random(6)
    root = html.parse("".join(linked_markup(rng) for _ in range(6)) + "<p></p><p class='a b'></p><p class='a'></p><p class='b a'></p>")
    for n in root.walk():
        alike = [c for c in n.parent.children if html._matches(c, html._own(n))]
        last = html._own(n) + (f":eq({[c is n for c in alike].index(True)})" if len(alike) > 1 else "")
        assert html.absolute_path(n).split(">")[-1] == last
        assert html.select(root, html.absolute_path(n), anywhere=False) == [n]
    began = time.perf_counter()
    found = html.leaf_texts(html.parse("<ul>" + "".join(f"<li class='c{k % 7}'>n{k}" for k in range(20_000)) + "</ul>"))
    assert len({html.absolute_path(n) for n in found}) == 20_000 and time.perf_counter() - began < 10
