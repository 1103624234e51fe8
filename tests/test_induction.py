"""Induction by joins over elements against the same on trees."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from agendaflow import storage
from agendaflow.functions import html
from agendaflow.operators import induction, nodes

ALL = 2**31 - 1


def markup(rng, depth=0):
    inner = "".join(markup(rng, depth + 1) for _ in range(rng.randint(0, 3))) if depth < 5 else "x"
    tag, own = rng.choice(["div", "ul", "li", "p", "a", "b"]), rng.choice(["", ' class="a"', ' class="a b"', ' class="b c"'])
    own += f' href="/{rng.randint(0, 99)}"' if rng.random() < 0.1 else ""
    return f"<{tag}{own}>{rng.choice(['', rng.choice('QRST') + str(rng.randint(0, 9))])}{inner}</{tag}>"


@pytest.fixture(scope="module")
def sites():
    rng = random.Random(21)
    return {k: "".join(markup(rng) for _ in range(3)) for k in range(15)} | {90: "", 91: "plain"}


@pytest.fixture(scope="module")
def trees(sites):
    roots = {k: html.parse(s) for k, s in sites.items()}
    return {k: (r, {id(n): i for i, n in enumerate(r.walk())} | {id(r): -1}) for k, r in roots.items()}


@pytest.fixture(scope="module")
def table(spark, sites):
    return nodes.page_nodes(spark.createDataFrame(list(sites.items()), "page int, html string")).cache()


def test_paths(spark, trees, table):
    want, hits = set(), []
    for k, (root, at) in trees.items():
        for n in root.walk():
            want.add((k, at[id(n)], -1, html.absolute_path(n)))
            want.add((k, at[id(n)], at[id(n.parent)], html.absolute_path(n, n.parent)))
            hits += [(k, at[id(n)], -1), (k, at[id(n)], at[id(n.parent)])]
    got = induction.paths_of(table, spark.createDataFrame(hits, "page int, node_id int, top_id int"), "page")
    assert {tuple(r) for r in got.select("page", "node_id", "top_id", "path").collect()} == want


def test_paths_of_many_kinds(spark):
    """Siblings that all have a class of their own meet few others."""
    page = "<ul>" + "".join(f'<li class="i c{k}">n</li>' for k in range(5000)) + '<li class="i">n</li></ul>'
    table = nodes.page_nodes(spark.createDataFrame([(1, page)], "page int, html string"))
    got = {r.node_id: r.segment for r in induction.segments(table, "page").collect()}
    assert got[0] == "ul" and got[1] == "li.i.c0" and got[5001] == "li.i:eq(5000)" and len(got) == 5002


PATHS = ["div", "div>p", "div.a>li>b", "p.a.b", "li:eq(1)", "div>b:eq(0)", "div:eq(0)>p:not([class])", "*:not([class])", "div:eq(1)>li:eq(0)>p:eq(0)", "li>*>a:eq(1)>b", "no way", "b.c"]


def test_selections(spark, trees, table):
    paths = spark.createDataFrame([(k, p, p) for k in trees for p in PATHS], "page int, path_id string, path string")
    want = {(k, p, at[id(n)]) for k, (root, at) in trees.items() for p in PATHS for n in html._descend(root, p)}
    assert {tuple(r) for r in induction.descend(table, paths, "page").collect()} == want
    starts = table.where("tag IN ('div', 'li')").select("page", F.col("node_id").alias("start_id"), "last_id")
    more = paths.unionByName(paths.select("page").distinct().select("page", F.lit("").alias("path_id"), F.lit("").alias("path")))
    want = {(k, at[id(n)], p, at[id(x)]) for k, (root, at) in trees.items() for n in root.walk() if n.tag in ("div", "li") for p in [*PATHS, ""] for x in html.select(n, p)}
    got = induction.reach(table, starts, more, "page")
    assert {tuple(r) for r in got.select("page", "start_id", "path_id", "node_id").collect()} == want


def test_elements_of_strings(spark, trees, table):
    strings = [["q1"], ["Q2", "r3"], ["S"], ["T4", "T5"], ["nowhere"]]
    rows = [(k, i, s, -1, ALL) for k in trees for i, s in enumerate(strings)]
    got = induction.smallest_holding(table, spark.createDataFrame(rows, "page int, i int, strings array<string>, from_id int, to_id int"), "page")
    want = {(k, i, at[id(n)]) for k, (root, at) in trees.items() for i, s in enumerate(strings) if (n := html.smallest_holding(root, s))}
    assert {(r.page, r.i, r.node_id) for r in got.collect()} == want and len(want) > 10
    rows = [(k, s, -1, ALL) for k in trees for s in ("Q1", "R", "S3", "T", "nowhere")]
    got = induction.chain_ends(table, spark.createDataFrame(rows, "page int, string string, from_id int, to_id int"), "page")
    want = {(k, s, at[id(n)]) for k, s, *_ in rows for root, at in [trees[k]] if (n := html.chain_end(root, s))}
    assert {(r.page, r.string, r.node_id) for r in got.collect()} == want and len(want) > 10


def test_ancestors(spark, trees, table):
    hits = table.select("page", "node_id")
    want = {(k, at[id(n)], at[id(html.with_link(n))]) for k, (root, at) in trees.items() for n in root.walk()}
    assert {tuple(r) for r in induction.with_link(table, hits, "page").collect()} == want
    rng, groups, want = random.Random(3), [], set()
    for k, (root, at) in trees.items():
        every = list(root.walk())
        for g in range(8 if every else 0):
            some = rng.sample(every, min(len(every), rng.randint(1, 3)))
            groups += [(k, g, at[id(n)]) for n in some]
            if at[id(html.common_ancestor(some))] >= 0:
                want.add((k, g, at[id(html.common_ancestor(some))]))
    got = induction.common_ancestors(table, spark.createDataFrame(groups, "page int, g int, node_id int"), ["g"], "page")
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20


def test_leaves(spark, trees, table):
    # a root is no element: trees in which it is itself a leaf are compared below
    want = {(k, at[id(n)]) for k, (root, at) in trees.items() for n in html.leaf_texts(root) if n is not root}
    assert {(r.page, r.node_id) for r in induction.leaf_elements(table, "page").collect()} == want and len(want) > 40
    few = nodes.page_nodes(spark.createDataFrame([(1, "<b>one <i>two</i></b><i></i>"), (2, "<div><br>x<p>y<img>z</p></div>")], "page int, html string"))
    assert {(r.page, r.tag, r.text) for r in induction.leaf_elements(few, "page").collect()} == {(1, "b", "one two"), (2, "div", "x y z"), (2, "p", "y z")}


@pytest.mark.parametrize("seed", range(3))
def test_regrouped(spark, seed):
    rng = random.Random(seed)
    # as paths of elements are: where one of a kind has a number, all have
    one = lambda: ">".join(rng.choice(["a:eq(0)", "a:eq(1)", "a:eq(2)", "b", "b.x"]) for _ in range(rng.randint(1, 3)))
    given = {k: [one() for _ in range(rng.randint(1, 8))] for k in range(40)}
    rows = [(k, i, p) for k, v in given.items() for i, p in enumerate(v)]
    got = induction.regrouped(spark.createDataFrame(rows, "k int, path_no int, path string"), "k").orderBy("k", "path_no").collect()
    assert {k: {r.path for r in got if r.k == k} for k in given} == {k: set(html.regroup_paths(v)) for k, v in given.items()}
    assert all(sorted(r.path_no for r in got if r.k == k) == list(range(sum(r.k == k for r in got))) for k in given)


def test_what_was_regrouped_stays_away(spark):
    rows = [(1, i, p) for i, p in enumerate(["a:eq(0)>b:eq(2)", "a>b:eq(2)", "a>b:eq(1)", "c"])]
    got = induction.regrouped(spark.createDataFrame(rows, "k int, path_no int, path string"), "k").orderBy("path_no")
    assert [(r.path_no, r.path) for r in got.collect()] == [(0, "c"), (1, "a>b")]


def listing(rng, k):
    entry = lambda i: f'<li class="{rng.choice(["item", "item big", "item big first"])}"><a href="/e{i}"><h3 class="t">Name {k}.{i}</h3></a><p class="d">{i % 4 + 1} mai</p><p>{rng.choice(["Bar", "Club"])}</p></li>'
    return f'<div><ul class="list">{"".join(entry(i) for i in range(rng.randint(1, 7)))}</ul><p>end</p></div>'


def test_recipes(spark):
    rng = random.Random(8)
    pages = {k: listing(rng, k) for k in range(12)}
    pages |= {20: '<a href="/x"><div class="e"><b>Solo</b><i>9 mai</i></div></a>', 21: "<p>nothing</p>", 22: ""}
    samples = {k: {"eventName": [f"Name {k}.0"], "eventDate": ["1 mai"]} for k in pages} | {20: {"eventName": ["solo", ""], "eventMultiDate": ["9 mai"]}}
    table = nodes.page_nodes(spark.createDataFrame(list(pages.items()), "page int, html string")).cache()
    rows = spark.createDataFrame([(k, key, [*v, None]) for k, s in samples.items() for key, v in s.items()], "page int, key string, strings array<string>")
    for links in (True, False):
        got = {r.page: (r.delimiter, r.main_page, r.events, r.dates) for r in induction.induce(table, rows, "page", links=links).collect()}
        want = {k: html.analyse(pages[k], samples[k], links) for k in pages}
        assert got == {k: (w["delimiter"], w["mainPage"], w["events"], [d for d in w["dates"]] if k < 20 else []) for k, w in want.items() if w["delimiter"]}
    assert induction.induce(table, rows.where("false"), "page").count() == 0


def test_counted_events(spark):
    pages = [(1, '<p><b>A</b><i>1</i></p><p><b>A</b><i>1</i></p><p><b>B</b></p><p class="x"><b>C</b><i>2</i></p>'), (2, "<p>A</p>")]
    table = nodes.page_nodes(spark.createDataFrame(pages, "page int, html string"))
    tries = spark.createDataFrame([(p, d, d) for p, _ in pages for d in ("p", "p.x", "div")], "page int, path_id string, path string")
    recipe = spark.createDataFrame([(1, "eventName", 0, "b"), (1, "eventDate", 0, "i"), (1, "eventPlace", 0, "u")], "page int, key string, path_no int, path string")
    got = {(r.page, r.path_id): r.events for r in induction.count_events(table, tries, recipe, "page").collect()}
    assert got == {(1, "p"): 2, (1, "p.x"): 1, (1, "div"): 0, (2, "p"): 1, (2, "p.x"): 0, (2, "div"): 0}
    assert html.count_events(html.parse(pages[0][1]), "p", {"eventName": ["b"], "eventDate": ["i"]}) == 2


def test_recipes_where_pages_lie(spark):
    """On elements dealt by page no join sends a table to all or moves rows, and no table between is left."""
    rng = random.Random(5)
    pages = {k: listing(rng, k) for k in range(30)}
    samples = {k: {"eventName": [f"Name {k}.0"], "eventDate": ["1 mai"]} for k in pages}
    rows = spark.createDataFrame([(k, key, v) for k, s in samples.items() for key, v in s.items()], "page int, key string, strings array<string>")
    table = storage.dealt(nodes.page_nodes(spark.createDataFrame(list(pages.items()), "page int, html string")), "elements", "page")
    rows = storage.dealt(rows, "strings", "page")
    store, folder = spark._jsparkSession.sharedState().statusStore(), Path(storage.shared_folder(spark).removeprefix("file://"))
    before, there, keys = store.executionsCount(), set(folder.iterdir()), [k.replace("__", ".") for k in induction._WHERE_THEY_LIE]
    keys = {k: spark.conf.get(k, None) for k in keys}
    found = induction.induce(table, rows, "page")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    ran = store.executionsList(before, 10000)
    plans = [ran.apply(i).physicalPlanDescription().split("== Initial Plan ==")[0] for i in range(ran.size())]
    assert len(plans) > 20 and not any("BroadcastExchange" in p for p in plans)
    assert sum("hashpartitioning(page" in p and "SortMergeJoin" in p for p in plans) == 0
    assert {p.name.rpartition("-")[0] for p in set(folder.iterdir()) - there} == {"induced-recipes"}
    assert {k: spark.conf.get(k, None) for k in keys} == keys and not [t for t in spark.catalog.listTables() if t.name.startswith("agendaflow_") and t.tableType != "TEMPORARY"]
    want = {k: html.analyse(pages[k], samples[k]) for k in pages}
    got = {r.page: (r.delimiter, r.main_page, r.events, r.dates) for r in found.collect()}
    assert got == {k: (w["delimiter"], w["mainPage"], w["events"], w["dates"]) for k, w in want.items() if w["delimiter"]}
