"""Page cleaning, rules, scores and plug-ins."""

from pyspark.sql import functions as F

from agendaflow.functions import html
from agendaflow.operators import recipes


def test_shapes(spark):
    one = lambda f, x: spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("y")).first().y
    assert one(html.lower_text, "<B>Ab</B>C") == "<B>ab</B>c"
    assert one(html.close_links, '<a class="x">1<a class="x">2</a></a>') == '<a class="x">1</a><a class="x">2</a>'
    assert one(html.add_depth, '<div><p class="d">x</p></div>') == '<div class="depth1"><p class="d depth2">x</p></div>'
    assert one(html.compact, '<p class="long name" id="i">x</p>') == '<p class="c0 c1">x</p>' and one(html.minimal, '<p class="long">x</p>') == "<p>x</p>"
    assert one(html.plain_text, "<p>a<b>c</b></p><i>d</i>") == "a\nc\nd" and one(html.parenthesis, "<p>a<b>c</b></p>") == "p(a b(c))"
    cleaned = one(html.clean_page, "<div><script>x</script><nav>n</nav><form>f</form><a href='/1'>one</a></div>")
    assert cleaned == '<div class="depth1"><a href="/1" class="depth2">one</a></div>'


def test_rules(spark):
    rows = [("Le 5 mai", []), ("Le 5 mai", ["\\d+"]), ("Le 5 mai 5", ["5", "6"]), ("x", None)]
    got = [r.y for r in spark.createDataFrame(rows, "f string, rule array<string>").select(recipes.apply_rule(F.col("f"), F.col("rule")).alias("y")).collect()]
    assert got == ["Le 5 mai", "5", "Le 6 mai 5", "x"]
    m = spark.createDataFrame([({"a": ["1"], "b": []}, {"a": ["2"], "c": ["3"]})], "x map<string,array<string>>, y map<string,array<string>>")
    r = m.select(recipes.merge_maps(F.col("x"), F.col("y")).alias("m"), recipes.prune(F.col("x")).alias("p")).first()
    assert r.m == {"a": ["1", "2"], "b": [], "c": ["3"]} and r.p == {"a": ["1"]}
    assert spark.range(1).select(recipes.plausible_year(F.lit(2026), 2025).alias("a"), recipes.uses_alternate("eventDate", F.lit("x")).alias("b"), recipes.uses_alternate("eventName", F.lit("x")).alias("c")).first() == (True, True, False)


def test_scores(spark):
    blocks = spark.createDataFrame([("v", 0, "<h2>a</h2><p>5 mai</p>"), ("v", 1, "<p>x</p>"), ("v", 2, "<h2>b</h2><p>6 mai</p>")], "v string, n int, b string")
    recipe = F.create_map(F.lit("eventName"), F.array(F.lit("h2")), F.lit("eventDate"), F.array(F.lit("p")))
    scored = recipes.scores(blocks, "b", recipe)
    assert {(r.n, r.hits, r.is_event) for r in scored.collect()} == {(0, 2, True), (1, 1, False), (2, 2, True)}
    assert recipes.best_block(scored, "v", "n").first() == ("v", 0, 2, 3)
    nodes = spark.createDataFrame([("v", ["a", "b"]), ("v", ["a"]), ("w", [])], "v string, c array<string>")
    assert {r.v: r.most for r in recipes.class_difference(nodes, "v", "c").collect()} == {"v": 1, "w": 0}


def test_plugins(spark):
    rows = [("d", k, kind, v) for k, (kind, v) in enumerate([("artist", "A"), ("date", "1"), ("place", "P"), ("artist", "B"), ("artist", "C"), ("place", "Q"), ("date", "2"), ("artist", "D")])]
    got = recipes.close_records(spark.createDataFrame(rows, "g string, s int, kind string, v string"), "g", "s", "kind", "v").collect()
    assert [tuple(r) for r in got] == [("d", "A", "1", "P"), ("d", "C", "2", "Q")]
    asked = recipes.classify(spark.createDataFrame([(1, "rock"), (2, None)], "id int, t string"), "t", str.upper)
    assert {r.id: r.style for r in asked.collect()} == {1: "ROCK", 2: None}
