"""Markup functions, links and blocks over the ``pages`` table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import pages, stats
from ..storage import dealt, parts, temporary, written
from .registry import query, table


def _drop(x: str, *tags: str) -> str:
    for tag in tags:
        x = f"regexp_replace({x}, '<{tag}[\\s\\S]*?</{tag}>', '', 'g')"
    return x


@query(f"SELECT page_id, {_drop('html', 'script', 'noscript')} AS html FROM pages")
def clean_scripts_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_scripts(F.col("html")).alias("html"))


@query("SELECT page_id, " + _drop("regexp_replace(html, '(?i)<\\s*path[^>]*>(.*?)<\\s*/path\\s*>', '\\1', 'g')", *text.USELESS) + " AS html FROM pages")
def remove_useless_tags_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.remove_useless_tags(F.col("html")).alias("html"))


@query(f"SELECT page_id, {_drop('html', 'form', 'style')} AS html FROM pages")
def remove_forms_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.remove_forms(F.col("html")).alias("html"))


@query("SELECT page_id, nullif(regexp_extract(html, '<body[\\s\\S]*?>[\\s\\S]*?</body>', 0), '') AS body FROM pages")
def extract_body_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.extract_body(F.col("html")).alias("body"))


def _without(x: str, *attributes: str) -> str:
    for name in attributes:
        x = f"regexp_replace({x}, '{name}[ ]*=[ ]*\"[\\s\\S]*?\"', '', 'g')"
    return x


@query(
    "SELECT page_id, "
    + _without(
        "regexp_replace(" + _drop("html", "head", "path", "header", "svg", "video", "option", "button", "footer", "nav", "select") + ", '<img[\\s\\S]*?>', '', 'g')",
        "style", "alt", "decoding", "srcSet", "src", "sizes", "rel", "target", "aria-label", "aria-haspopup", "aria-expanded", "aria-current", "aria-hidden", "aria-disabled", "aria-controls", "data-state",
    )
    + " AS html FROM pages"
)
def minimalize_basic_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.minimalize_basic(F.col("html")).alias("html"))


_STYLED = "regexp_replace(html, '<p>', '<p><img src=\"a\" style=\"top:0; position : absolute\"><b style=\"position:absolute\">', 'g')"


@query(f"SELECT page_id, regexp_replace({_STYLED}, '(<img[^>]*style\\s*=\\s*\"[^\"]*position\\s*:\\s*)absolute', '\\1XXXXXXXX', 'g') AS html FROM pages")
def fix_images_pages(spark, sf_dir):
    styled = F.regexp_replace("html", "<p>", "<p><img src=\"a\" style=\"top:0; position : absolute\"><b style=\"position:absolute\">")
    return table(spark, sf_dir, "pages").select("page_id", text.fix_images(styled).alias("html"))


@query("SELECT page_id, regexp_replace(html, '<p.*?>', '[***IMAGE***]', 'g') AS html FROM pages")
def image_placeholder_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.image_placeholder(F.regexp_replace("html", "<p", "<img")).alias("html"))


_LINKS = "SELECT page_id, url, unnest(generate_series(0, len(h) - 1)) AS pos, unnest(h) AS href FROM (SELECT page_id, url, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS h FROM pages)"


@query(f"SELECT page_id, CAST(pos AS INTEGER) AS pos, href FROM ({_LINKS}) WHERE href <> '#'")
def page_links_exploded(spark, sf_dir):
    return pages.page_links(table(spark, sf_dir, "pages")).select("page_id", "pos", "href")


@query(
    f"""
SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN href = '' THEN NULL WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href
  WHEN href LIKE '/%' THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) || '://' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1) || href
  ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '/') || href END AS link FROM ({_LINKS}) WHERE href <> '#'
"""
)
def page_links_absolute(spark, sf_dir):
    links = pages.page_links(table(spark, sf_dir, "pages"))
    return links.select("page_id", "pos", text.make_url(F.col("href"), text.base_url(F.col("url"))).alias("link"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/[^/]*$', '/') AS base FROM pages")
def base_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.base_url(F.col("url")).alias("base"))


@query("SELECT page_id, CASE WHEN regexp_matches(u, '(?i)^https?://') THEN u ELSE 'https://' || u END AS url FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE regexp_replace(url, '^https?://', '') END AS u FROM pages)")
def normalized_urls(spark, sf_dir):
    given = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^https?://", ""))
    return table(spark, sf_dir, "pages").select("page_id", text.normalize_url(given).alias("url"))


@query("SELECT page_id, unnest(generate_series(0, len(b) - 1))::INTEGER AS block_no, unnest(b) AS block FROM (SELECT page_id, regexp_extract_all(html, '<p>([\\s\\S]*?)</p>', 1) AS b FROM pages)")
def event_blocks_paragraphs(spark, sf_dir):
    return pages.blocks(table(spark, sf_dir, "pages").select("page_id", "html"), "p")


@query(
    """
WITH x AS (SELECT unnest(regexp_extract_all(html, '<([a-zA-Z0-9]+ class="[^"]*)"', 1)) AS x FROM pages)
SELECT lower(regexp_extract(x, '^([a-zA-Z0-9]+)', 1)) AS tag,
  array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(regexp_extract(x, 'class="(.*)$', 1), ' +'), lambda c: c <> ''))), ' ') AS classes, count(*) AS n
FROM x GROUP BY 1, 2 ORDER BY n DESC, tag, classes LIMIT 10
"""
)
def tag_class_top10(spark, sf_dir):
    return stats.tag_class_counts(table(spark, sf_dir, "pages"), "html")


_HREFS = f"SELECT DISTINCT href FROM ({_LINKS}) WHERE href <> '#'"


@query(f"SELECT href FROM ({_HREFS}) WHERE href NOT IN (SELECT '/' || n_name FROM nation) AND href <> '/the'")
def missing_links_anti(spark, sf_dir):
    links = pages.page_links(table(spark, sf_dir, "pages"))
    stored = table(spark, sf_dir, "nation").select(F.concat(F.lit("/"), "n_name").alias("href")).unionByName(spark.range(1).select(F.lit("/the").alias("href")))
    return pages.missing_links(links, stored, "href")


@query(f"SELECT page_id FROM pages WHERE regexp_replace(url, '^.*?([0-9]+)[^0-9]*$', '/\\1') IN ({_HREFS}) OR '/the' IN ({_HREFS}) AND contains(url, '/fr/')")
def existing_links_semi(spark, sf_dir):
    links = pages.page_links(table(spark, sf_dir, "pages"))
    number = F.regexp_replace("url", "^.*?([0-9]+)[^0-9]*$", "/$1")
    stored = table(spark, sf_dir, "pages").select("page_id", F.explode(F.array(number, F.when(F.col("url").contains("/fr/"), F.lit("/the")))).alias("href"))
    return pages.existing_links(links, stored.where("href IS NOT NULL"), "href").select("page_id").distinct()


@query(
    """
SELECT e.event_id, p.page_id, CASE WHEN e.page IS NOT NULL AND p.page_id IS NULL THEN 'no linked page: ' || e.page END AS error
FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN 'page' || (user_id * 7) END AS page FROM events) e LEFT JOIN pages p ON e.page = 'page' || p.page_id
"""
)
def linked_page_left_join(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "error", F.concat(F.lit("page"), F.col("user_id") * 7)).alias("page"))
    linked = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("page"), "page_id").alias("page"), F.col("page_id").cast("string").alias("html"))
    return pages.with_linked_page(events, linked, "page").select("event_id", F.col("linked_html").cast("long").alias("page_id"), "error")


@query("SELECT s_suppkey, u || (1 + i * 2) AS url FROM (SELECT s_suppkey, 'http://site' || s_suppkey || '/list?page=' AS u, unnest(generate_series(0, s_suppkey % 4)) AS i FROM supplier)")
def page_list_urls(spark, sf_dir):
    url = F.concat(F.lit("http://site"), "s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.lit("/list?page={index}")).otherwise(F.lit("/list?page=")))
    pages_of = (F.col("s_suppkey") % 4 + 1).cast("int")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(pages.page_list(url, F.lit(1), F.lit(2), pages_of)).alias("url"))


@query(
    """
WITH t AS (SELECT conv_id, min(turn) AS first FROM conversations GROUP BY 1)
SELECT c.conv_id, coalesce(nullif(s.role, ''), c.role) AS role, trim(concat_ws(' ', c.text, s.text)) AS text
FROM conversations c JOIN t ON c.conv_id = t.conv_id AND c.turn = t.first LEFT JOIN conversations s ON s.conv_id = c.conv_id AND s.turn > t.first
"""
)
def sub_events_exploded(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("first"))
    ranked = turns.join(first, "conv_id")
    heads = ranked.where("turn = first").select("conv_id", "role", "text")
    subs = ranked.where("turn > first").groupBy("conv_id").agg(F.collect_list(F.struct("role", "text")).alias("subs"))
    return pages.sub_events(heads.join(subs, "conv_id", "left"), F.col("subs"), ("role",), ("text",)).select("conv_id", "role", "text")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'div.' || replace(p_name, ' ', '-') || '>ul' WHEN 1 THEN '' WHEN 2 THEN p_type || '>' || p_name ELSE 'body' END AS prefix FROM part")
def subevent_common_prefix(spark, sf_dir):
    k = F.col("p_partkey") % 4
    top = F.concat(F.lit("div."), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit(">ul"))
    paths = (
        F.when(k == 0, F.array(F.concat(top, F.lit(">li:eq(0)")), F.concat(top, F.lit(">li:eq(1)>b")), F.concat(top, F.lit(">li:eq(1)"))))
        .when(k == 1, F.array(F.lit("a"), F.lit("b>c")))
        .when(k == 2, F.array(F.concat_ws(">", "p_type", "p_name")))
        .otherwise(F.array(F.lit("body>p"), F.lit("body")))
    )
    return table(spark, sf_dir, "part").select("p_partkey", pages.common_prefix(paths).alias("prefix"))


@query("SELECT c_custkey, CASE WHEN len(l) > 3 THEN array_to_string(l[1:3], ', ') || '...(' || len(l) || ' elements)' ELSE array_to_string(l, ', ') END AS shown FROM (SELECT o_custkey AS c_custkey, list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey) AS l FROM orders GROUP BY 1)")
def first_three_and_count(spark, sf_dir):
    return stats.first_and_count(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", "o_orderkey")


@query()
def html_nodes(spark, sf_dir):
    from ..functions import html

    html.register(spark)
    table(spark, sf_dir, "pages").createOrReplaceTempView("agendaflow_pages")
    return spark.sql("SELECT p.page_id, n.node_id, n.parent_id, n.depth, n.tag, array_join(n.classes, ' ') AS classes, n.sib_index FROM agendaflow_pages p, LATERAL html_nodes(p.html) n")


@query(
    """
WITH p AS (SELECT page_id, coalesce(regexp_extract(html, '<nav><ul>([\\s\\S]*?)</ul></nav>', 1), '') AS nav FROM pages),
a AS (SELECT page_id, regexp_extract_all(nav, '<a href="([^"]*)"', 1) AS h, regexp_extract_all(nav, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS t FROM p)
SELECT page_id, i - 1 AS pos, h[i] AS href, t[i] AS text FROM (SELECT page_id, h, t, unnest(generate_series(1, len(h))) AS i FROM a)
"""
)
def html_nodes_links(spark, sf_dir):
    """The links of each page's menu, whose list items have lost their end tags, from the node table."""
    from ..functions import html

    html.register(spark)
    table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", "</li>|</nav>", "").alias("html")).createOrReplaceTempView("agendaflow_open_pages")
    nodes = spark.sql("SELECT p.page_id, n.* FROM agendaflow_open_pages p, LATERAL html_nodes(p.html) n")
    item = nodes.where("tag = 'li'").select("page_id", F.col("node_id").alias("parent_id"), F.col("sib_index").cast("long").alias("pos"))
    links = nodes.where("tag = 'a'").join(item, ["page_id", "parent_id"])
    return links.select("page_id", "pos", "href", "text")


@query(
    """
WITH a AS (SELECT page_id, page_id % 28 + 1 AS d, page_id % 12 + 1 AS m, regexp_extract(url, '^https?://[^/:]+') || '/page/' || page_id * 2 AS link FROM pages WHERE contains(html, '<article>'))
SELECT CAST(page_id AS VARCHAR) AS venue_id, 0 AS block_no, d || '.' || m || '.2026 à 20h' AS "eventDate", link AS "eventURL", epoch_ms(timezone('UTC', timezone('Europe/Paris', make_timestamp(2026, m, d, 20, 0, 0)))) AS "unixDate",
  true AS "hasStartTime", CAST(1 AS INTEGER) AS n_possibilities, CASE WHEN page_id % 3 = 0 THEN 'no linked page: ' || link END AS "errorLog" FROM a
"""
)
def extracted_events(spark, sf_dir):
    """Each page's articles, which begin with a date; the linked page of an article is the page of its first
    link's number, if there is one, and every date is read."""
    from ..operators import extract

    paths = lambda *p: F.array(*map(F.lit, p))
    recipe = F.create_map(F.lit("eventName"), paths("h1"), F.lit("eventDate"), paths("p:eq(0)"), F.lit("eventURL"), paths(""))
    linked = F.create_map(F.lit("eventStyle"), paths("html>body>div.ad"), F.lit("eventPlace"), paths("html>head>title"))
    pages_ = table(spark, sf_dir, "pages")
    date = F.concat(F.lit("<article><p>"), F.col("page_id") % 28 + 1, F.lit("."), F.col("page_id") % 12 + 1, F.lit(".2026 à 20h</p>"))
    venues = pages_.select(F.col("page_id").cast("string").alias("id"), "url", F.lit("article").alias("delimiter"), recipe.alias("mainPage"), linked.alias("linkedPage"))
    stored = pages_.select(F.col("page_id").cast("string").alias("venue_id"), F.lit(0).alias("page_no"), F.concat(F.lit("<a href=\"/page/"), F.col("page_id") * 2, F.lit("\">"), F.replace("html", F.lit("<article>"), date), F.lit("</a>")).alias("html"))
    own = text.make_url(F.concat(F.lit("/page/"), F.col("page_id") * 2), text.base_url(F.col("url")))
    others = pages_.where("page_id % 3 > 0").select(own.alias("url"), "html").dropDuplicates(["url"])
    events = extract.events_of(extract.blocks_of(stored, venues), others, ["annulé"])
    form = F.array(F.struct(paths("day", "month", "year").alias("order"), F.lit("numeric").alias("month"), F.lit("long").alias("year")))
    dated = extract.dated_by(events, form, F.lit("2025-12-01").cast("date"), F.lit("Europe/Paris"), F.lit("french"))
    return dated.select("venue_id", "block_no", "eventDate", "eventURL", "unixDate", "hasStartTime", "n_possibilities", "errorLog")


_MENU = """
WITH p AS (SELECT page_id, coalesce(regexp_extract(html, '<nav><ul>([\\s\\S]*?)</ul></nav>', 1), '') AS nav FROM pages),
a AS (SELECT page_id, regexp_extract_all(nav, '<a href="([^"]*)"', 1) AS h, regexp_extract_all(nav, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS t FROM p)
"""


@query(_MENU + "SELECT DISTINCT page_id, 'http://site' || h[i] AS link FROM (SELECT page_id, h, unnest(generate_series(1, len(h))) AS i FROM a)")
def recipe_links_of_pages(spark, sf_dir):
    """The addresses that the menu entries of each page lead to by its recipe."""
    from ..operators import extract

    stored = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("venue_id"), F.lit(0).alias("page_no"), "html")
    recipe = F.create_map(F.lit("eventURL"), F.array(F.lit("a")))
    venues = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.lit("http://site/list").alias("url"), F.lit("nav>ul>li").alias("delimiter"), recipe.alias("mainPage"))
    return extract.links_to_download(stored, venues).select(F.col("venue_id").cast("long").alias("page_id"), "link")


@query("SELECT page_id, 'li.item' AS delimiter, CAST(3 AS INTEGER) AS events, 'h3.t' AS name, 'p.d' AS date FROM pages")
def induced_recipes(spark, sf_dir):
    """Recipes from the sample strings of one event of each site; the first event has a class of its own."""
    from ..functions.html import analyse_pages

    k = F.col("page_id").cast("string")
    item = lambda i, more: F.concat(F.lit(f'<li class="item{more}"><a href="/e{i}"><h3 class="t">Name {i} '), k, F.lit(f'</h3></a><p class="d">{i + 1} mai 2025</p>'))
    html = F.concat(F.lit("<ul>"), item(0, " first"), item(1, ""), item(2, ""), F.lit("</ul><p>end</p>"))
    samples = F.create_map(F.lit("eventName"), F.array(F.concat(F.lit("Name 0 "), k)), F.lit("eventDate"), F.array(F.lit("1 mai 2025")))
    found = table(spark, sf_dir, "pages").select("page_id", analyse_pages(html, samples, F.lit(True)).alias("r"))
    last = lambda key: F.element_at(F.split(F.col("r.mainPage")[key][0], ">"), -1)
    return found.select("page_id", "r.delimiter", "r.events", last("eventName").alias("name"), last("eventDate").alias("date"))


_NUMBERED = """
WITH e AS (SELECT c_nationkey AS venue, o_custkey AS block_no, o_orderkey AS sub_no, CASE WHEN o_orderstatus <> 'F' THEN 'http://x/' || o_orderkey END AS url FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'),
n AS (SELECT venue, block_no, sub_no, url, count(*) OVER (PARTITION BY venue, block_no) AS subs, row_number() OVER (PARTITION BY venue, block_no ORDER BY sub_no) - 1 AS sub,
  dense_rank() OVER (PARTITION BY venue ORDER BY block_no) - 1 AS event_no, CASE WHEN url IS NOT NULL THEN count(url) OVER (PARTITION BY venue ORDER BY block_no, sub_no ROWS UNBOUNDED PRECEDING) - 1 END AS linked_no FROM e)
SELECT venue, block_no, sub_no, event_no, CASE WHEN subs > 1 THEN event_no || '.' || sub ELSE CAST(event_no AS VARCHAR) END AS key, linked_no FROM n
"""


@query(_NUMBERED)
def numbered_events(spark, sf_dir):
    """A customer is a block, an order a sub-event; orders in progress are empty, finished ones have no page."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(
        F.col("c_nationkey").alias("venue"), F.lit(0).alias("page_no"), F.col("o_custkey").alias("block_no"), F.col("o_orderkey").alias("sub_no"), "o_orderstatus",
        F.when(F.col("o_orderstatus") != "F", F.concat(F.lit("http://x/"), "o_orderkey")).alias("url"),
    )
    return pages.events_map(rows, "venue", "url", F.col("o_orderstatus") == "P").select("venue", "block_no", "sub_no", "event_no", "key", "linked_no")


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN 'gone' ELSE 'new' END AS change FROM lineitem WHERE l_returnflag IN ('R', 'A')")
def changed_events(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    before = items.where("l_returnflag IN ('R', 'N')")
    after = items.where("l_returnflag IN ('A', 'N')")
    return pages.changed_events(before, after).drop("l_returnflag")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 1 THEN 'http://x/' || conv_id || '/' || turn END AS link FROM conversations")
def links_of_blocks(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("block_no"))
    links = turns.where("block_no % 2 = 1").withColumn("link", F.concat(F.lit("http://x/"), "conv_id", F.lit("/"), "block_no"))
    return pages.with_block_links(turns, links.unionByName(links), "conv_id").select("conv_id", F.col("block_no").alias("turn"), "link")


@query(_MENU + "SELECT page_id, h[i] AS href FROM (SELECT page_id, h, unnest(generate_series(1, len(h))) AS i FROM a)")
def nodes_by_path(spark, sf_dir):
    """The menu's links of each page by joins over its elements."""
    from ..operators import nodes

    table_ = written(nodes.page_nodes(table(spark, sf_dir, "pages").select("page_id", "html")), "page-nodes")
    found = nodes.select_path(table_, "nav>ul>li>a", "page_id")
    return found.select("page_id", "href")


@query(_MENU + "SELECT page_id, i - 1 AS block_no, t[i] AS \"eventName\" FROM (SELECT page_id, t, unnest(generate_series(1, len(t))) AS i FROM a)")
def fields_by_joins(spark, sf_dir):
    """Each menu entry as a block, its name by joins inside it."""
    from ..operators import nodes

    # read five times below: pages are parsed once
    table_ = written(nodes.page_nodes(table(spark, sf_dir, "pages").select("page_id", "html")), "page-nodes")
    found = nodes.blocks_and_fields(table_, "nav>ul>li", {"eventName": "a"}, "page_id")
    return found.select("page_id", F.col("block_no").cast("long").alias("block_no"), "eventName")


@query(_MENU + "SELECT page_id, i - 1 AS block_no, t[i] AS \"eventName\", h[i] AS \"eventURL\" FROM (SELECT page_id, t, h, unnest(generate_series(1, len(t))) AS i FROM a)")
def blocks_with_links(spark, sf_dir):
    """Each menu entry's link as a block: its own text, and the address that it has itself."""
    from ..operators import nodes

    table_ = written(nodes.page_nodes(table(spark, sf_dir, "pages").select("page_id", "html")), "page-nodes")
    found = nodes.blocks_and_fields(table_, "nav>ul>li", {"eventName": ["a:eq(0)", "table"], "eventURL": "a:eq(0)"}, "page_id")
    return found.select("page_id", F.col("block_no").cast("long").alias("block_no"), "eventName", "eventURL")


def _written_nodes(spark, sf_dir, html=None):
    from ..operators import nodes

    pages_ = table(spark, sf_dir, "pages")
    return written(nodes.page_nodes(pages_.select("page_id", (F.col("html") if html is None else html).alias("html"))), "page-nodes")


@query(_MENU + "SELECT page_id, CASE WHEN len(h) > 1 THEN 'html>body>nav>ul>li:eq(' || (i - 1) || ')>a' ELSE 'html>body>nav>ul>li>a' END AS path, h[i] AS href FROM (SELECT page_id, h, unnest(generate_series(1, len(h))) AS i FROM a)")
def paths_of_links(spark, sf_dir):
    """The whole path of each menu link."""
    from ..operators import induction, nodes

    table_ = _written_nodes(spark, sf_dir)
    hits = nodes.select_path(table_, "nav>ul>li>a", "page_id").select("page_id", "node_id", "href")
    found = induction.paths_of(table_, hits.withColumn("top_id", F.lit(-1)), "page_id")
    return hits.join(found, ["page_id", "node_id"]).select("page_id", "path", "href")


@query(_MENU + "SELECT page_id, t[i] AS text FROM (SELECT page_id, t, unnest(generate_series(1, len(t))) AS i FROM a)")
def leaves_of_lists(spark, sf_dir):
    """The lowest elements with text, of those the list items."""
    from ..operators import induction

    found = induction.leaf_elements(_written_nodes(spark, sf_dir), "page_id")
    return found.where("tag = 'li'").select("page_id", "text")


@query(_MENU + "SELECT page_id, CASE WHEN len(h) > 1 THEN 'ul' ELSE 'a' END AS tag FROM a WHERE len(h) > 0")
def common_element_of_links(spark, sf_dir):
    """The deepest element around all links of each page's menu."""
    from ..operators import induction, nodes

    table_ = _written_nodes(spark, sf_dir)
    tops = induction.common_ancestors(table_, nodes.select_path(table_, "nav>ul>li>a", "page_id"), [], "page_id")
    return tops.join(table_.select("page_id", F.col("node_id").alias("top_id"), "tag"), ["page_id", "top_id"]).select("page_id", "tag")


_ENTRY = '<li class="item"><a href="$1">№$2¶</a><p class="d">'


@query(_MENU + "SELECT page_id, 'li.item' AS delimiter, 'a' AS name, 'p.d' AS date, CAST(len(list_distinct(t)) AS BIGINT) AS events, CAST(len(h) AS INTEGER) AS n_dates FROM a WHERE len(h) > 0")
def recipes_from_pages(spark, sf_dir):
    """A recipe for each page from its first menu entry, whose entries have got a date and a class."""
    from ..operators import induction, nodes

    date = F.concat(F.col("page_id") % 28 + 1, F.lit(" mai"))
    menu = F.regexp_extract("html", r"<nav><ul>([\s\S]*?)</ul></nav>", 1)
    entry = F.concat(F.lit(_ENTRY), date, F.lit("</p></li>"))
    html = F.replace("html", menu, F.regexp_replace(menu, F.lit('<li><a href="([^"]*)">([^<]*)</a></li>'), entry))
    first = F.nullif(F.regexp_extract(menu, '<li><a href="[^"]*">([^<]*)</a></li>', 1), F.lit(""))
    shown = F.replace(F.concat(F.lit("№"), first, F.lit("¶")), F.lit("&amp;"), F.lit("&"))
    keyed = F.explode(F.create_map(F.lit("eventName"), F.array(shown), F.lit("eventDate"), F.array(date))).alias("key", "strings")
    samples = table(spark, sf_dir, "pages").where(first.isNotNull()).select("page_id", keyed)
    with temporary(spark):
        # markup is moved, once, before it is parsed: its elements hold each text once for every level
        moved = table(spark, sf_dir, "pages").select("page_id", html.alias("html")).repartition(parts(spark), "page_id")
        found = induction.induce(dealt(nodes.page_nodes(moved), "page-nodes", "page_id", there=True), samples, "page_id")
    one = lambda key: F.array_join(F.col("main_page")[key], " ")
    return found.select("page_id", "delimiter", one("eventName").alias("name"), one("eventDate").alias("date"), "events", F.size("dates").alias("n_dates"))
