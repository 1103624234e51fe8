"""Joins of events with places, venues, zones and dictionaries; nations and customers stand for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages, places
from .registry import query, sql_simplify, table

_P = "SELECT n_name AS title, arg_max(CAST(n_regionkey AS DOUBLE), n_nationkey) AS longitude, arg_max(CAST(n_nationkey AS DOUBLE), n_nationkey) AS latitude FROM nation WHERE n_nationkey % 3 <> 0 GROUP BY 1"


def _events(spark, sf_dir):
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return customer.join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("place"))


def _places(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0")
    return nation.select(F.col("n_name").alias("title"), F.col("n_regionkey").cast("double").alias("longitude"), F.col("n_nationkey").cast("double").alias("latitude"), F.col("n_nationkey").alias("seq"))


@query(
    f"""
SELECT c_custkey, n_name AS place, coalesce(longitude, 0) AS longitude, coalesce(latitude, 0) AS latitude, longitude IS NOT NULL AS known
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN ({_P}) p ON p.title = n_name
"""
)
def place_coords_left_join_default(spark, sf_dir):
    return places.with_coordinates(_events(spark, sf_dir), _places(spark, sf_dir))


@query("SELECT n_name AS place, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 3 = 0 GROUP BY 1")
def unknown_places(spark, sf_dir):
    missed = _events(spark, sf_dir).join(_places(spark, sf_dir), F.col("place") == F.col("title"), "left_anti")
    return missed.groupBy("place").agg(F.count("*").alias("n"))


def _venues(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    other = F.array(F.concat(F.left("n_name", F.lit(2)), F.lit(" - X")))
    return n.select(F.col("n_nationkey").alias("seq"), F.col("n_name").alias("name"), F.lit("Lyon").alias("city"), F.lit("France").alias("country"), other.alias("aliases"))


_ALIAS = f"""
WITH v AS (SELECT n_nationkey AS seq, n_name AS name, unnest([n_name, left(n_name, 2) || ' - X']) AS alias FROM nation),
k AS (SELECT {sql_simplify('alias')} AS key, arg_max(name, seq) AS venue FROM v GROUP BY 1),
e AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN lower(n_name) WHEN s_suppkey % 3 = 0 THEN s_name ELSE left(n_name, 2) || ' x' END AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey)
"""


@query(f"{_ALIAS} SELECT s_suppkey, coalesce(k.venue, e.place) AS place FROM e LEFT JOIN k ON k.key = {sql_simplify('e.place')}")
def alias_resolution_last_wins(spark, sf_dir):
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    place = F.when(F.col("s_suppkey") % 2 == 0, F.lower("n_name")).when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).otherwise(F.concat(F.left("n_name", F.lit(2)), F.lit(" x")))
    events = joined.select("s_suppkey", place.alias("place"), F.lit("Lyon").alias("city"), F.lit("France").alias("country"))
    return places.resolve_places(events, _venues(spark, sf_dir)).select("s_suppkey", "place")


@query(
    f"""
WITH a AS (SELECT {sql_simplify('n_name')} AS key, arg_min('http://' || n_nationkey, n_nationkey) AS url FROM nation WHERE n_nationkey % 2 = 0 GROUP BY 1)
SELECT c_custkey, coalesce(a.url, 'http://old/' || c_custkey) AS "eventURL", CASE WHEN a.url IS NOT NULL THEN 'http://old/' || c_custkey || ',' || a.url END AS "altURLs"
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN a ON a.key = {sql_simplify('n_name')}
"""
)
def alias_url_fix(spark, sf_dir):
    events = _events(spark, sf_dir).select("c_custkey", "place", F.lit("Lyon").alias("city"), F.lit("France").alias("country"), F.concat(F.lit("http://old/"), "c_custkey").alias("eventURL"), F.lit(None).cast("array<string>").alias("altURLs"))
    venues = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("seq"), F.col("n_name").alias("name"), F.lit("Lyon").alias("city"), F.lit("France").alias("country"), F.concat(F.lit("http://"), "n_nationkey").alias("url"))
    return places.fix_alias_urls(events, venues).select("c_custkey", "eventURL", F.array_join("altURLs", ",").alias("altURLs"))


@query(
    """
SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END, ''), CASE WHEN n_nationkey % 2 = 0 THEN n_name END, CASE WHEN r_regionkey % 2 = 0 THEN r_name END, 'Live') AS style
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""
)
def default_style_chain(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    own = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise("")
    style = places.style_chain(own, F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")), F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name")))
    return rows.select("c_custkey", style.alias("style"))


@query(
    """
SELECT r_name AS country, array_to_string(list(DISTINCT c_mktsegment ORDER BY c_mktsegment), ',') AS styles
FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1
"""
)
def country_styles(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    spoken = nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("languages"))
    countries = table(spark, sf_dir, "region").join(spoken, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("r_name").alias("country"), "languages")
    customer = table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment").distinct()
    dictionary = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("language"), F.col("c_mktsegment").alias("style"), F.col("c_mktsegment").alias("ord"))
    out = places.country_styles(countries, dictionary)
    return out.select("country", F.array_join(F.array_sort("styles"), ",").alias("styles"))


@query(
    """
SELECT c_custkey, coalesce(CASE WHEN c_mktsegment = 'BUILDING' AND n_nationkey % 2 = 0 THEN 'city-' || n_name END, CASE WHEN n_nationkey % 3 = 0 THEN 'country-' || n_name END) AS tz
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
)
def timezone_two_level(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_mktsegment").alias("city"), F.col("n_name").alias("country"))
    city = nation.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("country"), F.lit("BUILDING").alias("city"), F.concat(F.lit("city-"), "n_name").alias("tz"))
    country = nation.where("n_nationkey % 3 = 0").select(F.col("n_name").alias("country"), F.lit(None).cast("string").alias("city"), F.concat(F.lit("country-"), "n_name").alias("tz"))
    return places.zones(rows, city.unionByName(country)).select("c_custkey", "tz")


_KEY = "l_orderkey, l_partkey, l_suppkey"


@query(f"SELECT l_orderkey, l_linenumber, ({_KEY}) IN (SELECT {_KEY} FROM lineitem WHERE l_returnflag = 'R') AS detected FROM lineitem")
def iframe_composite_semi_anti(spark, sf_dir):
    keys = ["l_orderkey", "l_partkey", "l_suppkey"]
    items = table(spark, sf_dir, "lineitem")
    return pages.detected(items.select(*keys, "l_linenumber"), items.where("l_returnflag = 'R'"), *keys).select("l_orderkey", "l_linenumber", "detected")


@query("SELECT DISTINCT c_nationkey AS language FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('EUROPE', 'AMERICA'))")
def languages_without_dictionary(spark, sf_dir):
    """Customers' nations, of which those of two regions have a dictionary."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    known = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).where(F.col("r_name").isin("EUROPE", "AMERICA")).select(F.col("n_nationkey").alias("language"))
    return places.languages_without_dictionary(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("language")), known, "language")


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def repair_by_source(spark, sf_dir):
    errors = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return pages.repairs_by_source(errors, table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def deletable_cities(spark, sf_dir):
    """Orders on which no returned item depends, of customers without debts."""
    from ..operators.registry import deletable

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    free = deletable(orders, "o_orderkey", table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")))
    return deletable(free, "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))).select("o_orderkey")


@query("SELECT n_regionkey, n_name FROM nation UNION SELECT 0, 'Atlantis'")
def add_city_once(spark, sf_dir):
    from ..operators.registry import add_name

    nation = table(spark, sf_dir, "nation").select("n_regionkey", "n_name")
    once = add_name(nation, "n_name", {"n_regionkey": 0, "n_name": "Atlantis"})
    return add_name(once, "n_name", {"n_regionkey": 1, "n_name": "aTLANTIS"})


_ALIASED = """SELECT s_suppkey, s_nationkey AS city, unnest([s_name, left(s_name, 8) || ' ' || (s_suppkey % 7)]) AS alias FROM supplier"""


@query(f"SELECT s_suppkey, count(*) AS n FROM (SELECT * FROM ({_ALIASED}) QUALIFY count(*) OVER (PARTITION BY city, {sql_simplify('alias')}) = 1) GROUP BY 1")
def unique_aliases(spark, sf_dir):
    """How many names of each venue no other venue of its city has."""
    names = F.array("s_name", F.concat_ws(" ", F.left("s_name", F.lit(8)), F.col("s_suppkey") % 7))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("city"), names.alias("names"))
    return places.unique_names(rows, "s_suppkey", "city", "names")


@query(
    f"""
WITH p AS (SELECT n_name AS title, arg_max('http://' || n_nationkey, n_nationkey) AS url FROM nation WHERE n_nationkey % 3 <> 0 GROUP BY 1)
SELECT c_custkey, n_name AS place, p.url FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN p ON p.title = n_name
"""
)
def place_addresses(spark, sf_dir):
    known = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_name").alias("title"), F.concat(F.lit("http://"), "n_nationkey").alias("url"), F.col("n_nationkey").alias("seq"))
    return places.with_addresses(_events(spark, sf_dir), known)


@query(
    f"""
WITH d AS (SELECT {sql_simplify('n_name')} AS key, n_regionkey, arg_min('style ' || n_nationkey, n_nationkey) AS style FROM nation WHERE n_nationkey % 4 <> 1 GROUP BY ALL)
SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE '' END, ''), d.style, CASE WHEN nation.n_regionkey % 2 = 0 THEN 'site' END, 'Live') AS style
FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN d ON d.key = {sql_simplify('n_name')} AND d.n_regionkey = nation.n_regionkey
"""
)
def default_style_of_place(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.upper("n_name").alias("place"), F.col("n_regionkey").alias("city"), F.lit("x").alias("country"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise("").alias("style"), F.when(F.col("n_regionkey") % 2 == 0, "site").alias("siteStyle")
    )
    venues = nation.where("n_nationkey % 4 <> 1").select(F.col("n_nationkey").alias("seq"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("city"), F.lit("x").alias("country"), F.concat(F.lit("style "), "n_nationkey").alias("defaultStyle"))
    return places.with_default_style(rows, venues).select("c_custkey", "style")


@query(f"SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND {sql_simplify('a.s_name')} <> {sql_simplify('b.s_name')}")
def same_city_venues(spark, sf_dir):
    """All pairs of venues of one city that have different names."""
    return places.same_city_pairs(table(spark, sf_dir, "supplier"), "s_suppkey", "s_nationkey", "s_name")


@query(
    """
WITH v AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN 'http://x' END AS url, c_custkey % 4 <> 0 AS page, c_custkey % 6 <> 0 AS files, c_custkey % 7 <> 0 AS delimiter, c_custkey % 3 AS k FROM customer)
SELECT c_custkey, url IS NOT NULL AND page AS active, CASE WHEN url IS NULL THEN 'no url' WHEN NOT files THEN 'no files' WHEN NOT delimiter THEN 'no delimiter' WHEN NOT page THEN 'no main page' WHEN k = 0 THEN 'no name key' WHEN k = 1 THEN 'no date key' END AS reason FROM v
"""
)
def venue_checks(spark, sf_dir):
    from ..operators import filters

    k = F.col("c_custkey")
    paths = F.array(F.lit("p"))
    page = F.when(k % 3 == 0, F.create_map(F.lit("eventDate"), paths)).when(k % 3 == 1, F.create_map(F.lit("eventName"), paths)).otherwise(F.create_map(F.lit("eventMultiName"), paths))
    linked = F.when(k % 3 == 2, F.create_map(F.lit("eventDate"), paths))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 5 != 0, "http://x").alias("url"), F.when(k % 7 != 0, "div").alias("eventsDelimiterTag"), F.when(k % 4 != 0, page).alias("mainPage"), linked.alias("linkedPage"))
    out = filters.reject_reason(rows, F.col("c_custkey") % 6 != 0)
    return out.select("c_custkey", filters.is_active(F.col("url"), F.col("mainPage")).alias("active"), F.col("reject_reason").alias("reason"))


@query(f"SELECT c_custkey FROM customer WHERE {sql_simplify('c_name')} IN (SELECT {sql_simplify('s_name')} FROM supplier) OR {sql_simplify('c_name')} = 'customer 000000007'")
def venue_lookup(spark, sf_dir):
    from ..operators import filters

    venues = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("id"))
    return filters.find_venue(venues, "CUSTOMER 000000007").select("c_custkey")


@query(
    f"""
WITH c AS (SELECT c_custkey, 'Place ' || (c_custkey % 9) AS name, c_nationkey AS city FROM customer), s AS (SELECT s_suppkey, 'PLACE-' || (s_suppkey % 9) AS name, s_nationkey AS city FROM supplier),
p AS (SELECT {sql_simplify('name')} AS key, city, min(s_suppkey) AS s_suppkey, count(*) AS n FROM s GROUP BY ALL)
SELECT c_custkey, s_suppkey, coalesce(n, 0) AS n FROM c LEFT JOIN p ON p.city = c.city AND p.key = {sql_simplify('c.name')}
"""
)
def same_places(spark, sf_dir):
    """For each customer's place the first of the suppliers' places that are the same, and their number."""
    from ..operators import filters

    place = lambda df, key, name, city: table(spark, sf_dir, df).select(key, F.concat(F.lit(name), F.col(key) % 9).alias("name"), F.col(city).alias("city"), F.lit("x").alias("country"))
    return filters.same_places(place("customer", "c_custkey", "Place ", "c_nationkey"), place("supplier", "s_suppkey", "PLACE-", "s_nationkey"), "c_custkey", "s_suppkey")
