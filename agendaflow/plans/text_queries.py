"""String functions over documents, parts and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import filters, places
from .registry import query, sql_simplify, table


@query(f"SELECT doc_id, {sql_simplify('text')} AS simplified FROM documents")
def simplify_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.simplify(F.col("text")).alias("simplified"))


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def strip_accents_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_accents(F.col("text")).alias("plain"))


@query(
    f"""
SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE {sql_simplify('n_name')} = {sql_simplify("'Nation_7 '")} AND {sql_simplify('c_mktsegment')} = {sql_simplify("'Building'")}
"""
)
def venue_selection_wildcards(spark, sf_dir):
    venues = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    venues = venues.select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("city"), F.col("n_name").alias("country"))
    return filters.select_venues(venues, "*", "Building", "Nation_7 ").select("c_custkey")


@query("WITH p AS (SELECT unnest(['Customer#0000000012', 'Customer#000000001', 'Nobody']) AS prefix) SELECT prefix, min(c_name) AS id, count(*) AS n, count(*) = 1 AS \"unique\" FROM customer JOIN p ON starts_with(c_name, prefix) GROUP BY 1")
def venue_id_prefix(spark, sf_dir):
    venues = table(spark, sf_dir, "customer").select(F.col("c_name").alias("id"))
    found = [filters.by_id_prefix(venues, p).select(F.lit(p).alias("prefix"), "id", "n", "unique") for p in ("Customer#0000000012", "Customer#000000001", "Nobody")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(f"SELECT doc_id FROM documents WHERE contains({sql_simplify('text')}, 'queeau') OR contains({sql_simplify('text')}, 'elle est')")
def cancelled_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(filters.is_cancelled(F.col("text"), ["Quéeau", "Elle-est"])).select("doc_id")


@query(
    f"""
SELECT p_partkey, coalesce(CASE WHEN contains(s, 'red') THEN 'Warm' END, CASE WHEN contains(s, 'blue') THEN 'Cold' END, CASE WHEN contains(s, 'part 1') THEN 'First' END, p_name) AS style
FROM (SELECT p_partkey, p_name, {sql_simplify('p_name')} AS s FROM part)
"""
)
def style_dictionary_contains(spark, sf_dir):
    words = [("First", "Part-1"), ("Cold", "blue"), ("Warm", "réd")]
    return table(spark, sf_dir, "part").select("p_partkey", places.style_by_dictionary(F.col("p_name"), words).alias("style"))


@query("SELECT p_partkey, upper(CASE WHEN length(p_type || ' ' || p_name) > 30 THEN substr(p_type || ' ' || p_name, 1, 30) || '…' ELSE p_type || ' ' || p_name END) AS label FROM part")
def short_label(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.short_label(F.concat("p_type", F.lit(" "), "p_name")).alias("label"))


@query("SELECT p_partkey, TRY_CAST(nullif(regexp_extract(p_size || ' https://x', '^\\s*([-+]?\\d+(\\.\\d*)?)', 1), '') AS DOUBLE) AS number FROM part")
def prefix_number_parse(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.parse_number(F.concat(F.col("p_size").cast("string"), F.lit(" https://x"))).alias("number"))


@query("SELECT c_custkey, c_name || '|' || c_mktsegment || '|' || c_nationkey AS id, c_name AS name FROM customer")
def make_and_split_id(spark, sf_dir):
    made = text.make_id(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string"))
    return table(spark, sf_dir, "customer").select("c_custkey", made.alias("id"), text.name_of_id(made).alias("name"))


@query("SELECT doc_id, regexp_replace(text, 'en[a-z]', '#', '') AS text FROM documents")
def first_only_replace(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.first_only(F.col("text"), "en[a-z]", "#").alias("text"))


@query(
    """
SELECT p_partkey, trim(regexp_extract(a, '^([^(]*)', 1)) AS style, nullif(trim(regexp_extract(a, '\\(([^)]*)\\)', 1)), '') AS detail
FROM (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type || ' (' || p_brand || ')' ELSE p_type END AS a FROM part)
"""
)
def answer_to_style(spark, sf_dir):
    answer = F.when(F.col("p_size") % 2 == 0, F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")"))).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", text.style_of_answer(answer).alias("a")).select("p_partkey", "a.*")


@query("SELECT conv_id, turn FROM conversations WHERE coalesce(role, '') <> '' AND trim(coalesce(text, '')) <> ''")
def valid_events(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.where(filters.is_valid_event(F.col("role"), F.col("text"), F.lit(True), F.lit(True))).select("conv_id", "turn")


@query(
    f"""
WITH n AS (SELECT n_nationkey, n_regionkey, {sql_simplify('n_name')} AS s FROM nation)
SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM n a JOIN n b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey WHERE contains(a.s, b.s) OR contains(b.s, a.s)
"""
)
def similar_names_in_block(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a, b = n.alias("a"), n.alias("b")
    similar = filters.similar_name(F.col("a.n_name"), F.col("b.n_name"))
    pairs = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")) & similar)
    return pairs.select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"))


@query(
    """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN regexp_extract(p_name, '[0-9]+', 0) ELSE regexp_replace(p_name, 'a[a-z]', '#') END AS field FROM part
"""
)
def field_rules(spark, sf_dir):
    from ..operators.recipes import apply_rule

    k = F.col("p_partkey") % 3
    rule = F.when(k == 1, F.array(F.lit("[0-9]+"))).when(k == 2, F.array(F.lit("a[a-z]"), F.lit("#")))
    return table(spark, sf_dir, "part").select("p_partkey", apply_rule(F.col("p_name"), rule).alias("field"))


@query("SELECT user_id, len(list_intersect(list(DISTINCT event_type) FILTER (event_id % 2 = 0), list(DISTINCT event_type) FILTER (event_id % 2 = 1)))::BIGINT AS common, len(list_filter(list(DISTINCT event_type) FILTER (event_id % 2 = 0), lambda x: NOT list_contains(coalesce(list(DISTINCT event_type) FILTER (event_id % 2 = 1), []), x)))::BIGINT AS new FROM events GROUP BY 1 HAVING count(*) FILTER (event_id % 2 = 0) > 0 AND count(*) FILTER (event_id % 2 = 1) > 0")
def common_and_new_values(spark, sf_dir):
    even = F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type")))
    odd = F.collect_set(F.when(F.col("event_id") % 2 == 1, F.col("event_type")))
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(even.alias("a"), odd.alias("b")).where("size(a) > 0 AND size(b) > 0")
    return rows.select("user_id", F.size(F.array_intersect("a", "b")).cast("long").alias("common"), F.size(F.array_except("a", "b")).cast("long").alias("new"))


@query("SELECT c_custkey, c_acctbal BETWEEN 2024 AND 2028 AS plausible FROM customer")
def plausible_years(spark, sf_dir):
    from ..operators.recipes import plausible_year

    return table(spark, sf_dir, "customer").select("c_custkey", plausible_year(F.col("c_acctbal"), 2025).alias("plausible"))


@query("SELECT s_suppkey, sqrt(s_acctbal * s_acctbal + s_nationkey * s_nationkey) <= 3000 AS hit, (s_acctbal + 360 * round((10 - s_acctbal) / 360)) AS lon FROM supplier")
def circle_and_longitude(spark, sf_dir):
    from ..functions.maps import in_circle, wrap_longitude

    zero = F.lit(0.0)
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", in_circle(F.col("s_acctbal"), F.col("s_nationkey").cast("double"), zero, zero, F.lit(3000.0)).alias("hit"), wrap_longitude(F.col("s_acctbal"), F.lit(10.0)).alias("lon")
    )


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Théâtre' ELSE coalesce(CASE WHEN regexp_matches('xthéâtre', p_name) THEN p_name END, p_name) END AS fixed FROM part")
def fixed_strings(spark, sf_dir):
    candidates = F.array(F.lit("Rock"), F.lit("Théâtre"), F.lit("Théatre"))
    given = F.when(F.col("p_partkey") % 2 == 0, F.lit("Th��tre")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.fix_string(given, candidates).alias("fixed"))


@query("SELECT p_partkey, CASE WHEN p_name LIKE '%ring' THEN trim(left(p_name, length(p_name) - 4)) ELSE p_name END AS cut FROM part")
def endings_removed(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.remove_ending(F.col("p_name"), F.lit("ring")).alias("cut"))


@query("SELECT p_partkey, p_type || ' \\(' || p_name || '\\) (' || p_size || ')' AS escaped FROM part")
def escaped_parentheses(spark, sf_dir):
    given = F.concat("p_type", F.lit(" ("), "p_name", F.lit(") ("), F.col("p_size").cast("string"), F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", text.escape_parentheses(given).alias("escaped"))


@query("SELECT s_suppkey, s_suppkey % 5 AS k, CASE s_suppkey % 5 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'a|b' WHEN 3 THEN 'a b|a c|b c' ELSE 'a b c|a b d|a c d|b c d' END AS left_over FROM supplier")
def class_combinations(spark, sf_dir):
    """What remains when one of k classes goes, in every way."""
    from ..operators.recipes import combinations_without

    classes = F.slice(F.array(*map(F.lit, "abcd")), F.lit(1), (F.col("s_suppkey") % 5).cast("int"))
    rest = combinations_without(classes, 1)
    shown = F.transform(F.filter(rest, lambda x: F.size(x) > 0), lambda x: F.array_join(x, " "))
    return table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 5).alias("k"), F.array_join(F.array_sort(shown), "|").alias("left_over"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'a=1,2;b=3' ELSE 'a=1;c=' END AS merged, CASE WHEN s_suppkey % 3 = 0 THEN 'a,b' ELSE 'a' END AS pruned FROM supplier")
def merged_recipes(spark, sf_dir):
    """Two maps of lists joined key by key, and without the keys of empty lists."""
    from ..operators.recipes import merge_maps, prune

    lists = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    a = F.create_map(F.lit("a"), lists("1"))
    b = F.when(F.col("s_suppkey") % 3 == 0, F.create_map(F.lit("a"), lists("2"), F.lit("b"), lists("3"))).otherwise(F.create_map(F.lit("c"), lists()))
    both = merge_maps(a, b)
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(both), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")))), ";")
    return table(spark, sf_dir, "supplier").select("s_suppkey", shown.alias("merged"), F.array_join(F.array_sort(F.map_keys(prune(both))), ",").alias("pruned"))


@query("SELECT n_nationkey, row_number() OVER (ORDER BY lower(n_name), n_nationkey) AS place FROM nation")
def sorted_names(spark, sf_dir):
    from ..operators.stats import placed

    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return placed(nation, [F.collate("n_name", "UNICODE_CI_AI"), "n_nationkey"]).select("n_nationkey", "place")


@query("SELECT s_suppkey, -s_suppkey % 7 AS plain, ((-s_suppkey % 7) + 7) % 7 AS modulo FROM supplier")
def positive_modulo(spark, sf_dir):
    k = -F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", (k % 7).alias("plain"), F.pmod(k, F.lit(7)).alias("modulo"))


@query("SELECT c_custkey, c_name AS name, CAST(round(c_acctbal, 0) AS DOUBLE) AS latitude, c_mktsegment AS genre, 'Lyon' AS city, c_name AS alias FROM customer")
def legacy_place_lines(spark, sf_dir):
    from ..sources.csv import parse_legacy_line

    line = F.concat_ws(",", "c_name", F.round("c_acctbal", 0).cast("decimal(20,0)").cast("string"), F.lit(" 4.8 x"), F.lit("http://x"), "c_mktsegment")
    rows = table(spark, sf_dir, "customer").select("c_custkey", parse_legacy_line(line, "Lyon").alias("p"))
    return rows.select("c_custkey", "p.name", "p.latitude", "p.genre", "p.city", F.col("p.aliases")[0].alias("alias"))
