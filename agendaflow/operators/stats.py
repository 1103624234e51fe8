"""Counts for charts and choices among candidate values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import written

#: Accented letters that a good name keeps (fixed values).
ACCENTED = "éèêëàâäïîöôûüøæå"


def upcoming_per_place(events: DataFrame, places: DataFrame, after, place: str, time: str) -> DataFrame:
    """Events after a time for each known place, 0 included, and for each unknown one."""
    counts = events.where(F.col(time) > after).groupBy(place).agg(F.count("*").alias("n"))
    return places.select(place).distinct().join(counts, place, "full_outer").select(place, F.coalesce("n", F.lit(0)).alias("n"))


def upcoming_per_style(events: DataFrame, after, style: str, time: str, least: int = 1) -> DataFrame:
    return events.where(F.col(time) > after).groupBy(style).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def per_day(events: DataFrame, day: Column, first: str, last: str) -> DataFrame:
    """Events on every day from first to last, null where there is none."""
    counts = events.groupBy(day.alias("day")).agg(F.count("*").alias("n"))
    days = events.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    return days.join(counts, "day", "left")


def most_frequent(df: DataFrame, group: str, value: str) -> DataFrame:
    """The values that a group has most often, all of them on a tie."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(group))
    return counts.withColumn("__most", most).where("n = __most").drop("__most")


def best_name_order(name: Column, seq: Column) -> Column:
    """Sorts the best name first: longest, most accents, most even case of the letters A to Z, first."""
    accents = F.length(F.regexp_replace(F.lower(name), f"[^{ACCENTED}]", ""))
    upper = F.length(F.regexp_replace(name, "[^A-Z]", ""))
    lower = F.length(F.regexp_replace(name, "[^a-z]", ""))
    return F.struct(-F.length(name), -accents, F.abs(1 + upper - lower), seq)


def best_name(df: DataFrame, group: str, name: str, seq: str) -> DataFrame:
    return df.groupBy(group).agg(F.min_by(name, best_name_order(F.col(name), F.col(seq))).alias(name))


def best_style(df: DataFrame, group: str, style: str, seq: str, reference: Sequence[str]) -> DataFrame:
    """The first style that is in the reference list, else the longest."""
    order = F.struct(~F.col(style).isin(list(reference)), F.when(F.col(style).isin(list(reference)), 0).otherwise(-F.length(style)), F.col(seq))
    return df.groupBy(group).agg(F.min_by(style, order).alias(style))


def confirmed_dates(df: DataFrame, group: str, date: str, source: str) -> DataFrame:
    """A group's only date; of several those that a source lists which lists another as well."""
    # pairs are combined first; one shuffle on the group then serves both windows and the last aggregation
    pairs = df.select(group, date, source).distinct().repartition(group)
    own, whole = Window.partitionBy(group, source), Window.partitionBy(group)
    told = pairs.withColumn("__k", F.count("*").over(own))
    told = told.withColumns({"__low": F.min(date).over(whole), "__high": F.max(date).over(whole)})
    return told.where("__k > 1 OR __low = __high").select(group, date).distinct()


def keep_first(df: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*seq)).alias("r")).select(*keys, "r.*")


def tag_class_counts(html: DataFrame, column: str, most: int = 10) -> DataFrame:
    """The most frequent (tag, sorted distinct classes) of a column of markup; a top-k report."""
    found = html.select(F.explode(F.regexp_extract_all(column, F.lit("<([a-zA-Z0-9]+ class=\"[^\"]*)\""), 1)).alias("x"))
    tag = F.lower(F.regexp_extract("x", "^([a-zA-Z0-9]+)", 1))
    classes = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.regexp_extract("x", "class=\"(.*)$", 1), " +"), lambda c: c != ""))), " ")
    return found.groupBy(tag.alias("tag"), classes.alias("classes")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag", "classes").limit(most)


def prefix_sums(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums inside each group, in the order given: each of ``sums`` up to and with the row.

    Rows are dealt by ranges of group and order, so a group of any size lies in many tasks. Each task sums its
    own stretch; the stretches' totals, a row for each group and task, are summed again and added. Rows are
    written once between, which fixes where the ranges end. Equal rows share no task with others only by
    chance: ``order`` has to tell rows apart, and ascends (negate a number to count down).
    """
    keys = [F.col(c) for c in group]
    own = {f"__sum{k}": c for k, c in enumerate(sums.values())}
    sort = {f"__order{k}": F.col(c) if isinstance(c, str) else c for k, c in enumerate(order)}
    rows = df.withColumns({"__group": F.struct(*keys) if keys else F.lit(0), **sort, **{k: F.coalesce(c.cast("long"), F.lit(0)) for k, c in own.items()}})
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(tasks, "__group", *sort).withColumn("__part", F.spark_partition_id())
    stretch = Window.partitionBy("__part", "__group").orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)
    local = written(spread.withColumns({f"__local{k}": F.sum(c).over(stretch) for k, c in enumerate(own)}), "prefix-sums")
    totals = local.groupBy("__group", "__part").agg(*(F.sum(c).alias(c) for c in own))
    before = Window.partitionBy("__group").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__group", "__part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__before{k}") for k, c in enumerate(own)))
    out = local.join(offsets, ["__group", "__part"])
    return out.select(*df.columns, *((F.col(f"__local{k}") + F.col(f"__before{k}")).alias(name) for k, name in enumerate(sums)))


def running_number(df: DataFrame, group: Sequence[str], order: Sequence[str], counts: Column, name: str) -> DataFrame:
    """A running count of the rows for which ``counts`` is true, inside each group."""
    return prefix_sums(df, group, order, {name: counts})


def placed(df: DataFrame, order: Sequence[Column | str], name: str = "place") -> DataFrame:
    """``df`` with each row's place in an order of all rows, from 1."""
    return prefix_sums(df, [], order, {name: F.lit(1)})


def in_order(df: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    """Whether each value is at least the one before it in its group."""
    before = F.lag(value).over(Window.partitionBy(group).orderBy(*order))
    return df.select(group, *order, F.coalesce(F.col(value) >= before, F.lit(True)).alias("ordered"))


def sorted_counts(counts: DataFrame, n: str, seq: str) -> DataFrame:
    """Counts by falling number, equal ones in the order of ``seq``."""
    return counts.orderBy(F.desc(n), seq)


def sorted_names(df: DataFrame, name: str, seq: str) -> DataFrame:
    """Names as a reader would sort them: letter case and accents aside, equal ones in the order of ``seq``."""
    return df.orderBy(F.collate(name, "UNICODE_CI_AI"), seq)


def first_and_count(df: DataFrame, group: str, value: str, most: int = 3) -> DataFrame:
    """``group`` and ``shown``: the ``most`` smallest values, joined by commas, followed by ``...(n elements)`` if there
    are more. Only so many values of a group are kept, from the map side on, and counted apart."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(value))
    first = df.select(group, value).withColumn("__n", place).where(F.col("__n") <= most).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("__n", F.col(value).cast("string").alias("v")))).alias("l"))
    counts = df.groupBy(group).agg(F.count(value).alias("__count"))
    shown = F.array_join(F.transform("l", lambda x: x["v"]), ", ")
    more = F.concat(shown, F.lit("...("), F.col("__count"), F.lit(" elements)"))
    return first.join(counts, group).select(group, F.when(F.col("__count") > most, more).otherwise(shown).alias("shown"))
