"""Edits of the country, city and language registries as new tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def add_name(registry: DataFrame, name: str, row: dict) -> DataFrame:
    """The registry with one more row, unless a name like it, letter case aside, is there."""
    new = registry.sparkSession.range(1).select(*[F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in registry.schema.fields])
    there = registry.select(F.lower(name).alias("__name"))
    return registry.unionByName(new.join(there, F.lower(new[name]) == F.col("__name"), "left_anti"))


def deletable(registry: DataFrame, key: str, *dependents: DataFrame) -> DataFrame:
    """Rows on which nothing depends."""
    for d in dependents:
        registry = registry.join(d, key, "left_anti")
    return registry


def delete(registry: DataFrame, key: str, values: list, *dependents: DataFrame) -> DataFrame:
    """The registry without the given rows, as far as nothing depends on them."""
    gone = deletable(registry.where(F.col(key).isin(values)), key, *dependents).select(key)
    return registry.join(gone, key, "left_anti")


def change_list(registry: DataFrame, name: str, add: list[str] = (), remove: list[str] = ()) -> DataFrame:
    """An array column with values added once and others removed."""
    both = F.array_distinct(F.concat(F.coalesce(name, F.array().cast("array<string>")), F.array(*[F.lit(x) for x in add]).cast("array<string>")))
    return registry.withColumn(name, F.array_except(both, F.array(*[F.lit(x) for x in remove]).cast("array<string>")))
