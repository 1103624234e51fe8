"""Where queries are registered with the SQL that they equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_simplify(x: str) -> str:
    """The SQL of ``functions.text.simplify``."""
    plain = f"regexp_replace(strip_accents(lower({x})), '[~!@$%^&*()+=\\-,./'';:?><\\[\\]\\\\{{}}|`#]', ' ', 'g')"
    blanks = f"regexp_replace(regexp_replace({plain}, '[\\n\\t]', ' ', 'g'), '\\s{{2,}}', ' ', 'g')"
    return f"regexp_replace({blanks}, '^\\s|\\s$', '', 'g')"
