"""JSON texts as values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_json(text: Column) -> Column:
    """The text that all writings of one JSON value share: keys in order, no blanks between, escapes only where
    they are needed, and numbers without zeros at the end (those with an exponent stay numbers of their own).
    A text that is no JSON, or an object that repeats a key, stays as it is; null stays null."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def same_json(a: Column, b: Column) -> Column:
    """Whether two texts write one value; two nulls do."""
    return canonical_json(a).eqNullSafe(canonical_json(b))


def distinct_json(df: DataFrame, text: str, *seq: str) -> DataFrame:
    """One row for each JSON value of a column: the first in the order of ``seq``. Values are compared by a
    hash of 256 bits, so long texts are not sorted or held in a key; firsts are found before the shuffle."""
    rest = [c for c in df.columns if c != text]
    key = F.sha2(canonical_json(F.col(text)), 256)
    return df.groupBy(key.alias("__key")).agg(F.min_by(F.struct(text, *rest), F.struct(*seq)).alias("r")).select(*(F.col(f"r.{c}").alias(c) for c in df.columns))
