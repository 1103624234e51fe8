"""All registered queries and their SQL."""

from __future__ import annotations

from . import date_queries, event_queries, file_queries, join_queries, page_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
