"""All queries of the session operators, with SQL that gives the same rows."""

from strokeflow.registry import braking, breakdown, ingest, long, misc, more, series, stats  # noqa: F401
from strokeflow.registry.base import QUERIES, SQL


def queries():
    return QUERIES


def oracle_sql():
    return SQL
