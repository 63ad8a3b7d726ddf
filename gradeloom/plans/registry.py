"""Registered queries: name -> callable, and name -> the expected rows' SQL."""

from gradeloom.plans.sql_views import VIEWS
from gradeloom.sources.adapter import Tables

QUERIES = {}
SQL = {}


def plan(name, build):
    """Register ``build(Tables) -> DataFrame`` under ``name``."""

    def run(spark, sf_dir):
        return build(Tables(spark, sf_dir))

    run.__name__ = name
    QUERIES[name] = run


def expect(name, body):
    """The rows of a query in DuckDB's SQL, over the views of ``sql_views``."""
    SQL[name] = f"{VIEWS} {body}"
