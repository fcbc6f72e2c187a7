"""Registered queries: each is a function of (graph, spark, sf_dir) and, where SQL can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import Graph, load_graph, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(graph, spark, sf_dir)``; ``sql`` may name the graph's tables as if they existed."""

    def wrap(f: Callable[[Graph, SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(load_graph(spark, sf_dir), spark, sf_dir)
        if sql is not None:
            SQL[name] = with_tables(sql)
        return f

    return wrap


def stamp(name: str, alias: str | None = None):
    """A timestamp as text, the same in every engine."""
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(alias or name)


def sql_stamp(name: str, alias: str | None = None) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {alias or name.split('.')[-1]}"
