"""The registry of queries: what a query and its SQL are, and how results are made plain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.plans.adapter import with_entities

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, entities: bool = True):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = with_entities(sql) if entities else sql
        return f

    return add


def plain(df: DataFrame) -> DataFrame:
    """Amounts as doubles, days and times as text, whole numbers as bigint."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("decimal"):
            c = c.cast("double")
        elif kind in ("date", "timestamp", "timestamp_ntz"):
            c = F.date_format(c, "yyyy-MM-dd" if kind == "date" else "yyyy-MM-dd HH:mm:ss")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)
