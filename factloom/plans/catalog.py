"""The query catalogue: each query with the same result stated in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.oracle_views import with_views
from factloom.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return plain(self.build(Tables(spark, folder)))


CATALOG: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Registers a function of the tables under a name, with its SQL if it has any."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"{name} is there already")
        text = None if sql is None else with_views(sql)
        CATALOG[name] = Query(name, tuple(covers.split()), build, text)
        return build

    return add


def plain(df: DataFrame) -> DataFrame:
    """Times and dates as text and whole numbers as longs, so that engines compare alike."""
    columns = []
    for field in df.schema:
        column, kind = F.col(f"`{field.name}`"), field.dataType.typeName()
        if kind in ("timestamp", "timestamp_ntz"):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            column = column.cast("string")
        elif kind in ("integer", "short", "byte"):
            column = column.cast("long")
        elif kind in ("float", "decimal"):
            column = column.cast("double")
        columns.append(column.alias(field.name))
    return df.select(*columns)
