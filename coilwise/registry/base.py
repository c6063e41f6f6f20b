"""Registration of queries and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import reuse
from ..sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query under ``name``; ``covers`` lists the inventory ids it exercises."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def det(spark: SparkSession, d: str, model: str = "A") -> DataFrame:
    """Detections of one model; stands for a stored table, so it is derived once per session."""
    return reuse(tables.detections(spark, d, model))


def gt(spark: SparkSession, d: str) -> DataFrame:
    return reuse(tables.gt_boxes(spark, d))


def r6(c: str | Column, name: str | None = None, digits: int = 6) -> Column:
    """Rounded output column (results are rounded only here, at the sink)."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double"), digits)
    return out.alias(name or c) if (name or isinstance(c, str)) else out


def big(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("bigint").alias(name or c) if (name or isinstance(c, str)) else col.cast("bigint")
