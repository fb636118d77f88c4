"""The list of queries, and what their modules share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from quillon.functions.vectors import rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def round_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: rounded(n) for n in names})


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
