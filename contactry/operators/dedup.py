"""First wins, last wins, top k, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: list[str | Column], order: list[str | Column]) -> DataFrame:
    """One row per key: the first in the given total order."""
    return top_k(df, keys, order, 1)


def top_k(df: DataFrame, keys: list[str | Column], order: list[str | Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows per key. Spark limits groups before the shuffle, so a hot key sends k rows per task."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def union_streams(*named: tuple[str, DataFrame]) -> DataFrame:
    """Union by name with a stage ordinal, which later orders of 'first wins' use."""
    parts = [df.withColumns({"stage": F.lit(name), "stage_ord": F.lit(i)}) for i, (name, df) in enumerate(named)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
