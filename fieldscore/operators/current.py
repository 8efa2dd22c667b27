"""The current row of a key among repeated and superseded deliveries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current_rows(df: DataFrame, keys: list[str], version: str, ties: list[Column] | None = None) -> DataFrame:
    """The row of each key with the latest ``version``; equal rows count once.

    Nulls in ``version`` are the oldest; null keys are keys like any other. Rows of one key with one version
    are told apart by ``ties`` (by default the hash of the whole row), so the choice doesn't depend on the
    partitioning. Other columns pass through whatever their names. The filter on ``row_number`` becomes a
    partial group limit before the shuffle: of a key that holds a third of all rows each task sends one row.
    """
    rank = "__rank"
    while rank in df.columns:
        rank += "_"
    ties = ties if ties is not None else [F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if "map<" not in t and "variant" not in t])]
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last(), *ties)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1).drop(rank)
