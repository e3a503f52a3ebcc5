"""Deterministic splits, balanced limits and stratified samples.

Limits within groups are ranks that Spark cuts on the map side, so a large group
is never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def first_of_each(df: DataFrame, by: Sequence[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each group; ``order`` must end in a key."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def balanced(df: DataFrame, by: Sequence[str], total: int, groups: int, key: str = "id") -> DataFrame:
    """An equal share of ``total`` for each of ``groups`` groups, in key order."""
    return first_of_each(df, by, total // groups, F.col(key))


def salted_order(salt: str, *parts: str) -> Column:
    """A reproducible pseudo-random order of rows."""
    return F.sha2(F.concat_ws("|", F.lit(salt), *parts), 256)


def stratified(df: DataFrame, by: Sequence[str], n: int, salt: str, key: str = "id", cap: int | None = None) -> DataFrame:
    """n rows of each stratum in salted order; more than ``cap`` rows in all is an error."""
    out = first_of_each(df.withColumn("_order", salted_order(salt, key, *by)), by, n, F.col("_order"), F.col(key)).drop("_order")
    if cap is None:
        return out
    strata = df.select(*by).distinct().limit(cap // n + 2).count()
    if strata * n > cap:
        raise ValueError(f"{strata} strata of {n} rows may exceed the cap of {cap}")
    return out


def split_by_hash(df: DataFrame, key: str = "id", salt: str = "1337:") -> DataFrame:
    return df.withColumn("hash_split", C.hash_split(F.col(key), salt))


def folds(df: DataFrame, key: str, by: str, k: int = 5, salt: str = "1337:") -> DataFrame:
    """Adds ``fold``: strata are dealt out in salted order, so folds have equal shares of each."""
    dealt = F.row_number().over(Window.partitionBy(by).orderBy(salted_order(salt, key), F.col(key)))
    return df.withColumn("fold", F.pmod(dealt - 1, F.lit(k)))
