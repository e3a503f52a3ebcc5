"""Paired comparison of two runs over the same records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("gained_attack", "lost_attack", "new_benign_fp", "cleared_benign_fp", "unchanged")


def transition(truth: Column, old: Column, new: Column) -> Column:
    """What a record's prediction changed to; null predictions count as no flag."""
    old, new = F.coalesce(old, F.lit(False)), F.coalesce(new, F.lit(False))
    return F.when(truth & ~old & new, KINDS[0]).when(truth & old & ~new, KINDS[1]).when(~truth & ~old & new, KINDS[2]).when(~truth & old & ~new, KINDS[3]).otherwise(KINDS[4])


def paired(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Records of both runs, with ``<column>_old`` and ``<column>_new``."""
    left = old.select(key, *(F.col(c).alias(f"{c}_old") for c in columns))
    right = new.select(key, *(F.col(c).alias(f"{c}_new") for c in columns))
    return left.join(right, key)


def cause(old_hash: Column, new_hash: Column) -> Column:
    """Why a benign record is newly flagged: its normalized text changed, or only its score."""
    return F.when(~old_hash.eqNullSafe(new_hash), "normalizer_changed_view").otherwise("threshold_or_score_distribution")


def examples(df: DataFrame, by: list[str], key: str, n: int) -> DataFrame:
    """The first n keys of each group in key order, as an array."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(key))
    top = df.select(*by, key, rank.alias("_r")).where(F.col("_r") <= n)
    return top.groupBy(*by).agg(F.array_sort(F.collect_list(key)).alias("examples"))


def step_changes(df: DataFrame, key: str, steps: dict[str, Column], keep: list[str]) -> DataFrame:
    """``key, step, pred, before``: the decision after each step and after the one before it."""
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("no"), F.lit(n).alias("step"), p.alias("pred"), (list(steps.values())[i - 1] if i else F.lit(None).cast("boolean")).alias("before")) for i, (n, p) in enumerate(steps.items())))).alias("c")
    return df.select(key, *keep, cells).select(key, *keep, "c.no", "c.step", "c.pred", "c.before")
