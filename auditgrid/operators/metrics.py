"""Confusion counts, intervals, precision at base rates, curves and breakdowns.

Breakdowns count once for each combination of their fields before the counts are
spread over fields, so the input is shuffled once and in aggregated form. Curves
are built from counts by distinct score, so ties are one step and the ordered
scan runs over distinct scores only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import Z95
from .scan import running_sums

_PLACES = 9


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b; ``empty`` for a zero denominator."""
    return F.when(b > 0, a / b).otherwise(F.lit(empty).cast("double"))


def counts(truth: Column, flagged: Column) -> list[Column]:
    """tp, fn, fp, tn of boolean columns; a null prediction is no flag."""
    flagged = F.coalesce(flagged, F.lit(False))
    return [F.count_if(c).alias(n) for n, c in (("tp", truth & flagged), ("fn", truth & ~flagged), ("fp", ~truth & flagged), ("tn", ~truth & ~flagged))]


def wilson(hits: Column, total: Column, side: int, empty: float | None = None) -> Column:
    """Lower (-1) or upper (1) bound of the 95 % interval."""
    p, z2 = hits / total, Z95 * Z95
    half = Z95 * F.sqrt((p * (1 - p) + z2 / (4 * total)) / total)
    return F.when(total > 0, (p + z2 / (2 * total) + side * half) / (1 + z2 / total)).otherwise(F.lit(empty).cast("double"))


def base_rate_precision(recall: Column, fpr: Column, per_attack: int, empty: float | None = 0.0) -> Column:
    """Precision if there were ``per_attack`` benign rows for each attack."""
    share = 1 / (per_attack + 1)
    return ratio(recall * share, recall * share + fpr * (1 - share), empty)


def metric_block(places: int = _PLACES) -> list[Column]:
    """Rates, intervals and base-rate precisions over columns tp, fn, fp, tn."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    attacks, benign = tp + fn, fp + tn
    recall, fpr = ratio(tp, attacks), ratio(fp, benign)
    block = {
        "recall": recall,
        "recall_low": wilson(tp, attacks, -1),
        "recall_high": wilson(tp, attacks, 1),
        "fpr": fpr,
        "fpr_low": wilson(fp, benign, -1),
        "fpr_high": wilson(fp, benign, 1),
        "fp_per_1k": fpr * 1000,
        "precision_100": base_rate_precision(recall, fpr, 100),
        "precision_1000": base_rate_precision(recall, fpr, 1000),
    }
    return [attacks.alias("attacks"), benign.alias("benign"), *(F.round(c, places).alias(n) for n, c in block.items())]


def precision_interval(per_attack: int, places: int = _PLACES) -> list[Column]:
    """Bounds of the base-rate precision from the bounds of recall and false-positive rate."""
    tp, fn, fp, tn = (F.col(c) for c in ("tp", "fn", "fp", "tn"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    low = base_rate_precision(zero(wilson(tp, tp + fn, -1)), zero(wilson(fp, fp + tn, 1)), per_attack)
    high = base_rate_precision(zero(wilson(tp, tp + fn, 1)), zero(wilson(fp, fp + tn, -1)), per_attack)
    return [F.round(low, places).alias(f"precision_{per_attack}_low"), F.round(high, places).alias(f"precision_{per_attack}_high")]


def long_counts(df: DataFrame, fields: Sequence[str], aggregates: Sequence[Column], overall: bool = True) -> DataFrame:
    """``field, value`` and summed aggregates: one row for each value of each field.

    Values are counted by all fields together first; a null is "missing".
    """
    shown = [F.coalesce(F.col(f).cast("string"), F.lit("missing")).alias(f) for f in fields]
    base = df.groupBy(*shown).agg(*aggregates)
    sums = [c for c in base.columns if c not in fields]
    pairs = [F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]
    if overall:
        pairs.append(F.struct(F.lit("overall").alias("field"), F.lit("all").alias("value")))
    spread = base.select(F.explode(F.array(*pairs)).alias("cell"), *sums)
    return spread.groupBy("cell.field", "cell.value").agg(*(F.sum(c).alias(c) for c in sums))


def breakdown(df: DataFrame, fields: Sequence[str], truth: Column, flagged: Column) -> DataFrame:
    """Metric block for each value of each field, and over all rows."""
    cells = long_counts(df, fields, counts(truth, flagged))
    return cells.select("field", "value", "tp", "fn", "fp", "tn", *metric_block())


def steps(df: DataFrame, truth: Column, score: str) -> DataFrame:
    """By distinct score, from high to low: counts at it (p, n) and down to it (tp, fp), and totals."""
    grouped = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count_if(truth).alias("p"), F.count_if(~truth).alias("n"))
    run = running_sums(grouped, "score", ["p", "n"], descending=True)
    return run.select("score", "p", "n", F.col("p_run").alias("tp"), F.col("n_run").alias("fp"), F.col("p_all").alias("attacks"), F.col("n_all").alias("benign"))


def roc_auc(df: DataFrame, truth: Column, score: str) -> DataFrame:
    """``roc_auc`` in one row: attacks above each benign score, ties by half; null with one class."""
    s = steps(df, truth, score)
    wins = F.sum(F.col("n") * (F.col("tp") - F.col("p") + F.col("p") / 2))
    return s.agg(F.when((F.max("attacks") > 0) & (F.max("benign") > 0), wins / (F.max("attacks") * F.max("benign"))).alias("roc_auc"))


def average_precision(df: DataFrame, truth: Column, score: str) -> DataFrame:
    """``average_precision`` in one row: precision at each step weighted by its share of recall."""
    s = steps(df, truth, score)
    area = F.sum(F.try_divide("p", "attacks") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return s.agg(F.when((F.max("attacks") > 0) & (F.max("benign") > 0), area).alias("average_precision"))


def score_summary(df: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles (linear), mean and population deviation; nulls don't count."""
    c = F.col(score)
    out = {"low": F.min(c), **{n: F.percentile(c, F.lit(q)) for n, q in (("p05", 0.05), ("median", 0.5), ("p95", 0.95))}, "high": F.max(c), "mean": F.avg(c), "deviation": F.stddev_pop(c)}
    return df.groupBy(*by).agg(F.count(c).alias("n"), *(F.round(x, _PLACES).alias(n) for n, x in out.items()))


def brier(df: DataFrame, truth: Column, probability: Column) -> DataFrame:
    return df.agg(F.round(F.avg(F.pow(probability - truth.cast("double"), F.lit(2.0))), _PLACES).alias("brier"))


def coverage_grid(df: DataFrame, a: str, a_values: Sequence[str], b: str, b_values: Sequence[str]) -> DataFrame:
    """Counts of every combination of two closed vocabularies, zero where there is none."""
    cells = F.explode(F.array(*(F.struct(F.lit(x).alias(a), F.lit(y).alias(b)) for x in a_values for y in b_values))).alias("cell")
    grid = df.sparkSession.range(1).select(cells).select(f"cell.{a}", f"cell.{b}")
    return grid.join(df.groupBy(a, b).agg(F.count("*").alias("rows")), [a, b], "left").select(a, b, F.coalesce("rows", F.lit(0)).alias("rows"))
