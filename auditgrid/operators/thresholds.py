"""Thresholds chosen on one split, to be frozen for another.

All return one row. A prediction is ``score > tau``. Scores are counted by
distinct value first (`metrics.steps`), so the ordered scan sees each tie once;
null scores take no part. Named rules differ on purpose and are kept apart.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import base_rate_precision, ratio, steps
from .scan import running_sums

PAD = 1e-6


def youden(df: DataFrame, truth: Column, score: str) -> DataFrame:
    """The highest score with the largest recall minus false-positive rate."""
    s = steps(df, truth, score)
    gap = ratio(F.col("tp"), F.col("attacks")) - ratio(F.col("fp"), F.col("benign"))
    best = s.select("score", gap.alias("gap")).agg(F.max_by("score", F.struct("gap", "score")).alias("tau"), F.max("gap").alias("gap"))
    return best


def recall_at_fpr(df: DataFrame, truth: Column, score: str, target: float) -> DataFrame:
    """The lowest score down to which the false-positive rate stays at most ``target``."""
    s = steps(df, truth, score).withColumn("fpr", ratio(F.col("fp"), F.col("benign")))
    held = s.where(F.col("fpr") <= target)
    return held.agg(F.min("score").alias("tau"), F.max(ratio(F.col("tp"), F.col("attacks"))).alias("recall"), F.max("fpr").alias("fpr"), F.max("tp").alias("tp"), F.max("fp").alias("fp"))


def values_at(df: DataFrame, score: str, places: list[float], count: int) -> DataFrame:
    """``place, value``: scores at places in ascending order, counted from zero, linear between two ranks.

    No task holds the scores in order: a distinct score covers a range of ranks by
    its running count, and meets the ranks that are asked for in blocks of ranks.
    ``count`` is the number of scores; the asked ranks are broadcast.
    """
    s = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(F.count("*").alias("c"))
    run = running_sums(s, "score", ["c"]).select("score", (F.col("c_run") - F.col("c")).alias("from"), (F.col("c_run") - 1).alias("to"))
    size = max(1, count // max(1, len(places)))
    rows = [(p, r, w) for p in places for r, w in ({math.floor(p): math.ceil(p) - p} | {math.ceil(p): p - math.floor(p)} if p % 1 else {int(p): 1.0}).items()]
    asked = df.sparkSession.createDataFrame(pa.table({"place": [p for p, _, _ in rows], "rank": [r for _, r, _ in rows], "weight": [w for _, _, w in rows], "block": [r // size for _, r, _ in rows]}))
    spread = run.select("*", F.explode(F.sequence(F.expr(f"`from` div {size}"), F.expr(f"`to` div {size}"))).alias("block"))
    met = spread.join(F.broadcast(asked), "block").where((F.col("rank") >= F.col("from")) & (F.col("rank") <= F.col("to")))
    low, high = F.min("score"), F.max("score")
    return met.groupBy("place").agg(F.when(low == high, low).otherwise(F.sum(F.col("weight") * F.col("score"))).alias("value"))


def quantile_grid(df: DataFrame, score: str, n: int) -> DataFrame:
    """``tau``: distinct quantiles of the scores (linear), and a value below and above all."""
    count, low, high = df.agg(F.count(score), F.min(score), F.max(score)).first()
    spark = df.sparkSession
    if not count:
        return spark.createDataFrame([], "tau double")
    places = sorted({(count - 1) * (i / (n - 1)) for i in range(n)})
    ends = spark.createDataFrame(pa.table({"tau": [float(low) - PAD, float(high) + PAD]}))
    return values_at(df, score, places, count).select(F.col("value").alias("tau")).unionByName(ends).distinct()


def grid_counts(df: DataFrame, truth: Column, score: str, n: int) -> DataFrame:
    """``tau, tp, fp, attacks, benign`` over the grid.

    Scores and candidates are one ordered list: what lies above a candidate is
    a running sum, not a join.
    """
    s = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("at")).agg(F.count_if(truth).alias("p"), F.count_if(~truth).alias("n"))
    zero = F.lit(0).cast("long")
    grid = quantile_grid(df, score, n).select(F.col("tau").alias("at"), zero.alias("p"), zero.alias("n"), F.lit(1).alias("grid"))
    both = s.withColumn("grid", F.lit(0)).unionByName(grid).groupBy("at").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.max("grid").alias("grid"))
    run = running_sums(both, "at", ["p", "n"], descending=True).where("grid = 1")
    # what lies strictly above: a candidate that is a score doesn't count itself
    return run.select(F.col("at").alias("tau"), (F.col("p_run") - F.col("p")).alias("tp"), (F.col("n_run") - F.col("n")).alias("fp"), F.col("p_all").alias("attacks"), F.col("n_all").alias("benign"))


def zero_fp_grid(df: DataFrame, truth: Column, score: str, n: int = 1001) -> DataFrame:
    """The lowest candidate of most recall among those without a false positive."""
    c = grid_counts(df, truth, score, n).where("fp = 0")
    return c.agg(F.max_by("tau", F.struct(F.col("tp"), (-F.col("tau")).alias("low"))).alias("tau"), F.max("tp").alias("tp"))


def zero_fp_max(df: DataFrame, truth: Column, score: str) -> DataFrame:
    """The highest benign score; without benign rows just below the lowest score."""
    c = F.col(score)
    return df.agg(F.coalesce(F.max(F.when(~truth, c)), F.min(c) - 1e-9).alias("tau"))


def base_rate_f1(df: DataFrame, truth: Column, score: str, n: int = 401, least_tp: int = 30) -> DataFrame:
    """The lowest candidate with the largest F1 at one attack in 101 and enough hits."""
    c = grid_counts(df, truth, score, n)
    recall, fpr = ratio(F.col("tp"), F.col("attacks")), ratio(F.col("fp"), F.col("benign"))
    precision = base_rate_precision(recall, fpr, 100)
    f1 = F.round(ratio(2 * precision * recall, precision + recall), 12)
    enough = F.col("tp") >= F.greatest(F.lit(least_tp), F.ceil(F.col("attacks") / 100))
    return c.where(enough).select("tau", f1.alias("f1"), "tp").agg(F.max_by("tau", F.struct(F.col("f1"), (-F.col("tau")).alias("low"))).alias("tau"), F.max("f1").alias("f1"))


def order_statistic(df: DataFrame, score: str, alphas: list[float]) -> DataFrame:
    """``alpha, tau``: the ceil((n + 1)(1 - alpha))-th smallest score, or the largest."""
    s = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"))
    ranked = running_sums(s, "score", ["n"]).select("score", F.col("n_run").alias("upto"), F.col("n_all").alias("total"))
    wanted = ranked.select("*", F.explode(F.array(*map(F.lit, alphas))).alias("alpha"))
    rank = F.least(F.col("total"), F.ceil(F.round((F.col("total") + 1) * (1 - F.col("alpha")), 9)))
    return wanted.where(F.col("upto") >= rank).groupBy("alpha").agg(F.min("score").alias("tau"))


def budget(df: DataFrame, truth: Column, score: str, share: float) -> DataFrame:
    """Just above the (k + 1)-th largest benign score, with k = floor(share * benign rows)."""
    s = df.where(~truth & F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"))
    ranked = running_sums(s, "score", ["n"], descending=True).select("score", F.col("n_run").alias("upto"), F.col("n_all").alias("total"))
    k = F.floor(F.col("total") * share)
    return ranked.agg(F.coalesce(F.max(F.when(F.col("upto") >= k + 1, F.col("score"))) + 1e-12, F.min("score") - 1e-9).alias("tau"))


def roc_on_grid(df: DataFrame, truth: Column, score: str, points: list[float]) -> DataFrame:
    """``fpr, recall``: the curve, linear between its points, at given false-positive rates."""
    s = steps(df, truth, score).select(ratio(F.col("fp"), F.col("benign")).alias("x"), ratio(F.col("tp"), F.col("attacks")).alias("y"))
    curve = s.groupBy("x").agg(F.max("y").alias("y"), F.min("y").alias("y0"))
    wanted = F.explode(F.array(*map(F.lit, points))).alias("fpr")
    left = curve.select("*", wanted).groupBy("fpr").agg(
        F.max_by(F.struct("x", "y"), F.when(F.col("x") <= F.col("fpr"), F.col("x"))).alias("a"),
        F.min_by(F.struct("x", "y0"), F.when(F.col("x") > F.col("fpr"), F.col("x"))).alias("b"),
    )
    a_x, a_y = F.coalesce("a.x", F.lit(0.0)), F.coalesce("a.y", F.lit(0.0))
    return left.select("fpr", F.when(F.col("b").isNull(), a_y).otherwise(a_y + (F.col("b.y0") - a_y) * (F.col("fpr") - a_x) / (F.col("b.x") - a_x)).alias("recall"))
