"""Trained heads, calibration and routing with MLlib.

Feature columns come from an allow-list; truth and outcome columns can't be
features. Fits are deterministic for given rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import fixed
from .thresholds import order_statistic, recall_at_fpr

BARRED = ("expected_action", "risk_level", "label", "attack_class", "truth")
#: Cost values of the linear head; its ridge is 1 / (cost * rows).
COSTS = (0.01, 0.1, 1.0, 10.0)
TREES = tuple((depth, rate) for depth in (3, 6) for rate in (0.1, 0.05))


def features(tier: str) -> dict[str, Column]:
    """Named numeric features: the score alone, with flags, or with one-hot source and trust."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(True)).cast("double")
    hot = lambda c, v: F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0))
    coarse = C.coarse_source()
    out = {"score": F.coalesce(F.col("margin"), F.lit(0.0))}
    if tier in ("floor", "ceiling"):
        out |= {"tool": flag("requires_tool_call"), **{f"coarse_{v}": (coarse == v).cast("double") for v in ("user", "tool_result", "other")}}
    if tier == "ceiling":
        out |= {"sink": flag("contains_sensitive_sink"), **{f"source_{v}": hot("source_type", v) for v in fixed.SOURCES}}
    return out


def assembled(df: DataFrame, tier: str) -> DataFrame:
    """Adds ``f_<name>`` columns and ``weight``, which balances the two classes."""
    named = features(tier)
    if bad := set(named) & set(BARRED):
        raise ValueError(f"barred as features: {sorted(bad)}")
    return df.withColumns({f"f_{k}": v for k, v in named.items()}).withColumn("y", F.col("truth").cast("double"))


def _balanced(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows with balanced weights, and how many they are."""
    n, pos = df.agg(F.count("*"), F.sum("y")).first()
    pos = pos or 0.0
    share = F.when(F.col("y") == 1, n / (2 * max(pos, 1.0))).otherwise(n / (2 * max(n - pos, 1.0)))
    return df.withColumn("weight", share), n


def _pipeline(df: DataFrame, head) -> Pipeline:
    names = sorted(c for c in df.columns if c.startswith("f_"))
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="features"), head])


def linear_head(df: DataFrame, cost: float = 1.0) -> PipelineModel:
    df, n = _balanced(df)
    return _pipeline(df, LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", regParam=1 / (cost * max(n, 1)), standardization=False, maxIter=100)).fit(df)


def tree_head(df: DataFrame, depth: int = 3, rate: float = 0.1, rounds: int = 20) -> PipelineModel:
    return _pipeline(df, GBTClassifier(featuresCol="features", labelCol="y", maxDepth=depth, stepSize=rate, maxIter=rounds, seed=7)).fit(df)


def with_score(model: PipelineModel, df: DataFrame, name: str = "head_score") -> DataFrame:
    out = model.transform(df).withColumn(name, F.round(vector_to_array("probability")[1], 8))
    return out.drop("features", "rawPrediction", "probability", "prediction")


def choose(train: DataFrame, check: DataFrame, specs: Sequence[dict], fit, target: float = 0.01) -> tuple[dict, PipelineModel]:
    """The first spec with the most recall at the target rate on the check rows."""
    best, kept = None, None
    for spec in specs:
        model = fit(train, **spec)
        reached = recall_at_fpr(with_score(model, check), F.col("truth"), "head_score", target).first().recall or 0.0
        if best is None or reached > best[0]:
            best, kept = (reached, spec), model
    return best[1], kept


def coefficients(model: PipelineModel, df: DataFrame) -> DataFrame:
    names = sorted(c for c in df.columns if c.startswith("f_"))
    head = model.stages[-1]
    rows = [(n[2:], round(float(c), 6)) for n, c in zip(names, head.coefficients)] + [("intercept", round(float(head.intercept), 6))]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double")


def isotonic(df: DataFrame, score: str):
    return IsotonicRegression(featuresCol=score, labelCol="y").fit(df.withColumn("weight", F.lit(1.0)))


def calibrated(model, df: DataFrame, score: str) -> DataFrame:
    out = model.setFeaturesCol(score).transform(df)
    return out.withColumn("calibrated", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction"))), 8)).drop("prediction")


def lanes(df: DataFrame, low: float, high: float, score: str = "calibrated") -> DataFrame:
    """Adds ``bucket``: below low passes, above high is flagged, between is uncertain."""
    if not low < high:
        raise ValueError(f"the lower threshold {low} isn't below the upper one {high}")
    return df.withColumn("bucket", F.when(F.col(score) < low, "pass").when(F.col(score) > high, "flag").otherwise("uncertain"))


def conformal_lanes(df: DataFrame, score: str, alpha_pass: float, alpha_flag: float) -> tuple[float, float]:
    """Thresholds that the shares of a benign stream exceed at most."""
    taus = {round(r.alpha, 9): r.tau for r in order_statistic(df, score, [alpha_pass, alpha_flag]).collect()}
    return taus[round(alpha_pass, 9)], taus[round(alpha_flag, 9)]


def leave_one_out(df: DataFrame, val: DataFrame, check: DataFrame, fit, target: float = 0.01) -> DataFrame:
    """``held_out, recall, fpr``: for each attack class of ``df`` a head trained without it, measured on it.

    The threshold is the one of the target rate on ``val``, frozen for the check
    rows; a prediction is a score above it. Where no score keeps the rate it lies
    just above the highest. A class without check rows has no recall.
    """
    rows = []
    classes = sorted(r[0] for r in df.where(F.col("truth") & F.col("attack_class").isNotNull()).select("attack_class").distinct().collect())
    for name in classes:
        model = fit(df.where(~F.col("attack_class").eqNullSafe(name)))
        scored = with_score(model, val)
        tau = recall_at_fpr(scored, F.col("truth"), "head_score", target).first().tau
        if tau is None and (top := scored.agg(F.max("head_score")).first()[0]) is not None:
            tau = top + 1e-9
        hit, held = F.col("head_score") > F.lit(tau).cast("double"), F.col("truth") & F.col("attack_class").eqNullSafe(name)
        share = lambda of: F.round(F.avg(F.when(of, hit.cast("double"))), 6)
        r = with_score(model, check).agg(share(held).alias("recall"), share(~F.col("truth")).alias("fpr")).first()
        rows.append((name, r.recall, r.fpr))
    return df.sparkSession.createDataFrame(rows, "held_out string, recall double, fpr double")
