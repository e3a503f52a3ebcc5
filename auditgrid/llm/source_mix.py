"""Documents mixed to target shares of tokens along a time-varying curriculum.

How much is taken. The total is the largest for which every source that has
documents and a target can give its share with no document more than
``max_repeats`` times. Targets without documents can't be met; the others keep
their proportions to each other. A source whose demand exceeds its tokens starts
another pass over its documents; the last pass ends with the document whose
middle lies at the demand.

When it is taken. A source's weight runs linearly from a start weight to an end
weight, and its integral over the training is its share. Start weights lie
between the shares and the natural proportions, as far toward the latter
(``drift``) as keeps all weights between zero and twice the share; they sum to
one at any time. The integral of the weight is the cumulative demand; inverted,
it assigns to each taken copy the training position at which the source's demand
reaches the middle of the copy. Copies are range-sorted by position.

Scale. Within a source documents have a fixed pseudo-random order. Prefix sums
of tokens are built in two steps, over SLICES hash ranges of a source and within
a range, so that no source, however large, is in one task. Only the table of
targets, of at most MOST_TARGETS rows (checked), is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowkit import cut, partitions
from .tokenize_corpus import VOCABULARY, token_counts

SLICE_BITS, MOST_TARGETS = 10, 10_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df)


def mix_plan(tokens: DataFrame, targets: DataFrame, drift: float = 1.0) -> DataFrame:
    """For each target: what there is, what is demanded, and the weight's line.

    ``tokens`` has ``doc_id, grp, tokens``; ``targets`` has ``source,
    target_share, max_repeats``, with one row for each source. Null or
    non-positive shares and repeats demand nothing.
    """
    if targets.limit(MOST_TARGETS + 1).count() > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    there = tokens.where("tokens > 0").groupBy("grp").agg(F.count("*").alias("docs"), F.sum("tokens").alias("available"))
    plan = targets.select("source", "target_share", "max_repeats").join(there, F.col("source") == F.col("grp"), "left").drop("grp")
    every = Window.partitionBy()
    live = (F.col("target_share") > 0) & (F.col("max_repeats") > 0) & (F.coalesce("available", F.lit(0)) > 0)
    plan = plan.withColumn("share", F.when(live, F.col("target_share") / F.sum(F.when(live, F.col("target_share"))).over(every)).otherwise(0.0))
    plan = plan.withColumn("total", F.floor(F.min(F.when(live, F.col("available") * F.col("max_repeats") / F.col("share"))).over(every)))
    plan = plan.withColumn("demand", F.coalesce(F.col("share") * F.col("total"), F.lit(0.0)))
    plan = plan.withColumn("natural", F.when(live, F.col("available") / F.sum(F.when(live, F.col("available"))).over(every)).otherwise(0.0))
    reach = F.min(F.when(F.col("natural") > F.col("share"), F.col("share") / (F.col("natural") - F.col("share")))).over(every)
    plan = plan.withColumn("drift", F.least(F.lit(float(drift)), F.lit(1.0), F.coalesce(reach, F.lit(1.0))))
    start = F.col("share") + F.col("drift") * (F.col("natural") - F.col("share"))
    return plan.select("source", "target_share", "max_repeats", F.coalesce("docs", F.lit(0).cast("long")).alias("docs"), F.coalesce("available", F.lit(0).cast("long")).alias("available"), "share", F.coalesce("total", F.lit(0).cast("long")).alias("total"), "demand", start.alias("start"), (2 * F.col("share") - start).alias("end"))


def _ordered(tokens: DataFrame, plan: DataFrame) -> DataFrame:
    """Documents of demanded sources with the tokens of their source before them."""
    wanted = _small(plan.where("demand > 0"))
    docs = tokens.where("tokens > 0").join(wanted, F.col("grp") == F.col("source")).withColumn("place", F.xxhash64("doc_id", "source"))
    docs = docs.withColumn("slice", F.shiftrightunsigned("place", 64 - SLICE_BITS))
    sums = docs.groupBy("source", "slice").agg(F.sum("tokens").alias("held"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "slice", F.coalesce(F.sum("held").over(earlier), F.lit(0).cast("long")).alias("base"))
    within = Window.partitionBy("source", "slice").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("before", F.coalesce(F.sum("tokens").over(within), F.lit(0).cast("long")))
    return docs.join(sums, ["source", "slice"]).withColumn("before", F.col("before") + F.col("base"))


def mixed_documents(tokens: DataFrame, plan: DataFrame) -> DataFrame:
    """``doc_id, source, copy, tokens, position``, range-sorted by position in [0, 1].

    Documents without tokens, of no source or of one without a target are not
    taken. An empty table, or no target, gives no row.
    """
    docs = _ordered(tokens, plan)
    middle = F.col("before") + F.col("tokens") / 2
    passes = F.ceil((F.col("demand") - middle) / F.col("available")).cast("int")
    taken = docs.withColumn("passes", F.least(passes, F.col("max_repeats"))).where("passes > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "passes")))
    reached = ((F.col("copy") - 1) * F.col("available") + middle) / F.col("total")
    slope = F.col("end") - F.col("start")
    position = 2 * reached / (F.col("start") + F.sqrt(F.greatest(F.lit(0.0), F.col("start") * F.col("start") + 2 * slope * reached)))
    taken = taken.select("doc_id", "source", "copy", "tokens", F.least(F.lit(1.0), position).alias("position"))
    return taken.repartitionByRange(partitions(tokens.sparkSession), "position", "source", "doc_id", "copy").sortWithinPartitions("position", "source", "doc_id", "copy")


def mix_report(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """One row for each target: wanted and actual share of all tokens taken, and repeats.

    ``binding`` marks the source that keeps the total from being larger.
    """
    taken = mixed.groupBy("source").agg(F.count("*").alias("copies_taken"), F.countDistinct("doc_id").alias("docs_taken"), F.sum("tokens").alias("tokens_taken"), F.max("copy").alias("most_repeats"))
    out = plan.select("source", "target_share", "max_repeats", F.col("docs").alias("docs_available"), F.col("available").alias("tokens_available"), F.coalesce((F.col("share") > 0) & (F.floor(F.col("available") * F.col("max_repeats") / F.when(F.col("share") > 0, F.col("share"))) <= F.col("total")), F.lit(False)).alias("binding")).join(taken, "source", "left")
    zero = {c: 0 for c in ("copies_taken", "docs_taken", "tokens_taken", "most_repeats")}
    out = out.fillna(zero)
    every = F.sum("tokens_taken").over(Window.partitionBy())
    return out.withColumn("actual_share", F.when(every > 0, F.col("tokens_taken") / every))


def mix_curve(mixed: DataFrame, plan: DataFrame, steps: int = 10) -> DataFrame:
    """Actual and scheduled share of each source in each of ``steps`` equal parts of the training."""
    part = F.least(F.floor(F.col("position") * steps), F.lit(steps - 1)).cast("int")
    sums = mixed.groupBy(part.alias("step"), "source").agg(F.sum("tokens").alias("tokens"))
    sums = sums.withColumn("actual_share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy("step")))
    at = (F.col("step") + 0.5) / steps
    return sums.join(_small(plan.select("source", "start", "end")), "source").select("step", "source", "tokens", F.round("actual_share", 6).alias("actual_share"), F.round(F.col("start") + (F.col("end") - F.col("start")) * at, 6).alias("scheduled_share"))


def document_tokens(documents: DataFrame, key: Column, source: Column, text: Column, path: str = VOCABULARY) -> DataFrame:
    """Sizes of documents, counted once and kept in the shared folder."""
    return cut(token_counts(documents, key, source, text, path=path).where("doc_id is not null").distinct())
