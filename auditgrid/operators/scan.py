"""Ordered scans that no single task does alone.

A running sum over a whole table needs an order over all rows. Here the rows
(one for each distinct value, in practice) are cut into BINS ranges of the
ordering value that hold about as many rows each, by approximate quantiles, so
that neither a skewed value nor an outlier fills one range. Sums of the ranges
are accumulated over at most BINS rows, and within a range a window does the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1024
_ACCURACY = 20 * BINS


def _place(order: str) -> Column:
    """How many edges lie at or below a value, by halving."""
    steps = F.array(*(F.lit(BINS >> i) for i in range(1, BINS.bit_length())))
    edge = lambda i: F.try_element_at(F.col("_edges"), i)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(edge(at + step) <= F.col(order), F.lit(False)), at + step).otherwise(at))


def running_sums(df: DataFrame, order: str, sums: Sequence[str], descending: bool = False) -> DataFrame:
    """Adds ``<sum>_run``, up to and with the row, and ``<sum>_all`` for each sum.

    ``order`` must be numeric, distinct and not null. An empty table stays empty.
    """
    cuts = F.array(*(F.lit(i / BINS) for i in range(1, BINS)))
    edge = df.agg(F.percentile_approx(order, cuts, _ACCURACY).alias("_edges"), *(F.sum(s).alias(f"{s}_all") for s in sums)).withColumn("_one", F.lit(1))
    rows = df.withColumn("_one", F.lit(1)).join(F.broadcast(edge), "_one").drop("_one")
    rows = rows.withColumn("_bin", _place(order)).drop("_edges")
    first = F.col("_bin").desc() if descending else F.col("_bin")
    before = Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("_bin").agg(*(F.sum(s).alias(f"_{s}") for s in sums))
    base = base.select("_bin", *(F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)).alias(f"_{s}") for s in sums))
    within = Window.partitionBy("_bin").orderBy(F.col(order).desc() if descending else F.col(order)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("*", *(F.sum(s).over(within).alias(f"{s}_run") for s in sums))
    out = rows.join(F.broadcast(base), "_bin")
    return out.select(*df.columns, *((F.col(f"{s}_run") + F.col(f"_{s}")).alias(f"{s}_run") for s in sums), *(f"{s}_all" for s in sums))
