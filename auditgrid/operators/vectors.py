"""Nearest neighbours in a labelled bank, and their margin.

The queries come in blocks; a task multiplies a block with each part of the bank
and keeps the best k of either label, so the full product is never laid out and
no bank is gathered: parts of the bank and blocks of queries meet by an equi-join
on block numbers, and the best of parts are merged afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS = 512
#: Rows of a block of queries, and of a part of the bank, that one task holds.
BLOCK, PART = 8192, 65536


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null for a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b)))


def _matrix(column: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


_NEAR = ("query", "attack", "neighbour", "similarity")


def _best(k: int, places: int):
    """The k best of either label for a block of queries against a part of the bank."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in _NEAR}
        if len(left) and len(right):
            bank, ids, kinds = _matrix(right["bank_vector"]), right["neighbour"].to_numpy(), right["is_attack"].to_numpy(bool)
            for lo in range(0, len(left), ROWS):
                some = left.iloc[lo : lo + ROWS]
                sims = np.round(_matrix(some["query_vector"]) @ bank.T, places)
                for kind in (True, False):
                    at = np.flatnonzero(kinds == kind)
                    for row, query in zip(sims[:, at], some["query"]):
                        near = at if len(at) <= k else at[row >= np.partition(row, len(at) - k)[len(at) - k]]
                        value = row if len(at) <= k else row[row >= np.partition(row, len(at) - k)[len(at) - k]]
                        best = np.lexsort((ids[near], -value))[:k]
                        out["query"] += [query] * len(best)
                        out["attack"] += [kind] * len(best)
                        out["neighbour"] += ids[near][best].tolist()
                        out["similarity"] += value[best].tolist()
        return pd.DataFrame(out, columns=list(_NEAR))

    return run


def bank_neighbours(queries: DataFrame, bank: DataFrame, k: int, parts: int | None = None, places: int = 8) -> DataFrame:
    """``query, attack, neighbour, similarity, rank``: the k best of either label.

    ``queries`` has ``query, vector``, ``bank`` has ``neighbour, attack, vector``.
    Among equal similarities the smaller key comes first. Blocks of queries meet
    parts of the bank; there are ``parts`` of each, by default as many as keep a
    block below BLOCK and a part below PART rows, and at least a few for all cores.
    """
    few = max(2, math.isqrt(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    blocks, parts = (parts, parts) if parts else (max(few, -(-queries.count() // BLOCK)), max(few, -(-bank.count() // PART)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    # new names, as both may come from one table
    q = queries.select("query", F.col("vector").alias("query_vector"), own("query", blocks).alias("block"), every(parts).alias("part"))
    b = bank.select("neighbour", F.col("attack").alias("is_attack"), F.col("vector").alias("bank_vector"), own("neighbour", parts).alias("part"), every(blocks).alias("block"))
    kinds = f"query {queries.schema['query'].dataType.simpleString()}, attack boolean, neighbour {bank.schema['neighbour'].dataType.simpleString()}, similarity double"
    best = q.groupBy("block", "part").cogroup(b.groupBy("block", "part")).applyInPandas(_best(k, places), kinds)
    rank = F.row_number().over(Window.partitionBy("query", "attack").orderBy(F.col("similarity").desc(), "neighbour"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def usable(vector: Column, dim: int) -> Column:
    """A vector of the right length whose numbers are finite and not all zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & good & F.exists(vector, lambda x: x != 0), F.lit(False))


def margins(near: DataFrame, places: int = 8) -> DataFrame:
    """``query, s_pos, s_neg, margin``: mean similarity of the attack neighbours less that of the benign ones."""
    mean = lambda kind: F.avg(F.when(F.col("attack") == kind, F.col("similarity")))
    out = near.groupBy("query").agg(mean(True).alias("p"), mean(False).alias("n"))
    return out.select("query", F.round("p", places).alias("s_pos"), F.round("n", places).alias("s_neg"), F.round(F.col("p") - F.col("n"), places).alias("margin"))


def neighbour_ids(near: DataFrame) -> DataFrame:
    """``query, top_positive, top_negative``: neighbour keys, best first."""
    ids = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("attack") == kind, F.struct("rank", "neighbour")))), lambda x: x.neighbour)
    return near.groupBy("query").agg(ids(True).alias("top_positive"), ids(False).alias("top_negative"))


def unit_vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For `mapInPandas`: vectors scaled to unit length; zero vectors stay."""
    for rows in batches:
        if len(rows):
            rows["vector"] = list(_matrix(rows["vector"]))
        yield rows
