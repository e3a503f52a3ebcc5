"""Leakage, duplicates and schema violations of a corpus.

Violations come as rows ``id, code, field``; an empty result is a clean corpus.
Character grams and signatures here serve the corpus report; the pairing of
near duplicates goes over signature bands, and only distinct texts are paired.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import cut


def leaking_keys(df: DataFrame, keys: Sequence[str], split: str = "split") -> DataFrame:
    """``field, value, splits, rows``: values of key columns that occur in several splits."""
    cells = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).alias("value")) for k in keys))).alias("cell")
    counted = df.select(split, cells).where("cell.value is not null").groupBy("cell.field", "cell.value", split).agg(F.count("*").alias("n"))
    found = counted.groupBy("field", "value").agg(F.count("*").alias("splits"), F.sum("n").alias("rows"))
    return found.where("splits > 1")


def exact_duplicates(df: DataFrame, text: Column, split: str = "split", family: str = "family_id") -> DataFrame:
    """``text_hash, rows, splits, families`` of equal texts over splits and over families."""
    hashed = df.select(split, family, C.sha_hex(text).alias("text_hash"), text.alias("_t")).where("_t is not null and _t <> ''")
    cells = hashed.groupBy("text_hash", split, family).agg(F.count("*").alias("n"))
    out = cells.groupBy("text_hash").agg(F.sum("n").alias("rows"), F.countDistinct(split).alias("splits"), F.countDistinct(family).alias("families"))
    return out.where("splits > 1 and families > 1")


def duplicate_keys(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1")


def _signatures(n: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keys, signatures, counts = [], [], []
            for key, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                if not text:
                    continue
                grams = {text[i : i + n] for i in range(max(1, len(text) - n + 1))}
                raw = b"".join(hashlib.sha256(g.encode("utf-8", "surrogatepass")).digest()[:8] for g in grams)
                bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
                keys.append(key)
                signatures.append(int.from_bytes(np.packbits(2 * bits >= len(grams)).tobytes(), "big", signed=True))
                counts.append(len(grams))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((keys, signatures, counts), schema)], schema=schema)

    return run


def simhash(df: DataFrame, key: str, compact: str, n: int = 7) -> DataFrame:
    """``key, signature, grams``: 64 bits, each set where at least half of the gram hashes have it.

    A gram's hash is the first 64 bits of its SHA-256. The bits of a text are
    summed in one matrix in Arrow batches; as expressions, the grams of all texts
    would be rows with 64 sums, which took thirteen seconds where this takes one.
    Null and empty texts have no signature.
    """
    rows = df.select(key, compact)
    kind = rows.schema[key].dataType.simpleString()
    schema = pa.schema([(key, {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]), ("signature", pa.int64()), ("grams", pa.int32())])
    return rows.mapInArrow(_signatures(n, schema), f"{key} {kind}, signature long, grams int")


def banded_pairs(signatures: DataFrame, key: str, threshold: float = 0.0) -> DataFrame:
    """``a < b``: distinct pairs of keys whose signatures agree in one of four 16-bit bands.

    Equal signatures count as one for pairing and are expanded afterwards. Two
    classes meet in the first band that they share, so no pair has to be dropped
    again, and with a ``threshold`` only if ``grams`` of some of their members are
    within that ratio; this is seen in the join, before a pair is shuffled.
    """
    sized = {"fewest": F.min("grams"), "most": F.max("grams")} if threshold else {"fewest": F.lit(0), "most": F.lit(0)}
    classes = signatures.groupBy("signature").agg(F.min(key).alias("rep"), *(c.alias(n) for n, c in sized.items()))
    bands = classes.select("*", F.posexplode(F.array(*(C.band(F.col("signature"), i) for i in range(4)))).alias("i", "value"))
    other = bands.select(*(F.col(c).alias(f"{c}2") for c in ("rep", "signature", "fewest", "most")), "i", "value")
    apart = F.col("signature").bitwiseXOR(F.col("signature2"))
    first = C.any_of((F.col("i") > j) & (C.band(apart, j) == 0) for j in range(4))
    within = (F.col("most") >= threshold * F.col("fewest2")) & (F.col("most2") >= threshold * F.col("fewest"))
    near = bands.join(other, ["i", "value"]).where((F.col("rep") < F.col("rep2")) & ~first & within).select("rep", "rep2")
    member = signatures.join(classes, "signature").select(F.col(key).alias("m"), "rep")
    apart = near.join(member.withColumnRenamed("m", "x"), "rep").join(member.select(F.col("m").alias("y"), F.col("rep").alias("rep2")), "rep2").select("x", "y")
    same = member.select(F.col("m").alias("x"), "rep").join(member.select(F.col("m").alias("y"), "rep"), "rep").where("x < y").select("x", "y")
    return apart.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _similar(threshold: float, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            keep, similarity = [], []
            for i, (a, b) in enumerate(zip(rows.column(2).to_pylist(), rows.column(3).to_pylist())):
                x, y = ({t[j : j + n] for j in range(max(1, len(t) - n + 1))} for t in (a, b))
                both = len(x & y)
                if both >= threshold * (len(x) + len(y) - both):
                    keep.append(i)
                    similarity.append(both / (len(x) + len(y) - both))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(1).take(at), pa.array(similarity, pa.float64())], names=["a", "b", "similarity"])

    return run


def near_duplicates(df: DataFrame, key: str, compact: str, threshold: float = 0.92, extra: Sequence[str] = ()) -> DataFrame:
    """``a, b, similarity``: banded pairs with gram similarity of at least the threshold.

    ``extra`` columns must differ between the two (other split, other family).
    Only signatures, sizes and keys are shuffled until the pairs are known.
    """
    signed = cut(simhash(df, key, compact))
    pairs = banded_pairs(signed.select(key, "signature", "grams"), key, threshold)
    facts = signed.select(key, "grams").join(df.select(key, *extra), key) if extra else signed.select(key, "grams")
    for side in ("a", "b"):
        pairs = pairs.join(facts.select(*(F.col(c).alias(f"{c}_{side}") for c in facts.columns)), F.col(side) == F.col(f"{key}_{side}"))
    # similar sets are of similar size, so most pairs end before a text is moved
    pairs = pairs.where(F.least("grams_a", "grams_b") >= threshold * F.greatest("grams_a", "grams_b"))
    for c in extra:
        pairs = pairs.where(F.col(f"{c}_a") != F.col(f"{c}_b"))
    texts = df.select(F.col(key).alias("_k"), compact)
    pairs = pairs.select("a", "b").join(texts.select(F.col("_k").alias("a"), F.col(compact).alias("ta")), "a").join(texts.select(F.col("_k").alias("b"), F.col(compact).alias("tb")), "b")
    kind = df.schema[key].dataType.simpleString()
    return pairs.select("a", "b", "ta", "tb").mapInArrow(_similar(threshold, 7), f"a {kind}, b {kind}, similarity double")


def violations(df: DataFrame, rules: dict[tuple[str, str], Column], key: str = "id") -> DataFrame:
    """``id, code, field`` of each broken rule; a rule is true where it is broken."""
    hits = F.array_compact(F.array(*(F.when(C.true(broken), F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"))) for (code, field), broken in rules.items())))
    return df.select(key, F.explode(hits).alias("v")).select(key, "v.code", "v.field")
