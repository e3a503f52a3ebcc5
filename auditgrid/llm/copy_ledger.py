"""Records that differ only in layout: an incremental ledger of canonical keys.

Each text has a text key, from its letters and digits in order, and, if it is a
record of named fields (a flat JSON object, ``name=value`` parts, or ``name:
value`` lines), a field key, from its names and values in no order. A text is
filed under its field key if it has one, otherwise under its text key. The
ledger is bucketed by key. A batch is aggregated by key, full-outer-joined with
the buckets that it touches, counts are added and the earliest representative is
kept; buckets that it doesn't touch are carried over as they are.

A redelivered record counts once: the ledger also keeps the ids that it has,
bucketed, and drops those of a batch that it knows.

A record's text key is an alias of its field key, as the same letters may also
come as prose. Aliases are a third table; reading the ledger joins files that
an alias connects.

Each version is written to new folders of the cluster's shared folder and never
changed, so a lost executor or a repeated batch leaves no half a version.

Scale. Copies are counted before they are shuffled; a group that holds a third
of all rows is one row of a batch. A ledger has as many buckets as keep each below
about FILLED records of the first table, and as many tasks write them. Nothing is
collected but the numbers of the touched buckets.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrowkit import batch, cut, letters_and_digits, shared_dir

BUCKETS, FILLED = 16, 250_000
_STORED = {
    "ids": "id string, at timestamp, key binary, text_key binary, bucket int",
    "counts": "key binary, copies long, first struct<at: timestamp, id: string>, least_id string, bucket int",
    "aliases": "text_key binary, key binary",
}
_NAME = r"[^\W_][\w .\-]*?"
_ASSIGN = re.compile(rf"\s*({_NAME})\s*=\s*([^;]*?)\s*", re.S)
_LINE = re.compile(rf"\s*({_NAME})\s*:(?!//)\s*(.*?)\s*")


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def named_fields(text: str) -> list[tuple[str, str]] | None:
    """Names and values of a record of named fields, as written; None for other texts."""
    body = text.strip()
    if body[:1] == "{" and body[-1:] == "}":
        try:
            pairs = json.loads(body, object_pairs_hook=lambda x: x, parse_int=str, parse_float=str, parse_constant=str)
        except (ValueError, RecursionError):
            return None
        if isinstance(pairs, list) and pairs and all(not isinstance(v, list) for _, v in pairs):
            return [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in pairs]
        return None
    if "=" in body and ";" in body:
        parts = [p for p in body.split(";") if p.strip()]
        found = [_ASSIGN.fullmatch(p) for p in parts]
        if len(parts) > 1 and all(found):
            return [m.groups() for m in found]
    lines = [x for x in body.splitlines() if x.strip()]
    if len(lines) > 1 and ":" in lines[0]:
        found = [_LINE.fullmatch(x) for x in lines]
        if all(found):
            return [m.groups() for m in found]
    return None


def canonical_keys(text: str | None) -> tuple[bytes | None, bytes | None]:
    """Text key and field key; None where there is none."""
    if text is None or not (letters := letters_and_digits(text)):
        return None, None
    fields = named_fields(text)
    if fields is None:
        return _digest("t" + letters), None
    named = sorted((letters_and_digits(k), letters_and_digits(v)) for k, v in fields)
    return _digest("t" + letters), _digest("f" + "\x1e".join(f"{k}\x1f{v}" for k, v in named))


_KEYED = pa.schema([("id", pa.string()), ("at", pa.timestamp("us", "UTC")), ("key", pa.binary()), ("text_key", pa.binary())])


def _key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        keys = [canonical_keys(t) for t in rows.column(2).to_pylist()]
        yield batch(_KEYED, rows.column(0), rows.column(1).cast(pa.timestamp("us", "UTC")), [f or t for t, f in keys], [t if f else None for t, f in keys])


def keyed(df: DataFrame, key: Column, at: Column, text: Column) -> DataFrame:
    """``id, at, key, text_key``: one row for each row; ``text_key`` only where ``key`` is a field key."""
    rows = df.select(key.cast("string").alias("id"), at.cast("timestamp").alias("at"), text.alias("body"))
    return rows.mapInArrow(_key, "id string, at timestamp, key binary, text_key binary")


class Ledger:
    """Counts of copies by canonical key, kept over batches.

    Null texts and texts without a letter or digit are in no file. A null id is
    no record. Of an id with several texts in one batch the earliest counts,
    then the smallest key. An empty batch changes nothing.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.folder = folder or shared_dir(spark, "ledger")
        self.version = 0
        self.tables: dict[str, list[tuple[str, set[int] | None]]] = {"counts": [], "ids": [], "aliases": []}

    def _read(self, table: str) -> DataFrame | None:
        out = None
        for path, held in self.tables[table]:
            df = self.spark.read.schema(_STORED[table]).parquet(path)
            if held is not None:
                df = df.where(F.col("bucket").isin(sorted(held)))
            out = df if out is None else out.unionByName(df)
        return out

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int").alias("bucket")

    def merge(self, df: DataFrame, key: Column, at: Column, text: Column) -> "Ledger":
        """Add a batch of records."""
        self.version += 1
        rows = keyed(df, key, at, text).where("id is not null and key is not null")
        rows = rows.groupBy("id").agg(F.min(F.struct("at", "key", "text_key")).alias("first")).select("id", "first.*", self._bucket("id"))
        known = self._read("ids")
        if known is not None:
            rows = rows.join(known.select("bucket", "id"), ["bucket", "id"], "left_anti")
        fresh = f"{self.folder}/v{self.version}/new"
        rows.repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(fresh)
        if not self.spark.read.schema(_STORED["ids"]).parquet(fresh).head(1):
            return self
        new = self.spark.read.schema(_STORED["ids"]).parquet(fresh)
        self.tables["ids"].append((fresh, None))
        aliases = new.where("text_key is not null").select("text_key", "key").distinct()
        alias_path = f"{self.folder}/v{self.version}/aliases"
        aliases.write.parquet(alias_path)
        if self.spark.read.parquet(alias_path).head(1):
            self.tables["aliases"].append((alias_path, None))
        added = new.groupBy("key").agg(F.count("*").alias("copies"), F.min(F.struct("at", "id")).alias("first"), F.min("id").alias("least_id"))
        added = added.select("key", "copies", "first", "least_id", self._bucket("key"))
        touched = {r.bucket for r in added.select("bucket").distinct().collect()}
        old = self._read("counts")
        if old is not None:
            mine = old.where(F.col("bucket").isin(sorted(touched))).select("key", "bucket", F.col("copies").alias("c0"), F.col("first").alias("f0"), F.col("least_id").alias("l0"))
            added = added.join(mine, ["bucket", "key"], "full_outer").select(
                "key", (F.coalesce("copies", F.lit(0)) + F.coalesce("c0", F.lit(0))).alias("copies"), F.least("first", "f0").alias("first"), F.least("least_id", "l0").alias("least_id"), "bucket")
        path = f"{self.folder}/v{self.version}/counts"
        added.repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(path)
        kept = [(p, (set(range(self.buckets)) if h is None else h) - touched) for p, h in self.tables["counts"]]
        self.tables["counts"] = [(p, h) for p, h in kept if h] + [(path, touched)]
        return self

    def counts(self) -> DataFrame | None:
        """``key, copies, first_id, first_at, least_id`` of each file; None while empty."""
        df = self._read("counts")
        return None if df is None else df.select("key", "copies", F.col("first.id").alias("first_id"), F.col("first.at").alias("first_at"), "least_id")

    def files(self) -> DataFrame | None:
        """``key, root``: files that an alias connects share the smallest key; the others are their own."""
        counts, aliases = self.counts(), self._read("aliases")
        if counts is None:
            return None
        own = counts.select("key")
        if aliases is None:
            return own.withColumn("root", F.col("key"))
        # only text keys with a file of their own, or with several field keys, connect anything
        edges = aliases.select("text_key", "key").distinct()
        prose = edges.join(own.withColumnRenamed("key", "text_key"), "text_key", "left_semi").select("text_key").distinct()
        several = edges.groupBy("text_key").count().where("count > 1").select("text_key")
        live = edges.join(prose.unionByName(several).distinct(), "text_key", "left_semi")
        ties = cut(live.select(F.col("text_key").alias("tie"), "key").unionByName(prose.select(F.col("text_key").alias("tie"), F.col("text_key").alias("key"))))
        label = ties.select("key", F.col("key").alias("root")).distinct()
        if not ties.head(1):
            return own.withColumn("root", F.col("key"))
        while True:
            low = ties.join(label, "key").groupBy("tie").agg(F.min("root").alias("low"))
            after = cut(ties.join(low, "tie").groupBy("key").agg(F.min("low").alias("new")).join(label, "key").select("key", F.least("new", "root").alias("root"), (F.col("new") < F.col("root")).alias("moved")))
            label = after.select("key", "root")
            if not after.where("moved").head(1):
                break
        return own.join(label, "key", "left").select("key", F.coalesce("root", "key").alias("root"))

    def records(self) -> DataFrame | None:
        """``id, keep_id, copies``: each record, the smallest id of its group, and the group's size."""
        files, counts, ids = self.files(), self.counts(), self._read("ids")
        if files is None:
            return None
        groups = files.join(counts, "key").groupBy("root").agg(F.min("least_id").alias("keep_id"), F.sum("copies").alias("copies"), F.min(F.struct("first_at", "first_id")).alias("first"))
        by_key = files.join(groups, "root").where("copies > 1").select("key", "keep_id", "copies", F.col("first.first_id").alias("first_id"))
        return ids.select("id", "key").join(by_key, "key", "left").select("id", F.coalesce("keep_id", "id").alias("keep_id"), F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), F.coalesce("first_id", "id").alias("first_id"))


def ledger_of(df: DataFrame, key: Column, at: Column, text: Column, batches: int = 3, folder: str | None = None) -> Ledger:
    """A ledger fed with a table in ``batches`` equal ranges of its time column, a null time first."""
    rows = df.select(key.alias("id"), at.cast("timestamp").alias("at"), text.alias("body"))
    low, high, n = rows.agg(F.min(F.unix_micros("at")), F.max(F.unix_micros("at")), F.count("*")).first()
    ledger = Ledger(df.sparkSession, folder, max(BUCKETS, -(-n // FILLED)))
    if low is None or high == low:
        return ledger.merge(rows, F.col("id"), F.col("at"), F.col("body"))
    step = (high - low) // batches + 1
    number = F.coalesce(F.floor((F.unix_micros("at") - low) / step), F.lit(0))
    for i in range(batches):
        ledger.merge(rows.where(number == i), F.col("id"), F.col("at"), F.col("body"))
    return ledger
