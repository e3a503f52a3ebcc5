"""Scans. Filters on columns given here reach the files; schemas are explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CORRUPT = "_corrupt_record"


def json_rows(spark: SparkSession, path: str, schema: str, splits: list[str] | None = None) -> DataFrame:
    """JSON lines; blank lines are no rows, a malformed line ends the read with an error."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df if splits is None else df.where(F.col("split").isin(splits))


def json_rows_or_errors(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with ``file`` and ``_corrupt_record``: the line where it is malformed, null elsewhere."""
    named = StructType.fromDDL(f"{schema}, {CORRUPT} string")
    df = spark.read.schema(named).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return df.withColumn("file", F.col("_metadata.file_name"))


def json_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; lines that are no object are left out."""
    return json_rows_or_errors(spark, path, schema).where(f"{CORRUPT} is null").drop(CORRUPT, "file")


def typed_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of which every field must be there; a null or mistyped one is an error when read."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    need = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"missing field {c}"))).otherwise(F.col(c))
    return df.select(*(need(c).alias(c) for c in df.columns))


def json_documents(spark: SparkSession, path: str, schema: str, order: str | None = None, limit: int | None = None) -> DataFrame:
    """One JSON document a file, of one file or a folder; the first ``limit`` in order of a column."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    df = df if order is None else df.orderBy(order)
    return df if limit is None else df.limit(limit)


def json_line_errors(spark: SparkSession, folder: str, schema: str, keys: set[str]) -> DataFrame:
    """``file, error`` of lines in a folder that are no object, or have a missing or an unknown key."""
    lines = spark.read.text(folder).select(F.col("_metadata.file_name").alias("file"), "value").where("trim(value) <> ''")
    parsed = lines.select("file", F.from_json("value", "map<string,string>").alias("m"), "value")
    known = F.array(*map(F.lit, sorted(keys)))
    none = F.array().cast("array<string>")
    has = F.coalesce(F.map_keys("m"), none)
    missing, extra = F.array_except(known, has), F.array_except(has, known)
    error = F.when(F.col("m").isNull(), F.array(F.lit("no object"))).otherwise(F.concat(F.transform(missing, lambda k: F.concat(F.lit("missing "), k)), F.transform(extra, lambda k: F.concat(F.lit("unknown "), k))))
    return parsed.select("file", F.explode(error).alias("error"))


def csv_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def list_cell(column: str, separator: str = ";") -> Column:
    """The parts of a cell, trimmed and without empty ones."""
    return F.filter(F.transform(F.split(column, separator), lambda x: F.trim(x)), lambda x: x != "")


def parquet_rows(spark: SparkSession, path: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df if columns is None else df.select(*columns)
    return df if limit is None else df.limit(limit)


def schema_json(df: DataFrame) -> str:
    return df.schema.json()


def text_lines(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = (".json", ".jsonl", ".csv", ".md", ".txt")) -> DataFrame:
    """``file, value``: lines of all files below a folder with one of the suffixes."""
    df = spark.read.option("recursiveFileLookup", True).text(folder).select(F.col("_metadata.file_path").alias("file"), "value")
    return df.where(F.col("file").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))


def whole_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``file, value``: one row a file."""
    return spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def cached_vectors(spark: SparkSession, path: str, rows: DataFrame, key: str = "id") -> DataFrame:
    """Vectors kept from an earlier run for these rows, matched by key and by the hash of the text.

    A row whose text changed has a null vector.
    """
    kept = spark.read.parquet(path).select(key, "text_hash", "vector")
    return rows.withColumn("text_hash", F.sha2("text", 256)).join(kept, [key, "text_hash"], "left")


def earlier_stage(spark: SparkSession, path: str, columns: list[str], rows: DataFrame, key: str = "id") -> DataFrame:
    """Columns of an earlier stage's rows; a row that it lacks is an error when read."""
    there = spark.read.parquet(path).select(key, *columns, F.lit(True).alias("_there"))
    out = rows.join(there, key, "left")
    checked = F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("no earlier row for "), F.col(key).cast("string")))).otherwise(F.col(key))
    return out.withColumn(key, checked).drop("_there")
