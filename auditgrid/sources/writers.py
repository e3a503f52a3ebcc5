"""Sinks. Published results carry metadata and scores, never raw text."""

from __future__ import annotations

import html
import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from ..functions import columns as C
from ..functions.fixed import RAW_TEXT_FIELDS


def _fields(kind: DataType, at: str = "") -> Iterable[tuple[str, str, DataType]]:
    if isinstance(kind, StructType):
        for f in kind:
            yield f.name, f"{at}.{f.name}".strip("."), f.dataType
            yield from _fields(f.dataType, f"{at}.{f.name}")
    elif isinstance(kind, ArrayType):
        yield from _fields(kind.elementType, at)
    elif isinstance(kind, MapType):
        yield from _fields(kind.valueType, at)


def raw_text_fields(df: DataFrame, barred: Iterable[str] = RAW_TEXT_FIELDS) -> list[str]:
    """Paths of fields, at any depth, that must not be published."""
    barred = set(barred)
    return [path for name, path, _ in _fields(df.schema) if name in barred]


def checked(df: DataFrame) -> DataFrame:
    if bad := raw_text_fields(df):
        raise ValueError(f"fields of raw text: {', '.join(bad)}")
    return df


def private_values(df: DataFrame) -> Column:
    """True where a string at any depth holds a link or a mail address."""
    whole = F.to_json(F.struct(*(F.col(c) for c in df.columns)))
    return C.has_url(whole) | C.has_mail(whole)


def write_rows(df: DataFrame, path: str, kind: str = "json", by: list[str] | None = None) -> None:
    """Write metadata rows; raw text fields are an error before anything is written."""
    writer = checked(df).write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).format(kind).save(path)


def write_each(df: DataFrame, path: str, key: str) -> None:
    """A folder with one JSON file for each value of a key of unique values; raw text fields are an error."""
    checked(df).repartition(key).write.mode("errorifexists").partitionBy(key).json(path)


def pretty_json(df: DataFrame) -> Column:
    """Columns as indented JSON, keys sorted, nulls kept."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false", "pretty": "true"})


def canonical_json(df: DataFrame) -> Column:
    """Columns as JSON, keys sorted, nulls kept."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"})


def canonical_hash(df: DataFrame) -> Column:
    return F.sha2(canonical_json(df), 256)


def file_hashes(df: DataFrame, path_column: str = "path", content: str = "content") -> DataFrame:
    """``line``: hash and name of binary files, as a checksum file has them."""
    return df.select(F.concat(F.sha2(content, 256), F.lit("  "), F.regexp_extract(path_column, r"([^/]+)$", 1)).alias("line"))


def manifest(df: DataFrame, by: list[str], checks: dict[str, Column]) -> DataFrame:
    """One row: number of records, counts by column values, and the outcome of checks, as JSON."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias("value")) for c in by))).alias("c")).groupBy("c.field", "c.value").agg(F.count("*").alias("n"))
    one_field = long.groupBy("field").agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias("counts"))
    tables = one_field.agg(F.to_json(F.array_sort(F.collect_list(F.struct("field", "counts")))).alias("counts"))
    total = df.agg(F.count("*").alias("records"), *(F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(True)).alias(n) for n, c in checks.items()))
    one = total.withColumn("_k", F.lit(1)).join(tables.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return one.select("records", *checks, "counts")


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A table of aggregated rows, in their order; more than ``most`` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows aren't a report")
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(df.columns), line(["-"] * len(df.columns)), *map(line, rows)]) + "\n"


def html_table(df: DataFrame, title: str, most: int = 1000) -> str:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows aren't a report")
    cells = lambda tag, row: "<tr>" + "".join(f"<{tag}>{html.escape(str(c))}</{tag}>" for c in row) + "</tr>"
    return f"<h1>{html.escape(title)}</h1><table>{cells('th', df.columns)}{''.join(cells('td', r) for r in rows)}</table>"


def sorted_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, indent=2)
