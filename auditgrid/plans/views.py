"""The evaluation tables that queries start from, as DataFrames and as SQL.

Rows that a delivery repeats are one record, so each view has a record once.
Repeats have equal values, so distinct rows of the needed columns are the
records, which keeps what is shuffled narrow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C

SCORED = ("id", "split", "label", "attack_class", "benign_subclass", "bypass_class", "source_type", "trust_level", "expected_action", "contains_sensitive_sink", "requires_tool_call", "margin", "threshold_tau", "pred_attack")
FIELDS = ("attack_class", "benign_subclass", "bypass_class", "source_type", "trust_level", "expected_action")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rows4(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Corpus records of round 4: id and the named columns."""
    return table(spark, folder, "corpus_v4").select("id", *columns).distinct()


def each4(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Corpus records of round 4 as often as they were delivered, for queries that end in distinct rows.

    What a query makes of a text is narrower than the text, so repeats are dropped
    after that.
    """
    return table(spark, folder, "corpus_v4").select("id", *columns)


def spread(df: DataFrame) -> DataFrame:
    """The rows in at least as many partitions as there are cores, for slow functions of few files.

    A table with as many partitions is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def rows7(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Corpus records of round 7: id and the named columns."""
    return table(spark, folder, "corpus_v7").select("id", *columns).distinct()


def scored(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Scored records as last scored, with the named columns (default: all).

    A record may be scored twice with other values, so these aren't repeats.
    """
    names = columns or SCORED[1:]
    last = table(spark, folder, "embed_rows").groupBy("id").agg(F.max_by(F.struct(*names), "scored_at").alias("r"))
    return last.select("id", "r.*")


def judged(spark: SparkSession, folder: str, split: str, *columns: str) -> DataFrame:
    """Scored records of a split that have a margin, with the truth as a boolean.

    With ``columns`` only these are read, beside id, split, label and margin.
    """
    rows = scored(spark, folder, *(("split", "label", "margin", *columns) if columns else ()))
    return rows.where((F.col("split") == split) & F.col("margin").isNotNull()).withColumn("truth", F.col("label") == "attack")


def second(df: DataFrame) -> DataFrame:
    """A second score for paired comparisons: the margin, shifted by a structural rule."""
    shift = F.when(C.r1(), 0.03).otherwise(-0.01)
    return df.withColumn("margin2", F.round(F.col("margin") + shift, 8))


def traces(spark: SparkSession, folder: str) -> DataFrame:
    """Tool calls."""
    return table(spark, folder, "tool_traces").drop("loaded_at").distinct()


R4 = "rows4 AS (SELECT DISTINCT ON (id) * FROM corpus_v4)"
R7 = "rows7 AS (SELECT DISTINCT ON (id) * FROM corpus_v7)"
S = "scored AS (SELECT DISTINCT ON (id) * FROM embed_rows ORDER BY id, scored_at DESC)"
VAL = S + ", val AS (SELECT *, label = 'attack' AS truth FROM scored WHERE split = 'validation' AND margin IS NOT NULL)"
TEST = S + ", test AS (SELECT *, label = 'attack' AS truth FROM scored WHERE split = 'test' AND margin IS NOT NULL)"
BOTH = VAL + ", test AS (SELECT *, label = 'attack' AS truth FROM scored WHERE split = 'test' AND margin IS NOT NULL)"
T = "traces AS (SELECT DISTINCT ON (trace_id) * FROM tool_traces)"
#: Structural rules as SQL over a row's columns.
R1 = "coalesce(trust_level = 'untrusted', false) AND coalesce(requires_tool_call, false)"
COARSE = "CASE WHEN source_type = 'tool_result' OR trust_level = 'tool_output' THEN 'tool_result' WHEN source_type = 'user' OR trust_level = 'authenticated_user' THEN 'user' ELSE 'other' END"
R2 = f"(coalesce(contains_sensitive_sink, false) AND ({COARSE}) <> 'user')"
SECOND = f"round(margin + CASE WHEN {R1} THEN 0.03::double ELSE -0.01::double END, 8)"

_Z = 1.959963984540054


def wilson(hits: str, total: str, sign: str) -> str:
    """SQL of an interval's bound."""
    return f"(CASE WHEN {total} > 0 THEN (({hits})::double / {total} + {_Z * _Z}::double / (2 * {total}) {sign} {_Z}::double * sqrt((({hits})::double / {total} * (1 - ({hits})::double / {total}) + {_Z * _Z}::double / (4 * {total})) / {total})) / (1 + {_Z * _Z}::double / {total}) END)"


def ratio(a: str, b: str, empty: str = "0.0::double") -> str:
    return f"(CASE WHEN ({b}) > 0 THEN ({a})::double / ({b}) ELSE {empty} END)"


def base_rate(recall: str, fpr: str, n: int, empty: str = "0.0::double") -> str:
    p = f"(1::double / {n + 1})"
    return ratio(f"({recall} * {p})", f"{recall} * {p} + {fpr} * (1 - {p})", empty)


_RECALL, _FPR = ratio("tp", "tp + fn"), ratio("fp", "fp + tn")
#: The metric block over columns tp, fn, fp, tn.
BLOCK = f"""tp + fn AS attacks, fp + tn AS benign, round({_RECALL}, 9) AS recall, round({wilson('tp', '(tp + fn)', '-')}, 9) AS recall_low,
round({wilson('tp', '(tp + fn)', '+')}, 9) AS recall_high, round({_FPR}, 9) AS fpr, round({wilson('fp', '(fp + tn)', '-')}, 9) AS fpr_low,
round({wilson('fp', '(fp + tn)', '+')}, 9) AS fpr_high, round({_FPR} * 1000, 9) AS fp_per_1k,
round({base_rate(_RECALL, _FPR, 100)}, 9) AS precision_100, round({base_rate(_RECALL, _FPR, 1000)}, 9) AS precision_1000"""


def counted(pred: str) -> str:
    """Counts over truth and a prediction."""
    p = f"coalesce({pred}, false)"
    return f"count(*) FILTER (truth AND {p}) AS tp, count(*) FILTER (truth AND NOT {p}) AS fn, count(*) FILTER (NOT truth AND {p}) AS fp, count(*) FILTER (NOT truth AND NOT {p}) AS tn"


def by_fields(source: str, fields: tuple[str, ...], aggregates: str, overall: bool = True) -> str:
    """field, value and aggregates: grouping sets over fields, nulls as missing."""
    inner = ", ".join(f"coalesce({f}::varchar, 'missing') AS _{f}" for f in fields)
    sets = ", ".join([f"(_{f})" for f in fields] + (["()"] if overall else []))
    field = " ".join(f"WHEN grouping(_{f}) = 0 THEN '{f}'" for f in fields)
    value = " ".join(f"WHEN grouping(_{f}) = 0 THEN _{f}" for f in fields)
    return f"SELECT CASE {field} ELSE 'overall' END AS field, CASE {value} ELSE 'all' END AS value, {aggregates} FROM (SELECT *, {inner} FROM {source}) GROUP BY GROUPING SETS ({sets})"
