"""Metric rows, unfolded from an aggregated row.

A finding is written as SQL text over the aggregated columns, so that the many
findings of a table reach Spark as one expression.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemend.constants import CHECKED, EMPTY, FAILED, SKIPPED
from tablemend.functions.columns import percentage
from tablemend.model import METRIC_COLUMNS, METRIC_SCHEMA


def literal(value: str | None) -> str:
    """A text as an SQL literal."""
    if value is None:
        return "cast(null as string)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def metric(
    table: str, dimension: str, rule: str | None, description: str,
    errors: str, total: str, status: str = CHECKED,
) -> str:
    """A metric row; ``errors`` and ``total`` are SQL over the aggregated columns."""
    return (
        f"named_struct('table_name', {literal(table)}, 'quality_dimension', {literal(dimension)}, "
        f"'rule_name', {literal(rule)}, 'issue_description', {literal(description)}, "
        f"'error_count', cast({errors} as bigint), 'total_count', cast({total} as bigint), "
        f"'status', {literal(status)})"
    )


def skipped(table: str, dimension: str, rule: str | None, description: str) -> str:
    """A check that could not be made: no errors, no rows, so it weighs nothing in a share."""
    return metric(table, dimension, rule, description, "0", "0", SKIPPED)


def empty_table(table: str, dimension: str = "6V") -> str:
    return metric(table, dimension, "Volume", "table has no rows", "0", "0", EMPTY)


def rows(findings: Sequence[str]) -> str:
    return f"array({', '.join(findings)})"


def unfold(df: DataFrame, findings: Sequence[str] | str) -> DataFrame:
    """One row per finding; a text is an SQL array of findings."""
    array = findings if isinstance(findings, str) else rows(findings)
    share = percentage("error_count", "total_count").alias("error_percentage")
    found = df.select(F.expr(f"inline({array})"))
    return found.select(*[share if c == "error_percentage" else c for c in METRIC_COLUMNS])


def metric_rows(spark: SparkSession, values: Iterable[tuple]) -> DataFrame:
    """Findings about metadata only (schemas, table names): a handful, made on the driver."""
    return spark.createDataFrame(list(values), METRIC_SCHEMA)


def isolated(spark: SparkSession, table: str, frame: DataFrame, dimension: str = "6V") -> DataFrame:
    """The metrics of one table, measured now; a failure becomes a volume row instead of an error.

    Metrics have a row per rule, so what the driver holds does not grow with the table.
    """
    try:
        return metric_rows(spark, [tuple(r) for r in frame.collect()])
    except Exception as error:
        reason = str(error).strip()
        return metric_rows(spark, [(table, dimension, "Volume", f"rows cannot be read: {reason}", 0, 0, 0.0, FAILED)])


def union_all(parts: Iterable[DataFrame]) -> DataFrame:
    """All rows of frames with the same columns, paired up so that the plan stays shallow."""
    frames = list(parts)
    while len(frames) > 1:
        pairs = [frames[i:i + 2] for i in range(0, len(frames), 2)]
        frames = [p[0].unionByName(p[1]) if len(p) == 2 else p[0] for p in pairs]
    return frames[0]
