"""Duplicate rows and repeated keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemend.constants import UNIQUENESS
from tablemend.functions.columns import column, quoted
from tablemend.functions.digest import packed_digest, text_columns
from tablemend.operators.metrics import metric, unfold


def row_groups(df: DataFrame, by_digest: bool = True) -> DataFrame:
    """``copies`` of every distinct row.

    Grouping counts copies before the shuffle, so a row that fills a third of
    the table reaches its reducer as one counter per task.  The texts of a row
    are grouped by their SHA-256, so 32 bytes travel instead of all of them.
    """
    texts = text_columns(df) if by_digest else []
    if texts:
        others = [F.col(quoted(c)) for c in df.columns if c not in texts]
        df = df.select(packed_digest(texts).alias("__texts"), *others)
    return df.groupBy(*[F.col(quoted(c)) for c in df.columns]).agg(F.count(F.lit(1)).alias("copies"))


def _surplus(groups: DataFrame) -> DataFrame:
    return groups.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("surplus"),
    )


def duplicate_rows(
    df: DataFrame, table: str, dimension: str = UNIQUENESS, rule: str | None = None,
    description: str = "duplicate rows", by_digest: bool = True,
) -> DataFrame:
    """Rows beyond the first of their kind (total - distinct); an empty table gives no metric."""
    counted = _surplus(row_groups(df, by_digest)).filter("n > 0")
    return unfold(counted, [metric(table, dimension, rule, description, "surplus", "n")])


def duplicate_keys(df: DataFrame, table: str, key: Sequence[str], dimension: str = UNIQUENESS) -> DataFrame:
    """Rows beyond the first of their declared primary key; a NULL counts as a key value."""
    groups = row_groups(df.select(*[column(df, k) for k in key]))
    return unfold(
        _surplus(groups).filter("n > 0"),
        [metric(table, dimension, "+".join(key), "repeated primary key", "surplus", "n")],
    )


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()
