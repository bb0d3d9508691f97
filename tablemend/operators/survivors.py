"""One row per declared key: the fullest, then the newest, then the one of the smallest digest.

The best row is a grouped maximum, so a key with a third of all rows reaches its reducer as one row per task.
Rows whose key is missing, or a word that stands for a missing value, are nobody's copies and all stay.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.constants import UNIQUENESS
from tablemend.functions.columns import column, quoted, resolve
from tablemend.functions.dates import lenient_date
from tablemend.functions.predicates import effectively_empty, stands_for_missing
from tablemend.model import Dataset, TableSpec
from tablemend.operators.cells import row_digest
from tablemend.operators.metrics import metric, skipped, union_all, unfold
from tablemend.operators.uniqueness import row_groups


def _without_key(df: DataFrame, key: Sequence[str]) -> Column:
    lost = F.lit(False)
    for k in key:
        lost = lost | stands_for_missing(column(df, k))
    return lost


def _rank(df: DataFrame, newest: str | None) -> Column:
    """What is greater for a better row: filled cells, the date, and the reversed digest for the rest."""
    filled = sum((F.when(effectively_empty(F.col(quoted(c))), 0).otherwise(1) for c in df.columns), F.lit(0))
    date = lenient_date(column(df, newest).cast("string")) if newest and resolve(df, newest) else F.lit(None).cast("date")
    smallest = F.translate(row_digest(df), "0123456789abcdef", "fedcba9876543210")
    return F.struct(filled.alias("filled"), F.coalesce(date, F.lit("0001-01-01").cast("date")).alias("day"), smallest.alias("digest"))


def survivors(df: DataFrame, key: Sequence[str], newest: str | None = None) -> DataFrame:
    """The best row of every key, and all rows without a key; columns as they were."""
    lost = _without_key(df, key)
    row = F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("row")
    ranked = df.filter(~lost).select(*[column(df, k).alias(f"__k{i}") for i, k in enumerate(key)],
                                     F.struct(_rank(df, newest).alias("rank"), row).alias("__best"))
    best = ranked.groupBy(*[f"__k{i}" for i in range(len(key))]).agg(F.max("__best").alias("__best"))
    kept = best.select(*[F.col(f"__best.row.{quoted(c)}").alias(c) for c in df.columns])
    return kept.unionByName(df.filter(lost))


def rejected(df: DataFrame, key: Sequence[str], newest: str | None = None) -> DataFrame:
    """The rows that another row of their key displaces, once each, with ``__copies`` of them, ``__filled`` and ``__best_filled``."""
    keyed = df.filter(~_without_key(df, key))
    rows = keyed.groupBy(*[F.col(quoted(c)) for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    ranked = rows.withColumn("__rank", _rank(df, newest))
    names = [f"__k{i}" for i in range(len(key))]
    own = keyed.select(*[column(df, k).alias(n) for n, k in zip(names, key)], _rank(df, newest).alias("__r"))
    best = own.groupBy(*names).agg(F.max("__r").alias("__best"))
    same = F.lit(True)
    for n, k in zip(names, key):
        same = same & (column(df, k) == F.col(n))
    met = ranked.join(best, same)
    copies = F.col("__n") - F.when(F.col("__rank") == F.col("__best"), 1).otherwise(0)
    return met.withColumn("__copies", copies).filter("__copies > 0").select(
        *[F.col(quoted(c)) for c in df.columns], "__copies", F.col("__rank.filled").alias("__filled"), F.col("__best.filled").alias("__best_filled"))


def key_profile(ds: Dataset, specs: Mapping[str, TableSpec], dimension: str = UNIQUENESS) -> DataFrame:
    """Two metrics per table with a declared key: rows beyond the first of their key, and rows without one."""
    parts = []
    for name, df in ds.items():
        key = specs[name].primary_key if name in specs else ()
        if not key:
            continue
        label = "+".join(key)
        if any(resolve(df, k) is None for k in key):
            parts.append(unfold(df.sparkSession.range(1), [skipped(name, dimension, label, "declared key, column missing")]))
            continue
        columns = [column(df, k).alias(f"k{i}") for i, k in enumerate(key)]
        groups = row_groups(df.select(*columns, _without_key(df, key).alias("lost")), by_digest=False)
        counted = groups.agg(
            F.coalesce(F.sum("copies"), F.lit(0)).alias("n"),
            F.coalesce(F.sum(F.when(~F.col("lost"), F.col("copies") - 1)), F.lit(0)).alias("surplus"),
            F.coalesce(F.sum(F.when(F.col("lost"), F.col("copies"))), F.lit(0)).alias("lost"),
        )
        parts.append(unfold(counted, [
            metric(name, dimension, label, "declared key repeated", "surplus", "n"),
            metric(name, dimension, label, "declared key missing", "lost", "n"),
        ]))
    return union_all(parts)
