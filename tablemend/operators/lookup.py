"""Attach facts about a key to every row that uses it, whatever the sizes and the skew.

A lookup has one row per key, so attaching it never multiplies rows.  It is
broadcast if an estimate of its size is below the session's broadcast limit;
otherwise the engine chooses the join.  Building the plan runs no job.  Rows without
a key are spread over all tasks; a key with a large share of the
rows is one side of a left join, whose partitions the adaptive engine splits.
No word that stands for a missing value is a key, on either side.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemend.functions.columns import column, fold, quoted
from tablemend.functions.predicates import stands_for_missing
from tablemend.sources.sinks import Steps

KEY = "__key"
_SPREAD = "__spread"
# Columnar files unpack to a multiple of their size, which is what Spark estimates from.
_UNPACKED = 4
# Places per shuffle partition over which rows without a key are dealt out.
_FINENESS = 8

_UNITS = {"": 1, "b": 1, "k": 2**10, "kb": 2**10, "m": 2**20, "mb": 2**20,
          "g": 2**30, "gb": 2**30, "t": 2**40, "tb": 2**40}


def broadcast_limit(spark: SparkSession) -> int:
    """spark.sql.autoBroadcastJoinThreshold in bytes; -1 forbids broadcasting."""
    setting = spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower()
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", setting).groups()
    return int(number) * _UNITS[unit]


def estimated_bytes(df: DataFrame) -> int:
    """Spark's size estimate of ``df``, raised to what it may take in memory."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) * _UNPACKED


@dataclass(frozen=True)
class Lookup:
    """One row per key (column ``KEY``), and an estimate of its size."""

    rows: DataFrame
    estimate: int

    @property
    def facts(self) -> list[str]:
        return [c for c in self.rows.columns if c != KEY]


def lookup(df: DataFrame, key: Column, **facts: Column) -> Lookup:
    """The keys of ``df``, each with the aggregated ``facts``; NULL and marks of missing values are none."""
    keyed = df.withColumn(KEY, key).filter(~stands_for_missing(F.col(KEY)))
    rows = keyed.groupBy(KEY).agg(*[c.alias(name) for name, c in facts.items()]) if facts \
        else keyed.select(KEY).distinct()
    return Lookup(rows, estimated_bytes(rows))


def known_keys(df: DataFrame, name: str, marker: str) -> Lookup:
    """The keys in a column, folded, with a true ``marker`` to tell a match from none."""
    keys = lookup(df, fold(column(df, name)))
    return Lookup(keys.rows.withColumn(marker, F.lit(True)), keys.estimate)


def attach(df: DataFrame, key: Column, facts: Lookup, limit: int | None = None, steps: Steps | None = None) -> DataFrame:
    """Left join of ``facts`` on ``key``, a text: every row of ``df`` once, NULL facts where no key matches.

    With ``steps``, rows that were shuffled before are written there before they are shuffled again."""
    spark = df.sparkSession
    limit = broadcast_limit(spark) if limit is None else limit
    columns = [F.col(quoted(c)) for c in df.columns]
    if steps is not None and facts.estimate > limit:
        df = steps.cut(df)
    keyed = df.withColumn(KEY, key)
    if facts.estimate <= limit:
        return keyed.join(F.broadcast(facts.rows), KEY, "left").select(*columns, *facts.facts)
    # Rows without a key get texts that no key equals, by their content and the partition they are in: equal rows are spread
    # too, and a task that is run again reads the same partition and deals alike.
    places = int(spark.conf.get("spark.sql.shuffle.partitions")) * _FINENESS
    hashable = [F.col(quoted(f.name)) for f in df.schema if "map<" not in f.dataType.simpleString()]
    place = F.pmod(F.xxhash64(F.spark_partition_id(), *hashable), F.lit(places)).cast("string")
    left = keyed.withColumn(_SPREAD, F.coalesce(F.col(KEY), F.concat(F.lit("\x00"), place)))
    right = facts.rows.withColumnRenamed(KEY, _SPREAD)
    return left.join(right, _SPREAD, "left").select(*columns, *facts.facts)


def matched_rows(
    df: DataFrame, key: Column, facts: Lookup, hit: Column, limit: int | None = None
) -> DataFrame:
    """One row: ``n`` rows of ``df``, and ``e`` of them whose key has facts that satisfy ``hit``.

    Rows are counted per key first, so the lookup sees each key once.
    """
    rows = df.select(key.alias("__used")).groupBy("__used").agg(F.count(F.lit(1)).alias("__rows"))
    joined = attach(rows, F.col("__used"), facts, limit)
    return joined.agg(
        F.coalesce(F.sum("__rows"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(hit, F.col("__rows"))), F.lit(0)).alias("e"),
    )
