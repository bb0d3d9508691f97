"""Summaries of metrics.

Metrics have a row per table and rule, whatever the size of the measured tables,
so the reports order and rank them without further precautions.  Skipped checks
carry no rows and so no weight.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemend.constants import DIMENSION_NAMES, SEVERITY_LEVELS
from tablemend.functions.columns import percentage

KEY = ["table_name", "quality_dimension", "rule_name", "issue_description"]


def dimension_share(metrics: DataFrame) -> DataFrame:
    """Weighted error share per table and dimension."""
    return (
        metrics.filter(F.col("total_count") > 0)
        .groupBy("table_name", "quality_dimension")
        .agg(F.sum("error_count").alias("errors"), F.sum("total_count").alias("total"))
        .select("table_name", "quality_dimension", percentage("errors", "total").alias("error_percentage"))
        .orderBy("table_name", "quality_dimension")
    )


def _mean(pct: Column) -> Column:
    """Mean of percentages with two places, rounded half up to two places, exactly."""
    hundredths, n = F.sum(F.round(pct * 100).cast("bigint")), F.count(pct)
    return (hundredths * 2 + n - (hundredths * 2 + n) % (n * 2)) / (n * 2) / F.lit(100.0)


def matrix(shares: DataFrame, dimensions: Sequence[str] | None = None, fill: bool = False) -> DataFrame:
    """Tables by dimensions; ``fill`` puts 0 where a table has no such dimension."""
    pivot = shares.groupBy("table_name").pivot("quality_dimension", list(dimensions) if dimensions else None)
    out = pivot.agg(F.avg("error_percentage"))
    return out.na.fill(0.0) if fill else out


def dimension_ranking(shares: DataFrame) -> DataFrame:
    """Dimensions by mean share over the tables that have them, worst first."""
    return _ranked(shares, "quality_dimension")


def table_ranking(shares: DataFrame) -> DataFrame:
    """Tables by mean share over the dimensions they have, worst first."""
    return _ranked(shares, "table_name")


def _ranked(shares: DataFrame, by: str) -> DataFrame:
    means = shares.groupBy(by).agg(_mean(F.col("error_percentage")).alias("mean_percentage"))
    order = Window.orderBy(F.desc("mean_percentage"), by)
    return means.withColumn("rank", F.row_number().over(order))


def stacked(shares: DataFrame) -> DataFrame:
    """Where each dimension's segment starts and ends in a stacked bar of its table.

    A dimension that a table lacks would be a segment without width, and has no row.
    """
    ranking = dimension_ranking(shares).select("quality_dimension", F.col("rank").alias("dim_rank"))
    cells = shares.join(ranking, "quality_dimension")
    before = Window.partitionBy("table_name").orderBy("dim_rank").rowsBetween(Window.unboundedPreceding, -1)
    start = F.round(F.coalesce(F.sum("error_percentage").over(before), F.lit(0.0)), 2)
    return cells.withColumn("bar_start", start).withColumn(
        "bar_end", F.round(F.col("bar_start") + F.col("error_percentage"), 2)
    ).select("table_name", "quality_dimension", "dim_rank", "bar_start", "error_percentage", "bar_end")


def severity(shares: DataFrame) -> DataFrame:
    """The threshold that a share has reached."""
    level = F.lit("ok")
    for limit, name in reversed(SEVERITY_LEVELS):
        level = F.when(F.col("error_percentage") >= limit, F.lit(name)).otherwise(level)
    return shares.withColumn("severity", level)


# The headings of the detail listing.
DETAIL_HEADINGS = {
    "id": "Nr.",
    "table_name": "Datne",
    "quality_dimension": "DK dimensija",
    "rule_name": "Nosacījums",
    "issue_description": "Kļūdas apraksts",
    "error_count": "Kļūdu sk.",
    "total_count": "Kopējais rindu sk.",
    "error_percentage": "% kļūda",
    "checked_at": "Izskatīšanas datums",
}


def detail(stored: DataFrame) -> DataFrame:
    """The stored metrics under their headings, oldest first."""
    ordered = stored.orderBy("checked_at", "id")
    return ordered.select(*[F.col(c).alias(heading) for c, heading in DETAIL_HEADINGS.items()])


def by_dimension(metrics: DataFrame) -> DataFrame:
    """Errors per dimension, under its full name where it has one."""
    names = F.create_map(*[F.lit(x) for pair in DIMENSION_NAMES.items() for x in pair])
    full = F.coalesce(F.try_element_at(names, F.col("quality_dimension")), F.col("quality_dimension"))
    return metrics.groupBy("quality_dimension").agg(F.sum("error_count").alias("error_count")).select(
        "quality_dimension", full.alias("dimension_name"), "error_count"
    )


def by_table(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("table_name").agg(F.sum("error_count").alias("error_count"))


def top_rules(metrics: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` rules with the most errors; metrics without a rule name are left out."""
    return (
        metrics.filter(F.col("rule_name").isNotNull())
        .groupBy("table_name", "rule_name")
        .agg(F.sum("error_count").alias("error_count"))
        .orderBy(F.desc("error_count"), "table_name", "rule_name")
        .limit(n)
    )


def before_after(before: DataFrame, after: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Two measurements side by side; a check that only one of them made is kept."""
    def shown(metrics: DataFrame, suffix: str) -> DataFrame:
        return metrics.groupBy(*key).agg(
            F.sum("error_count").alias(f"errors_{suffix}"), F.sum("total_count").alias(f"total_{suffix}")
        ).select(
            *[F.col(k).alias(f"{k}_{suffix}") for k in key], f"errors_{suffix}", f"total_{suffix}",
            percentage(f"errors_{suffix}", f"total_{suffix}").alias(f"pct_{suffix}"),
        )

    old, new = shown(before, "before"), shown(after, "after")
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"{k}_before").eqNullSafe(F.col(f"{k}_after"))
    return old.join(new, same, "full").select(
        *[F.coalesce(F.col(f"{k}_before"), F.col(f"{k}_after")).alias(k) for k in key],
        "errors_before", "errors_after", "pct_before", "pct_after",
        (F.col("errors_after") - F.col("errors_before")).alias("errors_delta"),
        F.round(F.col("pct_after") - F.col("pct_before"), 2).alias("pct_delta"),
    )


def across_snapshots(snapshots: DataFrame, runs: Sequence[str], key: Sequence[str] = KEY) -> DataFrame:
    """A row per check over any number of snapshots (metrics with run_id), in the order of ``runs``.

    ``errors_<run>`` and ``pct_<run>`` are NULL where a run did not make the check.  A change is a share of errors other than in
    the run before that made the check; ``first_change`` and ``last_change`` are the runs with the first and the last one.
    """
    place = F.array_position(F.array(*[F.lit(r) for r in runs]), F.col("run_id")).cast("int")
    chosen = snapshots.filter(F.col("run_id").isin(*runs))
    summed = chosen.groupBy(*key, "run_id").agg(F.sum("error_count").alias("errors"), F.sum("total_count").alias("total")).select(
        *key, "run_id", place.alias("place"), "errors", percentage("errors", "total").alias("pct"))
    before = F.lag("pct").over(Window.partitionBy(*key).orderBy("place"))
    marked = summed.withColumn("changed", F.coalesce(F.col("pct") != before, F.lit(False)))
    told = marked.groupBy(*key).agg(
        F.count_if("changed").alias("changes"),
        F.min_by("run_id", F.when(F.col("changed"), F.col("place"))).alias("first_change"),
        F.max_by("run_id", F.when(F.col("changed"), F.col("place"))).alias("last_change"),
        *[F.max(F.when(F.col("run_id") == r, F.col(c))).alias(f"{c}_{r}") for r in runs for c in ("errors", "pct")],
    )
    columns = [f"`{c}_{r}`" for r in runs for c in ("errors", "pct")]
    return told.select(*key, *columns, "changes", "first_change", "last_change")
