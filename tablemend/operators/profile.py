"""Row-local checks of a table in one pass.

All rules of a table become conditional counts in a single aggregation: the scan
reads only the columns the rules need, every task keeps one row of counters, and
the only exchange is that row per task.  Where duplicate rows are counted too, the
verdicts of a row travel with its digest, so that the table is read once for both.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemend.constants import UNIQUENESS
from tablemend.functions.columns import column, quoted, resolve
from tablemend.functions.digest import packed_digest, text_columns
from tablemend.model import ColumnRule, Rule
from tablemend.operators.metrics import empty_table, metric, rows, skipped, union_all, unfold
from tablemend.operators.uniqueness import duplicate_rows

# Types whose equal values look the same to every rule (0.0 and -0.0 are equal, but other texts).
_PLAIN = (T.StringType, T.IntegralType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType,
          T.BooleanType, T.BinaryType)
_VERDICTS_IN_MARK = 62


def expand(df: DataFrame, rules: Iterable[Rule | ColumnRule]) -> list[Rule]:
    """Replace each column rule by one rule per column of ``df``."""
    out: list[Rule] = []
    for rule in rules:
        if isinstance(rule, Rule):
            out.append(rule)
            continue
        exempt = {name.lower() for name in rule.exempt}
        for name in df.columns:
            shown = name.upper() if rule.upper_names else name
            if name.lower() in exempt:
                out.append(Rule(rule.dimension, shown, f"{rule.description}: expected here",
                                lambda c: F.lit(False), (name,)))
            else:
                out.append(Rule(rule.dimension, shown, rule.description, rule.test, (name,)))
    return out


def bad_row(df: DataFrame, rule: Rule) -> Column | None:
    """The rule's test on the columns of ``df``; None if one of them is missing."""
    found = [next((n for n in need.split("|") if resolve(df, n)), None) for need in rule.needs]
    if None in found:
        return None
    return rule.test(*[column(df, name) for name in found])


def _tested(df: DataFrame, rules: Iterable[Rule | ColumnRule]) -> list[tuple[Rule, Column | None]]:
    tested = [(rule, bad_row(df, rule)) for rule in expand(df, rules)]
    return [(rule, test) for rule, test in tested if test is not None or not rule.optional]


def _findings(table: str, tested: list[tuple[Rule, Column | None]]) -> list[str]:
    return [
        skipped(table, rule.dimension, rule.name, f"not checked, column missing: {rule.description}") if test is None
        else metric(table, rule.dimension, rule.name, rule.description, f"e{i}", "n")
        for i, (rule, test) in enumerate(tested)
    ]


def profile(
    df: DataFrame, table: str, rules: Iterable[Rule | ColumnRule], volume_dimension: str = "6V"
) -> DataFrame:
    """The metrics of ``rules`` on ``df``; an empty table gives its volume row only."""
    tested = _tested(df, rules)
    # Counted as values that are there: tests then stand in the aggregation, whose code is compiled in parts.
    counters = [F.count(F.when(test, F.lit(1))).alias(f"e{i}") for i, (_, test) in enumerate(tested) if test is not None]
    counted = df.agg(F.count(F.lit(1)).alias("n"), *counters)
    found = _findings(table, tested)
    volume = rows([empty_table(table, volume_dimension)])
    return unfold(counted, f"if(n = 0, {volume}, {rows(found) if found else 'null'})")


def profile_with_duplicates(
    df: DataFrame, table: str, rules: Iterable[Rule | ColumnRule], volume_dimension: str = "6V", *,
    dimension: str = UNIQUENESS, rule: str | None = None, description: str = "duplicate rows",
) -> DataFrame:
    """The metrics of :func:`profile` and :func:`duplicate_rows`, with every row made and read once for both.

    Rows are grouped by their digest and a mark with a bit per rule, which equal rows share; copies are
    counted before the shuffle.  Tables with columns whose equal values may look different are read twice.
    """
    if not df.columns or not all(isinstance(f.dataType, _PLAIN) for f in df.schema):
        own = profile(df, table, rules, volume_dimension)
        return own.unionByName(duplicate_rows(df, table, dimension, rule, description))
    tested = _tested(df, rules)
    places = {i: divmod(nth, _VERDICTS_IN_MARK) for nth, i in enumerate(i for i, (_, t) in enumerate(tested) if t is not None)}
    marks: dict[int, Column] = {}
    for i, (mark, bit) in places.items():
        verdict = F.when(tested[i][1], F.lit(1 << bit).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        marks[mark] = marks[mark].bitwiseOR(verdict) if mark in marks else verdict
    texts = text_columns(df)
    others = [F.col(quoted(c)).alias(f"__c{i}") for i, c in enumerate(df.columns) if c not in texts]
    digest = [packed_digest(texts).alias("__texts")] if texts else []
    marked = df.select(*digest, *others, *[verdicts.alias(f"__m{m}") for m, verdicts in marks.items()])
    groups = marked.groupBy(*marked.columns).agg(F.count(F.lit(1)).alias("copies"))
    counted = groups.agg(
        F.expr("coalesce(sum(copies), 0L) as n"), F.expr("coalesce(sum(copies - 1), 0L) as surplus"),
        *[F.expr(f"sum(if(__m{m} & {1 << bit}L != 0, copies, 0L)) as e{i}") for i, (m, bit) in places.items()],
    )
    found = [*_findings(table, tested), metric(table, dimension, rule, description, "surplus", "n")]
    return unfold(counted, f"if(n = 0, {rows([empty_table(table, volume_dimension)])}, {rows(found)})")


def profile_one_by_one(df: DataFrame, table: str, rules: Iterable[Rule]) -> DataFrame:
    """The same metrics with one pass per rule: what fusing them saves, and a check on it."""
    return union_all(profile(df, table, [rule]) for rule in expand(df, rules))
