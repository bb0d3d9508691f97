"""Checks of a row against attributes of its parent."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemend.functions.columns import column, fold, resolve
from tablemend.model import CrossRule
from tablemend.operators.lookup import Lookup, attach, lookup
from tablemend.operators.metrics import metric, skipped, unfold


def cross_profile(
    df: DataFrame, table: str, fk: str, parent: DataFrame, pk: str,
    facts: Mapping[str, Column], rules: Sequence[CrossRule], limit: int | None = None,
) -> DataFrame:
    """Metrics of ``rules`` over the rows of ``df`` and ``facts`` of their parents.

    ``facts`` are aggregates over the parent rows of a key (parents may come in
    copies).  The child's half of each rule is taken first: only its value travels, and only
    rows that can fail meet only parents that matter.  The child is read once.  All rules share one lookup, keys are
    compared without case, and every row counts at most once.
    """
    lost = [n for r in rules for n in (fk, *r.needs) if resolve(df, n) is None]
    if lost or resolve(parent, pk) is None:
        why = f"column missing: {', '.join(lost) or pk}"
        one = df.sparkSession.range(1)
        return unfold(one, [skipped(table, r.dimension, r.name, f"not checked, {why}") for r in rules])
    halves = df.select(
        fold(column(df, fk)).alias("__fk"),
        *[r.child(*[column(df, n) for n in r.needs]).alias(f"__h{i}") for i, r in enumerate(rules)],
    )
    can_fail = F.lit(False)
    for i in range(len(rules)):
        half = F.col(f"__h{i}")
        is_flag = isinstance(halves.schema[f"__h{i}"].dataType, T.BooleanType)
        can_fail = can_fail | (F.coalesce(half, F.lit(False)) if is_flag else half.isNotNull())
    known = lookup(parent, fold(column(parent, pk)), **facts)
    if all(r.matters for r in rules):
        matter = F.lit(False)
        for r in rules:
            matter = matter | F.coalesce(r.matters(*[F.col(n) for n in r.facts]), F.lit(False))
        known = Lookup(known.rows.filter(matter), known.estimate)
    # All rows pass, once; those that cannot fail have no key and so meet nobody.
    keyed = halves.withColumn("__fk", F.when(can_fail, F.col("__fk")))
    joined = attach(keyed, F.col("__fk"), known, limit)
    tests = [r.test(F.col(f"__h{i}"), *[F.col(n) for n in r.facts]) for i, r in enumerate(rules)]
    counted = joined.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(t & F.col("__fk").isNotNull()).alias(f"e{i}") for i, t in enumerate(tests)])
    return unfold(counted, [
        metric(table, r.dimension, r.name, r.description, f"e{i}", "n")
        for i, r in enumerate(rules)
    ])
