"""Reproducible defects.

Every defect is decided by a draw on the row's key, so the same rows are hit on
every run, on any number of partitions, and a test can count them beforehand.
An injection is a list of steps on one table; it is one projection, with an
explode where rows are to be duplicated, and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.functions.columns import column, quoted, require
from tablemend.functions.dates import cast_date
from tablemend.functions.draws import HashDraws
from tablemend.model import Dataset

_SEED = "__seed"
_COPY = "__copy"
# Copies of a row draw for themselves in later steps: a copy shifts the salt by this much.
_COPY_SALT = 1000


@dataclass(frozen=True)
class Branch:
    """With probability ``rate``, the value becomes ``change(value, columns)``."""

    rate: float
    change: Callable[[Column, Callable[[str], Column]], Column]


@dataclass(frozen=True)
class Corrupt:
    """Change a column.

    Branches are tried in order with a draw each, so the second of two branches
    at 5 % and 10 % hits 9.5 % of the rows.
    """

    column: str
    salt: int
    branches: tuple[Branch, ...]


@dataclass(frozen=True)
class Duplicate:
    """Add a copy of the drawn rows."""

    rate: float
    salt: int


Step = Corrupt | Duplicate


def to_null(rate: float) -> Branch:
    return Branch(rate, lambda c, _: F.lit(None).cast("string"))


def to_text(rate: float, value: str) -> Branch:
    return Branch(rate, lambda c, _: F.lit(value))


def with_prefix(rate: float, prefix: str) -> Branch:
    return Branch(rate, lambda c, _: F.concat(F.lit(prefix), c))


def as_layout(rate: float, layout: str) -> Branch:
    """The date of the value, written in another layout."""
    return Branch(rate, lambda c, _: F.date_format(cast_date(c), layout))


def in_century(rate: float, digits: str) -> Branch:
    """Force the first two digits of the year."""
    return Branch(rate, lambda c, _: F.concat(F.lit(digits), F.date_format(cast_date(c), "yy-MM-dd")))


def day_before(rate: float, other: str) -> Branch:
    """The day before the date in another column."""
    return Branch(rate, lambda c, col: F.date_sub(cast_date(col(other)), 1).cast("string"))


def inject(df: DataFrame, steps: Sequence[Step], keys: Sequence[str | Column], draws=None) -> DataFrame:
    """Apply ``steps`` in order; ``keys`` identify a row for the draws.

    The seed is taken from the keys before any step, so that a step may corrupt
    a key column without changing later draws.
    """
    draws = draws or HashDraws()
    key_columns = [k if isinstance(k, Column) else column(df, k) for k in keys]
    out = df.withColumn(_SEED, draws.seed(key_columns))
    copied = any(isinstance(s, Duplicate) for s in steps)
    if copied:
        out = out.withColumn(_COPY, F.lit(0))

    def drawn(salt: int, rate: float, after_copy: bool) -> Column:
        return draws.below(_SEED, f"{salt} + {_COPY_SALT} * {_COPY}" if after_copy else str(salt), rate)

    after_copy = False
    for step in steps:
        if isinstance(step, Duplicate):
            copies = F.when(drawn(step.salt, step.rate, after_copy), F.array(F.lit(0), F.lit(1)))
            out = out.withColumn(_COPY, F.explode(copies.otherwise(F.array(F.lit(0)))))
            after_copy = True
            continue
        name = require(out, step.column)
        value = F.col(quoted(name))
        changed = None
        for i, branch in enumerate(step.branches):
            hit = drawn(step.salt + i, branch.rate, after_copy)
            new = branch.change(value, lambda other: column(out, other)).cast("string")
            changed = F.when(hit, new) if changed is None else changed.when(hit, new)
        out = out.withColumn(name, changed.otherwise(value.cast("string")))
    return out.drop(_SEED, _COPY)


@dataclass(frozen=True)
class InjectionPlan:
    table: str
    keys: tuple[str, ...]
    steps: tuple[Step, ...]


def inject_dataset(ds: Dataset, plans: Sequence[InjectionPlan], draws=None) -> Dataset:
    """Every planned table with its defects; tables without a plan as they are."""
    by_table = {p.table: p for p in plans}
    return {
        name: inject(df, by_table[name].steps, by_table[name].keys, draws) if name in by_table else df
        for name, df in ds.items()
    }
