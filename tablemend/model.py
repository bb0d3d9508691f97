"""Declarative specifications and the schemas of the two result tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

Dataset = dict[str, DataFrame]

METRIC_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("quality_dimension", T.StringType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("issue_description", T.StringType()),
    T.StructField("error_count", T.LongType()),
    T.StructField("total_count", T.LongType()),
    T.StructField("error_percentage", T.DoubleType()),
    T.StructField("status", T.StringType()),
])
METRIC_COLUMNS = METRIC_SCHEMA.names

INTEGRITY_SCHEMA = T.StructType([
    T.StructField("table_name", T.StringType()),
    T.StructField("metric_type", T.StringType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("raw_count", T.LongType()),
    T.StructField("total_count", T.LongType()),
])


@dataclass(frozen=True)
class Rule:
    """A row-local check: ``test`` gets the columns named in ``needs`` and is true for a bad row.

    "A|B" needs A, or B if there is no A.  Where a column is missing the rule is
    reported as skipped, or left out if it is ``optional``.
    """

    dimension: str
    name: str
    description: str
    test: Callable[..., Column]
    needs: tuple[str, ...] = ()
    optional: bool = False


@dataclass(frozen=True)
class CrossRule:
    """A check of a row against facts about its parent, cut in halves so that few rows have to meet.

    ``child`` makes one value of the columns in ``needs``; rows where it is NULL or false are
    fine.  ``matters`` is true for the parents that a row can fail with (None: all).  ``test`` gets that
    value and the ``facts`` and is true for a bad row.
    """

    dimension: str
    name: str
    description: str
    needs: tuple[str, ...]
    child: Callable[..., Column]
    facts: tuple[str, ...]
    matters: Callable[..., Column] | None
    test: Callable[..., Column]


@dataclass(frozen=True)
class ColumnRule:
    """The same row-local check on every column of a table."""

    dimension: str
    description: str
    test: Callable[[Column], Column]
    upper_names: bool = False
    # Columns in which the finding is expected: they are reported with 0 errors.
    exempt: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Via:
    """The detour of a chained key repair: child.column -> table.key, then take ``payload``."""

    column: str
    table: str
    key: str
    payload: str


@dataclass(frozen=True)
class FkRule:
    table: str
    column: str
    ref_table: str
    ref_column: str
    via: Via | None = None

    @property
    def target(self) -> str:
        return f"{self.ref_table}.{self.ref_column}"

    @property
    def label(self) -> str:
        return f"{self.column}→{self.target}"


@dataclass(frozen=True)
class Fix:
    """A correction of some columns.

    ``apply`` gets the columns and returns the new ones.  With ``prepare``, which
    gets the columns first, ``apply`` gets its results instead, worked out once.
    """

    name: str
    description: str
    columns: tuple[str, ...]
    apply: Callable[..., Sequence[Column]]
    prepare: Callable[..., Sequence[Column]] | None = None


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType | None = None
    primary_key: tuple[str, ...] = ()
    identifiers: tuple[str, ...] = ()
    fk_rules: tuple[FkRule, ...] = ()
    profile_rules: tuple[Rule | ColumnRule, ...] = ()
    validation_rules: tuple[Rule | ColumnRule, ...] = ()
    fixes: tuple[Fix, ...] = ()
    post_rules: tuple[Rule | ColumnRule, ...] = ()


@dataclass(frozen=True)
class DomainSpec:
    name: str
    keywords: tuple[str, ...]
    description: str
    nullable_columns: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
