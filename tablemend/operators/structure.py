"""Tables and columns as declared and as found."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemend.constants import CHECKED, UNDETERMINED
from tablemend.functions.columns import resolve
from tablemend.model import Dataset, DomainSpec, TableSpec
from tablemend.operators.metrics import empty_table, metric, metric_rows, rows, union_all, unfold


def overview(ds: Dataset) -> DataFrame:
    """Columns and rows of every table."""
    return union_all(
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"), "n_rows"
        )
        for name, df in ds.items()
    )


def volumes(ds: Dataset, dimension: str = "6V") -> DataFrame:
    """A row per table: no errors among n rows, or the empty-table row."""
    parts = []
    for name, df in ds.items():
        counted = df.agg(F.count(F.lit(1)).alias("n"))
        full = metric(name, dimension, "Volume", "table has rows", "0", "n")
        parts.append(unfold(counted, f"if(n = 0, {rows([empty_table(name, dimension)])}, {rows([full])})"))
    return union_all(parts)


def detect_domain(tables: Sequence[str], domains: Sequence[DomainSpec]) -> DomainSpec | None:
    """The first domain with a keyword among the table names."""
    names = set(tables)
    return next((d for d in domains if names.intersection(d.keywords)), None)


def domain_metric(spark: SparkSession, domain: DomainSpec | None) -> DataFrame:
    name = domain.name if domain else UNDETERMINED
    errors = 0 if domain else 1
    row = ("Global", "5DD", "Domain Detection", f"domain: {name}", errors, 1, 100.0 * errors, CHECKED)
    return metric_rows(spark, [row])


def schema_drift(ds: Dataset, specs: Mapping[str, TableSpec]) -> DataFrame:
    """Differences between the declared and the found columns, one metric each.

    Only schemas are looked at, so nothing is read.  Names are compared without case.
    """
    findings = []

    def found(table: str, dimension: str, rule: str, text: str, errors: int, total: int) -> None:
        pct = round(errors / total * 100, 2) if total else 0.0
        findings.append((table, dimension, rule, text, errors, total, pct, CHECKED))

    for name, df in ds.items():
        spec = specs.get(name)
        if spec is None or spec.schema is None:
            found(name, "5MD", "Schema Definition", "no schema declared", 1, 1)
            continue
        declared = spec.schema.fields
        for field in declared:
            actual = resolve(df, field.name)
            if actual is None:
                found(name, "5SV", field.name, "declared column missing", 1, len(declared))
            elif df.schema[actual].dataType != field.dataType:
                want, have = field.dataType.simpleString(), df.schema[actual].dataType.simpleString()
                found(name, "5SV", field.name, f"declared {want}, found {have}", 1, len(declared))
        known = {f.name.lower() for f in declared}
        extra = [c for c in df.columns if c.lower() not in known]
        if extra:
            found(name, "5SV", "Unexpected Columns", f"not declared: {', '.join(extra)}", len(extra), len(df.columns))
    return metric_rows(next(iter(ds.values())).sparkSession, findings)
