"""tablemend: data quality, cleansing and integration of tables on Spark."""

from tablemend.model import (
    ColumnRule,
    DomainSpec,
    FkRule,
    Rule,
    TableSpec,
    Via,
)

__all__ = ["ColumnRule", "DomainSpec", "FkRule", "Rule", "TableSpec", "Via"]
