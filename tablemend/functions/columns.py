"""Case-insensitive column resolution and small type helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def resolve(df: DataFrame, name: str) -> str | None:
    """The column of ``df`` called ``name`` in any case; the exact spelling wins."""
    if name in df.columns:
        return name
    folded = name.lower()
    return next((c for c in df.columns if c.lower() == folded), None)


def require(df: DataFrame, name: str) -> str:
    found = resolve(df, name)
    if found is None:
        raise KeyError(f"no column {name!r} among {df.columns}")
    return found


def column(df: DataFrame, name: str) -> Column:
    """``name`` as a quoted column, so that dots in a name stay part of it."""
    return F.col(quoted(require(df, name)))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[require(df, name)].dataType, T.StringType)


def text(c: Column) -> Column:
    return c.cast("string")


def fold(c: Column) -> Column:
    """Key form of a column for comparisons that ignore case."""
    return F.lower(text(c))


def percentage(errors: str, total: str) -> Column:
    """100*errors/total of two columns to two places, half up, in exact integer arithmetic; 0 without rows."""
    twice, scaled = f"nullif({total} * 2, 0L)", f"({errors} * 20000L + {total})"
    return F.expr(f"coalesce(({scaled} - {scaled} % {twice}) / {twice} / 100.0D, 0.0D)")
