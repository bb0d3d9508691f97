"""Row-level correction of one table, with a count of what every step changed.

The order is fixed: fill NULLs, drop duplicate rows, apply the fixes of the
table's specification, trim text.  Everything before and after the duplicates is
one projection each, so a table is corrected with a single shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemend.constants import (
    DASHED_PATTERN, DIGITS_PATTERN, INVALID_FORMAT, UNKNOWN, UNKNOWN_GENDER,
)
from tablemend.functions.columns import column, quoted, resolve
from tablemend.functions.dates import clamp_future, clamp_order, iso_text, parse_any
from tablemend.model import Fix, TableSpec
from tablemend.operators.metrics import metric, skipped, unfold

_COPIES, _FILLED = "__copies", "__filled"
_FIXED, _TRIMMED = "__fixed", "__trimmed"
_NUMBERS = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType)


def fill_nulls(df: DataFrame) -> DataFrame:
    """Text NULLs become UNKNOWN, numeric ones 0."""
    return df.select(*[_filled(f).alias(f.name) for f in df.schema])


def _filled(field: T.StructField) -> Column:
    c = F.col(quoted(field.name))
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(c, F.lit(UNKNOWN))
    if isinstance(field.dataType, _NUMBERS):
        return F.coalesce(c, F.lit(0).cast(field.dataType))
    return c


def trim_texts(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.trim(F.col(quoted(f.name))).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(quoted(f.name))
        for f in df.schema
    ])


# --- fixes -----------------------------------------------------------------


def fix_gender(name: str = "GENDER") -> Fix:
    """m and f in any case are kept in capitals, all else is unknown."""
    def apply(c: Column) -> list[Column]:
        c = c.cast("string")
        return [F.when(F.lower(c).isin("m", "f"), F.upper(c)).otherwise(F.lit(UNKNOWN_GENDER))]
    return Fix(f"{name}_Corrected", "other values set to U", (name,), apply)


def fix_life_dates(birth: str, death: str, layouts: Sequence[str], as_of: Column) -> Fix:
    """ISO dates; death not before birth, neither in the future; NULL if unreadable."""
    def apply(born: Column, died: Column) -> list[Column]:
        return [iso_text(clamp_future(born, as_of)), iso_text(clamp_future(clamp_order(died, born), as_of))]
    return Fix("Dates_Corrected", "order, format and future dates repaired", (birth, death), apply,
               lambda b, d: [parse_any(b, layouts), parse_any(d, layouts)])


def fix_period(start: str, stop: str, layouts: Sequence[str]) -> Fix:
    """ISO dates; stop not before start; NULL if unreadable."""
    def apply(begin: Column, end: Column) -> list[Column]:
        return [iso_text(begin), iso_text(clamp_order(end, begin))]
    return Fix("StartStop_Dates_Corrected", "order and format repaired", (start, stop), apply,
               lambda a, b: [parse_any(a, layouts), parse_any(b, layouts)])


def fix_characters(name: str, unwanted: str) -> Fix:
    """Remove the characters matched by ``unwanted``; nothing left is an invalid format."""
    def apply(c: Column) -> list[Column]:
        c = c.cast("string")
        kept = F.regexp_replace(c, unwanted, "")
        return [F.when((kept == "") | (c == INVALID_FORMAT), F.lit(INVALID_FORMAT)).otherwise(kept)]
    return Fix(f"{name}_Format_Corrected", f"{unwanted} removed", (name,), apply)


def fix_numeric_code(name: str = "CODE") -> Fix:
    def apply(c: Column) -> list[Column]:
        c = c.cast("string")  # the mark is a text, so a column of numbers becomes one
        return [F.when(c.rlike(DIGITS_PATTERN), c).otherwise(F.lit(UNKNOWN))]
    return Fix(f"{name}_Format_Corrected", "codes other than digits set to UNKNOWN", (name,), apply)


def fix_identifier(name: str, prefix: str = "bad-") -> Fix:
    """Take the prefix off; what is not letters, digits and dashes then is unknown."""
    def apply(c: Column) -> list[Column]:
        c = c.cast("string")
        bare = F.when(c.startswith(prefix), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)
        return [F.when(~bare.rlike(DASHED_PATTERN), F.lit(UNKNOWN)).otherwise(bare)]
    return Fix(f"{name}_Format_Corrected", "prefix removed, invalid set to UNKNOWN", (name,), apply)


# --- the correction --------------------------------------------------------


def usable_fixes(df: DataFrame, fixes: Sequence[Fix]) -> list[Fix]:
    """The fixes whose columns ``df`` has."""
    return [f for f in fixes if all(resolve(df, c) for c in f.columns)]


def correct(df: DataFrame, fixes: Sequence[Fix]) -> DataFrame:
    """The corrected rows."""
    marked = correct_marked(df, fixes)
    return marked.select(*[F.col(quoted(c)) for c in df.columns])


def correct_marked(df: DataFrame, fixes: Sequence[Fix]) -> DataFrame:
    """The corrected rows with marks: copies merged, copies filled, and a flag per fix."""
    usable = usable_fixes(df, fixes)
    # Marks are taken per row before the shuffle and added up per distinct row.
    # A NULL in a column that cannot be filled is no fill.
    was_filled = F.lit(False)
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, *_NUMBERS)):
            was_filled = was_filled | F.col(quoted(f.name)).isNull()
    filled = df.select(*[_filled(f).alias(f.name) for f in df.schema], was_filled.alias(_FILLED))
    distinct = filled.groupBy(*[F.col(quoted(c)) for c in df.columns]).agg(
        F.count(F.lit(1)).alias(_COPIES), F.count_if(F.col(_FILLED)).alias(_FILLED)
    )

    prepared, rows = prepare_fixes(distinct, usable)
    new, flags = {}, []
    for i, fix in enumerate(usable):
        names = [resolve(df, c) for c in fix.columns]
        fixed = list(fix.apply(*prepared[i]))
        new.update(zip(names, fixed))
        changed = F.lit(False)
        for name, after in zip(names, fixed):
            changed = changed | ~F.col(quoted(name)).cast("string").eqNullSafe(after.cast("string"))
        flags.append(changed.alias(f"{_FIXED}{i}"))
    fixed_rows = rows.select(
        *[new[c].alias(c) if c in new else F.col(quoted(c)) for c in df.columns], _COPIES, _FILLED, *flags
    )

    texts = [f.name for f in fixed_rows.schema if isinstance(f.dataType, T.StringType)]
    untrimmed = F.lit(False)
    for t in texts:
        untrimmed = untrimmed | ~F.trim(F.col(quoted(t))).eqNullSafe(F.col(quoted(t)))
    return fixed_rows.select(
        *[F.trim(F.col(quoted(c))).alias(c) if c in texts else F.col(quoted(c)) for c in df.columns],
        _COPIES, _FILLED, *[f"{_FIXED}{i}" for i in range(len(usable))], untrimmed.alias(_TRIMMED),
    )


def prepare_fixes(df: DataFrame, fixes: Sequence[Fix]) -> tuple[list[list[Column]], DataFrame]:
    """What each fix is applied to, and ``df`` with the prepared columns that some of them ask for."""
    inputs, extra = [], {}
    for i, fix in enumerate(fixes):
        columns = [column(df, c) for c in fix.columns]
        if fix.prepare is not None:
            made = {f"__prepared{i}_{n}": c for n, c in enumerate(fix.prepare(*columns))}
            extra.update(made)
            columns = [F.col(name) for name in made]
        inputs.append(columns)
    return inputs, df.withColumns(extra) if extra else df


def apply_fix(df: DataFrame, fix: Fix) -> DataFrame:
    """A single fix, without the other steps of a correction."""
    (inputs,), rows = prepare_fixes(df, [fix])
    new = dict(zip([resolve(df, c) for c in fix.columns], fix.apply(*inputs)))
    return rows.select(*[new[c].alias(c) if c in new else F.col(quoted(c)) for c in df.columns])


def correction_log(
    marked: DataFrame, table: str, fixes: Sequence[Fix], dimension: str = "15C"
) -> DataFrame:
    """Rows changed by every step, from the marks; steps whose columns are missing are reported as skipped."""
    usable = usable_fixes(marked, fixes)
    counted = marked.agg(
        F.coalesce(F.sum(_COPIES), F.lit(0)).alias("before"),
        F.coalesce(F.sum(_FILLED), F.lit(0)).alias("filled"),
        F.count(F.lit(1)).alias("after"),
        *[F.count_if(F.col(f"{_FIXED}{i}")).alias(f"f{i}") for i in range(len(usable))],
        F.count_if(F.col(_TRIMMED)).alias("trimmed"),
    )
    steps = [
        ("Completeness_Auto_Fill", "missing values filled", "filled", "before"),
        ("Exact_Duplicates_Removed", "duplicate rows removed", "before - after", "before"),
        *[(f.name, f.description, f"f{i}", "after") for i, f in enumerate(usable)],
        ("Whitespace_Trimmed", "surrounding blanks removed", "trimmed", "after"),
    ]
    lost = {f.name: [c for c in f.columns if not resolve(marked, c)] for f in fixes if f not in usable}
    return unfold(counted, [
        *[metric(table, dimension, n, text, e, t) for n, text, e, t in steps],
        *[skipped(table, dimension, f"{name}_Skipped", f"not corrected, column missing: {', '.join(columns)}")
          for name, columns in lost.items()],
    ])


def corrector(spec: TableSpec) -> Callable[[DataFrame], DataFrame]:
    """The correction of a specification, for use with ``DataFrame.transform``."""
    return lambda df: correct(df, spec.fixes)
