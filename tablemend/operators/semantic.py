"""Codes against a code list, and codes suggested from descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.constants import DIGITS_PATTERN
from tablemend.functions.columns import column, text
from tablemend.operators.lookup import Lookup, attach, lookup, matched_rows
from tablemend.operators.metrics import metric, unfold
from tablemend.operators.orphans import KeyUse, key_use_counts

SUGGESTED = "SUGGESTED_CODE"


def normalized(description: Column) -> Column:
    """A description without surrounding blanks, kind suffixes and case."""
    bare = F.regexp_replace(text(description), r"^\s+|\s+$", "")
    for suffix in (" (finding)", " (disorder)"):
        bare = F.replace(bare, F.lit(suffix), F.lit(""))
    return F.lower(bare)


def unknown_codes(
    df: DataFrame, table: str, codes: DataFrame, code: str = "CODE", list_code: str = "code",
    dimension: str = "9S", rule: str = "CODE_SNOMED_Validity",
) -> DataFrame:
    """Numeric codes that the list does not know; texts and NULLs are none of this check's business."""
    c = column(df, code)
    numeric = df.select(F.when(text(c).rlike(DIGITS_PATTERN), text(c)).alias("code"))
    counted = key_use_counts([KeyUse(table, numeric, "code")], codes, list_code, ignore_case=False)
    return unfold(counted, [
        metric(table, dimension, rule, "numeric code not in the code list", "dangling", "total")
    ])


def code_lookup(codes: DataFrame, description: str = "description", code: str = "code") -> Lookup:
    """Normalized description -> code; the smallest code if a description has several."""
    key = normalized(column(codes, description))
    return lookup(codes.filter(key != ""), key, **{SUGGESTED: F.min(text(column(codes, code)))})


def _to_suggest(df: DataFrame, code: str, description: str) -> Column:
    """The search key of a row whose code is missing or not numeric, NULL for other rows."""
    c = text(column(df, code))
    return F.when(c.isNull() | ~c.rlike(DIGITS_PATTERN), normalized(column(df, description)))


def suggest_codes(
    df: DataFrame, codes: Lookup, code: str = "CODE", description: str = "DESCRIPTION", limit: int | None = None
) -> DataFrame:
    """``df`` with a code suggested by the description where the own one is missing or not numeric."""
    return attach(df, _to_suggest(df, code, description), codes, limit)


def suggested_codes(
    df: DataFrame, table: str, codes: Lookup, code: str = "CODE", description: str = "DESCRIPTION",
    dimension: str = "9S", rule: str = "CODE_Correction_by_Description", limit: int | None = None,
) -> DataFrame:
    """How many rows have a suggestion."""
    counted = matched_rows(df, _to_suggest(df, code, description), codes, F.col(SUGGESTED).isNotNull(), limit)
    return unfold(counted, [
        metric(table, dimension, rule, "code known from the description", "e", "n")
    ])
