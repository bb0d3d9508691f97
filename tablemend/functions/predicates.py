"""Predicates for bad values.

Whether NULL counts differs from rule to rule, so each predicate states it; a
predicate that comes out NULL is not counted (``count_if`` counts TRUE only).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemend.constants import EMPTY_TEXTS, MISSING_FK, UNKNOWN, UUID_PATTERN
from tablemend.functions.columns import text


def is_null(c: Column) -> Column:
    return c.isNull()


def null_or_empty(c: Column) -> Column:
    """NULL or the empty text; blanks are a value here."""
    return c.isNull() | (text(c) == "")


def effectively_empty(c: Column) -> Column:
    """NULL, blank, or one of the texts that stand for nothing."""
    return c.isNull() | F.lower(F.trim(text(c))).isin(*EMPTY_TEXTS)


def stands_for_missing(c: Column) -> Column:
    """Effectively empty, or a mark that a repair has set: no such text is a key."""
    return effectively_empty(c) | (F.lower(F.trim(text(c))) == MISSING_FK.lower())


def invalid_uuid(c: Column) -> Column:
    t = text(c)
    return effectively_empty(c) | (F.length(t) != 36) | ~t.rlike(UUID_PATTERN)


def outside(c: Column, allowed: Iterable[str]) -> Column:
    """Not among ``allowed``; NULL is not counted."""
    return ~c.isin(*allowed)


def null_or_outside(c: Column, allowed: Iterable[str], ignore_case: bool = False) -> Column:
    return c.isNull() | outside(F.lower(c) if ignore_case else c, allowed)


def mismatch(c: Column, pattern: str) -> Column:
    """Does not match ``pattern``; NULL is not counted."""
    return ~text(c).rlike(pattern)


def mismatch_except(c: Column, pattern: str, *sentinels: str) -> Column:
    return mismatch(c, pattern) & ~text(c).isin(*sentinels)


def null_or_equal(c: Column, value: str) -> Column:
    return c.isNull() | (text(c) == value)


def is_unknown(c: Column) -> Column:
    return F.lower(text(c)) == UNKNOWN.lower()


def looks_like_integer(c: Column) -> Column:
    """A text that a cast to a 64-bit integer accepts (a fraction is cut off)."""
    whole = F.regexp_extract(text(c), r"^\s*([+-]?\d+)(?:\.\d*)?\s*$", 1)
    return F.when(c.isNotNull(), F.nullif(whole, F.lit("")).try_cast("bigint").isNotNull())
