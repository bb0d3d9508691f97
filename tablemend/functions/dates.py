"""Dates out of untidy text.

Texts may carry more than the date (``2020-01-05T10:11:12Z``), may lack leading
zeros and may come in several layouts.  ``lenient_date`` reads the date at the
front of a text and gives NULL for anything else; it never raises and needs no
session setting.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd"
US = "MM/dd/yyyy"
EUROPEAN = "dd/MM/yyyy"
DOTTED = "yyyy.MM.dd"
COMPACT = "yyyyMMdd"


def _alternative(layout: str, group: int) -> tuple[str, dict[str, int]]:
    """A pattern for a date in ``layout``, and the group of each field counted from ``group``."""
    separated = not layout.isalpha()
    fields, pattern = {}, ""
    for part in re.split(r"(yyyy|MM|dd)", layout):
        if part in ("yyyy", "MM", "dd"):
            pattern += r"(\d{4})" if part == "yyyy" else r"(\d{1,2})" if separated else r"(\d{2})"
            fields[part] = group + len(fields)
        else:
            pattern += re.sub(r"(\W)", r"\\\1", part)
    return pattern, fields


def _shape(layout: str) -> str:
    return re.sub(r"MM|dd", "##", layout)


def parse_any(c: Column, layouts: Iterable[str]) -> Column:
    """The date at the front of a text, under the first layout that fits.

    One pattern knows all the layouts and puts the fields it finds in ISO order;
    a text without a date becomes "--", which is none either.  Layouts that a
    pattern cannot tell apart (day or month first) are tried one after the other.
    A text that begins with an ISO date of ten characters is cut and cast without a pattern.
    """
    layouts = list(layouts)
    rounds: list[list[str]] = []
    for layout in layouts:
        fitting = (r for r in rounds if all(_shape(other) != _shape(layout) for other in r))
        free = next(fitting, None)
        if free is None:
            rounds.append([layout])
        else:
            free.append(layout)
    dates = [_in_iso_order(c, r).try_cast("date") for r in rounds]
    if ISO in layouts:
        dates.insert(0, _plain_iso(c.cast("string")))
    return dates[0] if len(dates) == 1 else F.coalesce(*dates)


def _plain_iso(t: Column) -> Column:
    """The date in the first ten characters, if dashes stand in their places; no other layout fits such a text."""
    dashes = (F.substring(t, 5, 1) == "-") & (F.substring(t, 8, 1) == "-")
    return F.when(dashes, F.substring(t, 1, 10).try_cast("date"))


def _in_iso_order(c: Column, layouts: list[str]) -> Column:
    alternatives, groups = [], {"yyyy": "", "MM": "", "dd": ""}
    for i, layout in enumerate(layouts):
        pattern, fields = _alternative(layout, 3 * i + 1)
        alternatives.append(pattern)
        for field, group in fields.items():
            groups[field] += f"${group}"
    # Of the groups of a field, those of the other layouts are empty.
    pattern = rf"(?s)^\s*(?:{'|'.join(alternatives)}).*$|^.*$"
    return F.regexp_replace(c.cast("string"), pattern, f"{groups['yyyy']}-{groups['MM']}-{groups['dd']}")


def lenient_date(c: Column, layout: str = ISO) -> Column:
    """The date at the front of a text in one layout."""
    return parse_any(c, [layout])


def cast_date(c: Column) -> Column:
    """A date by plain cast (ISO date, optional time part), NULL where it does not fit, of any type."""
    return c.cast("string").try_cast("date")


def whole_number(c: Column) -> Column:
    """A number without fraction, NULL for anything else."""
    # A cast that fails costs an exception per row, so a text that is no number is NULL before the cast.
    return F.nullif(F.regexp_extract(c.cast("string"), r"^\s*([+-]?\d+)\s*$", 1), F.lit("")).try_cast("bigint")


def before(a: Column, b: Column, date: Callable[[Column], Column] = cast_date) -> Column:
    """a < b as dates, or else as whole numbers."""
    return F.coalesce(date(a) < date(b), whole_number(a) < whole_number(b))


def iso_text(d: Column) -> Column:
    return d.cast("string")


def clamp_order(later: Column, earlier: Column) -> Column:
    """``later``, but never before ``earlier``; a NULL on either side changes nothing."""
    return F.when(later < earlier, earlier).otherwise(later)


def clamp_future(d: Column, as_of: Column) -> Column:
    return F.when(d > as_of, as_of).otherwise(d)
