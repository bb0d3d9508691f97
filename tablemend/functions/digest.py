"""One short key for all the text of a row, for grouping rows without shuffling their text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemend.functions.columns import quoted


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def text_digest(names: Sequence[str]) -> Column:
    """SHA-256 over text columns: rows with the same texts, and only those, share it.

    Every text is framed by its length, so that neighbours cannot run together.
    """
    framed = [f"coalesce(concat(length({quoted(n)}), ':', {quoted(n)}), '-')" for n in names]
    return F.expr(f"unhex(sha2(concat({', '.join(framed)}), 256))")


# A size takes 8 bits of a frame: 0 is NULL, 255 a text of this many bytes or more.
_LONG = 254
_SIZES_IN_FRAME = 7


def packed_digest(names: Sequence[str]) -> Column:
    """SHA-256 over text columns, for grouping only: rows with the same texts, and only those, share it.

    The sizes of the texts go before them in few numbers, and are written out where a text is long,
    so that framing costs less than the digest itself.
    """
    sizes = [f"octet_length({quoted(n)})" for n in names]
    packed = [f"coalesce(cast(least({size}, {_LONG}) + 1 as bigint), 0L)" for size in sizes]
    frames = []
    for start in range(0, len(packed), _SIZES_IN_FRAME):
        part = packed[start:start + _SIZES_IN_FRAME]
        frames.append("cast(" + " | ".join(f"shiftleft({size}, {8 * i})" for i, size in enumerate(part)) + " as string)")
    is_long = " or ".join(f"coalesce({size} >= {_LONG}, false)" for size in sizes)
    written_out = f"if({is_long}, concat_ws(',', " + ", ".join(f"coalesce(cast({size} as string), '-')" for size in sizes) + "), '')"
    framed = [f"concat_ws(',', {', '.join(frames)})", "':'", written_out, "':'", *[f"coalesce({quoted(n)}, '')" for n in names]]
    return F.expr(f"unhex(sha2(concat({', '.join(framed)}), 256))")
