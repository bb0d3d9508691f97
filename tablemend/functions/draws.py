"""Reproducible draws: a row's fate depends on its key only.

``rand()`` gives other rows on every run and every partitioning, so nothing
measured afterwards could be checked.  Both kinds below map (seed of the row,
salt) to [0, 1) in steps; different salts give unrelated draws.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PRIME = 1_000_003


class HashDraws:
    """Draws by a 64-bit hash of the key columns, of any type."""

    def seed(self, keys: list[Column]) -> Column:
        return F.xxhash64(*keys)

    def below(self, seed: str, salt: str, rate: float) -> Column:
        """Whether the draw is below ``rate``; ``seed`` names a column, ``salt`` is SQL."""
        return F.expr(f"shiftrightunsigned(xxhash64({seed}, {salt}), 11) < {round(rate * 2**53)}L")


class ArithmeticDraws:
    """Draws by modular arithmetic on one integer key: any SQL engine can repeat them.

    Rates are multiples of 1/1000, and keys that differ by a multiple of 1,000,003 share their draws.
    """

    def seed(self, keys: list[Column]) -> Column:
        (key,) = keys
        return F.pmod(key.cast("bigint"), F.lit(_PRIME).cast("bigint"))

    def below(self, seed: str, salt: str, rate: float) -> Column:
        if abs(rate * 1000 - round(rate * 1000)) > 1e-9:
            raise ValueError(f"rate {rate}: arithmetic draws have steps of 1/1000, use HashDraws")
        mixed = f"pmod({seed} * 7919 + ({salt}) * 104729, {_PRIME})"
        return F.expr(f"pmod(pmod({mixed} * {mixed}, {_PRIME}), 1000) < {round(rate * 1000)}")
