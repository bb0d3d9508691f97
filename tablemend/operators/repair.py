"""Identifier clean-up and foreign key repair; rows are neither lost nor multiplied."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.constants import MISSING_FK, UNKNOWN
from tablemend.functions.columns import column, fold, is_text, quoted, require, resolve, text
from tablemend.functions.predicates import invalid_uuid, is_unknown, stands_for_missing
from tablemend.model import Dataset, FkRule, TableSpec, Via
from tablemend.operators.lookup import (
    KEY, Lookup, attach, estimated_bytes, known_keys, lookup, matched_rows,
)
from tablemend.operators.metrics import metric, union_all, unfold
from tablemend.operators.orphans import fillable, fk_metrics
from tablemend.sources.sinks import Steps, shuffles_dropped, stage_in_steps

CHANGED_PREFIX = "__rekeyed_"


def sanitize_identifiers(df: DataFrame, names: Sequence[str], sentinel: str = UNKNOWN) -> DataFrame:
    """Replace whatever is no UUID in the named text columns by ``sentinel``."""
    found = _identifier_columns(df, names).values()
    return df.withColumns({
        n: F.when(invalid_uuid(F.col(quoted(n))), F.lit(sentinel)).otherwise(F.col(quoted(n))) for n in found
    }) if found else df


def _identifier_columns(df: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """The text columns among the named ones, under their names in ``df``."""
    return {n: require(df, n) for n in names if resolve(df, n) and is_text(df, n)}


def parents_through(
    reference: Dataset, rule: FkRule, through: str, marker: str, limit: int | None = None, known: Lookup | None = None
) -> Lookup:
    """Per key of the detour table: the parent it leads to (column ``through``), if that exists.

    Copies of a detour row may disagree.  Parents that do not exist are ignored
    and the smallest of the others is taken, so the answer does not depend on
    the order of rows.  ``marker`` is true for every key of the detour table.
    ``known`` is the lookup of the parents, with the marker ``__known``, if there is one already.
    """
    detour = reference[rule.via.table]
    pairs = detour.select(
        fold(column(detour, rule.via.key)).alias("__id"), column(detour, rule.via.payload).alias("__parent")
    ).filter(~stands_for_missing(F.col("__id")))
    known = known or known_keys(reference[rule.ref_table], rule.ref_column, "__known")
    checked = attach(pairs, fold(F.col("__parent")), known, limit)
    parent = F.min(F.when(F.col("__known"), F.col("__parent")))
    rows = checked.groupBy(F.col("__id").alias(KEY)).agg(parent.alias(through), F.lit(True).alias(marker))
    return Lookup(rows, estimated_bytes(pairs))


class StoredLookups:
    """The lookups of a run, each built once from ``reference`` and written as Parquet under ``folder``.

    A lookup is written when a key repair first asks for it; all later ones read its narrow rows (a row per key) and
    scan and group no parent table again.  A lost executor costs no more than its own tasks.
    """

    def __init__(self, reference: Dataset, folder: str, limit: int | None = None):
        self.reference, self.folder, self.limit = reference, folder.rstrip("/"), limit
        self._stored: dict[tuple[str, ...], DataFrame] = {}

    def _once(self, key: tuple[str, ...], build: Callable[[], Lookup], names: Mapping[str, str]) -> Lookup:
        if key not in self._stored:
            rows = build().rows
            path = f"{self.folder}/{len(self._stored)}"
            with shuffles_dropped(rows.sparkSession):
                rows.write.mode("overwrite").parquet(path)
            self._stored[key] = rows.sparkSession.read.schema(rows.schema).parquet(path)
        rows = self._stored[key]
        return Lookup(rows.withColumnsRenamed(names), estimated_bytes(rows))

    def known(self, table: str, name: str, marker: str) -> Lookup:
        def build() -> Lookup:
            return known_keys(self.reference[table], name, "__known")

        return self._once((table, name.lower()), build, {"__known": marker})

    def through(self, rule: FkRule, through: str, marker: str) -> Lookup:
        via = rule.via

        def build() -> Lookup:
            known = self.known(rule.ref_table, rule.ref_column, "__known")
            return parents_through(self.reference, rule, "__through", "__detour", self.limit, known)

        key = (via.table, via.key.lower(), via.payload.lower(), rule.ref_table, rule.ref_column.lower())
        return self._once(key, build, {"__through": through, "__detour": marker})


@dataclass(frozen=True)
class RepairMode:
    """How a broken key is treated.

    ``detour_if_unknown``: take the detour only for keys already marked unknown
    (other broken keys become the sentinel); otherwise for every broken key.
    """

    sentinel: str
    detour_if_unknown: bool = False


# A valid own key, else the key through the detour, else a mark.
MARK_MISSING = RepairMode(MISSING_FK)
# Keys that were blanked out are recovered through the detour, all others must exist.
MARK_UNKNOWN = RepairMode(UNKNOWN, detour_if_unknown=True)


def repair_keys(
    df: DataFrame, rules: Sequence[FkRule], reference: Dataset, mode: RepairMode = MARK_MISSING,
    limit: int | None = None, mark_changes: bool = False, stored: StoredLookups | None = None, steps: Steps | None = None,
) -> DataFrame:
    """Repair all foreign keys of one table against the keys in ``reference``.

    Each rule costs one lookup.  A detour and a direct rule over the same column
    share theirs: the lookup that says whether the encounter exists also says
    which patient it belongs to.  ``mark_changes`` adds a flag per key column.
    With ``stored`` (of the same ``reference``), lookups are shared with other tables; with ``steps``, the rows of a
    large table are written between lookups that shuffle them.
    """
    usable = [r for r in rules if r.ref_table in reference and resolve(df, r.column)
              and resolve(reference[r.ref_table], r.ref_column)]
    out = df
    through: dict[FkRule, str] = {}
    exists: dict[tuple[str, str, str], str] = {}

    for i, rule in enumerate(usable):
        via = rule.via
        if via is None or not _can_detour(df, via, reference):
            continue
        through[rule] = f"__through{i}"
        marker = exists[via.column.lower(), via.table, via.key.lower()] = f"__detour{i}"
        facts = stored.through(rule, through[rule], marker) if stored else \
            parents_through(reference, rule, through[rule], marker, limit)
        out = attach(out, fold(column(df, via.column)), facts, limit, steps)

    for i, rule in enumerate(usable):
        asked = (rule.column.lower(), rule.ref_table, rule.ref_column.lower())
        if asked not in exists:
            exists[asked] = f"__exists{i}"
            facts = stored.known(rule.ref_table, rule.ref_column, exists[asked]) if stored else \
                known_keys(reference[rule.ref_table], rule.ref_column, exists[asked])
            out = attach(out, fold(column(df, rule.column)), facts, limit, steps)

    repaired: dict[str, Column] = {}
    for rule in usable:
        own = text(column(df, rule.column))  # a mark is a text, so a column of numbers becomes one
        choices = [F.when(F.col(exists[rule.column.lower(), rule.ref_table, rule.ref_column.lower()]), own)]
        if rule in through:
            detour = text(F.col(through[rule]))
            if mode.detour_if_unknown:
                choices.insert(0, F.when(is_unknown(own), detour))
            else:
                choices.append(detour)
        repaired[require(df, rule.column)] = F.coalesce(*choices, F.lit(mode.sentinel))
    flags = [
        (~text(F.col(quoted(name))).eqNullSafe(value)).alias(CHANGED_PREFIX + name) for name, value in repaired.items()
    ] if mark_changes else []
    return out.select(
        *[repaired[c].alias(c) if c in repaired else F.col(quoted(c)) for c in df.columns], *flags
    )


def _can_detour(df: DataFrame, via: Via, reference: Dataset) -> bool:
    table = reference.get(via.table)
    return bool(
        table is not None and resolve(df, via.column) and resolve(table, via.key) and resolve(table, via.payload)
    )


def fix_log(ds: Dataset, specs: Mapping[str, TableSpec], dimension: str = "Integ_Fix") -> DataFrame:
    """What the integrity repair changes: bad identifiers, then keys without a parent.

    The latter are counted once the identifiers are clean, and leave out the
    unknown ones.  Steps that change nothing have no row.
    """
    parts = []
    for name, df in ds.items():
        names = _identifier_columns(df, specs[name].identifiers) if name in specs else {}
        if names:
            counted = df.agg(
                F.count(F.lit(1)).alias("n"),
                *[F.count_if(invalid_uuid(F.col(quoted(n)))).alias(f"e{i}") for i, n in enumerate(names.values())],
            )
            parts.append(unfold(counted, [
                metric(name, dimension, f"{n}_Format_Corrected", f"no UUID, set to {UNKNOWN}",
                       f"e{i}", "n")
                for i, n in enumerate(names)
            ]))
    clean = {
        name: sanitize_identifiers(df, specs[name].identifiers) if name in specs else df for name, df in ds.items()
    }
    rules = [r for name in ds if name in specs for r in specs[name].fk_rules]
    dangling = fk_metrics(clean, rules, dimension, nulls_are_orphans=False, ignore_case=True,
                          sentinel=UNKNOWN, full_rule_name=False, reference=ds)
    chained = [f"{r.table}.{r.column}" for r in rules if r.via is not None]
    is_chained = F.concat_ws(".", "table_name", "rule_name").isin(chained)
    kind = F.when(is_chained, F.lit("_FK_Corrected_Chained")).otherwise(F.lit("_FK_Corrected_Direct"))
    parts.append(dangling.withColumn("rule_name", F.concat("rule_name", kind)))
    return union_all(parts).filter(F.col("error_count") > 0)


def repair_integrity(
    ds: Dataset, specs: Mapping[str, TableSpec], limit: int | None = None, stored: StoredLookups | None = None,
    staging: str | None = None,
) -> Dataset:
    """Clean identifiers, then repair foreign keys against the keys of the tables as given.

    With a folder ``staging``, the repaired tables are written there."""
    def repaired(name: str, df: DataFrame, steps: Steps | None = None) -> DataFrame:
        clean = sanitize_identifiers(df, specs[name].identifiers) if name in specs else df
        return repair_keys(clean, specs[name].fk_rules, ds, MARK_UNKNOWN, limit, stored=stored, steps=steps) if name in specs else df

    return stage_in_steps(ds, staging, repaired) if staging else {name: repaired(name, df) for name, df in ds.items()}


def impute_candidates(
    df: DataFrame, rule: FkRule, reference: Dataset, dimension: str = "11FI", limit: int | None = None
) -> DataFrame:
    """Rows without a key that the detour could fill (whether or not that parent exists)."""
    via = rule.via
    detour = reference[via.table]
    facts = lookup(detour, fold(column(detour, via.key)), __through=F.min(column(detour, via.payload)))
    gap = column(df, rule.column).isNull()
    counted = matched_rows(
        df, F.when(gap, fold(column(df, via.column))), facts, F.col("__through").isNotNull(), limit
    )
    return unfold(counted, [fillable(rule, "e", "n", dimension)])
