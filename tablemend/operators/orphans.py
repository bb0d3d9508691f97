"""Foreign keys without a parent, counted.

All foreign keys that point at one parent column are counted together: the keys
of the children and of the parent go into one grouping by key, which counts per
task before it shuffles.  So a key (or NULL) that fills a third of a table is one
counter per task, the parent is read once for all its children, and no join is
needed.  Every flavour of orphan count (NULL counted or not, sentinel counted or
not) comes out of the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.constants import INTEGRITY, UNKNOWN
from tablemend.functions.columns import column, fold, resolve, text
from tablemend.functions.predicates import effectively_empty, stands_for_missing
from tablemend.model import Dataset, FkRule
from tablemend.operators.metrics import literal, metric, rows, skipped, union_all, unfold

_PARENT = -1


@dataclass(frozen=True)
class KeyUse:
    """A child column whose values are looked up in the parent."""

    label: str
    df: DataFrame
    column: str
    # True for rows that ask whether the key leads to something (see ``payload``); None if no row does.
    asks: Column | None = None


def key_use_counts(
    uses: Sequence[KeyUse], parent: DataFrame, parent_key: str, *,
    ignore_case: bool, sentinel: str | None = None, payload: str | None = None,
) -> DataFrame:
    """One row per use: total, null_keys, sentinel_keys, linked, dangling and more.

    ``dangling`` keys are neither NULL nor the sentinel and have no parent, so
    total = null_keys + sentinel_keys + linked + dangling.  ``linked_value`` and
    ``dangling_value`` leave out the texts that integrity work takes for empty.  With
    ``payload``, a column of the parent, ``led`` counts the asking rows whose key has one that is not NULL.
    """
    def key(df: DataFrame, name: str) -> Column:
        c = column(df, name)
        return fold(c) if ignore_case else text(c)

    asking = [i for i, u in enumerate(uses) if payload is not None and u.asks is not None]

    def tag(df: DataFrame, name: str, use: int, marked: Column | None) -> DataFrame:
        marks = [F.coalesce(F.lit(False) if marked is None else marked, F.lit(False)).alias("mark")] if asking else []
        return df.select(key(df, name).alias("key"), F.lit(use).alias("use"), *marks)

    tagged = [tag(u.df, u.column, i, u.asks) for i, u in enumerate(uses)]
    known = tag(parent, parent_key, _PARENT, column(parent, payload).isNotNull() if asking else None)
    per_key = union_all([*tagged, known.filter(~stands_for_missing(F.col("key")))]).groupBy("key").agg(
        *[F.expr(f"count_if(use = {i}) as n{i}") for i in range(len(uses))],
        F.expr(f"count_if(use = {_PARENT}) as parents"),
        *[F.expr(f"count_if(use = {i} and mark) as a{i}") for i in asking],
        *([F.expr(f"count_if(use = {_PARENT} and mark) as leading")] if asking else []),
    )

    folded = sentinel.lower() if sentinel is not None and ignore_case else sentinel
    is_sentinel = "false" if folded is None else f"key <=> {literal(folded)}"
    kinds = {
        "total": "true", "null_keys": "key is null", "sentinel_keys": "marked",
        "linked": "not marked and found", "dangling": "key is not null and not marked and not found",
        "linked_value": "value and not marked and found", "dangling_value": "value and not marked and not found",
    }
    judged = per_key.select(
        "*", F.expr(f"{is_sentinel} as marked"), F.expr("parents > 0 as found"),
        (~effectively_empty(F.col("key"))).alias("value"),
    )
    sums = judged.agg(*[
        F.expr(f"coalesce(sum(if({where}, n{i}, 0L)), 0L) as {kind}{i}")
        for i in range(len(uses)) for kind, where in kinds.items()
    ], *[F.expr(f"coalesce(sum(if(leading > 0, a{i}, 0L)), 0L) as led{i}") for i in asking])
    per_use = [
        f"named_struct('label', {literal(u.label)}, " + ", ".join(f"'{kind}', {kind}{i}" for kind in kinds)
        + f", 'led', {f'led{i}' if i in asking else '0L'})"
        for i, u in enumerate(uses)
    ]
    return sums.select(F.expr(f"inline({rows(per_use)})"))


def by_parent(rules: Sequence[FkRule]) -> list[list[FkRule]]:
    """Rules grouped by the parent column they point at."""
    groups: dict[tuple[str, str], list[FkRule]] = {}
    for rule in rules:
        groups.setdefault((rule.ref_table, rule.ref_column.lower()), []).append(rule)
    return list(groups.values())


def obstacle(rule: FkRule, ds: Dataset, reference: Dataset) -> str | None:
    """Why ``rule`` cannot be checked, if it cannot."""
    if rule.ref_table not in reference:
        return f"table {rule.ref_table} not loaded"
    if resolve(ds[rule.table], rule.column) is None or resolve(reference[rule.ref_table], rule.ref_column) is None:
        return "column missing"
    return None


def fk_metrics(
    ds: Dataset, rules: Sequence[FkRule], dimension: str = INTEGRITY, *,
    nulls_are_orphans: bool, ignore_case: bool, sentinel: str | None = None,
    report_sentinel: bool = False, full_rule_name: bool = True, reference: Dataset | None = None,
    detours: Sequence[FkRule] = (),
) -> DataFrame:
    """A metric per foreign key rule whose child table is loaded.

    ``nulls_are_orphans``: whether a NULL key counts as an error.
    ``sentinel``: a value that marks a known gap and is not an error;
    ``report_sentinel`` adds a row with their number, if there are any.
    ``full_rule_name``: "PATIENT→patients.ID" instead of "PATIENT".
    ``detours``: rules out of :func:`shared_detours`; the NULL keys that each could fill are counted in the same pass.
    """
    reference = reference or ds
    rules = [r for r in rules if r.table in ds]

    def shown(rule: FkRule) -> str:
        return rule.label if full_rule_name else rule.column

    parts: list[DataFrame] = []
    for rule in rules:
        why = obstacle(rule, ds, reference)
        if why:
            row = skipped(rule.table, dimension, shown(rule), f"not checked, {why}")
            parts.append(unfold(ds[rule.table].sparkSession.range(1), [row]))

    errors = "dangling + null_keys" if nulls_are_orphans else "dangling"
    waiting = list(detours)
    for group in by_parent([r for r in rules if obstacle(r, ds, reference) is None]):
        through = []
        for rule in group:
            through.append(next((d for d in waiting if _same_lookup(rule, d)), None))
            waiting = [d for d in waiting if d != through[-1]]
        gaps = [None if d is None else column(ds[d.table], d.column).isNull() for d in through]
        uses = [KeyUse(str(i), ds[r.table], r.column, gap) for i, (r, gap) in enumerate(zip(group, gaps))]
        counted = key_use_counts(
            uses, reference[group[0].ref_table], group[0].ref_column, ignore_case=ignore_case, sentinel=sentinel,
            payload=next((d.via.payload for d in through if d), None),
        )
        cases = []
        for i, rule in enumerate(group):
            lost = metric(rule.table, dimension, shown(rule), f"no such key in {rule.target}", errors, "total")
            always = [lost, *([fillable(through[i], "led", "total")] if through[i] else [])]
            if report_sentinel:
                marked = metric(rule.table, dimension, f"{rule.column}_{sentinel}", f"marked as {sentinel}",
                                "sentinel_keys", "total")
                cases.append(f"when '{i}' then if(sentinel_keys > 0, {rows([*always, marked])}, {rows(always)})")
            else:
                cases.append(f"when '{i}' then {rows(always)}")
        parts.append(unfold(counted, f"case label {' '.join(cases)} end"))
    return union_all(parts)


def fillable(rule: FkRule, errors: str, total: str, dimension: str = "11FI") -> str:
    """The metric of NULL keys that the detour of ``rule`` could fill."""
    via = rule.via
    return metric(rule.table, dimension, f"{rule.column}_Imputation_from_Encounter",
                  f"missing, but known through {via.column}→{via.table}.{via.key}", errors, total)


def _same_lookup(rule: FkRule, detour: FkRule) -> bool:
    """Whether ``rule`` looks up the column, and in the parent, that ``detour`` goes through."""
    via = detour.via
    own = (rule.table, rule.column.lower(), rule.ref_table, rule.ref_column.lower())
    return own == (detour.table, via.column.lower(), via.table, via.key.lower())


def shared_detours(ds: Dataset, rules: Sequence[FkRule], detours: Sequence[FkRule]) -> list[FkRule]:
    """The detours through a key that ``rules`` check anyway: one per key, with the same payload for all keys of a parent."""
    payloads: dict[tuple[str, str], str] = {}
    taken: set[FkRule] = set()
    out = []
    for d in detours:
        checked = next((r for r in rules if r not in taken and _same_lookup(r, d) and obstacle(r, ds, ds) is None), None)
        if checked is None or resolve(ds[d.table], d.column) is None or resolve(ds[d.via.table], d.via.payload) is None:
            continue
        if payloads.setdefault((d.via.table, d.via.key.lower()), d.via.payload.lower()) == d.via.payload.lower():
            taken.add(checked)
            out.append(d)
    return out


def orphans(
    child: DataFrame, fk: str, parent: DataFrame, pk: str, *,
    nulls_are_orphans: bool, ignore_case: bool, sentinel: str | None = None,
) -> DataFrame:
    """The rows of ``child`` whose key has no parent, as counted by :func:`fk_metrics`."""
    def key(df: DataFrame, name: str) -> Column:
        c = column(df, name)
        return fold(c) if ignore_case else text(c)

    keys = parent.select(key(parent, pk).alias("__parent")).filter(~stands_for_missing(F.col("__parent"))).distinct()
    own = key(child, fk)
    asked = child
    if sentinel is not None:
        asked = asked.filter(~own.eqNullSafe(F.lit(sentinel.lower() if ignore_case else sentinel)))
    if not nulls_are_orphans:
        asked = asked.filter(own.isNotNull())
    return asked.join(keys, own == keys["__parent"], "left_anti")


def empty_references(ds: Dataset, rules: Sequence[FkRule], dimension: str = "15C") -> DataFrame | None:
    """A warning per rule whose parent table has no key at all, so that no child can link."""
    parts = []
    for group in by_parent([r for r in rules if r.table in ds and obstacle(r, ds, ds) is None]):
        parent = ds[group[0].ref_table]
        key = column(parent, group[0].ref_column)
        seen = parent.filter(key.isNotNull()).limit(1).agg(F.count(F.lit(1)).alias("keys"))
        warnings = [
            metric(r.table, dimension, f"{r.column}_Ref_Table_Empty", f"{r.target} has no keys", "1", "1")
            for r in group
        ]
        parts.append(unfold(seen.filter("keys = 0"), warnings))
    return union_all(parts) if parts else None


def link_rates(ds: Dataset, rules: Sequence[FkRule], sentinel: str = UNKNOWN) -> DataFrame:
    """Per rule: keys marked unknown, keys with a value (``candidates``) and how many of them link."""
    usable = [r for r in rules if r.table in ds and obstacle(r, ds, ds) is None]
    parts = []
    for group in by_parent(usable):
        uses = [KeyUse("\n".join([r.table, r.column, r.target]), ds[r.table], r.column) for r in group]
        counted = key_use_counts(
            uses, ds[group[0].ref_table], group[0].ref_column, ignore_case=True, sentinel=sentinel
        )
        names = F.split("label", "\n")
        parts.append(counted.select(
            names[0].alias("table_name"), names[1].alias("fk_column"), names[2].alias("target"), "total",
            F.col("sentinel_keys").alias("unknown"),
            (F.col("linked_value") + F.col("dangling_value")).alias("candidates"),
            F.col("linked_value").alias("linked"),
        ))
    return union_all(parts)
