"""The stages of a quality run, each from tables to tables or metrics.

A full run is one chain: profile, validate, repair integrity, correct, re-assess.
``run`` writes the tables between the stages, so that later stages read rows
instead of repeating the plans before them, and a lost executor costs no more
than its own tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemend.constants import FAILED, MISSING_FK, REPEATED_ROWS
from tablemend.functions.columns import quoted
from tablemend.model import Dataset, FkRule, TableSpec
from tablemend.operators import report
from tablemend.operators.correct import correct, correct_marked, correction_log
from tablemend.operators.cross_rules import cross_profile
from tablemend.operators.integrity_report import integrity_report
from tablemend.operators.metrics import isolated, metric, skipped, union_all, unfold
from tablemend.operators.orphans import empty_references, fk_metrics, obstacle, shared_detours
from tablemend.operators.profile import profile, profile_with_duplicates
from tablemend.operators.repair import (
    CHANGED_PREFIX, MARK_MISSING, StoredLookups, fix_log, impute_candidates, repair_integrity, repair_keys,
)
from tablemend.operators.semantic import code_lookup, suggested_codes, unknown_codes
from tablemend.operators.structure import detect_domain, domain_metric, schema_drift
from tablemend.plans import synthea
from tablemend.sources.sinks import Steps, stage_dataset, stage_in_steps, stage_parts, write_dataset


def profile_dataset(
    ds: Dataset, specs: Mapping[str, TableSpec], fks: Sequence[FkRule] = synthea.PROFILE_FKS,
    isolate: bool = False, staging: str | None = None,
) -> DataFrame:
    """Completeness, duplicates, accuracy, timeliness, validity and key integrity.

    With ``isolate`` the tables are measured at once, one after the other, and a
    table that cannot be read is reported and left out instead of failing the run.
    With a folder ``staging``, the metrics of large tables are written there, those of one table after the other.
    """
    parts = []
    for name, df in ds.items():
        rules = specs[name].profile_rules if name in specs else synthea.profile_rules()
        own = profile_with_duplicates(df, name, rules, description=REPEATED_ROWS)
        parts.append(isolated(df.sparkSession, name, own) if isolate else own)
    if isolate:
        failed = {r["table_name"] for p in parts for r in p.filter(F.col("status") == FAILED).collect()}
        ds = {name: df for name, df in ds.items() if name not in failed}
    usable = [r for r in fks if r.table in ds and r.ref_table in ds]
    if usable:
        parts.append(fk_metrics(ds, usable, nulls_are_orphans=True, ignore_case=False))
    return stage_parts(parts, staging) if staging else union_all(parts)


def validate_dataset(
    ds: Dataset, specs: Mapping[str, TableSpec], impute: bool = True, limit: int | None = None, isolate: bool = False,
    staging: str | None = None,
) -> DataFrame:
    """All checks before the correction: domain, schema, syntax, keys, business, semantics, age.

    Outside the healthcare domain the rules that only make sense there are
    reported as skipped.  ``impute`` adds the count of keys that could be filled.
    With ``isolate`` a table that cannot be read is reported and left out.
    ``staging`` as in :func:`profile_dataset`.
    """
    spark = next(iter(ds.values())).sparkSession
    domain = detect_domain(list(ds), synthea.DOMAINS)
    parts = [domain_metric(spark, domain), schema_drift(ds, specs)]
    if isolate:
        ds, failures = _readable(ds)
        parts += failures
        if not ds:
            return union_all(parts)
    if domain is not synthea.HEALTHCARE:
        for name, df in ds.items():
            general = [r for r in (specs[name].validation_rules if name in specs else ()) if r.dimension != "7S"]
            parts.append(profile(df, name, general))
            parts.append(_skip(df, name, ("7S", "8BL", "8RI", "9S", "10CL", "11FI"), "outside the healthcare domain"))
        return union_all(parts)

    for name, df in ds.items():
        parts.append(profile(df, name, specs[name].validation_rules if name in specs else ()))
    rules = [r for name in ds if name in specs for r in specs[name].fk_rules]
    chained = {
        name: [r for r in specs[name].fk_rules if impute and r.via is not None and r.via.table in ds] if name in specs else []
        for name in ds
    }
    shared = shared_detours(ds, rules, [r for name, detours in chained.items() for r in detours if r.table == name])
    if rules:
        parts.append(fk_metrics(ds, rules, "8RI", nulls_are_orphans=False, ignore_case=True, full_rule_name=False,
                                detours=shared))
    parts += _cross_checks(ds, limit)
    if "conditions" in ds:
        codes = synthea.code_list(spark)
        parts += [
            unknown_codes(ds["conditions"], "conditions", codes),
            suggested_codes(ds["conditions"], "conditions", code_lookup(codes), limit=limit),
        ]
    for name, df in ds.items():
        spec = specs.get(name)
        parts += [impute_candidates(df, r, ds, limit=limit) for r in chained[name] if r not in shared]
        if not chained[name]:
            parts.append(_skip(df, name, ("11FI",), "no detour to fill keys from"))
        if not (spec and spec.fk_rules):
            parts.append(_skip(df, name, ("8RI",), "no foreign keys declared"))
        if name not in ("allergies", "medications"):
            parts.append(_skip(df, name, ("8BL",), "no business rules declared"))
        if name != "conditions":
            parts.append(_skip(df, name, ("9S", "10CL"), "no such rules declared"))
    return stage_parts(parts, staging) if staging else union_all(parts)


def _readable(ds: Dataset) -> tuple[Dataset, list[DataFrame]]:
    """The tables whose rows can be read in all columns, and a volume row for each of the others."""
    good, failures = {}, []
    for name, df in ds.items():
        digest = F.bit_xor(F.xxhash64(*[F.col(quoted(c)).cast("string") for c in df.columns]))
        counted = df.agg(F.count(F.lit(1)).alias("n"), digest.alias("digest"))
        read = "concat('rows can be read', if(digest is null, '', ''))"  # the digest makes the scan read every column
        row = metric(name, "6V", "Volume", "rows can be read", "0", "n").replace("'rows can be read'", read)
        found = isolated(df.sparkSession, name, unfold(counted, [row]))
        if found.filter(F.col("status") == FAILED).isEmpty():
            good[name] = df
        else:
            failures.append(found)
    return good, failures


def _skip(df: DataFrame, name: str, dimensions: Sequence[str], why: str) -> DataFrame:
    return unfold(df.sparkSession.range(1), [skipped(name, d, "Domain_Specific_Checks", why) for d in dimensions])


def _cross_checks(ds: Dataset, limit: int | None) -> list[DataFrame]:
    patients = ds.get("patients")
    if patients is None:
        return [_skip(df, name, ("8BL", "10CL"), "table patients not loaded") for name, df in ds.items()]
    parts = [
        cross_profile(ds[t], t, "PATIENT", patients, "ID", synthea.death_facts(patients),
                      synthea.after_death_rules(t), limit)
        for t in ("allergies", "medications") if t in ds
    ]
    if "conditions" in ds:
        parts.append(cross_profile(ds["conditions"], "conditions", "PATIENT", patients, "ID",
                                   synthea.clinical_facts(patients), synthea.clinical_rules(), limit))
    return parts


def correct_dataset(
    ds: Dataset, specs: Mapping[str, TableSpec], repair: bool = True, limit: int | None = None,
    stored: StoredLookups | None = None, staging: str | None = None,
) -> Dataset:
    """Corrected tables; ``repair`` also repairs foreign keys, against the keys as they came in.

    With ``stored`` (of ``ds``), the lookups of the keys are built once for all tables.  With a folder ``staging``,
    the corrected tables are written there."""
    def corrected(name: str, df: DataFrame, steps: Steps | None = None) -> DataFrame:
        spec = specs.get(name, TableSpec(name))
        fixed = correct(df, spec.fixes)
        return repair_keys(fixed, spec.fk_rules, ds, MARK_MISSING, limit, stored=stored, steps=steps) if repair else fixed

    return stage_in_steps(ds, staging, corrected) if staging else {name: corrected(name, df) for name, df in ds.items()}


def correct_with_log(
    ds: Dataset, specs: Mapping[str, TableSpec], staging: str, repair: bool = True, limit: int | None = None
) -> tuple[Dataset, DataFrame]:
    """Corrected tables and the log of changes, both from one run of the correction.

    The corrected rows are staged together with a mark per step, so counting the
    marks afterwards is a scan of a few narrow columns.  Lookups of keys are built once for all
    tables and written beside them.
    """
    stored = StoredLookups(ds, f"{staging.rstrip('/')}-lookups", limit)

    def marked(name: str, df: DataFrame, steps: Steps) -> DataFrame:
        spec = specs.get(name, TableSpec(name))
        rows = correct_marked(df, spec.fixes)
        return repair_keys(rows, spec.fk_rules, ds, MARK_MISSING, limit, True, stored, steps) if repair else rows

    staged = stage_in_steps(ds, staging, marked)
    warnings = empty_references(ds, [r for name in ds if name in specs for r in specs[name].fk_rules]) if repair else None
    logs = [] if warnings is None else [warnings]
    for name, rows in staged.items():
        spec = specs.get(name, TableSpec(name))
        logs.append(correction_log(rows, name, spec.fixes))
        keys = [c for c in rows.columns if c.startswith(CHANGED_PREFIX)]
        if keys:
            chained = {r.column for r in spec.fk_rules if r.via is not None}
            counted = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(quoted(k))).alias(k) for k in keys])
            logs.append(unfold(counted, [
                metric(name, "15C", _rekeyed(k, chained), "foreign key repaired", quoted(k), "n")
                for k in keys
            ]))
        left_out = _unrepaired(ds, name, spec) if repair else []
        if left_out:
            logs.append(unfold(rows.sparkSession.range(1), left_out))
    corrected = {name: rows.select(*[quoted(c) for c in ds[name].columns]) for name, rows in staged.items()}
    return corrected, union_all(logs)


def _unrepaired(ds: Dataset, name: str, spec: TableSpec) -> list[str]:
    """Rows for the key repairs that could not be made."""
    if not spec.fk_rules:
        return [skipped(name, "15C", "Cross_Table_Correction_Skipped", "no foreign keys declared")]
    reasons = {r.column: obstacle(r, ds, ds) for r in spec.fk_rules}
    return [skipped(name, "15C", f"{c}_FK_Correction_Skipped", f"not repaired, {why}") for c, why in reasons.items() if why]


def _rekeyed(flag: str, chained: set[str]) -> str:
    name = flag.removeprefix(CHANGED_PREFIX)
    return f"{name}_FK_Corrected_{'Three_Table' if name in chained else 'Direct'}"


def assess_corrected(
    ds: Dataset, specs: Mapping[str, TableSpec], sentinel: str | None = MISSING_FK, isolate: bool = False,
    staging: str | None = None,
) -> DataFrame:
    """The checks on corrected tables; keys marked with ``sentinel`` are counted apart.

    With ``isolate`` a table that cannot be read is reported and left out.
    ``staging`` as in :func:`profile_dataset`.
    """
    parts = []
    if isolate:
        ds, parts = _readable(ds)
        if not ds:
            return union_all(parts)
    for name, df in ds.items():
        rules = specs[name].post_rules if name in specs else ()
        parts.append(profile_with_duplicates(
            df, name, rules, "17PC_V", dimension="17PC_U", rule="Exact_Duplicates",
            description="duplicate rows after correction",
        ))
        if not (name in specs and specs[name].fk_rules):
            parts.append(_skip(df, name, ("17PC_RI",), "no foreign keys declared"))
    fks = [r for name in ds if name in specs for r in specs[name].fk_rules]
    if fks:
        parts.append(fk_metrics(ds, fks, "17PC_RI", nulls_are_orphans=False, ignore_case=True, sentinel=sentinel,
                                report_sentinel=sentinel is not None, full_rule_name=False))
        empty = empty_references(ds, fks, "17PC_RI")
        parts += [] if empty is None else [empty]
    return stage_parts(parts, staging) if staging else union_all(parts)


@dataclass(frozen=True)
class Outcome:
    tables: Dataset
    before: DataFrame
    validation: DataFrame
    integrity: DataFrame
    fixes: DataFrame
    corrections: DataFrame
    saved: DataFrame
    after: DataFrame
    comparison: DataFrame


def run(ds: Dataset, as_of: str, base: str, out_format: str = "csv", limit: int | None = None) -> Outcome:
    """Profile and validate, repair integrity, correct, save under ``base`` and measure again.

    Every measurement is made once and written under ``base``/metrics; the outcome reads it there.
    """
    specs = synthea.specs(as_of)
    base = base.rstrip("/")
    stored = StoredLookups(ds, f"{base}/lookups", limit)
    linked = repair_integrity(ds, specs, limit, stored, f"{base}/linked")
    tables, corrections = correct_with_log(linked, specs, f"{base}/marked", limit=limit)
    saved = write_dataset(tables, f"{base}/corrected", out_format)
    parts = f"{base}/metrics-parts"
    metrics = stage_dataset({
        "before": profile_dataset(ds, specs, staging=f"{parts}/before"),
        "validation": validate_dataset(ds, specs, limit=limit, staging=f"{parts}/validation"),
        "fixes": fix_log(ds, specs), "integrity": integrity_report(linked, specs), "corrections": corrections,
        "assessed": assess_corrected(tables, specs, staging=f"{parts}/assessed"),
        "after": profile_dataset(tables, specs, staging=f"{parts}/after"),
    }, f"{base}/metrics")
    return Outcome(
        tables=tables, before=metrics["before"], validation=metrics["validation"], integrity=metrics["integrity"],
        fixes=metrics["fixes"], corrections=metrics["corrections"], saved=saved, after=metrics["assessed"],
        comparison=report.before_after(metrics["before"], metrics["after"]),
    )
