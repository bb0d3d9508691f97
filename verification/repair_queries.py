"""Queries for corrections, key repair, the integrity report, re-assessment and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemend.constants import STOPPED_EARLY, TIMELINESS
from tablemend.functions.dates import EUROPEAN, ISO
from tablemend.model import FkRule
from tablemend.operators import correct as C
from tablemend.operators.integrity_report import integrity_report
from tablemend.operators.metrics import union_all
from tablemend.operators.orphans import empty_references, link_rates, orphans
from tablemend.operators.profile import profile
from tablemend.operators.repair import (
    MARK_MISSING, StoredLookups, fix_log, repair_integrity, repair_keys, sanitize_identifiers,
)
from tablemend.operators.structure import volumes
from tablemend.operators.uniqueness import drop_duplicate_rows
from tablemend.plans import pipeline, synthea
from tablemend.sources.discovery import discover
from tablemend.sources.readers import read_text
from tablemend.sources.sinks import (
    export_json, offending_sample, write_corrupted, write_dataset, write_table,
)
from verification import clinic
from verification import sql as S
from verification.catalog import query
from verification.profile_queries import specs

def _folder(spark: SparkSession) -> str:
    """A new folder for files of a query, in the folder that all executors share."""
    return clinic.folder(spark)


# --- one correction at a time ------------------------------------------------


def _rows(table: str, **replaced: str) -> str:
    """The rows of a table, some columns replaced."""
    return "SELECT " + ", ".join(
        f'{replaced[c]} AS "{c}"' if c in replaced else f'"{c}"' for c in S.COLUMNS[table]
    ) + f" FROM {table}"


def _iso(d: str) -> str:
    return f"CAST({d} AS VARCHAR)"


def _clamped(later: str, earlier: str) -> str:
    return f"CASE WHEN {later} < {earlier} THEN {earlier} ELSE {later} END"


def _not_future(d: str) -> str:
    return f"CASE WHEN {d} > {S.TODAY} THEN {S.TODAY} ELSE {d} END"


def sql_life_dates(birth: str = "BIRTHDATE", death: str = "DEATHDATE") -> dict[str, str]:
    b, d = S.any_day(birth, *S.BIRTH), S.any_day(death, *S.BIRTH)
    return {"BIRTHDATE": _iso(_not_future(b)), "DEATHDATE": _iso(_not_future(f"({_clamped(d, b)})"))}


def sql_period(start: str = "START", stop: str = "STOP") -> dict[str, str]:
    a, b = S.any_day(start, *S.PERIOD), S.any_day(stop, *S.PERIOD)
    return {"START": _iso(a), "STOP": _iso(_clamped(b, a))}


def sql_keep(c: str, unwanted: str) -> str:
    return f"coalesce(nullif(regexp_replace({c}, '{unwanted}', '', 'g'), ''), CASE WHEN {c} IS NOT NULL THEN 'INVALID_FORMAT' END)"


def sql_gender(c: str) -> str:
    return f"CASE WHEN lower({c}) IN ('m', 'f') THEN upper({c}) ELSE 'U' END"


def sql_code(c: str) -> str:
    return f"CASE WHEN {S.matches(c, '^[0-9]+$')} THEN {c} ELSE 'UNKNOWN' END"


def sql_identifier(c: str) -> str:
    bare = f"regexp_replace({c}, '^bad-', '')"
    return f"CASE WHEN {S.matches(bare, '^[A-Za-z0-9-]+$')} OR {c} IS NULL THEN {bare} ELSE 'UNKNOWN' END"


@query("correct_fill", S.with_(S.ctes("patients", "conditions"), f"""
SELECT coalesce(GENDER, 'UNKNOWN') AS a, coalesce(DEATHDATE, 'UNKNOWN') AS b, coalesce(DRIVERS, 'UNKNOWN') AS c FROM patients
UNION ALL SELECT coalesce(PATIENT, 'UNKNOWN'), coalesce(STOP, 'UNKNOWN'), coalesce(CODE, 'UNKNOWN') FROM conditions"""))
def correct_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = clinic.dirty(spark, sf_dir, "patients", "conditions")
    a = C.fill_nulls(ds["patients"]).selectExpr("GENDER a", "DEATHDATE b", "DRIVERS c")
    return a.unionByName(C.fill_nulls(ds["conditions"]).selectExpr("PATIENT a", "STOP b", "CODE c"))


@query("correct_dedup", S.with_(S.ctes("encounters"), "SELECT DISTINCT * FROM encounters"))
def correct_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_duplicate_rows(clinic.dirty(spark, sf_dir, "encounters")["encounters"])


@query("correct_domain", S.with_(S.ctes("patients"), _rows("patients", GENDER=sql_gender("GENDER"))))
def correct_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.apply_fix(clinic.dirty(spark, sf_dir, "patients")["patients"], C.fix_gender())


@query("correct_life_dates", S.with_(S.ctes("patients"), _rows("patients", **sql_life_dates())))
def correct_life_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    fix = C.fix_life_dates("BIRTHDATE", "DEATHDATE", synthea.BIRTH_LAYOUTS, F.lit(clinic.AS_OF).cast("date"))
    return C.apply_fix(clinic.dirty(spark, sf_dir, "patients")["patients"], fix)


@query("correct_dates", S.with_(S.ctes("conditions"), _rows("conditions", **sql_period())))
def correct_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    fix = C.fix_period("START", "STOP", synthea.PERIOD_LAYOUTS)
    return C.apply_fix(clinic.dirty(spark, sf_dir, "conditions")["conditions"], fix)


_TWO = ("compact", "iso", "eu")


@query("correct_dates_without_dotted", S.with_(S.ctes("conditions"), _rows(
    "conditions", START=_iso(S.any_day("START", *_TWO)),
    STOP=_iso(_clamped(S.any_day("STOP", *_TWO), S.any_day("START", *_TWO))))))
def correct_dates_without_dotted(spark: SparkSession, sf_dir: str) -> DataFrame:
    fix = C.fix_period("START", "STOP", ("yyyyMMdd", ISO, EUROPEAN))
    return C.apply_fix(clinic.dirty(spark, sf_dir, "conditions")["conditions"], fix)


@query("correct_digits", S.with_(S.ctes("patients"), _rows(
    "patients", SSN=sql_keep("SSN", "[^0-9]"), DRIVERS=sql_keep("DRIVERS", "[^A-Za-z0-9-]"))))
def correct_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = C.apply_fix(clinic.dirty(spark, sf_dir, "patients")["patients"], C.fix_characters("SSN", "[^0-9]"))
    return C.apply_fix(df, C.fix_characters("DRIVERS", "[^A-Za-z0-9-]"))


@query("correct_code", S.with_(S.ctes("encounters"), _rows("encounters", CODE=sql_code("CODE"))))
def correct_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.apply_fix(clinic.dirty(spark, sf_dir, "encounters")["encounters"], C.fix_numeric_code())


@query("correct_ids", S.with_(S.ctes("encounters"), _rows(
    "encounters", ID=sql_identifier("ID"), PATIENT=sql_identifier("PATIENT"))))
def correct_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = clinic.dirty(spark, sf_dir, "encounters")["encounters"]
    return C.apply_fix(C.apply_fix(df, C.fix_identifier("ID")), C.fix_identifier("PATIENT"))


@query("correct_trim", S.with_(S.ctes("patients"), "SELECT " + ", ".join(
    f'trim("{c}") AS "{c}"' for c in S.COLUMNS["patients"]) + " FROM patients"))
def correct_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.trim_texts(clinic.dirty(spark, sf_dir, "patients")["patients"])


# --- the whole correction of a table -----------------------------------------

def corrected_ctes(table: str, suffix: str = "_fixed") -> list[str]:
    """fill -> distinct -> fix -> trim, as CTEs; the last one is ``<table><suffix>``."""
    filled = ", ".join(f"""coalesce("{c}", 'UNKNOWN') AS "{c}\"""" for c in S.COLUMNS[table])
    if table == "patients":
        new = {"GENDER": sql_gender("GENDER"), **sql_life_dates(), "SSN": sql_keep("SSN", "[^0-9]"),
               "DRIVERS": sql_keep("DRIVERS", "[^A-Za-z0-9-]"), "ID": sql_identifier("ID")}
    else:
        ids = ("ID", "PATIENT") if table == "encounters" else ("PATIENT", "ENCOUNTER")
        new = {**sql_period(), "CODE": sql_code("CODE"), **{c: sql_identifier(c) for c in ids}}
    fixed = ", ".join(f'trim({new.get(c, chr(34) + c + chr(34))}) AS "{c}"' for c in S.COLUMNS[table])
    return [
        f"{table}_filled AS (SELECT DISTINCT {filled} FROM {table})",
        f"{table}{suffix} AS (SELECT {fixed} FROM {table}_filled)",
    ]


def _correction(table: str) -> None:
    @query(f"correct_table_{table}", S.with_([*S.ctes(table), *corrected_ctes(table)], f"SELECT * FROM {table}_fixed"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return clinic.dirty(spark, sf_dir, table)[table].transform(C.corrector(specs()[table]))


for _t in S.TABLES:
    _correction(_t)


def _log_ctes(table: str) -> tuple[list[str], list[str]]:
    """CTEs and metric rows of the correction log."""
    cols = S.COLUMNS[table]
    q = [f'"{c}"' for c in cols]
    filled = ", ".join(f"""coalesce({c}, 'UNKNOWN') AS {c}""" for c in q)
    steps = [
        S.metric_from(table, "15C", "Completeness_Auto_Fill", "missing values filled",
                      f"SELECT count(*) FILTER (WHERE {' OR '.join(c + ' IS NULL' for c in q)}) AS e, count(*) AS t FROM {table}"),
        S.metric_from(table, "15C", "Exact_Duplicates_Removed", "duplicate rows removed",
                      f"SELECT (SELECT count(*) FROM {table}) - (SELECT count(*) FROM {table}_filled) AS e, "
                      f"(SELECT count(*) FROM {table}) AS t"),
    ]

    def fix(name: str, text: str, new: dict[str, str]) -> None:
        changed = " OR ".join(f'"{c}" IS DISTINCT FROM ({e})' for c, e in new.items())
        steps.append(S.check(table, "15C", name, text, changed, f"{table}_filled"))

    if table == "patients":
        fix("GENDER_Corrected", "other values set to U", {"GENDER": sql_gender("GENDER")})
        fix("Dates_Corrected", "order, format and future dates repaired", sql_life_dates())
        fix("SSN_Format_Corrected", "[^0-9] removed", {"SSN": sql_keep("SSN", "[^0-9]")})
        fix("DRIVERS_Format_Corrected", "[^A-Za-z0-9-] removed", {"DRIVERS": sql_keep("DRIVERS", "[^A-Za-z0-9-]")})
        ids = ("ID",)
    else:
        fix("StartStop_Dates_Corrected", "order and format repaired", sql_period())
        fix("CODE_Format_Corrected", "codes other than digits set to UNKNOWN", {"CODE": sql_code("CODE")})
        ids = ("ID", "PATIENT") if table == "encounters" else ("PATIENT", "ENCOUNTER")
    for c in ids:
        fix(f"{c}_Format_Corrected", "prefix removed, invalid set to UNKNOWN", {c: sql_identifier(c)})
    # No fix leaves blanks at the ends, so only untouched columns can be trimmed.
    untouched = [c for c in cols if c in ("FIRST", "MARITAL", "ENCOUNTERCLASS", "DESCRIPTION", "TYPE")]
    steps.append(S.check(table, "15C", "Whitespace_Trimmed", "surrounding blanks removed",
                         " OR ".join(f'trim("{c}") <> "{c}"' for c in untouched), f"{table}_filled"))
    return [f"{table}_filled AS (SELECT DISTINCT {filled} FROM {table})"], steps


_LOGS = [_log_ctes(t) for t in S.TABLES]


@query("correction_log", S.with_([*S.ctes(*S.TABLES), *[c for ctes, _ in _LOGS for c in ctes]],
                                 S.union([s for _, steps in _LOGS for s in steps])))
def correction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_all(
        C.correction_log(C.correct_marked(df, specs()[n].fixes), n, specs()[n].fixes)
        for n, df in clinic.dirty(spark, sf_dir).items()
    )


# --- key repair --------------------------------------------------------------

PATIENT_KEYS = "patient_keys AS (SELECT DISTINCT lower(ID) AS id FROM patients WHERE ID IS NOT NULL)"
ENCOUNTER_KEYS = """encounter_keys AS (
  SELECT lower(e.ID) AS id, min(CASE WHEN p.id IS NOT NULL THEN e.PATIENT END) AS parent
  FROM encounters e LEFT JOIN patient_keys p ON lower(e.PATIENT) = p.id WHERE e.ID IS NOT NULL GROUP BY 1)"""


def repaired(table: str, source: str, sentinel: str, if_unknown: bool) -> str:
    """The repair of all keys of a table, as a query."""
    if table == "encounters":
        return f"""SELECT c.* REPLACE (CASE WHEN p.id IS NOT NULL THEN c.PATIENT ELSE '{sentinel}' END AS PATIENT)
FROM {source} c LEFT JOIN patient_keys p ON lower(c.PATIENT) = p.id"""
    own = "WHEN p.id IS NOT NULL THEN c.PATIENT"
    if if_unknown:
        choice = f"CASE WHEN lower(c.PATIENT) = 'unknown' AND e.parent IS NOT NULL THEN e.parent {own} ELSE '{sentinel}' END"
    else:
        choice = f"CASE {own} WHEN e.parent IS NOT NULL THEN e.parent ELSE '{sentinel}' END"
    return f"""SELECT c.* REPLACE ({choice} AS PATIENT,
  CASE WHEN e.id IS NOT NULL THEN c.ENCOUNTER ELSE '{sentinel}' END AS ENCOUNTER)
FROM {source} c LEFT JOIN patient_keys p ON lower(c.PATIENT) = p.id
LEFT JOIN encounter_keys e ON lower(c.ENCOUNTER) = e.id"""


KEY_CTES = [PATIENT_KEYS, ENCOUNTER_KEYS]


@query("repair_fk_direct", S.with_([*S.ctes("patients", "encounters"), PATIENT_KEYS],
                                   repaired("encounters", "encounters", "MISSING_FK", False)))
def repair_fk_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = clinic.dirty(spark, sf_dir, "patients", "encounters")
    return repair_keys(ds["encounters"], synthea.fk_rules("encounters"), ds, MARK_MISSING)


def _chained(table: str) -> None:
    @query(f"repair_fk_chained_{table}", S.with_([*S.ctes("patients", "encounters", table), *KEY_CTES],
                                                 repaired(table, table, "MISSING_FK", False)))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ds = clinic.dirty(spark, sf_dir, "patients", "encounters", table)
        return repair_keys(ds[table], synthea.fk_rules(table), ds, MARK_MISSING)


for _t in synthea.CLINICAL:
    _chained(_t)


@query("repair_fk_sliced", S.with_([*S.ctes("patients", "encounters", "conditions"), *KEY_CTES],
                                   repaired("conditions", "conditions", "MISSING_FK", False)))
def repair_fk_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair without any broadcast of keys."""
    ds = clinic.dirty(spark, sf_dir, "patients", "encounters", "conditions")
    return repair_keys(ds["conditions"], synthea.fk_rules("conditions"), ds, MARK_MISSING, limit=-1)


_SKEWED = "CASE WHEN o_orderkey % 3 = 0 THEN '7' WHEN o_orderkey % 3 = 1 THEN CAST(o_custkey AS {text}) END"


@query("repair_fk_hot_key", f"""
SELECT o_orderkey, CASE WHEN k IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 2 = 1) THEN k
  ELSE 'MISSING_FK' END AS custkey
FROM (SELECT o_orderkey, {_SKEWED.replace('{text}', 'VARCHAR')} AS k FROM orders)""")
def repair_fk_hot_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the rows have one key and a third have none; the lookup is not broadcast."""
    orders = clinic.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", f"{_SKEWED.replace('{text}', 'STRING')} as custkey")
    odd = clinic.table(spark, sf_dir, "customer").filter("c_custkey % 2 = 1")
    rule = FkRule("orders", "custkey", "customer", "c_custkey")
    return repair_keys(orders, [rule], {"customer": odd}, MARK_MISSING, limit=-1)


def sanitized(table: str) -> str:
    ids = {"patients": ("ID",), "encounters": ("ID",)}.get(table, ("PATIENT", "ENCOUNTER"))
    new = {c: f"CASE WHEN {S.bad_uuid(c)} THEN 'UNKNOWN' ELSE {c} END" for c in ids}
    return f"{table}_clean AS ({_rows(table, **new)})"


@query("sanitize_ids", S.with_([*S.ctes(*S.TABLES), *[sanitized(t) for t in S.TABLES]], """
SELECT 'patients' AS table_name, ID AS a, GENDER AS b FROM patients_clean
UNION ALL SELECT 'encounters', ID, PATIENT FROM encounters_clean
UNION ALL SELECT 'conditions', PATIENT, ENCOUNTER FROM conditions_clean
UNION ALL SELECT 'medications', PATIENT, ENCOUNTER FROM medications_clean
UNION ALL SELECT 'allergies', PATIENT, ENCOUNTER FROM allergies_clean"""))
def sanitize_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = {"patients": ("ID", "GENDER"), "encounters": ("ID", "PATIENT")}
    parts = []
    for n, df in clinic.dirty(spark, sf_dir).items():
        a, b = shown.get(n, ("PATIENT", "ENCOUNTER"))
        clean = sanitize_identifiers(df, specs()[n].identifiers)
        parts.append(clean.select(F.lit(n).alias("table_name"), F.col(a).alias("a"), F.col(b).alias("b")))
    return union_all(parts)


def linked(table: str) -> str:
    """A table after the integrity repair, as a CTE."""
    if table == "patients":
        return "patients_linked AS (SELECT * FROM patients_clean)"
    return f"{table}_linked AS ({repaired(table, f'{table}_clean', 'UNKNOWN', True)})"


LINKED_CTES = [*S.ctes(*S.TABLES), *[sanitized(t) for t in S.TABLES], *KEY_CTES, *[linked(t) for t in S.TABLES]]


def _repaired_integrity(spark: SparkSession, sf_dir: str, staging: str | None = None):
    """All tables after the integrity repair; the lookups of their parents are built once."""
    ds = clinic.derived(spark, sf_dir)
    return repair_integrity(ds, specs(), stored=StoredLookups(ds, _folder(spark)), staging=staging)


@query("repair_integrity", S.with_(LINKED_CTES, """
SELECT 'encounters' AS table_name, ID, PATIENT, '' AS ENCOUNTER FROM encounters_linked
UNION ALL SELECT 'patients', ID, '', '' FROM patients_linked
UNION ALL SELECT 'conditions', START, PATIENT, ENCOUNTER FROM conditions_linked
UNION ALL SELECT 'medications', START, PATIENT, ENCOUNTER FROM medications_linked
UNION ALL SELECT 'allergies', START, PATIENT, ENCOUNTER FROM allergies_linked"""))
def repair_all_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = _repaired_integrity(spark, sf_dir)
    parts = [fixed["encounters"].select(F.lit("encounters").alias("table_name"), "ID", "PATIENT",
                                        F.lit("").alias("ENCOUNTER")),
             fixed["patients"].select(F.lit("patients").alias("table_name"), "ID", F.lit("").alias("PATIENT"),
                                      F.lit("").alias("ENCOUNTER"))]
    for t in synthea.CLINICAL:
        parts.append(fixed[t].select(F.lit(t).alias("table_name"), F.col("START").alias("ID"), "PATIENT", "ENCOUNTER"))
    return union_all(parts)


_FK = [("encounters", "PATIENT", "patients")] + [
    (t, c, p) for t in synthea.CLINICAL for c, p in (("PATIENT", "patients"), ("ENCOUNTER", "encounters"))
]


def _fix_log_sql() -> list[str]:
    parts = []
    for t in S.TABLES:
        for c in {"patients": ("ID",), "encounters": ("ID",)}.get(t, ("PATIENT", "ENCOUNTER")):
            parts.append(S.check(t, "Integ_Fix", f"{c}_Format_Corrected", "no UUID, set to UNKNOWN", S.bad_uuid(c)))
    for t, c, p in _FK:
        kind = "Chained" if t != "encounters" and c == "PATIENT" else "Direct"
        parts.append(S.orphans(t, "Integ_Fix", f"{c}_FK_Corrected_{kind}", c, p, "ID", nulls=False, fold=True,
                               child=f"{t}_clean", target=f"{p}.ID", but="UNKNOWN"))
    return parts


@query("fix_log", S.with_([*S.ctes(*S.TABLES), *[sanitized(t) for t in S.TABLES]],
                          f"SELECT * FROM ({S.union(_fix_log_sql())}) WHERE error_count > 0"))
def integrity_fix_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fix_log(clinic.dirty(spark, sf_dir), specs())


def _rate(table: str, c: str, parent: str, suffix: str) -> str:
    value = f"NOT {S.empty('c.' + c)}"
    found = f"EXISTS (SELECT 1 FROM {parent}{suffix} p WHERE lower(p.ID) = lower(c.{c}))"
    return f"""SELECT '{table}' AS table_name, '{c}' AS fk_column, '{parent}.ID' AS target, count(*) AS total,
  count(*) FILTER (WHERE lower({c}) = 'unknown') AS unknown, count(*) FILTER (WHERE {value}) AS candidates,
  count(*) FILTER (WHERE {value} AND {found}) AS linked FROM {table}{suffix} c"""


@query("link_report", S.with_(S.ctes(*S.TABLES), S.union([_rate(t, c, p, "") for t, c, p in _FK])))
def link_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_rates(clinic.dirty(spark, sf_dir), [r for t in synthea.TABLES for r in synthea.fk_rules(t)])


def _two(e: str, t: str) -> str:
    return f"CAST(CAST(({S.pct(e, t)}) AS DECIMAL(5,2)) AS VARCHAR)"


def _integrity_sql() -> list[str]:
    parts = []
    for t in S.TABLES:
        for c in S.COLUMNS[t]:
            parts.append(f"""SELECT '{t}' AS table_name, 'Completeness' AS metric_type, '{c}' AS column_name,
  {_two('n - e', 'n')} || '% aizpildīts' AS value, n - e AS raw_count, n AS total_count
  FROM (SELECT count(*) AS n, count(*) FILTER (WHERE {S.empty('"' + c + '"')}) AS e FROM {t}_linked)""")
    for t, c, p in _FK:
        rate = f"({_rate(t, c, p, '_linked')})"
        share = f"CASE WHEN candidates = 0 THEN '100.00' ELSE {_two('linked', 'candidates')} END"
        parts.append(f"""SELECT '{t}', 'Referential Integrity (Unlinked Valid FK - Post-Fix)', '{c} -> {p}.ID',
  {share} || '% atbilstība (' || (candidates - linked) || ' neatbilstošas *derīgas* vērtības)', linked, candidates FROM {rate}""")
        parts.append(f"""SELECT '{t}', 'Referential Integrity (UNKNOWN FK - Post-Fix)', '{c} (UNKNOWN Sentinel)',
  unknown || ' vērtības ir ''UNKNOWN''', unknown, total FROM {rate} WHERE unknown > 0""")
    return parts


@query("integrity_report", S.with_(LINKED_CTES, S.union(_integrity_sql())))
def report_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked_tables = _repaired_integrity(spark, sf_dir, _folder(spark))
    return integrity_report(linked_tables, specs())


# --- correction with key repair, and what is left ----------------------------

CORRECTED_CTES = [
    *S.ctes(*S.TABLES), *KEY_CTES,
    *[c for t in S.TABLES for c in corrected_ctes(t)],
    "patients_done AS (SELECT * FROM patients_fixed)",
    *[f"{t}_done AS ({repaired(t, f'{t}_fixed', 'MISSING_FK', False)})" for t in S.TABLES if t != "patients"],
]


def _post_sql() -> list[str]:
    parts = []
    for t in S.TABLES:
        d = f"{t}_done"
        parts += [S.check(t, "17PC_C", c, "missing value (NULL) after correction", f'"{c}" IS NULL', d)
                  for c in S.COLUMNS[t]]
        if t == "patients":
            parts += [
                S.check(t, "17PC_A", "GENDER", "invalid gender after correction", "GENDER NOT IN ('M', 'F', 'U')", d),
                S.check(t, "17PC_A", "BIRTHDATE/DEATHDATE", "died before birth after correction",
                        f"{S.day('DEATHDATE')} < {S.day('BIRTHDATE')}", d),
                S.check(t, "17PC_A", "BIRTHDATE_Future", "in the future after correction",
                        f"{S.day('BIRTHDATE')} > {S.TODAY}", d),
                S.check(t, "17PC_A", "DEATHDATE_Future", "in the future after correction",
                        f"{S.day('DEATHDATE')} > {S.TODAY}", d),
                S.check(t, "17PC_V", "SSN_Format", "other than digits after correction",
                        f"NOT {S.matches('SSN', '^[0-9]+$')} AND SSN <> 'INVALID_FORMAT'", d),
                S.check(t, "17PC_V", "DRIVERS_Format", "other than letters, digits and dashes after correction",
                        f"NOT {S.matches('DRIVERS', '^[A-Za-z0-9-]+$')} AND DRIVERS <> 'INVALID_FORMAT'", d),
            ]
        else:
            parts += [
                S.check(t, "17PC_V", "CODE", "other than digits after correction",
                        f"NOT {S.matches('CODE', '^[0-9]+$')}", d),
                S.check(t, "17PC_T", "START/STOP", "STOP before START after correction",
                        f"{S.day('STOP')} < {S.day('START')}", d),
            ]
        parts.append(S.duplicates(t, "17PC_U", "Exact_Duplicates", "duplicate rows after correction", d))
    parts.append(S.skip("patients", "17PC_RI", "Domain_Specific_Checks", "no foreign keys declared"))
    for t, c, p in _FK:
        parts.append(S.orphans(t, "17PC_RI", c, c, p, "ID", nulls=False, fold=True, child=f"{t}_done",
                               ref=f"{p}_done", target=f"{p}.ID", but="MISSING_FK"))
        parts.append("SELECT * FROM (" + S.check(
            t, "17PC_RI", f"{c}_MISSING_FK", "marked as MISSING_FK", f"{c} = 'MISSING_FK'", f"{t}_done"
        ) + ") WHERE error_count > 0")
    return parts


@query("post_correction_metrics", S.with_(CORRECTED_CTES, S.union(_post_sql())))
def post_correction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = clinic.derived(spark, sf_dir)
    corrected = pipeline.correct_dataset(ds, specs(), stored=StoredLookups(ds, _folder(spark)), staging=_folder(spark))
    return pipeline.assess_corrected(corrected, specs(), staging=_folder(spark))


def _corrected(table: str) -> None:
    needed = [t for t in ("patients", "encounters", table) if t != table] + [table]
    if table == "encounters":
        needed = ["patients", "encounters"]
    keys = KEY_CTES if table != "encounters" else [PATIENT_KEYS]

    @query(f"correct_and_repair_{table}", S.with_(
        [*S.ctes(*needed), *keys, *corrected_ctes(table)], repaired(table, f"{table}_fixed", "MISSING_FK", False)))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ds = clinic.dirty(spark, sf_dir, *needed)
        return repair_keys(C.correct(ds[table], specs()[table].fixes), specs()[table].fk_rules, ds, MARK_MISSING)


for _t in ("encounters", "conditions"):
    _corrected(_t)


# --- sinks and sources -------------------------------------------------------

def _round_trip(fmt: str) -> None:
    @query(f"sink_roundtrip_{fmt}", S.with_(S.ctes("conditions"), "SELECT * FROM conditions"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = _folder(spark)
        written = write_corrupted(clinic.dirty(spark, sf_dir, "conditions"), base, [fmt])
        assert list(written) == ["conditions"]
        schemas = {"conditions": clinic.dirty(spark, sf_dir, "conditions")["conditions"].schema}
        return discover(spark, base, "formats", schemas)["conditions"].select(*S.COLUMNS["conditions"])


for _fmt in ("csv", "json", "parquet"):
    _round_trip(_fmt)


@query("source_parts_layout", S.with_(S.ctes("medications"), "SELECT * FROM medications"))
def source_parts_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _folder(spark)
    write_table(clinic.dirty(spark, sf_dir, "medications")["medications"], f"{base}/medications", "csv")
    return discover(spark, base, "parts")["medications"]


@query("source_text_lines", "SELECT event_type AS value FROM events")
def source_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/lines"
    clinic.table(spark, sf_dir, "events").select("event_type").write.text(path)
    return read_text(spark, path)


@query("empty_reference", S.metric_from(
    "lineitem", "15C", "l_orderkey_Ref_Table_Empty", "orders.o_orderkey has no keys",
    "SELECT 1 AS e, 1 AS t WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < -1e18)"))
def empty_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = {"lineitem": clinic.table(spark, sf_dir, "lineitem"),
          "orders": clinic.table(spark, sf_dir, "orders").filter("o_totalprice < -1e18")}
    return empty_references(ds, [FkRule("lineitem", "l_orderkey", "orders", "o_orderkey")])


_SAVED = ("customer", "orders", "lineitem")


@query("sink_dataset_saved", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, 'Data_Saved_HDFS' AS rule_name, count(*) AS total_count FROM {t}" for t in _SAVED))
def sink_dataset_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = {t: clinic.table(spark, sf_dir, t) for t in _SAVED}
    return write_dataset(ds, _folder(spark), "parquet").select("table_name", "rule_name", "total_count")


@query("sink_metrics_json", S.union(
    [S.metric_from(t, "6V", "Volume", "table has rows", f"SELECT 0 AS e, count(*) AS t FROM {t}") for t in _SAVED]))
def sink_metrics_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_folder(spark)}/metrics"
    found = volumes({t: clinic.table(spark, sf_dir, t) for t in _SAVED})
    export_json(found, path)
    return spark.read.schema(found.schema).json(path)


_NO_PATIENT = "SELECT * FROM encounters WHERE {nulls} coalesce(PATIENT NOT IN (SELECT ID FROM patients WHERE ID IS NOT NULL), {null})"


@query("orphan_rows_nulls_count", S.with_(S.ctes("patients", "encounters"), _NO_PATIENT.format(nulls="PATIENT IS NULL OR", null="true")))
def orphan_rows_nulls_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = clinic.dirty(spark, sf_dir, "patients", "encounters")
    return orphans(ds["encounters"], "PATIENT", ds["patients"], "ID", nulls_are_orphans=True, ignore_case=False)


@query("orphan_rows_nonnull_ci", S.with_(S.ctes("encounters", "conditions"), """
SELECT * FROM conditions WHERE ENCOUNTER IS NOT NULL AND lower(ENCOUNTER) <> 'bad'
AND lower(ENCOUNTER) NOT IN (SELECT lower(ID) FROM encounters WHERE ID IS NOT NULL)"""))
def orphan_rows_nonnull_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = clinic.dirty(spark, sf_dir, "encounters", "conditions")
    return orphans(ds["conditions"], "ENCOUNTER", ds["encounters"], "ID", nulls_are_orphans=False, ignore_case=True,
                   sentinel="BAD")


@query("offending_sample", S.with_(S.ctes("patients", "encounters"), f"""
SELECT PATIENT, ID, START FROM ({_NO_PATIENT.format(nulls="", null="false")})
ORDER BY PATIENT NULLS FIRST, ID NULLS FIRST, START NULLS FIRST LIMIT 5"""))
def sample_of_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = clinic.dirty(spark, sf_dir, "patients", "encounters")
    lost = orphans(ds["encounters"], "PATIENT", ds["patients"], "ID", nulls_are_orphans=False, ignore_case=False)
    return offending_sample(lost, F.lit(True), ["PATIENT", "ID", "START"])


@query("repair_numeric_keys", """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_partkey % 5 <> 0 THEN CAST(l_partkey AS VARCHAR) ELSE 'MISSING_FK' END AS l_partkey,
       CASE WHEN l_suppkey % 3 = 0 THEN CAST(l_suppkey AS VARCHAR) ELSE 'UNKNOWN' END AS code
FROM lineitem""")
def repair_numeric_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers as keys and codes: parts divisible by five are missing, two suppliers in three have a negative code."""
    part = clinic.table(spark, sf_dir, "part").filter("p_partkey % 5 <> 0")
    lines = clinic.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "if(l_suppkey % 3 = 0, l_suppkey, -l_suppkey) AS code")
    linked = repair_keys(lines, [FkRule("lineitem", "l_partkey", "part", "p_partkey")], {"part": part}, MARK_MISSING)
    return C.apply_fix(linked, C.fix_numeric_code("code"))


@query("correct_fill_numbers", """
SELECT l_orderkey, CASE WHEN l_quantity > 45 THEN 0 ELSE l_quantity END AS quantity,
       CASE WHEN l_partkey % 7 = 0 THEN 0 ELSE l_partkey END AS part,
       CASE WHEN l_returnflag = 'N' THEN 'UNKNOWN' ELSE l_returnflag END AS flag, l_shipdate
FROM lineitem""")
def correct_fill_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = clinic.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "if(l_quantity > 45, null, l_quantity) AS quantity", "if(l_partkey % 7 = 0, null, l_partkey) AS part",
        "nullif(l_returnflag, 'N') AS flag", "l_shipdate")
    return C.fill_nulls(holes)


@query("profile_numeric_period", S.metric_from("orders", TIMELINESS, "START/STOP", STOPPED_EARLY, """
SELECT count(*) FILTER (WHERE o_orderkey % 11 = 0) AS e, count(*) AS t FROM orders"""))
def profile_numeric_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """START and STOP as 64-bit numbers, the declared type: one order in eleven stops before it starts."""
    rows = clinic.table(spark, sf_dir, "orders").selectExpr(
        "unix_timestamp(cast(o_orderdate as timestamp)) AS START",
        "unix_timestamp(cast(o_orderdate as timestamp)) + if(o_orderkey % 11 = 0, -1, 86400) AS STOP")
    rules = [r for r in synthea.profile_rules() if getattr(r, "name", "") == "START/STOP"]
    return profile(rows, "orders", rules)
