"""Queries for sources, profiling, validation, key checks and injection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemend.constants import (
    ACCURACY, BAD_DATE, BAD_FORMAT, BAD_GENDER, CODE_PATTERN, COMPLETENESS, DASHED_PATTERN, DIED_EARLY, DIGITS_PATTERN,
    DIMENSION_NAMES, EMPTY_VALUE, REPEATED_ROWS, STOPPED_EARLY, TIMELINESS, UNIQUENESS, VALIDITY,
)
from tablemend.functions import predicates as P
from tablemend.functions.dates import cast_date
from tablemend.functions.draws import HashDraws
from tablemend.model import ColumnRule, CrossRule, FkRule, Rule
from tablemend.operators.cross_rules import cross_profile
from tablemend.operators.metrics import union_all
from tablemend.operators.orphans import KeyUse, fk_metrics, key_use_counts
from tablemend.operators.profile import profile
from tablemend.operators.report import by_dimension
from tablemend.operators.semantic import code_lookup, suggest_codes, suggested_codes, unknown_codes
from tablemend.operators.structure import (
    detect_domain, domain_metric, overview, schema_drift, volumes,
)
from tablemend.operators.uniqueness import duplicate_keys, duplicate_rows
from tablemend.plans import pipeline, synthea
from tablemend.operators.repair import impute_candidates
from verification import clinic
from verification import sql as S
from verification.catalog import query


def specs():
    return synthea.specs(clinic.AS_OF)


STAR = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                 "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "labels": ["doc_id", "quality", "toxic"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "conversations": ["conv_id", "turn", "role", "text"],
    "embeddings": ["vec_id", "embedding", "label"],
}


def star(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: clinic.table(spark, sf_dir, n).select(*STAR[n]) for n in names or STAR}


# --- completeness and volume -------------------------------------------------



def _complete_sql(table: str, columns: list[str]) -> str:
    return S.union([
        S.check(table, COMPLETENESS, c.upper(), EMPTY_VALUE, f'"{c}" IS NULL OR CAST("{c}" AS VARCHAR) = \'\'')
        for c in columns
    ])


def _completeness(table: str) -> None:
    @query(f"profile_completeness_{table}", _complete_sql(table, STAR[table]))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rule = ColumnRule(COMPLETENESS, EMPTY_VALUE, P.null_or_empty, upper_names=True)
        return profile(star(spark, sf_dir, table)[table], table, [rule])


for _t in ("customer", "orders", "lineitem", "documents", "events"):
    _completeness(_t)


@query("profile_completeness_dirty", S.with_(S.ctes(*S.TABLES), S.union(
    [_complete_sql(t, S.COLUMNS[t]) for t in S.TABLES]
    + [S.check(t, "7S", c, "missing value (NULL)", f'"{c}" IS NULL') for t in S.TABLES for c in S.COLUMNS[t]]
)))
def completeness_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [ColumnRule(COMPLETENESS, EMPTY_VALUE, P.null_or_empty, upper_names=True),
             ColumnRule("7S", "missing value (NULL)", P.is_null)]
    return union_all(profile(df, n, rules) for n, df in clinic.dirty(spark, sf_dir).items())


@query("completeness_nullable", S.with_(S.ctes("patients"), S.union([
    S.check("patients", "12C", c, "missing value (NULL)" + (": expected here" if c == "DEATHDATE" else ""),
            "false" if c == "DEATHDATE" else f'"{c}" IS NULL')
    for c in S.COLUMNS["patients"]
])))
def completeness_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    nullable = frozenset(synthea.HEALTHCARE.nullable_columns["patients"])
    rule = ColumnRule("12C", "missing value (NULL)", P.is_null, exempt=nullable)
    return profile(clinic.dirty(spark, sf_dir, "patients")["patients"], "patients", [rule])


@query("table_volumes", S.union([
    S.metric_from(t, "6V", "Volume", "table has rows", f"SELECT 0 AS e, count(*) AS t FROM {t}") for t in STAR
]))
def table_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volumes(star(spark, sf_dir))


@query("empty_table_volume", S.union([
    S.metric_from("orders", "6V", "Volume", "table has no rows",
                  "SELECT count(*) AS e, count(*) AS t FROM orders WHERE o_totalprice < -1e18", "empty"),
]))
def empty_table_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = star(spark, sf_dir, "orders")["orders"].filter("o_totalprice < -1e18")
    rule = ColumnRule(COMPLETENESS, EMPTY_VALUE, P.null_or_empty, upper_names=True)
    return profile(none, "orders", [rule])


# --- uniqueness --------------------------------------------------------------

@query("profile_row_duplicates", S.with_(S.ctes("patients", "encounters"), S.union(
    [S.duplicates(t, UNIQUENESS, None, "duplicate rows") for t in ["patients", "encounters", *STAR]]
    + [S.duplicates("documents.text", UNIQUENESS, None, "duplicate rows", "(SELECT text FROM documents)")]
)))
def row_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = clinic.dirty(spark, sf_dir, "patients", "encounters") | star(spark, sf_dir)
    tables["documents.text"] = tables["documents"].select("text")
    return union_all(duplicate_rows(df, n) for n, df in tables.items())


_KEYS = {
    "lineitem": ["l_orderkey", "l_linenumber"], "orders": ["o_orderkey"], "conversations": ["conv_id", "turn"],
    "documents": ["text"], "patients": ["ID"], "encounters": ["ID"], "conditions": ["PATIENT", "CODE", "START"],
}


@query("profile_key_duplicates", S.with_(S.ctes("patients", "encounters", "conditions"), S.union(
    [S.repeats(t, UNIQUENESS, key) for t, key in _KEYS.items()]
)))
def key_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = clinic.dirty(spark, sf_dir, "patients", "encounters", "conditions")
    tables |= star(spark, sf_dir, "lineitem", "orders", "conversations", "documents")
    return union_all(duplicate_keys(tables[t], t, key) for t, key in _KEYS.items())


# --- domains, dates, formats -------------------------------------------------

@query("domain_violations", S.with_(S.ctes("patients"), S.union([
    S.check("patients", ACCURACY, "GENDER", "outside M, F, U", "GENDER NOT IN ('M', 'F', 'U')"),
    S.check("patients", "7S", "GENDER", "missing or outside m, f", "GENDER IS NULL OR lower(GENDER) NOT IN ('m', 'f')"),
    S.check("customer", ACCURACY, "c_mktsegment", "unknown segment", "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
    S.check("orders", ACCURACY, "o_orderstatus", "unknown status", "o_orderstatus NOT IN ('F', 'O')"),
])))
def domain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = star(spark, sf_dir, "customer", "orders")
    return union_all([
        profile(clinic.dirty(spark, sf_dir, "patients")["patients"], "patients", [
            Rule(ACCURACY, "GENDER", "outside M, F, U", lambda c: P.outside(c, ("M", "F", "U")), ("GENDER",)),
            Rule("7S", "GENDER", "missing or outside m, f",
                 lambda c: P.null_or_outside(c, ("m", "f"), ignore_case=True), ("GENDER",)),
        ]),
        profile(ds["customer"], "customer", [
            Rule(ACCURACY, "c_mktsegment", "unknown segment",
                 lambda c: P.outside(c, ("BUILDING", "MACHINERY")), ("c_mktsegment",))]),
        profile(ds["orders"], "orders", [
            Rule(ACCURACY, "o_orderstatus", "unknown status", lambda c: P.outside(c, ("F", "O")), ("o_orderstatus",))]),
    ])


_PARSED = [("patients", "BIRTHDATE"), ("patients", "DEATHDATE"), ("encounters", "START"), ("encounters", "STOP"),
           ("conditions", "START"), ("conditions", "STOP"), ("medications", "START"), ("allergies", "STOP")]


@query("date_parse_failures", S.with_(S.ctes(*S.TABLES), S.union([
    S.check(t, ACCURACY, c, "no date", f"{S.day(c)} IS NULL") for t, c in _PARSED
])))
def date_parse_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = clinic.dirty(spark, sf_dir)
    return union_all(
        profile(df, n, [Rule(ACCURACY, c, "no date", lambda c: cast_date(c).isNull(), (c,))
                        for t, c in _PARSED if t == n])
        for n, df in ds.items()
    )


def _validation_checks(table: str) -> list[str]:
    """The row-local checks of the validation in SQL."""
    order = S.check(table, "7S", "START/STOP", "STOP before START",
                    f"{S.any_day('STOP', *S.PERIOD)} < {S.any_day('START', *S.PERIOD)}")
    code = S.check(table, "7S", "CODE_AlphanumericFormat", "not letters, digits, dots and dashes",
                   f"NOT {S.matches('CODE', '^[A-Za-z0-9.-]+$')}")

    def number(c: str) -> str:
        return f"TRY_CAST(regexp_extract({c}, '^\\s*([+-]?\\d+)(?:\\.\\d*)?\\s*$', 1) AS BIGINT) IS NOT NULL"

    def unreadable(c: str, *layouts: str) -> str:
        return f"{c} IS NULL OR NOT ({S.any_day(c, *layouts)} IS NOT NULL OR {number(c)})"

    own = {
        "patients": [
            S.check(table, "7S", "BIRTHDATE", "born in the years 19xx", "BIRTHDATE LIKE '19%'"),
            S.check(table, "7S", "DEATHDATE", "died before birth", f"{S.day('DEATHDATE')} < {S.day('BIRTHDATE')}"),
            S.check(table, "7S", "GENDER", "missing or neither m nor f",
                    "GENDER IS NULL OR lower(GENDER) NOT IN ('m', 'f')"),
            S.check(table, "7S", "BIRTHDATE_Completeness", "missing", "BIRTHDATE IS NULL"),
            S.check(table, "7S", "BIRTHDATE_Format", "in none of the layouts",
                    f"BIRTHDATE IS NOT NULL AND {S.any_day('BIRTHDATE', *S.BIRTH)} IS NULL"),
            S.check(table, "7S", "BIRTHDATE_Future", "in the future",
                    f"{S.any_day('BIRTHDATE', *S.BIRTH)} > {S.TODAY}"),
            S.check(table, "7S", "DEATHDATE_Future", "in the future",
                    f"{S.any_day('DEATHDATE', *S.BIRTH)} > {S.TODAY}"),
            S.check(table, "7S", "SSN_Format", "other than digits", f"NOT {S.matches('SSN', '^[0-9]+$')}"),
            S.check(table, "7S", "DRIVERS_Format", "other than letters, digits and dashes",
                    f"NOT {S.matches('DRIVERS', '^[A-Za-z0-9-]+$')}"),
        ],
        "encounters": [
            S.check(table, "7S", "START", "missing or INVALID", "START IS NULL OR START = 'INVALID'"),
            S.check(table, "7S", "PATIENT", "missing or BAD", "PATIENT IS NULL OR PATIENT = 'BAD'"),
            order, code,
        ],
        "conditions": [
            S.check(table, "7S", "PATIENT", "missing", "PATIENT IS NULL"),
            S.check(table, "7S", "ENCOUNTER", "is 0000", "ENCOUNTER = '0000'"),
            S.check(table, "7S", "STOP", "in none of the layouts and no number",
                    f"STOP IS NOT NULL AND {S.any_day('STOP', *S.STALE)} IS NULL AND NOT {number('STOP')}"),
            order, code,
        ],
        "medications": [
            S.check(table, "7S", "START", "missing or unreadable", unreadable("START", "iso")),
            S.check(table, "7S", "STOP", "missing or unreadable", unreadable("STOP", "iso", "dot")),
            S.check(table, "7S", "ENCOUNTER", "missing", "ENCOUNTER IS NULL"),
            S.check(table, "7S", "PATIENT", "missing", "PATIENT IS NULL"),
            order, code,
        ],
        "allergies": [code],
    }[table]
    nulls = [S.check(table, "7S", c, "missing value (NULL)", f'"{c}" IS NULL') for c in S.COLUMNS[table]]
    complete = [
        S.check(table, "12C", c, "missing value (NULL)" + (": expected here" if c == "DEATHDATE" else ""),
                "false" if c == "DEATHDATE" else f'"{c}" IS NULL')
        for c in S.COLUMNS[table]
    ]
    if table == "patients":
        age = S.skip(table, "12T", "Timeliness", "not checked, column missing: older than five years")
    else:
        age = S.check(table, "12T", "Timeliness", "older than five years",
                      f"{S.any_day('STOP', *S.STALE)} < {S.TODAY} - 1825")
    return [*nulls, *own, *complete, age]


def _validation(table: str) -> None:
    @query(f"validate_{table}", S.with_(S.ctes(table), S.union(_validation_checks(table))))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return profile(clinic.dirty(spark, sf_dir, table)[table], table, specs()[table].validation_rules)


for _t in S.TABLES:
    _validation(_t)


@query("medication_dates_strict", S.with_(S.ctes("medications"), S.union([
    S.check("medications", "7S", "START", "missing or unreadable",
            f"START IS NULL OR {S.day('START')} IS NULL OR NOT {S.matches('START', '^[0-9]+$')}"),
    S.check("medications", "7S", "STOP", "missing or unreadable",
            f"STOP IS NULL OR {S.day('STOP')} IS NULL OR {S.day('STOP', 'dot')} IS NULL "
            f"OR NOT {S.matches('STOP', '^[0-9]+$')}"),
])))
def medication_dates_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = synthea.specs(clinic.AS_OF, strict_medications=True)["medications"].validation_rules
    wanted = [r for r in rules if isinstance(r, Rule) and r.description == "missing or unreadable"]
    return profile(clinic.dirty(spark, sf_dir, "medications")["medications"], "medications", wanted)


_ORDERED = {"patients": ("BIRTHDATE", "DEATHDATE"), "encounters": ("START", "STOP"), "conditions": ("START", "STOP"),
            "medications": ("START", "STOP"), "allergies": ("START", "STOP")}


@query("date_order_violations", S.with_(S.ctes(*S.TABLES), S.union([
    S.check(t, TIMELINESS, f"{a}/{b}", "wrong order", f"{S.day(b)} < {S.day(a)}") for t, (a, b) in _ORDERED.items()
])))
def date_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_all(
        profile(df, n, [Rule(TIMELINESS, "/".join(_ORDERED[n]), "wrong order",
                             lambda a, b: cast_date(b) < cast_date(a), _ORDERED[n])])
        for n, df in clinic.dirty(spark, sf_dir).items()
    )


@query("regex_violations", S.with_(S.ctes("patients", "encounters", "conditions"), S.union([
    S.check("patients", VALIDITY, "SSN", "not digits", f"NOT {S.matches('SSN', '^[0-9]+$')}"),
    S.check("patients", VALIDITY, "DRIVERS", "not dashed", f"NOT {S.matches('DRIVERS', '^[A-Za-z0-9-]+$')}"),
    S.check("encounters", VALIDITY, "CODE", "not a code", f"NOT {S.matches('CODE', '^[A-Za-z0-9.-]+$')}"),
    S.check("encounters", VALIDITY, "ID", "no UUID", S.bad_uuid("ID")),
    S.check("conditions", VALIDITY, "CODE", "not a code", f"NOT {S.matches('CODE', '^[A-Za-z0-9.-]+$')}"),
    S.check("conditions", VALIDITY, "ENCOUNTER", "no UUID", S.bad_uuid("ENCOUNTER")),
    S.check("customer", VALIDITY, "c_name", "not a code", f"NOT {S.matches('c_name', '^[A-Za-z0-9.-]+$')}"),
    S.check("part", VALIDITY, "p_brand", "not a code", f"NOT {S.matches('p_brand', '^[A-Za-z0-9.-]+$')}"),
    S.check("part", VALIDITY, "p_partkey", "not digits", f"NOT {S.matches('CAST(p_partkey AS VARCHAR)', '^[0-9]+$')}"),
])))
def regex_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rule(name: str, text: str, test) -> Rule:
        return Rule(VALIDITY, name, text, test, (name,))

    def code(name: str) -> Rule:
        return rule(name, "not a code", lambda c: P.mismatch(c, CODE_PATTERN))

    def digits(name: str) -> Rule:
        return rule(name, "not digits", lambda c: P.mismatch(c, DIGITS_PATTERN))

    ds = clinic.dirty(spark, sf_dir, "patients", "encounters", "conditions") | star(spark, sf_dir, "customer", "part")
    rules = {
        "patients": [digits("SSN"), rule("DRIVERS", "not dashed", lambda c: P.mismatch(c, DASHED_PATTERN))],
        "encounters": [code("CODE"), rule("ID", "no UUID", P.invalid_uuid)],
        "conditions": [code("CODE"), rule("ENCOUNTER", "no UUID", P.invalid_uuid)],
        "customer": [code("c_name")],
        "part": [code("p_brand"), digits("p_partkey")],
    }
    return union_all(profile(df, n, rules[n]) for n, df in ds.items())


@query("future_dates", S.union([
    S.check("orders", "7S", "o_orderdate", "in the future", "CAST(o_orderdate AS DATE) > DATE '2000-01-01'"),
    S.check("lineitem", "7S", "l_shipdate", "in the future", "CAST(l_shipdate AS DATE) > DATE '2000-01-01'"),
]))
def future_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    today = F.lit("2000-01-01").cast("date")
    dates = {"orders": "o_orderdate", "lineitem": "l_shipdate"}
    return union_all(
        profile(df, n, [Rule("7S", dates[n], "in the future", lambda c: cast_date(c) > today, (dates[n],))])
        for n, df in star(spark, sf_dir, *dates).items()
    )


@query("stale_records", S.union([
    S.check("orders", "12T", "o_orderdate", "stale", "CAST(o_orderdate AS DATE) < DATE '2001-06-01' - 1825"),
    S.check("events", "12T", "ts", "stale", "CAST(ts AS DATE) < DATE '2024-01-15'"),
]))
def stale_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = star(spark, sf_dir, "orders", "events")
    old = F.date_sub(F.lit("2001-06-01").cast("date"), synthea.STALE_DAYS)
    recent = F.lit("2024-01-15").cast("date")
    return union_all([
        profile(ds["orders"], "orders", [Rule("12T", "o_orderdate", "stale", lambda c: cast_date(c) < old, ("o_orderdate",))]),
        profile(ds["events"], "events", [Rule("12T", "ts", "stale", lambda c: cast_date(c) < recent, ("ts",))]),
    ])


# --- the whole profile -------------------------------------------------------

_FKS = [("encounters", "PATIENT", "patients", "ID"), ("conditions", "ENCOUNTER", "encounters", "ID"),
        ("medications", "PATIENT", "patients", "ID"), ("medications", "ENCOUNTER", "encounters", "ID")]


def profile_sql(tables: list[str]) -> list[str]:
    parts = []
    for t in tables:
        parts.append(_complete_sql(t, S.COLUMNS[t]))
        parts.append(S.duplicates(t, UNIQUENESS, None, REPEATED_ROWS))
        if t == "patients":
            parts += [
                S.check(t, ACCURACY, "GENDER", BAD_GENDER, "GENDER NOT IN ('M', 'F', 'U')"),
                S.check(t, ACCURACY, "BIRTHDATE", BAD_DATE, f"{S.day('BIRTHDATE')} IS NULL"),
                S.check(t, TIMELINESS, "BIRTHDATE/DEATHDATE", DIED_EARLY,
                        f"{S.day('DEATHDATE')} < {S.day('BIRTHDATE')}"),
            ]
        else:
            parts += [
                S.check(t, TIMELINESS, "START/STOP", STOPPED_EARLY, f"{S.day('STOP')} < {S.day('START')}"),
                S.check(t, VALIDITY, "CODE", BAD_FORMAT, f"NOT {S.matches('CODE', '^[A-Za-z0-9.-]+$')}"),
            ]
    return parts + [
        S.orphans(t, "Starptabulu integritāte", f"{c}→{p}.{k}", c, p, k, nulls=True, fold=False)
        for t, c, p, k in _FKS if t in tables
    ]


@query("profile_dataset", S.with_(S.ctes(*S.TABLES), S.union(profile_sql(S.TABLES))))
def profile_dirty_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.profile_dataset(clinic.derived(spark, sf_dir), specs())


# --- keys --------------------------------------------------------------------

@query("fk_orphans_null_counts", S.with_(S.ctes("patients", "encounters", "conditions", "medications"), S.union([
    S.orphans(t, "Starptabulu integritāte", f"{c}→{p}.{k}", c, p, k, nulls=True, fold=False) for t, c, p, k in _FKS
])))
def fk_orphans_null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = clinic.dirty(spark, sf_dir, "patients", "encounters", "conditions", "medications")
    return fk_metrics(ds, synthea.PROFILE_FKS, nulls_are_orphans=True, ignore_case=False)


_ALL_FKS = [("encounters", "PATIENT", "patients")] + [
    (t, c, p) for t in synthea.CLINICAL for c, p in (("PATIENT", "patients"), ("ENCOUNTER", "encounters"))
]


@query("fk_orphans_nonnull_ci", S.with_(S.ctes(*S.TABLES), S.union([
    S.orphans(t, "8RI", c, c, p, "ID", nulls=False, fold=True) for t, c, p in _ALL_FKS
])))
def fk_orphans_nonnull_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = clinic.dirty(spark, sf_dir)
    rules = [r for t in synthea.TABLES for r in synthea.fk_rules(t)]
    return fk_metrics(ds, rules, "8RI", nulls_are_orphans=False, ignore_case=True, full_rule_name=False)


_STAR_FKS = [("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"),
             ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"),
             ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
             ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"),
             ("events", "user_id", "customer", "c_custkey")]


@query("fk_orphans_star", S.union([
    S.orphans(t, "8RI", f"{c}→{p}.{k}", c, p, k, nulls=False, fold=True) for t, c, p, k in _STAR_FKS
]))
def fk_orphans_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [FkRule(*r) for r in _STAR_FKS]
    return fk_metrics(star(spark, sf_dir), rules, "8RI", nulls_are_orphans=False, ignore_case=True)


@query("key_use_counts", S.with_(S.ctes("patients", "encounters", "medications"), """
SELECT label, count(*) AS total, count(*) FILTER (WHERE key IS NULL) AS null_keys,
  count(*) FILTER (WHERE key = 'bad') AS sentinel_keys,
  count(*) FILTER (WHERE key IS NOT NULL AND key <> 'bad' AND known) AS linked,
  count(*) FILTER (WHERE key IS NOT NULL AND key <> 'bad' AND NOT known) AS dangling
FROM (
  SELECT label, key, key IN (SELECT lower(ID) FROM patients WHERE ID IS NOT NULL) AS known
  FROM (SELECT 'encounters' AS label, lower(PATIENT) AS key FROM encounters
        UNION ALL SELECT 'medications', lower(PATIENT) FROM medications))
GROUP BY label"""))
def key_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = clinic.dirty(spark, sf_dir, "patients", "encounters", "medications")
    uses = [KeyUse(t, ds[t], "PATIENT") for t in ("encounters", "medications")]
    counted = key_use_counts(uses, ds["patients"], "ID", ignore_case=True, sentinel="BAD")
    return counted.select("label", "total", "null_keys", "sentinel_keys", "linked", "dangling")


# --- rules across tables -----------------------------------------------------

_DEATHS = f"""
deaths AS (SELECT lower(ID) AS id, min({S.day('DEATHDATE')}) AS died FROM patients GROUP BY 1)"""


_AFTER_DEATH = [
    S.metric_from(t, "8BL", "START/DEATHDATE", f"{t} after the patient's death", f"""
      SELECT count(*) FILTER (WHERE {S.day('START')} > died) AS e, count(*) AS t
      FROM {t} c LEFT JOIN deaths ON lower(c.PATIENT) = deaths.id""")
    for t in ("allergies", "medications")
]


@query("event_after_parent_date",
       S.with_([*S.ctes("patients", "medications", "allergies"), _DEATHS], S.union(_AFTER_DEATH)))
def event_after_parent_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = clinic.dirty(spark, sf_dir, "patients", "medications", "allergies")
    return union_all(
        cross_profile(ds[t], t, "PATIENT", ds["patients"], "ID", synthea.death_facts(ds["patients"]),
                      synthea.after_death_rules(t))
        for t in ("allergies", "medications")
    )


@query("shipped_before_ordered", S.metric_from(
    "lineitem", "8BL", "l_shipdate/o_orderdate", "shipped before the order", """
      SELECT count(*) FILTER (WHERE CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE)) AS e, count(*) AS t
      FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"""))
def shipped_before_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = star(spark, sf_dir, "lineitem", "orders")
    rule = CrossRule("8BL", "l_shipdate/o_orderdate", "shipped before the order", ("l_shipdate",), cast_date,
                     ("ordered",), None, lambda shipped, ordered: shipped < ordered)
    facts = {"ordered": F.min(cast_date(F.col("o_orderdate")))}
    return cross_profile(ds["lineitem"], "lineitem", "l_orderkey", ds["orders"], "o_orderkey", facts, [rule])


_CLINICAL_CTES = f"""
facts AS (SELECT lower(ID) AS id, bool_or(lower(GENDER) = 'm') AS male, max({S.day('BIRTHDATE')}) AS born
  FROM patients GROUP BY 1),
joined AS (SELECT c.DESCRIPTION, male, born FROM conditions c LEFT JOIN facts ON lower(c.PATIENT) = facts.id)"""
_CLINICAL = [
    S.check("conditions", "10CL", "Male_Pregnancy", "pregnancy of a man",
            "lower(DESCRIPTION) LIKE '%pregnancy%' AND male", "joined"),
    S.check("conditions", "10CL", "Young_Type2_Diabetes", "type 2 diabetes of somebody born after 2015-01-01",
            "lower(DESCRIPTION) LIKE '%type 2 diabetes mellitus%' AND born > DATE '2015-01-01'", "joined"),
]


@query("cross_attribute_conflict",
       S.with_([*S.ctes("patients", "conditions"), _CLINICAL_CTES], S.union(_CLINICAL)))
def cross_attribute_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = clinic.dirty(spark, sf_dir, "patients", "conditions")
    return cross_profile(ds["conditions"], "conditions", "PATIENT", ds["patients"], "ID",
                         synthea.clinical_facts(ds["patients"]), synthea.clinical_rules())


# --- codes -------------------------------------------------------------------

NORM = "lower(replace(replace(trim({c}), ' (finding)', ''), ' (disorder)', ''))"


_UNKNOWN_CODES = S.check(
    "conditions", "9S", "CODE_SNOMED_Validity", "numeric code not in the code list",
    f"{S.matches('CODE', '^[0-9]+$')} AND CODE NOT IN (SELECT code FROM code_list)")


@query("semantic_unknown_codes", S.with_([*S.ctes("conditions"), S.CODE_LIST], _UNKNOWN_CODES))
def semantic_unknown_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unknown_codes(clinic.dirty(spark, sf_dir, "conditions")["conditions"], "conditions",
                         synthea.code_list(spark))


_NEEDS = f"(CODE IS NULL OR NOT {S.matches('CODE', '^[0-9]+$')})"
_SUGGEST = f"""
suggestions AS (SELECT {NORM.replace('{c}', 'description')} AS name, min(code) AS suggested FROM code_list GROUP BY 1),
suggested_rows AS (SELECT c.*, CASE WHEN {_NEEDS} THEN suggested END AS "SUGGESTED_CODE"
  FROM conditions c LEFT JOIN suggestions ON {NORM.replace('{c}', 'c.DESCRIPTION')} = suggestions.name)"""


_SUGGESTED_CODES = S.check(
    "conditions", "9S", "CODE_Correction_by_Description", "code known from the description",
    '"SUGGESTED_CODE" IS NOT NULL', "suggested_rows")


@query("semantic_suggested_codes", S.with_([*S.ctes("conditions"), S.CODE_LIST, _SUGGEST], _SUGGESTED_CODES))
def semantic_suggested_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggested_codes(clinic.dirty(spark, sf_dir, "conditions")["conditions"], "conditions",
                           code_lookup(synthea.code_list(spark)))


@query("semantic_suggestions", S.with_([*S.ctes("conditions"), S.CODE_LIST, _SUGGEST], "SELECT * FROM suggested_rows"))
def semantic_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest_codes(clinic.dirty(spark, sf_dir, "conditions")["conditions"], code_lookup(synthea.code_list(spark)))


@query("semantic_unknown_parts", S.check(
    "lineitem", "9S", "l_partkey", "numeric code not in the code list",
    "l_linenumber = 2 OR l_partkey NOT IN (SELECT p_partkey FROM part)"))
def semantic_unknown_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = star(spark, sf_dir, "lineitem", "part")
    lines = ds["lineitem"].withColumn("l_partkey", F.expr("if(l_linenumber = 2, l_partkey + 1000000000000, l_partkey)"))
    return unknown_codes(lines, "lineitem", ds["part"], "l_partkey", "p_partkey", rule="l_partkey")


_THROUGH = "through AS (SELECT lower(ID) AS id, min(PATIENT) AS parent FROM encounters GROUP BY 1)"
_IMPUTABLE = [
    S.metric_from(t, "11FI", "PATIENT_Imputation_from_Encounter",
                  "missing, but known through ENCOUNTER→encounters.ID", f"""
      SELECT count(*) FILTER (WHERE PATIENT IS NULL AND parent IS NOT NULL) AS e, count(*) AS t
      FROM {t} c LEFT JOIN through ON lower(c.ENCOUNTER) = through.id""")
    for t in synthea.CLINICAL
]


@query("impute_parent_candidates", S.with_([*S.ctes("encounters", *synthea.CLINICAL), _THROUGH], S.union(_IMPUTABLE)))
def impute_parent_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = clinic.dirty(spark, sf_dir, "encounters", *synthea.CLINICAL)
    return union_all(impute_candidates(ds[t], synthea.fk_rules(t)[0], ds) for t in synthea.CLINICAL)


# --- structure ---------------------------------------------------------------

@query("structure_overview", S.union([
    f"SELECT '{t}' AS table_name, CAST({len(c)} AS BIGINT) AS n_columns, count(*) AS n_rows FROM {t}"
    for t, c in STAR.items()
]))
def structure_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview(star(spark, sf_dir))


def _declared(table: str) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in synthea.schema(table)]


def _drift_sql(table: str) -> list[str]:
    """What the texts of the clinic's tables lack against the declaration, written out per column."""
    declared, found = _declared(table), S.COLUMNS[table]
    n, parts = len(declared), []

    def finding(rule: str, text: str, errors: int, total: int) -> None:
        parts.append(S.metric_from(table, "5SV", rule, text, f"SELECT {errors} AS e, {total} AS t"))

    for name, kind in declared:
        if name not in found:
            finding(name, "declared column missing", 1, n)
        elif kind != "string":
            finding(name, f"declared {kind}, found string", 1, n)
    extra = [c for c in found if c not in dict(declared)]
    if extra:
        finding("Unexpected Columns", f"not declared: {', '.join(extra)}", len(extra), len(found))
    return parts


@query("schema_drift", S.with_(S.ctes(*S.TABLES), S.union(
    [p for t in S.TABLES for p in _drift_sql(t)]
    + [S.metric_from(t, "6V", "Volume", "table has rows", f"SELECT 0 AS e, count(*) AS t FROM {t}") for t in S.TABLES]
)))
def schema_and_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = clinic.dirty(spark, sf_dir)
    return schema_drift(ds, specs()).unionByName(volumes(ds))


@query("domain_detection", S.union(
    [S.metric_from("Global", "5DD", "Domain Detection", "domain: Rūpniecība", "SELECT 0 AS e, 1 AS t")]
    + [S.metric_from(t, "6V", "Volume", "table has rows", f"SELECT 0 AS e, count(*) AS t FROM {t}") for t in STAR]
))
def domain_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = star(spark, sf_dir)
    return domain_metric(spark, detect_domain(list(ds), synthea.DOMAINS)).unionByName(volumes(ds))


@query("schema_undeclared", S.union(
    [S.metric_from(t, "5MD", "Schema Definition", "no schema declared", "SELECT 1 AS e, 1 AS t") for t in STAR]
    + [S.metric_from(t, "6V", "Volume", "table has rows", f"SELECT 0 AS e, count(*) AS t FROM {t}") for t in STAR]
))
def schema_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = star(spark, sf_dir)
    return schema_drift(ds, {}).unionByName(volumes(ds))


# --- the whole validation ----------------------------------------------------

def _validation_sql() -> list[str]:
    def skip(table: str, dimension: str, why: str) -> str:
        return S.skip(table, dimension, "Domain_Specific_Checks", why)

    found = S.metric_from("Global", "5DD", "Domain Detection", "domain: Veselības aprūpe", "SELECT 0 AS e, 1 AS t")
    return [
        found, *[p for t in S.TABLES for p in [*_drift_sql(t), *_validation_checks(t)]],
        *[S.orphans(t, "8RI", c, c, p, "ID", nulls=False, fold=True) for t, c, p in _ALL_FKS],
        *_AFTER_DEATH, *_CLINICAL, _UNKNOWN_CODES, _SUGGESTED_CODES, *_IMPUTABLE,
        *[skip(t, "11FI", "no detour to fill keys from") for t in ("patients", "encounters")],
        skip("patients", "8RI", "no foreign keys declared"),
        *[skip(t, "8BL", "no business rules declared") for t in ("patients", "encounters", "conditions")],
        *[skip(t, d, "no such rules declared") for t in S.TABLES if t != "conditions" for d in ("9S", "10CL")],
    ]


@query("validate_dataset", S.with_(
    [*S.ctes(*S.TABLES), _DEATHS, _CLINICAL_CTES, S.CODE_LIST, _SUGGEST, _THROUGH], S.union(_validation_sql())))
def validate_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.validate_dataset(clinic.derived(spark, sf_dir), specs())


_NAMED = " ".join(f"WHEN '{code}' THEN {S.quote(name)}" for code, name in DIMENSION_NAMES.items())


@query("report_by_dimension_named", S.with_(
    [*S.ctes(*S.TABLES), _DEATHS, _CLINICAL_CTES, S.CODE_LIST, _SUGGEST, _THROUGH], f"""
SELECT quality_dimension, CASE quality_dimension {_NAMED} ELSE quality_dimension END AS dimension_name,
  CAST(sum(error_count) AS BIGINT) AS error_count FROM ({S.union(_validation_sql())}) GROUP BY quality_dimension"""))
def report_by_dimension_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_dimension(pipeline.validate_dataset(clinic.derived(spark, sf_dir), specs()))


@query("inject_hash_draws", """
SELECT rate, true AS within, count(*) AS n FROM lineitem, (VALUES ('0.05'), ('0.01'), ('0.3')) AS r(rate) GROUP BY rate""")
def inject_hash_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The draws of production: within five standard errors of their rate."""
    draws = HashDraws()
    seeded = star(spark, sf_dir, "lineitem")["lineitem"].withColumn(
        "seed", draws.seed([F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]))
    parts = []
    for salt, rate in enumerate((0.05, 0.01, 0.3)):
        hit = F.avg(draws.below("seed", str(salt), rate).cast("double"))
        within = F.abs(hit - rate) <= 5 * F.sqrt(F.lit(rate * (1 - rate)) / F.count(F.lit(1)))
        parts.append(seeded.agg(within.alias("within"), F.count(F.lit(1)).alias("n")).select(F.lit(str(rate)).alias("rate"), "within", "n"))
    return union_all(parts)


# --- injection ---------------------------------------------------------------

def _injection(table: str) -> None:
    columns = ", ".join(f'"{c}"' for c in S.COLUMNS[table])

    @query(f"inject_{table}", S.with_(S.ctes(table), f"SELECT {columns} FROM {table}"))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return clinic.dirty(spark, sf_dir, table)[table]


for _t in S.TABLES:
    _injection(_t)
