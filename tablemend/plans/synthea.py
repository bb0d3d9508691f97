"""The specification of the five Synthea tables: keys, rules, fixes, defects.

``as_of`` stands for today wherever a rule or a fix compares with the present.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemend.constants import (
    ACCURACY, BAD_DATE, BAD_FORMAT, BAD_GENDER, CODE_PATTERN, COMPLETENESS, DASHED_PATTERN, DIED_EARLY,
    DIGITS_PATTERN, EMPTY_VALUE, INVALID_FORMAT, STOPPED_EARLY, TIMELINESS, VALIDITY,
)
from tablemend.functions import predicates as P
from tablemend.functions.columns import column
from tablemend.functions.dates import (
    COMPACT, DOTTED, EUROPEAN, ISO, US, before, cast_date, lenient_date, parse_any,
)
from tablemend.model import ColumnRule, CrossRule, DomainSpec, Fix, FkRule, Rule, TableSpec, Via
from tablemend.operators import inject as I
from tablemend.operators.correct import (
    fix_characters, fix_gender, fix_identifier, fix_life_dates, fix_numeric_code, fix_period,
)

TABLES = ("patients", "encounters", "conditions", "medications", "allergies")
CLINICAL = ("conditions", "medications", "allergies")

# The columns of every table.
SCHEMAS = {
    "patients": (
        "ID string, BIRTHDATE date, DEATHDATE date, SSN string, DRIVERS string, PASSPORT string, "
        "PREFIX string, FIRST string, LAST string, SUFFIX string, MAIDEN string, MARITAL string, "
        "RACE string, ETHNICITY string, GENDER string, BIRTHPLACE string, ADDRESS string, CITY string, "
        "STATE string, ZIP string"
    ),
    "encounters": (
        "ID string, START bigint, STOP bigint, PATIENT string, ORGANIZATION string, PROVIDER string, "
        "PAYER string, ENCOUNTERCLASS string, CODE string, DISPLAY string, DESCRIPTION string, "
        "BASE_ENCOUNTER string, REASONCODE string, REASONDISPLAY string"
    ),
    "conditions": (
        "START bigint, STOP bigint, PATIENT string, ENCOUNTER string, CODE string, SYSTEM string, "
        "DISPLAY string, DESCRIPTION string"
    ),
    "medications": (
        "START bigint, STOP bigint, PATIENT string, ENCOUNTER string, CODE string, SYSTEM string, "
        "DISPLAY string, PRESCRIPTION string, REASONDISPLAY string, REASONCODE string"
    ),
    "allergies": (
        "START string, STOP string, PATIENT string, ENCOUNTER string, CODE string, SYSTEM string, "
        "DISPLAY string, TYPE string, CATEGORY string, CRITICALITY string, DESCRIPTION string, "
        "REACTION1 string, SEVERITY1 string, REACTION2 string, SEVERITY2 string"
    ),
}

# Domains, in the order in which they are tried.
DOMAINS = (
    DomainSpec(
        "Veselības aprūpe",
        ("patients", "allergies", "conditions", "encounters", "medications", "providers", "organizations",
         "immunizations", "procedures"),
        "healthcare",
        {"patients": ("DEATHDATE",)},
    ),
    DomainSpec(
        "Izglītība",
        ("students", "courses", "enrollments", "teachers", "grades", "schools", "curriculum"),
        "education",
    ),
    DomainSpec(
        "Rūpniecība",
        ("products", "manufacturing", "inventory", "suppliers", "customers", "orders", "production_lines"),
        "industry",
    ),
)
HEALTHCARE = DOMAINS[0]

# The code list, description -> code.
CODE_LIST = {
    "Received certificate of high school equivalency (finding)": "105480006",
    "Chronic neck pain (finding)": "279039007",
    "Acute deep venous thrombosis (disorder)": "128053003",
    "Nonproliferative diabetic retinopathy due to type 2 diabetes mellitus (disorder)": "399270008",
    "Neuropathy due to type 2 diabetes mellitus (disorder)": "230572002",
    "Chronic intractable migraine without aura (disorder)": "719080004",
    "Microalbuminuria due to type 2 diabetes mellitus (disorder)": "408540003",
    "Macular edema and retinopathy due to type 2 diabetes mellitus (disorder)": "422034002",
    "Proliferative diabetic retinopathy due to type II diabetes mellitus (disorder)": "399304008",
}

BIRTH_LAYOUTS = (ISO, US, DOTTED)
# The dotted layout is an addition: without it the dates that the injection
# writes that way would be lost by the correction.
PERIOD_LAYOUTS = (COMPACT, ISO, EUROPEAN, DOTTED)
STALE_LAYOUTS = (ISO, EUROPEAN, DOTTED)
STALE_DAYS = 365 * 5


def schema(table: str) -> T.StructType:
    """The declared columns; needs no session."""
    types = {"string": T.StringType(), "date": T.DateType(), "bigint": T.LongType()}
    fields = [field.split(" ") for field in SCHEMAS[table].split(", ")]
    return T.StructType([T.StructField(name, types[kind]) for name, kind in fields])


def code_list(spark: SparkSession) -> DataFrame:
    """A table of known size, which the engine broadcasts by itself."""
    values = ", ".join(f"('{description}', '{code}')" for description, code in CODE_LIST.items())
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(description, code)")


def fk_rules(table: str) -> tuple[FkRule, ...]:
    """PATIENT for all but the patients; ENCOUNTER, and a detour through it, for the clinical tables."""
    if table == "patients":
        return ()
    if table == "encounters":
        return (FkRule(table, "PATIENT", "patients", "ID"),)
    via = Via("ENCOUNTER", "encounters", "ID", "PATIENT")
    return (
        FkRule(table, "PATIENT", "patients", "ID", via),
        FkRule(table, "ENCOUNTER", "encounters", "ID"),
    )


# The keys that the profile of a dataset checks (NULL counts, case matters).
PROFILE_FKS = (
    FkRule("encounters", "PATIENT", "patients", "ID"),
    FkRule("conditions", "ENCOUNTER", "encounters", "ID"),
    FkRule("medications", "PATIENT", "patients", "ID"),
    FkRule("medications", "ENCOUNTER", "encounters", "ID"),
)


# --- rules -----------------------------------------------------------------


def profile_rules() -> tuple[Rule | ColumnRule, ...]:
    """The rules of the profile: for any table, as far as it has the columns."""
    def rule(dimension: str, name: str, text: str, test, *needs: str) -> Rule:
        return Rule(dimension, name, text, test, needs, optional=True)

    return (
        ColumnRule(COMPLETENESS, EMPTY_VALUE, P.null_or_empty, upper_names=True),
        rule(ACCURACY, "GENDER", BAD_GENDER, lambda c: P.outside(c, ("M", "F", "U")), "GENDER"),
        rule(ACCURACY, "BIRTHDATE", BAD_DATE, lambda c: cast_date(c).isNull(), "BIRTHDATE"),
        rule(TIMELINESS, "BIRTHDATE/DEATHDATE", DIED_EARLY,
             lambda b, d: cast_date(d) < cast_date(b), "BIRTHDATE", "DEATHDATE"),
        rule(TIMELINESS, "START/STOP", STOPPED_EARLY, lambda a, b: before(b, a), "START", "STOP"),
        rule(VALIDITY, "CODE", BAD_FORMAT, lambda c: P.mismatch(c, CODE_PATTERN), "CODE"),
    )


def validation_rules(table: str, as_of: Column, strict_medications: bool = False) -> tuple[Rule | ColumnRule, ...]:
    """The row-local rules of the validation.

    ``strict_medications`` asks a medication's dates to be readable in every
    accepted way at once, which no text is, instead of in one of them.
    """
    rules: list[Rule | ColumnRule] = [ColumnRule("7S", "missing value (NULL)", P.is_null)]
    rules += _syntax_rules(table, as_of, strict_medications)
    nullable = HEALTHCARE.nullable_columns.get(table, ())
    rules.append(ColumnRule("12C", "missing value (NULL)", P.is_null, exempt=frozenset(nullable)))
    rules.append(Rule(
        "12T", "Timeliness", "older than five years",
        lambda c: parse_any(c, STALE_LAYOUTS) < F.date_sub(as_of, STALE_DAYS), ("STOP|START",),
    ))
    return tuple(rules)


def _syntax_rules(table: str, as_of: Column, strict: bool) -> list[Rule]:
    def rule(name: str, text: str, test, *needs: str) -> Rule:
        return Rule("7S", name, text, test, needs)

    def future(c: Column) -> Column:
        return parse_any(c, BIRTH_LAYOUTS) > as_of

    order = rule("START/STOP", "STOP before START", _stops_early, "START", "STOP")
    code = rule("CODE_AlphanumericFormat", "not letters, digits, dots and dashes",
                lambda c: P.mismatch(c, CODE_PATTERN), "CODE")
    if table == "patients":
        return [
            rule("BIRTHDATE", "born in the years 19xx", lambda c: c.cast("string").startswith("19"), "BIRTHDATE"),
            rule("DEATHDATE", "died before birth", lambda b, d: cast_date(d) < cast_date(b), "BIRTHDATE", "DEATHDATE"),
            rule("GENDER", "missing or neither m nor f",
                 lambda c: P.null_or_outside(c, ("m", "f"), ignore_case=True), "GENDER"),
            rule("BIRTHDATE_Completeness", "missing", P.is_null, "BIRTHDATE"),
            rule("BIRTHDATE_Format", "in none of the layouts",
                 lambda c: c.isNotNull() & parse_any(c, BIRTH_LAYOUTS).isNull(), "BIRTHDATE"),
            rule("BIRTHDATE_Future", "in the future", future, "BIRTHDATE"),
            rule("DEATHDATE_Future", "in the future", future, "DEATHDATE"),
            rule("SSN_Format", "other than digits", lambda c: P.mismatch(c, DIGITS_PATTERN), "SSN"),
            rule("DRIVERS_Format", "other than letters, digits and dashes",
                 lambda c: P.mismatch(c, DASHED_PATTERN), "DRIVERS"),
        ]
    if table == "encounters":
        return [
            rule("START", "missing or INVALID", lambda c: P.null_or_equal(c, "INVALID"), "START"),
            rule("PATIENT", "missing or BAD", lambda c: P.null_or_equal(c, "BAD"), "PATIENT"),
            order, code,
        ]
    if table == "conditions":
        return [
            rule("PATIENT", "missing", P.is_null, "PATIENT"),
            rule("ENCOUNTER", "is 0000", lambda c: c.cast("string") == "0000", "ENCOUNTER"),
            rule("STOP", "in none of the layouts and no number",
                 lambda c: c.isNotNull() & parse_any(c, STALE_LAYOUTS).isNull() & ~P.looks_like_integer(c), "STOP"),
            order, code,
        ]
    if table == "medications":
        return [
            rule("START", "missing or unreadable", lambda c: _unreadable(c, (ISO,), strict), "START"),
            rule("STOP", "missing or unreadable", lambda c: _unreadable(c, (ISO, DOTTED), strict), "STOP"),
            rule("ENCOUNTER", "missing", P.is_null, "ENCOUNTER"),
            rule("PATIENT", "missing", P.is_null, "PATIENT"),
            order, code,
        ]
    return [code]


def _stops_early(start: Column, stop: Column) -> Column:
    """Order of the dates in texts, or else of numbers."""
    return before(stop, start, lambda c: parse_any(c, PERIOD_LAYOUTS))


def _unreadable(c: Column, layouts: tuple[str, ...], strict: bool) -> Column:
    readable = [lenient_date(c, layout).isNotNull() for layout in layouts] + [P.looks_like_integer(c)]
    verdict = readable[0]
    for r in readable[1:]:
        verdict = verdict & r if strict else verdict | r
    return c.isNull() | ~verdict


# Checks against the patient: facts about the patient, then rules on the row and those facts.


def death_facts(patients: DataFrame) -> dict[str, Column]:
    return {"died": F.min(lenient_date(column(patients, "DEATHDATE")))}


def after_death_rules(table: str) -> tuple[CrossRule, ...]:
    return (CrossRule("8BL", "START/DEATHDATE", f"{table} after the patient's death", ("START",), lenient_date,
                      ("died",), lambda died: died.isNotNull(), lambda start, died: start > died),)


def clinical_facts(patients: DataFrame) -> dict[str, Column]:
    return {
        "male": F.bool_or(F.lower(column(patients, "GENDER")) == "m"),
        "born": F.max(cast_date(column(patients, "BIRTHDATE"))),
    }


def clinical_rules() -> tuple[CrossRule, ...]:
    def says(words: str):
        return lambda description: F.lower(description).contains(words)

    young = F.lit("2015-01-01").cast("date")
    return (
        CrossRule("10CL", "Male_Pregnancy", "pregnancy of a man", ("DESCRIPTION",), says("pregnancy"),
                  ("male",), lambda male: male, lambda said, male: said & male),
        CrossRule("10CL", "Young_Type2_Diabetes", "type 2 diabetes of somebody born after 2015-01-01", ("DESCRIPTION",),
                  says("type 2 diabetes mellitus"), ("born",), lambda born: born > young,
                  lambda said, born: said & (born > young)),
    )


def post_rules(table: str, as_of: Column) -> tuple[Rule | ColumnRule, ...]:
    """The row-local rules on corrected tables."""
    rules: list[Rule | ColumnRule] = [ColumnRule("17PC_C", "missing value (NULL) after correction", P.is_null)]
    if table == "patients":
        rules += [
            Rule("17PC_A", "GENDER", "invalid gender after correction",
                 lambda c: P.outside(c, ("M", "F", "U")), ("GENDER",)),
            Rule("17PC_A", "BIRTHDATE/DEATHDATE", "died before birth after correction",
                 lambda b, d: cast_date(d) < cast_date(b), ("BIRTHDATE", "DEATHDATE")),
            Rule("17PC_A", "BIRTHDATE_Future", "in the future after correction",
                 lambda c: cast_date(c) > as_of, ("BIRTHDATE",)),
            Rule("17PC_A", "DEATHDATE_Future", "in the future after correction",
                 lambda c: cast_date(c) > as_of, ("DEATHDATE",)),
            Rule("17PC_V", "SSN_Format", "other than digits after correction",
                 lambda c: P.mismatch_except(c, DIGITS_PATTERN, INVALID_FORMAT), ("SSN",)),
            Rule("17PC_V", "DRIVERS_Format", "other than letters, digits and dashes after correction",
                 lambda c: P.mismatch_except(c, DASHED_PATTERN, INVALID_FORMAT), ("DRIVERS",)),
        ]
    else:
        rules += [
            Rule("17PC_V", "CODE", "other than digits after correction",
                 lambda c: P.mismatch(c, DIGITS_PATTERN), ("CODE",)),
            Rule("17PC_T", "START/STOP", "STOP before START after correction",
                 lambda a, b: before(b, a), ("START", "STOP")),
        ]
    return tuple(rules)


# --- corrections -----------------------------------------------------------


def fixes(table: str, as_of: Column) -> tuple[Fix, ...]:
    if table == "patients":
        return (
            fix_gender("GENDER"),
            fix_life_dates("BIRTHDATE", "DEATHDATE", BIRTH_LAYOUTS, as_of),
            fix_characters("SSN", "[^0-9]"),
            fix_characters("DRIVERS", "[^A-Za-z0-9-]"),
            fix_identifier("ID"),
        )
    keys = ("ID", "PATIENT") if table == "encounters" else ("PATIENT", "ENCOUNTER")
    return (
        fix_period("START", "STOP", PERIOD_LAYOUTS),
        fix_numeric_code("CODE"),
        *[fix_identifier(k) for k in keys],
    )


# --- defects ---------------------------------------------------------------

INJECTION = (
    I.InjectionPlan("patients", ("ID",), (
        I.Corrupt("BIRTHDATE", 1, (I.in_century(0.05, "19"),)),
        I.Corrupt("DEATHDATE", 2, (I.day_before(0.05, "BIRTHDATE"),)),
        I.Corrupt("GENDER", 3, (I.to_null(0.05), I.to_text(0.10, "X"))),
        I.Duplicate(0.01, 5),
    )),
    I.InjectionPlan("encounters", ("ID",), (
        I.Corrupt("ID", 11, (I.with_prefix(0.05, "bad-"),)),
        I.Duplicate(0.02, 12),
        I.Corrupt("START", 13, (I.to_text(0.05, "INVALID"), I.to_null(0.10))),
        I.Corrupt("PATIENT", 15, (I.to_null(0.05), I.to_text(0.10, "BAD"))),
    )),
    I.InjectionPlan("conditions", ("PATIENT", "ENCOUNTER", "CODE", "START"), (
        I.Corrupt("PATIENT", 21, (I.to_null(0.05),)),
        I.Corrupt("ENCOUNTER", 22, (I.to_text(0.05, "0000"),)),
        I.Corrupt("STOP", 23, (I.as_layout(0.05, EUROPEAN), I.as_layout(0.10, DOTTED))),
        I.Corrupt("CODE", 25, (I.to_text(0.05, "XXX123"),)),
    )),
    I.InjectionPlan("medications", ("PATIENT", "ENCOUNTER", "CODE", "START"), (
        I.Corrupt("START", 31, (I.as_layout(0.05, ISO), I.to_null(0.10))),
        I.Corrupt("STOP", 33, (I.as_layout(0.05, ISO),)),
        I.Corrupt("ENCOUNTER", 34, (I.to_null(0.05),)),
        I.Corrupt("PATIENT", 35, (I.to_null(0.05),)),
    )),
    I.InjectionPlan("allergies", ("PATIENT", "ENCOUNTER", "CODE", "START"), (
        I.Corrupt("STOP", 41, (I.day_before(0.05, "START"),)),
        I.Corrupt("TYPE", 42, (I.to_text(0.05, "UNKNOWN"), I.to_null(0.10))),
        I.Corrupt("ENCOUNTER", 44, (I.to_null(0.05),)),
        I.Corrupt("PATIENT", 45, (I.to_null(0.05),)),
    )),
)


# --- the whole -------------------------------------------------------------


def specs(as_of: Column | str, strict_medications: bool = False) -> dict[str, TableSpec]:
    day = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    keys = {"patients": ("ID",), "encounters": ("ID",)}
    return {
        t: TableSpec(
            name=t,
            schema=schema(t),
            primary_key=keys.get(t, ("PATIENT", "CODE", "START")),
            identifiers=keys.get(t, ("PATIENT", "ENCOUNTER")),
            fk_rules=fk_rules(t),
            profile_rules=profile_rules(),
            validation_rules=validation_rules(t, day, strict_medications),
            fixes=fixes(t, day),
            post_rules=post_rules(t, day),
        )
        for t in TABLES
    }
