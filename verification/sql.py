"""Building blocks of the oracle SQL, written apart from the Spark code they check."""

from __future__ import annotations

from tablemend.plans import synthea
from verification import clinic
from verification.clinic import AS_OF

TODAY = f"DATE '{AS_OF}'"


# --- expressions -----------------------------------------------------------


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pct(e: str, t: str) -> str:
    return f"CASE WHEN {t} > 0 THEN ((({e}) * 20000 + ({t})) // (2 * ({t}))) / 100.0 ELSE 0.0 END"


def draw(salt: str | int, rate: float, seed: str = "k") -> str:
    x = f"((({seed} % 1000003) * 7919 + ({salt}) * 104729) % 1000003)"
    return f"((({x} * {x}) % 1000003) % 1000 < {round(rate * 1000)})"


_LAYOUTS = {
    "iso": (r"^\d{4}-\d{1,2}-\d{1,2}", "%Y-%m-%d"),
    "us": (r"^\d{1,2}/\d{1,2}/\d{4}", "%m/%d/%Y"),
    "eu": (r"^\d{1,2}/\d{1,2}/\d{4}", "%d/%m/%Y"),
    "dot": (r"^\d{4}\.\d{1,2}\.\d{1,2}", "%Y.%m.%d"),
    "compact": (r"^\d{8}", "%Y%m%d"),
}


def day(c: str, layout: str = "iso") -> str:
    pattern, form = _LAYOUTS[layout]
    return f"CAST(try_strptime(nullif(regexp_extract(ltrim({c}), '{pattern}'), ''), '{form}') AS DATE)"


def any_day(c: str, *layouts: str) -> str:
    return "coalesce(" + ", ".join(day(c, x) for x in layouts) + ")"


BIRTH = ("iso", "us", "dot")
PERIOD = ("compact", "iso", "eu", "dot")
STALE = ("iso", "eu", "dot")


def matches(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, '{pattern}')"


EMPTY = "({c} IS NULL OR lower(trim({c})) IN ('', '0000', 'unknown', 'n/a'))"
UUID = "^[A-Fa-f0-9]{8}-[A-Fa-f0-9]{4}-[A-Fa-f0-9]{4}-[A-Fa-f0-9]{4}-[A-Fa-f0-9]{12}$"


def empty(c: str) -> str:
    return EMPTY.replace("{c}", c)


def bad_uuid(c: str) -> str:
    return f"({empty(c)} OR length({c}) <> 36 OR NOT {matches(c, UUID)})"


# --- clinic tables ---------------------------------------------------------


def uuid(head: str, key: str) -> str:
    return f"'{head}000000-0000-4000-8000-' || lpad(CAST({key} AS VARCHAR), 12, '0')"


_DESCRIPTIONS = clinic.DESCRIPTIONS
CODE_LIST = "code_list(description, code) AS (VALUES " + ", ".join(
    f"({quote(d)}, {quote(c)})" for d, c in synthea.CODE_LIST.items()
) + ")"

_LIST = "[" + ", ".join(quote(d) for d in _DESCRIPTIONS) + "]"
_CODE_ARRAY = "[" + ", ".join(quote(c) for c in synthea.CODE_LIST.values()) + "]"
_LINES = """
lines AS (
  SELECT l.*, o.o_custkey, l.l_orderkey * 8 + l.l_linenumber AS k, CAST(l.l_shipdate AS DATE) AS d
  FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

CLEAN = {
    "patients": f"""
patients0 AS (
  SELECT c_custkey AS k, {uuid('ac', 'c_custkey')} AS ID,
    CAST(born AS VARCHAR) AS BIRTHDATE,
    CASE WHEN c_custkey % 5 = 0 THEN CAST(born + CAST(20000 + c_custkey % 7000 AS INTEGER) AS VARCHAR) END AS DEATHDATE,
    CASE WHEN c_custkey % 4 = 0 THEN '999' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0')
      ELSE '999-' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-'
        || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') END AS SSN,
    CASE WHEN c_custkey % 6 = 0 THEN 'S 99#' || c_custkey WHEN c_custkey % 7 <> 0 THEN 'S99-' || c_custkey END AS DRIVERS,
    CASE WHEN c_custkey % 9 = 0 THEN '  ' || c_name || ' ' ELSE c_name END AS "FIRST",
    CASE WHEN c_custkey % 11 = 0 THEN '' ELSE c_mktsegment END AS MARITAL,
    CASE WHEN c_custkey % 2 = 0 THEN 'M' WHEN c_custkey % 13 = 0 THEN 'f' ELSE 'F' END AS GENDER
  FROM (SELECT *, DATE '1930-01-01' + CAST(c_custkey * 7919 % 33000 AS INTEGER) AS born FROM customer))""",
    "encounters": f"""
encounters0 AS (
  SELECT o_orderkey AS k, {uuid('bd', 'o_orderkey')} AS ID,
    CAST(d AS VARCHAR) || 'T00:00:00Z' AS START,
    CAST(d + CAST(o_orderkey % 5 AS INTEGER) - 1 AS VARCHAR) || 'T00:00:00Z' AS STOP,
    {uuid('ac', 'o_custkey')} AS PATIENT,
    CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' ELSE o_orderpriority END AS ENCOUNTERCLASS,
    CASE WHEN o_orderkey % 19 = 0 THEN 'A ' || (o_orderkey % 1000)
      ELSE CAST(100000 + o_orderkey % 900000 AS VARCHAR) END AS CODE,
    o_orderstatus AS DESCRIPTION
  FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders))""",
    "conditions": f"""
conditions0 AS (
  SELECT k, CAST(d AS VARCHAR) AS START,
    CASE WHEN l_linenumber % 3 <> 0 THEN CAST(d + CAST(l_quantity AS INTEGER) AS VARCHAR) END AS STOP,
    {uuid('ac', 'o_custkey')} AS PATIENT,
    CASE WHEN l_linenumber = 2 THEN upper({uuid('bd', 'l_orderkey')}) ELSE {uuid('bd', 'l_orderkey')} END AS ENCOUNTER,
    CASE WHEN l_partkey % 4 = 0 AND l_partkey % 13 < 9 THEN ({_CODE_ARRAY})[l_partkey % 13 + 1]
      ELSE CAST(l_partkey AS VARCHAR) END AS CODE,
    ({_LIST})[l_partkey % 13 + 1] AS DESCRIPTION
  FROM lines)""",
    "medications": f"""
medications0 AS (
  SELECT k, CAST(d AS VARCHAR) || 'T00:00:00Z' AS START,
    CASE WHEN l_linenumber % 4 <> 0 THEN CAST(d + CAST(l_quantity AS INTEGER) - 3 AS VARCHAR) || 'T00:00:00Z' END AS STOP,
    {uuid('ac', 'o_custkey')} AS PATIENT, {uuid('bd', 'l_orderkey')} AS ENCOUNTER,
    CAST(l_suppkey AS VARCHAR) AS CODE, l_returnflag AS DESCRIPTION
  FROM lines)""",
    "allergies": f"""
allergies0 AS (
  SELECT k, CAST(d AS VARCHAR) AS START,
    CASE WHEN l_linenumber = 1 THEN CAST(d + 30 AS VARCHAR) END AS STOP,
    {uuid('ac', 'o_custkey')} AS PATIENT, {uuid('bd', 'l_orderkey')} AS ENCOUNTER,
    CAST(l_suppkey AS VARCHAR) || '-' || l_linestatus AS CODE,
    CASE WHEN l_linenumber % 2 = 0 THEN 'allergy' ELSE 'intolerance' END AS TYPE
  FROM lines)""",
}


def _layout(c: str, form: str) -> str:
    return f"strftime({day(c)}, '{form}')"


# The copy of a duplicated row draws anew in later steps.
_C = "1000 * copy"

DIRTY = {
    "patients": f"""
patients1 AS (SELECT * REPLACE (CASE WHEN {draw(1, .05)} THEN '19' || substr(BIRTHDATE, 3) ELSE BIRTHDATE END AS BIRTHDATE)
  FROM patients0),
patients2 AS (SELECT * REPLACE (
    CASE WHEN {draw(2, .05)} THEN CAST({day('BIRTHDATE')} - 1 AS VARCHAR) ELSE DEATHDATE END AS DEATHDATE,
    CASE WHEN {draw(3, .05)} THEN NULL WHEN {draw(4, .10)} THEN 'X' ELSE GENDER END AS GENDER)
  FROM patients1),
patients AS (SELECT * EXCLUDE (k) FROM patients2 UNION ALL SELECT * EXCLUDE (k) FROM patients2 WHERE {draw(5, .01)})""",
    "encounters": f"""
encounters1 AS (SELECT * REPLACE (CASE WHEN {draw(11, .05)} THEN 'bad-' || ID ELSE ID END AS ID) FROM encounters0),
encounters2 AS (SELECT *, 0 AS copy FROM encounters1 UNION ALL SELECT *, 1 FROM encounters1 WHERE {draw(12, .02)}),
encounters AS (SELECT * EXCLUDE (k, copy) REPLACE (
    CASE WHEN {draw(f'13 + {_C}', .05)} THEN 'INVALID' WHEN {draw(f'14 + {_C}', .10)} THEN NULL ELSE START END AS START,
    CASE WHEN {draw(f'15 + {_C}', .05)} THEN NULL WHEN {draw(f'16 + {_C}', .10)} THEN 'BAD' ELSE PATIENT END AS PATIENT)
  FROM encounters2)""",
    "conditions": f"""
conditions AS (SELECT * EXCLUDE (k) REPLACE (
    CASE WHEN {draw(21, .05)} THEN NULL ELSE PATIENT END AS PATIENT,
    CASE WHEN {draw(22, .05)} THEN '0000' ELSE ENCOUNTER END AS ENCOUNTER,
    CASE WHEN {draw(23, .05)} THEN {_layout('STOP', '%d/%m/%Y')} WHEN {draw(24, .10)} THEN {_layout('STOP', '%Y.%m.%d')}
      ELSE STOP END AS STOP,
    CASE WHEN {draw(25, .05)} THEN 'XXX123' ELSE CODE END AS CODE)
  FROM conditions0)""",
    "medications": f"""
medications AS (SELECT * EXCLUDE (k) REPLACE (
    CASE WHEN {draw(31, .05)} THEN {_layout('START', '%Y-%m-%d')} WHEN {draw(32, .10)} THEN NULL ELSE START END AS START,
    CASE WHEN {draw(33, .05)} THEN {_layout('STOP', '%Y-%m-%d')} ELSE STOP END AS STOP,
    CASE WHEN {draw(34, .05)} THEN NULL ELSE ENCOUNTER END AS ENCOUNTER,
    CASE WHEN {draw(35, .05)} THEN NULL ELSE PATIENT END AS PATIENT)
  FROM medications0)""",
    "allergies": f"""
allergies AS (SELECT * EXCLUDE (k) REPLACE (
    CASE WHEN {draw(41, .05)} THEN CAST({day('START')} - 1 AS VARCHAR) ELSE STOP END AS STOP,
    CASE WHEN {draw(42, .05)} THEN 'UNKNOWN' WHEN {draw(43, .10)} THEN NULL ELSE TYPE END AS TYPE,
    CASE WHEN {draw(44, .05)} THEN NULL ELSE ENCOUNTER END AS ENCOUNTER,
    CASE WHEN {draw(45, .05)} THEN NULL ELSE PATIENT END AS PATIENT)
  FROM allergies0)""",
}

COLUMNS = {
    "patients": ["ID", "BIRTHDATE", "DEATHDATE", "SSN", "DRIVERS", "FIRST", "MARITAL", "GENDER"],
    "encounters": ["ID", "START", "STOP", "PATIENT", "ENCOUNTERCLASS", "CODE", "DESCRIPTION"],
    "conditions": ["START", "STOP", "PATIENT", "ENCOUNTER", "CODE", "DESCRIPTION"],
    "medications": ["START", "STOP", "PATIENT", "ENCOUNTER", "CODE", "DESCRIPTION"],
    "allergies": ["START", "STOP", "PATIENT", "ENCOUNTER", "CODE", "TYPE"],
}
TABLES = list(COLUMNS)


def ctes(*tables: str) -> list[str]:
    """CTEs for the tables with defects."""
    out = [_LINES] if any(t in ("conditions", "medications", "allergies") for t in tables) else []
    for t in tables:
        out += [CLEAN[t], DIRTY[t]]
    return out


def with_(parts: list[str], body: str) -> str:
    return ("WITH " + ",\n".join(p.strip() for p in parts) + "\n" if parts else "") + body


# --- metrics ---------------------------------------------------------------


def metric_from(table: str, dimension: str, rule: str | None, text: str, counts: str, status: str = "checked") -> str:
    """A metric row out of a query that gives columns e and t."""
    rule_sql = "CAST(NULL AS VARCHAR)" if rule is None else quote(rule)
    return (
        f"SELECT {quote(table)} AS table_name, {quote(dimension)} AS quality_dimension, {rule_sql} AS rule_name, "
        f"{quote(text)} AS issue_description, CAST(e AS BIGINT) AS error_count, CAST(t AS BIGINT) AS total_count, "
        f"{pct('e', 't')} AS error_percentage, {quote(status)} AS status FROM ({counts})"
    )


def check(table: str, dimension: str, rule: str | None, text: str, bad: str, source: str | None = None) -> str:
    counts = f"SELECT count(*) FILTER (WHERE {bad}) AS e, count(*) AS t FROM {source or table}"
    return metric_from(table, dimension, rule, text, counts)


def skip(table: str, dimension: str, rule: str, text: str) -> str:
    return metric_from(table, dimension, rule, text, "SELECT 0 AS e, 0 AS t", "skipped")


def union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


def duplicates(table: str, dimension: str, rule: str | None, text: str, source: str | None = None) -> str:
    s = source or table
    return metric_from(table, dimension, rule, text,
                       f"SELECT (SELECT count(*) FROM {s}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {s})) AS e, "
                       f"(SELECT count(*) FROM {s}) AS t")


def repeats(table: str, dimension: str, key: list[str], source: str | None = None) -> str:
    cols = ", ".join(key)
    s = source or table
    return metric_from(table, dimension, "+".join(key), "repeated primary key",
                       f"SELECT sum(c - 1) AS e, sum(c) AS t FROM (SELECT count(*) AS c FROM {s} GROUP BY {cols})")


def orphans(table: str, dimension: str, rule: str, fk: str, parent: str, pk: str, *, nulls: bool, fold: bool,
            child: str | None = None, ref: str | None = None, target: str | None = None,
            but: str | None = None) -> str:
    """Keys without a parent; ``but`` excludes a sentinel."""
    c, p = (f"lower(CAST(c.{fk} AS VARCHAR))", f"lower(CAST(p.{pk} AS VARCHAR))") if fold else (f"c.{fk}", f"p.{pk}")
    lost = f"NOT EXISTS (SELECT 1 FROM {ref or parent} p WHERE {p} = {c})"
    bad = lost if nulls else f"c.{fk} IS NOT NULL AND {lost}"
    if but:
        bad += f" AND lower(c.{fk}) <> lower('{but}')"
    return metric_from(table, dimension, rule, f"no such key in {target or f'{parent}.{pk}'}",
                       f"SELECT (SELECT count(*) FROM {child or table} c WHERE {bad}) AS e, "
                       f"(SELECT count(*) FROM {child or table}) AS t")
