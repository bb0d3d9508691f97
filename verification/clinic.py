"""The star tables in the shape of a clinic's tables, clean and with defects.

customer -> patients, orders -> encounters, lineitem (with its order) ->
conditions, medications and allergies; every row of every table is used.  The
texts have natural faults (blanks, case, open ends, odd characters); the defects
are injected with arithmetic draws, which SQL can repeat.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tablemend.functions.draws import ArithmeticDraws
from tablemend.model import Dataset
from tablemend.operators.inject import inject
from tablemend.plans import synthea
from tablemend.sources.sinks import remove, shared_folder, stage_dataset

Star = dict[str, DataFrame]
_LINES = "lines"

AS_OF = "2003-06-01"

DESCRIPTIONS = [
    *synthea.CODE_LIST,
    "Normal pregnancy (finding)",
    "Diabetes mellitus: TYPE 2 diabetes mellitus (disorder)",
    "  Chronic neck pain  ",
    "Stress",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _uuid(head: str, key: str) -> str:
    return f"concat('{head}000000-0000-4000-8000-', lpad(cast({key} as string), 12, '0'))"


def _day(date: str) -> str:
    return f"cast({date} as string)"


def _stamp(date: str) -> str:
    return f"concat({_day(date)}, 'T00:00:00Z')"


def _texts(values) -> str:
    return "array(" + ", ".join("'" + v + "'" for v in values) + ")"


def patients(tables: Star) -> DataFrame:
    born = "date_add(date'1930-01-01', cast(c_custkey * 7919 % 33000 as int))"
    died = f"date_add({born}, cast(20000 + c_custkey % 7000 as int))"
    return tables["customer"].selectExpr(
        "c_custkey",
        f"{_uuid('ac', 'c_custkey')} as ID",
        f"{_day(born)} as BIRTHDATE",
        f"case when c_custkey % 5 = 0 then {_day(died)} end as DEATHDATE",
        """case when c_custkey % 4 = 0 then concat('999', lpad(cast(c_custkey % 1000000 as string), 6, '0'))
           else concat('999-', lpad(cast(c_custkey % 100 as string), 2, '0'), '-',
                       lpad(cast(c_custkey % 10000 as string), 4, '0')) end as SSN""",
        """case when c_custkey % 6 = 0 then concat('S 99#', c_custkey)
           when c_custkey % 7 <> 0 then concat('S99-', c_custkey) end as DRIVERS""",
        "if(c_custkey % 9 = 0, concat('  ', c_name, ' '), c_name) as FIRST",
        "if(c_custkey % 11 = 0, '', c_mktsegment) as MARITAL",
        "case when c_custkey % 2 = 0 then 'M' when c_custkey % 13 = 0 then 'f' else 'F' end as GENDER",
    )


def encounters(tables: Star) -> DataFrame:
    day = "cast(o_orderdate as date)"
    return tables["orders"].selectExpr(
        "o_orderkey",
        f"{_uuid('bd', 'o_orderkey')} as ID",
        f"{_stamp(day)} as START",
        f"{_stamp(f'date_add({day}, cast(o_orderkey % 5 as int) - 1)')} as STOP",
        f"{_uuid('ac', 'o_custkey')} as PATIENT",
        "if(o_orderkey % 17 = 0, 'n/a', o_orderpriority) as ENCOUNTERCLASS",
        """if(o_orderkey % 19 = 0, concat('A ', o_orderkey % 1000),
           cast(100000 + o_orderkey % 900000 as string)) as CODE""",
        "o_orderstatus as DESCRIPTION",
    )


def _lines(tables: Star) -> DataFrame:
    """All line items, with the customer of their order if there is one."""
    if _LINES in tables:
        return tables[_LINES]
    owner = tables["orders"].selectExpr("o_orderkey as l_orderkey", "o_custkey")
    used = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    return tables["lineitem"].select(*used).join(owner, "l_orderkey", "left")


_LINE_KEY = "l_orderkey * 8 + l_linenumber as line_key"
_SHIPPED = "cast(l_shipdate as date)"


def conditions(tables: Star) -> DataFrame:
    n, known, encounter = len(DESCRIPTIONS), len(synthea.CODE_LIST), _uuid("bd", "l_orderkey")
    return _lines(tables).selectExpr(
        _LINE_KEY,
        f"{_day(_SHIPPED)} as START",
        f"case when l_linenumber % 3 <> 0 then {_day(f'date_add({_SHIPPED}, cast(l_quantity as int))')} end as STOP",
        f"{_uuid('ac', 'o_custkey')} as PATIENT",
        f"if(l_linenumber = 2, upper({encounter}), {encounter}) as ENCOUNTER",
        f"""case when l_partkey % 4 = 0 and l_partkey % {n} < {known}
            then try_element_at({_texts(synthea.CODE_LIST.values())}, cast(l_partkey % {n} as int) + 1)
            else cast(l_partkey as string) end as CODE""",
        f"element_at({_texts(DESCRIPTIONS)}, cast(l_partkey % {n} as int) + 1) as DESCRIPTION",
    )


def medications(tables: Star) -> DataFrame:
    stop = _stamp(f"date_add({_SHIPPED}, cast(l_quantity as int) - 3)")
    return _lines(tables).selectExpr(
        _LINE_KEY,
        f"{_stamp(_SHIPPED)} as START",
        f"case when l_linenumber % 4 <> 0 then {stop} end as STOP",
        f"{_uuid('ac', 'o_custkey')} as PATIENT",
        f"{_uuid('bd', 'l_orderkey')} as ENCOUNTER",
        "cast(l_suppkey as string) as CODE",
        "l_returnflag as DESCRIPTION",
    )


def allergies(tables: Star) -> DataFrame:
    return _lines(tables).selectExpr(
        _LINE_KEY,
        f"{_day(_SHIPPED)} as START",
        f"case when l_linenumber = 1 then {_day(f'date_add({_SHIPPED}, 30)')} end as STOP",
        f"{_uuid('ac', 'o_custkey')} as PATIENT",
        f"{_uuid('bd', 'l_orderkey')} as ENCOUNTER",
        "concat(l_suppkey, '-', l_linestatus) as CODE",
        "if(l_linenumber % 2 = 0, 'allergy', 'intolerance') as TYPE",
    )


_BUILDERS = {
    "patients": (patients, "c_custkey"),
    "encounters": (encounters, "o_orderkey"),
    "conditions": (conditions, "line_key"),
    "medications": (medications, "line_key"),
    "allergies": (allergies, "line_key"),
}


def _star(spark: SparkSession, sf_dir: str) -> Star:
    return {n: table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem")}


def clean(spark: SparkSession, sf_dir: str, *names: str, star: Star | None = None) -> Dataset:
    """The tables without defects (all five, or those named)."""
    tables = star or _star(spark, sf_dir)
    return {n: _BUILDERS[n][0](tables).drop(_BUILDERS[n][1]) for n in names or _BUILDERS}


def dirty(spark: SparkSession, sf_dir: str, *names: str, star: Star | None = None) -> Dataset:
    """The tables with the defects of the injection plan."""
    tables = star or _star(spark, sf_dir)
    plans = {p.table: p for p in synthea.INJECTION}
    out = {}
    for n in names or _BUILDERS:
        build, key = _BUILDERS[n]
        out[n] = inject(build(tables), plans[n].steps, [key], ArithmeticDraws()).drop(key)
    return out


def folder(spark: SparkSession) -> str:
    """A new folder for files of a query, in the folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"


def stored_star(spark: SparkSession, sf_dir: str) -> Star:
    """The star tables, with the line items and their customers joined once and written to a new folder."""
    return _stored_star(spark, sf_dir, folder(spark))


def _stored_star(spark: SparkSession, sf_dir: str, lines: str) -> Star:
    tables = _star(spark, sf_dir)
    return tables | stage_dataset({_LINES: _lines(tables)}, lines)


def derived(spark: SparkSession, sf_dir: str) -> Dataset:
    """All tables with their defects, derived where they are read, from line items that are joined with their orders once."""
    return dirty(spark, sf_dir, star=stored_star(spark, sf_dir))


def stored(spark: SparkSession, sf_dir: str, star: Star | None = None) -> Dataset:
    """All tables with their defects, written to a new folder: for work that reads a table more than once."""
    if star is not None:
        return stage_dataset(dirty(spark, sf_dir, star=star), folder(spark))
    lines = folder(spark)
    tables = stage_dataset(dirty(spark, sf_dir, star=_stored_star(spark, sf_dir, lines)), folder(spark))
    remove(spark, lines)  # the tables are read from here on
    return tables
