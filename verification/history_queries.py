"""Queries for broken records, Delta directories, snapshots, changed cells, survivors, renamed keys and whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemend.model import Dataset, Fix, FkRule, TableSpec
from tablemend.operators import cells, key_order, survivors
from tablemend.operators import report as R
from tablemend.operators.metrics import union_all
from tablemend.operators.repair import StoredLookups, sanitize_identifiers
from tablemend.plans import pipeline
from tablemend.sources import delta_log, metric_store, part_files, quarantine
from tablemend.sources.sinks import is_large, remove, stage_dataset
from verification import clinic, files
from verification import repair_queries as Q
from verification import sql as S
from verification.catalog import query
from verification.profile_queries import profile_sql, specs
from verification.repair_queries import _folder

# --- whole tables as rows of text ----------------------------------------------


def as_rows(ds: Dataset) -> DataFrame:
    """table_name, row: every row of every table, all columns as one text."""
    return union_all(
        df.select(F.lit(n).alias("table_name"), F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("NULL")) for c in S.COLUMNS[n]]).alias("row"))
        for n, df in ds.items()
    )


def rows_sql(suffix: str, tables: list[str] = S.TABLES) -> str:
    return S.union([
        f"SELECT '{t}' AS table_name, concat_ws('|', " + ", ".join(f"coalesce(\"{c}\", 'NULL')" for c in S.COLUMNS[t]) + f") AS row FROM {t}{suffix}"
        for t in tables
    ])


@query("sanitize_ids_all_columns", S.with_([*S.ctes(*S.TABLES), *[Q.sanitized(t) for t in S.TABLES]], rows_sql("_clean")))
def sanitize_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_rows({n: sanitize_identifiers(df, specs()[n].identifiers) for n, df in clinic.dirty(spark, sf_dir).items()})


@query("repair_integrity_all_columns", S.with_(Q.LINKED_CTES, rows_sql("_linked")))
def repair_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_rows(Q._repaired_integrity(spark, sf_dir))


for _t in ("medications", "allergies"):
    Q._corrected(_t)


# --- broken records --------------------------------------------------------------

_FIELDS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
_TEXTS = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _FIELDS)
_SHORT, _LONG, _CUT = "o_orderkey % 13 = 0", "o_orderkey % 17 = 0", "o_orderkey % 11 = 0"
_CSV = f"""CASE WHEN {_SHORT} THEN concat_ws(',', o_orderkey, o_custkey)
  WHEN {_LONG} THEN concat_ws(',', {', '.join(_FIELDS)}, 'more') ELSE concat_ws(',', {', '.join(_FIELDS)}) END"""
_JSON = "'{' || " + " || ',' || ".join(f"'\"{c}\":\"' || {c} || '\"'" for c in _FIELDS) + " || '}'"
_JSON_LINE = f"CASE WHEN {_CUT} THEN left({_JSON}, length({_JSON}) - 3) ELSE {_JSON} END"
_BAD_CSV = f"({_SHORT} OR {_LONG})"


def _scans(spark: SparkSession, sf_dir: str) -> list[quarantine.Scan]:
    orders, folder = clinic.table(spark, sf_dir, "orders"), _folder(spark)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in _FIELDS])
    out = []
    for fmt, line in (("csv", _CSV), ("json", _JSON_LINE)):
        orders.selectExpr(line.replace("VARCHAR", "STRING")).repartition(3).write.text(f"{folder}/raw-{fmt}")
        out.append(quarantine.scan(spark, f"{folder}/raw-{fmt}", fmt, f"orders_{fmt}", f"{folder}/{fmt}", schema, header=False))
    return out


@query("quarantine_good_rows", f"""
SELECT 'orders_csv' AS table_name, {_TEXTS} FROM orders WHERE NOT {_BAD_CSV}
UNION ALL SELECT 'orders_json', {_TEXTS} FROM orders WHERE NOT {_CUT}""")
def quarantine_good_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_all(s.rows.select(F.lit(s.table).alias("table_name"), *_FIELDS) for s in _scans(spark, sf_dir))


@query("quarantine_records", f"""
SELECT 'orders_csv' AS table_name, {_CSV} AS record FROM orders WHERE {_BAD_CSV}
UNION ALL SELECT 'orders_json', {_JSON_LINE} FROM orders WHERE {_CUT}""")
def quarantine_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_all(s.broken.select(F.lit(s.table).alias("table_name"), "record") for s in _scans(spark, sf_dir))


@query("quarantine_metrics", S.union([
    S.metric_from(t, "6V", "Broken_Records", "records that cannot be read", f"SELECT count(*) FILTER (WHERE {bad}) AS e, count(*) AS t FROM orders")
    for t, bad in (("orders_csv", _BAD_CSV), ("orders_json", _CUT))]))
def quarantine_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_all(s.metrics() for s in _scans(spark, sf_dir))


@query("part_file_faults", """
SELECT 'even.parquet' AS file_name, count(*) AS n_rows FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT 'odd.parquet', count(*) FROM orders WHERE o_orderkey % 2 = 1
UNION ALL SELECT 'broken.parquet', 0 UNION ALL SELECT 'mistyped.parquet', 0
UNION ALL SELECT 'narrow.parquet', count(*) FROM orders WHERE o_orderkey % 5 = 0""")
def part_file_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of five part files: one is no Parquet, one has a text for a number, one lacks a column."""
    orders, folder = clinic.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), _folder(spark)
    files.put_part(orders.filter("o_orderkey % 2 = 0"), folder, "even.parquet")
    files.put_part(orders.filter("o_orderkey % 2 = 1"), folder, "odd.parquet")
    files.put_part(orders.withColumn("o_totalprice", F.lit("dear")), folder, "mistyped.parquet")
    files.put_part(orders.filter("o_orderkey % 5 = 0").drop("o_orderstatus"), folder, "narrow.parquet")
    files.put_text(spark, f"{folder}/broken.parquet", "no parquet at all")
    return part_files.read_parts(spark, folder, "parquet", "orders", orders.schema).counts().select("file_name", "n_rows")


# --- the table a Delta directory holds ---------------------------------------------


def _delta(spark: SparkSession, sf_dir: str) -> str:
    """Five versions: two parts, one rewritten without dear orders, a checkpoint, one removed and one added by status."""
    orders, folder = clinic.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), _folder(spark)
    put = lambda where, name: files.put_part(orders.filter(where), folder, name)
    begin = files.described(orders)
    files.commit(spark, folder, 0, *begin, files.added(put("o_orderkey % 4 < 2", "a one.parquet").replace(" ", "%20")))
    files.commit(spark, folder, 1, files.added(put("o_orderkey % 4 = 2", "b.parquet")))
    files.commit(spark, folder, 2, files.removed("a%20one.parquet"), files.added(put("o_orderkey % 4 < 2 AND o_totalprice < 200000", "a2.parquet")))
    log = delta_log.actions(spark, folder)
    kept = log.filter("metaData IS NOT NULL OR protocol IS NOT NULL").drop("version")
    live = delta_log.live_files(log).select(F.struct("path", F.lit(None).cast("struct<storageType:string>").alias("deletionVector")).alias("add"))
    gone = spark.range(1).select(F.struct(F.lit("a%20one.parquet").alias("path")).alias("remove"))
    files.put_part(kept.unionByName(live, True).unionByName(gone, True).select("add", "remove", "metaData", "protocol"),
                   f"{folder}/_delta_log", f"{2:020d}.checkpoint.parquet")
    files.commit(spark, folder, 3, files.removed("b.parquet"))
    files.commit(spark, folder, 4, files.added(put("o_orderkey % 4 = 3", "c.parquet")))
    return folder


_ORDER = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE"


@query("delta_live_rows", f"{_ORDER} (o_orderkey % 4 < 2 AND o_totalprice < 200000) OR o_orderkey % 4 = 3")
def delta_live_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_log.read_delta(spark, _delta(spark, sf_dir))


@query("delta_rows_of_version", f"{_ORDER} o_orderkey % 4 <= 2")
def delta_rows_of_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta_log.read_delta(spark, _delta(spark, sf_dir), version=1)


# --- three snapshots ----------------------------------------------------------------

_RUNS = ("original", "damaged", "corrected")
_KEY = ", ".join(R.KEY)


def _metrics_of(name: str, source: str) -> str:
    shadow = ", ".join(f"{t} AS (SELECT * FROM ({source.replace('<t>', t)}))" for t in S.TABLES)
    return f"{name} AS (WITH {shadow} {S.union(profile_sql(S.TABLES))})"


_PIVOT = ", ".join(
    f"max(error_count) FILTER (WHERE place = {i}) AS errors_{r}, max(error_percentage) FILTER (WHERE place = {i}) AS pct_{r}"
    for i, r in enumerate(_RUNS))


@query("snapshots_compared", S.with_([
    *Q.CORRECTED_CTES, _metrics_of("m0", "SELECT * EXCLUDE (k) FROM <t>0"), f"m1 AS ({S.union(profile_sql(S.TABLES))})",
    _metrics_of("m2", "SELECT * FROM <t>_done"),
    "snapshots AS (" + S.union([f"SELECT {i} AS place, '{r}' AS run, * FROM m{i}" for i, r in enumerate(_RUNS)]) + ")",
    f"moves AS (SELECT *, error_percentage <> lag(error_percentage) OVER (PARTITION BY {_KEY} ORDER BY place) AS changed FROM snapshots)",
], f"""SELECT {_KEY}, {_PIVOT}, count(*) FILTER (WHERE changed) AS changes,
  arg_min(run, place) FILTER (WHERE changed) AS first_change, arg_max(run, place) FILTER (WHERE changed) AS last_change
FROM moves GROUP BY {_KEY}"""))
def snapshots_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of the tables without defects, with them, and corrected, kept in one history."""
    folder, star = _folder(spark), clinic.stored_star(spark, sf_dir)
    dirty = clinic.dirty(spark, sf_dir, star=star)
    stored = StoredLookups(dirty, f"{folder}/lookups")
    corrected = pipeline.correct_dataset(dirty, specs(), stored=stored, staging=f"{folder}/corrected")
    for run, ds in zip(_RUNS, (clinic.clean(spark, sf_dir, star=star), dirty, corrected)):
        metric_store.append_snapshot(pipeline.profile_dataset(ds, specs(), staging=f"{folder}/parts/{run}"), f"{folder}/history", run)
    history = metric_store.read_snapshots(spark, f"{folder}/history")
    return R.across_snapshots(history, metric_store.runs_of(history))


# --- changed cells --------------------------------------------------------------------

_AFTER = """after AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS o_custkey,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 9 <> 0
  UNION ALL SELECT -o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 9 = 0)"""
_CELL = """SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CAST(1 AS INTEGER) AS nth,
  CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS kind,
  '{c}' AS "column", CAST(b.{c} AS VARCHAR) AS old, CAST(a.{c} AS VARCHAR) AS new
FROM orders b FULL JOIN after a ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.{c} IS DISTINCT FROM b.{c}"""


@query("changed_cells", S.with_([_AFTER], S.union([_CELL.replace("{c}", c) for c in ("o_custkey", "o_orderstatus")])))
def changed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of the orders: values changed and lost, rows gone and new."""
    before = clinic.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    gone = F.col("o_orderkey") % 9 == 0
    after = before.filter(~gone).selectExpr(
        "o_orderkey", "if(o_orderkey % 7 = 0, null, o_custkey) AS o_custkey", "if(o_orderkey % 5 = 0, 'Z', o_orderstatus) AS o_orderstatus")
    after = after.unionByName(before.filter(gone).withColumn("o_orderkey", -F.col("o_orderkey")))
    return cells.changed_cells(before, after, ["o_orderkey"])


def _digest(table: str) -> str:
    return "sha256(upper(sha256(concat(" + ", ".join(f"coalesce(length(\"{c}\") || ':' || \"{c}\", '-')" for c in S.COLUMNS[table]) + "))))"


def _cells_sql(table: str) -> str:
    """The cells of a table's correction, from the same expressions as the correction's own SQL."""
    digest, parts = _digest(table), []
    for c in S.COLUMNS[table]:
        parts.append(f"SELECT 'Completeness_Auto_Fill' AS step, {digest} AS row, count(*) AS rows, '{c}' AS \"column\", NULL AS old, 'UNKNOWN' AS new "
                     f"FROM {table} WHERE \"{c}\" IS NULL GROUP BY {digest}")
    steps = [("GENDER_Corrected", {"GENDER": Q.sql_gender("GENDER")}), ("Dates_Corrected", Q.sql_life_dates()),
             ("SSN_Format_Corrected", {"SSN": Q.sql_keep("SSN", "[^0-9]")}),
             ("DRIVERS_Format_Corrected", {"DRIVERS": Q.sql_keep("DRIVERS", "[^A-Za-z0-9-]")})] if table == "patients" else [
                 ("StartStop_Dates_Corrected", Q.sql_period()), ("CODE_Format_Corrected", {"CODE": Q.sql_code("CODE")})]
    ids = {"patients": ("ID",), "encounters": ("ID", "PATIENT")}.get(table, ("PATIENT", "ENCOUNTER"))
    steps += [(f"{c}_Format_Corrected", {c: Q.sql_identifier(c)}) for c in ids]
    for name, new in steps:
        for c, e in new.items():
            parts.append(f"SELECT '{name}', {digest}, 1, '{c}', \"{c}\", {e} FROM {table}_filled WHERE \"{c}\" IS DISTINCT FROM ({e})")
    for c in [c for c in S.COLUMNS[table] if c in ("FIRST", "MARITAL", "ENCOUNTERCLASS", "DESCRIPTION", "TYPE")]:
        parts.append(f"SELECT 'Whitespace_Trimmed', {digest}, 1, '{c}', \"{c}\", trim(\"{c}\") FROM {table}_filled WHERE trim(\"{c}\") <> \"{c}\"")
    return f"SELECT '{table}' AS table_name, * FROM ({S.union(parts)})"


@query("correction_cells", S.with_([*S.ctes(*S.TABLES), *[c for ctes, _ in Q._LOGS for c in ctes]], S.union([_cells_sql(t) for t in S.TABLES])))
def correction_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    return union_all(cells.correction_cells(df, n, specs()[n].fixes, f"{folder}/{n}") for n, df in clinic.stored(spark, sf_dir).items())


@query("correction_cells_per_step", S.with_(
    [*S.ctes(*S.TABLES), *[c for ctes, _ in Q._LOGS for c in ctes]],
    f"""SELECT table_name, rule_name AS step, error_count FROM ({S.union([s for _, steps in Q._LOGS for s in steps])})
WHERE error_count > 0 AND rule_name <> 'Exact_Duplicates_Removed'"""))
def correction_cells_per_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells add up to the correction log."""
    folder, parts = _folder(spark), []
    for n, df in clinic.stored(spark, sf_dir).items():
        part = cells.cells_per_step(cells.correction_cells(df, n, specs()[n].fixes, f"{folder}/{n}"))
        if is_large(df):  # a large table is told and counted before the next one is begun
            part = stage_dataset({n: part}, f"{folder}/steps")[n]
            remove(spark, f"{folder}/{n}")
        parts.append(part)
    return union_all(parts)


# --- declared keys -----------------------------------------------------------------------

_MISSING = "lower(trim({c})) = 'missing_fk'"


def _lost(columns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"{S.empty(c)} OR {_MISSING.replace('{c}', c)}" for c in columns) + ")"


_RANKED = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY filled DESC, day DESC, digest) AS nth,
  max(filled) OVER (PARTITION BY ID) AS best_filled FROM (
    SELECT *, {' + '.join(f'CASE WHEN {S.empty(chr(34) + c + chr(34))} THEN 0 ELSE 1 END' for c in S.COLUMNS['encounters'])} AS filled,
      coalesce({S.day('START')}, DATE '0001-01-01') AS day, {_digest('encounters')} AS digest FROM encounters) WHERE NOT {_lost(('ID',))})"""
_ENCOUNTER = ", ".join(f'"{c}"' for c in S.COLUMNS["encounters"])


@query("survivors_encounters", S.with_([*S.ctes("encounters"), _RANKED], f"""
SELECT {_ENCOUNTER} FROM ranked WHERE nth = 1 UNION ALL SELECT {_ENCOUNTER} FROM encounters WHERE {_lost(('ID',))}"""))
def survivors_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(clinic.dirty(spark, sf_dir, "encounters")["encounters"], ["ID"], newest="START")


@query("rejected_encounters", S.with_([*S.ctes("encounters"), _RANKED], f"""
SELECT {_ENCOUNTER}, count(*) AS copies, filled, best_filled FROM ranked WHERE nth > 1 GROUP BY ALL"""))
def rejected_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = survivors.rejected(clinic.dirty(spark, sf_dir, "encounters")["encounters"], ["ID"], newest="START")
    return found.withColumnsRenamed({"__copies": "copies", "__filled": "filled", "__best_filled": "best_filled"})


def _key_sql(table: str, key: tuple[str, ...]) -> list[str]:
    name, n = "+".join(key), f"(SELECT count(*) FROM {table})"
    lost, columns = _lost(key), ", ".join(key)
    return [
        S.metric_from(table, pipeline_uniqueness, name, "declared key repeated",
                      f"SELECT coalesce(sum(c - 1), 0) AS e, {n} AS t FROM (SELECT count(*) AS c FROM {table} WHERE NOT {lost} GROUP BY {columns})"),
        S.metric_from(table, pipeline_uniqueness, name, "declared key missing", f"SELECT count(*) AS e, {n} AS t FROM {table} WHERE {lost}"),
    ]


pipeline_uniqueness = survivors.UNIQUENESS
_KEYS = {"patients": ("ID",), "encounters": ("ID",), **{t: ("PATIENT", "CODE", "START") for t in ("conditions", "medications", "allergies")}}


@query("profile_declared_keys", S.with_(S.ctes(*S.TABLES), S.union([m for t, k in _KEYS.items() for m in _key_sql(t, k)])))
def profile_declared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.key_profile(clinic.dirty(spark, sf_dir), specs())


# Key tables in which no word that stands for a missing value is a key: corrected tables hold such words.
_STRICT_KEYS = [k.replace("WHERE ID IS NOT NULL", f"WHERE NOT {_lost(('ID',))}").replace("WHERE e.ID IS NOT NULL", f"WHERE NOT {_lost(('e.ID',))}")
                for k in Q.KEY_CTES]


# --- keys in their order --------------------------------------------------------------------

_NEW_KEY = "CASE WHEN {k} % 7 = 0 THEN 'new-' || ({k} * 3) ELSE 'N' || {k} END"


def _renamed_orders(spark: SparkSession, sf_dir: str) -> tuple[Dataset, dict[str, TableSpec]]:
    """Orders of which every seventh is about to get another number, and lines that hold the old ones, the new ones or none."""
    orders = clinic.table(spark, sf_dir, "orders").selectExpr(
        "if(o_orderkey % 7 = 0, concat('old-', o_orderkey), concat('N', o_orderkey)) AS okey", "o_orderstatus AS status")
    lines = clinic.table(spark, sf_dir, "lineitem").selectExpr(
        """case when l_orderkey % 5 = 0 and l_linenumber = 1 then 'nobody' when l_orderkey % 7 <> 0 then concat('N', l_orderkey)
           when l_linenumber % 2 = 0 then concat('OLD-', l_orderkey) else concat('new-', l_orderkey * 3) end AS okey""",
        "l_linenumber AS line", "l_partkey AS part", "l_suppkey AS supplier")

    def renumber(c):
        return [F.when(c.startswith("old-"), F.concat(F.lit("new-"), F.substr(c, F.lit(5)).cast("long") * 3)).otherwise(c)]

    return {"lines": lines, "orders": orders}, {
        "orders": TableSpec("orders", primary_key=("okey",), fixes=(Fix("Renumbered", "new numbers", ("okey",), renumber),)),
        "lines": TableSpec("lines", fk_rules=(FkRule("lines", "okey", "orders", "okey"),)),
    }


@query("rekey_children", f"""
SELECT DISTINCT CASE WHEN l_orderkey % 5 = 0 AND l_linenumber = 1 THEN 'MISSING_FK'
  WHEN l_orderkey NOT IN (SELECT o_orderkey FROM orders) THEN 'MISSING_FK' ELSE {_NEW_KEY.replace('{k}', 'l_orderkey')} END AS okey,
  l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier FROM lineitem""")
def rekey_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines follow the orders that were renumbered, whatever the new number is."""
    return key_order.correct_in_order(*_renamed_orders(spark, sf_dir))[0]["lines"]


@query("rekey_metrics", S.union([
    S.metric_from("Global", "15C", "Key_Order", "every parent comes before its children", "SELECT 0 AS e, 2 AS t"),
    S.metric_from("lines", "15C", "okey_Followed_Renamed", "old id of a renamed parent", """
SELECT count(*) FILTER (WHERE l_orderkey % 7 = 0 AND l_linenumber % 2 = 0 AND l_orderkey IN (SELECT o_orderkey FROM orders)) AS e, count(*) AS t FROM lineitem""")]))
def rekey_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_order.correct_in_order(*_renamed_orders(spark, sf_dir))[1]


def _shadowed(suffix: str, tables: list[str] = S.TABLES) -> list[str]:
    return [f"{t} AS (SELECT * FROM {t}{suffix})" for t in tables]


_IN_ORDER = S.with_(
    [*S.ctes(*S.TABLES), *[c for t in S.TABLES for c in Q.corrected_ctes(t)],
     "patients_ordered AS (SELECT * FROM patients_fixed)",
     f"encounters_ordered AS (WITH patients AS (SELECT * FROM patients_fixed), {_STRICT_KEYS[0]} {Q.repaired('encounters', 'encounters_fixed', 'MISSING_FK', False)})",
     *[f"{t}_ordered AS (WITH patients AS (SELECT * FROM patients_fixed), encounters AS (SELECT * FROM encounters_ordered), {', '.join(_STRICT_KEYS)} "
       f"{Q.repaired(t, f'{t}_fixed', 'MISSING_FK', False)})" for t in ("conditions", "medications", "allergies")]],
    rows_sql("_ordered"))


@query("correct_in_key_order", _IN_ORDER)
def correct_in_key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five tables corrected in the order of their keys, children against parents as corrected."""
    return as_rows(key_order.correct_in_order(clinic.derived(spark, sf_dir), specs(), staging=_folder(spark))[0])


# --- whole runs -------------------------------------------------------------------------------

_DONE = [f"patients_done AS (SELECT * FROM patients_fixed)",
         *[f"{t}_done AS ({Q.repaired(t, f'{t}_fixed', 'MISSING_FK', False)})" for t in S.TABLES if t != "patients"]]


@query("correct_with_log", S.with_(Q.CORRECTED_CTES, rows_sql("_done")))
def correct_with_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_rows(pipeline.correct_with_log(clinic.derived(spark, sf_dir), specs(), _folder(spark))[0])


def _moved(table: str, c: str) -> str:
    kind = "Three_Table" if table not in ("patients", "encounters") and c == "PATIENT" else "Direct"
    return S.metric_from(table, "15C", f"{c}_FK_Corrected_{kind}", "foreign key repaired", f"SELECT count(*) FILTER (WHERE moved_{c}) AS e, count(*) AS t FROM {table}_moves")


def _moves(table: str) -> str:
    """The repair of a table's keys, and which of them it changed."""
    columns = ["PATIENT"] if table == "encounters" else ["PATIENT", "ENCOUNTER"]
    kept = ", ".join(f"{c} AS {c}_was" for c in columns)
    flags = ", ".join(f"{c} IS DISTINCT FROM {c}_was AS moved_{c}" for c in columns)
    return f"{table}_moves AS (SELECT {flags} FROM ({Q.repaired(table, f'(SELECT *, {kept} FROM {table}_fixed)', 'MISSING_FK', False)}))"


_CHILDREN = [t for t in S.TABLES if t != "patients"]


@query("correct_with_log_metrics", S.with_(
    [*S.ctes(*S.TABLES), *Q.KEY_CTES, *[c for t in S.TABLES for c in Q.corrected_ctes(t)], *[_moves(t) for t in _CHILDREN]],
    S.union([*[s for _, steps in Q._LOGS for s in steps],
             *[_moved(t, c) for t in _CHILDREN for c in (["PATIENT"] if t == "encounters" else ["PATIENT", "ENCOUNTER"])],
             S.skip("patients", "15C", "Cross_Table_Correction_Skipped", "no foreign keys declared")])))
def correct_with_log_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.correct_with_log(clinic.derived(spark, sf_dir), specs(), _folder(spark))[1]


_FULL = f"""(WITH {', '.join([*_shadowed('_linked'), *_STRICT_KEYS, *[c for t in S.TABLES for c in Q.corrected_ctes(t)], *_DONE])}
{{body}})"""


@query("full_run", S.with_(Q.LINKED_CTES, "SELECT * FROM " + _FULL.replace("{body}", rows_sql("_done"))))
def full_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile, validation, integrity repair, correction, saving and re-assessment of the five tables: the saved tables."""
    return as_rows(pipeline.run(clinic.stored(spark, sf_dir), clinic.AS_OF, _folder(spark), "parquet").tables)


@query("full_run_integrity", S.with_(Q.LINKED_CTES, "SELECT * FROM " + _FULL.replace(
    "{body}", S.union([m for m in Q._post_sql() if "'17PC_RI'" in m]))))
def full_run_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys after a full run: orphans, and the rows marked MISSING_FK."""
    after = pipeline.run(clinic.stored(spark, sf_dir), clinic.AS_OF, _folder(spark), "parquet").after
    return after.filter(F.col("quality_dimension") == "17PC_RI")
