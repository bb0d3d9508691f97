import pytest
from pyspark.sql import functions as F

from tablemend.constants import MISSING_FK, UNKNOWN
from tablemend.functions.columns import fold
from tablemend.model import FkRule, Via
from tablemend.operators.integrity_report import integrity_report
from tablemend.operators.lookup import attach, broadcast_limit, known_keys, lookup
from tablemend.operators.orphans import KeyUse, empty_references, fk_metrics, key_use_counts, link_rates, orphans
from tablemend.operators.repair import (
    MARK_MISSING, MARK_UNKNOWN, StoredLookups, fix_log, impute_candidates, repair_integrity, repair_keys, sanitize_identifiers,
)
from tablemend.operators.semantic import code_lookup, suggest_codes, suggested_codes
from tablemend.plans import synthea
from tests.fixtures import eid, errors, pid

LIMITS = pytest.mark.parametrize("limit", [None, -1], ids=["broadcast", "sliced"])


@LIMITS
def test_chained_repair_marks_what_is_left(clinic, limit):
    fixed = repair_keys(clinic["conditions"], synthea.fk_rules("conditions"), clinic, MARK_MISSING, limit)
    got = sorted((r.CODE or "", r.DESCRIPTION or "", r.PATIENT, r.ENCOUNTER) for r in fixed.collect())
    assert got == sorted([
        ("279039007", "Chronic neck pain (finding)", pid(1), eid(1)),
        ("72892002", "Normal PREGNANCY", pid(2), eid(2)),
        ("", "chronic neck pain", pid(1), eid(1).upper()),  # two patients share encounter 1: the smaller
        ("XXX123", "Stress (finding)", MISSING_FK, MISSING_FK),
        ("44054006", "Diabetes: type 2 diabetes mellitus", pid(3), eid(5)),
        ("1", "  Acute deep venous thrombosis (disorder) ", pid(4), eid(4)),
        ("n/a", "", pid(2).upper(), MISSING_FK),
        ("", "x", MISSING_FK, MISSING_FK),
    ])


@LIMITS
def test_detour_for_unknown_keys_only(clinic, specs, limit):
    fixed = repair_integrity(clinic, specs, limit)
    keys = {(r.CODE, r.DESCRIPTION): r.PATIENT for r in fixed["conditions"].collect()}
    assert keys[None, "chronic neck pain"] == pid(1)
    # A key that is wrong but not unknown is not replaced by the detour.
    assert keys["1", "  Acute deep venous thrombosis (disorder) "] == UNKNOWN
    # An encounter without a real patient recovers nothing.
    assert {r.PATIENT for r in fixed["allergies"].collect()} == {pid(1), UNKNOWN}
    ids = {r.ID for r in fixed["encounters"].collect()}
    assert UNKNOWN in ids and not any(i.startswith("bad-") for i in ids)


@LIMITS
@pytest.mark.parametrize("mode", [MARK_MISSING, MARK_UNKNOWN])
def test_repair_keeps_rows_and_leaves_only_known_keys(clinic, mode, limit):
    known = {"patients": {r.Id.lower() for r in clinic["patients"].collect() if r.Id},
             "encounters": {r.ID.lower() for r in clinic["encounters"].collect() if r.ID}}
    for name in ("encounters", *synthea.CLINICAL):
        rules = synthea.fk_rules(name)
        fixed = repair_keys(clinic[name], rules, clinic, mode, limit)
        assert fixed.columns == clinic[name].columns
        assert fixed.count() == clinic[name].count()
        for rule in rules:
            values = {r[0] for r in fixed.select(rule.column).collect()}
            assert {v.lower() for v in values if v != mode.sentinel} <= known[rule.ref_table]


def test_change_marks(clinic):
    fixed = repair_keys(clinic["medications"], synthea.fk_rules("medications"), clinic, mark_changes=True)
    assert fixed.filter("__rekeyed_PATIENT").count() == 2
    assert fixed.filter("__rekeyed_ENCOUNTER").count() == 2


def test_sanitize_identifiers(clinic):
    clean = sanitize_identifiers(clinic["medications"], ["PATIENT", "ENCOUNTER", "NOPE"])
    assert clean.filter(F.col("PATIENT") == UNKNOWN).count() == 2
    assert clean.filter(F.col("ENCOUNTER") == UNKNOWN).count() == 2


def test_fix_log(clinic, specs):
    got = {k[0::2]: v for k, v in errors(fix_log(clinic, specs)).items()}
    assert got["patients", "ID_Format_Corrected"] == (1, 9)
    assert got["encounters", "ID_Format_Corrected"] == (1, 8)
    assert got["conditions", "PATIENT_Format_Corrected"] == (3, 8)
    assert got["conditions", "PATIENT_FK_Corrected_Chained"] == (1, 8)
    assert got["conditions", "ENCOUNTER_FK_Corrected_Direct"] == (1, 8)
    assert got["encounters", "PATIENT_FK_Corrected_Direct"] == (2, 8)
    assert ("allergies", "PATIENT_FK_Corrected_Chained") not in got


def test_key_use_counts_add_up(clinic):
    uses = [KeyUse(t, clinic[t], "PATIENT") for t in ("encounters", "conditions", "medications")]
    rows = {r.label: r for r in key_use_counts(uses, clinic["patients"], "ID", ignore_case=True, sentinel="BAD").collect()}
    for r in rows.values():
        assert r.total == r.null_keys + r.sentinel_keys + r.linked + r.dangling
    e = rows["encounters"]
    assert (e.total, e.null_keys, e.sentinel_keys, e.linked, e.dangling) == (8, 1, 1, 5, 1)


def test_orphans_follow_joins(clinic):
    """The grouped counts equal plain anti-joins."""
    for rule in synthea.PROFILE_FKS:
        child, parent = clinic[rule.table], clinic[rule.ref_table]
        plain = child.join(parent.select(F.col(rule.ref_column).alias("k")), F.col(rule.column) == F.col("k"), "left_anti")
        (row,) = fk_metrics(clinic, [rule], nulls_are_orphans=True, ignore_case=False).collect()
        assert row.error_count == plain.count()


def test_rules_that_cannot_be_checked_are_skipped(clinic):
    rules = [FkRule("conditions", "PATIENT", "nobody", "ID"), FkRule("conditions", "NOPE", "patients", "ID")]
    rows = fk_metrics(clinic, rules, nulls_are_orphans=True, ignore_case=True).collect()
    assert {(r.status, r.error_count, r.total_count) for r in rows} == {("skipped", 0, 0)} and len(rows) == 2


def test_empty_reference_is_reported(clinic, specs):
    ds = clinic | {"patients": clinic["patients"].filter("Id is null")}
    rules = [r for t in synthea.TABLES for r in synthea.fk_rules(t)]
    rows = empty_references(ds, rules).collect()
    assert {(r.table_name, r.rule_name) for r in rows} == {
        (t, "PATIENT_Ref_Table_Empty") for t in ("encounters", *synthea.CLINICAL)}
    assert empty_references(clinic, rules).count() == 0


def test_link_rates_and_report(clinic, specs):
    fixed = repair_integrity(clinic, specs)
    rates = {(r.table_name, r.fk_column): r for r in link_rates(fixed, synthea.fk_rules("conditions")).collect()}
    r = rates["conditions", "PATIENT"]
    assert (r.total, r.unknown, r.candidates, r.linked) == (8, 3, 5, 5)
    rows = {(x.table_name, x.metric_type, x.column_name): x for x in integrity_report(fixed, specs).collect()}
    unknown = rows["conditions", "Referential Integrity (UNKNOWN FK - Post-Fix)", "PATIENT (UNKNOWN Sentinel)"]
    assert (unknown.raw_count, unknown.total_count, unknown.value) == (3, 8, "3 vērtības ir 'UNKNOWN'")
    filled = rows["conditions", "Completeness", "CODE"]
    assert (filled.raw_count, filled.total_count, filled.value) == (5, 8, "62.50% aizpildīts")


def test_impute_candidates(clinic):
    (row,) = impute_candidates(clinic["allergies"], synthea.fk_rules("allergies")[0], clinic).collect()
    assert (row.error_count, row.total_count) == (1, 3)  # the detour gives BAD, which is a value


# --- lookups under skew ------------------------------------------------------

@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share a key, a third have none, and many rows are copies."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).when(F.col("id") % 3 == 1, F.col("id").cast("string")).alias("k"),
        (F.col("id") % 2).alias("v"),
    ).repartition(6)
    parents = spark.range(0, 30_000, 2).select(F.col("id").cast("string").alias("p")).union(
        spark.createDataFrame([("hot",), (None,)], "p string"))
    return rows, parents


def test_building_a_lookup_runs_no_job(spark, skewed):
    rows, parents = skewed
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("building"))
    spark.sparkContext.setJobGroup("building", "plans only")
    try:
        attach(rows, fold(F.col("k")), known_keys(parents, "p", "found"), -1)
        suggested_codes(spark.createDataFrame([("x", "Stress")], "CODE string, DESCRIPTION string"), "t",
                        code_lookup(synthea.code_list(spark)))
        assert jobs() == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_the_code_list_is_broadcast(spark):
    df = spark.range(10).selectExpr("cast(null as string) AS CODE", "cast(id as string) AS DESCRIPTION")
    plan = suggest_codes(df, code_lookup(synthea.code_list(spark)))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "__spread" not in plan


def test_marks_of_missing_keys_are_no_keys(spark):
    """A row whose own key and detour are both unknown is given to nobody."""
    patients = spark.createDataFrame([("P1",), ("UNKNOWN",), ("n/a",)], "ID string")
    encounters = spark.createDataFrame([("UNKNOWN", "P1"), ("E1", "P1"), ("E2", "UNKNOWN")], "ID string, PATIENT string")
    conditions = spark.createDataFrame(
        [("UNKNOWN", "UNKNOWN"), ("UNKNOWN", "E1"), ("MISSING_FK", "E2"), (None, None), ("n/a", "missing_fk"), ("p1", "e1")],
        "PATIENT string, ENCOUNTER string")
    ds = {"patients": patients, "encounters": encounters, "conditions": conditions}
    for limit in (-1, 10**9):
        fixed = repair_keys(conditions, synthea.fk_rules("conditions"), ds, limit=limit).collect()
        assert sorted(map(tuple, fixed)) == [
            (MISSING_FK, "E2"), (MISSING_FK, MISSING_FK), (MISSING_FK, MISSING_FK), (MISSING_FK, MISSING_FK), ("P1", "E1"), ("p1", "e1")]
    (row,) = fk_metrics(ds, [synthea.fk_rules("conditions")[1]], nulls_are_orphans=False, ignore_case=True).collect()
    assert (row.error_count, row.total_count) == (2, 6)


def test_numbers_as_keys(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id bigint")
    child = spark.createDataFrame([(1, "a"), (3, "b"), (None, "c")], "k bigint, v string")
    fixed = repair_keys(child, [FkRule("child", "k", "parent", "id")], {"parent": parents})
    assert sorted(map(tuple, fixed.collect())) == [("1", "a"), (MISSING_FK, "b"), (MISSING_FK, "c")]


@pytest.mark.parametrize("nulls, ci, sentinel, left", [
    (True, False, None, [None, "A", "BAD", "z"]), (False, True, "BAD", ["z"]), (False, False, "BAD", ["A", "z"])])
def test_orphan_rows(spark, nulls, ci, sentinel, left):
    child = spark.createDataFrame([("a",), ("A",), ("z",), (None,), ("BAD",)], "k string")
    parent = spark.createDataFrame([("a",), (None,), ("unknown",)], "id string")
    rows = orphans(child, "k", parent, "id", nulls_are_orphans=nulls, ignore_case=ci, sentinel=sentinel).collect()
    assert sorted([r[0] for r in rows], key=str) == sorted(left, key=str)


def test_sliced_lookup_equals_broadcast(spark, skewed):
    rows, parents = skewed
    known = known_keys(parents, "p", "found")
    sliced = attach(rows, fold(F.col("k")), known, -1)
    whole = attach(rows, fold(F.col("k")), known, 10**9)
    assert sliced.columns == whole.columns == ["k", "v", "found"]
    summary = lambda df: sorted(map(tuple, df.groupBy("k", "v", "found").count().collect()), key=repr)
    assert summary(sliced) == summary(whole)
    assert sliced.filter("found and k = 'HOT'").count() == 10_000
    assert sliced.filter("found and k <> 'HOT'").count() == 5_000


def test_rows_without_a_key_are_spread(spark, skewed):
    rows, parents = skewed
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = attach(rows, fold(F.col("k")), known_keys(parents, "p", "found"))
        per_task = out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count("found"))
        sizes = [r["n"] for r in per_task.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # "HOT" is left to the adaptive engine, which is off here; the rows without a key go to all tasks.
    assert len(sizes) == 4 and sum(sizes) == 30_000 and max(sizes) < 17_000


def test_lookup_has_one_row_per_key(spark):
    df = spark.createDataFrame([("a", 2), ("A", 1), (None, 0)], "k string, v int")
    rows = lookup(df, fold(F.col("k")), least=F.min("v")).rows.collect()
    assert [tuple(r) for r in rows] == [("a", 1)]


def test_broadcast_limit_reads_the_session(spark):
    assert broadcast_limit(spark) == 10 * 2**20
    for text, expected in (("1k", 1024), ("20MB", 20 * 2**20), ("-1", -1), ("7", 7)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", text)
        assert broadcast_limit(spark) == expected
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_large_lookup_is_not_broadcast(spark, skewed):
    rows, parents = skewed
    plan = attach(rows, fold(F.col("k")), known_keys(parents, "p", "found"), 0)._jdf.queryExecution().toString()
    assert "__spread" in plan


def test_rows_with_maps_can_be_sliced(spark, skewed):
    rows, parents = skewed
    with_map = rows.withColumn("m", F.create_map(F.lit("a"), F.col("v")))
    assert attach(with_map, fold(F.col("k")), known_keys(parents, "p", "found"), -1).count() == 30_000


def test_rules_without_detour_table_fall_back_to_direct_repair(clinic):
    rule = FkRule("conditions", "PATIENT", "patients", "ID", Via("ENCOUNTER", "visits", "ID", "PATIENT"))
    fixed = repair_keys(clinic["conditions"], [rule], clinic)
    assert fixed.filter(F.col("PATIENT") == MISSING_FK).count() == 4


@pytest.mark.parametrize("mode", [MARK_MISSING, MARK_UNKNOWN])
def test_stored_lookups_read_the_parents_once(spark, clinic, specs, tmp_path, mode):
    for name in ("patients", "encounters"):
        clinic[name].write.parquet(f"{tmp_path}/in/{name}")
    ds = clinic | {name: spark.read.parquet(f"{tmp_path}/in/{name}") for name in ("patients", "encounters")}
    stored = StoredLookups(ds, f"{tmp_path}/lookups")
    for limit in (None, -1):
        for name in ("conditions", "medications", "allergies"):
            rules = specs[name].fk_rules
            shared = repair_keys(ds[name], rules, ds, mode, limit, True, stored)
            plan = shared._jdf.queryExecution().optimizedPlan().toString()
            assert not any(f"{tmp_path}/in" in f for f in shared.inputFiles()) and "Aggregate" not in plan
            assert sorted(map(str, shared.collect())) == sorted(map(str, repair_keys(ds[name], rules, ds, mode, limit, True).collect()))
    # Of the keys of encounters and of patients, one lookup each.
    assert len(list((tmp_path / "lookups").iterdir())) == 2
