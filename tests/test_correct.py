import pytest
from pyspark.sql import functions as F

from tablemend.operators import correct as C
from tablemend.plans import pipeline, synthea
from tests.fixtures import errors, eid, pid


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_patients(clinic, specs):
    fixed = C.correct(clinic["patients"], specs["patients"].fixes)
    assert fixed.columns == clinic["patients"].columns
    assert rows(fixed, "Id", "BIRTHDATE", "DEATHDATE", "SSN", "DRIVERS", "FIRST", "GENDER") == sorted([
        (pid(1), "1980-03-05", "2010-01-01", "999123456", "S99-1", "Ann", "F"),
        (pid(2), "2020-03-05", "2020-03-05", "999123456", "S99", "Bob", "M"),
        (pid(3), "2016-02-29", None, "12", "UNKNOWN", "Cyd", "U"),
        (pid(4), "1950-02-14", None, "INVALID_FORMAT", "S99-4", "Dan", "U"),
        (pid(5), "1960-07-08", "2024-06-30", "INVALID_FORMAT", "INVALID_FORMAT", "Eve", "U"),
        (pid(6), "2024-06-30", None, "12", "S99-6", "Fay", "M"),
        (pid(7), None, None, "999", "S99-7", "Gus", "M"),
        ("UNKNOWN", None, None, "INVALID_FORMAT", "UNKNOWN", "", "F"),
    ], key=repr)


def test_encounters(clinic, specs):
    fixed = C.correct(clinic["encounters"], specs["encounters"].fixes)
    got = rows(fixed, "ID", "START", "STOP", "PATIENT", "CODE")
    assert (eid(2), "2021-01-02", "2021-01-02", pid(2), "UNKNOWN") in got
    assert (eid(3), None, "2021-01-01", "BAD", "UNKNOWN") in got
    assert (eid(4), None, None, "UNKNOWN", "1") in got
    assert (eid(6), "2023-01-01", "2023-02-01", pid(3).upper(), "3") in got


def test_periods_with_and_without_the_dotted_layout(clinic):
    def stops(layouts):
        fixed = C.apply_fix(clinic["conditions"], C.fix_period("START", "STOP", layouts))
        return {(r.CODE, r.STOP) for r in fixed.collect()}
    with_dots, without = stops(synthea.PERIOD_LAYOUTS), stops([x for x in synthea.PERIOD_LAYOUTS if "." not in x])
    assert {("72892002", "2021-02-01"), (None, "2021-02-01"), ("1", "2021-01-01"), ("XXX123", None)} <= with_dots
    assert (None, None) in without and (None, "2021-02-01") not in without


def test_log_counts_changes(clinic, specs):
    marked = C.correct_marked(clinic["patients"], specs["patients"].fixes)
    got = {k[2]: v for k, v in errors(C.correction_log(marked, "patients", specs["patients"].fixes)).items()}
    assert got == {
        "Completeness_Auto_Fill": (6, 9),
        "Exact_Duplicates_Removed": (1, 9),
        "GENDER_Corrected": (3, 8),  # NULL, X and m
        "Dates_Corrected": (7, 8),  # all but the first row: an open death date was filled and is NULL again
        "SSN_Format_Corrected": (5, 8),
        "DRIVERS_Format_Corrected": (2, 8),
        "ID_Format_Corrected": (0, 8),
        "Whitespace_Trimmed": (1, 8),
    }


def test_numbers_are_filled_and_other_types_left(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, 2, 3.0, None)], "i int, l long, d double, t date")
    assert rows(C.fill_nulls(df), "i", "l", "d", "t") == [(0, 0, 0.0, None), (1, 2, 3.0, None)]


def test_correcting_twice_changes_nothing_more(clinic, specs):
    for name, df in clinic.items():
        once = C.correct(df, specs[name].fixes)
        twice = C.correct(once, specs[name].fixes)
        assert rows(once, *once.columns) == rows(twice, *once.columns), name


@pytest.mark.parametrize("repair", [True, False])
def test_corrected_tables_pass_their_checks(clinic, specs, repair):
    fixed = pipeline.correct_dataset(clinic, specs, repair=repair)
    got = errors(pipeline.assess_corrected(fixed, specs))
    for (table, dimension, rule), (bad, total) in got.items():
        if dimension in ("17PC_A", "17PC_T") or rule in ("SSN_Format", "GENDER"):
            assert bad == 0, (table, rule)
    # What was marked is counted apart from what is wrong.
    if repair:
        assert got["conditions", "17PC_RI", "PATIENT"] == (0, 8)
        assert got["conditions", "17PC_RI", "PATIENT_MISSING_FK"] == (2, 8)
        assert got["conditions", "17PC_RI", "ENCOUNTER_MISSING_FK"] == (3, 8)
    else:
        assert got["conditions", "17PC_RI", "PATIENT"][0] > 0
    # UNKNOWN is no code.
    assert got["conditions", "17PC_V", "CODE"] == (4, 8)


def test_drivers_unknown_passes_as_text(spark, specs):
    df = spark.createDataFrame([("UNKNOWN",)], "DRIVERS string")
    assert C.apply_fix(df, C.fix_characters("DRIVERS", "[^A-Za-z0-9-]")).first()[0] == "UNKNOWN"
    assert C.apply_fix(df.toDF("SSN"), C.fix_characters("SSN", "[^0-9]")).first()[0] == "INVALID_FORMAT"


def test_identifier_prefix_is_removed_before_the_check(spark):
    df = spark.createDataFrame([("bad-a1",), ("bad-a 1",), ("a_1",), (None,), ("xbad-1",)], "ID string")
    got = [r[0] for r in C.apply_fix(df, C.fix_identifier("ID")).collect()]
    assert got == ["a1", "UNKNOWN", "UNKNOWN", None, "xbad-1"]


def test_fixes_keep_rows(clinic, specs):
    for name, df in clinic.items():
        for fix in specs[name].fixes:
            assert C.apply_fix(df, fix).count() == df.count()


def test_trim_takes_blanks_only(spark):
    df = spark.createDataFrame([(" a ", 1), ("\tb\n", 2)], "t string, n int")
    assert rows(C.trim_texts(df), "t", "n") == [("\tb\n", 2), ("a", 1)]
    assert C.trim_texts(df).filter(F.col("n") == 1).first().t == "a"
