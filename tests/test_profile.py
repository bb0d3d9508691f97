import pytest
from pyspark.sql import functions as F

from tablemend.model import ColumnRule, Rule
from tablemend.functions import predicates as P
from tablemend.operators.profile import profile, profile_one_by_one
from tablemend.operators.uniqueness import duplicate_keys, duplicate_rows, row_groups
from tablemend.plans import pipeline, synthea
from tests.fixtures import errors


def profiled(clinic, specs):
    return errors(pipeline.profile_dataset(clinic, specs))


def test_profile_of_the_fixture(clinic, specs):
    got = profiled(clinic, specs)
    expected = {
        ("patients", "Pilnīgums (Completeness)", "ID"): (1, 9),
        ("patients", "Pilnīgums (Completeness)", "SSN"): (2, 9),
        ("patients", "Pilnīgums (Completeness)", "FIRST"): (1, 9),
        ("patients", "Unikalitāte (Uniqueness)", None): (1, 9),
        ("patients", "Precizitāte (Accuracy)", "GENDER"): (2, 9),  # X and m; NULL is not counted
        ("patients", "Precizitāte (Accuracy)", "BIRTHDATE"): (5, 9),  # two layouts, two INVALID, one NULL
        ("patients", "Savlaicīgums (Timeliness)", "BIRTHDATE/DEATHDATE"): (1, 9),
        ("encounters", "Savlaicīgums (Timeliness)", "START/STOP"): (1, 8),
        ("encounters", "Derīgums (Validity)", "CODE"): (1, 8),
        ("encounters", "Unikalitāte (Uniqueness)", None): (0, 8),
        ("conditions", "Derīgums (Validity)", "CODE"): (2, 8),  # n/a and the empty text
        # NULL, BAD, 99 and the key in capitals have no parent when case matters.
        ("encounters", "Starptabulu integritāte", "PATIENT→patients.ID"): (4, 8),
        ("conditions", "Starptabulu integritāte", "ENCOUNTER→encounters.ID"): (4, 8),
        ("medications", "Starptabulu integritāte", "PATIENT→patients.ID"): (2, 5),
        ("medications", "Starptabulu integritāte", "ENCOUNTER→encounters.ID"): (2, 5),
    }
    assert {k: got[k] for k in expected} == expected


def test_validation_of_the_fixture(clinic, specs):
    got = errors(pipeline.validate_dataset(clinic, specs).filter("quality_dimension <> '5SV'"),
                 "table_name", "quality_dimension", "rule_name", "issue_description")
    got = {k[:3] + (k[3],): v for k, v in got.items()}

    def count(table, dimension, rule, text):
        found = [v for k, v in got.items() if k[:3] == (table, dimension, rule) and text in k[3]]
        assert len(found) == 1, (table, dimension, rule, found)
        return found[0][0]

    assert count("Global", "5DD", "Domain Detection", "Veselības aprūpe") == 0
    assert count("patients", "7S", "BIRTHDATE", "19xx") == 2
    assert count("patients", "7S", "GENDER", "neither") == 3  # NULL, X and U
    assert count("patients", "7S", "BIRTHDATE_Format", "layouts") == 2
    assert count("patients", "7S", "BIRTHDATE_Future", "future") == 1
    assert count("patients", "7S", "DEATHDATE_Future", "future") == 1
    assert count("patients", "7S", "SSN_Format", "digits") == 4  # dashes twice, the empty text, abc
    assert count("patients", "7S", "DRIVERS_Format", "letters") == 2
    assert count("patients", "12C", "DEATHDATE", "expected") == 0
    assert count("encounters", "7S", "START", "INVALID") == 3
    assert count("encounters", "7S", "PATIENT", "BAD") == 2
    assert count("encounters", "7S", "START/STOP", "before") == 1
    assert count("conditions", "7S", "ENCOUNTER", "0000") == 1
    assert count("conditions", "7S", "STOP", "layouts") == 1
    assert count("conditions", "7S", "START/STOP", "before") == 1
    assert count("medications", "7S", "START", "unreadable") == 2
    assert count("medications", "7S", "STOP", "unreadable") == 2
    # Ignoring case and NULL: 99 only for conditions; BAD and 99 for encounters.
    assert count("conditions", "8RI", "PATIENT", "no such") == 1
    assert count("conditions", "8RI", "ENCOUNTER", "no such") == 2
    assert count("encounters", "8RI", "PATIENT", "no such") == 2
    assert count("medications", "8RI", "PATIENT", "no such") == 1
    assert count("medications", "8BL", "START/DEATHDATE", "death") == 1
    assert count("allergies", "8BL", "START/DEATHDATE", "death") == 1
    assert count("conditions", "10CL", "Male_Pregnancy", "man") == 1
    assert count("conditions", "10CL", "Young_Type2_Diabetes", "2015") == 1
    assert count("conditions", "9S", "CODE_SNOMED_Validity", "list") == 3
    assert count("conditions", "9S", "CODE_Correction_by_Description", "description") == 1
    assert count("conditions", "11FI", "PATIENT_Imputation_from_Encounter", "ENCOUNTER") == 1
    assert count("medications", "11FI", "PATIENT_Imputation_from_Encounter", "ENCOUNTER") == 1
    assert count("allergies", "11FI", "PATIENT_Imputation_from_Encounter", "ENCOUNTER") == 1
    assert count("conditions", "12T", "Timeliness", "five") == 1


def test_strict_medications_flag_everything(clinic):
    from tests.fixtures import AS_OF
    rules = [r for r in synthea.specs(AS_OF, strict_medications=True)["medications"].validation_rules
             if isinstance(r, Rule) and "unreadable" in r.description]
    assert {k[2]: v for k, v in errors(profile(clinic["medications"], "medications", rules)).items()} == {
        "START": (5, 5), "STOP": (5, 5)}


def test_fused_equals_one_by_one(clinic, specs):
    for name, df in clinic.items():
        rules = specs[name].validation_rules
        fused = sorted(map(tuple, profile(df, name, rules).collect()), key=repr)
        single = sorted(map(tuple, profile_one_by_one(df, name, rules).collect()), key=repr)
        assert fused == single


def test_empty_table_gives_its_volume_only(clinic, specs):
    none = clinic["patients"].filter("1 = 0")
    rows = profile(none, "patients", specs["patients"].profile_rules).collect()
    assert [(r.quality_dimension, r.error_count, r.total_count, r.status) for r in rows] == [("6V", 0, 0, "empty")]
    assert duplicate_rows(none, "patients").count() == 0
    assert profile(none, "patients", []).count() == 1


def test_missing_column_is_skipped_or_left_out(clinic):
    test = lambda c: c.isNull()
    rows = profile(clinic["patients"], "patients", [
        Rule("7S", "a", "x", test, ("NOPE",)), Rule("7S", "b", "x", test, ("NOPE",), optional=True),
        Rule("7S", "c", "x", test, ("NOPE|gender",)),
    ]).collect()
    assert {(r.rule_name, r.status, r.error_count) for r in rows} == {("a", "skipped", 0), ("c", "checked", 1)}


def test_wide_table_is_profiled_in_one_pass(spark):
    n = 320
    df = spark.range(10).select(*[F.when(F.col("id") < i % 3, F.col("id")).alias(f"c{i}") for i in range(n)])
    plan = profile(df, "wide", [ColumnRule("7S", "null", P.is_null)])
    assert plan._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
    got = errors(plan)
    assert len(got) == n
    assert all(got["wide", "7S", f"c{i}"] == (10 - i % 3, 10) for i in range(n))
    assert profile(df.filter("1 = 0"), "wide", [ColumnRule("7S", "null", P.is_null)]).count() == 1


@pytest.mark.parametrize("by_digest", [True, False])
def test_duplicate_rows(spark, by_digest):
    rows = [("a", None, 1.0), ("a", None, 1.0), (None, "a", 1.0), ("", "a", 1.0), ("1:", "x", 0.0), ("1", ":x", -0.0),
            ("z", "z", 0.0), ("z", "z", -0.0)]
    df = spark.createDataFrame(rows, "a string, b string, c double")
    (row,) = duplicate_rows(df, "t", by_digest=by_digest).collect()
    assert (row.error_count, row.total_count) == (2, 8)


def test_texts_travel_as_digests(spark):
    df = spark.range(5).withColumn("a", F.lit("x")).withColumn("b", F.lit("y"))
    assert row_groups(df).columns == ["__texts", "id", "copies"]
    assert row_groups(df.select("id")).columns == ["id", "copies"]


def test_duplicate_keys_count_null_as_a_value(clinic):
    (row,) = duplicate_keys(clinic["encounters"], "encounters", ["ID"]).collect()
    assert (row.error_count, row.total_count, row.rule_name) == (2, 8, "ID")
