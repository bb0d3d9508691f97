"""The command line steps, from raw CSV to the comparison, and failure isolation."""

import pytest
from pyspark.sql import functions as F

from tablemend.__main__ import arguments, main
from tablemend.plans import pipeline
from tests.fixtures import AS_OF, errors


@pytest.fixture(scope="module")
def base(clinic, tmp_path_factory):
    base = tmp_path_factory.mktemp("dataset")
    for name, df in clinic.items():
        df.coalesce(1).write.option("header", True).csv(f"{base}/original/{name}/csv")
    return base


def test_all_steps(spark, base):
    at = ["--as-of", AS_OF]
    main(["profile", f"{base}/original", f"{base}/m0", *at])
    main(["inject", f"{base}/original", f"{base}/corrupted", "--formats", "parquet,json,csv", *at])
    main(["profile", f"{base}/corrupted", f"{base}/m1", *at])
    main(["validate", f"{base}/corrupted", f"{base}/m2", *at])
    main(["repair", f"{base}/corrupted", f"{base}/linked", f"{base}/report", *at])
    main(["correct", f"{base}/corrupted", f"{base}/corrected", f"{base}/m3", *at])
    main(["correct", f"{base}/corrupted", f"{base}/uncoupled", f"{base}/m4", "--keep-keys", *at])
    main(["profile", f"{base}/corrected", f"{base}/m5", "--layout", "parts", *at])
    main(["report", f"{base}/m1", f"{base}/shares"])
    main(["compare", f"{base}/m1", f"{base}/m5", f"{base}/compared"])
    reports = ("severity", "matrix", "dimensions", "tables", "errors_by_dimension", "errors_by_table", "top_rules")
    assert all(spark.read.json(f"{base}/shares/{r}").count() > 0 for r in reports)
    assert "errors_delta" in spark.read.json(f"{base}/compared").columns
    assert spark.read.parquet(f"{base}/report-fixes").count() > 0
    stored = [spark.read.parquet(f"{base}/m{i}") for i in range(6)]
    assert all(m.count() > 0 for m in stored)
    assert stored[3].filter("rule_name = 'Data_Saved_HDFS'").count() == 5
    assert stored[3].filter("rule_name like '%Three_Table'").count() == 3
    assert stored[4].filter("rule_name like '%Three_Table' or rule_name like '%MISSING_FK'").count() == 0
    assert stored[5].select("table_name").distinct().count() == 5
    assert spark.read.json(f"{base}/report").count() > 0


def test_a_step_is_required():
    with pytest.raises(SystemExit):
        arguments([])


def test_an_unreadable_table_does_not_fail_the_profile(clinic, specs):
    broken = clinic["medications"].withColumn("CODE", F.raise_error(F.lit("disk gone")).cast("string"))
    got = pipeline.profile_dataset(clinic | {"medications": broken}, specs, isolate=True)
    failed = got.filter("status = 'failed'").collect()
    assert [(r.table_name, r.quality_dimension, r.total_count) for r in failed] == [("medications", "6V", 0)]
    rest = errors(got.filter("table_name <> 'medications'"))
    assert rest["patients", "Unikalitāte (Uniqueness)", None] == (1, 9)
    assert rest["conditions", "Starptabulu integritāte", "ENCOUNTER→encounters.ID"] == (4, 8)


def test_repairs_that_cannot_be_made_are_logged(clinic, specs, tmp_path):
    ds = {n: clinic[n] for n in ("conditions", "encounters")} | {"other": clinic["patients"]}
    _, log = pipeline.correct_with_log(ds, specs, str(tmp_path))
    skipped = {(r.table_name, r.rule_name) for r in log.filter("status = 'skipped'").collect()}
    assert skipped == {("conditions", "PATIENT_FK_Correction_Skipped"), ("encounters", "PATIENT_FK_Correction_Skipped"),
                       ("other", "Cross_Table_Correction_Skipped")}
