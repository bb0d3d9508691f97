import pytest

from tablemend.constants import MISSING_FK
from tablemend.operators import report as R
from tablemend.operators.metrics import metric_rows
from tablemend.operators.semantic import SUGGESTED, code_lookup, suggest_codes
from tablemend.operators.structure import detect_domain, domain_metric, overview, schema_drift, volumes
from tablemend.plans import pipeline, synthea
from tablemend.sources.metric_store import stamped
from tests.fixtures import AS_OF, errors, tables


@pytest.fixture(scope="module")
def metrics(spark):
    def row(table, dimension, rule, bad, total, status="checked"):
        return (table, dimension, rule, "x", bad, total, round(100 * bad / total, 2) if total else 0.0, status)
    return metric_rows(spark, [
        row("a", "7S", "r1", 1, 10), row("a", "7S", "r2", 2, 10), row("a", "12C", "r1", 9, 10),
        row("b", "7S", "r1", 1, 100), row("b", "??", None, 50, 100), row("b", "8BL", "r1", 0, 0, "skipped"),
    ])


def cells(df, *columns):
    return {tuple(r[c] for c in columns[:-1]): r[columns[-1]] for r in df.collect()}


def test_shares_weigh_by_rows_and_skip_what_was_not_checked(metrics):
    assert cells(R.dimension_share(metrics), "table_name", "quality_dimension", "error_percentage") == {
        ("a", "7S"): 15.0, ("a", "12C"): 90.0, ("b", "7S"): 1.0, ("b", "??"): 50.0}


def test_matrix(metrics):
    shares = R.dimension_share(metrics)
    filled = {r.table_name: r for r in R.matrix(shares, ["7S", "12C"], fill=True).collect()}
    assert (filled["a"]["7S"], filled["a"]["12C"], filled["b"]["12C"]) == (15.0, 90.0, 0.0)
    assert {r.table_name: r["12C"] for r in R.matrix(shares).collect()} == {"a": 90.0, "b": None}


def test_rankings(metrics):
    shares = R.dimension_share(metrics)
    assert cells(R.dimension_ranking(shares), "quality_dimension", "mean_percentage", "rank") == {
        ("12C", 90.0): 1, ("??", 50.0): 2, ("7S", 8.0): 3}
    assert cells(R.table_ranking(shares), "table_name", "mean_percentage", "rank") == {("a", 52.5): 1, ("b", 25.5): 2}


def test_stacked_and_severity(metrics):
    shares = R.dimension_share(metrics)
    assert cells(R.stacked(shares), "table_name", "quality_dimension", "bar_start", "bar_end") == {
        ("a", "12C", 0.0): 90.0, ("a", "7S", 90.0): 105.0, ("b", "??", 0.0): 50.0, ("b", "7S", 50.0): 51.0}
    assert cells(R.severity(shares), "table_name", "quality_dimension", "severity") == {
        ("a", "7S"): "critical", ("a", "12C"): "critical", ("b", "7S"): "recommended", ("b", "??"): "critical"}


def test_summaries(metrics):
    assert cells(R.by_dimension(metrics), "quality_dimension", "dimension_name", "error_count") == {
        ("7S", "Sintaktiskā Validācija"): 4, ("12C", "Pilnīgums (Pirms Labošanas)"): 9, ("??", "??"): 50,
        ("8BL", "Biznesa Loģikas Validācija"): 0}
    assert cells(R.by_table(metrics), "table_name", "error_count") == {("a",): 12, ("b",): 51}
    top = [(r.table_name, r.rule_name, r.error_count) for r in R.top_rules(metrics, 3).collect()]
    assert top == [("a", "r1", 10), ("a", "r2", 2), ("b", "r1", 1)]


def test_detail_has_the_headings(metrics):
    assert R.detail(stamped(metrics)).columns == list(R.DETAIL_HEADINGS.values())


def test_before_after_keeps_one_sided_checks(metrics):
    after = metrics.filter("table_name = 'b'")
    got = {(r.table_name, r.quality_dimension, r.rule_name): r for r in R.before_after(metrics, after).collect()}
    assert len(got) == 6
    assert got["b", "??", None].errors_delta == 0 and got["a", "7S", "r1"].errors_after is None


def test_structure(clinic, specs):
    assert cells(overview(clinic), "table_name", "n_columns", "n_rows")["patients", 7] == 9
    assert {r.table_name: r.total_count for r in volumes(clinic).collect()}["allergies"] == 3
    drift = errors(schema_drift(clinic, specs))
    assert ("patients", "5SV", "ID") not in drift  # "Id" is the declared ID
    assert drift["patients", "5SV", "BIRTHDATE"] == (1, 20)
    assert drift["encounters", "5SV", "START"] == (1, 14)
    undeclared = errors(schema_drift({"x": clinic["patients"]}, specs))
    assert undeclared == {("x", "5MD", "Schema Definition"): (1, 1)}
    extra = clinic["conditions"].withColumn("MORE", clinic["conditions"]["CODE"])
    assert errors(schema_drift({"conditions": extra}, specs))["conditions", "5SV", "Unexpected Columns"] == (1, 7)


def test_domains(spark):
    assert detect_domain(["orders", "patients"], synthea.DOMAINS).description == "healthcare"
    assert detect_domain(["orders"], synthea.DOMAINS).description == "industry"
    assert detect_domain(["courses"], synthea.DOMAINS).description == "education"
    assert domain_metric(spark, detect_domain(["x"], synthea.DOMAINS)).first().error_count == 1


def test_outside_healthcare_the_special_rules_are_skipped(spark, clinic):
    got = pipeline.validate_dataset({"orders": clinic["encounters"]}, {})
    assert {r.status for r in got.filter("quality_dimension in ('7S', '8RI', '9S')").collect()} == {"skipped"}


def test_suggested_codes(spark, clinic):
    codes = code_lookup(synthea.code_list(spark))
    got = {(r.CODE, r.DESCRIPTION): r[SUGGESTED] for r in suggest_codes(clinic["conditions"], codes).collect()}
    assert got[None, "chronic neck pain"] == "279039007"
    assert got["279039007", "Chronic neck pain (finding)"] is None  # has a numeric code
    assert got["XXX123", "Stress (finding)"] is None


def test_whole_run(spark, tmp_path):
    out = pipeline.run(tables(spark), AS_OF, str(tmp_path))
    assert {r.rule_name for r in out.saved.collect()} == {"Data_Saved_HDFS"}
    log = errors(out.corrections)
    assert log["patients", "15C", "Exact_Duplicates_Removed"] == (1, 9)
    assert ("conditions", "15C", "PATIENT_FK_Corrected_Three_Table") in log
    assert ("encounters", "15C", "PATIENT_FK_Corrected_Direct") in log
    left = errors(out.after)
    assert all(bad == 0 for (t, d, r), (bad, _) in left.items() if d == "17PC_RI" and "MISSING" not in r)
    # Rows without any key are marked and given to nobody, and no mark counts as a parent.
    rows = out.tables["conditions"].collect()
    lost = [r for r in rows if r.ENCOUNTER == MISSING_FK and r.PATIENT == MISSING_FK]
    assert lost and not any(r.PATIENT == "UNKNOWN" or r.ENCOUNTER == "UNKNOWN" for r in rows)
    compared = {(r.table_name, r.rule_name): r for r in out.comparison.collect()}
    assert compared["patients", None].errors_before == 1 and compared["patients", None].errors_after == 0
    assert out.integrity.count() > 0 and out.fixes.count() > 0 and out.validation.count() > 0
    back = spark.read.option("header", True).csv(str(tmp_path / "corrected" / "conditions"))
    assert back.count() == 8
