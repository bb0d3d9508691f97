"""What is worked out once: lookups, corrected parents, line items with their orders, metrics of a report,
changed cells, keys and their detours."""

from __future__ import annotations

import contextlib
import io
from dataclasses import replace

from tablemend.model import FkRule, Via
from tablemend.operators import cells, key_order
from tablemend.operators.metrics import union_all
from tablemend.operators.orphans import fk_metrics, shared_detours
from tablemend.operators.repair import MARK_MISSING, StoredLookups, impute_candidates
from tablemend.plans import pipeline
from verification import clinic as star
from verification import profile_queries, report_queries

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("extended")
    return out.getvalue()


def rows(df) -> list:
    return sorted(map(str, df.collect()))


def test_cells_are_not_filtered_in_an_array(clinic, specs):
    found = plan(cells.correction_cells(clinic["conditions"], "conditions", specs["conditions"].fixes))
    assert "lambda" not in found and "Generate explode" in found


def test_line_items_meet_their_orders_once(spark):
    assert all("Join" not in plan(df) for df in star.derived(spark, SMALL).values())
    assert rows(star.derived(spark, SMALL)["allergies"]) == rows(star.dirty(spark, SMALL)["allergies"])


def test_reports_read_stored_metrics(spark):
    found = plan(report_queries.metrics(spark, SMALL))
    assert "Aggregate" not in found and "parquet" in found


def test_corrected_dataset_shares_stored_lookups(clinic, specs, tmp_path):
    stored = StoredLookups(clinic, str(tmp_path))
    got, plain = pipeline.correct_dataset(clinic, specs, stored=stored), pipeline.correct_dataset(clinic, specs)
    assert all(rows(got[t]) == rows(plain[t]) for t in plain)
    # patients, and encounters with the patients they lead to
    assert len(list(tmp_path.iterdir())) == 2


def test_parents_in_key_order_are_corrected_once(clinic, specs, tmp_path):
    got, log = key_order.correct_in_order(clinic, specs, MARK_MISSING, staging=str(tmp_path))
    plain, plain_log = key_order.correct_in_order(clinic, specs, MARK_MISSING)
    assert all(rows(got[t]) == rows(plain[t]) for t in plain) and rows(log) == rows(plain_log)
    assert {p.name for p in (tmp_path / "parents").iterdir()} == {"patients", "encounters"}


def test_keys_that_a_detour_could_fill_are_counted_with_the_orphans(clinic, specs):
    """One grouping by key counts both; a detour to another column of the same parent is looked up apart."""
    assert "__through" not in plan(pipeline.validate_dataset(clinic, specs))
    other = FkRule("conditions", "CODE", "patients", "ID", Via("ENCOUNTER", "encounters", "ID", "CODE"))
    more = replace(specs["conditions"], fk_rules=(*specs["conditions"].fk_rules, other))
    rules = [r for t in clinic for r in {**specs, "conditions": more}[t].fk_rules]
    detours = [r for r in rules if r.via is not None]
    assert set(shared_detours(clinic, rules, detours)) == set(detours) - {other}
    got = pipeline.validate_dataset(clinic, {**specs, "conditions": more}).filter("quality_dimension = '11FI' and status = 'checked'")
    want = union_all(impute_candidates(clinic[r.table], r, clinic) for r in detours)
    assert rows(got) == rows(want) and len(detours) == 4


def test_detours_on_odd_keys(spark):
    """Copies of a key, marks of missing values, capitals, NULL keys and rules that stand twice."""
    parents = spark.createDataFrame([("a", None), ("a", "p"), ("b", None), ("n/a", "p"), (None, "p"), ("C", "q")], "ID string, PATIENT string")
    child = spark.createDataFrame(
        [(None, "A"), (None, "a"), ("x", "a"), (None, "b"), (None, "n/a"), (None, None), (None, "c"), (None, "gone")],
        "PATIENT string, ENCOUNTER string")
    ds = {"encounters": parents, "conditions": child}
    key, via = FkRule("conditions", "ENCOUNTER", "encounters", "ID"), FkRule(
        "conditions", "PATIENT", "patients", "ID", Via("ENCOUNTER", "encounters", "ID", "PATIENT"))
    found = fk_metrics(ds, [key, key], "8RI", nulls_are_orphans=False, ignore_case=True, detours=shared_detours(ds, [key, key], [via]))
    led = found.filter("quality_dimension = '11FI'")
    assert [(r["error_count"], r["total_count"]) for r in led.collect()] == [(3, 8)]
    assert rows(led) == rows(impute_candidates(child, via, ds))
    for empty in (parents.limit(0), parents.filter("PATIENT IS NULL")):
        without = {**ds, "encounters": empty}
        led = fk_metrics(without, [key], "8RI", nulls_are_orphans=False, ignore_case=True, detours=[via]).filter("quality_dimension = '11FI'")
        assert rows(led) == rows(impute_candidates(child, via, without))


def test_validation_reads_derived_tables(spark, monkeypatch):
    monkeypatch.setattr(star, "stored", None)
    for query in (profile_queries.validate_dataset, profile_queries.report_by_dimension_named):
        assert "__through" not in plan(query(spark, SMALL))
