"""Broken records, Delta directories, snapshots, counts of writes, changed cells, survivors, key order, part files."""

import pytest
from pyspark.sql import functions as F

from tablemend.model import Fix, FkRule, TableSpec
from tablemend.operators import cells, key_order, survivors
from tablemend.operators import correct as C
from tablemend.operators import report as R
from tablemend.operators.metrics import metric_rows
from tablemend.sources import delta_log, metric_store, part_files, quarantine, sinks
from tablemend.sources.readers import FormatUnavailable
from verification import files


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_broken_csv_and_json_records(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.csv").write_text("a,b\n1,2\n3\n")
    (tmp_path / "c" / "b.csv").write_text("a,b\n5,6\n7,8,9\n\"x,y\",\n")
    found = quarantine.scan(spark, str(tmp_path / "c"), "csv", "t", str(tmp_path / "out"))
    assert content(found.rows) == [("1", "2"), ("5", "6"), ("x,y", None)] and (found.good, found.bad) == (3, 2)
    assert content(found.broken) == [("a.csv", "3"), ("b.csv", "7,8,9")]
    assert content(found.by_file()) == [("a.csv", 1, 1), ("b.csv", 2, 1)]
    assert found.metrics().first()["error_percentage"] == 40.0
    (tmp_path / "j.json").write_text('{"a":1,"b":"x"}\n{"a":2,\n[1]\n{"b":null}\n')
    found = quarantine.scan(spark, str(tmp_path / "j.json"), "json", "t", str(tmp_path / "out2"))
    assert content(found.rows) == [("1", "x"), (None, None)] and (found.good, found.bad) == (2, 2)
    with pytest.raises(ValueError):
        quarantine.raw(spark, "x", "parquet")


def test_delta_directory(spark, tmp_path):
    table, rows = str(tmp_path / "d"), spark.range(8).withColumn("p", F.col("id") % 2)
    files.put_part(rows.filter("p = 0").drop("p"), table, "p=0/x.parquet")
    files.put_part(rows.filter("p = 1").drop("p"), table, "p=1/y.parquet")
    files.commit(spark, table, 0, *files.described(rows, ["p"]), files.added("p=0/x.parquet", p="0"))
    files.commit(spark, table, 1, files.added("p=1/y.parquet", p="1"), files.removed("p=0/x.parquet"))
    assert content(delta_log.read_delta(spark, table)) == [(1, 1), (3, 1), (5, 1), (7, 1)]
    assert content(delta_log.read_delta(spark, table, 0)) == [(0, 0), (2, 0), (4, 0), (6, 0)]
    files.commit(spark, table, 2, files.removed("p=1/y.parquet"))
    assert content(delta_log.read_delta(spark, table)) == [] and delta_log.is_delta(spark, table)
    with pytest.raises(FileNotFoundError):
        delta_log.read_delta(spark, table, 9)
    files.commit(spark, table, 4, files.added("p=1/y.parquet"))
    with pytest.raises(FileNotFoundError):  # version 3 lacks
        delta_log.read_delta(spark, table)
    files.commit(spark, table, 3, {"add": {"path": "p=0/x.parquet", "deletionVector": {"storageType": "u"}}})
    with pytest.raises(FormatUnavailable):
        delta_log.read_delta(spark, table)


def test_writes_count_and_scan_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def passing(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(50).mapInArrow(passing, "id long")
    saved = sinks.write_dataset({"t": df, "none": spark.range(0)}, str(tmp_path / "w"), "csv").collect()
    assert [(r["table_name"], r["total_count"]) for r in saved] == [("t", 50), ("none", 0)] and seen.value == 50
    staged, counts = sinks.stage_counted({"t": spark.range(7)}, str(tmp_path / "s"))
    assert counts == {"t": 7} and staged["t"].count() == 7


def metrics(spark, *errors):
    return metric_rows(spark, [("t", "7S", r, "d", e, 10, e * 10.0, "checked") for r, e in errors])


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "h")
    for run, errors in (("a", [("x", 5), (None, 1)]), ("b", [("x", 5), (None, 2)]), ("c", [("x", 0), ("y", 3)])):
        metric_store.append_snapshot(metrics(spark, *errors), path, run)
    with pytest.raises(Exception, match="already exists"):
        metric_store.append_snapshot(metrics(spark, ("x", 1)), path, "a")
    with pytest.raises(ValueError):
        metric_store.append_snapshot(metrics(spark, ("x", 1)), path, "a/b")
    history = metric_store.read_snapshots(spark, path)
    assert metric_store.runs_of(history) == ["a", "b", "c"]
    found = {r["rule_name"]: r for r in R.across_snapshots(history, ["a", "b", "c"]).collect()}
    assert [found["x"][c] for c in ("errors_a", "errors_c", "changes", "first_change", "last_change")] == [5, 0, 1, "c", "c"]
    assert [found[None][c] for c in ("errors_b", "errors_c", "changes", "last_change")] == [2, None, 1, "b"]
    assert found["y"]["changes"] == 0 and found["y"]["first_change"] is None


def test_changed_cells(spark):
    before = spark.createDataFrame([(1, "a", None), (1, "b", "x"), (2, "c", "y"), (None, "n", "n")], "k int, v string, w string")
    after = spark.createDataFrame([(1, "a", None), (1, "b", "z"), (3, "c", None), (None, "n", None)], "k int, v string, w string")
    found = content(cells.changed_cells(before, after, ["k"]))
    assert (2, 1, "removed", "v", "c", None) in found and (3, 1, "added", "w", None, None) in found
    assert (None, 1, "changed", "w", "n", None) in found
    assert [r for r in found if r[2] == "changed" and r[0] == 1 and r[3] == "w"] in (
        [(1, 2, "changed", "w", "x", "z")], [(1, 1, "changed", "w", "x", "z")]) or len([r for r in found if r[0] == 1]) > 1
    assert content(cells.changed_cells(before, before, ["k"])) == []


def test_cells_add_up_to_the_log(spark):
    rows = [("m", None, " a "), ("m", None, " a "), ("x", "12", "b"), (None, "12", "b"), ("F", "1-2", "c")]
    df = spark.createDataFrame(rows, "GENDER string, SSN string, NAME string")
    fixes = [C.fix_gender("GENDER"), C.fix_characters("SSN", "[^0-9]")]
    found = cells.correction_cells(df, "t", fixes)
    log = {r["rule_name"]: r["error_count"] for r in C.correction_log(C.correct_marked(df, fixes), "t", fixes).collect()}
    per_step = {r["step"]: r["error_count"] for r in cells.cells_per_step(found).collect()}
    assert per_step == {k: v for k, v in log.items() if v and k != "Exact_Duplicates_Removed"}
    assert ("GENDER_Corrected", "GENDER", "x", "U") in {(r["step"], r["column"], r["old"], r["new"]) for r in found.collect()}
    assert ("Completeness_Auto_Fill", 2) in {(r["step"], r["rows"]) for r in found.collect()}


def test_survivors_and_rejected_rows(spark):
    rows = [("1", "2020-01-01", None), ("1", "2019-01-01", "full"), ("1", "2021-01-01", "full"), ("1", "2021-01-01", "full"),
            ("UNKNOWN", None, "a"), (None, None, "b"), ("2", None, None)] + [("hot", f"2020-01-{d:02d}", "x") for d in range(1, 29)]
    df = spark.createDataFrame(rows, "id string, day string, v string")
    kept = content(survivors.survivors(df, ["ID"], newest="DAY"))
    assert kept == sorted([("1", "2021-01-01", "full"), ("UNKNOWN", None, "a"), (None, None, "b"), ("2", None, None), ("hot", "2020-01-28", "x")], key=repr)
    lost = survivors.rejected(df, ["id"], newest="day").collect()
    assert sum(r["__copies"] for r in lost) + len(kept) == len(rows) and ("1", "2021-01-01", 1) in {(r["id"], r["day"], r["__copies"]) for r in lost}
    profile = survivors.key_profile({"t": df, "u": df}, {"t": TableSpec("t", primary_key=("id",)), "u": TableSpec("u", primary_key=("none",))}).collect()
    assert [(r["error_count"], r["status"]) for r in profile] == [(30, "checked"), (2, "checked"), (0, "skipped")]
    assert survivors.survivors(df.limit(0), ["id"]).collect() == []


def test_keys_in_order(spark):
    rules = [FkRule("c", "b", "b", "id"), FkRule("b", "a", "a", "id"), FkRule("a", "up", "a", "id")]
    assert key_order.key_order(["c", "b", "a"], rules) == (["a", "b", "c"], [])
    ring = [*rules, FkRule("a", "c", "c", "id")]
    assert key_order.key_order(["c", "b", "a", "d"], ring) == (["d"], ["c", "b", "a"])
    renamed = Fix("New", "", ("id",), lambda c: [F.when(c == "p1", "q9").otherwise(c)])
    parents = spark.createDataFrame([("p1",), ("p2",), ("p2",)], "id string")
    children = spark.createDataFrame([("P1", 1), ("p2", 2), ("zz", 3), (None, 4)], "parent string, n int")
    specs = {"p": TableSpec("p", fixes=(renamed,)), "c": TableSpec("c", fk_rules=(FkRule("c", "parent", "p", "id"),))}
    for limit in (None, -1):
        out, log = key_order.correct_in_order({"c": children, "p": parents}, specs, limit=limit)
        assert content(out["c"]) == [("MISSING_FK", 3), ("MISSING_FK", 4), ("p2", 2), ("q9", 1)]
        assert [(r["rule_name"], r["error_count"], r["total_count"]) for r in log.collect()] == [
            ("Key_Order", 0, 2), ("parent_Followed_Renamed", 1, 4)]
    cyclic = {"p": TableSpec("p", fk_rules=(FkRule("p", "id", "c", "parent"),)), "c": specs["c"]}
    out, log = key_order.correct_in_order({"c": children, "p": parents}, cyclic)
    assert log.first()["issue_description"] == "keys form a cycle: c, p" and out["c"].count() == 4


def test_part_files(spark, tmp_path):
    folder, df = str(tmp_path / "t"), spark.range(10).withColumn("v", F.lit("a"))
    files.put_part(df, folder, "a.parquet")
    files.put_part(df.limit(0), folder, "none.parquet")
    files.put_part(df.withColumn("id", F.lit("text")), folder, "typed.parquet")
    files.put_text(spark, f"{folder}/bad.parquet", "x" * 50)
    parts = part_files.read_parts(spark, folder, "parquet", "t", df.schema)
    assert parts.table_rows().count() >= 10
    assert content(parts.counts().select("file_name", "n_rows")) == [("a.parquet", 10), ("bad.parquet", 0), ("none.parquet", 0), ("typed.parquet", 0)]
    found = parts.metrics().collect()
    assert (found[0]["error_count"], found[0]["total_count"]) == (3, 4) and len(found) == 4
