"""Large tables: worked on one after the other, written between their shuffles, whose files do not stay."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tablemend.operators import cells, key_order
from tablemend.operators.lookup import Lookup, attach
from tablemend.operators.repair import StoredLookups, repair_integrity
from tablemend.plans import pipeline
from tablemend.sources import metric_store, sinks
from verification import clinic as star
from verification import history_queries

SMALL = "/root/testdata/sf0.001"


def rows(df) -> list:
    return sorted(map(str, df.collect()))


def tables(ds) -> dict:
    return {name: rows(df) for name, df in ds.items()}


def shuffle_files(spark) -> int:
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).getName().startswith("shuffle_") for i in range(files.size()))


@pytest.fixture
def large(spark, monkeypatch):
    """Every table is large and no join is a broadcast; the folders that steps were written to."""
    written = []
    cut = sinks.Steps.cut

    def spied(self, df):
        out = cut(self, df)
        written.extend([self.folder] if out is not df else [])
        return out

    monkeypatch.setattr(sinks, "LARGE", -1)
    monkeypatch.setattr(sinks.Steps, "cut", spied)
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield written
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def few(spark, before) -> bool:
    """Whether the files go, which happens in the background."""
    until = time.time() + 20
    while shuffle_files(spark) > before and time.time() < until:
        time.sleep(0.2)
    return shuffle_files(spark) <= before


def test_writes_leave_no_shuffle_files(spark, clinic, tmp_path):
    before, setting = shuffle_files(spark), spark.conf.get(sinks._DROP, None)
    made = spark.range(1000).repartition(3, F.col("id"))
    sinks.stage_dataset({"a": made, "b": made.groupBy(F.col("id") % 7).count()}, str(tmp_path / "t"))
    StoredLookups(clinic, str(tmp_path / "l")).known("encounters", "ID", "there")
    metric_store.append_snapshot(pipeline.profile_dataset(clinic, {}), str(tmp_path / "h"), "one")
    assert few(spark, before) and spark.conf.get(sinks._DROP, None) == setting


def test_size_of_sources_counts_files(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "n"))
    read = spark.read.parquet(str(tmp_path / "n"))
    size = sinks.source_bytes(read)
    assert 0 < size < 10**6 and sinks.source_bytes(read.unionByName(read).groupBy("id").count()) == 2 * size


def test_rows_are_written_between_shuffles_only(spark, tmp_path, large):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, n int")
    facts = Lookup(spark.createDataFrame([("a", True)], "__key string, there boolean"), 100)
    steps = sinks.Steps(str(tmp_path / "s"), df)
    once = attach(df, F.col("k"), facts, -1, steps)
    assert not large and not steps.used
    twice = attach(once.withColumnRenamed("there", "one"), F.col("k"), facts, -1, steps)
    assert len(large) == 1 and rows(twice) == rows(df.selectExpr("k", "n", "nullif(k = 'a', false) as one", "nullif(k = 'a', false) as there"))
    assert attach(twice.drop("one", "there"), F.col("k"), facts, 10**6, steps).count() == 3 and len(large) == 1
    cut = steps.cut(twice)
    assert len(large) == 2 and [p.name for p in (tmp_path / "s").iterdir()] == ["1"] and cut.count() == 3
    steps.close()
    assert not (tmp_path / "s").exists()


def test_small_tables_take_no_steps(spark, clinic, tmp_path):
    """Nor do rows whose size nobody knows."""
    assert sinks.source_bytes(spark.createDataFrame(clinic["patients"].rdd, clinic["patients"].schema)) == 0
    steps = sinks.Steps(str(tmp_path), clinic["patients"])
    assert not steps.large and steps.cut(grouped := clinic["patients"].distinct()) is grouped


def test_corrected_in_steps(clinic, specs, tmp_path, large):
    """The same tables and log as without steps, and the rows between the steps are removed."""
    plain = pipeline.correct_dataset(clinic, specs, limit=-1)
    staged = pipeline.correct_dataset(clinic, specs, limit=-1, stored=StoredLookups(clinic, f"{tmp_path}/l", -1), staging=f"{tmp_path}/c")
    assert tables(staged) == tables(plain) and len(large) >= 4
    logged, log = pipeline.correct_with_log(clinic, specs, f"{tmp_path}/m", limit=-1)
    assert tables(logged) == tables(plain)
    assert not list(tmp_path.glob("*-steps/*"))
    sinks.LARGE = 2**40
    assert rows(log) == rows(pipeline.correct_with_log(clinic, specs, f"{tmp_path}/n", limit=-1)[1])


def test_integrity_is_repaired_in_steps(clinic, specs, tmp_path, large):
    staged = repair_integrity(clinic, specs, -1, StoredLookups(clinic, f"{tmp_path}/l", -1), f"{tmp_path}/r")
    assert tables(staged) == tables(repair_integrity(clinic, specs, -1)) and len(large) >= 3


def test_key_order_in_steps(clinic, specs, tmp_path, large):
    got, log = key_order.correct_in_order(clinic, specs, limit=-1, staging=str(tmp_path))
    plain, plain_log = key_order.correct_in_order(clinic, specs, limit=-1)
    assert tables(got) == tables(plain) and rows(log) == rows(plain_log) and large
    assert {p.name for p in (tmp_path / "children").iterdir()} == {"conditions", "medications", "allergies"}


def test_measured_in_parts(clinic, specs, tmp_path, large):
    for i, measure in enumerate((pipeline.profile_dataset, pipeline.assess_corrected)):
        assert rows(measure(clinic, specs, staging=f"{tmp_path}/{i}")) == rows(measure(clinic, specs))
        assert len(list((tmp_path / str(i)).iterdir())) > 5


def test_cells_of_large_tables(clinic, specs, tmp_path, large):
    for name in ("patients", "conditions"):
        df = clinic[name]
        told = cells.correction_cells(df, name, specs[name].fixes, f"{tmp_path}/{name}")
        plain = cells.correction_cells(df, name, specs[name].fixes)
        assert rows(told) == rows(plain) and (tmp_path / name / "filled").exists()


def test_cells_with_many_columns(spark):
    names = [f"c{i}" for i in range(130)]
    df = spark.createDataFrame([tuple(None if i in (0, 61, 62, 129) else "v" for i in range(130))] * 2, ", ".join(f"{n} string" for n in names))
    found = cells.correction_cells(df, "t", []).collect()
    assert sorted(r["column"] for r in found) == ["c0", "c129", "c61", "c62"] and {r["rows"] for r in found} == {2}


def test_steps_are_counted_by_the_text_of_a_row(spark):
    """Digests travel as bytes; texts that are none are still told apart."""
    digest = "004a" * 16
    texts = [digest, digest.upper(), "\x00J" * 16, "x", None]
    df = spark.createDataFrame([("t", "s", t, 10**i) for i, t in enumerate(texts) for _ in range(2)], "table_name string, step string, row string, rows long")
    assert [r["error_count"] for r in cells.cells_per_step(df).collect()] == [11111]


def test_stored_tables_do_not_keep_their_lines(spark, monkeypatch, tmp_path, large):
    monkeypatch.setattr(star, "folder", lambda _, made=iter("abcdefgh"): str(tmp_path / next(made)))
    got = star.stored(spark, SMALL)
    assert tables(got) == tables(star.dirty(spark, SMALL)) and {p.name for p in tmp_path.glob("*/*")} == set(got)


def test_cells_per_step_of_large_tables(spark, large):
    got = rows(history_queries.correction_cells_per_step(spark, SMALL))
    sinks.LARGE = 2**40
    assert got == rows(history_queries.correction_cells_per_step(spark, SMALL))
