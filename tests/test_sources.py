import pytest
from pyspark.sql import functions as F

from tablemend.sources import metric_store as M
from tablemend.sources import readers as R
from tablemend.sources import sinks as K
from tablemend.sources.discovery import discover
from tablemend.operators.metrics import metric_rows
from tablemend.plans import synthea


@pytest.fixture
def table(spark):
    return spark.createDataFrame([("1", " a ", None), ("2", "ā,\"q\"", None)], "id string, t string, e string")


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_round_trip(spark, table, tmp_path, fmt):
    path = str(tmp_path / "t")
    K.write_table(table, path, fmt)
    back = R.read_table(spark, path, fmt, table.schema)
    assert content(back.select(*table.columns)) == content(table)


def test_json_without_schema_keeps_columns_and_text(spark, table, tmp_path):
    K.write_table(table.withColumn("n", F.lit(1)), str(tmp_path / "t"), "json")
    back = R.read_json(spark, str(tmp_path / "t"))
    assert sorted(back.dtypes) == [("e", "string"), ("id", "string"), ("n", "string"), ("t", "string")]
    assert content(back.select("id", "t", "e")) == content(table)


def test_text_and_delta_files(spark, table, tmp_path):
    table.select("id").write.text(str(tmp_path / "x"))
    assert content(R.read_text(spark, str(tmp_path / "x"))) == [("1",), ("2",)]
    table.write.parquet(str(tmp_path / "d"))
    (tmp_path / "d" / "_delta_log").mkdir()
    assert R.read_table(spark, str(tmp_path / "d"), "delta").count() == 2


def test_avro_needs_its_package(spark, table, tmp_path):
    try:
        K.write_table(table, str(tmp_path / "a"), "avro")
    except R.FormatUnavailable as error:
        assert "avro" in str(error)
    else:
        assert R.read_avro(spark, str(tmp_path / "a")).count() == 2


def test_unknown_formats(spark, table, tmp_path):
    with pytest.raises(ValueError):
        R.read_table(spark, "x", "xml")
    with pytest.raises(ValueError):
        K.write_table(table, str(tmp_path / "x"), "delta")


def test_discovery_by_format_folder(spark, table, tmp_path):
    K.write_corrupted({"patients": table, "encounters": table, "third": table}, str(tmp_path), ["json", "csv"])
    (tmp_path / "broken_corrupted" / "parquet").mkdir(parents=True)
    (tmp_path / "broken_corrupted" / "parquet" / "x.parquet").write_text("not parquet")
    (tmp_path / "loose.txt").write_text("x")
    ds = discover(spark, str(tmp_path), schemas={"patients": table.schema, "third": table.schema})
    assert set(ds) == {"patients", "encounters", "third"}
    for df in ds.values():
        assert content(df.select(*table.columns)) == content(table)


def test_discovery_of_files_and_parts(spark, table, tmp_path):
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "Patients.csv").write_text("Id,NAME\n1,x\n")
    (tmp_path / "flat" / "notes.txt").write_text("x")
    ds = discover(spark, str(tmp_path / "flat"), "files")
    assert list(ds) == ["patients"] and ds["patients"].columns == ["Id", "NAME"]
    K.write_table(table, str(tmp_path / "parts" / "a"), "csv")
    K.write_table(table, str(tmp_path / "parts" / "b"), "parquet")
    K.write_table(table.filter("1 = 0"), str(tmp_path / "parts" / "c"), "parquet")
    (tmp_path / "parts" / "d").mkdir()
    assert set(discover(spark, str(tmp_path / "parts"), "parts")) == {"a", "b", "c"}
    assert set(discover(spark, str(tmp_path / "parts"), "parts", skip_empty=True)) == {"a", "b"}


def test_discovery_of_nothing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        discover(spark, str(tmp_path / "none"))
    (tmp_path / "file").write_text("x")
    with pytest.raises(NotADirectoryError):
        discover(spark, str(tmp_path / "file"))


def test_write_dataset_isolates_failures(spark, table, tmp_path):
    (tmp_path / "bad").write_text("a file where a folder should go")
    broken = table.withColumn("x", F.raise_error(F.lit("boom")).cast("string"))
    rows = {r.table_name: r for r in K.write_dataset({"good": table, "broken": broken}, str(tmp_path / "out")).collect()}
    assert (rows["good"].rule_name, rows["good"].error_count, rows["good"].total_count) == ("Data_Saved_HDFS", 0, 2)
    assert (rows["broken"].rule_name, rows["broken"].error_count) == ("Data_Save_Failed", 1)


def test_lineage_is_cut_in_the_shared_folder(spark, table):
    assert K.shared_folder(spark)
    cut = K.cut_lineage(table)
    assert content(cut) == content(table)
    assert "Scan ExistingRDD" in cut._jdf.queryExecution().toString()


def test_staging(spark, table, tmp_path):
    staged = K.stage_dataset({"t": table}, str(tmp_path))
    assert content(staged["t"]) == content(table)


def test_json_export(spark, table, tmp_path):
    K.export_json(table, str(tmp_path / "j"))
    assert '"e":null' in spark.read.text(str(tmp_path / "j")).first()[0]
    assert '"e":null' in K.as_json(table).first()[0]


def test_sample_is_bounded(table):
    assert K.offending_sample(table, F.col("e").isNull(), ["id"], 1).count() == 1


@pytest.fixture
def metrics(spark):
    row = ("t", "d", "r", "x", 1, 4, 25.0, "checked")
    nameless = ("t", "d", None, "x", 1, 4, 25.0, "checked")
    return metric_rows(spark, [row, row, nameless, nameless, ("t", "d", "s", "x", 0, 0, 0.0, "skipped")])


def test_metric_store(spark, metrics, tmp_path):
    assert M.distinct_metrics(metrics).count() == 4  # a NULL never equals another
    M.write_metrics(metrics, str(tmp_path / "m"))
    M.write_metrics(metrics, str(tmp_path / "m"))
    stored = M.read_metrics(spark, str(tmp_path / "m"))
    assert sorted(r.id for r in stored.collect()) == [1, 2, 3, 4]
    assert stored.filter("checked_at is null").count() == 0
    assert M.without_skipped(stored).count() == 3


def test_metric_store_needs_a_driver_for_jdbc(spark, metrics):
    url, properties = "jdbc:nothing://nowhere/db", {"driver": "no.such.Driver"}
    with pytest.raises(Exception, match="no.such.Driver"):
        M.write_metrics_jdbc(metrics, url, "t", properties)
    with pytest.raises(Exception, match="no.such.Driver"):
        M.read_metrics_jdbc(spark, url, "t", properties)


def test_text_schema():
    assert {f.dataType.simpleString() for f in R.text_schema(synthea.schema("patients"))} == {"string"}
