"""One table from one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("csv", "json", "parquet", "avro", "delta")


class FormatUnavailable(RuntimeError):
    """The format needs a package that this session does not have."""


def text_schema(schema: T.StructType) -> T.StructType:
    """The same columns as plain nullable text, the form in which raw files are read."""
    return T.StructType([T.StructField(f.name, T.StringType()) for f in schema])


def read_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with a header; every column stays text, so no pass is spent on inferring types."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_json(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """JSON lines.  A schema saves the pass that finds the columns, but must spell them as the file does.

    Without one, every value is read as text, as from CSV.
    """
    reader = spark.read.option("mode", "PERMISSIVE")
    if schema is not None:
        return reader.schema(schema).json(path)
    return reader.option("primitivesAsString", True).json(path)


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def read_avro(spark: SparkSession, path: str | list[str]) -> DataFrame:
    try:
        return spark.read.format("avro").load(path)
    except Exception as error:
        if "avro" in str(error).lower() and "data source" in str(error).lower():
            raise FormatUnavailable(
                "avro needs the spark-avro package: start Spark with "
                "--packages org.apache.spark:spark-avro_2.13:<your Spark version>"
            ) from error
        raise


def read_delta_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The Parquet files of a Delta directory.

    The transaction log is not consulted: files that a later commit removed are read too.
    ``delta_log.read_delta`` reads the live ones only.
    """
    return read_parquet(spark, path)


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path)


def read_table(
    spark: SparkSession, path: str | list[str], fmt: str, schema: T.StructType | None = None
) -> DataFrame:
    if fmt == "csv":
        return read_csv(spark, path)
    if fmt == "json":
        return read_json(spark, path, schema)
    if fmt == "parquet":
        return read_parquet(spark, path)
    if fmt == "avro":
        return read_avro(spark, path)
    if fmt == "delta":
        return read_delta_files(spark, path)
    if fmt == "text":
        return read_text(spark, path)
    raise ValueError(f"unknown format {fmt!r}, expected one of {(*FORMATS, 'text')}")
