"""Raw text tables with broken records: good rows apart from broken ones, both counted while they are staged.

A record is broken if its line is no JSON object, or has more or fewer values than the table has
columns.  The raw files are read once: rows go to the folder of good or of broken ones,
each with the file it came from, and the write itself counts them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemend.constants import CHECKED
from tablemend.functions.columns import quoted
from tablemend.operators.metrics import metric_rows
from tablemend.sources.readers import read_csv, read_json

RECORD, FILE, BROKEN = "_corrupt_record", "__file", "__broken"


@dataclass(frozen=True)
class Scan:
    """``rows`` has the table's columns; ``broken`` file and record of every line that is none; ``good`` and ``bad`` count them."""

    table: str
    rows: DataFrame
    broken: DataFrame
    files: DataFrame
    good: int
    bad: int

    def metrics(self, dimension: str = "6V") -> DataFrame:
        """The share of broken records among all."""
        n = self.good + self.bad
        share = (self.bad * 20_000 + n) // (2 * n) / 100 if n else 0.0
        spark = self.rows.sparkSession
        return metric_rows(spark, [(self.table, dimension, "Broken_Records", "records that cannot be read", self.bad, n, share, CHECKED)])

    def by_file(self) -> DataFrame:
        """file_name, good, bad: the records of each file that has any."""
        name = F.element_at(F.split(FILE, "/"), -1)
        return self.files.groupBy(name.alias("file_name")).agg(
            F.count_if(~F.col(BROKEN)).alias("good"), F.count_if(F.col(BROKEN)).alias("bad"))


def raw(
    spark: SparkSession, path: str | list[str], fmt: str, schema: T.StructType | None = None, header: bool = True
) -> DataFrame:
    """The records of CSV or JSON files as text columns, the line of a broken one in ``RECORD``, and ``FILE``.

    A CSV schema names the columns in the order of the files, whose first lines are skipped if they are a ``header``;
    without a schema the first file's header names them."""
    if fmt not in ("csv", "json"):
        raise ValueError(f"broken records are told apart in csv and json files, not in {fmt!r}")
    if schema is None:
        found = read_csv(spark, path) if fmt == "csv" else read_json(spark, path)
        schema = T.StructType([f for f in found.schema if f.name != RECORD])
    wide = T.StructType([*schema.fields, T.StructField(RECORD, T.StringType())])
    reader = spark.read.schema(wide).options(mode="PERMISSIVE", columnNameOfCorruptRecord=RECORD)
    rows = reader.option("header", header).csv(path) if fmt == "csv" else reader.json(path)
    return rows.select(*[F.col(quoted(c)) for c in wide.names], F.col("_metadata.file_path").alias(FILE))


def scan(
    spark: SparkSession, path: str | list[str], fmt: str, table: str, folder: str, schema: T.StructType | None = None,
    header: bool = True,
) -> Scan:
    """Read raw files once, split their records and stage them under ``folder``."""
    records = raw(spark, path, fmt, schema, header)
    names = [c for c in records.columns if c not in (RECORD, FILE)]
    split = records.withColumn(BROKEN, F.col(RECORD).isNotNull())
    counts = Observation(f"records of {table}")
    counted = split.observe(counts, F.count_if(~F.col(BROKEN)).alias("good"), F.count_if(F.col(BROKEN)).alias("bad"))
    counted.write.mode("overwrite").partitionBy(BROKEN).parquet(folder)
    seen = counts.get
    staged = spark.read.schema(split.schema).parquet(folder)
    return Scan(
        table,
        rows=staged.filter(~F.col(BROKEN)).select(*[F.col(quoted(c)) for c in names]),
        broken=staged.filter(F.col(BROKEN)).select(F.element_at(F.split(FILE, "/"), -1).alias("file_name"), F.col(RECORD).alias("record")),
        files=staged.select(FILE, BROKEN),
        good=seen.get("good", 0), bad=seen.get("bad", 0),
    )
