"""Tables in many part files: faults are found per file, and a file that cannot be read does not cost the table.

The folder's files are listed by Spark, without their content; rows carry the file they come from.  A file of the list without
a row, in a scan that skips what it cannot read, is empty or unreadable: which of both, a Parquet
file says in its last bytes, a text file by its length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemend.functions.columns import quoted
from tablemend.operators.metrics import literal, metric, unfold

FILE = "__file"


@dataclass(frozen=True)
class Parts:
    """``rows`` of the readable files with ``__file``; ``files`` (file_name, bytes): all of them."""

    table: str
    rows: DataFrame
    files: DataFrame

    def table_rows(self) -> DataFrame:
        return self.rows.drop(FILE)

    def counts(self) -> DataFrame:
        """file_name, n_rows, bytes of every file, 0 rows for one without any."""
        # The digest makes the scan read every column: a file may be unreadable in one of them.
        digest = F.bit_xor(F.xxhash64(*[F.col(quoted(c)).cast("string") for c in self.rows.columns if c != FILE]))
        name = F.element_at(F.split(FILE, "/"), -1).alias("__name")
        per_file = self.rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"), digest.alias("d")).select(
            "__name", F.when(F.col("d").isNotNull(), F.col("n")).alias("n_rows"))
        met = self.files.join(per_file, F.col("file_name") == F.col("__name"), "left")
        return met.select("file_name", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "bytes")

    def metrics(self, dimension: str = "6V") -> DataFrame:
        """A row per file without rows, and one for the table: files without rows of all files."""
        counts = self.counts()
        table = unfold(
            counts.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_rows") == 0).alias("e")),
            [metric(self.table, dimension, "Part_Files", "files without a readable row", "e", "n")])
        bad = counts.filter("n_rows = 0")
        each = unfold(bad, [metric(self.table, dimension, "Part_File", "", "1", "1")])
        # The description names the file, so it is no literal.
        named = bad.select(
            F.expr(literal(self.table)).alias("table_name"), F.lit(dimension).alias("quality_dimension"), F.lit("Part_File").alias("rule_name"),
            F.concat(F.lit("no readable row in "), F.col("file_name")).alias("issue_description"),
            F.lit(1).cast("long").alias("error_count"), F.lit(1).cast("long").alias("total_count"), F.lit(100.0).alias("error_percentage"),
            F.lit("failed").alias("status"))
        return table.unionByName(named.select(*each.columns))


def read_parts(spark: SparkSession, path: str, fmt: str, table: str, schema: T.StructType) -> Parts:
    """The part files of a table with the declared columns; whatever cannot be read as those is left out.

    A file without a declared column gives NULL there; one whose column has another type is unreadable (Parquet)."""
    if fmt not in ("csv", "json", "parquet"):
        raise ValueError(f"part files are csv, json or parquet, not {fmt!r}")
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", True).option("pathGlobFilter", f"*.{fmt}")
    rows = reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path) if fmt == "json" else reader.parquet(path)
    rows = rows.select(*[F.col(quoted(c)) for c in schema.names], F.col("_metadata.file_path").alias(FILE))
    listed = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{fmt}").load(path)
    files = listed.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("bytes"))
    return Parts(table, rows, files)
