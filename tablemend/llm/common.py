"""What several operators need: written intermediate tables and gapless numbers."""

from __future__ import annotations

import math
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space and its complement, as the words and line keys of all operators see them.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_own_folder: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, unless PYTHONPATH gives it to them already."""
    root = Path(__file__).resolve().parents[2]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        folder = Path(tempfile.mkdtemp(prefix="tablemend-code-"))  # on the driver, which serves it to the executors
        with zipfile.ZipFile(folder / "tablemend_code.zip", "w") as archive:
            for file in sorted((root / "tablemend").rglob("*.py")):
                archive.write(file, file.relative_to(root))
        spark.sparkContext.addPyFile(str(folder / "tablemend_code.zip"))
        _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    return _own_folder.setdefault(app, tempfile.mkdtemp(prefix="tablemend-"))


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back.

    The plan ends there: what follows reads files that survive lost executors,
    and values that differ between two runs of a task are fixed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def uniform(*parts: Column) -> Column:
    """A number inside (0, 1) that depends on the given columns alone."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 12).cast("double") + 0.5) / float(1 << 52)


def number_rows(staged: DataFrame, group: list[str], order: list[str], into: str) -> DataFrame:
    """Adds ``into``: 0, 1, 2 … inside each group, without a gap.

    A group is cut into slices by a hash of the ``order`` columns, so that one
    with a third of all rows is spread over many tasks; the slices' counts give
    where each one begins.  Slices hold about as many rows as there are slices
    (the root of the table), so neither grows with the whole table.  ``staged``
    must give the same rows whenever it is read.
    """
    total = staged.count()
    slices = max(1, math.ceil(total / max(500, math.isqrt(total))))
    cut = staged.withColumn("__slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    keys = [*group, "__slice"]
    counts = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*keys).orderBy(*order)
    numbered = cut.withColumn("__row", F.row_number().over(inside) - 1)
    same = [numbered[k].eqNullSafe(starts[k]) for k in keys]
    joined = numbered.join(starts, same, "left")
    return joined.select(*[numbered[c] for c in staged.columns], (F.col("__start") + F.col("__row")).alias(into))
