"""Writing tables, staging intermediate ones, exporting small results."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from itertools import cycle

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablemend.constants import CHECKED
from tablemend.model import METRIC_SCHEMA, Dataset
from tablemend.operators.metrics import union_all
from tablemend.sources.readers import FORMATS, FormatUnavailable

# The order in which the injection run cycles through its output formats.
FORMAT_CYCLE = ("avro", "json", "csv", "parquet")
# Bytes of its sources from which a table is worked on by itself and written between its shuffles: these take about twenty times as much.
LARGE = 2**29
_DROP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Overwrite ``path``.

    CSV gets a header line and keeps blanks around values; JSON keeps NULL fields,
    so that a column without any value is still there when it is read back.
    """
    if fmt not in FORMATS or fmt == "delta":
        raise ValueError(f"cannot write {fmt!r}, expected csv, json, parquet or avro")
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    elif fmt == "json":
        writer = writer.option("ignoreNullFields", False)
    try:
        writer.format(fmt).save(path)
    except Exception as error:
        if fmt == "avro" and "data source" in str(error).lower():
            raise FormatUnavailable("avro needs the spark-avro package") from error
        raise


def observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df``, and where the number of its rows can be read once an action on it has run.

    To be put right before a write, so that no row is counted that a later step repeats."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def write_dataset(ds: Mapping[str, DataFrame], base: str, fmt: str = "csv") -> DataFrame:
    """Write every table to ``<base>/<table>`` and report each as a ``15DS`` metric.

    A table that fails is reported with the reason and does not stop the others.
    The total of the metric is what the write itself counted: nothing is read again.
    """
    spark = next(iter(ds.values())).sparkSession
    rows: list[tuple] = []
    for name, df in ds.items():
        path = f"{base.rstrip('/')}/{name}"
        try:
            counted, seen = observed(df)
            write_table(counted, path, fmt)
            rows.append((name, "15DS", "Data_Saved_HDFS", f"written as {fmt} to {path}", 0, seen.get.get("n", 0), 0.0, CHECKED))
        except Exception as error:
            reason = str(error).strip()
            rows.append((name, "15DS", "Data_Save_Failed", f"write to {path} failed: {reason}", 1, 1, 100.0, CHECKED))
    return spark.createDataFrame(rows, METRIC_SCHEMA)


def write_corrupted(
    ds: Mapping[str, DataFrame], base: str, formats: Sequence[str] = FORMAT_CYCLE
) -> dict[str, str]:
    """Write table after table to ``<base>/<table>_corrupted/<format>``, cycling the formats."""
    written = {}
    for (name, df), fmt in zip(ds.items(), cycle(formats)):
        path = f"{base.rstrip('/')}/{name}_corrupted/{fmt}"
        write_table(df, path, fmt)
        written[name] = path
    return written


def export_json(df: DataFrame, path: str) -> None:
    """A metric or report table as JSON lines; NULL fields are written out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def as_json(df: DataFrame) -> DataFrame:
    """The rows as one JSON text each."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def offending_sample(df: DataFrame, bad: Column, columns: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` values, in order, of the rows that ``bad`` finds."""
    return df.filter(bad).select(*columns).orderBy(*columns).limit(n)


_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the checkpoint folder of the session.

    A local session without one gets a folder of its own; a cluster must name one.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("no checkpoint folder: set spark.checkpoint.dir to a folder that all executors share")
    own = _own_folder.setdefault(context.applicationId, tempfile.mkdtemp(prefix="tablemend-"))
    context.setCheckpointDir(own)
    return own


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of ``df`` without its history, kept in the shared checkpoint folder.

    The copy is a reliable one: losing an executor loses no row of it.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """A write inside drops the files of its shuffles when it ends; otherwise they stay until the driver collects garbage."""
    before = spark.conf.get(_DROP, None)
    spark.conf.set(_DROP, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP, before) if before is not None else spark.conf.unset(_DROP)


def source_bytes(df: DataFrame) -> int:
    """Spark's estimate of all that ``df`` reads; what is read twice counts twice, and what has no known size does not count."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    unknown = df.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(size for size in sizes if size < unknown)


def is_large(*sources: DataFrame) -> bool:
    return sum(map(source_bytes, sources)) > LARGE


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that was written here and that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Steps:
    """The rows of one table between the shuffles of its repair.

    Those of a large table are written, so that the files of a shuffle are gone before the next one; of the
    written rows only the last are kept.  Rows that were not shuffled, and small tables, pass as they are.
    """

    def __init__(self, folder: str, source: DataFrame):
        self.spark, self.folder = source.sparkSession, folder.rstrip("/")
        self.large = is_large(source)
        self._written: list[str] = []

    def cut(self, df: DataFrame) -> DataFrame:
        if not self.large or "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString():
            return df
        name = str(len(self._written))
        rows = stage_dataset({name: df}, self.folder, codec="zstd")[name]
        if self._written:
            remove(self.spark, self._written[-1])
        self._written.append(f"{self.folder}/{name}")
        return rows

    @property
    def used(self) -> bool:
        return bool(self._written)

    def close(self) -> None:
        """To be called when no more rows are read from here."""
        if self._written:
            remove(self.spark, self.folder)


def stage_in_steps(ds: Dataset, base: str, build: Callable[[str, DataFrame, Steps], DataFrame]) -> Dataset:
    """The tables that ``build`` makes of ``ds``, written under ``base``: large ones one after the other, in their steps."""
    base, small, out = base.rstrip("/"), {}, {}
    for name, df in ds.items():
        steps = Steps(f"{base}-steps/{name}", df)
        rows = build(name, df, steps)
        if steps.large:
            out |= stage_dataset({name: rows}, base)
            steps.close()
        else:
            small[name] = rows
    out |= stage_dataset(small, base)
    return {name: out[name] for name in ds}


def stage_parts(parts: Sequence[DataFrame], base: str) -> DataFrame:
    """The rows of all ``parts``; if these read much, each that does is written, one after the other, and read back."""
    if not is_large(*parts):
        return union_all(parts)
    large = {str(i): p for i, p in enumerate(parts) if is_large(p)}
    written = stage_dataset(large, base, at_once=1)
    return union_all(written.get(str(i), p) for i, p in enumerate(parts))


def stage_dataset(ds: Dataset, base: str, at_once: int | None = None, codec: str | None = None) -> Dataset:
    """Write every table as Parquet under ``base`` and continue from the written tables."""
    return stage_counted(ds, base, at_once, codec)[0]


def stage_counted(
    ds: Dataset, base: str, at_once: int | None = None, codec: str | None = None
) -> tuple[Dataset, dict[str, int]]:
    """The same, with the number of rows that each write has counted.

    The writes are independent jobs; a few run at once, so that the last tasks of one do not leave the cluster
    idle.  Large tables are written one after the other, so that the shuffles of one are gone before the next.
    """
    paths = {name: f"{base.rstrip('/')}/{name}" for name in ds}
    if not ds:
        return {}, {}
    at_once = at_once or (1 if any(map(is_large, ds.values())) else 4)
    counted = {name: observed(df) for name, df in ds.items()}
    with shuffles_dropped(next(iter(ds.values())).sparkSession), ThreadPoolExecutor(at_once) as pool:
        writes = [
            pool.submit(inheritable_thread_target(df.sparkSession)(df.write.mode("overwrite").parquet), paths[name], compression=codec)
            for name, (df, _) in counted.items()
        ]
        for write in writes:
            write.result()
    staged = {name: df.sparkSession.read.parquet(paths[name]) for name, df in ds.items()}
    return staged, {name: seen.get.get("n", 0) for name, (_, seen) in counted.items()}
