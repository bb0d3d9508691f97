"""Find the tables of a dataset by the layout of its folders.

Only names are listed on the driver, through the file system of the path
(local, HDFS, object store); the data itself is opened by Spark.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tablemend.model import Dataset
from tablemend.sources.readers import FORMATS, read_table

log = logging.getLogger(__name__)

CORRUPTED_SUFFIX = "_corrupted"


def list_folder(spark: SparkSession, path: str) -> list[tuple[str, str, bool]]:
    """(name, full path, is folder) of the entries of ``path``, in listing order."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        raise FileNotFoundError(path)
    if not fs.getFileStatus(hadoop_path).isDirectory():
        raise NotADirectoryError(path)
    return [
        (s.getPath().getName(), s.getPath().toString(), bool(s.isDirectory()))
        for s in fs.listStatus(hadoop_path)
    ]


def discover(
    spark: SparkSession,
    base: str,
    layout: str = "formats",
    schemas: Mapping[str, T.StructType] | None = None,
    skip_empty: bool = False,
) -> Dataset:
    """The tables under ``base``.

    ``formats``: ``<base>/<table>[_corrupted]/<format>/``; the first format that opens wins.
    ``files``:   ``<base>/<table>.csv``.
    ``parts``:   ``<base>/<table>/part-*.<format>``; the first data file tells the format.

    A table that does not open is left out with a warning, and so is one without
    rows if ``skip_empty`` is set.  ``schemas`` (by table) are given to JSON reads.
    """
    finders = {"formats": _by_format_folder, "files": _by_file, "parts": _by_part_files}
    schemas = schemas or {}
    found: Dataset = {}
    folders: dict[str, str] = {}
    for table, path, fmt in finders[layout](spark, base):
        folder = path.rsplit("/", 1)[0] if layout == "formats" else path
        if table in found:
            if folder != folders[table]:
                raise ValueError(f"table {table} is in two folders, {folders[table]} and {folder}")
            continue
        df = _open(spark, table, path, fmt, schemas.get(table), skip_empty)
        if df is not None:
            found[table] = df
            folders[table] = folder
    return found


def _open(
    spark: SparkSession, table: str, path: str, fmt: str, schema: T.StructType | None, skip_empty: bool
) -> DataFrame | None:
    try:
        df = read_table(spark, path, fmt, schema)
        if skip_empty and df.isEmpty():
            log.warning("table %s: no rows in %s", table, path)
            return None
        return df
    except Exception as error:  # one unreadable table must not hide the others
        log.warning("table %s: cannot read %s as %s: %s", table, path, fmt, error)
        return None


def _by_format_folder(spark: SparkSession, base: str) -> Iterator[tuple[str, str, str]]:
    for name, path, is_folder in list_folder(spark, base):
        if is_folder:
            table = name.replace(CORRUPTED_SUFFIX, "")
            for inner, inner_path, _ in list_folder(spark, path):
                if inner.lower() in FORMATS:
                    yield table, inner_path, inner.lower()


def _by_file(spark: SparkSession, base: str) -> Iterator[tuple[str, str, str]]:
    for name, path, _ in list_folder(spark, base):
        if name.lower().endswith(".csv"):
            yield name[: -len(".csv")].lower(), path, "csv"


def _by_part_files(spark: SparkSession, base: str) -> Iterator[tuple[str, str, str]]:
    for name, path, is_folder in list_folder(spark, base):
        if is_folder:
            table = name.replace(CORRUPTED_SUFFIX, "")
            seen = set()
            for inner, _, inner_is_folder in list_folder(spark, path):
                fmt = inner.rsplit(".", 1)[-1].lower()
                hidden = inner.startswith(("_", "."))
                if not hidden and not inner_is_folder and fmt in FORMATS and fmt not in seen:
                    seen.add(fmt)
                    yield table, path, fmt
