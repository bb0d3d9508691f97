"""The table that a Delta directory holds, from its transaction log: no package needed.

The log is replayed as a query.  Every action on a file carries the version it came with; the last
action per path decides, and the table is the files whose last action added them.  A checkpoint stands for all
versions up to its own.  File names are metadata: the driver gets them as it does for any listing of a folder.

Tables that need more than the log's first reader version (deletion vectors, mapped columns) are refused.
"""

from __future__ import annotations

import json
import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemend.sources.discovery import list_folder
from tablemend.sources.readers import FormatUnavailable

LOG = "_delta_log"
_ACTIONS = (
    "add struct<path:string, deletionVector:struct<storageType:string>>, remove struct<path:string>, "
    "metaData struct<schemaString:string, partitionColumns:array<string>, configuration:map<string,string>>, "
    "protocol struct<minReaderVersion:int>"
)
_KINDS = ("add", "remove", "metaData", "protocol")
_VERSION = r"^(\d{20})"


def is_delta(spark: SparkSession, path: str) -> bool:
    return any(name == LOG and folder for name, _, folder in list_folder(spark, path))


def log_files(spark: SparkSession, path: str, version: int | None = None) -> tuple[list[str], list[str]]:
    """(files of the last checkpoint, commits after it) up to ``version``."""
    listed = list_folder(spark, f"{path.rstrip('/')}/{LOG}")
    found = [(int(m.group(1)), name, full) for name, full, _ in listed if (m := re.match(_VERSION, name))]
    found = [f for f in found if version is None or f[0] <= version]
    checkpoints = [(v, full) for v, name, full in found if ".checkpoint." in name and name.endswith(".parquet")]
    last = max((v for v, _ in checkpoints), default=-1)
    commits = sorted((v, full) for v, name, full in found if re.fullmatch(r"\d{20}\.json", name) and v > last)
    if last < 0 and (not commits or commits[0][0] != 0):
        raise FileNotFoundError(f"{path}: the log has neither a checkpoint nor its first commit")
    expected = list(range(last + 1, last + 1 + len(commits)))
    if [v for v, _ in commits] != expected or (version is not None and last + len(commits) != version):
        raise FileNotFoundError(f"{path}: the log lacks commits of the versions {expected[:1]} to {version}")
    return [full for v, full in checkpoints if v == last], [full for _, full in commits]


def actions(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The log's actions and the version (a checkpoint's for those it stands for)."""
    checkpoint, commits = log_files(spark, path, version)
    number = F.regexp_extract(F.col("_metadata.file_name"), _VERSION, 1).cast("long").alias("version")
    parts = []
    if commits:
        parts.append(spark.read.schema(_ACTIONS).json(commits).select(*_KINDS, number))
    if checkpoint:
        held = spark.read.schema(_ACTIONS).parquet(*checkpoint)
        parts.append(held.select(*_KINDS, number))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def live_files(log: DataFrame) -> DataFrame:
    """path of the files whose last action added them; of one version's two actions on a path the addition counts."""
    each = log.select("version", F.coalesce("add.path", "remove.path").alias("path"), F.col("add.path").isNotNull().alias("added"))
    last = Window.partitionBy("path").orderBy(F.desc("version"), F.desc("added"))
    return each.filter(F.col("path").isNotNull()).withColumn("nth", F.row_number().over(last)).filter("nth = 1 AND added").select("path")


def read_delta(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a Delta directory at ``version`` (None: the last)."""
    path = path.rstrip("/")
    log = actions(spark, path, version)
    told = log.agg(
        F.max_by("metaData", F.when(F.col("metaData").isNotNull(), F.col("version"))).alias("table"),
        F.max("protocol.minReaderVersion").alias("reader"), F.count("add.deletionVector.storageType").alias("vectors"),
    ).first()
    mapped = told["table"] is not None and (told["table"]["configuration"] or {}).get("delta.columnMapping.mode", "none") != "none"
    if told["table"] is None or told["vectors"] or mapped or (told["reader"] or 1) > 2:
        raise FormatUnavailable(f"{path} needs a Delta reader: deletion vectors, mapped columns or an unknown protocol")
    schema = T.StructType.fromJson(json.loads(told["table"]["schemaString"]))
    files = [unquote(r["path"]) for r in live_files(log).collect()]
    if not files:
        return spark.createDataFrame([], schema)
    full = [f if re.match(r"^([A-Za-z][A-Za-z0-9+.-]*:|/)", f) else f"{path}/{f}" for f in files]
    read = spark.read.schema(schema).option("basePath", path).parquet(*sorted(full))
    return read.select(*[F.col(f"`{n}`") for n in schema.names])
