"""Files that no writer of Spark makes: named part files, broken ones, and commits of a Delta log."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def _system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A file with this text."""
    where, system = _system(spark, path)
    out = system.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def put_part(df: DataFrame, folder: str, name: str) -> str:
    """``df`` as one Parquet file ``name`` in a folder."""
    spark, aside = df.sparkSession, f"{folder}/_aside_{name}"
    df.coalesce(1).write.parquet(aside)
    where, system = _system(spark, aside)
    part = next(s.getPath() for s in system.listStatus(where) if s.getPath().getName().startswith("part-"))
    target, _ = _system(spark, f"{folder}/{name}")
    system.mkdirs(target.getParent())
    system.rename(part, target)
    return name


def commit(spark: SparkSession, table: str, version: int, *actions: dict) -> None:
    lines = "".join(json.dumps(a) + "\n" for a in actions)
    put_text(spark, f"{table}/_delta_log/{version:020d}.json", lines)


def described(df: DataFrame, partitions: list[str] | None = None) -> list[dict]:
    """The actions with which a log begins."""
    meta = {"id": "t", "format": {"provider": "parquet", "options": {}}, "schemaString": df.schema.json(),
            "partitionColumns": partitions or [], "configuration": {}}
    return [{"protocol": {"minReaderVersion": 1, "minWriterVersion": 2}}, {"metaData": meta}]


def added(name: str, **partition: str) -> dict:
    return {"add": {"path": name, "partitionValues": partition, "size": 1, "modificationTime": 0, "dataChange": True}}


def removed(name: str) -> dict:
    return {"remove": {"path": name, "deletionTimestamp": 0, "dataChange": True}}
