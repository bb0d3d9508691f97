"""Shards by jump consistent hashing, without a table of the ring.

A document's key and the number of shards decide its shard; with one more shard
the moved documents all go into the new one, about 1 in n + 1 of them.

Null ids share one shard (they have the same key), a null text counts as empty,
repeated rows share a shard and get numbers of their own, an empty table gives
no rows.  Columns besides ``doc_id`` and ``text`` may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemend.llm.common import number_rows, stage

#: Bytes that a document takes besides its text.
OVERHEAD = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key."""
    key = keys.astype(np.uint64, copy=True)
    shard, following = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    going = np.arange(len(key))
    while len(going):
        shard[going] = following[going]
        key[going] = key[going] * np.uint64(2862933555777941757) + np.uint64(1)
        spread = (key[going] >> np.uint64(33)).astype(np.float64) + 1
        following[going] = np.floor((shard[going] + 1) * (float(1 << 31) / spread)).astype(np.int64)
        going = going[following[going] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """The shard of each row; ``key`` is any column of scattered 64-bit numbers."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return place(key)


def assign(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard (with one shard more), slot (0, 1, … in the shard)."""
    text = F.coalesce(docs["text"], F.lit(""))
    key = F.xxhash64(docs["doc_id"])
    placed = stage(docs.select(
        docs["doc_id"].alias("doc_id"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        shard_of(key, shards).alias("shard"),
        shard_of(key, shards + 1).alias("grown_shard"),
    ), "shards")
    return number_rows(placed, ["shard"], ["doc_id", "text_crc32", "size"], "slot")


def write(docs: DataFrame, path: str, shards: int, tasks_per_shard: int = 8) -> None:
    """Whole documents as Parquet, one folder a shard; several tasks write each shard."""
    if "shard" in (c.lower() for c in docs.columns):
        raise ValueError("the documents have a column named shard already")
    part = F.pmod(F.xxhash64(*[docs[c] for c in docs.columns]), F.lit(tasks_per_shard))
    placed = docs.withColumn("shard", shard_of(F.xxhash64(docs["doc_id"]), shards)).withColumn("__part", part)
    placed.repartition("shard", "__part").drop("__part").write.partitionBy("shard").parquet(path)
