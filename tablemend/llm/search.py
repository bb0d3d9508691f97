"""What both searches share: equal vectors as one, blocks of queries against blocks of rows, the merge.

Every query block meets every row block in a task of its own (:func:`search`), and a
task returns the best rows per query; nothing else leaves it.  Equal vectors are one row with
their ``k + 1`` smallest ids, since ties go to smaller ids and a query excludes itself only;
so a vector with a third of all rows takes part once.

Rows without an id, vectors of another length than the most frequent one, and vectors that the caller's filter rejects, take no part; rows that
repeat id and vector are one row.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemend.llm.common import stage

ROWS_PER_BLOCK, QUERIES_PER_BLOCK = 16_384, 2_048


def distinct_vectors(vectors: DataFrame, k: int) -> DataFrame:
    """gid, vec, ids: the distinct vectors of (vec_id, vec) with their k + 1 smallest ids; gid is the smallest."""
    each = vectors.filter(F.col("vec_id").isNotNull()).select("vec_id", "vec").distinct()
    # The engine cuts groups to k + 1 rows before it shuffles them.
    nth = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = each.withColumn("__nth", nth).filter(F.col("__nth") <= k + 1)
    grouped = few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return grouped.select(F.element_at("ids", 1).alias("gid"), "vec", "ids")


def of_one_length(vectors: DataFrame) -> DataFrame:
    """The vectors of the most frequent length, of equally frequent ones the longest."""
    lengths = vectors.groupBy(F.size("vec").alias("n")).count().orderBy(F.col("count").desc(), F.col("n").desc())
    usual = lengths.first()
    return vectors if usual is None else vectors.filter(F.size("vec") == usual["n"])


def matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """A list column of equally long lists."""
    array = column.combine_chunks()
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(array), -1) if len(array) else np.zeros((0, 0), dtype)


def search(rows: DataFrame, asked: DataFrame, k: int, best: Callable, score_type: str) -> DataFrame:
    """gid, vec_id, score: the k + 1 best rows of each asked vector.

    ``rows`` and ``asked`` are staged tables (gid, vec, ids); ``best(queries, vectors)`` takes
    two matrices and returns (query, row, score) of all pairs that may belong to the best
    k + 1 rows of the block.
    """
    blocks = max(1, math.ceil(rows.count() / ROWS_PER_BLOCK))
    ask_blocks = max(1, math.ceil(asked.count() / QUERIES_PER_BLOCK))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = rows.withColumn("block", F.pmod(F.xxhash64("gid"), F.lit(blocks)).cast("int")).withColumn("asking", each(ask_blocks))
    left = asked.withColumn("asking", F.pmod(F.xxhash64("gid"), F.lit(ask_blocks)).cast("int")).withColumn("block", each(blocks))
    numbers = pa.int64() if score_type == "long" else pa.float64()

    def compare(queries: pa.Table, table: pa.Table) -> pa.Table:
        names, gids, out = ["gid", "vec_id", "score"], [], []
        if queries.num_rows and table.num_rows:
            kind = np.int64 if score_type == "long" else np.float64
            q, x = matrix(queries["vec"], kind), matrix(table["vec"], kind)
            ids = table["ids"].combine_chunks()
            first, every = ids.offsets.to_numpy(), ids.values.to_numpy()
            asked_id = queries["gid"].to_numpy()
            for who, row, score in best(q, x):
                # Each equal vector stands for its smallest ids.
                n = first[row + 1] - first[row]
                who, score = np.repeat(who, n), np.repeat(score, n)
                vec_id = every[np.repeat(first[row], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                order = np.lexsort((vec_id, -score, who))
                who, score, vec_id = who[order], score[order], vec_id[order]
                place = np.arange(len(who)) - np.searchsorted(who, who)
                keep = place <= k
                gids.append(asked_id[who[keep]])
                out.append((vec_id[keep], score[keep]))
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        columns = [pa.array(cat(gids, np.int64), pa.int64()), pa.array(cat([v for v, _ in out], np.int64), pa.int64()),
                   pa.array(cat([s for _, s in out], np.int64), numbers)]
        return pa.Table.from_arrays(columns, names)

    found = left.groupBy("asking", "block").cogroup(right.groupBy("asking", "block")).applyInArrow(
        compare, f"gid long, vec_id long, score {score_type}")
    order = Window.partitionBy("gid").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("__nth", F.row_number().over(order)).filter(F.col("__nth") <= k + 1).drop("__nth")


def answers(found: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score for ``queries`` (query_id, gid): the best rows without the query's own."""
    q = queries.withColumnRenamed("gid", "__gid")
    others = found.join(q, found["gid"] == q["__gid"]).filter(F.col("vec_id") != F.col("query_id"))
    # A query may come with several vectors; each is answered for itself.
    order = Window.partitionBy("query_id", "gid").orderBy(F.col("score").desc(), "vec_id")
    ranked = others.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def prepared(vectors: DataFrame, every: int, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(distinct vectors, those asked for, query_id and gid of the queries), staged.

    Queries are the rows whose id is divisible by ``every``."""
    vectors = of_one_length(vectors)
    rows = stage(distinct_vectors(vectors, k), "vectors")
    mine = vectors.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("__vec"))
    queries = mine.distinct().join(rows, F.col("__vec") == F.col("vec"))
    queries = stage(queries.select("query_id", "gid"), "queries")
    asked = stage(rows.join(queries.select("gid").distinct(), "gid", "left_semi").select("gid", "vec"), "asked")
    return rows, asked, queries
