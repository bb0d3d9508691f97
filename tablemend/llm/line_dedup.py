"""Reversible line deduplication: exact reference counts behind sharded cuckoo filters.

A :class:`LineStore` holds three tables:

* ``refs``: one row for each keyed line of each document (key, doc_id, text hash, line number);
* ``counts``: per key the number of documents that hold it, the largest of their ids and the filter it was put into;
* ``filters``: per shard of the key space one or more cuckoo filters of the keys in ``counts``.

Inserting a batch counts its own keys first, then asks the filters of each shard.  Keys
they have never seen are new for certain; only the others meet the count
table, which settles false positives.  Every key that it does not hold is put into a filter of its shard and
appended; rows of keys that did not come are left alone.  Deleting documents takes their references away,
recounts the keys they held and takes keys without references out of the very filter they were put into, so that no
other key loses its mark; after that the store is as if the documents had never come.

A line's key is the line without white space at both ends, A-Z lower-cased; keys of at
least ``min_chars`` code points count.  A key found in ``min_docs`` documents or more loses
all its lines except in the document with the largest id.

A null or empty text is one empty line.  Documents are told apart by id; all null ids are
one document, which never is the largest unless alone.  Rows that repeat an id count as one document, and each
row loses its own lines.  An empty table gives empty tables.  Columns besides ``doc_id`` and
``text`` may have any name; keys are MD5 sums of 128 bits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemend.llm.common import SPACES, ascii_lower, stage
from tablemend.llm.cuckoo import SLOTS, Cuckoo

MIN_CHARS, MIN_DOCS = 40, 5
#: Stands for no id, so that ids stay whole numbers on their way through pandas.
NO_ID = -(1 << 63)
_COUNTS = "shard int, key binary, n_docs long, last_doc long, generation int"
_ROW = ["shard", "key", "n_docs", "last_doc", "generation"]
_FILTERS = "shard int, generation int, data binary"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def _hash(keys: pd.Series) -> np.ndarray:
    """The first eight bytes of each key."""
    return np.frombuffer(b"".join(k[:8] for k in keys), np.uint64)


def references(docs: DataFrame, min_chars: int) -> DataFrame:
    numbered = docs.select(
        docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"),
        F.posexplode(lines_of(docs["text"])).alias("line_no", "line"),
    )
    line = _trimmed(F.col("line"))
    long_enough = numbered.filter(F.char_length(line) >= min_chars)
    return long_enough.select(F.unhex(F.md5(ascii_lower(line))).alias("key"), "doc_id", "text_hash", "line_no")


def _count(refs: DataFrame, shards: int) -> DataFrame:
    """Per key: documents (a null id is one) and the largest id."""
    n = F.count_distinct("doc_id") + F.max(F.col("doc_id").isNull().cast("long"))
    grouped = refs.groupBy("key").agg(n.alias("n_docs"), F.coalesce(F.max("doc_id"), F.lit(NO_ID)).alias("last_doc"))
    return grouped.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key", "n_docs", "last_doc")


def _opened(filters: pd.DataFrame) -> list[Cuckoo]:
    return [Cuckoo.loads(d) for d in filters.sort_values("generation")["data"]] if len(filters) else []


def _ask(key: tuple, keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """The keys of one shard, and whether a filter may have seen them."""
    seen = np.zeros(len(keys), bool)
    if len(keys):
        h = _hash(keys["key"])
        for g in _opened(filters):
            seen |= g.contains(h)
    return keys[["shard", "key", "n_docs", "last_doc"]].assign(seen=seen)


def _insert(key: tuple, keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """The new keys of one shard with the filter each was put into, and the shard's filters."""
    generations = _opened(filters)
    put = np.full(len(keys), -1, np.int32)
    if len(keys):
        h, left = _hash(keys["key"]), np.arange(len(keys))
        for g, last in enumerate(generations[-1:], len(generations) - 1):
            # A filter takes all keys of a batch or none.
            if not len(last.insert(h)):
                put[left], left = g, left[:0]
        if len(left):
            generations.append(Cuckoo.sized(len(left)))
            while len(generations[-1].insert(h[left])):  # more than its slots hold: a larger one
                generations[-1] = Cuckoo(np.zeros((2 * len(generations[-1].table), SLOTS), np.uint16))
            put[left] = len(generations) - 1
    rows = pd.DataFrame({
        "shard": np.int32(key[0]), "key": None, "n_docs": 0, "last_doc": NO_ID,
        "generation": np.arange(len(generations), dtype=np.int32), "data": [g.dumps() for g in generations],
    })
    out = keys[["shard", "key", "n_docs", "last_doc"]].assign(generation=put, data=None)
    return pd.concat([f for f in (out, rows) if len(f)]) if len(out) or len(rows) else rows


def _take_out(key: tuple, keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """The shard's filters without the keys, each taken out of the filter it was put into."""
    generations = _opened(filters)
    if len(keys):
        h, put = _hash(keys["key"]), keys["generation"].to_numpy()
        for g, filter_ in enumerate(generations):
            filter_.remove(h[put == g])
    return pd.DataFrame({
        "shard": np.int32(key[0]), "generation": np.arange(len(generations), dtype=np.int32),
        "data": [g.dumps() for g in generations],
    })


@dataclass(frozen=True)
class LineStore:
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = MIN_CHARS
    #: Whether nothing was ever inserted, so that there is nothing to ask.
    fresh: bool = True

    @classmethod
    def empty(cls, spark: SparkSession, shards: int, min_chars: int = MIN_CHARS) -> LineStore:
        """A store without documents.  A shard's keys must fit into a task: about 100,000 a shard are a good number."""
        refs = spark.createDataFrame([], "key binary, doc_id long, text_hash long, line_no int")
        return cls(refs, spark.createDataFrame([], _COUNTS), spark.createDataFrame([], _FILTERS), shards, min_chars)

    def insert(self, docs: DataFrame) -> LineStore:
        """The store with the documents of ``docs``, whose ids it must not hold yet."""
        return self.insert_references(stage(references(docs, self.min_chars), "line-refs"))

    def insert_references(self, refs: DataFrame) -> LineStore:
        mine = ["shard", "key", "n_docs", "last_doc"]
        came = _count(refs, self.shards)
        if self.fresh:
            known, new = None, came
        else:
            asked = stage(came.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(
                _ask, "shard int, key binary, n_docs long, last_doc long, seen boolean"), "line-asked")
            met = asked.filter("seen").select(F.col("key").alias("__key"), F.col("n_docs").alias("__n"), F.col("last_doc").alias("__last"))
            # The count table has the last word on keys that may have been seen.
            known = stage(self.counts.join(met, F.col("key") == F.col("__key")).select(
                "shard", "key", (F.col("n_docs") + F.col("__n")).alias("n_docs"), F.greatest("last_doc", "__last").alias("last_doc"), "generation"), "line-known")
            new = asked.join(known.select(F.col("key").alias("__key")), F.col("key") == F.col("__key"), "left_anti").select(mine)
        put = stage(new.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_insert, f"{_COUNTS}, data binary"), "line-put")
        counts = put.filter("data is null").select(_ROW)
        if known is not None:
            untouched = self.counts.join(known.select(F.col("key").alias("__key")), F.col("key") == F.col("__key"), "left_anti")
            counts = stage(untouched.select(_ROW).unionByName(known).unionByName(counts), "line-counts")
        filters = put.filter("data is not null").select("shard", "generation", "data")
        return LineStore(self.refs.unionByName(refs), counts, filters, self.shards, self.min_chars, fresh=False)

    def delete(self, doc_ids: DataFrame) -> LineStore:
        """The store without the documents of ``doc_ids`` (one column, doc_id)."""
        ids = doc_ids.select(F.col("doc_id").alias("__id")).distinct()
        mine = self.refs["doc_id"].eqNullSafe(ids["__id"])
        refs = stage(self.refs.join(ids, mine, "left_anti"), "line-refs")
        touched = self.refs.join(ids, mine, "left_semi").select("key").distinct()
        recount = _count(refs.join(touched, "key", "left_semi"), self.shards).select(
            F.col("key").alias("__key"), F.col("n_docs").alias("__n"), F.col("last_doc").alias("__last"))
        held = stage(self.counts.join(touched, "key").join(recount, F.col("key") == F.col("__key"), "left"), "line-held")
        stays = held.filter(F.col("__key").isNotNull()).select(
            "shard", "key", F.col("__n").alias("n_docs"), F.col("__last").alias("last_doc"), "generation")
        untouched = self.counts.join(touched, "key", "left_anti").select(_ROW)
        counts = stage(untouched.unionByName(stays), "line-counts")
        gone = held.filter(F.col("__key").isNull()).select("shard", "key", "generation")
        filters = stage(
            gone.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(_take_out, _FILTERS), "line-filters",
        )
        return LineStore(refs, counts, filters, self.shards, self.min_chars, self.fresh)

    def drops(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """doc_id, text_hash, __dropped (sorted line numbers) of the documents that lose lines."""
        shared = self.counts.filter(F.col("n_docs") >= min_docs).select("key", F.nullif("last_doc", F.lit(NO_ID)).alias("last_doc"))
        lost = self.refs.join(shared, "key").filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        return lost.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("line_no")).alias("__dropped"))

    def apply(self, docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
        """``docs`` with __n_lines, __n_dropped and __kept, the text of the lines that stay."""
        drops = self.drops(min_docs).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "__dropped")
        mine = docs["doc_id"].eqNullSafe(drops["__id"]) & (F.xxhash64(docs["text"]) == drops["__hash"])
        joined = docs.join(drops, mine, "left")
        lines = lines_of(docs["text"])
        # The lines between two dropped ones are one slice: linear in lines and drops.
        edges = F.concat(F.array(F.lit(-1)), F.col("__dropped"))
        ends = F.concat(F.col("__dropped"), F.array(F.size(F.col("__lines"))))
        slices = F.transform(
            F.arrays_zip(edges.alias("a"), ends.alias("b")),
            lambda s: F.slice(F.col("__lines"), s["a"] + 2, s["b"] - s["a"] - 1),
        )
        kept = F.array_join(F.flatten(slices), "\n")
        whole = F.coalesce(docs["text"], F.lit(""))
        return (
            joined.withColumn("__lines", lines)
            .withColumn("__n_lines", F.size("__lines").cast("long"))
            .withColumn("__n_dropped", F.when(F.col("__dropped").isNull(), 0).otherwise(F.size("__dropped")).cast("long"))
            .withColumn("__kept", F.when(F.col("__dropped").isNull(), whole).otherwise(kept))
            .select(*[docs[c] for c in docs.columns], "__n_lines", "__n_dropped", "__kept")
        )


def ingest(docs: DataFrame, deliveries: int = 2, min_chars: int = MIN_CHARS, keys_per_shard: int = 50_000) -> LineStore:
    """A store of all documents, inserted in ``deliveries`` batches by a hash of the id, as they would come over time.

    A shard holds at most about ``keys_per_shard`` keys, so that it fits into a task.
    """
    refs = stage(
        references(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(deliveries)).cast("int")),
        "line-refs",
    )
    shards = max(1, -(-refs.count() // keys_per_shard))
    store = LineStore.empty(docs.sparkSession, shards, min_chars)
    batches = [refs.filter(F.col("batch") == b).drop("batch") for b in range(deliveries)]
    return reduce(lambda s, b: s.insert_references(b), batches, store)
