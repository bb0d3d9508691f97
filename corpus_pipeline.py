"""A corpus through toxicity filter, line and near deduplication, mixing and packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next stage's docs.  All but the last return the columns of ``documents``.

Nulls and edge cases: any column may be null; an empty table passes through every stage as an empty table;
columns besides ``doc_id``, ``text``, ``source`` and ``n_chars`` may have any name (but two leading underscores)
and come through all stages but the last.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemend.llm import line_dedup, mixing, near_dup, packing, toxicity
from tablemend.llm.common import ship, stage
from tablemend.llm.queries import END_ID, MIX, SEQUENCE, TOKENIZER

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of any toxic grade is ``toxicity.THRESHOLD`` or more go; a null or empty text has
    the chance of a text without known words, which stays unless most labels are toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = toxicity.judge(docs, toxicity.train(docs, labels))
    return judged.filter(~F.col("__toxic")).select(*[docs[c] for c in docs.columns])


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them; every document stays, if with less text.
    A null text, and one that loses no line, stays as it is."""
    cleaned = line_dedup.ingest(docs).apply(docs)
    lost = F.col("__n_dropped") > 0
    text = F.when(lost, F.col("__kept")).otherwise(docs["text"])
    length = F.when(lost, F.char_length("__kept").cast("long")).otherwise(docs["n_chars"])
    return cleaned.select(*[{"text": text, "n_chars": length}.get(c, F.col(c)).alias(c) for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of texts that share four fifths of their five-word shingles, the one of the
    smallest id.  Texts without words are linked with nothing and stay; of rows that repeat id and text one stays."""
    return near_dup.deduplicate(docs, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes it: never, once or twice.  A null source is a source;
    a text without words comes with the whole copies of its source only."""
    return mixing.mix(docs, **MIX)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences, one row a piece, as ``op9`` returns them.
    A null or empty text is the end token alone; a document that the mix repeats is packed as often."""
    return packing.pack(packing.pieces(docs, TOKENIZER, END_ID, SEQUENCE), SEQUENCE)


def _shipped(step: Stage) -> Stage:
    """The stage, with the package known to the Python workers."""
    @functools.wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return step(spark, docs, sf_dir)

    return run_step


STAGES = [(name, _shipped(step)) for name, step in (
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_dup", without_near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
)]

#: A trained model, random draws and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
