"""Row rules and duplicate rows in one reading of a table."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablemend.functions import predicates as P
from tablemend.functions.digest import packed_digest
from tablemend.model import ColumnRule, Rule
from tablemend.operators.profile import profile, profile_with_duplicates
from tablemend.operators.uniqueness import duplicate_rows
from tablemend.plans import pipeline


def rows(df) -> list:
    return sorted(map(str, df.collect()))


def readings(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Range (0, 9,")


def apart(df, table, rules, volume="6V"):
    return profile(df, table, rules, volume).unionByName(duplicate_rows(df, table))


def test_dataset_is_profiled_in_one_reading_per_table(spark, specs):
    texts = spark.range(9).select(F.col("id").cast("string").alias("CODE"))
    assert readings(pipeline.profile_dataset({"t": texts}, {}, fks=())) == 1
    assert readings(pipeline.assess_corrected({"t": texts}, specs)) == 1


def test_one_reading_gives_the_metrics_of_two(clinic, specs):
    for name, df in clinic.items():
        rules = specs[name].profile_rules
        for some in (df, df.unionByName(df).unionByName(df.limit(1)), df.filter("1 = 0")):
            assert rows(profile_with_duplicates(some, name, rules)) == rows(apart(some, name, rules))


def test_more_rules_than_bits_in_a_mark(spark):
    df = spark.range(10).select(*[F.when(F.col("id") % 7 < i % 3, F.col("id") % 7).alias(f"c{i}") for i in range(140)])
    rules = [Rule("7S", "gone", "x", P.is_null, ("NOPE",)), ColumnRule("7S", "null", P.is_null)]
    assert rows(profile_with_duplicates(df, "wide", rules)) == rows(apart(df, "wide", rules))
    assert rows(profile_with_duplicates(df, "wide", [])) == rows(apart(df, "wide", []))


def test_a_key_that_fills_the_table_is_one_row_per_task(spark):
    df = spark.range(0, 1000, 1, 4).select(F.lit("x").alias("a"), F.when(F.col("id") < 990, "y").alias("b"))
    found = profile_with_duplicates(df, "t", [ColumnRule("7S", "null", P.is_null)])
    assert {r.rule_name: (r.error_count, r.total_count) for r in found.collect()} == {
        "a": (0, 1000), "b": (10, 1000), None: (998, 1000)}


@pytest.mark.parametrize("kind", ["double", "struct<x:double>"])
def test_equal_values_with_other_texts_are_judged_one_by_one(spark, kind):
    made = {"double": "id * d", "struct<x:double>": "struct(id * d as x)"}[kind]
    df = spark.createDataFrame([(0, 1.0), (0, -1.0), (1, 1.0)], "id int, d double").selectExpr(f"{made} as v", "'a' as t")
    rules = [Rule("7S", "minus", "written with a minus", lambda c: c.cast("string").contains("-"), ("v",))]
    got = {r.rule_name: (r.error_count, r.total_count) for r in profile_with_duplicates(df, "t", rules).collect()}
    assert got == {"minus": (1, 3), None: (1, 3)}


def test_packed_digest_tells_texts_apart(spark):
    sizes = (0, 1, 253, 254, 255, 256, 600)
    pairs = [("x" * a, "x" * b) for a in sizes for b in sizes] + [
        (None, "a"), ("a", None), (None, None), ("1:", "x"), ("1", ":x"), ("ā", "b"), ("āb", ""), ("254,1:", "a"),
        (None, "x" * 300), ("x" * 300, None), ("-", "x" * 300),
    ]
    wide = [(a, *["c"] * 7, b) for a, b in pairs]
    for found in (spark.createDataFrame(pairs, "a string, b string"),
                  spark.createDataFrame(wide, ", ".join(f"c{i} string" for i in range(9)))):
        digests = found.select(packed_digest(found.columns).alias("d"))
        assert digests.distinct().count() == len(set(pairs))
        assert digests.filter("octet_length(d) = 32").count() == len(pairs)
    odd = spark.createDataFrame([("q", "r")], "`a.b` string, `c``d` string")
    assert odd.select(packed_digest(odd.columns)).count() == 1
