import pytest
from pyspark.sql import functions as F

from tablemend.functions.dates import DOTTED, EUROPEAN
from tablemend.functions.draws import ArithmeticDraws
from tablemend.operators import inject as I
from tablemend.operators.profile import profile
from tablemend.plans import synthea
from verification import clinic

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def clean(spark):
    return {n: df.cache() for n, df in clinic.clean(spark, SF).items()}


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_injection_does_not_depend_on_partitioning(clean):
    for plan in synthea.INJECTION:
        df = clean[plan.table]
        one = I.inject(df.coalesce(1), plan.steps, plan.keys)
        many = I.inject(df.repartition(7), plan.steps, plan.keys)
        assert content(one) == content(many)


def test_rates(clean):
    dirty = I.inject_dataset(clean, synthea.INJECTION)
    n = clean["encounters"].count()
    e = dirty["encounters"]
    assert abs(e.count() / n - 1.02) < 0.01
    share = lambda c: e.filter(c).count() / e.count()
    assert abs(share(F.col("ID").startswith("bad-")) - 0.05) < 0.02
    assert abs(share(F.col("START") == "INVALID") - 0.05) < 0.02
    assert abs(share(F.col("START").isNull()) - 0.095) < 0.025
    assert abs(share(F.col("PATIENT") == "BAD") - 0.095) < 0.025
    c = dirty["conditions"]
    with_stop = c.filter("STOP is not null")
    assert abs(with_stop.filter("STOP like '%/%'").count() / with_stop.count() - 0.05) < 0.02
    assert abs(with_stop.filter("STOP like '%.%'").count() / with_stop.count() - 0.095) < 0.02


def test_what_is_injected_is_found(clean):
    """The measured errors are those of the clean table plus the drawn rows."""
    df = clean["encounters"].withColumn("key", F.col("ID"))
    dirty = I.inject(df, [I.Corrupt("START", 1, (I.to_text(0.05, "INVALID"), I.to_null(0.10)))], ["key"])
    drawn = dirty.join(df.select("key", F.col("START").alias("was")), "key").filter(
        ~F.col("START").eqNullSafe(F.col("was"))).count()
    rules = [r for r in synthea.validation_rules("encounters", F.current_date())
             if getattr(r, "description", "") == "missing or INVALID"]
    (row,) = profile(dirty, "encounters", rules).collect()
    assert row.error_count == drawn > 0


def test_copies_draw_for_themselves(spark):
    df = spark.range(20_000).withColumn("v", F.lit("x"))
    out = I.inject(df, [I.Duplicate(0.5, 1), I.Corrupt("v", 2, (I.to_null(0.5),))], ["id"])
    pairs = out.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("kept")).filter("n = 2")
    mixed = pairs.filter("kept = 1").count() / pairs.count()
    assert 0.45 < mixed < 0.55


def test_changes(spark):
    df = spark.createDataFrame([("2020-02-29", "a")], "d string, t string")
    cases = {
        "d": [(I.in_century(1, "19"), "1920-02-29"), (I.as_layout(1, EUROPEAN), "29/02/2020"),
              (I.as_layout(1, DOTTED), "2020.02.29"), (I.day_before(1, "d"), "2020-02-28"), (I.to_null(1), None)],
        "t": [(I.with_prefix(1, "bad-"), "bad-a"), (I.to_text(1, "X"), "X"), (I.to_text(0, "X"), "a")],
    }
    for name, branches in cases.items():
        for branch, expected in branches:
            out = I.inject(df, [I.Corrupt(name, 1, (branch,))], ["t"])
            assert out.first()[name] == expected
            assert out.columns == ["d", "t"]


def test_arithmetic_draws_take_one_key(spark):
    df = spark.range(1000).withColumn("v", F.lit("x"))
    out = I.inject(df, [I.Corrupt("v", 3, (I.to_null(0.2),))], ["id"], ArithmeticDraws())
    hit = lambda k: (lambda x: x * x % 1000003 % 1000 < 200)((k % 1000003 * 7919 + 3 * 104729) % 1000003)
    assert {r.id for r in out.filter("v is null").collect()} == {k for k in range(1000) if hit(k)}
