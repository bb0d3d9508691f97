import datetime as dt

import pytest
from pyspark.sql import functions as F

from tablemend.functions import dates as D
from tablemend.functions import predicates as P
from tablemend.functions.columns import percentage, resolve
from tablemend.functions.draws import ArithmeticDraws, HashDraws


def one(spark, value, expression):
    df = spark.createDataFrame([(value,)], "c string")
    return df.select(expression(F.col("c")).alias("x")).first()["x"]


DAY = dt.date(2020, 1, 5)


@pytest.mark.parametrize("text, layout, expected", [
    ("2020-01-05T10:11:12Z", D.ISO, DAY),
    ("2020-01-05junk", D.ISO, DAY),
    (" 2020-1-5", D.ISO, DAY),
    ("20200105", D.ISO, None),
    ("2020", D.ISO, None),
    ("2020-13-45", D.ISO, None),
    ("20-01-05", D.ISO, None),
    ("INVALID", D.ISO, None),
    ("", D.ISO, None),
    (None, D.ISO, None),
    ("--", D.ISO, None),
    ("01/05/2020", D.US, DAY),
    ("13/05/2020", D.US, None),
    ("05/01/2020", D.EUROPEAN, DAY),
    ("2020.01.05", D.DOTTED, DAY),
    ("2020-01.05", D.DOTTED, None),
    ("20200105", D.COMPACT, DAY),
    ("2020-01-05", D.COMPACT, None),
])
def test_lenient_date(spark, text, layout, expected):
    assert one(spark, text, lambda c: D.lenient_date(c, layout)) == expected


def test_parse_any_takes_the_first_layout_that_fits(spark):
    both = lambda c: D.parse_any(c, (D.US, D.EUROPEAN, D.ISO))
    assert one(spark, "02/03/2020", both) == dt.date(2020, 2, 3)
    assert one(spark, "13/03/2020", both) == dt.date(2020, 3, 13)
    assert one(spark, "2020-01-05", both) == DAY


def test_cast_date_accepts_what_a_cast_does(spark):
    assert one(spark, "2020", D.cast_date) == dt.date(2020, 1, 1)
    assert one(spark, "2020-01-05T10:00:00Z", D.cast_date) == DAY
    assert one(spark, "05/01/2020", D.cast_date) is None


@pytest.mark.parametrize("text, empty", [
    (None, True), ("", True), ("  ", True), ("0000", True), (" Unknown ", True), ("N/A", True),
    ("000", False), ("x", False),
])
def test_effectively_empty(spark, text, empty):
    assert one(spark, text, P.effectively_empty) is empty


@pytest.mark.parametrize("text, bad", [
    ("ac000000-0000-4000-8000-000000000001", False),
    ("AC000000-0000-4000-8000-000000000001", False),
    ("bad-ac000000-0000-4000-8000-000000000001", True),
    (" ac000000-0000-4000-8000-000000000001", True),
    ("gc000000-0000-4000-8000-000000000001", True),
    ("UNKNOWN", True), (None, True),
])
def test_invalid_uuid(spark, text, bad):
    assert one(spark, text, P.invalid_uuid) is bad


def test_null_handling_differs_by_predicate(spark):
    assert one(spark, None, lambda c: P.outside(c, ("M",))) is None
    assert one(spark, None, lambda c: P.null_or_outside(c, ("m",), ignore_case=True)) is True
    assert one(spark, "M", lambda c: P.null_or_outside(c, ("m",), ignore_case=True)) is False
    assert one(spark, None, lambda c: P.mismatch(c, "^a$")) is None
    assert one(spark, "b", lambda c: P.mismatch_except(c, "^a$", "b")) is False


@pytest.mark.parametrize("text, number", [("12", True), (" -3 ", True), ("12.5", True), ("1e3", False), ("x", False),
                                          ("1234567890123456789", True), ("9223372036854775808", False), ("0" * 30 + "1", True)])
def test_looks_like_integer(spark, text, number):
    assert one(spark, text, P.looks_like_integer) is number


def test_percentage_is_exact(spark):
    cases = [(1, 8, 12.5), (1, 3, 33.33), (2, 3, 66.67), (1, 800, 0.13), (0, 0, 0.0), (5, 0, 0.0),
             (10**13 - 1, 10**13, 100.0)]
    df = spark.createDataFrame([(e, t) for e, t, _ in cases], "e long, t long")
    assert [r[0] for r in df.select(percentage("e", "t")).collect()] == [p for _, _, p in cases]


def test_resolve_ignores_case_but_prefers_the_exact_name(spark):
    df = spark.createDataFrame([(1, 2)], "Id int, other int")
    assert resolve(df, "ID") == "Id" and resolve(df, "none") is None
    assert resolve(spark.createDataFrame([(1, 2)], "id int, ID int"), "ID") == "ID"


@pytest.mark.parametrize("draws", [ArithmeticDraws(), HashDraws()])
def test_draws_hit_their_rate_and_are_unrelated(spark, draws):
    df = spark.range(100_000).withColumn("s", draws.seed([F.col("id")]))
    a, b = draws.below("s", "1", 0.1), draws.below("s", "2", 0.1)
    got = df.agg(F.count_if(a), F.count_if(b), F.count_if(a & b)).first()
    assert abs(got[0] - 10_000) < 500 and abs(got[1] - 10_000) < 500
    assert abs(got[2] - 1_000) < 200


def test_plain_iso_dates_are_read_as_by_the_pattern(spark):
    """Texts that take the way without a pattern, and others close to them."""
    texts = ["2020-01-05", "2020-01-05T10:11:12Z", "2020-01-5 x", "2020-01-051", "2020-01- 5", "2020-1-05", "2020-13-01",
             "2021-02-29", " 2020-01-05", "+202-01-05", "-2020-01-05", "12020-1-05", "2020-1 -05", "0000-01-01", "2020-01-05\nx",
             "2020-01-5T", "2020-01-\t5", "2020-01-05é", "２０２０-01-05", "abcd-ef-gh", "20-01-05", "2020", "2020-01", "", None,
             "05/01/2020", "2020.01.05", "20200105", "2020-01-0x", "2020-0x-01", "😀020-01-05", "   1-02-03"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    for layouts in ([D.ISO], [D.ISO, D.EUROPEAN, D.DOTTED], [D.COMPACT, D.ISO, D.EUROPEAN, D.DOTTED], [D.ISO, D.US, D.DOTTED], [D.US, D.EUROPEAN, D.ISO]):
        rounds = [[x for x in layouts if x != D.EUROPEAN], [D.EUROPEAN]] if D.US in layouts and D.EUROPEAN in layouts else [layouts]
        by_pattern = F.coalesce(*[D._in_iso_order(F.col("c"), r).try_cast("date") for r in rounds])
        for r in df.select("c", D.parse_any(F.col("c"), layouts).cast("string").alias("got"), by_pattern.cast("string").alias("want")).collect():
            assert r["got"] == r["want"], (layouts, r)
    found = df.select(D.parse_any(F.col("c"), iter([D.ISO]))).limit(4).collect()
    assert [r[0] for r in found] == [DAY] * 4
