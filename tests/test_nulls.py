import math

import pytest
from pyspark.sql import functions as F

from conftest import rows
from supplyloom.functions import nulls as N


def one(df, expr):
    return df.select(expr.alias("x")).first()[0]


@pytest.fixture
def numbers(table):
    return table("k string, v double", [("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0), ("c", None)])


def test_unknown_condition_gives_null(table):
    df = table("v double", [(-1.0,), (None,), (2.0,)])
    out = [r[0] for r in df.select(N.if_else(F.col("v") > 0, F.lit(1), F.lit(0))).collect()]
    assert out == [0, None, 1]


def test_membership_is_never_null(table):
    df = table("v string", [("a",), (None,), ("b",)])
    assert [r[0] for r in df.filter(N.not_in("v", ["a"])).collect()] == [None, "b"]
    assert [r[0] for r in df.filter(N.in_set("v", ["a"])).collect()] == ["a"]


def test_strict_aggregates_are_null_when_any_input_is(numbers):
    out = numbers.groupBy("k").agg(
        N.strict_sum("v").alias("s"), N.strict_mean("v").alias("m"), N.strict_sd("v").alias("d")
    )
    assert rows(out) == [
        ("a", None, None, None), ("b", 6.0, 3.0, pytest.approx(math.sqrt(2))), ("c", None, None, None),
    ]


def test_zero_sum_of_nothing_is_zero(numbers):
    assert rows(numbers.groupBy("k").agg(N.zero_sum("v"))) == [("a", 1.0), ("b", 6.0), ("c", 0.0)]


def test_mean_ignores_nan_and_null(table):
    df = table("v double", [(float("nan"),), (None,), (4.0,)])
    assert one(df, N.mean_ok("v")) == 4.0


def test_sd_of_one_value_is_null(table):
    assert one(table("v double", [(4.0,)]), N.strict_sd("v")) is None


def test_ratios_by_zero_are_null(table):
    df = table("a double, b double", [(1.0, 0.0)])
    assert one(df, N.ratio("a", "b")) is None
    assert one(df, N.pct("a", "b")) is None
    assert one(table("a int, b int", [(1, 8)]), N.pct("a", "b")) == 12.5


def test_bounds_leave_nulls_alone(table):
    df = table("v double", [(None,), (-5.0,), (150.0,)])
    pick = lambda e: [r[0] for r in df.select(e).collect()]
    assert pick(N.cap("v", 100.0)) == [None, -5.0, 100.0]
    assert pick(N.floor_zero("v")) == [None, 0.0, 150.0]
    assert pick(N.negative_part("v")) == [None, -5.0, 0.0]
    assert pick(N.censor("v", 0, 100)) == [None, None, None]
