"""Distribution operators against brute force, in one and in many buckets."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from conftest import rows
from supplyloom.operators import ranking

NAN = float("nan")


def brute_ecdf(reference, v):
    known = [r for r in reference if r is not None and r == r]
    if v is None or v != v or not known:
        return None
    return sum(r <= v for r in known) / len(known)


def sample(n, seed):
    """A third of the rows share one value; some are missing."""
    rng = random.Random(seed)
    return [
        7.0 if i % 3 == 0 else None if i % 11 == 0 else NAN if i % 13 == 0 else round(rng.gauss(0, 50), 1)
        for i in range(n)
    ]


@pytest.mark.parametrize("rows_per_bucket", [4, 1_000_000])
def test_ecdf_external_population(table, rows_per_bucket):
    scored, reference = sample(300, 1), sample(200, 2)
    out = ranking.ecdf_rank(
        table("i int, v double", list(enumerate(scored))), "v", "q",
        table("w double", [(x,) for x in reference]), "w", rows_per_bucket,
    )
    got = {r["i"]: r["q"] for r in out.collect()}
    assert len(got) == len(scored)
    assert got == {i: brute_ecdf(reference, v) for i, v in enumerate(scored)}


def test_ecdf_of_itself_is_monotone_and_reaches_one(table):
    values = sample(150, 3)
    out = ranking.ecdf_rank(table("v double", [(x,) for x in values]), "v", "q", rows_per_bucket=10)
    known = sorted((r["v"], r["q"]) for r in out.collect() if r["q"] is not None)
    assert [q for _, q in known] == sorted(q for _, q in known) and known[-1][1] == 1.0
    assert all(q == brute_ecdf(values, v) for v, q in known)


@pytest.mark.parametrize("rows_per_bucket", [5, 1_000_000])
def test_exact_quantiles_match_linear_interpolation(table, rows_per_bucket):
    data = [("hot" if i % 3 else f"g{i % 7}", v) for i, v in enumerate(sample(400, 4))]
    data += [("none", None), ("single", 3.5), (None, 1.0), (None, 2.0)]
    names = {"q1": 0.25, "median": 0.5, "q9": 0.9}
    out = ranking.exact_quantiles(
        table("g string, v double", data), "v", ["g"], names, rows_per_bucket
    )
    got = {r["g"]: r for r in out.collect()}
    assert set(got) == {g for g, _ in data}
    for g in got:
        known = [v for k, v in data if k == g and v is not None and v == v]
        for name, p in names.items():
            want = pytest.approx(np.quantile(known, p), abs=1e-9) if known else None
            assert got[g][name] == want, (g, name)


@pytest.mark.parametrize("rows_per_bucket", [6, 1_000_000])
def test_boxplot_stats(table, rows_per_bucket):
    data = [("a", float(v)) for v in [1, 2, 2, 3, 4, 5, 6, 40, 40, -30]] + [("b", 2.0), ("b", None)]
    stats, outliers = ranking.boxplot_stats(table("g string, v double", data), "v", ["g"], rows_per_bucket)
    values = np.array([v for g, v in data if g == "a"])
    q1, q3 = np.quantile(values, [0.25, 0.75])
    inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
    a = {r["g"]: r for r in stats.collect()}["a"]
    assert (a["q1"], a["q3"]) == (q1, q3)
    assert (a["whisker_low"], a["whisker_high"]) == (inside.min(), inside.max())
    assert (a["n"], a["n_outliers"]) == (10, 3)
    assert rows(outliers) == [("a", -30.0, 1), ("a", 40.0, 2)]


def test_category_distribution_counts_null(table):
    df = table("r string, c string", [("x", "p"), ("x", "p"), ("x", None), ("y", "p"), (None, None)])
    assert rows(ranking.category_distribution(df, "c", ["r"])) == [
        (None, None, 1, 100.0), ("x", None, 1, pytest.approx(100 / 3)),
        ("x", "p", 2, pytest.approx(200 / 3)), ("y", "p", 1, 100.0),
    ]
    whole = ranking.filtered_distribution(df, F.col("r") == "x", "c")
    assert rows(whole) == [(None, 1, pytest.approx(100 / 3)), ("p", 2, pytest.approx(200 / 3))]


def test_row_number_pick(table):
    df = table("a int, b string", [(None, "n"), (2, "y"), (1, "x")])
    assert rows(ranking.row_number_pick(df, ["a", "b"])) == [(1, "x", 1)]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=40), st.integers(1, 9))
def test_running_weights_property(spark, values, rows_per_bucket):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    out = ranking.ecdf_rank(df, "v", "q", rows_per_bucket=rows_per_bucket).collect()
    assert len(out) == len(values)
    assert all(r["q"] == brute_ecdf(values, r["v"]) for r in out)


def test_many_buckets_equal_a_plain_window(table):
    values = [float(v) for v in random.Random(9).sample(range(20_000), 1_500)]
    out = ranking.ecdf_rank(table("v double", [(x,) for x in values]), "v", "q", rows_per_bucket=3)
    order = {v: (i + 1) / len(values) for i, v in enumerate(sorted(values))}
    assert {r["v"]: r["q"] for r in out.collect()} == order
