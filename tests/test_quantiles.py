"""Sketch-bracketed quantiles against numpy: ties, hot values, nulls, NaN, narrowing and widening."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import profile, quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]


def _check(df, pdf, gather, groups=("g",)):
    got = {tuple(r[g] for g in groups): r for r in quantiles.exact_quantiles(
        df, "v", PROBS, group=list(groups), with_n=True, gather=gather).collect()}
    want = {k if isinstance(k, tuple) else (k,): x.v.dropna().to_numpy()
            for k, x in pdf.groupby(list(groups), dropna=False)}
    want = {tuple(None if isinstance(p, float) and math.isnan(p) else p for p in k): x for k, x in want.items() if len(x)}
    assert set(got) == set(want)
    for k, x in want.items():
        row = got[k]
        assert row["n"] == len(x)
        assert np.allclose([row[f"p{round(p * 100)}"] for p in PROBS], np.quantile(x, PROBS), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("gather", [100_000, 300, 8])
def test_groups_ties_nulls_and_a_hot_value(spark, gather):
    rng = np.random.default_rng(2)
    pdf = pd.concat([
        pd.DataFrame({"g": "hot", "v": np.concatenate([np.full(3000, 5.5), rng.normal(5, 1, 3000)])}),
        pd.DataFrame({"g": "ties", "v": rng.integers(0, 4, 3000).astype(float)}),
        pd.DataFrame({"g": "one", "v": [7.0]}), pd.DataFrame({"g": None, "v": rng.exponential(1, 900)}),
        pd.DataFrame({"g": "skewed", "v": 10 ** rng.uniform(-9, 9, 2500)})])
    pdf.loc[rng.random(len(pdf)) < 0.05, "v"] = np.nan
    rows = [(g, None if math.isnan(v) else v) for g, v in zip(pdf.g, pdf.v)] + [("empty", None)]
    _check(spark.createDataFrame(rows, "g string, v double").repartition(5), pdf, gather)


def test_wrong_brackets_are_widened(spark, monkeypatch):
    """Even a sketch that points anywhere changes nothing."""
    monkeypatch.setattr(quantiles, "MARGIN", -0.2)
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": "a", "v": rng.normal(0, 1, 4000)})
    _check(spark.createDataFrame(pdf), pdf, 50)


def test_no_groups_nan_and_no_values(spark):
    df = spark.createDataFrame([(float(i),) for i in range(8)] + [(float("nan"),), (float("nan"),), (None,)], "v double")
    row = quantiles.exact_quantiles(df, "v", [0.0, 0.5, 0.75, 0.8, 1.0], gather=4).first()
    assert row[0] == 0.0 and row[1] == 4.5 and row[2] == 6.75 and math.isnan(row[3]) and math.isnan(row[4])
    none = quantiles.exact_quantiles(df.filter("v is null"), "v", [0.5], with_n=True).collect()
    assert [tuple(r) for r in none] == [(None, 0)]
    assert quantiles.exact_quantiles(df.filter("v is null"), "v", [0.5], group=["v"]).count() == 0


def test_shuffle_does_not_follow_the_distinct_values(spark):
    """What the bracket scans gather stays the same at ten times the distinct values."""
    def gathered(n):
        rows = spark.range(n).select((F.col("id") * 1.0).alias("__x"))
        state = quantiles._first(rows, [], [0.5], 100)
        while not state.filter(F.exists("__b", lambda b: ~b["done"])).isEmpty():
            state = quantiles.materialize(quantiles._narrowed(rows, state, [], [0.5], 100))
        return state.first()["__b"][0]["inside"]

    assert gathered(30_000) <= 100 and gathered(300_000) <= 100


def test_rank_errors(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("a", 50.0)] * 20, "g string, v double")
    answers = spark.createDataFrame([("a", 10.0, 50.0)], "g string, p25 double, p50 double")
    row = quantiles.rank_errors(df, "v", answers, ["p25", "p50"], [0.25, 0.5], "g").first()
    assert row.p25_rank_error == pytest.approx((30 - 11) / 120) and row.p50_rank_error == 0


def test_approximate_statistics_report_a_broken_promise(spark):
    df = spark.range(50_000).select(F.col("id").cast("double").alias("v"))
    assert profile.approx_wide_stats(df, ["v"]).first().within is True
    rough = profile.approx_wide_stats(df, ["v"], probs=(0.25, 0.5), accuracy=3).first()
    assert max(rough.p25_rank_error, rough.p50_rank_error) <= 1 / 3


def test_duplicates_tell_null_places_apart(spark):
    rows = [(None, "a"), ("a", None), (None, None), (None, "a"), ("", None), ("a", None), ("a", None), ("b", "c")]
    got = profile.duplicates(spark.createDataFrame(rows, "x string, y string")).first()
    assert (got.rows, got.distinct_rows, got.duplicate_rows) == (8, 5, 3)
    none = profile.duplicates(spark.createDataFrame([], "x string")).first()
    assert none.distinct_rows == 0
    numbers = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (float("nan"),)], "x double")
    assert profile.duplicates(numbers).first().distinct_rows == 2


def test_colliding_digests_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(profile, "_digest", lambda df, cols: [F.lit(1).alias("__d1"), F.lit(2).alias("__d2")])
    df = spark.createDataFrame([(i % 7, str(i % 3)) for i in range(100)], "x int, y string")
    got = profile.duplicates(df).first()
    assert (got.rows, got.distinct_rows, got.duplicate_rows) == (100, 21, 79)


def test_counting_scan_is_a_plain_aggregate_and_settles_repeated_values(spark):
    """Rows are counted without a sketch, and quantiles on repeated values need no further scan."""
    rows = spark.range(20_000).select(F.col("id").alias("g") % 2, (F.col("id") % 11 * 0.01).alias("__x")).toDF("g", "__x")
    state = quantiles.materialize(quantiles._first(rows, ["g"], PROBS, 100))
    plan = quantiles._cells(rows, state, ["g"], 500)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "kll" not in plan.lower()
    for row in quantiles._narrowed(rows, state, ["g"], PROBS, 100).collect():
        x = np.sort(np.arange(row.g, 20_000, 2) % 11 * 0.01)
        for b in row["__b"]:
            assert b["done"] and b["inside"] == 0
            assert (b["at_low"], b["at_high"]) == (x[b["low"]], x[b["high"]])


def test_one_counting_scan_cuts_a_bracket_far_below_its_first_width(spark):
    """The bracket of a sketch is about MARGIN wide on either side; the cells in it are much smaller."""
    rows = spark.range(200_000).select(F.rand(3).alias("__x"))
    state = quantiles.materialize(quantiles._first(rows, [], [0.25, 0.5], 10))
    for b in quantiles._narrowed(rows, state, [], [0.25, 0.5], 10).first()["__b"]:
        assert b["inside"] < 200_000 * 2 * quantiles.MARGIN / 4


def test_constants_and_joins_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", "c"], 6000, p=[0.9, 0.08, 0.02]), "v": rng.normal(0, 1, 6000).round(3)})
    df = spark.createDataFrame(pdf)
    for few in (0, 32):
        monkeypatch.setattr(quantiles, "FEW", few)
        _check(df, pdf, 40)


def test_no_groups_cut_twice(spark, monkeypatch):
    """Without groups brackets are constants in every scan, whatever may be compared so."""
    x = np.random.default_rng(5).normal(0, 1, 5000)
    df = spark.createDataFrame(pd.DataFrame({"v": x}))
    monkeypatch.setattr(quantiles, "FINE", 2)
    for few in (0, 32):
        monkeypatch.setattr(quantiles, "FEW", few)
        got = quantiles.exact_quantiles(df, "v", PROBS, gather=5)
        assert np.allclose(list(got.first()), np.quantile(x, PROBS), rtol=1e-12, atol=1e-12)
        assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
