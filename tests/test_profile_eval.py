"""Small frames with known answers."""

import math

from pyspark.sql import functions as F

from tessera.operators import clean, evaluate, profile, split, topk


def test_null_profile_one_aggregate(spark):
    df = spark.createDataFrame([(1, "", None), (None, "x", 2.0), (3, None, 3.0)], "a int, s string, d double")
    got = {r.column_name: (r.nulls, r.pct) for r in profile.null_profile(df).collect()}
    assert got == {"a": (1, 33.33), "s": (2, 66.67), "d": (1, 33.33)}
    plan = profile.null_profile(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") <= 2  # one partial + one final aggregate


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, "b")], "k int, v string")
    r = profile.duplicates(df).first()
    assert (r.rows, r.distinct_rows, r.duplicate_rows) == (4, 2, 2)


def test_wide_stats_and_skew_variants(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "x double")
    r = profile.wide_stats(df, ["x"]).first()
    assert r["count"] == 4 and abs(r.skew_pop - 0.7684) < 1e-4 and abs(r.skew_samp - 1.3309) < 1e-4
    assert abs(r.kurt_pop - (-1.0)) < 1e-3
    assert abs(r.p50 - 3.0) < 1e-12 and abs(r.p25 - 1.75) < 1e-12


def test_all_null_column_gives_null_stats(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "x double, y double")
    r = {x.column_name: x for x in profile.wide_stats(df, ["x", "y"]).collect()}
    assert r["x"]["count"] == 0 and r["x"].mean is None and r["y"].p50 == 1.5


def test_histogram_sums_to_rows(spark):
    df = spark.createDataFrame([(x / 10,) for x in range(100)], "v double")
    h = profile.histogram_tenths(df, "v")
    assert h.agg(F.sum("n")).first()[0] == 100 and h.count() == 100


def test_boxplot(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 2, 3, 4, 5, 6, 7, 8, 100]], "v double")
    r = profile.boxplot(df, "v").first()
    assert (r.q1, r.median, r.q3, r.outliers, r.whisker_hi) == (3.0, 5.0, 7.0, 1, 8.0)


def test_loss_accounting_and_verdict(spark):
    df = spark.createDataFrame([(1, "x"), (2, ""), (3, None), (4, "y")], "id int, s string")
    keep = clean.keep_predicate(df, not_empty=["s"])
    r = clean.sufficiency(clean.loss_accounting(df, keep), enough=3, caution=1).first()
    assert (r.original, r.kept, r.removed, r.pct_lost, r.verdict) == (4, 2, 2, 50.0, "caution")


def test_hash_split_disjoint_and_complete(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    tr, te = split.hash_split(df, "k")
    assert tr.count() + te.count() == 2000
    assert tr.join(te, "k").count() == 0
    assert 1500 < tr.count() < 1700
    tr2, _ = split.hash_split(df.repartition(7), "k")
    assert sorted(r.k for r in tr.collect()) == sorted(r.k for r in tr2.collect())


def _preds(spark):
    return spark.createDataFrame([(1, 3.0, 2.5), (2, 5.0, 5.0), (3, 2.0, 3.0), (4, 7.0, 6.0), (5, 1.0, 2.0)],
                                 "id int, label double, prediction double")


def test_metrics_hand_computed(spark):
    r = evaluate.metrics(_preds(spark)).first()
    errs = [0.5, 0.0, -1.0, 1.0, -1.0]
    mse = sum(e * e for e in errs) / 5
    ys = [3, 5, 2, 7, 1]
    sst = sum((y - 3.6) ** 2 for y in ys)
    assert abs(r.mse - mse) < 1e-12 and abs(r.rmse ** 2 - r.mse) < 1e-12
    assert abs(r.mae - 0.7) < 1e-12 and abs(r.r2 - (1 - mse * 5 / sst)) < 1e-12
    by = evaluate.metrics_by(_preds(spark).withColumn("m", F.lit("x")), "m").first()
    assert abs(by.r2 - r.r2) < 1e-12


def test_worst_predictions_tie_break(spark):
    w = evaluate.worst_predictions(_preds(spark), "id", 3).collect()
    assert [x.id for x in w] == [3, 4, 5]


def test_leaderboard_sorted_and_best(spark):
    board = spark.createDataFrame([("b", 2.0, 1.0, 0.5, 0.0), ("a", 1.0, 1.0, 0.7, 60.0)],
                                  "model string, rmse double, mae double, r2 double, seconds double")
    lb = evaluate.leaderboard(board).collect()
    assert [r.model for r in lb] == ["a", "b"] and lb[0].minutes == 1.0 and lb[1].minutes is None
    assert topk.best_model(board).first().model == "a"
    v = board.select(evaluate.r2_verdict(F.col("r2")).alias("v")).collect()
    assert [x.v for x in v] == ["acceptable", "suspect leakage"]


def test_duplicates_with_a_long_list_of_digests(spark, monkeypatch):
    df = spark.createDataFrame([(i % 40, None if i % 3 else f"v{i % 60}") for i in range(300)], "a int, b string").repartition(6)
    short = profile.duplicates(df).first()
    monkeypatch.setattr(profile, "BROADCAST_MAX_ROWS", 0)
    assert profile.duplicates(df).first() == short
    assert short.rows == 300 and short.distinct_rows == df.distinct().count()
