"""Cases that earlier versions got wrong: empties, constants, null targets, many hot keys, ties."""

import math

from pyspark.sql import functions as F

from tessera.functions import scalars as H
from tessera.operators import audit, clean, encode, evaluate, joins, profile
from tessera.plans import models
from tests.test_models import _linear


def test_a_hundred_equal_hot_keys_are_all_salted(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 100).alias("c"))
    table = df.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    out = joins.lookup(df, table.withColumn("m", F.col("c") * 2), "c", count_col="n", salt_by=["id"], salt_buckets=400)
    rows = out.collect()
    assert len(rows) == 20_000 and all(r.m == r.c * 2 for r in rows)
    # Every key holds 1 % of the rows, four partitions' worth: none is left unsalted.
    hot = table.filter(F.col("n") * 400 > 20_000)
    assert hot.count() == 100


def test_time_encode_adds_its_two_columns_and_repeats(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], "xyz"[i % 3], i // 4, float(i)) for i in range(60)],
                               "id long, c string, d string, t long, y double")
    once = encode.time_encode(df, "c", "y", "t", salt_by=["id"])
    assert once.columns == [*df.columns, "c_past_mean", "c_past_mean_n"]
    twice = encode.time_encode(once, "d", "y", "t", salt_by=["id"])
    assert twice.columns == [*once.columns, "d_past_mean", "d_past_mean_n"]
    for r in twice.collect():
        for col in ("c", "d"):
            past = [float(i) for i in range(60) if i // 4 < r.t and ("ab"[i % 2] if col == "c" else "xyz"[i % 3]) == r[col]]
            assert r[f"{col}_past_mean_n"] == len(past)
            assert r[f"{col}_past_mean"] is None if not past else math.isclose(r[f"{col}_past_mean"], sum(past) / len(past))


def test_null_targets_count_for_nothing(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", 4.0), (3, "a", 6.0), (4, "b", 1.0)], "id long, c string, y double")
    got = {r.id: r.c_loo for r in encode.loo_encode(df, "c", "y", salt_by=["id"]).collect()}
    assert got[2] == 6.0 and got[3] == 4.0 and got[1] == 5.0 and math.isclose(got[4], 11 / 3)


def test_empty_and_constant_inputs_do_not_raise(spark):
    empty = spark.createDataFrame([], "label double, prediction double, t string")
    assert [r.pct for r in profile.null_profile(empty, ["t"]).collect()] == [None]
    acc = clean.loss_accounting(empty, clean.keep_predicate(empty, not_null=["label"]))
    assert clean.sufficiency(acc).first().kept == 0
    flat = spark.createDataFrame([(1.0, 0.5), (1.0, 1.5), (None, 9.0), (1.0, None)], "label double, prediction double")
    m = evaluate.metrics(flat).first()
    assert m.r2 is None and m.n == 2 and m.rmse == 0.5
    board = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.5)], "model string, rmse double, r2 double")
    assert {r.r2_improvement_pct for r in evaluate.improvement(board, "a").collect()} == {None}
    unused = spark.createDataFrame([("f", 0.0)], "feature string, importance double")
    assert audit.dominance_audit(unused).first().dominant is False


def test_rounding_keeps_what_does_not_fit(spark):
    df = spark.createDataFrame([(float("nan"),), (1e30,), (float("inf"),), (1.25,), (None,)], "x double")
    got = [r[0] for r in df.select(H.round_half_up(F.col("x"), 1)).collect()]
    assert math.isnan(got[0]) and got[1:] == [1e30, math.inf, 1.3, None]


def test_encoders_are_fitted_on_the_base_rows(spark):
    from tessera.plans.features import FeatureSpec, encode_train_test

    rows = spark.createDataFrame([(i, float(i % 5), "ab"[i % 2], "xyz"[i % 3]) for i in range(60)],
                                 "k long, y double, c string, d string")
    spec = FeatureSpec(key="k", label="y", text=None, hashed=[], reduce=[], encoders=[("c", "target"), ("d", "target")],
                       numeric=[], indexed=[])
    train, test = encode_train_test(rows, rows, spec)
    for frame in (train, test):
        assert set(frame.columns) == {"k", "y", "c_encoded", "d_encoded"} and frame.count() == 60


def test_isotonic_points_match_the_rows(spark):
    prep = _linear(spark, n=400)
    points = models.isotonic_points(prep.train, 0, "y")
    assert points.agg(F.sum("weight")).first()[0] == prep.train.count()


def test_grid_has_one_winner_among_ties(spark):
    from tessera.plans import tune

    prep = _linear(spark, n=200)
    table = tune.report(tune.search(prep, "ridge", grid={"regParam": [0.0], "elasticNetParam": [0.0, 0.5, 1.0]})).collect()
    assert sum(r.is_best for r in table) == 1
    assert all((r.test_rmse is not None) == r.is_best for r in table)
