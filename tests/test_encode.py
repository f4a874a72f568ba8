"""E1-E3, X1-X3 and the skew-safe lookup: invariants and brute force."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import encode, joins


def _train_test(spark):
    train = spark.createDataFrame(
        [(1, "a", 1.0), (2, "a", 3.0), (3, "b", 5.0), (4, "c", 2.0), (5, "c", 2.0), (6, "c", 8.0),
         (7, None, 4.0), (8, "a", 6.0)], "id int, cat string, y double")
    test = spark.createDataFrame([(9, "a", 0.0), (10, "z", 0.0), (11, None, 0.0), (12, "b", 0.0)],
                                 "id int, cat string, y double")
    return train, test


def test_frequency_fit_apply(spark):
    train, test = _train_test(spark)
    enc = encode.fit_frequency(train, "cat")
    total = enc.table.agg(F.sum("value")).first()[0]
    assert abs(total - 1.0) < 1e-12
    got = {r.id: r.cat_freq for r in enc.apply(test).collect()}
    assert got == {9: 3 / 8, 10: 1 / 8, 11: 1 / 8, 12: 1 / 8}
    assert "cat" not in enc.apply(test).columns


def test_target_fit_apply_smoothing(spark):
    train, test = _train_test(spark)
    enc = encode.fit_target(train, "cat", "y", smoothing=10)
    mu = 31 / 8
    got = {r.id: r.cat_encoded for r in enc.apply(test).collect()}
    assert abs(got[9] - (10 / 3 * 3 + mu * 10) / 13) < 1e-12
    assert abs(got[10] - mu) < 1e-12
    # smoothed value lies between the category mean and mu
    for r in enc.table.filter(F.col("cat").isNotNull()).collect():
        m = {"a": 10 / 3, "b": 5.0, "c": 4.0}[r.cat]
        assert min(m, mu) - 1e-12 <= r.value <= max(m, mu) + 1e-12


def test_top_n_ties_and_other(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate("aaabbbcccdde")], "id int, c string")
    top = encode.fit_top_n(df, "c", 2)
    assert [r.c for r in top.collect()] == ["a", "b"]
    out = {r.id: r.c for r in encode.reduce_cardinality(df, "c", top, n=2).collect()}
    assert out[0] == "a" and out[6] == "Other" and out[11] == "Other"


def test_loo_equal_targets_and_single(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", 2.0), (3, "a", 2.0), (4, "b", 9.0)],
                               "id int, c string, y double")
    got = {r.id: r.c_loo for r in encode.loo_encode(df, "c", "y").collect()}
    assert got[1] == got[2] == got[3] == 2.0
    assert abs(got[4] - 15 / 4) < 1e-12  # alone in its category -> mu


def _brute_kfold(pdf, k):
    import hashlib

    def fold(key):
        return int(hashlib.md5(f"42:{key}".encode()).hexdigest()[:8], 16) % k

    pdf = pdf.assign(fold=pdf.id.map(fold))
    mu = pdf.y.mean()
    out = {}
    for r in pdf.itertuples():
        other = pdf[(pdf.c == r.c) & (pdf.fold != r.fold)]
        out[r.id] = other.y.mean() if len(other) else mu
    return out


def _skewed(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        c = "hot" if i % 3 == 0 else f"c{rnd.randint(0, 200)}"   # a third of rows in one key
        rows.append((i, c, float(rnd.randint(0, 100)), 1_700_000_000 + rnd.randint(0, 500)))
    return spark.createDataFrame(rows, "id int, c string, y double, t long")


def test_kfold_matches_brute_force_under_skew(spark):
    df = _skewed(spark)
    got = {r.id: r.c_kfold for r in encode.kfold_encode(df, "c", "y", key="id", k=5).collect()}
    want = _brute_kfold(df.toPandas(), 5)
    assert len(got) == len(want)
    assert all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_time_encode_matches_brute_force_under_skew(spark):
    df = _skewed(spark).withColumn("ts", F.timestamp_seconds("t"))
    out = encode.time_encode(df, "c", "y", "ts")
    got = {r.id: (r.c_past_mean, r.c_past_mean_n) for r in out.collect()}
    pdf = df.toPandas()
    for r in pdf.sample(300, random_state=1).itertuples():
        past = pdf[(pdf.c == r.c) & (pdf.t < r.t)]
        mean = past.y.mean() if len(past) else None
        g = got[r.id]
        assert g[1] == len(past)
        assert (g[0] is None and mean is None) or abs(g[0] - mean) < 1e-9


def test_lookup_salted_keeps_every_row_once(spark):
    df = _skewed(spark)
    table = df.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"))
    out = joins.lookup(df, table, "c", count_col="n", salt_by=["id"], salt_buckets=8)
    assert out.count() == df.count()
    assert out.select("id").distinct().count() == df.count()
    pd_out = out.toPandas()
    means = df.toPandas().groupby("c").y.mean()
    assert (abs(pd_out.m - pd_out.c.map(means)) < 1e-9).all()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan  # the hot-key list is broadcast


def test_unique_keys_check(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert [r.k for r in joins.unique_keys(df, "k").collect()] == [1]


def test_combined_encodings_equal_the_separate_encoders(spark):
    """One fit for E2, X1, X2, E1 gives what the four encoders give, under a
    hot key, with a null category and null targets."""
    df = _skewed(spark).withColumn("c", F.when(F.col("id") % 17 == 0, None).otherwise(F.col("c"))) \
        .withColumn("y", F.when(F.col("id") % 23 == 0, None).otherwise(F.col("y")))
    got = {r.id: r for r in encode.encodings(df, "c", "y", kinds=("target", "loo", "kfold",
                                                                    "frequency"),
                                             key="id", k=5).collect()}
    sep = encode.fit_target(df, "c", "y").apply(df, drop=False, salt_by=["id"])
    sep = encode.loo_encode(sep, "c", "y", salt_by=["id"])
    sep = encode.kfold_encode(sep, "c", "y", key="id", k=5)
    sep = encode.fit_frequency(df, "c").apply(sep, drop=False, salt_by=["id"])
    want = {r.id: r for r in sep.collect()}
    assert got.keys() == want.keys() and len(got) == 3000
    for i, w in want.items():
        g = got[i]
        for c in ("c_encoded", "c_loo", "c_kfold", "c_freq"):
            a, b = g[c], w[c]
            assert (a is None and b is None) or abs(a - b) < 1e-9, (i, c, a, b)


def _mixed(spark):
    rows = [(i, None if i % 11 == 0 else f"a{i % 4}", None if i % 7 == 0 else i % 3, None if i % 5 == 0 else float(i % 13))
            for i in range(200)]
    return spark.createDataFrame(rows, "id int, a string, b int, y double").repartition(5)


def test_encoders_of_one_scan_equal_separate_fits(spark):
    df = _mixed(spark)
    kinds = [("a", "frequency"), ("a", "target"), ("b", "target"), ("b", "mean"), ("y", "frequency")]
    alone = {"frequency": lambda c: encode.fit_frequency(df, c), "target": lambda c: encode.fit_target(df, c, "y"),
             "mean": lambda c: encode.fit_mean(df, c, "y")}
    for (col, kind), enc in zip(kinds, encode.fit_many(df, kinds, "y"), strict=True):
        sep = alone[kind](col)
        got, want = [{tuple(r)[0]: r for r in e.table.select(col, "n", "value").collect()} for e in (enc, sep)]
        assert got.keys() == want.keys() and None in got and enc.output == sep.output
        for k, r in want.items():
            assert got[k].n == r.n and got[k].value == pytest.approx(r.value, rel=1e-12)
        assert enc.apply(df, drop=False, salt_by=["id"]).count() == 200


def test_category_stats_of_odd_inputs(spark):
    empty = encode.category_stats(_mixed(spark).filter("id < 0"), ["a", "b"], "y")
    assert [t.count() for t in empty.values()] == [0, 0]
    assert encode.category_stats(_mixed(spark), [], "y") == {}
    twice = encode.category_stats(_mixed(spark), ["b", "b"])
    assert list(twice) == ["b"] and sum(r.n for r in twice["b"].collect()) == 200
    with pytest.raises(ValueError, match="unknown encoders"):
        encode.fit_many(_mixed(spark), [("a", "ordinal")], "y")


def test_top_n_and_encoders_share_a_scan(spark):
    from tessera.plans.features import FeatureSpec, encode_train_test

    df = _mixed(spark).select("id", "a", F.col("b").cast("string").alias("b"), F.col("a").alias("c"), "y")
    spec = FeatureSpec(key="id", label="y", text=None, hashed=["a"], reduce=["a", "c"], top_n=2,
                       encoders=[("b", "target"), ("c", "frequency")], numeric=[], indexed=[])
    train, test = encode_train_test(df, df, spec)
    top = encode.fit_top_n(df, "c", 2)
    cut = encode.reduce_cardinality(df, "c", top, n=2)
    want = encode.fit_target(df, "b", "y").apply(encode.fit_frequency(cut, "c").apply(cut, salt_by=["id"]), salt_by=["id"])
    columns = ["id", "b_encoded", "c_freq"]
    got, want = [d.select(columns).orderBy("id").toPandas().to_numpy() for d in (test, want)]
    assert got == pytest.approx(want)
    assert train.count() == 200
