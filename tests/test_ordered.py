"""Distributed prefix sums and exact quantiles against numpy / pandas."""

import numpy as np
import pandas as pd

from tessera.operators import ordered


def test_exact_quantiles_match_numpy_with_hot_value(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(50, 10, 2000).round(2), np.full(1000, 42.0)])
    df = spark.createDataFrame(pd.DataFrame({"v": vals}))
    probs = [0.0, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]
    row = ordered.exact_quantiles(df, "v", probs).first()
    want = np.quantile(vals, probs)  # linear interpolation
    assert all(abs(a - b) < 1e-9 for a, b in zip(row, want))


def test_grouped_quantiles(spark):
    pdf = pd.DataFrame({"g": ["a"] * 5 + ["b"] * 4, "v": [1, 2, 4, 9, 9, 3, 1, 2, 10]})
    df = spark.createDataFrame(pdf.astype({"v": float}))
    got = {r.g: (r.p50, r.p25) for r in ordered.exact_quantiles(df, "v", [0.5, 0.25], group=["g"]).collect()}
    for g, sub in pdf.groupby("g"):
        assert abs(got[g][0] - np.quantile(sub.v, 0.5)) < 1e-12
        assert abs(got[g][1] - np.quantile(sub.v, 0.25)) < 1e-12


def test_exclusive_prefix_matches_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["x", "y", "z"], 500, p=[0.8, 0.1, 0.1]),
                        "t": rng.permutation(500), "s": rng.integers(0, 9, 500)})
    df = spark.createDataFrame(pdf)
    got = ordered.exclusive_prefix(df, ["g"], "t", ["s"], partitions=7).toPandas()
    pdf = pdf.sort_values(["g", "t"])
    pdf["want"] = pdf.groupby("g").s.cumsum() - pdf.s
    m = got.merge(pdf, on=["g", "t"])
    assert len(m) == 500 and (m.s_before == m.want).all()


def test_grouped_quantiles_and_boxplot_with_hot_group(spark):
    """One group holds 40% of the rows (it spans several range partitions);
    quantiles, group sizes and the box plot agree with numpy."""
    from tessera.operators import profile

    rng = np.random.default_rng(11)
    g = np.concatenate([np.full(1600, "hot"), rng.choice(["a", "b", "c", "d"], 2400)])
    v = np.concatenate([rng.normal(0, 1, 1600), rng.exponential(2, 2400)]).round(3)
    pdf = pd.DataFrame({"g": g, "v": v})
    pdf.loc[pdf.index % 97 == 0, "v"] = np.nan  # nulls are ignored
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    q = {r.g: r for r in ordered.exact_quantiles(df, "v", [0.25, 0.5, 0.9], group=["g"],
                                                  with_n=True).collect()}
    box = {r.g: r for r in profile.boxplot(df, "v", group="g").collect()}
    for key, sub in pdf.dropna().groupby("g"):
        x = sub.v.to_numpy()
        want = np.quantile(x, [0.25, 0.5, 0.9])
        got = q[key]
        assert got.n == len(x)
        assert np.allclose([got.p25, got.p50, got.p90], want, atol=1e-9)
        q1, q3 = np.quantile(x, [0.25, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        b = box[key]
        assert b.n == len(x) and b.outliers == int(((x < lo) | (x > hi)).sum())
        assert abs(b.whisker_lo - x[x >= lo].min()) < 1e-9
        assert abs(b.whisker_hi - x[x <= hi].max()) < 1e-9
