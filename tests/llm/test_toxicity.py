import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import toxicity as X


def corpus(n, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(5, 120))]
        toxic = int(i % 6 == 0)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vileword", "nastything", "nastything", "grrr" + rng.choice("xyz")])
        rows.append((i, " ".join(words), toxic))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(3000)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 5], "doc_id long, label int")
    got = {r["doc_id"]: r["score"] for r in X.score(docs, X.fit(docs, labels)).collect()}
    held = [(got[i] >= 0.5, y) for i, _, y in rows if i % 5 == 0]
    assert np.mean([p == y for p, y in held]) > 0.97
    assert np.mean([p for p, y in held if y]) > 0.9


def test_ftrl_matches_a_plain_loop():
    texts, labels = [t for _, t, _ in corpus(60)], np.array([y for *_, y in corpus(60)], float)
    at, w = X.ftrl(texts, labels, passes=1)
    size, l1 = (1 << X.HASH_BITS) + 1, X.L1_ROOT * np.sqrt(60)
    z, n = {}, {}
    odds = (labels.sum() + 1) / (60 - labels.sum() + 1)
    z[size - 1] = -np.log(odds) * (X.BETA / X.ALPHA + X.L2) - np.sign(np.log(odds)) * l1

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= l1 and i < size - 1:
            return 0.0
        return (np.sign(zi) * l1 - zi) / ((X.BETA + np.sqrt(n.get(i, 0.0))) / X.ALPHA + X.L2)

    for t, y in zip(texts, labels, strict=True):
        rows = {*X.features(t).tolist(), size - 1}
        p = 1 / (1 + np.exp(-sum(weight(i) for i in rows)))
        for i, wi in [(i, weight(i)) for i in rows]:
            g, old = p - y, n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (np.sqrt(old + g * g) - np.sqrt(old)) / X.ALPHA * wi
            n[i] = old + g * g
    want = {i: weight(i) for i in z if weight(i) != 0.0}
    assert dict(zip(at.tolist(), w, strict=True)).keys() == want.keys()
    assert np.allclose([want[i] for i in at.tolist()], w)


def test_cache_bound_does_not_change_features(monkeypatch):
    texts = [t for _, t, _ in corpus(40)]
    whole = [X.features(t).tolist() for t in texts]
    monkeypatch.setattr(X, "CACHE_WORDS", 20)
    assert [X.features(t).tolist() for t in texts] == whole


def test_edges(spark, clash):
    none = spark.createDataFrame([], "doc_id long, label int")
    flat = X.score(clash, X.fit(clash, none)).collect()
    assert len(flat) == clash.count() and {r["score"] for r in flat} == {0.5}
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 1), (3, 0), (3, 1), (99, 1)], "doc_id long, label int")
    scored = X.score(clash, X.fit(clash, labels))
    assert "text" not in scored.columns and scored.filter("score is null or score < 0 or score > 1").count() == 0
    assert X.score(clash.limit(0), X.fit(clash, labels)).collect() == []


def test_query_shape(spark):
    df = X.query(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "held_out", "score", "predicted"]
    assert df.count() == 200 and df.filter(F.col("predicted") != (F.col("score") >= 0.5).cast("int")).count() == 0


def test_groups_without_rows_do_not_halve_the_weights(spark):
    docs = spark.createDataFrame([(1, "one vile text"), (2, "a fine text")], "doc_id long, text string")
    one = X.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, label int")).collect()
    at, w = X.ftrl(["one vile text"], np.array([1.0]))
    assert {r["coordinate"]: round(r["weight"], 12) for r in one} == dict(zip(at.tolist(), w.round(12), strict=True))


def test_one_id_with_many_texts_stays_within_the_bound(spark, monkeypatch):
    monkeypatch.setattr(X, "SAMPLE", 60)
    rows = [(1, f"text {k % 700}") for k in range(2000)] + [(k, f"other {k}") for k in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id long, label int")
    seen = []
    real = X.stored
    monkeypatch.setattr(X, "stored", lambda df, name: seen.append(real(df, name)) or seen[-1])
    X.fit(docs, labels).collect()
    n = seen[0].filter("coordinate < 0").agg(F.sum("weight")).first()[0]
    assert 20 <= n <= 120
