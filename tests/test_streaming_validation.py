"""Streaming application of fitted encoders; the validation report plan."""

import os
import tempfile

from pyspark.sql import functions as F

from tessera.operators import encode
from tessera.plans.validation import validation_report
from tessera.streaming.scoring import apply_stream, freeze

SF = "/root/testdata/sf0.001"


def test_stream_scoring_matches_batch(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    enc = freeze(encode.fit_target(orders, "o_custkey", "o_totalprice"))
    stream = spark.readStream.schema(orders.schema).option("pathGlobFilter", "orders.parquet") \
        .parquet(SF) \
        .select("o_orderkey", "o_custkey", "o_totalprice")
    scored = apply_stream(stream, [enc], salt_by=["o_orderkey"])
    ck = tempfile.mkdtemp(prefix="stream-ck-", dir="/tmp")
    q = (scored.writeStream.format("memory").queryName("scored_orders").outputMode("append")
         .option("checkpointLocation", ck).start())
    q.processAllAvailable()
    q.stop()
    got = {r.o_orderkey: r.o_custkey_encoded for r in spark.sql("select * from scored_orders").collect()}
    want = {r.o_orderkey: r.o_custkey_encoded for r in enc.apply(orders).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_validation_report_shapes(spark):
    movies = spark.createDataFrame(
        [("t1", "A", "2019", "Drama", 100, "D1", "W", "P", "X, Y", "good film", 10, 1.0, 2.0),
         ("t2", "B", "TV Movie 2019", "Drama", 90, "D2", "W", "P", "X", "", 5, 1.0, 1.0),
         ("t3", "C", "1975", "", 120, "D1", None, "P", "Y", "old one", 7, None, 1.0),
         ("t4", "D", "2001", "Comedy", 95, "D3", "W", "P", "Z", "fun", 3, 2.0, 0.0)],
        "imdb_title_id string, title string, year string, genre string, duration int, director string,"
        " writer string, production_company string, actors string, description string, votes long,"
        " reviews_from_users double, reviews_from_critics double")
    ratings = spark.createDataFrame([("t1", 7.0), ("t2", 6.5), ("t3", 8.0), ("t9", 1.0)],
                                    "imdb_title_id string, avg_vote double")
    rep = validation_report(movies, ratings)
    assert rep["shape"].first().rows == 4
    acc = rep["accounting"].first()
    assert (acc.original, acc.kept, acc.verdict) == (4, 1, "insufficient")
    assert rep["unparsed_years"].first().unparsed == 1
    nulls = {r.column_name: r.nulls for r in rep["null_profile"].collect()}
    assert nulls["label"] == 1 and nulls["genre"] == 1 and nulls["description"] == 1
    assert [r.imdb_title_id for r in rep["preview"].collect()] == ["t1"]
    assert rep["label_histogram"].first().bin == 7.0


def test_stream_scoring_salts_a_hot_category(spark):
    """A category with a third of the rows is salted inside the streaming
    plan; every streamed row is scored exactly once, as in batch."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    keys = np.concatenate([np.full(1000, "hot"), rng.choice([f"k{i}" for i in range(200)], 2000)])
    pdf = pd.DataFrame({"id": np.arange(3000), "cat": keys, "y": rng.normal(0, 1, 3000)})
    src = tempfile.mkdtemp(prefix="stream-src-", dir="/tmp")
    batch = spark.createDataFrame(pdf)
    batch.write.mode("overwrite").parquet(os.path.join(src, "part"))
    enc = freeze(encode.fit_frequency(batch, "cat"))
    stream = spark.readStream.schema(batch.schema).parquet(os.path.join(src, "part"))
    scored = apply_stream(stream, [enc], salt_by=["id"])
    ck = tempfile.mkdtemp(prefix="stream-ck-", dir="/tmp")
    q = (scored.writeStream.format("memory").queryName("scored_hot").outputMode("append")
         .option("checkpointLocation", ck).start())
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("select * from scored_hot").collect()
    assert len(rows) == 3000 and len({r.id for r in rows}) == 3000
    want = {r.id: r.cat_freq for r in enc.apply(batch, salt_by=["id"]).collect()}
    assert all(abs(r.cat_freq - want[r.id]) < 1e-12 for r in rows)
    assert abs(next(r.cat_freq for r in rows if r.id == 0) - 1000 / 3000) < 1e-12
