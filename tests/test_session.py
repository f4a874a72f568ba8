"""Session sizing and lineage-cut settings."""

from tessera.session import MAX_SHUFFLE_PARTITIONS, ensure_checkpoint_dir, scale_conf


def test_scale_conf_grows_with_input_and_is_capped():
    small = scale_conf(2 << 30, cores=8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16  # two per core at least
    mid = scale_conf(10 << 40, cores=2000)
    assert int(mid["spark.sql.shuffle.partitions"]) == 10 * 1024  # one per GB
    big = scale_conf(100 << 40, cores=8000)
    assert int(big["spark.sql.shuffle.partitions"]) == MAX_SHUFFLE_PARTITIONS
    assert int(big["spark.sql.files.maxPartitionBytes"]) == 512 << 20


def test_checkpoint_dir_is_reliable_and_reused(spark):
    a = ensure_checkpoint_dir(spark)
    assert a and ensure_checkpoint_dir(spark) == a


def test_spread_only_where_asked(spark):
    from tessera.sources.sinks import SPREAD_CONF, spread_if_asked

    one = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert spread_if_asked(one) is one
    spark.conf.set(SPREAD_CONF, "3")
    try:
        assert spread_if_asked(one).rdd.getNumPartitions() == 3
        assert spread_if_asked(one).count() == one.count()
    finally:
        spark.conf.unset(SPREAD_CONF)


def test_stored_tables_prune_columns_and_keep_metadata(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    from tessera.session import stored

    df = spark.range(100).select("id", (F.col("id") % 7).alias("a b"), F.lit(None).cast("string").alias("c"))
    kept = stored(VectorAssembler(inputCols=["id", "a b"], outputCol="v").transform(df), "test")
    assert kept.count() == 100 and kept.filter("id = 41").first()["v"].toArray().tolist() == [41.0, 6.0]
    assert kept.schema["v"].metadata["ml_attr"]["num_attrs"] == 2
    plan = kept.filter("id > 90").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan and "GreaterThan(id,90)" in plan
    assert stored(df.filter("id < 0"), "test").collect() == []
