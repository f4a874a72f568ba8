"""Scalar expressions on inline rows."""

from decimal import Decimal

from pyspark.sql import functions as F

from tessera.functions import scalars as H
from tessera.functions import predicates as P
from tessera.functions import text as M


def test_year_digits_and_strict(spark):
    df = spark.createDataFrame([("2019",), ("TV Movie 2019",), ("",), (None,), ("2019-20",)], "year string")
    rows = df.select(H.year_digits("year").alias("d"), H.year_strict("year").alias("s")).collect()
    assert [(r.d, r.s) for r in rows] == [(2019, 2019), (2019, None), (None, None), (None, None),
                                          (201920, None)]


def test_decade_flags_and_duration(spark):
    df = spark.createDataFrame([(1979, 90), (1980, 91), (2015, 120), (2014, 121)], "y int, d int")
    rows = df.select(H.decade("y").alias("dec"), H.is_recent("y").alias("r"),
                     H.is_old_classic("y").alias("o"), H.duration_category("d").alias("c")).collect()
    assert [tuple(r) for r in rows] == [(1970, 0.0, 1.0, "short"), (1980, 0.0, 1.0, "medium"),
                                        (2010, 1.0, 0.0, "medium"), (2010, 0.0, 0.0, "long")]


def test_duration_bin_left_closed(spark):
    df = spark.createDataFrame([(79,), (80,), (100,), (149,), (200,), (None,)], "d int")
    got = [r[0] for r in df.select(H.duration_bin("d")).collect()]
    assert got == ["<80", "80-100", "100-120", "120-150", ">200", None]


def test_tenth_bin_guard(spark):
    df = spark.createDataFrame([(0.7,), (6.9,), (7.0,), (9.99,)], "x double")
    got = [r[0] for r in df.select(H.tenth_bin("x")).collect()]
    assert got == [0.7, 6.9, 7.0, 9.9]


def test_round_half_up_snaps_ties(spark):
    df = spark.createDataFrame([(232.56792449999997,), (2.675,), (-0.0,)], "x double")
    got = [r[0] for r in df.select(H.round_half_up(F.col("x"), 6)).collect()]
    assert got[0] == 232.567925 and got[1] == 2.675 and str(got[2]) == "0.0"


def test_ratios_and_log(spark):
    df = spark.createDataFrame([(100, 4.0, 5.0)], "v long, u double, c double")
    r = df.select(H.votes_per_review("v", "u", "c").alias("a"), H.review_ratio("u", "c").alias("b"),
                  H.log_votes("v").alias("l")).first()
    assert r.a == 10.0 and abs(r.b - 4 / 6) < 1e-12 and abs(r.l - 4.61512051684126) < 1e-12


def test_money_parse(spark):
    df = spark.createDataFrame([("$ 2250",), ("INR 1000",), ("EUR 1,234.50",), (None,), ("n/a",)], "m string")
    rows = df.select(H.money_currency("m").alias("c"), H.money_amount("m").alias("a")).collect()
    assert [(r.c, r.a) for r in rows] == [("$", Decimal("2250.00")), ("INR", Decimal("1000.00")),
                                          ("EUR", Decimal("1234.50")), (None, None), (None, None)]


def test_split_multi(spark):
    df = spark.createDataFrame([("A, B,C",), ("",), (None,)], "s string")
    got = [r[0] for r in df.select(H.split_multi("s")).collect()]
    assert got == [["A", "B", "C"], [], None]


def test_missing_is_type_aware(spark):
    # comparing a numeric column with '' would raise under ANSI
    df = spark.createDataFrame([(None, ""), (1, "x"), (2, None)], "n int, s string")
    r = df.agg(F.count_if(P.missing(df, "n")).alias("n"), F.count_if(P.missing(df, "s")).alias("s")).first()
    assert (r.n, r.s) == (1, 2)


def test_tokens_match_ml_tokenizer(spark):
    from pyspark.ml.feature import RegexTokenizer, StopWordsRemover

    df = spark.createDataFrame([(1, "The été movie, a GREAT one: isn't it? Yes!!"), (2, "")], "id int, t string")
    tok = RegexTokenizer(inputCol="t", outputCol="w", pattern=r"\W+", minTokenLength=3).transform(df)
    ml = StopWordsRemover(inputCol="w", outputCol="f").transform(tok)
    sql = df.select("id", M.without_stop_words(M.tokens("t")).alias("f2"))
    got = {r.id: (r.f, r.f2) for r in ml.join(sql, "id").collect()}
    assert all(a == b for a, b in got.values())
    assert got[1][0] == ["movie", "great", "one", "isn", "yes"]


def test_blend_identity(spark):
    df = spark.createDataFrame([(1.5, 1.5, 1.5)], "a double, b double, c double")
    assert abs(df.select(H.blend(["a", "b", "c"])).first()[0] - 1.5) < 1e-12
