import hashlib
import re

from pyspark.sql import functions as F

from tessera.llm import decontamination as D

A = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
ITEMS = [(1, A), (1, A), (2, "Short item Here"), (3, "the the the the the the the the the the the the the the"),
         (4, None), (5, " .,- "), (None, "no id but eight words are in this"), (6, "ünï cödé wörds " * 5)]


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for k, t in items:
        v = words(t)
        n = min(len(v), 13)
        grams = {tuple(v[s:s + n]) for s in range(len(v) - n + 1)} if n else set()
        for p in range(len(w) - n + 1) if n else ():
            if tuple(w[p:p + n]) in grams:
                hit.update(range(p, p + n))
                ids.add("" if k is None else str(k))
    return (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(),
            bool(hit) and 20 * len(hit) >= len(w))


TEXTS = [None, "", "...", A, "x " + A.upper() + " y", A.replace("seven", "zzz"), "a short ITEM, here! " * 2,
         "the " * 40, "no id but eight words are in this", "ünï CöDé wörds " * 9, "pad " * 900 + A, A[:60],
         " ".join(A.split()[1:14]), "nothing to see"]


def frames(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, A, "x"), (3, A, "x"), (3, "other", "x")],
                                 "doc_id long, text string, item string").repartition(3)
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


def test_matches_brute_force(spark):
    docs, items = frames(spark)
    got = sorted((str(r["__key"]), *tuple(r)[2:]) for r in D.judge(docs, items).collect())
    assert got == sorted((str(r["doc_id"]), *brute(r["text"], ITEMS)) for r in docs.collect())


def test_shuffled_joins_give_the_same(spark):
    docs, items = frames(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted((str(r["__key"]), *tuple(r)[2:]) for r in D.judge(docs, items).collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted((str(r["doc_id"]), *brute(r["text"], ITEMS)) for r in docs.collect())


def test_proximity_finds_reordered_windows(spark):
    docs = spark.createDataFrame([(1, A), (2, " ".join(reversed(A.split()))), (3, "nothing alike"),
                                  (4, A.replace(" ", " filler" * 9 + " "))], "doc_id long, text string")
    items = spark.createDataFrame([(1, A)], "item_id long, text string")
    near = {r["__key"] for r in D.proximity(docs, items, slop=4).collect()}
    assert near == {1, 2}
    far = {r["__key"] for r in D.proximity(docs, items, slop=60).collect()}
    assert far == {1, 2, 4}
    assert {r["__key"] for r in D.phrases(docs, items).collect()} == {1}


def test_empty_tables(spark):
    docs, items = frames(spark)
    assert D.judge(docs.limit(0), items).collect() == []
    assert D.judge(docs, items.limit(0)).filter("n_hit > 0 or contaminated").count() == 0


def test_stage_drops_contaminated_rows_only(spark, clash, tmp_path):
    frames(spark)[1].write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = clash.unionByName(clash.limit(1).withColumn("text", F.lit(A)))
    out = D.stage(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.count() == clash.count()


def test_stage_returns_every_column_unchanged(spark, clash, tmp_path):
    spark.createDataFrame([("i", A)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    taken = [c for c, kind in clash.dtypes if c not in ("doc_id", "text", "lang", "source", "n_chars", "kept")]
    rows = D.stage(spark, clash, str(tmp_path)).collect()
    assert rows and all(r[c] == "taken" for r in rows for c in taken)


def test_a_one_word_item_in_a_long_document(spark):
    docs = spark.createDataFrame([(1, "the end of the " * 4000), (2, "none")], "doc_id long, text string")
    bench = spark.createDataFrame([("i", "The"), ("j", "end of"), ("k", "of end")], "item_id string, text string")
    got = {r["__key"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in D.judge(docs, bench).collect()}
    assert got == {1: (16_000, 16_000, 2), 2: (1, 0, 0)}
