import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import quality_rules as Q


def brute(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    covered = {p for k in range(len(words) - 4) if grams[tuple(words[k:k + 5])] > 1 for p in range(k, k + 5)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def test_base_figures(docs, clash):
    for df in (docs, clash):
        got = Q.judge(df, out="rules").select("text", "rules.*").collect()
        assert len(got) == df.count()
        for r in got:
            assert tuple(r)[1:7] == brute(r["text"]), r["text"]
            assert not (r["base_failed"] and r["kept"])


def test_overlapping_repeats(spark):
    texts = ["a b c d e a b c d e f", "x " * 30, "a b c d e f g a b c d e z a b c d e", "p q r s t u"]
    df = spark.createDataFrame([(t, "en", "s") for t in texts], "text string, lang string, source string")
    for r in Q.judge(df).select("text", "rules.*").collect():
        assert r["n_repeat_words"] == brute(r["text"])[4]


def test_adaptive_layer_rejects_symbols_and_keeps_clean_texts(spark):
    clean = [(i, " ".join(f"word{i * 7 + k}" for k in range(60)), "en", f"s{i % 3}") for i in range(300)]
    junk = [(1000 + i, " ".join(f"word{k}{i}###" for k in range(60)), "en", f"s{i % 3}") for i in range(30)]
    few = [(2000 + i, " ".join(f"mot{i * 7 + k}" for k in range(60)), "fr", None) for i in range(5)]
    df = spark.createDataFrame(clean + junk + few, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in Q.judge(df).filter("rules.kept").select("doc_id").collect()}
    assert kept == {r[0] for r in clean + few}


def test_filter_on_the_verdict_stays_cheap(docs):
    """A filter on the verdict may not be pushed into the window expressions."""
    plan = Q.stage(docs.sparkSession, docs, "")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("xxhash64") <= 2


def test_stage_keeps_columns(docs):
    out = Q.stage(docs.sparkSession, docs, "")
    assert out.columns == docs.columns
    assert out.filter("text is null or text = ''").count() == 0


def test_empty_table(docs):
    assert Q.judge(docs.limit(0)).collect() == []


def test_sketch_quartiles_are_close(spark):
    df = spark.range(20_000).select(
        F.concat(F.lit("w "), F.repeat(F.lit("#"), F.pmod("id", F.lit(100)).cast("int"))).alias("text"),
        F.lit("en").alias("lang"), F.lit("s").alias("source"))
    f = Q.fences(df).first()
    shares = sorted((k % 100) / (1 + k % 100) for k in range(20_000))
    lo, hi = shares[5000], shares[15000]
    assert abs(f["__max_symbol_share"] - (hi + Q.SPREAD * (hi - lo) + Q.SLACK["symbol_share"])) < 0.1


def test_short_words_and_half_duplicate_lines_are_rejected(spark):
    def words(i, n=60):
        return [f"word{i * 7 + k}" for k in range(n)]

    def lines(i, n=20):
        return [" ".join(words(i * 100 + k, 3)) for k in range(n)]

    clean = [(i, "\n".join(lines(i)), "en", f"s{i % 3}") for i in range(300)]
    # One repeated line, one symbol and somewhat shorter words are nothing unusual.
    clean += [(500 + i, "\n".join(lines(i) + ["the end"] * 2 + ["a & b"]), "en", f"s{i % 3}") for i in range(9)]
    clean += [(520 + i, " ".join(w[1:] for w in words(i + 300)), "en", f"s{i % 3}") for i in range(9)]
    soup = [(1000 + i, " ".join(chr(97 + (i + k * k) % 26) + (str(k) if k % 9 == 0 else "") for k in range(60)), "en",
             f"s{i % 3}") for i in range(9)]
    # Lines of three words repeat at a distance, so no five-word window does.
    half = [(2000 + i, "\n".join(lines(i, 10) + lines(i, 10)[::-2] + lines(i, 10)[::-2]), "en", f"s{i % 3}")
            for i in range(9)]
    df = spark.createDataFrame(clean + soup + half, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["rules"] for r in Q.judge(df, out="rules").select("doc_id", "rules").collect()}
    assert {k for k, r in got.items() if r["kept"]} == {r[0] for r in clean}


def test_half_duplicates_fail_the_adaptive_layer_alone(spark):
    clean = [(i, "\n".join(f"line{i} text{k} words{i * k}" for k in range(20)), "en", "s") for i in range(100)]
    # Every line twice, words apart: windows that repeat are too few for the base layer.
    half = [(1000 + i, "\n".join(x for k in range(10) for x in (f"same{k}", f"own{i} a{k} b{k} c{k} d{k} e{k}", f"same{k}",
                                                               f"same{k}")), "en", "s") for i in range(10)]
    df = spark.createDataFrame(clean + half, "doc_id long, text string, lang string, source string")
    rows = Q.judge(df, out="rules").select("doc_id", "rules.*").collect()
    assert not any(r["base_failed"] for r in rows)
    assert {r["doc_id"] for r in rows if r["kept"]} == {r[0] for r in clean}


def test_stage_returns_every_column_unchanged(spark, clash):
    taken = [c for c, kind in clash.dtypes if c not in ("doc_id", "text", "lang", "source", "n_chars", "kept")]
    rows = Q.stage(spark, clash, "").collect()
    assert rows and all(r[c] == "taken" for r in rows for c in taken)


def test_query_equals_brute_force(spark):
    """Base figures and verdicts; sketches of so few documents hold every value, so fences are exact."""
    import math

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    values = {}
    for r in docs:
        n, chars, symbols, dup, *_ = brute(r["text"])
        lines = [x for x in (r["text"] or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        if n:
            values.setdefault(r["lang"], []).append((symbols / chars, dup / len(lines), math.log(chars / n)))
    assert max(map(len, values.values())) < Q.SKETCH_K
    assert max(Counter((r["lang"], r["source"]) for r in docs).values()) < Q.MIN_GROUP  # fences are the languages'
    fence = {}
    for lang, rows in values.items():
        for k, name in enumerate(("symbol_share", "dup_share", "word_len")):
            x = sorted(row[k] for row in rows)
            lo, hi = x[math.ceil(0.25 * len(x)) - 1], x[math.ceil(0.75 * len(x)) - 1]
            spread = max(hi - lo, Q.SLACK[name], *([sum(x) / len(x) - hi] if k < 2 else []))
            fence[lang, name] = (lo - Q.SPREAD * spread, hi + Q.SPREAD * spread)
    want = []
    for r in docs:
        n, chars, symbols, dup, repeat, failed = brute(r["text"])
        lines = [x for x in (r["text"] or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]

        def above(count, size, name):
            usual = fence[r["lang"], name][1] * size
            return count > max(1.0, usual + math.sqrt(usual * max(0.0, 1 - fence[r["lang"], name][1])))

        out = n and (above(symbols, chars, "symbol_share") or above(dup, len(lines), "dup_share")
                     or not fence[r["lang"], "word_len"][0] <= math.log(chars / n) <= fence[r["lang"], "word_len"][1])
        want.append((r["doc_id"], n, chars, symbols, dup, repeat, failed, not failed and not out))
    got = [tuple(r) for r in Q.query(spark, sf).collect()]
    assert sorted(got) == sorted(want) and 0 < sum(r[-1] for r in got) < len(got)
