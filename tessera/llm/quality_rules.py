"""Quality rules with thresholds learned per language and source.

Two layers. The base layer is fixed: enough words, not mostly repeated
phrases. The adaptive layer compares a document's symbol share, duplicate-line
share and mean word length with fences taken from quantile sketches of its own
(language, source) group: third quartile + ``SPREAD`` x spread, and for word
length, on the log scale, the mirrored lower fence too. The spread is the
interquartile range, or how far the mean lies above the third quartile where
that is more (most documents of a group have no symbol and no repeated line);
``SLACK`` is the least. A share is judged as a count out of the document's
letters or lines: it may pass the fence by one standard deviation of such a
count, and a single symbol or repeated line never decides.

Sketches are KLL sketches, aggregated map-side, so a source with a third of
all rows is pre-aggregated before any shuffle. Group sketches are merged into
language sketches; groups of fewer than ``MIN_GROUP`` documents take their
language's fences. The fence table (one row per language and source) is
written to the shared folder before use, so every task and every retry sees
the same fences; it joins back null-safely, broadcast only if its stored size
is under the session's threshold, else by a shuffle join that AQE can split.
Everything is built-in expressions; a document's statistics never leave its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free_name, split_words, stored

#: Base layer.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Adaptive layer: spreads beyond the quartile, and the least spread per
#: feature. Shares need none; that of the word length is on the log scale.
SPREAD = 3.0
SLACK = {"symbol_share": 0.0, "dup_share": 0.0, "word_len": 0.2}
#: Groups below this many documents use their language's merged sketch.
MIN_GROUP = 50
#: KLL accuracy parameter (rank error about 0.7 %).
SKETCH_K = 400


def _cheap(df: DataFrame, text: str) -> DataFrame:
    """Adds __words, __word_chars, __n_symbols, __lines, __dup_lines and the three features."""
    blank = F.coalesce(F.col(text), F.lit(""))
    d = df.withColumn("__words", split_words(F.col(text)))
    d = d.withColumn("__n_words", F.size("__words").cast("long"))
    lines = F.filter(F.split(blank, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    d = d.withColumn("__lines", lines)
    d = d.withColumn("__word_chars", F.length(F.array_join("__words", "")).cast("long"))
    d = d.withColumn("__n_symbols", F.regexp_count(blank, F.lit(r"[#*$%&|<>]")).cast("long"))
    d = d.withColumn("__dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    return (d.withColumn("__symbol_share", F.try_divide(F.col("__n_symbols"), F.col("__word_chars")))
            .withColumn("__dup_share", F.try_divide(F.col("__dup_lines"), F.size("__lines")))
            .withColumn("__word_len", F.ln(F.try_divide(F.col("__word_chars"), F.col("__n_words")))))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds __n_repeat: words inside 5-word windows that the text holds twice or more.

    Windows are compared by their 64-bit hash inside one text. Texts whose
    windows are all different (the usual case) stop after one hash set; the
    others sort (hash, place) once and measure the union of the places.
    """
    n = F.size("__words")
    grams = F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("__words"), i, WINDOW))))
    d = df.withColumn("__grams", grams)
    d = d.withColumn("__sorted", F.when(
        F.size(F.array_distinct("__grams")) < F.size("__grams"),
        F.sort_array(F.transform("__grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def repeated(x: Column, k: Column) -> Column:
        same = lambda at: F.coalesce(F.get(F.col("__sorted"), at)["h"] == x["h"], F.lit(False))
        return same(k - 1) | same(k + 1)

    d = d.withColumn("__places", F.sort_array(F.transform(F.filter("__sorted", repeated), lambda x: x["i"])))
    covered = F.aggregate(
        "__places", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        lambda acc: acc["n"])
    return d.withColumn("__n_repeat", F.coalesce(covered, F.lit(0)).cast("long"))


_FEATURES = ("symbol_share", "dup_share", "word_len")


def fences(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per (language, source): __lang, __source and an upper (and lower) fence per feature.

    Documents without words say nothing; null languages and sources are
    groups of their own. Sketches are of all documents, not a sample.
    """
    d = _cheap(docs.select(F.col(lang).alias("__lang"), F.col(source).alias("__source"),
                           F.col(text).alias("__text")), "__text").filter("__n_words > 0")
    group = d.groupBy("__lang", "__source").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.kll_sketch_agg_double(F.col(f"__{f}"), F.lit(SKETCH_K)).alias(f) for f in _FEATURES],
        *[F.sum(f"__{f}").alias(f"sum_{f}") for f in _FEATURES])
    group = stored(group, "quality-sketches")
    language = group.groupBy(F.col("__lang").alias("__l")).agg(
        F.sum("n").alias("l_n"),
        *[F.kll_merge_agg_double(F.col(f), F.lit(SKETCH_K)).alias(f"l_{f}") for f in _FEATURES],
        *[F.sum(f"sum_{f}").alias(f"l_sum_{f}") for f in _FEATURES])
    g = group.join(language, F.col("__lang").eqNullSafe(F.col("__l")))
    out = []
    for f in _FEATURES:
        own = F.col("n") >= MIN_GROUP
        sketch = F.when(own, F.col(f)).otherwise(F.col(f"l_{f}"))
        mean = F.when(own, F.col(f"sum_{f}") / F.col("n")).otherwise(F.col(f"l_sum_{f}") / F.col("l_n"))
        lo, hi = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        spread = F.greatest(hi - lo, F.lit(SLACK[f]), *([] if f == "word_len" else [mean - hi]))
        out += [(hi + F.lit(SPREAD) * spread).alias(f"__max_{f}"), (lo - F.lit(SPREAD) * spread).alias(f"__min_{f}")]
    return stored(g.select("__lang", "__source", *out), "quality-fences")


def _above(count: Column, size: Column, fence: Column) -> Column:
    """Whether a count out of ``size`` is more than the fence, one deviation of such a count and one explain."""
    usual = fence * size
    return F.coalesce(count > F.greatest(F.lit(1.0), usual + F.sqrt(usual * F.greatest(F.lit(0.0), 1 - fence))),
                      F.lit(False))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          out: str = "rules") -> DataFrame:
    """All rows and columns of ``docs`` plus a struct column ``out``.

    Its fields: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept. Null and blank texts have no words and fail the base
    layer. A column already named ``out`` is replaced; any other column stays,
    whatever its name: a row's own columns travel as one struct. Repeated rows stay
    repeated; an empty table gives an empty result.
    """
    names = [c for c in docs.columns if c != out]
    table = fences(docs, text, lang, source).withColumnsRenamed({"__lang": "__fl", "__source": "__fs"})
    own = F.struct(*[F.col(c) for c in names], F.lit(True).alias(free_name(names, "any")))
    d = docs.select(own.alias("__row"), F.col(text).alias("__text"), F.col(lang).alias("__lang"), F.col(source).alias("__source"))
    d = _repeat_words(_cheap(d, "__text"))
    d = d.join(table, F.col("__lang").eqNullSafe(F.col("__fl")) & F.col("__source").eqNullSafe(F.col("__fs")), "left")
    base_failed = (F.col("__n_words") < MIN_WORDS) | (
        100 * F.col("__n_repeat") > MAX_REPEAT_PERCENT * F.col("__n_words"))
    outlier = (_above(F.col("__n_symbols"), F.col("__word_chars"), F.col("__max_symbol_share"))
               | _above(F.col("__dup_lines"), F.size("__lines"), F.col("__max_dup_share"))
               | F.coalesce(F.col("__word_len") > F.col("__max_word_len"), F.lit(False))
               | F.coalesce(F.col("__word_len") < F.col("__min_word_len"), F.lit(False)))
    verdict = F.struct(
        F.col("__n_words").alias("n_words"), F.col("__word_chars").alias("word_chars"),
        F.col("__n_symbols").alias("n_symbols"), F.col("__dup_lines").alias("n_dup_lines"),
        F.col("__n_repeat").alias("n_repeat_words"), base_failed.alias("base_failed"),
        (~base_failed & ~outlier).alias("kept"))
    # A one-row generator: a caller's filter on the verdict must not be pushed below
    # it, where the optimizer would write the window expressions out many times over.
    judged = d.select("__row", F.explode(F.array(verdict)).alias("__verdict"))
    return judged.select(*[F.col("__row")[c].alias(c) for c in names], F.col("__verdict").alias(out))


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's base figures and the verdict of both layers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return judge(docs, out="__rules").select("doc_id", "__rules.*")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that both layers keep, with their own columns, whatever these are called."""
    out = free_name(docs.columns, "rules")
    return judge(docs, out=out).filter(F.col(out)["kept"]).select(*docs.columns)
