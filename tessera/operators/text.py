"""M1, M2, M4 as relational statistics over whole texts.

Term statistics need, per term, the number of occurrences and the number
of documents containing it. Both come out of one shuffle: each document's
tokens are sorted inside the row (no shuffle), a token is flagged when it
differs from its predecessor (its first occurrence in that document), and
one grouped aggregate by term sums occurrences and flags. Stop words are
removed with a broadcast anti-join against the fixed stop list (a hash
probe per token instead of a scan of the list).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import english_stop_words, tokens


def stop_table(spark, stop=None) -> DataFrame:
    """The stop list as a one-column DataFrame (fixed size: safe to broadcast)."""
    stop = stop if stop is not None else english_stop_words()
    return spark.range(1).select(F.explode(F.array(*[F.lit(w) for w in stop])).alias("term"))


def token_rows(docs: DataFrame, text: str, keep: list[str] | None = None,
               first_flag: bool = False, stop=None) -> DataFrame:
    """One row per content token: (keep..., term[, first]).

    ``first`` marks the first occurrence of the term in its document.
    """
    keep = keep or []
    toks = tokens(text)
    if first_flag:
        # The sorted array is its own column so the lambda reads it instead
        # of re-sorting per element.
        sorted_docs = docs.select(*keep, F.sort_array(toks).alias("__toks"))
        s = F.col("__toks")
        flags = F.transform(s, lambda x, i: F.when(i == 0, F.lit(True))
                            .otherwise(x != F.element_at(s, i)))
        exploded = sorted_docs.select(
            *keep, F.inline(F.arrays_zip(s.alias("term"), flags.alias("first"))))
    else:
        exploded = docs.select(*keep, F.explode(toks).alias("term"))
    stop_df = F.broadcast(stop_table(docs.sparkSession, stop))
    return exploded.join(stop_df, on="term", how="left_anti")


def term_counts(docs: DataFrame, text: str) -> DataFrame:
    """(term, n occurrences, docs containing it) in one shuffle."""
    rows = token_rows(docs, text, first_flag=True)
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("n"),
                                    F.count_if(F.col("first")).alias("docs"))


def idf_terms(docs: DataFrame, text: str) -> DataFrame:
    """M4 per term: df and ln((m + 1) / (df + 1)), m = number of documents."""
    m = docs.select(F.count(F.lit(1)).cast("double")).scalar()
    rows = token_rows(docs, text, first_flag=True).filter(F.col("first"))
    g = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return g.select("term", "df", F.log((m + 1) / (F.col("df") + 1)).alias("idf"))
