"""Benchmark decontamination through a distributed positional inverted index.

1. Corpus frequencies of the benchmark's terms (one scan, partial aggregates).
2. Every window of every benchmark item picks its ``RAREST`` rarest places.
3. Postings (document, position) of the chosen terms are stored: one scan, and
   the index holds rare terms only, so it is a small part of the corpus.
4. Each posting is shifted by its term's offset in the item; postings that agree
   on (item, document, shift) are intersected: a window is a candidate where
   all its chosen places meet.
5. Candidates are confirmed word by word against the document, which gives the
   exact phrase matches; ``proximity`` gives unordered near matches from the
   same postings.

Every join is an equi-join on a term, a document or an item. Benchmark-side
tables are stored, so Spark broadcasts them only when their size is under its
threshold and otherwise shuffles with AQE's skew splitting. A frequent term's
postings are spread over (item, document, shift) before they are grouped. All
steps are DataFrame operations. A document is known by its id and a hash of its
text, so repeated and null ids are safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, stored

#: Words of a window, and rare places of a window whose postings are intersected.
WINDOW, RAREST = 13, 3
#: A document is contaminated if hit words are at least one in so many.
SHARE = 20

_BREAKS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_SPLIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _raw_words(text: Column) -> Column:
    """Runs of ASCII letters and digits and non-ASCII characters, case kept; null and blank have none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BREAKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _SPLIT))


def _lower(word: Column) -> Column:
    return F.when(word.rlike("[A-Z]"), F.translate(word, ASCII_UPPER, ASCII_LOWER)).otherwise(word)


def _documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("__key"), F.xxhash64(F.col(text)).alias("__hash"),
                       _raw_words(F.col(text)).alias("__words"))


def _tokens(docs: DataFrame) -> DataFrame:
    return docs.select("__key", "__hash", F.posexplode("__words").alias("pos", "word")).select(
        "__key", "__hash", "pos", _lower(F.col("word")).alias("term"))


def items_of(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, id, words): distinct (id, words) pairs with at least one word; a null id is ''."""
    rows = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"),
                            F.transform(_raw_words(F.col(text)), _lower).alias("words"))
    rows = rows.filter(F.size("words") > 0).distinct()
    return rows.select(F.sha2(F.concat_ws(" ", "id", F.array_join("words", " ")), 256).alias("item"), "id", "words")


def index(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
          item_key: str = "item_id", item_text: str = "text", window: int = WINDOW):
    """(documents, items, plans, postings).

    items: item, id, words; plans: item, windows (array of start, len, need:
    the offsets of the rarest places); postings: term, __key, __hash, pos of
    every chosen term, stored.
    """
    d = _documents(docs, key, text)
    items = stored(items_of(benchmark, item_key, item_text), "items")
    places = items.select("item", F.posexplode("words").alias("offset", "term"))
    terms = stored(places.select("term").distinct(), "terms")
    counts = stored(_tokens(d).join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term-counts")
    size = F.size("words")
    windows = items.select("item", F.explode(F.sequence(F.lit(0), F.greatest(size - window, F.lit(0)))).alias("start"),
                           F.least(size, F.lit(window)).alias("len"))
    rank = Window.partitionBy("item", "start").orderBy(F.coalesce("n", F.lit(0)), "offset")
    chosen = stored(
        windows.join(places, "item").filter("offset >= start and offset < start + len")
        .join(counts, "term", "left").withColumn("rank", F.row_number().over(rank))
        .filter(F.col("rank") <= RAREST), "chosen")
    plans = stored(
        chosen.groupBy("item", "start", "len").agg(F.collect_list("offset").alias("need"))
        .groupBy("item").agg(F.collect_list(F.struct("start", "len", "need")).alias("windows")), "windows")
    rare = stored(chosen.select("term").distinct(), "rare-terms")
    postings = stored(_tokens(d).join(rare, "term"), "postings")
    return d, items, plans, postings, chosen


def phrases(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text",
            item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(__key, __hash, id, at, len): every occurrence of a window, exact, per document and item."""
    d, items, plans, postings, chosen = index(docs, benchmark, key, text, item_key, item_text, window)
    spots = chosen.select("term", "item", "offset").distinct()
    met = (postings.join(spots, "term")
           .groupBy("item", "__key", "__hash", (F.col("pos") - F.col("offset")).alias("shift"))
           .agg(F.collect_set("offset").alias("have")))
    # A window of three or more words needs RAREST places, so lone ones end here
    # unless the item itself is shorter. A candidate is numbers: its item's words
    # are joined only to the few words of the document that it is compared with.
    candidates = (met.join(plans, "item")
                  .withColumn("open", F.filter("windows", lambda w: F.size(F.array_except(w["need"], F.col("have"))) == 0))
                  .select("__key", "__hash", "item", "shift", F.explode("open").alias("w"))
                  .filter(F.col("shift") + F.col("w.start") >= 0)
                  .groupBy("__key", "__hash").agg(F.collect_list(F.struct(
                      "item", (F.col("shift") + F.col("w.start")).alias("at"), F.col("w.start").alias("start"),
                      F.col("w.len").alias("len"))).alias("found")))
    candidates = stored(candidates, "candidates")
    keys = candidates.select(F.col("__key").alias("k"), F.col("__hash").alias("h"))
    same = lambda a, b: F.col("__key").eqNullSafe(F.col(a)) & (F.col("__hash") == F.col(b))
    c = candidates.select(F.col("__key").alias("ck"), F.col("__hash").alias("ch"), "found")
    texts = d.join(keys, same("k", "h"), "left_semi").join(c, same("ck", "ch"))
    words = texts.select("__key", "__hash", F.transform("__words", _lower).alias("__low"), "found")
    exact = words.select("__key", "__hash", "__low", F.explode("found").alias("f")).select(
        "__key", "__hash", "f.*", F.slice("__low", F.col("f.at") + 1, F.col("f.len")).alias("part"))
    return (exact.join(items, "item").filter(F.col("part") == F.slice("words", F.col("start") + 1, F.col("len")))
            .select("__key", "__hash", "id", "at", "len").distinct())


def proximity(docs: DataFrame, benchmark: DataFrame, slop: int, key: str = "doc_id", text: str = "text",
              item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(__key, __hash, id, start): windows whose chosen terms all occur, in any order, within
    ``len + slop`` consecutive words of the document.

    Positions are dealt into two layers of overlapping blocks of twice that
    span, so every such stretch lies whole in one block and a frequent term's
    postings spread over blocks.
    """
    _, items, _, postings, chosen = index(docs, benchmark, key, text, item_key, item_text, window)
    need = chosen.groupBy("item", "start", "len").agg(F.collect_set("term").alias("need"))
    spots = chosen.select("term", "item", "start", "len").distinct()
    span = F.col("len") + slop
    blocks = F.array(F.floor(F.col("pos") / (2 * span)) * 2, F.floor((F.col("pos") + span) / (2 * span)) * 2 - 1)
    met = (postings.join(spots, "term").withColumn("block", F.explode(blocks))
           .groupBy("item", "start", "len", "__key", "__hash", "block")
           .agg(F.sort_array(F.collect_set(F.struct("pos", "term"))).alias("have"))
           .join(need, ["item", "start", "len"]))
    near = F.exists("have", lambda a: F.size(F.array_except(F.col("need"), F.transform(
        F.filter("have", lambda b: (b["pos"] >= a["pos"]) & (b["pos"] < a["pos"] + span)), lambda b: b["term"]))) == 0)
    return met.filter(near).join(items, "item").select("__key", "__hash", "id", "start").distinct()


def judge(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: __key, __hash, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and word-less texts have no words and are clean; items without words
    are never found; items that repeat count once, items of one id together;
    an empty benchmark leaves everything clean. Repeated rows stay repeated.
    Other columns of either table are not read.
    """
    found = phrases(docs, benchmark, key, text)
    hits = stored(found.groupBy("__key", "__hash").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(
            F.sequence(F.col("at"), F.col("at") + F.col("len") - 1))))).cast("long").alias("__n_hit"),
        F.sort_array(F.collect_set("id")).alias("__ids")), "hits")
    hits = hits.select(F.col("__key").alias("k"), F.col("__hash").alias("h"), "__n_hit", "__ids")
    d = _documents(docs, key, text).select("__key", "__hash", F.size("__words").cast("long").alias("n_words"))
    n_hit = F.coalesce("__n_hit", F.lit(0)).cast("long")
    ids = F.coalesce("__ids", F.array().cast("array<string>"))
    return (d.join(hits, F.col("__key").eqNullSafe(F.col("k")) & (F.col("__hash") == F.col("h")), "left")
            .select("__key", "__hash", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                    F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                    ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated")))


def query(spark, sf_dir: str) -> DataFrame:
    """Every document held against every benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumnRenamed(
        "__key", "doc_id").drop("__hash")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that are not contaminated, with their own columns, whatever these are called."""
    bad = judge(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated").select(
        F.col("__key").alias("__k"), F.col("__hash").alias("__h")).distinct()
    bad = stored(bad, "contaminated")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    clean = rows.join(bad, F.col("id").eqNullSafe(F.col("__k")) & (F.col("hash") == F.col("__h")), "left_anti")
    return clean.select(*[F.col("row")[c].alias(c) for c in docs.columns])


ORACLE = r"""
with d as (select row_number() over () as i, doc_id, list_filter(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
b as (select distinct coalesce(item_id::varchar, '') as id, list_filter(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
win as (select id, least(len(w), 13) as n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') as gram
        from b, unnest(range(1, greatest(len(w) - 13, 0) + 2)) as t(s) where len(w) > 0),
sizes as (select distinct n from win),
g as (select i, s, n, array_to_string(w[s:s + n - 1], ' ') as gram
      from d, sizes, unnest(range(1, len(w) - n + 2)) as t(s) where len(w) >= n),
hit as (select distinct i, s, g.n, id from g join win using (n, gram)),
words as (select i, count(distinct p) as n_hit from hit, unnest(range(s, s + n)) as t(p) group by i),
ids as (select i, count(distinct id) as n_items, string_agg(distinct id, ',' order by id) as ids from hit group by i)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
from d left join words using (i) left join ids using (i)
"""
