"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: every lower-cased word, the word's first letters (two
stem lengths, so unseen inflections of a known stem still count), word
bigrams, and skip-grams that leave one word out, each hashed to one of
2^HASH_BITS coordinates and counted once.

Fitting is bounded: about ``SAMPLE`` labelled texts are chosen by hashes of
their id and text, dealt into ``GROUPS`` groups, and each group is fitted in its own task
with per-coordinate learning rates and L1 sparsity; the groups' weights are
averaged by a Spark aggregate, each by its number of rows. What comes to the driver and is broadcast is at
most 2^HASH_BITS weights, mostly zero. Scoring reads every text whole in one
pass without a shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

HASH_BITS = 20
#: Documented bound of the fit: expected number of labelled texts, groups, passes.
SAMPLE, GROUPS, PASSES = 16_384, 2, 2
#: FTRL-proximal: learning rate scale and smoothing, L2 strength, and L1 strength per
#: square root of a group's rows (a coordinate without signal drifts that far).
ALPHA, BETA, L2, L1_ROOT = 1.0, 1.0, 1.0, 0.19
#: Letters of the two stem features.
STEMS = (4, 5)
#: Words a worker remembers hashes of.
CACHE_WORDS = 300_000

_MASK = np.uint64((1 << HASH_BITS) - 1)
_WORD = re.compile(r"[^\W_]+")


class _Hashes(dict):
    """word -> place in a table of (word, stem, stem) hashes."""

    def __init__(self):
        super().__init__()
        self.rows: list[tuple[int, ...]] = []
        self.table = np.zeros((0, 1 + len(STEMS)), np.uint64)

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest
        self[word] = place = len(self.rows)
        self.rows.append((h(word, 1), *(h(word[:k], 10 + k) for k in STEMS)))
        return place

    def of(self, words: list[str]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.rows.clear()
            self.table = self.table[:0]
        places = [self[w] for w in words]
        if len(self.table) < len(self.rows):
            self.table = np.concatenate([self.table, np.array(self.rows[len(self.table):], np.uint64)])
        return self.table[places]


_HASHES = _Hashes()


def features(text: str | None) -> np.ndarray:
    """Coordinates of a text, repeats included."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.int64)
    h = _HASHES.of(words)
    one = h[:, 0]
    pair = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] + np.uint64(0x7F4A7C15))
    skip = (one[:-2] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (one[2:] + np.uint64(0x165667B1))
    mixed = np.concatenate([h.ravel(), pair ^ (pair >> np.uint64(29)), skip ^ (skip >> np.uint64(31))])
    return (mixed >> np.uint64(7) & _MASK).astype(np.int64)


def ftrl(texts: list[str | None], labels: np.ndarray, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) that are not zero; coordinate 2^HASH_BITS is the intercept."""
    size = (1 << HASH_BITS) + 1
    z, n, l1 = np.zeros(size), np.zeros(size), L1_ROOT * np.sqrt(len(texts))

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        w = (np.sign(zi) * l1 - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where((np.abs(zi) <= l1) & (at < size - 1), 0.0, w)

    # The intercept starts at the log-odds of the labels, so common words have nothing to explain.
    odds = (labels.sum() + 1.0) / (len(labels) - labels.sum() + 1.0)
    z[-1] = -np.log(odds) * (BETA / ALPHA + L2) - np.sign(np.log(odds)) * l1
    rows = [np.append(np.unique(features(t)), size - 1) for t in texts]
    for _ in range(passes):
        for at, y in zip(rows, labels, strict=True):
            w = weights(at)
            p = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35.0, 35.0)))
            g = p - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    every = weights(np.arange(size))
    at = np.flatnonzero(every)
    return at, every[at]


def _share(c, part: str, share: float):
    """Rows whose hash falls into this share."""
    return F.pmod(F.xxhash64(*c, F.lit(part)), F.lit(1 << 30)) < int(share * (1 << 30))


def fit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(coordinate, weight) from about SAMPLE labelled texts; ``labels`` is (doc_id, label in 0/1).

    First about SAMPLE ids are chosen by hash. If they have more than that many different
    texts (an id can repeat), as many of these are chosen by a hash of id and text.
    Rows without id or label are left out; a text that repeats under its id counts once;
    an id labelled twice counts as toxic if one label says so; ids without a document
    teach nothing. The groups' weights are averaged by their number of rows. With no usable
    row the weights are empty and every score is 0.5.
    """
    known = (labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max("label").alias("label")))
    total = known.count()
    share = min(1.0, SAMPLE / total) if total else 0.0
    chosen = known.filter(_share(["doc_id"], "sample", share)).select(
        F.col("doc_id").alias("id"), F.col("label").cast("double"))
    # At most about SAMPLE rows of two numbers: a proven bound for a broadcast.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select(
        "id", "label", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    different = texts.select("id", "h").distinct().count()
    rows = texts.filter(_share(["id", "h"], "text", min(1.0, SAMPLE / max(1, different))))
    rows = rows.dropDuplicates(["id", "h"]).withColumn("g", F.pmod(F.xxhash64("id", "h", F.lit("group")), F.lit(GROUPS)))

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "text"])
        order = np.random.default_rng(7).permutation(len(group))
        at, w = ftrl(group["text"].to_numpy()[order].tolist(), group["label"].to_numpy()[order])
        # The group's number of rows goes along as coordinate -1.
        return pd.DataFrame({"coordinate": np.append(at, -1), "weight": np.append(w * len(group), len(group))})

    parts = stored(rows.groupBy("g").applyInPandas(train, "coordinate long, weight double"), "toxicity-weights")
    rows_seen = parts.filter("coordinate < 0").agg(F.sum("weight")).scalar()
    return parts.filter("coordinate >= 0").groupBy("coordinate").agg((F.sum("weight") / rows_seen).alias("weight"))


def score(docs: DataFrame, weights: DataFrame, text: str = "text", out: str = "score",
          keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns plus ``out``: the probability that the whole text is toxic.

    Null and empty texts have no features and get the intercept's probability.
    The weights number at most 2^HASH_BITS + 1 and are collected and broadcast.
    A column already named ``out`` is replaced; repeated rows stay.
    """
    found = weights.collect()
    dense = np.zeros((1 << HASH_BITS) + 1)
    for r in found:
        dense[r["coordinate"]] = r["weight"]
    table = docs.sparkSession.sparkContext.broadcast(dense)
    names = [c for c in (docs.columns if keep is None else keep) if c not in (out, text)]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(out, T.DoubleType())])

    def run(batches):
        w = table.value
        for batch in batches:
            sums = []
            for t in batch.column(len(names)):
                at = features(t.as_py())
                sums.append(w[-1] + w[np.unique(at[w[at] != 0.0])].sum())
            p = 1.0 / (1.0 + np.exp(-np.clip(np.array(sums, float), -500.0, 500.0)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], names=[*names, out])

    return docs.select(*names, text).mapInArrow(run, schema)


#: A row is held out of the fit when its checksum leaves this remainder.
FOLDS, HELD_OUT = 5, 0


def _fold(folds: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def query(spark, sf_dir: str) -> DataFrame:
    """Every document scored by a model that never saw the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(_fold(FOLDS) != HELD_OUT).select(
        "doc_id", F.col("toxic").alias("label"))
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(_fold(FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
