"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. Two
fingerprints at two or fewer differing bits agree wholly on at least one
segment (pigeonhole), and on the segment after it they differ in at most two
bits. That next segment is decoded with the perfect Golay code [23, 12, 7]:
a word within two bits of its codeword gives that codeword's index; a word
three bits away gives it and the five codewords four bits away. Words at two or
fewer differing bits always share an index (proved over all cosets in the
tests), so keys (exact segment, index of the next) miss no pair. A fingerprint
has 3 to 18 keys.

Candidates are joined on the keys and verified by ``bit_count``. Copies never
meet there: only distinct fingerprints are keyed, so a third of all rows with
one text is one row. A key shared by more than ``CROWD`` distinct fingerprints
is not paired up; its members name all words one bit away instead (65 each),
and members that name the same word, which differ by two bits at most, are
linked to the smallest of them: the same links up to reachability, in linear
work. Components come from alternating large-star and small-star rounds on
stored edges; only the number of changed edges reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, stored

#: Contract of the registered query and of the pipeline stage.
SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: Distinct fingerprints that share a key and are still compared pairwise.
CROWD = 16
#: Fixed value: generator polynomial of the binary Golay code of length 23,
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: (lowest bit, width) of the three segments.
SEGMENTS = ((41, 23), (18, 23), (0, 18))

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority bits of the XXH64 of the text's word shingles; no words give 0."""
    words = (text or "").encode("utf-8").translate(_FOLD).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends[shingle - 1:].tolist() if len(words) >= shingle else [len(line)]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], seed) for a, b in zip(starts, ends, strict=False)], ">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k:k + (1 << 16)].view(np.uint8)).reshape(-1, 64).sum(0, np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                 seed: int = SEED, extra: list | None = None) -> DataFrame:
    """(key, *extra columns, fp): the fingerprint of every row's whole text as a signed long."""
    chosen = docs.select(F.col(key).alias("__key"), *(extra or []), F.col(text).alias("__text"))
    names = [c for c in chosen.columns if c != "__text"]
    schema = T.StructType([chosen.schema[c] for c in names] + [T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(len(names))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))],
                                             names=[*names, "fp"])

    return chosen.mapInArrow(run, schema)


def _remainder(words: np.ndarray) -> np.ndarray:
    for bit in range(22, 10, -1):
        words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - 11)), words)
    return words


def _golay_tables() -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome: the error pattern of weight three or less, and, where that has
    weight three, the five weight-seven codewords that contain it."""
    singles = 1 << np.arange(23)
    patterns = np.concatenate([[0], singles, [a | b for i, a in enumerate(singles) for b in singles[:i]],
                               [a | b | c for i, a in enumerate(singles) for j, b in enumerate(singles[:i])
                                for c in singles[:j]]]).astype(np.int64)
    errors = np.zeros(2048, np.int64)
    errors[_remainder(patterns)] = patterns
    messages = np.arange(4096, dtype=np.int64) << 11
    codewords = messages | _remainder(messages)
    sevens = codewords[np.bitwise_count(codewords) == 7]
    around = np.zeros((2048, 5), np.int64)
    for s in np.flatnonzero(np.bitwise_count(errors) == 3):
        around[s] = sevens[sevens & errors[s] == errors[s]]
    return errors, around


def golay_indices(words: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices of 23-bit words; unused places repeat the first."""
    errors, around = _TABLES
    syndrome = _remainder(words.astype(np.int64))
    nearest = words ^ errors[syndrome]
    return np.concatenate([nearest[:, None], nearest[:, None] ^ around[syndrome]], axis=1) >> 11


_TABLES = _golay_tables()


def keys_of(fps: np.ndarray) -> np.ndarray:
    """(n, 18) keys: segment number, its exact bits, a Golay index of the segment after it."""
    parts = [(fps >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1) for low, width in SEGMENTS]
    return np.concatenate([((s << 23 | parts[s])[:, None] << 12) | golay_indices(parts[(s + 1) % 3])
                           for s in range(3)], axis=1)


def _keyed(nodes: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            keys = np.sort(keys_of(fps), axis=1)
            fresh = np.ones(keys.shape, bool)
            fresh[:, 1:] = keys[:, 1:] != keys[:, :-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(fps.view(np.int64), fresh.sum(1))), pa.array(keys[fresh])], names=["fp", "key"])

    return nodes.select("fp").mapInArrow(run, "fp long, key long")


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) edges, a < b, whose components are those of all pairs within MAX_BITS bits.

    ``nodes`` has distinct fingerprints in ``fp``. Keys with up to CROWD
    members give every verified pair; crowded keys give star edges.
    """
    keys = stored(_keyed(nodes), "simhash-keys")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = stored(keys.join(shared, "key"), "simhash-shared")
    few = met.filter(F.col("n") <= CROWD)
    pairs = (few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key")
             .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS))
             .select("a", "b"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long")
                                             for k in range(64)])
    near = (met.filter(F.col("n") > CROWD).select("fp").distinct()
            .withColumn("word", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x)))))
    hubs = (near.groupBy("word").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
            .select("word", "a"))
    stars = near.join(hubs, "word").filter("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", extra: list | None = None) -> DataFrame:
    """One row per input row: __key, *extra, fp and component (smallest key reachable).

    Null, empty and word-less texts have fingerprint 0, linked like any other.
    Null keys are carried; a component whose keys are all null has a null
    component. Repeated rows stay repeated. Only key, text and ``extra``
    columns are read. An empty table gives an empty result.
    """
    fps = stored(fingerprints(docs, key, text, extra=extra), "simhash-fingerprints")
    nodes = stored(fps.groupBy("fp").agg(F.min("__key").alias("first")), "simhash-nodes")
    roots = components(links(nodes).select(F.col("a").alias("u"), F.col("b").alias("v")))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component"))
    named = stored(rooted.join(smallest, F.col("root") == F.col("r")).select(
        F.col("fp").alias("__fp"), "component"), "simhash-components")
    return fps.join(named, F.col("fp") == F.col("__fp")).drop("__fp")


def query(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return cluster(docs).select(F.col("__key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                F.col("component").alias("component_id"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest doc_id stays.

    Rows of one component that share that doc_id are told apart by a hash of
    their text; wholly equal ones leave one. A component of null ids keeps one.
    A row's own columns travel as one struct, so their names do not matter.
    """
    digest = F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()).alias("__digest")
    marked = cluster(docs, extra=[digest])
    best = marked.groupBy("component", F.when(F.col("component").isNull(), F.col("fp")).alias("__f")).agg(
        F.min(F.struct(F.col("__key").isNull().alias("__n"), "__key", "__digest")).alias("b"))
    keep = best.select(F.col("b.__key").alias("__kept"), F.col("b.__digest").alias("__kept_digest")).distinct()
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row"), F.col("doc_id").alias("id"), digest.alias("digest"))
    hit = rows.join(
        keep, F.col("id").eqNullSafe(F.col("__kept")) & (F.col("digest") == F.col("__kept_digest")), "left_semi")
    return hit.dropDuplicates(["id", "digest"]).select(*[F.col("row")[c].alias(c) for c in names])
