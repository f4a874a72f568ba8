"""Exact nearest neighbours by inner product: int8 tiles bound every score, floats decide.

Rows are packed into blocks. A vector y is stored with its int8 code q, its step s
(largest absolute component / 127) and the norms of s*q and of what the code leaves
out, e = y - s*q. For a query x and a candidate y

    |x.y - (s*q of x).(s*q of y)| <= |s*q of x| * |e of y| + |e of x| * |y|,

so a product of two integer tiles gives every score up to a known error. (The tile
products are taken in single precision, in slices short enough that all sums are
whole numbers below 2^24: they equal the integer products.) A pair survives if its
upper bound reaches both the k-th largest lower bound of its tile and the worst score
of the query's full heap. Survivors are recomputed from the original vectors in double
precision and pushed on the query's heap of k. Nothing that could belong to the
result is dropped, so recall is 1.

Blocks of queries are *stripes*, blocks of candidates are *parts*; a task gets one
stripe and one part. Both are dealt round-robin and are bounded in values, so no
vector, id or label can make one task larger. A stripe's heaps are merged over its
parts by trees of ``FAN`` (heap merges of sorted lists), so no merge grows with the
table. Rows moved: queries x parts + candidates x stripes, in blocks.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Contract of the registered query: neighbours a query, and which rows are queries.
NEIGHBOURS, EVERY = 20, 20
#: Components of a block of candidates and of a block of queries.
PART_VALUES, STRIPE_VALUES = 1 << 20, 1 << 16
#: Heaps merged at once.
FAN = 32
#: Tile of a product, and pairs that are recomputed at once.
TILE_QUERIES, TILE_ROWS, PAIRS = 256, 4096, 1 << 16
#: Components whose int8 products sum to whole numbers that single precision holds.
SLICE = (1 << 24) // (127 * 127)

_BLOCK = "block long, seq long, dim int, ids binary, vectors binary, codes binary, steps binary, coded binary, lost binary"
_HEAPS = "block long, seq long, part long, queries binary, sizes binary, ids binary, scores binary"


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): rows whose id is not null and whose vector is finite and not zero."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & (F.abs(c) < F.lit(float("inf"))))
    return rows.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite
                       & F.exists(v, lambda c: c != 0)).select(
        F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))


def quantise(v: np.ndarray) -> tuple[np.ndarray, ...]:
    """(codes, steps, norm of the coded part, norm of what the code loses) per row, norms rounded up."""
    steps = np.abs(v).max(axis=1) / 127
    safe = np.where(steps > 0, steps, 1.0)
    codes = np.clip(np.rint(v / safe[:, None]), -127, 127).astype(np.int8)
    coded = codes * safe[:, None]
    up = 1 + 1e-9
    with np.errstate(over="ignore", invalid="ignore"):
        lost = np.sqrt(np.square(v - coded).sum(axis=1)) * up
        return codes, safe, np.sqrt(np.square(coded).sum(axis=1)) * up, np.nan_to_num(lost, nan=np.inf, posinf=np.inf)


def _packed(rows: DataFrame, blocks: int) -> DataFrame:
    """Blocks of rows: ids, original vectors, codes, steps and norms; one dimension a block row."""
    wide = rows.schema["v"].dataType.elementType != T.FloatType()
    kind = np.float64 if wide else np.float32

    def work(batches):
        block, seq, held = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)
            starts = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths):
                mine = np.flatnonzero(lengths == dim)
                held.setdefault(int(dim), []).append((ids[mine], flat[starts[mine][:, None] + np.arange(dim)]))
        for dim, parts in held.items():
            ids, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            codes, steps, coded, lost = quantise(v.astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([seq], pa.int64()), pa.array([dim], pa.int32()),
                 *[pa.array([a.tobytes()], pa.binary()) for a in (ids.astype(np.int64), v, codes, steps, coded, lost)]],
                names=["block", "seq", "dim", "ids", "vectors", "codes", "steps", "coded", "lost"])
            seq += 1

    return rows.repartition(blocks).mapInArrow(work, _BLOCK)


def _unpacked(row: dict, kind) -> dict:
    shape = (-1, row["dim"])
    read = lambda name, of: np.frombuffer(row[name], of)
    return {"dim": row["dim"], "ids": read("ids", np.int64), "steps": read("steps", np.float64),
            "coded": read("coded", np.float64), "lost": read("lost", np.float64),
            "v": read("vectors", kind).reshape(shape), "codes": read("codes", np.int8).reshape(shape)}


def tile_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 codes, exact."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], SLICE):
        out += a[:, k:k + SLICE].astype(np.float32) @ b[:, k:k + SLICE].astype(np.float32).T
    return out


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner product of each row of ``a`` with the same row of ``b``, in double precision, component by component."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k].astype(np.float64) * b[:, k].astype(np.float64)
    return out


def search_part(q: dict, c: dict, heaps: list[list], k: int, tile: tuple[int, int] = (TILE_QUERIES, TILE_ROWS)) -> None:
    """Push every candidate that may be among a query's k nearest on its heap of (score, -id)."""
    high, wide = tile
    for top in range(0, len(q["ids"]), high):
        qs = slice(top, top + high)
        for left in range(0, len(c["ids"]), wide):
            cs = slice(left, left + wide)
            mine = heaps[qs]
            with np.errstate(over="ignore", invalid="ignore"):
                score = tile_scores(q["codes"][qs], c["codes"][cs])
                score *= q["steps"][qs][:, None]
                score *= c["steps"][cs][None, :]
                for own in np.flatnonzero(np.isin(q["ids"][qs], c["ids"][cs])):
                    score[own, c["ids"][cs] == q["ids"][qs][own]] = -np.inf
                size = q["coded"][qs] + q["lost"][qs]
                error = np.multiply.outer(q["coded"][qs], c["lost"][cs])
                error += np.multiply.outer(q["lost"][qs], c["coded"][cs] + c["lost"][cs])
                # What rounding in double precision can add.
                error += np.multiply.outer(size, c["coded"][cs] + c["lost"][cs]) * (1e-15 * (q["dim"] + 8))
                bound = np.array([h[0][0] if len(h) == k else -np.inf for h in mine])
                if score.shape[1] > k and not np.isfinite(bound).all():
                    low = np.nan_to_num(score - error, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
                    place = low.shape[1] - k
                    bound = np.maximum(bound, np.partition(low, place, axis=1)[:, place])
                score += error
                i, j = np.nonzero(~(score < bound[:, None]))
            other = q["ids"][qs][i] != c["ids"][cs][j]
            i, j = i[other], j[other]
            for at in range(0, len(i), PAIRS):
                a, b = i[at:at + PAIRS], j[at:at + PAIRS]
                scores = exact_scores(q["v"][qs][a], c["v"][cs][b])
                for one, s, who in zip(a.tolist(), scores.tolist(), c["ids"][cs][b].tolist(), strict=True):
                    heap = mine[one]
                    if len(heap) < k:
                        heapq.heappush(heap, (s, -who))
                    elif (s, -who) > heap[0]:
                        heapq.heapreplace(heap, (s, -who))


def _heap_row(block: int, seq: int, part: int, queries: bytes, heaps: list[list]) -> list:
    flat = [entry for heap in heaps for entry in heap]
    return [block, seq, part, queries, np.array([len(h) for h in heaps], np.int64).tobytes(),
            np.array([-e[1] for e in flat], np.int64).tobytes(), np.array([e[0] for e in flat], np.float64).tobytes()]


def _heaps_of(row: dict) -> list[list]:
    ends = np.cumsum(np.frombuffer(row["sizes"], np.int64)).tolist()
    entries = list(zip(np.frombuffer(row["scores"], np.float64).tolist(),
                       (-np.frombuffer(row["ids"], np.int64)).tolist(), strict=True))
    return [entries[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _table(rows: list[list]) -> pa.Table:
    kinds = [pa.int64()] * 3 + [pa.binary()] * 4
    names = ["block", "seq", "part", "queries", "sizes", "ids", "scores"]
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)


def _tiles(queries: DataFrame, candidates: DataFrame, stripes: int, parts: int, k: int, wide: bool) -> DataFrame:
    kind, tile = np.float64 if wide else np.float32, (TILE_QUERIES, TILE_ROWS)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        found, others = [], [_unpacked(c, kind) for c in right.to_pylist()]
        for row in left.to_pylist():
            q = _unpacked(row, kind)
            heaps: list[list] = [[] for _ in q["ids"]]
            for c in others:
                if c["dim"] == q["dim"]:
                    search_part(q, c, heaps, k, tile)
            found.append(_heap_row(row["block"], row["seq"], row["part"], row["ids"], [sorted(h, reverse=True) for h in heaps]))
        return _table(found)

    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.withColumn("part", numbers(parts))
    right = candidates.withColumnRenamed("block", "part").withColumn("block", numbers(stripes))
    return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(work, _HEAPS)


def _merged(heaps: DataFrame, parts: int, k: int) -> DataFrame:
    fan = FAN

    def work(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        lists = zip(*[_heaps_of(r) for r in rows], strict=True)
        best = [list(islice(heapq.merge(*one, reverse=True), k)) for one in lists]
        return _table([_heap_row(rows[0]["block"], rows[0]["seq"], rows[0]["part"] // fan, rows[0]["queries"], best)])

    while parts > 1:
        group = F.expr(f"part div {fan}").alias("group")
        heaps = heaps.groupBy("block", "seq", group).applyInArrow(work, _HEAPS)
        parts = -(-parts // fan)
    return heaps


def nearest(queries: DataFrame, rows: DataFrame, k: int = NEIGHBOURS, key: str = "vec_id",
            vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query row's k rows of largest inner product.

    Ranks run from 1, by score descending, then id ascending; with fewer than k
    candidates all are returned. A row is no candidate of a query with its own id.
    Rows with a null id or a null, empty or zero vector, or one that holds null, NaN or
    infinite components, take no part on either side. Vectors meet only those of
    as many components. Rows that repeat an id are rows of their own: each such
    query has its own ranks, each such candidate its own place. Columns other than
    ``key`` and ``vector`` are not read; empty tables give an empty result. Scores
    are double precision sums over the original components; one that overflows is infinite.
    """
    wide = rows.schema[vector].dataType.elementType != T.FloatType()
    find, among = usable(queries, key, vector), usable(rows, key, vector)
    if wide or find.schema["v"].dataType != among.schema["v"].dataType:
        wide = True
        find, among = (x.withColumn("v", F.col("v").cast("array<double>")) for x in (find, among))
    size = F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")
    stripes, parts = (
        max(1, -(-int(got["n"]) * int(got["dim"] or 1) // values))
        for got, values in ((find.agg(*size).first(), STRIPE_VALUES), (among.agg(*size).first(), PART_VALUES)))
    left = stored(_packed(find, stripes), "query-blocks")
    right = stored(_packed(among, parts), "candidate-blocks")
    heaps = _merged(_tiles(left, right, stripes, parts, k, wide), parts, k)

    def flat(batches):
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], np.int64)
                starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.frombuffer(row["queries"], np.int64), sizes)),
                     pa.array((np.arange(len(starts)) - starts + 1).astype(np.int32)),
                     pa.array(np.frombuffer(row["ids"], np.int64)), pa.array(np.frombuffer(row["scores"], np.float64))],
                    names=["query_id", "rank", "vec_id", "score"])

    return heaps.mapInArrow(flat, "query_id long, rank int, vec_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose id is divisible by 20."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(rows.filter(F.col("vec_id") % EVERY == 0), rows)


ORACLE = """
WITH usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.v, c.v) AS score
  FROM usable q JOIN usable c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
