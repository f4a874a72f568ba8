"""Byte-level BPE by corpus-level merge replay, and the exact inverse.

A task treats a block of texts as one corpus. The block's distinct words lie
end to end in one array of tokens with links to their neighbours; an inverted
index leads from each mergeable token pair (named by the token it merges to)
to the places where it stands. Merges are then replayed in rank order: the
lowest rank in the index is taken, all its places in all words are merged at
once, and only the pairs to the left and right of those places are looked up
again and entered into the index. No word is scanned twice.

A word's merges depend on nothing outside the word, so blocks give the same
ids as one corpus-wide replay would, and no word occurrence is ever shuffled:
the plan is scan -> encode -> decode with no exchange, and a lost task simply
runs again. Words already met by a worker come from a bounded cache.

Memory per task: one block (``BLOCK_CHARS`` characters of whole texts, or one
text if longer) and the cache (``CACHE_WORDS`` words of up to
``CACHE_WORD_CHARS`` characters).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_CHARS = 2_000_000
CACHE_WORDS = 250_000
CACHE_WORD_CHARS = 64

_NONE = np.int64(1 << 40)  # "this pair does not merge"


class Merges:
    """A rank table ready for replay: token bytes by rank and every mergeable pair, sorted."""

    def __init__(self, rank_file: bytes):
        lines = (line.split() for line in rank_file.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        size = max(self.bytes_of) + 1
        self.stride = size
        pairs = [(self.ranks[t[:k]] * size + self.ranks[t[k:]], r) for t, r in self.ranks.items()
                 for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        pairs.sort()
        self.pair_keys = np.array([p for p, _ in pairs] or [-1], np.int64)
        self.pair_ranks = np.array([r for _, r in pairs] or [_NONE], np.int64)
        self.of_byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.of_byte < 0).any():
            raise ValueError("a byte-level rank file needs all 256 single bytes")
        self.cache: dict[str, bytes] = {}

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair merges to, or _NONE."""
        keys = left * self.stride + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], _NONE)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """Ids of each distinct, non-empty word, packed as little-endian unsigned 32 bits."""
        out: list[bytes | None] = [None] * len(words)
        todo = []
        for k, w in enumerate(words):
            whole = self.ranks.get(w)
            if whole is None:
                todo.append(k)
            else:
                out[k] = whole.to_bytes(4, "little")
        if todo:
            for k, ids in zip(todo, self._replay([words[k] for k in todo]), strict=True):
                out[k] = ids
        return out

    def _replay(self, words: list[bytes]) -> list[bytes]:
        lengths = np.array([len(w) for w in words], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        token = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(token)
        following = np.arange(1, n + 1)
        following[starts + lengths - 1] = -1
        before = np.arange(-1, n - 1)
        before[starts] = -1
        alive = np.ones(n, bool)

        pair = np.full(n, _NONE)  # what the pair that begins here merges to
        inner = np.flatnonzero(following >= 0)
        pair[inner] = self.merged(token[inner], token[following[inner]])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(places: np.ndarray) -> None:
            ranks = pair[places]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for part in np.split(places, cuts):
                rank = int(pair[part[0]])
                if rank in index:
                    index[rank].append(part)
                else:
                    index[rank] = [part]
                    heapq.heappush(heap, rank)

        if len(live := np.flatnonzero(pair < _NONE)):
            enter(live)
        odd: set[int] = set()
        while heap:
            rank = heapq.heappop(heap)
            entries = index.pop(rank)
            places = entries[0] if len(entries) == 1 else np.unique(np.concatenate(entries))
            places = places[pair[places] == rank]
            if not len(places):
                continue
            places = _leftmost(places, following, pair, rank)
            right = following[places]
            after = following[right]
            token[places] = rank
            following[places] = after
            inside = after >= 0
            before[after[inside]] = places[inside]
            alive[right] = False
            pair[right] = _NONE
            left = before[places]
            touched = np.concatenate([places, left[left >= 0]])
            ends = following[touched]
            pair[touched] = np.where(ends >= 0, self.merged(token[touched], token[ends]), _NONE)
            if len(fresh := touched[pair[touched] < _NONE]):
                early = fresh[pair[fresh] < rank]
                # A lower rank that appears late: those words' order is not the
                # corpus order; they are redone one by one below.
                odd.update((np.searchsorted(starts, early, "right") - 1).tolist())
                enter(np.unique(fresh))
        counts = np.add.reduceat(alive, starts, dtype=np.int64)
        packed = token[alive].astype("<u4").tobytes()
        stops = np.cumsum(counts) * 4
        out = [packed[a:b] for a, b in zip((stops - counts * 4).tolist(), stops.tolist(), strict=True)]
        for k in odd:
            out[k] = self.merge_one(words[k])
        return out

    def merge_one(self, word: bytes) -> bytes:
        """One word by a queue of (rank, place): the order of merges written out plainly."""
        token: list[bytes | None] = [word[i:i + 1] for i in range(len(word))]
        following = [*range(1, len(word)), -1]
        before = list(range(-1, len(word) - 1))
        rank_of = lambda i: self.ranks.get(token[i] + token[following[i]]) if following[i] >= 0 else None
        heap = [(r, i) for i in range(len(word)) if (r := rank_of(i)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            if token[i] is None or rank_of(i) != rank:
                continue
            j = following[i]
            token[i] += token[j]
            token[j] = None
            following[i] = following[j]
            if following[i] >= 0:
                before[following[i]] = i
            for k in (i, before[i]):
                if k >= 0 and (r := rank_of(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return b"".join(self.ranks[t].to_bytes(4, "little") for t in token if t is not None)


def _leftmost(places: np.ndarray, following: np.ndarray, pair: np.ndarray, rank: int) -> np.ndarray:
    """Drop places whose left neighbour in the same run merges first (as in ``aaa``)."""
    clash = pair[following[places]] == rank
    if not clash.any():
        return places
    places = np.sort(places)
    taken: set[int] = set()
    keep = np.ones(len(places), bool)
    for k, (i, j) in enumerate(zip(places.tolist(), following[places].tolist(), strict=True)):
        if i in taken:
            keep[k] = False
        else:
            taken.add(j)
    return places[keep]


_TABLES: dict[str, Merges] = {}


def _merges(rank_file: bytes) -> Merges:
    """Parsed once per Python worker; workers live through many tasks."""
    key = hashlib.sha256(rank_file).hexdigest()
    if key not in _TABLES:
        _TABLES[key] = Merges(rank_file)
    return _TABLES[key]


def encode_block(merges: Merges, split: regex.Pattern, texts: list[str | None]) -> list[bytes]:
    """Packed ids of every text of one block."""
    words = [split.findall(t) if t else [] for t in texts]
    cache, distinct = merges.cache, set().union(*words)
    fresh = [w for w in distinct if w not in cache]
    if len(cache) + len(fresh) > CACHE_WORDS:
        cache.clear()
        fresh = list(distinct)
    cache.update(zip(fresh, merges.replay([w.encode("utf-8") for w in fresh]), strict=True))
    out = [b"".join([cache[w] for w in ws]) for ws in words]
    for w in fresh:
        if len(w) > CACHE_WORD_CHARS:
            del cache[w]
    return out


def _blocks(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of whole texts of about BLOCK_CHARS characters."""
    start, size, texts = 0, 0, []
    for k, value in enumerate(column):
        text = value.as_py()
        if texts and size + len(text or "") > BLOCK_CHARS:
            yield start, texts
            start, size, texts = k, 0, []
        texts.append(text)
        size += len(text or "")
    if texts:
        yield start, texts


def _unpack(bytes_of: dict[int, bytes], ids: bytes) -> bytes:
    return b"".join([bytes_of[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text", out: str = "ids",
           decoded: str | None = None) -> DataFrame:
    """``df`` without ``text`` and with ``out``: packed ids (little-endian unsigned 32 bits).

    Null and empty texts give empty ids. Other columns, nulls and repeated
    rows pass through; a column already named ``out`` is replaced. The rank
    file (bounded by the vocabulary) is read on the driver and broadcast. With
    ``decoded`` the ids are decoded again in the same pass, into that column.
    """
    with open(rank_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in df.columns if c not in (text, out, decoded)]
    names = [*keep, out, *([decoded] if decoded else [])]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, T.BinaryType()) for c in names[len(keep):]])

    def run(batches):
        merges, split = _merges(ranks.value), regex.compile(pattern)
        for batch in batches:
            column = batch.column(len(keep))
            for start, texts in _blocks(column):
                ids = encode_block(merges, split, texts)
                part = batch.slice(start, len(texts))
                columns = [*part.columns[:len(keep)], pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([_unpack(merges.bytes_of, x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.select(*keep, text).mapInArrow(run, schema)


def decode(df: DataFrame, rank_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with ``out``: the bytes that the packed ids stand for (null ids: empty)."""
    with open(rank_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in df.columns if c != out]
    at = keep.index(ids)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.BinaryType())])

    def run(batches):
        bytes_of = _merges(ranks.value).bytes_of
        for batch in batches:
            texts = [_unpack(bytes_of, x.as_py() or b"") for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*keep, out])

    return df.select(*keep).mapInArrow(run, schema)


#: Rank file of the registered query.
RANK_FILE = "byte_bpe_50k.tiktoken"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and of decoded bytes, per document."""
    import public_tokenizers

    path = public_tokenizers.path(RANK_FILE)
    # One pass, so a task needs one Python worker and one copy of the tables.
    both = encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN, out="__ids", decoded="__decoded")
    return both.select("doc_id", (F.octet_length("__ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("__ids", 256).alias("ids_sha256"), F.sha2("__decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    """Every document's text encoded whole and decoded again."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage (the last): token counts and digests of what is left."""
    return digests(docs)
