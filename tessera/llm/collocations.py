"""Collocations: phrases of up to four words from word-level FM-indexes, one a shard.

1. *Shards.* A task splits its texts into pieces and words and deals the words of
   each language into shards of about ``SHARD_WORDS`` words; a shard ends between
   two pieces, so no phrase spans two shards. A shard is its words' numbers in
   order, 0 between pieces, and its own word list. It is written once, compressed.
2. *Index.* Wherever a shard is read, its index is made: the Burrows-Wheeler
   transform of the numbers in both directions (the word before each row of the
   forward order, the word after each row of the backward order), the symbols'
   first rows, and the step from a row to the row of the neighbouring word. A phrase
   is an interval of rows in both orders. ``extend`` adds one word on the left
   (forward transform) or on the right (backward transform) to all intervals
   of a list at once and gives each longer phrase's count and both of its intervals.
   Depth is limited to four words, so the orders only sort the first three.
3. *What can be frequent.* Counts must be summed over shards, but most phrases of a
   shard are rare everywhere. Shards send a 64-bit hash and the count of every
   word and two-word phrase, packed by bucket of the hash; a bucket adds them up and
   answers each shard with one bit a phrase: whether that sum reaches ``least``. Phrases
   that share a hash only make a sum larger, so no frequent phrase is lost. With those
   bits shards extend what can be frequent to three words (on the left) and four (on
   the right), where every two neighbouring words must be able to be, and ask again.
4. *Sum.* Shards send the text and count of each phrase whose bit is set, packed by
   language and bucket; grouped sums by text are exact, and those under ``least`` go.
   What shares a hash is told apart here, so hashes never decide a result.

A word or phrase that fills a third of all texts is one entry a shard. A bucket gets
about ``BUCKET_WORDS`` entries, dealt by hash. Nothing is collected to the driver but the
number of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, ASCII_UPPER, stored

#: Contract of the registered query.
LEAST, LONGEST, HELD_PERCENT, SCORE_SCALE, TOP = 30, 4, 80, 2_000_000, 2000
#: Bytes that end a piece, and bytes that separate words in one.
PIECE_ENDS, WORD_GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Words of a shard, bytes split into words at once, words' entries in a bucket on average.
SHARD_WORDS, SPLIT_BYTES, BUCKET_WORDS = 1_000_000, 1 << 20, 1_000_000
#: Groups in which a language's phrases are ranked before they are ranked together.
RANK_GROUPS = 64
#: Bits of a phrase's hash that are sent.
HASH_BITS = 64
#: Bits of a word's number for which three numbers sort as one.
NARROW = 21

_FOLD = bytes.maketrans(ASCII_UPPER.encode() + PIECE_ENDS + WORD_GAPS,
                        ASCII_LOWER.encode() + b"." * len(PIECE_ENDS) + b" " * len(WORD_GAPS))
_M, _N = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SHARDS = "shard string, lang string, n_words long, numbers binary, words binary"


class _Gather:
    """Words of one language until they fill a shard."""

    def __init__(self):
        self.known: dict[bytes, int] = {b".": 0}
        self.parts, self.size = [np.zeros(1, np.int32)], 0
        self.waiting: list[bytes] = []
        self.bytes = 0

    def add(self, piece: bytes) -> None:
        """Folded bytes in which each "." stands alone between spaces and ends a piece."""
        # Only space is left of ASCII white space, so split() cuts at spaces.
        found, known = piece.split(), self.known
        try:
            numbers = [known[w] for w in found]
        except KeyError:
            for w in found:
                known.setdefault(w, len(known))
            numbers = [known[w] for w in found]
        self.parts.append(np.array(numbers, np.int32))
        self.size += len(numbers)

    def row(self) -> tuple[int, bytes, bytes]:
        numbers = np.concatenate([*self.parts, np.zeros(1, np.int32)])
        again = np.ones(len(numbers), bool)
        again[1:] = (numbers[1:] > 0) | (numbers[:-1] > 0)  # of several ends in a row one is enough
        press = zstandard.ZstdCompressor(level=1)
        return (int((numbers > 0).sum()), press.compress(numbers[again].tobytes()),
                press.compress(b" ".join(list(self.known)[1:])))


def _splits(text: bytes, size: int):
    """Folded bytes in portions of about ``size``, cut at spaces."""
    folded = text.translate(_FOLD).replace(b".", b" . ")
    at = 0
    while at < len(folded):
        to = folded.find(b" ", at + size)
        to = len(folded) if to < 0 else to
        yield folded[at:to]
        at = to


def shards(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(shard, lang, n_words, numbers, words): the words of all texts as shards of one language each."""
    chosen = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    full, split = SHARD_WORDS, SPLIT_BYTES

    def work(batches):
        task, made, held = TaskContext.get().partitionId(), 0, {}

        def emit(language):
            nonlocal made
            n, numbers, words = held.pop(language).row()
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{task}-{made}"]), pa.array([language]), pa.array([n], pa.int64()),
                 pa.array([numbers], pa.binary()), pa.array([words], pa.binary())],
                names=["shard", "lang", "n_words", "numbers", "words"])

        def split_up(language):
            gather = held[language]
            texts, gather.waiting, gather.bytes = gather.waiting, [], 0
            for portion in _splits(b".".join(texts) + b".", split):
                gather = held.setdefault(language, _Gather())
                gather.add(portion)
                # Between two texts a shard can end anywhere, within one only after a piece.
                if gather.size >= full and portion.endswith(b"."):
                    yield emit(language)
            if language in held and held[language].size >= full:
                yield emit(language)

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for language, one in zip(batch.column(0).to_pylist(), texts, strict=True):
                if not one.is_valid:
                    continue
                gather = held.setdefault(language, _Gather())
                gather.waiting.append(one.as_py())
                gather.bytes += len(gather.waiting[-1])
                if gather.bytes >= split:
                    yield from split_up(language)
        for language in list(held):
            yield from split_up(language)
        for language in list(held):
            yield emit(language)

    return chosen.mapInArrow(work, _SHARDS)


class Index:
    """FM-index of a shard in both directions, to a depth of three words."""

    def __init__(self, numbers: np.ndarray):
        n = len(numbers)
        self.numbers = numbers
        counts = np.bincount(numbers, minlength=1)
        self.first = np.concatenate([[0], np.cumsum(counts)])  # first row of every symbol, in both orders
        #: Of both orders: the word that extends a row, and the row of that word's place.
        self.left, self.to_left = self._transform(-1)
        self.right, self.to_right = self._transform(1)
        self.size = n

    def _transform(self, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows in the order of the words towards the other side, each with the word on ``side``."""
        x = self.numbers
        second, third = np.roll(x, side), np.roll(x, 2 * side)
        if len(self.first) <= 1 << NARROW:
            wide = x.astype(np.uint64) << np.uint64(2 * NARROW)
            wide |= second.astype(np.uint64) << np.uint64(NARROW)
            wide |= third.astype(np.uint64)
            order = np.argsort(wide)
        else:
            order = np.lexsort((third, second, x))
        row = np.empty(len(x), np.int32)
        row[order] = np.arange(len(x), dtype=np.int32)
        beside = np.roll(x, -side)  # the word on this side of every place
        return beside[order], np.roll(row, -side)[order]

    def words(self) -> tuple[np.ndarray, ...]:
        """(word, count, forward row, backward row) of every word that occurs."""
        counts = np.diff(self.first)
        word = np.flatnonzero(counts)
        word = word[word > 0]
        return word, counts[word], self.first[word], self.first[word]

    def extend(self, side: int, count: np.ndarray, near: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, ...]:
        """Every phrase one word longer on ``side`` (-1 left, 1 right).

        ``near`` are the intervals' first rows in the order whose transform holds that side
        (forward for the left), ``far`` those in the other. Returns (number of the extended
        interval, added word, count, near, far), by interval and word.
        """
        beside, step = (self.left, self.to_left) if side < 0 else (self.right, self.to_right)
        which = np.repeat(np.arange(len(count)), count)
        begin = np.cumsum(count) - count
        rows = np.arange(len(which)) + (near - begin)[which]
        added = beside[rows]
        if len(self.first) * max(len(count), 1) < 1 << 62:
            order = np.argsort(which * len(self.first) + added)
        else:
            order = np.lexsort((added, which))
        which, added = which[order], added[order]
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (added[1:] != added[:-1])
        head = np.flatnonzero(new)
        if not len(head):
            none = np.zeros(0, np.int64)
            return none, none, none, none, none
        found = np.diff(np.append(head, len(which)))
        # One step in the near order; in the far order, words that are smaller stand before.
        nearer = np.minimum.reduceat(step[rows[order]], head)
        which, added = which[head], added[head].astype(np.int64)
        farther = far[which] + (head - begin[which])
        real = added > 0
        return which[real], added[real], found[real], nearer[real].astype(np.int64), farther[real]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _M) ^ (b + (a >> np.uint64(29)))
    x *= _N
    return x ^ (x >> np.uint64(32))


class Shard:
    """A read shard: its index, its words and its phrases by level."""

    def __init__(self, lang: str, numbers: bytes, words: bytes, bits: int = HASH_BITS):
        self.bits = np.uint64(64 - bits)
        unpress = zstandard.ZstdDecompressor()
        self.index = Index(np.frombuffer(unpress.decompress(numbers), np.int32))
        text = unpress.decompress(words)
        self.words = [b"", *(text.split(b" ") if text else [])]
        self.seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8")))

    def low(self) -> tuple[list[np.ndarray], np.ndarray]:
        """All words and two-word phrases: (columns of numbers, counts)."""
        word, count, forward, backward = self.index.words()
        which, added, twice, near, far = self.index.extend(1, count, backward, forward)
        self.ones, self.twos = (word, count), (word[which], added, twice, far, near)
        zero = np.zeros(len(word), np.int64)
        return [np.concatenate([word, word[which]]), np.concatenate([zero, added])], np.concatenate([count, twice])

    def high(self, marks: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Three- and four-word phrases all of whose neighbouring words are marked; ``marks`` follows ``low``."""
        self.low()
        two = marks[len(self.ones[0]):]
        a, b, count, forward, backward = (c[two] for c in self.twos)
        pairs = a << 32 | b  # in order

        def marked(x, y):
            if not len(pairs):
                return np.zeros(len(x), bool)
            pair = x << 32 | y
            return pairs[np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)] == pair

        which, left, n, forward, backward = self.index.extend(-1, count, forward, backward)
        keep = marked(left, a[which])
        which, left, n, forward, backward = (c[keep] for c in (which, left, n, forward, backward))
        three = [left, a[which], b[which]]
        onward, right, m, _, _ = self.index.extend(1, n, backward, forward)
        keep = marked(three[2][onward], right)
        onward, right, m = onward[keep], right[keep], m[keep]
        columns = [np.concatenate([c, c[onward]]) for c in three]
        return [*columns, np.concatenate([np.zeros(len(n), np.int64), right])], np.concatenate([n, m])

    def keys(self, columns: list[np.ndarray]) -> np.ndarray:
        hashes = np.array([0, *map(xxhash.xxh3_64_intdigest, self.words[1:])], np.uint64)
        key = np.full(len(columns[0]), self.seed)
        for column in columns:
            key = _mix(key, hashes[column])
        return key >> self.bits

    def texts(self, columns: list[np.ndarray]) -> pa.Array:
        words = pa.array([w.decode("utf-8") for w in self.words], pa.string())
        parts = [pc.take(words, pa.array(column)) for column in columns]
        joined = parts[0]
        for part, column in zip(parts[1:], columns[1:], strict=True):
            longer = pc.binary_join_element_wise(joined, part, " ")
            joined = pc.if_else(pa.array(column > 0), longer, joined)
        return joined


def _bits(marks: list[dict] | None, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The buckets' answers in the order of the shard's own phrases."""
    order = np.argsort(keys % np.uint64(buckets), kind="stable")
    out = np.zeros(len(keys), bool)
    bits = [np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=m["n"])
            for m in sorted(marks or [], key=lambda m: m["bucket"])]
    if bits:
        out[order] = np.concatenate(bits).astype(bool)
    return out


def _marks(sent: DataFrame, least: int) -> DataFrame:
    """Per shard a list (bucket, n, bits): which of the phrases it sent reach ``least`` over all shards."""
    def work(table: pa.Table) -> pa.Table:
        sizes = [len(c.as_py()) for c in table.column("counts")]
        keys = np.concatenate([np.frombuffer(c.as_py(), np.uint64) for c in table.column("keys")])
        counts = np.concatenate([np.frombuffer(c.as_py(), np.uint8) for c in table.column("counts")])
        order = np.argsort(keys)
        sorted_keys = keys[order]
        head = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
        enough = np.add.reduceat(counts[order].astype(np.int64), head) >= least
        marked = np.empty(len(keys), bool)
        marked[order] = np.repeat(enough, np.diff(np.append(head, len(keys))))
        ends = np.cumsum(sizes)
        bits = [np.packbits(part).tobytes() for part in np.split(marked, ends[:-1])]
        return pa.Table.from_arrays(
            [table.column("shard"), table.column("bucket"), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary())],
            names=["shard", "bucket", "n", "bits"])

    answers = sent.groupBy("bucket").applyInArrow(work, "shard string, bucket long, n int, bits binary")
    return answers.groupBy("shard").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("marks"))


def _by_bucket(keys: np.ndarray, buckets: int):
    """(bucket, places of its keys in their order) of every bucket that has keys."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for at in np.split(order, cuts) if len(order) else ():
        yield bucket[at[0]], at


def _sent(keys: np.ndarray, counts: np.ndarray, shard: str, buckets: int, least: int):
    """Hashes and counts (up to ``least``) of a shard's phrases, a row a bucket."""
    counts = np.minimum(counts, least).astype(np.uint8)
    for bucket, at in _by_bucket(keys, buckets):
        yield pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int64()), pa.array([shard]), pa.array([keys[at].tobytes()], pa.binary()),
             pa.array([counts[at].tobytes()], pa.binary())], names=["bucket", "shard", "keys", "counts"])


_SENT = "bucket long, shard string, keys binary, counts binary"


def _rows(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """((lang, words, phrase, count), (lang, n)): phrases of one to four words that occur ``least`` times, and word totals.

    ``count`` is all contiguous occurrences within pieces, overlaps included. ``least`` is 1 to 255.
    """
    if not 1 <= least <= 255:
        raise ValueError("least must be 1 to 255")
    made = stored(shards(docs, text, lang), "shards")
    total = made.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    buckets, bits = max(1, -(-int(total) // BUCKET_WORDS)), HASH_BITS

    def low(batches):
        for row in _rows(batches):
            shard = Shard(row["lang"], row["numbers"], row["words"], bits)
            columns, counts = shard.low()
            yield from _sent(shard.keys(columns), counts, row["shard"], buckets, least)

    def high(batches):
        for row in _rows(batches):
            shard = Shard(row["lang"], row["numbers"], row["words"], bits)
            columns, _ = shard.low()
            columns, counts = shard.high(_bits(row["marks"], shard.keys(columns), buckets))
            yield from _sent(shard.keys(columns), counts, row["shard"], buckets, least)

    def texts(batches):
        for row in _rows(batches):
            shard = Shard(row["lang"], row["numbers"], row["words"], bits)
            low_columns, low_counts = shard.low()
            low_keys = shard.keys(low_columns)
            marks = _bits(row["marks"], low_keys, buckets)
            columns, counts = shard.high(marks)
            keys = shard.keys(columns)
            more = _bits(row["more"], keys, buckets)
            none = np.zeros(int(marks.sum()), np.int64)
            columns = [np.concatenate([low_columns[k][marks] if k < 2 else none, c[more]]) for k, c in enumerate(columns)]
            counts, keys = np.concatenate([low_counts[marks], counts[more]]), np.concatenate([low_keys[marks], keys[more]])
            found = shard.texts(columns)
            for bucket, at in _by_bucket(keys, buckets):
                whole = pa.array([0, len(at)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["lang"]], pa.string()), pa.array([bucket], pa.int64()),
                     pa.ListArray.from_arrays(whole, found.take(pa.array(at))),
                     pa.ListArray.from_arrays(whole, pa.array(counts[at].astype(np.int64)))],
                    names=["lang", "bucket", "phrases", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        flat = pa.table({"phrase": pc.list_flatten(table.column("phrases")), "count": pc.list_flatten(table.column("counts"))})
        sums = flat.group_by("phrase").aggregate([("count", "sum")])
        sums = sums.filter(pc.greater_equal(sums.column("count_sum"), least))
        words = pc.add(pc.count_substring(sums.column("phrase"), " "), 1).cast(pa.int32())
        lang = pa.array([key[0].as_py()] * len(sums), pa.string())
        return pa.table([lang, words, sums.column("phrase"), sums.column("count_sum")],
                        names=["lang", "words", "phrase", "count"])

    kinds = "shard", "lang", "numbers", "words"
    marks = stored(_marks(made.select(*kinds).mapInArrow(low, _SENT), least), "marks")
    marked = made.select(*kinds).join(marks, "shard")
    more = _marks(marked.mapInArrow(high, _SENT), least).withColumnRenamed("marks", "more")
    sent = marked.join(more, "shard", "left").mapInArrow(
        texts, "lang string, bucket long, phrases array<string>, counts array<long>")
    sums = sent.groupBy("lang", "bucket").applyInArrow(add, "lang string, words int, phrase string, count long")
    return stored(sums, "phrases"), made.groupBy("lang").agg(F.sum("n_words").alias("n"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST,
                 top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score, cut, held): the best phrases of two to four words of each language.

    ``a`` counts the phrase, ``l`` and ``r`` its parts at the cut (after ``cut`` words) with
    the lowest score floor(2000000 a / (l + r)), the first of equals; ``n`` all words of the
    language; ``held`` the count of the most frequent longer phrase that contains it (null
    without one). Phrases are dropped if ``held`` is at least 80 % of ``a``. The first
    ``top`` by score, then ``a``, then bytes of the phrase.

    Null texts are empty; null languages are ``und``, which a language of that name
    joins. Repeated rows count again; a language without phrases has no rows; an empty
    table gives an empty result. Only ``text`` and ``lang`` are read.
    """
    known, totals = phrases(docs, text, lang, least)
    counts = known.select("lang", F.col("phrase").alias("part"), F.col("count").alias("f"))
    many = known.filter("words > 1").select("lang", "phrase", "words", F.col("count").alias("a"),
                                            F.split("phrase", " ").alias("w"))
    cuts = many.withColumn("cut", F.explode(F.expr("sequence(1, words - 1)")))
    cuts = cuts.select("lang", "phrase", "a", "cut", F.expr("array_join(slice(w, 1, cut), ' ')").alias("begin"),
                       F.expr("array_join(slice(w, cut + 1, words - cut), ' ')").alias("end"))
    cuts = (cuts.join(counts.select("lang", F.col("part").alias("begin"), F.col("f").alias("l")), ["lang", "begin"])
            .join(counts.select("lang", F.col("part").alias("end"), F.col("f").alias("r")), ["lang", "end"]))
    score = F.expr(f"(cast({SCORE_SCALE} as decimal(18,0)) * cast(a as decimal(19,0)))"
                   " div (cast(l as decimal(20,0)) + cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    inner = F.expr("filter(flatten(transform(sequence(2, words - 1), k -> transform(sequence(1, words - k + 1),"
                   " s -> array_join(slice(w, s, k), ' ')))), p -> p <> phrase)")
    held = (many.filter("words > 2").select("lang", "a", F.explode(F.array_distinct(inner)).alias("phrase"))
            .groupBy("lang", "phrase").agg(F.max("a").alias("held")))
    kept = best.join(held, ["lang", "phrase"], "left").filter(
        F.expr(f"held is null or cast(100 as decimal(10,0)) * held < cast({HELD_PERCENT} as decimal(10,0)) * a"))
    kept = kept.select("lang", "phrase", "a", "b.l", "b.r", "b.score", "b.cut", "held")
    order = F.desc("score"), F.desc("a"), F.col("phrase")
    # Each of a language's groups keeps its first ones, so ranking a language takes a bounded number of rows.
    group = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS))).orderBy(*order)
    first = kept.withColumn("rank", F.row_number().over(group)).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "cut", "held")


def query(spark, sf_dir: str) -> DataFrame:
    """Each language's first 2,000 collocations."""
    found = collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.drop("cut", "held")


ORACLE = """
WITH texts AS (
  SELECT row_number() OVER () AS t, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
pieces AS (
  SELECT t, lang, unnest(regexp_split_to_array(x, '[.,;:!?\\x0A-\\x0D]')) AS piece,
         generate_subscripts(regexp_split_to_array(x, '[.,;:!?\\x0A-\\x0D]'), 1) AS p FROM texts),
lists AS (
  SELECT t, lang, p, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, k, unnest([array_to_string(w[s:s + k - 1], ' ') for s in range(1, len(w) - k + 2)]) AS phrase
  FROM lists, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM lists GROUP BY lang),
many AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
cuts AS (
  SELECT lang, phrase, a, c, array_to_string(w[1:c], ' ') AS b, array_to_string(w[c + 1:k], ' ') AS e
  FROM many, (SELECT unnest([1, 2, 3]) AS c) WHERE c < k),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, cuts.c, x.f AS l, y.f AS r,
         CAST((CAST(2000000 AS HUGEINT) * cuts.a) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM cuts JOIN counts x ON x.lang = cuts.lang AND x.phrase = cuts.b
            JOIN counts y ON y.lang = cuts.lang AND y.phrase = cuts.e),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
inside AS (
  SELECT lang, a, unnest(list_distinct([array_to_string(w[s:s + 1], ' ') for s in range(1, k)]
                                       || [array_to_string(w[s:s + 2], ' ') for s in range(1, k - 1) if k = 4])) AS phrase
  FROM many WHERE k > 2),
held AS (SELECT lang, phrase, max(a) AS held FROM inside GROUP BY ALL),
ranked AS (
  SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank,
         best.phrase, a, l, r, score
  FROM best LEFT JOIN held ON held.lang = best.lang AND held.phrase = best.phrase
  WHERE held IS NULL OR CAST(100 AS HUGEINT) * held < CAST(80 AS HUGEINT) * a)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals ON totals.lang = ranked.lang WHERE rank <= 2000
"""
