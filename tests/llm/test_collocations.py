import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import collocations as co

SCHEMA = "text string, lang string, rank string, phrase string, a string, score string, words string, n string"


def _frame(spark, texts):
    return spark.createDataFrame([(t, g, "r", "p", "a", "s", "w", "n") for t, g in texts], SCHEMA).repartition(3)


def _fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _counts(texts):
    f, n = defaultdict(Counter), Counter()
    for text, lang in texts:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _fold(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[s:s + k]) for s in range(len(w) - k + 1))
    return f, n


def _brute(texts, least, top):
    out = set()
    counts, n = _counts(texts)
    for lang, f in counts.items():
        many = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        rows = []
        for p, a in many.items():
            if any(len(q) > len(p) and 100 * c >= 80 * a and any(q[s:s + len(p)] == p for s in range(len(q)))
                   for q, c in many.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out |= {(lang, i, p.decode(), -a, le, r, n[lang], -s) for i, (s, a, p, le, r) in enumerate(sorted(rows)[:top], 1)}
    return out


def _got(df):
    rows = [tuple(r) for r in df.drop("cut", "held").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.fixture
def small(monkeypatch):
    """Many shards, splits and buckets on little text."""
    for name, value in (("SHARD_WORDS", 60), ("SPLIT_BYTES", 50), ("BUCKET_WORDS", 40)):
        monkeypatch.setattr(co, name, value)


def _random(seed, n, vocabulary):
    rng = np.random.default_rng(seed)
    ends = [" "] * 12 + ["  ", "\t", ". ", ", ", "\n", "!", " ?! "]
    return ["".join(vocabulary[min(int(rng.exponential(3)), len(vocabulary) - 1)] + ends[rng.integers(len(ends))]
                    for _ in range(rng.integers(0, 60))) for _ in range(n)]


def test_equals_brute_force(spark, small):
    vocabulary = ["the", "The", "a", "É", "é", "日本", "don't", "\x00x", "new\x1cyork", "a-b", "ß", "x" * 40]
    texts = [(t, lang) for lang in ("en", "und", None, "d e") for t in _random(hash(lang is None) % 7 + len(lang or ""), 60, vocabulary)]
    want = _brute(texts, 5, 40)
    assert len(want) > 60
    assert _got(co.collocations(_frame(spark, texts), least=5, top=40)) == want


def test_odd_texts(spark, small, texts):
    rows = [(t, g) for t in texts for g in ("en", None)] * 3 + [("one two " * 300, "en"), ("a b c d " * 20, "fr"), (".,;!\n" * 50, "es")]
    assert _got(co.collocations(_frame(spark, rows), least=4, top=100)) == _brute(rows, 4, 100)
    assert co.collocations(_frame(spark, [])).count() == 0
    assert co.collocations(_frame(spark, [(None, None), ("", "en"), ("short text", "en")])).count() == 0


def test_long_text_without_piece_ends_stays_whole(spark, small):
    rows = [("p q r s t " * 200, "en")]
    got = {r.phrase: r.a for r in co.phrases(_frame(spark, rows), least=150)[0].selectExpr("phrase", "count a").collect()}
    assert got["p q r s"] == 200 and got["t p q r"] == 199 and got["t"] == 200


def test_colliding_hashes_change_nothing(spark, small, monkeypatch):
    texts = [(t, "en") for t in _random(5, 80, ["a", "b", "c", "d", "e", "f"])]
    monkeypatch.setattr(co, "HASH_BITS", 3)
    assert _got(co.collocations(_frame(spark, texts), least=6, top=50)) == _brute(texts, 6, 50)


@pytest.mark.parametrize("narrow", [co.NARROW, 1])
def test_index_extends_both_ways(monkeypatch, narrow):
    monkeypatch.setattr(co, "NARROW", narrow)
    rng = np.random.default_rng(9)
    x = np.concatenate([[0], rng.integers(0, 5, 400), [0]]).astype(np.int32)
    index = co.Index(x)
    seen = Counter(tuple(x[i:i + k].tolist()) for k in (1, 2, 3, 4) for i in range(len(x) - k + 1))
    want = lambda k: {p: c for p, c in seen.items() if len(p) == k and 0 not in p}
    word, count, forward, backward = index.words()
    phrases, sides = [(int(w),) for w in word], (1, -1, 1)
    assert dict(zip(phrases, count.tolist(), strict=True)) == want(1)
    for side in sides:
        if side < 0:
            which, added, count, forward, backward = index.extend(-1, count, forward, backward)
        else:
            which, added, count, backward, forward = index.extend(1, count, backward, forward)
        phrases = [(a, *phrases[w]) if side < 0 else (*phrases[w], a) for w, a in zip(which.tolist(), added.tolist(), strict=True)]
        assert dict(zip(phrases, count.tolist(), strict=True)) == want(len(phrases[0]))


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = [(r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert _got(co.query(spark, sf)) == _brute(texts, 30, 2000)
