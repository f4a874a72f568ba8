import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from tessera.llm import bpe

PATH = P.path(bpe.RANK_FILE)


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def merges():
    with open(PATH, "rb") as f:
        return bpe.Merges(f.read())


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_random_texts_match_tiktoken(reference, merges):
    rng = random.Random(5)
    parts = ["a", "aa", "b", " ", "  ", "\n", "é", "ß", "1", "23", "!!", "...", "\u3000", "中", "\U0001f600", "'s", "'ll",
             "the", " the", "==", "--", "\t", "\x00", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(800)]
    texts += ["a" * 3000, " " * 999, "=-" * 700, "", None]
    got = bpe.encode_block(merges, regex.compile(P.PATTERN), texts)
    assert [ids(g) for g in got] == [reference.encode_ordinary(t or "") for t in texts]


def test_replay_equals_plain_queue(merges):
    words = [b"unbelievable", b"aaaaaaaaaaaaa", b"mississippi" * 9, bytes(range(256)), b"=" * 100]
    assert merges.replay(words) == [merges.merge_one(w) if w not in merges.ranks else
                                    merges.ranks[w].to_bytes(4, "little") for w in words]


def test_late_lower_rank_is_redone_per_word():
    # "ab" merges late, then "abc" has a lower rank: the order inside the word decides.
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"bab"]
    table = b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(tokens))
    m = bpe.Merges(table)
    words = [b"xabcab", b"ababc", b"babab", b"abab"]
    enc = tiktoken.Encoding("t", pat_str=r".+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    assert [ids(x) for x in m.replay(words)] == [enc.encode_ordinary(w.decode()) for w in words]


def test_block_and_cache_bounds_do_not_change_ids(merges, monkeypatch):
    texts = [f"word{i} other{i % 7} {'z' * (i % 90)}" for i in range(300)]
    split = regex.compile(P.PATTERN)
    whole = bpe.encode_block(merges, split, texts)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    assert [bpe.encode_block(merges, split, [t])[0] for t in texts] == whole


def test_documents(spark, clash, reference):
    packed = bpe.encode(clash, PATH, P.PATTERN)
    both = bpe.decode(packed, PATH)
    assert set(both.columns) == (set(clash.columns) - {"text"}) | {"ids", "decoded"}
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, bytes(r["ids"]), bytes(r["decoded"])) for r in both.collect())
    want = []
    for r in clash.select("doc_id", "text").collect():
        text = r["text"] or ""
        want.append((r["doc_id"] if r["doc_id"] is not None else -1,
                     np.array(reference.encode_ordinary(text), "<u4").tobytes(), text.encode()))
    assert got == sorted(want)


def test_digests(docs, reference):
    rows = {(r["doc_id"], r["decoded_sha256"]): r for r in bpe.digests(docs).collect()}
    for r in docs.collect():
        text = r["text"] or ""
        found = rows[r["doc_id"], hashlib.sha256(text.encode()).hexdigest()]
        want = reference.encode_ordinary(text)
        assert found["n_tokens"] == len(want)
        assert found["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()


def test_empty_table(docs):
    assert bpe.digests(docs.limit(0)).collect() == []
