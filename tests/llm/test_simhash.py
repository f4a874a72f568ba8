import random

import numpy as np
import xxhash

from tessera.llm import simhash as S
from tessera.llm.common import components


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[k:k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """Smallest key reachable over links of at most two bits."""
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted((k if k is not None else -1, fps[i], least.get(find(i), -1)) for i, (k, _) in enumerate(rows))


def test_words_within_two_bits_share_a_golay_index():
    errors, _ = S._TABLES
    assert len(set(errors.tolist())) == 2048 and np.bitwise_count(errors).max() == 3
    flips = [0, *(1 << i for i in range(23)), *(1 << i | 1 << j for i in range(23) for j in range(i))]
    mine = S.golay_indices(errors)  # one word of every coset; the code is linear
    for e in flips:
        assert (mine[:, :, None] == S.golay_indices(errors ^ e)[:, None, :]).any(axis=(1, 2)).all()


def test_keys_of_pairs_within_two_bits_meet():
    rng = random.Random(4)
    a = [rng.getrandbits(64) for _ in range(3000)]
    b = [x ^ (1 << rng.randrange(64)) ^ (rng.randrange(2) << rng.randrange(64)) for x in a]
    ka, kb = S.keys_of(np.array(a, np.uint64)), S.keys_of(np.array(b, np.uint64))
    assert all(set(x) & set(y) for x, y in zip(ka.tolist(), kb.tolist(), strict=True))


def near(n, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(900)}" for _ in range(rng.choice([4, 40, 300]))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(900)}"
        rows.append((i, " ".join(words)))
    return rows


def test_components_match_brute_force(spark, texts):
    rows = near(220, 1) + [(1000 + i, t) for i, t in enumerate(texts)] + [(None, "null id"), (None, None), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r["__key"] if r["__key"] is not None else -1, r["fp"] & (1 << 64) - 1,
                  r["component"] if r["component"] is not None else -1) for r in S.cluster(df).collect())
    assert got == brute_components(rows)


def test_crowded_keys_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(S, "CROWD", 2)
    rows = near(220, 2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["__key"], r["fp"] & (1 << 64) - 1, r["component"]) for r in S.cluster(df).collect())
    assert got == brute_components(rows)


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(300, 299), (300, 299)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(30)}, 299: 299, 300: 299}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_stage_keeps_one_of_each_component(spark, clash):
    out = S.stage(spark, clash, "").collect()
    rows = [(r["doc_id"], r["text"]) for r in clash.collect()]
    wanted = {(c, f) if c >= 0 else f for k, f, c in brute_components(rows)}
    assert len(out) == len({c if c >= 0 else ("f", f) for _, f, c in brute_components(rows)}) and wanted
    assert set(out[0].asDict()) == set(clash.columns)
    assert S.stage(spark, clash.limit(0), "").collect() == []


def test_empty_query(spark, docs):
    assert S.cluster(docs.limit(0)).collect() == []


def test_stage_returns_every_column_unchanged(spark, clash):
    taken = [c for c, kind in clash.dtypes if c not in ("doc_id", "text", "lang", "source", "n_chars", "kept")]
    rows = S.stage(spark, clash, "").collect()
    assert rows and all(r[c] == "taken" for r in rows for c in taken)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in S.query(spark, sf).collect())
    assert got == brute_components(rows)
