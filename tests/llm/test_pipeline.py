import hashlib

import pytest

import __spark_entry__ as E
import corpus_pipeline
from tessera.llm import registry
from tests.llm.test_simhash import brute_components
from tests.llm.test_suffix_dedup import brute as brute_suffix
from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(E.queries())
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(registry.QUERIES) <= names and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash", "suffix_dedup", "decontamination", "bpe"]


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle_agrees(spark, name):
    problems, _, _ = compare(spark, duck(SF), name, E.queries()[name], E.oracle_sql()[name], SF)
    assert not problems, problems


def test_stages_one_by_one(spark, tmp_path):
    """Every stage held against brute force on its own input."""
    from tests.llm.test_bpe import PATH  # noqa: F401  (the rank file is there)
    from tests.llm.test_decontamination import brute as brute_bench
    from tests.llm.test_quality_rules import brute as brute_quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs, columns = spark.read.parquet(str(tmp_path / name)), docs.columns
        rows[name] = docs.collect()
        after = {r["doc_id"] for r in rows[name]}
        if name != "bpe":
            assert docs.columns == columns
        if name == "quality_rules":
            assert all(not brute_quality(t)[5] for k, t in before if k in after)
        elif name == "simhash":
            assert after == {c for _, _, c in brute_components(before)}
        elif name == "suffix_dedup":
            want = {k: kept for k, _, _, _, kept in brute_suffix(before)}
            assert {r["doc_id"]: r["text"] for r in rows[name]} == {k: v.decode(errors="ignore") for k, v in want.items()}
        elif name == "decontamination":
            assert after == {k for k, t in before if not brute_bench(t, items)[4]}
        else:
            assert {r["doc_id"]: r["decoded_sha256"] for r in rows[name]} == {
                k: hashlib.sha256(t.encode()).hexdigest() for k, t in before}
