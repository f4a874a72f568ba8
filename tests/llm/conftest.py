import pytest

PAD = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt "


@pytest.fixture(scope="session")
def texts():
    """Null, empty, blank, short, non-ASCII, odd white space, long, and equal texts."""
    passage = "The quick brown fox jumps over the lazy dog while seven wizards quietly judge my vow of silence today. "
    return [
        None, "", "   \n\t ", "a", "two words", "É À ß 日本語 \U0001f600 don't we'll 123 ...!!",
        "x" * 5000, "\x0b\x0cpage\rbreaks\n\n\nline\nline\nline", PAD * 400, "same text here " * 3, "same text here " * 3,
        passage + "first tail that is its own", "an own head " + passage + "second tail", passage * 3,
        "#$%& | <> ** " * 20, "UPPER lower MiXeD words " * 30,
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """documents with null, repeated and equal ids, and columns named like outputs."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, None if t is None else len(t), "x")
            for i, t in enumerate(texts)]
    rows += [rows[8], rows[9], (None, "no id at all but text", "en", "s1", 21, "x"), (3, "other text, same id", "fr", "s0", 19, "x")]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").repartition(3)


@pytest.fixture(scope="session")
def clash(docs):
    """The same rows with every output's name already taken."""
    from pyspark.sql import functions as F

    taken = ["ids", "decoded", "host", "path", "rule", "verdict", "shard", "slot", "score", "lang_pred", "spans",
             "component", "fp", "n_words", "bucket", "start", "rules",
             # Names that operators use inside.
             "__words", "__n_words", "__lines", "__grams", "__sorted", "__places", "__rules", "__row", "__text", "__lang",
             "__source", "__kept", "__verdict", "__d", "__t", "__key", "__hash", "__k", "__h", "row", "id", "digest", "hash",
             "h", "p", "found", "shapes", "__null", "__tie", "__z", "kept_sha256", "n_removed"]
    return docs.select("*", *[F.lit("taken").alias(c) for c in taken])
