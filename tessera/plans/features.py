"""One parameterised feature plan, fitted once per training set.

The reference builds the same nine-stage pipeline for every model and every
grid point and fits it each time (D8). Here the encoders (DataFrames) and
the feature stages (Spark ML) are fitted once on the training part; the
featurised train/test tables are narrowed to (key, label, features) and
checkpointed to the shared folder, so every regressor reads the same
small, lineage-free input.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import (IDF, FeatureHasher, HashingTF, RegexTokenizer, StandardScaler,
                                StopWordsRemover, StringIndexer, VectorAssembler)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import MIN_TOKEN_LENGTH, TOKEN_PATTERN
from ..operators import encode
from ..session import cached, materialize

# Vector sizes of the hashed text and category features.
TEXT_FEATURES = 100
HASH_FEATURES = 16


@dataclass
class FeatureSpec:
    """What to build; the defaults are the clean run on the movie schema.

    ``encoders`` pairs a column with ``"frequency"`` (E1) or ``"target"``
    (E2). ``reduce`` columns are cut to their ``top_n`` values (E3) before
    hashing. ``numeric`` columns enter the vector as they are; ``indexed``
    columns are string-indexed (unseen -> extra index).
    """

    key: str
    label: str
    text: str | None = "description"
    hashed: list[str] = field(default_factory=lambda: ["genre"])
    reduce: list[str] = field(default_factory=lambda: ["genre"])
    top_n: int = encode.TOP_N
    encoders: list[tuple[str, str]] = field(
        default_factory=lambda: [("director", "frequency"), ("actors", "frequency")])
    numeric: list[str] = field(default_factory=lambda: [
        "duration", "year_clean", "decade", "is_recent", "is_old_classic"])
    indexed: list[str] = field(default_factory=lambda: ["duration_category"])
    smoothing: float = encode.SMOOTHING
    text_features: int = TEXT_FEATURES
    hash_features: int = HASH_FEATURES
    # Partitions of the tables that the fits read, a part of the result (see
    # ``_placed``). None: one per ROWS_PER_PARTITION rows, whatever the cluster.
    fit_partitions: int | None = None

    def encoded_names(self) -> list[str]:
        return [c + ("_freq" if kind == "frequency" else "_encoded") for c, kind in self.encoders]

    def assembled(self) -> list[str]:
        cols = []
        if self.text:
            cols.append("text_features")
        if self.hashed:
            cols.append("hashed_features")
        cols += self.encoded_names()
        cols += self.numeric
        cols += [c + "_indexed" for c in self.indexed]
        return cols


def encode_train_test(train: DataFrame, test: DataFrame, spec: FeatureSpec):
    """Fit the category encoders on train, apply the same tables to both."""
    # One scan of the training rows feeds the top-N cuts and all encoders, which are fitted
    # on the base rows and only then applied. A cut column that is also encoded takes its
    # encoder from the cut values, in a scan of its own.
    shared = [(c, kind) for c, kind in spec.encoders if c not in spec.reduce]
    stats = encode.category_stats(train, [*spec.reduce, *[c for c, _ in shared]],
                                  spec.label if any(kind == "target" for _, kind in shared) else None)
    for c in spec.reduce:
        top = materialize(encode.top_of(stats[c], c, spec.top_n))
        train = encode.reduce_cardinality(train, c, top, n=spec.top_n)
        test = encode.reduce_cardinality(test, c, top, n=spec.top_n)
    fitted = []
    for c, kind in spec.encoders:
        if kind not in ("frequency", "target"):
            raise ValueError(f"unknown encoder {kind!r}")
        if c in spec.reduce:
            fitted += encode.fit_many(train, [(c, kind)], spec.label, spec.smoothing)
        else:
            fitted.append(encode.from_stats(kind, c, stats[c], spec.smoothing))
    for enc in fitted:
        train = enc.apply(train, salt_by=[spec.key])
        test = enc.apply(test, salt_by=[spec.key])
    return train, test


def transform_stages(spec: FeatureSpec) -> list:
    """M1-M3, M5: stateless transformers (tokenise, stop words, hashing)."""
    stages = []
    if spec.text:
        stages += [
            RegexTokenizer(inputCol=spec.text, outputCol="text_words", pattern=TOKEN_PATTERN,
                           minTokenLength=MIN_TOKEN_LENGTH),
            StopWordsRemover(inputCol="text_words", outputCol="text_filtered"),
            HashingTF(inputCol="text_filtered", outputCol="text_tf", numFeatures=spec.text_features),
        ]
    if spec.hashed:
        stages.append(FeatureHasher(inputCols=list(spec.hashed), outputCol="hashed_features",
                                    numFeatures=spec.hash_features))
    return stages


def estimator_stages(spec: FeatureSpec) -> list:
    """M4, M6-M8: stages that learn from the training rows."""
    stages = []
    if spec.text:
        stages.append(IDF(inputCol="text_tf", outputCol="text_features", minDocFreq=0))
    for c in spec.indexed:
        stages.append(StringIndexer(inputCol=c, outputCol=c + "_indexed", handleInvalid="keep"))
    stages += [
        VectorAssembler(inputCols=spec.assembled(), outputCol="features", handleInvalid="skip"),
        StandardScaler(inputCol="features", outputCol="scaled_features", withStd=True,
                       withMean=False),
    ]
    return stages


def feature_stages(spec: FeatureSpec) -> list:
    """M9: the whole nine-stage feature plan, in order."""
    return transform_stages(spec) + estimator_stages(spec)


@dataclass
class Prepared:
    """Featurised, checkpointed inputs shared by every regressor."""

    train: DataFrame
    test: DataFrame
    features: PipelineModel
    spec: FeatureSpec

    def release(self) -> None:
        """Drop the cached tables; their lineage starts at the checkpoints."""
        self.train.unpersist()
        self.test.unpersist()

    def feature_names(self) -> list[str]:
        """Names of the assembled vector slots (from the ML attribute metadata)."""
        meta = self.train.schema["features"].metadata.get("ml_attr", {})
        names: dict[int, str] = {}
        for group in meta.get("attrs", {}).values():
            for a in group:
                names[a["idx"]] = a.get("name", str(a["idx"]))
        size = meta.get("num_attrs", len(names))
        return [names.get(i, f"f{i}") for i in range(size)]


def prepare(train: DataFrame, test: DataFrame, spec: FeatureSpec,
            checkpoint: bool = True) -> Prepared:
    """Encode, fit the feature stages once, narrow, checkpoint and cache.

    The stateless stages run once per side and their narrow output (no raw
    text) is checkpointed, so the estimator fits (IDF, indexers, scaler) do
    not re-tokenise the texts once per stage. The final (key, label,
    features) tables are cached: every regressor iterates over them. Text
    columns are made non-null first: the tokenizer fails on null text.
    """
    if spec.text:
        train = train.withColumn(spec.text, F.coalesce(F.col(spec.text), F.lit("")))
        test = test.withColumn(spec.text, F.coalesce(F.col(spec.text), F.lit("")))
    train_e, test_e = encode_train_test(train, test, spec)
    pre = PipelineModel(stages=transform_stages(spec))
    inputs = [spec.key, spec.label, *spec.encoded_names(), *spec.numeric, *spec.indexed]
    inputs += (["text_tf"] if spec.text else []) + (["hashed_features"] if spec.hashed else [])

    def narrow(df: DataFrame) -> DataFrame:
        out = pre.transform(df).select(*inputs)
        return materialize(out) if checkpoint else out

    train_t, test_t = narrow(train_e), narrow(test_e)
    post = Pipeline(stages=estimator_stages(spec)).fit(train_t)
    model = PipelineModel(stages=pre.stages + post.stages)
    keep = [spec.key, F.col(spec.label).cast("double").alias(spec.label), "features",
            "scaled_features"]
    tr = post.transform(train_t).select(*keep)
    te = post.transform(test_t).select(*keep)
    if checkpoint:
        tr = cached(_placed(tr, spec, train_t.count()))
        te = cached(_placed(te, spec, test_t.count()))
        tr.count(), te.count()
    return Prepared(tr, te, model, spec)


def slot_rows(prep: Prepared) -> DataFrame:
    """M3-M8 laid open: (key, side, slot, value, scaled) for every slot that is not zero.

    One row per row of the training and test tables and named slot of the assembled
    vector, before and after scaling.
    """
    names = F.array(*[F.lit(n) for n in prep.feature_names()])
    both = prep.train.withColumn("side", F.lit("train")).unionByName(prep.test.withColumn("side", F.lit("test")))
    cells = F.arrays_zip(names.alias("slot"), vector_to_array("features").alias("value"),
                         vector_to_array("scaled_features").alias("scaled"))
    cells = F.filter(cells, lambda c: c["value"] != 0)
    return both.select(prep.spec.key, "side", F.explode(cells).alias("c")).select(prep.spec.key, "side", "c.*")


# How many fits may run at once on the tables (the grid search's parallelism).
CONCURRENT_FITS = 4


# Rows of a partition that the fits read. A tree level or a gradient step is one
# task a partition, so small tables are one task and large ones as many as they need.
ROWS_PER_PARTITION = 100_000


def fit_partitions(rows: int, spec: FeatureSpec) -> int:
    """Partitions for ``rows`` training rows: from the rows alone, so fits repeat on any cluster."""
    return spec.fit_partitions or max(1, -(-rows // ROWS_PER_PARTITION))


def _placed(df: DataFrame, spec: FeatureSpec, rows: int) -> DataFrame:
    """Rows dealt by key into ``fit_partitions`` partitions, in key order.

    Bagging and mini-batches draw random numbers per partition and row. With
    partitions and their order fixed by the key, a fit repeats on any cluster.
    """
    return dealt(df, spec.key, fit_partitions(rows, spec))


def dealt(df: DataFrame, key: str, partitions: int) -> DataFrame:
    """Rows in ``partitions`` partitions by key, each in key order (at least one partition)."""
    return df.repartition(max(1, partitions), key).sortWithinPartitions(key)
