"""Text -> vector.

E1: hashed subword vectors, averaged per text and trained jointly with the projection (``subwords``, the
default: no vocabulary); or word tokens -> Word2Vec, whose ``transform`` averages the token vectors; or
hashed term frequencies with IDF and L2 norm. E2/E3: the learned projection head
(``ContrastiveProjection``). E4: ``TextEncoder.transform`` embeds a whole table; a user's own
model can be plugged in through ``embed_with_model`` (Arrow batches via ``predict_batch_udf``).
"""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer, Word2Vec
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions.text import WORD_PATTERN
from vellum.operators.contrastive import ContrastiveProjection, ProjectionModel, l2_normalize
from vellum.operators.subwords import JointEncoderFit, SubwordTable
from vellum.session import require_columns
from vellum.sources import fs as FS

FEATURIZERS = ("subwords", "word2vec", "hashing")
# Spark ML's Word2Vec collects its vocabulary (and the vocabulary x vector_size model) to the
# driver: for that kind the vocabulary is counted first and a larger one is refused.
MAX_VOCAB = 2_000_000
W2V_PARTITIONS = 8  # a fixed number: vectors must not depend on the cores


def featurizer_pipeline(text: str, kind: str = "word2vec", vector_size: int = 64, min_count: int = 1,
                        seed: int = 42, num_features: int = 1024, num_partitions: int | None = None,
                        max_iter: int = 1) -> Pipeline:
    if kind not in FEATURIZERS:
        raise ValueError(f"kind must be one of {FEATURIZERS}")
    tok = RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=WORD_PATTERN, gaps=False, toLowercase=True)
    if kind == "word2vec":
        w2v = Word2Vec(inputCol="_tokens", outputCol="_fvec", vectorSize=vector_size, minCount=min_count,
                       seed=seed, maxIter=max_iter)
        if num_partitions:
            w2v.setNumPartitions(num_partitions)
        return Pipeline(stages=[tok, w2v])
    return Pipeline(stages=[tok, HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
                            IDF(inputCol="_tf", outputCol="_idf"),
                            Normalizer(inputCol="_idf", outputCol="_fvec", p=2.0)])


def vocabulary_size(df: DataFrame, text: str, min_count: int, cap: int) -> int:
    """Distinct lower-cased word tokens seen at least ``min_count`` times, counted up to ``cap + 1``
    (a distributed aggregate; only the count reaches the driver)."""
    tok = RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=WORD_PATTERN, gaps=False, toLowercase=True)
    words = tok.transform(df.select(F.coalesce(F.col(text), F.lit("")).alias(text))) \
        .select(F.explode("_tokens").alias("_w"))
    return words.groupBy("_w").count().filter(F.col("count") >= min_count).limit(cap + 1).count()


class TextEncoder:
    """Featurizer (+ optional learned projection). Without a projection the features are only
    L2-normalized."""

    def __init__(self, featurizer: PipelineModel | SubwordTable, text: str, projection: ProjectionModel | None = None):
        self.featurizer = featurizer
        self.text = text
        self.projection = projection

    @classmethod
    def fit_featurizer(cls, df: DataFrame, text: str, **kw) -> "TextEncoder":
        """E1 fit on the texts of ``df``. The default kind ``subwords`` needs no pass here (its vectors are
        trained by ``fit_joint``; ``buckets``, ``vector_size`` and ``seed`` size it)."""
        require_columns(df, text)
        kind = kw.pop("kind", "subwords")
        if kind == "subwords":
            return cls(SubwordTable(None, int(kw.get("buckets", 1 << 16)), int(kw.get("vector_size", 32)),
                                    int(kw.get("seed", 42))), text)
        if kind == "word2vec":
            kw.setdefault("num_partitions", W2V_PARTITIONS)
            n = vocabulary_size(df, text, int(kw.get("min_count", 1)), MAX_VOCAB)
            if n > MAX_VOCAB:
                raise ValueError(f"vocabulary over {MAX_VOCAB} words at min_count={kw.get('min_count', 1)}: "
                                 "raise min_count or use kind='subwords'")
        return cls(featurizer_pipeline(text, kind=kind, **kw).fit(df.select(text)), text)

    @classmethod
    def fit_joint(cls, df: DataFrame, text: str, label: str, initial: "TextEncoder | None" = None, **kw) -> "TextEncoder":
        """E1 + E10: token vectors and projection trained together (``JointEncoderFit`` settings in ``kw``);
        ``initial`` continues a fitted encoder of the same sizes (E11)."""
        before = (initial.featurizer, initial.projection) if initial is not None else None
        table, head = JointEncoderFit(**kw).fit(df, text, label, before)
        return cls(table, text, head)

    def features(self, df: DataFrame, out: str = "features") -> DataFrame:
        if self.text not in df.columns:
            raise ValueError(f"input has no text column {self.text!r}")
        if isinstance(self.featurizer, SubwordTable):
            return self.featurizer.transform(df, self.text, out)
        f = self.featurizer.transform(df.withColumn(self.text, F.coalesce(F.col(self.text), F.lit(""))))
        return f.withColumn(out, vector_to_array("_fvec")).drop("_tokens", "_fvec", "_tf", "_idf")

    def transform(self, df: DataFrame, out: str = "embedding") -> DataFrame:
        """The embedding of every row's text (keys travel with their vector)."""
        f = self.features(df, "_features")
        if self.projection is None:
            return f.withColumn(out, l2_normalize("_features").cast("array<float>")).drop("_features")
        return self.projection.transform(f, "_features", out).drop("_features")

    def fit_projection(self, df: DataFrame, label: str, **kw) -> "TextEncoder":
        """E10 on top of E1: learn the projection from the featurized texts; ``initial`` in
        ``kw`` continues a previous projection (E11)."""
        initial = kw.pop("initial", None) or self.projection
        f = self.features(df, "features").select("features", label)
        est = ContrastiveProjection(features="features", label=label, **kw)
        return TextEncoder(self.featurizer, self.text, est.fit(f, initial=initial))

    # -- S12: directory with the Spark ML featurizer and the projection parquet row
    def save(self, path: str) -> None:
        path = path.rstrip("/")
        from pyspark.sql import SparkSession

        sp = SparkSession.getActiveSession()
        if isinstance(self.featurizer, SubwordTable):
            self.featurizer.save(sp, f"{path}/featurizer")
        else:
            self.featurizer.write().overwrite().save(f"{path}/featurizer")
        if self.projection is not None:
            self.projection.save(sp, f"{path}/projection")
        FS.write_text(sp, f"{path}/encoder.json", json.dumps({"text": self.text,
                                                               "projection": self.projection is not None}))

    @classmethod
    def load(cls, spark, path: str) -> "TextEncoder":
        path = path.rstrip("/")
        meta = FS.read_text(spark, f"{path}/encoder.json")
        if meta is None:
            raise FileNotFoundError(f"no encoder at {path}")
        meta = json.loads(meta)
        proj = ProjectionModel.load(spark, f"{path}/projection") if meta["projection"] else None
        table = SubwordTable.load(spark, f"{path}/featurizer")
        return cls(table or PipelineModel.load(f"{path}/featurizer"), meta["text"], proj)


def load_encoder(spark, path: str) -> TextEncoder | None:
    """The encoder at ``path`` or None (missing or unreadable)."""
    try:
        return TextEncoder.load(spark, path)
    except Exception:  # noqa: BLE001
        return None


def embed_with_model(df: DataFrame, col: str, make_predict_fn, dim: int, batch_size: int = 256,
                     out: str = "embedding") -> DataFrame:
    """E4 for a user's own model: ``make_predict_fn()`` returns ``f(np.ndarray[str]) -> (n, dim)``;
    it runs once per Python worker on Arrow batches of ``batch_size`` texts."""
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size,
                            input_tensor_shapes=None)
    return df.withColumn(out, udf(F.coalesce(F.col(col), F.lit(""))))
