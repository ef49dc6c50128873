"""Stage 2 and the evaluators: embed the datasets, fit classifiers, report metrics (V3-V8)."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from vellum.operators import metrics as MT
from vellum.operators import models as MD
from vellum.operators.encode import TextEncoder
from vellum.operators.subwords import SubwordTable
from vellum.session import scratch_path
from vellum.sources.cache import EmbeddingStore, content_hash


def embed_split(encoder: TextEncoder, df: DataFrame, keep: list[str], label: str,
                store: EmbeddingStore | None = None, encoder_id: str | None = None,
                split: str = "all") -> DataFrame:
    """Embed once and persist (store, or a scratch table): every later model fit re-reads the
    vectors instead of re-running the encoder. Stored vectors answer only for the same encoder id,
    projection weights and rows."""
    if store is not None and encoder_id:
        p = encoder.projection
        weights = hashlib.sha1(p.W.tobytes() + p.b.tobytes()).hexdigest() if p is not None else ""
        if isinstance(encoder.featurizer, SubwordTable):
            weights += hashlib.sha1(encoder.featurizer.matrix(df.sparkSession).tobytes()).hexdigest()
        encoder_id = f"{encoder_id}|{weights}|{content_hash(df, *keep, label, encoder.text)}"
        cached = store.load(encoder_id, split)
        if cached is not None:
            return cached
    emb = encoder.transform(df.select(*keep, label, encoder.text)).select(*keep, label, "embedding")
    if store is not None and encoder_id:
        store.save(emb, encoder_id, split)
        return store.load(encoder_id, split)
    path = scratch_path(df.sparkSession, f"embed-{split}")
    emb.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def train_and_evaluate(train_emb: DataFrame, test_emb: DataFrame, label: str, keep: list[str],
                       models: list[str], seed: int = 42, settings: dict[str, dict] | None = None) -> dict[str, DataFrame]:
    """Fit each preset; return the long scored table, per (model, split) AUC, ROC points on the
    test split, confusion matrices, reports and the ranked comparison."""
    tr = train_emb.withColumnRenamed(label, "label") if label != "label" else train_emb
    te = test_emb.withColumnRenamed(label, "label") if label != "label" else test_emb
    scored = MD.train_models(tr, te, "embedding", "label", models, seed, keep, settings)
    path = scratch_path(train_emb.sparkSession, "scored")
    scored.write.mode("overwrite").parquet(path)
    scored = train_emb.sparkSession.read.parquet(path)
    by = ["model", "split"]
    return {
        "scores": scored,
        "auc": MT.roc_auc(scored, by=by),
        "roc": MT.roc_curve(scored.filter("split = 'test'"), by=["model"]),
        "confusion": MT.confusion_matrix(scored, by=by),
        "report": MT.classification_report(scored, by=by),
        "comparison": MT.compare_models(scored),
    }


def evaluate_checkpoint(spark, checkpoint_path: str, train: DataFrame, test: DataFrame, label: str,
                        keep: list[str], store: EmbeddingStore | None = None,
                        settings: dict[str, dict] | None = None) -> dict[str, DataFrame]:
    """V7: encoder from a checkpoint folder -> cached vectors -> LR (balanced) and GBT (quick)."""
    enc = TextEncoder.load(spark, checkpoint_path)
    eid = checkpoint_path.rstrip("/")
    tr = embed_split(enc, train, keep, label, store, eid, "train")
    te = embed_split(enc, test, keep, label, store, eid, "test")
    return train_and_evaluate(tr, te, label, keep, ["lr_checkpoint", "gbt_quick"], settings=settings)


def evaluate_encoder(spark, encoder_path: str, train: DataFrame, test: DataFrame, label: str,
                     keep: list[str], store: EmbeddingStore | None = None,
                     settings: dict[str, dict] | None = None) -> dict[str, DataFrame]:
    """V8: the saved encoder on train and test with three classifiers."""
    enc = TextEncoder.load(spark, encoder_path)
    eid = encoder_path.rstrip("/")
    tr = embed_split(enc, train, keep, label, store, eid, "train")
    te = embed_split(enc, test, keep, label, store, eid, "test")
    return train_and_evaluate(tr, te, label, keep, ["lr_encoder", "gbt_quick", "mlp"], settings=settings)
