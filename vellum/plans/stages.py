"""The two stages as functions: catalog to saved encoder, and saved encoder to compared classifiers; plus
embedding a file with a checkpoint and keeping the vectors of a growing table up to date."""

from __future__ import annotations

import datetime as _dt
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import lookback as LB
from vellum.operators import models as MD
from vellum.operators.encode import TextEncoder, load_encoder
from vellum.operators.profile import batch_stats, dataset_profile, union_all
from vellum.plans import evaluate as EV
from vellum.plans.dataset import build_train_test
from vellum.session import require_columns, scratch_path
from vellum.sources import cache as CA
from vellum.sources import fs as FS
from vellum.sources.cache import EmbeddingStore, content_hash, load_data, params_key
from vellum.sources.catalog import FULL, TableCatalog
from vellum.sources.versions import VersionedTable

KEY, TS, LABEL, TEXT = "UserLoanId", "CreatedAt", "DefaultDPD21", "concatenated_body"


@dataclass
class Stage1:
    encoder: TextEncoder
    train: DataFrame
    test: DataFrame
    encoder_path: str
    from_cache: bool

    def profile(self) -> DataFrame:
        """A6 of both datasets."""
        return union_all(dataset_profile(self.train, "train", LABEL), dataset_profile(self.test, "test", LABEL))


def fit_stage1(lake: TableCatalog, cache_dir: str, train_range: tuple[str, str], test_range: tuple[str, str],
               days: int = 28, max_tokens: int | None = 256, separator: str = "---", messages: str = "android_sms",
               spine: str = "label_spine", encoder: dict | None = None, use_cache: bool = True,
               tokenizer: str = "words", prefilter: bool = True, inputs: str | None = None) -> Stage1:
    """Stage 1: read spine and messages by name, split by date, build the look-back datasets, train the
    encoder on the train split, save all.

    With ``use_cache`` the datasets and the encoder that equal parameters and equal input tables made before
    are read back and nothing is computed; a missing encoder is fitted on the cached datasets. Without it
    everything is built anew and replaces the cached state. ``inputs`` names the state of the input tables
    (a version, a snapshot id); otherwise their contents are hashed, one pass over the rows the windows
    can reach. ``encoder``: settings of ``TextEncoder.fit_joint``; training checkpoints are not kept."""
    spark, cache_dir = lake.spark, cache_dir.rstrip("/")
    lo = min(train_range[0], test_range[0])
    hi = max(train_range[1], test_range[1])
    labels = lake.read_all(spine)
    require_columns(labels, KEY, TS, LABEL, what="spine")
    low = _dt.datetime.fromisoformat(lo) - _dt.timedelta(days=days)
    if lake.tables.get(messages, (None,))[0] != FULL:
        lake.update_statistics(messages, TS)
    log = lake.read_between(messages, TS, low, _dt.datetime.fromisoformat(hi))
    spine_rows = labels.select(KEY, TS, LABEL)
    state = inputs or f"{content_hash(log, KEY, TS, 'body')}|{content_hash(LB.date_range(spine_rows, lo, hi), KEY, TS, LABEL)}"
    train, test = build_train_test(log, spine_rows, train_range, test_range, days, max_tokens, separator, tokenizer,
                                   cache_dir=f"{cache_dir}/datasets", use_cache=use_cache, inputs=state, prefilter=prefilter)
    settings = dict(encoder or {})
    path = f"{cache_dir}/encoders/" + params_key({"inputs": state, "train": train_range, "days": days, "encoder": settings,
                                                  "max_tokens": max_tokens, "separator": separator, "tokenizer": tokenizer})
    done = f"{path}/_DONE"
    found = load_encoder(spark, path) if use_cache and FS.exists(spark, done) else None
    if found is None:
        if FS.exists(spark, done):
            FS.delete(spark, done)
        TextEncoder.fit_joint(train, TEXT, LABEL, **settings).save(path)
        FS.write_text(spark, done, json.dumps(settings, default=str))
        found_now = TextEncoder.load(spark, path)
        return Stage1(found_now, train, test, path, False)
    return Stage1(found, train, test, path, True)


def run_stage2(encoder: TextEncoder, train: DataFrame, test: DataFrame, models: str | list[str] = "all",
               label: str = LABEL, keep: tuple[str, ...] = (KEY, TS), store: EmbeddingStore | None = None,
               encoder_id: str | None = None, settings: dict[str, dict] | None = None, seed: int = 42) -> dict[str, DataFrame]:
    """Stage 2: vectors of both splits (from ``store`` where it has them), the selected classifiers with
    their stage-2 configurations, and scores, AUC, ROC points, confusion, report and ranking. ``models`` is
    ``all``, one of ``models.SWITCH`` (trees, logistic, network) or a list of presets; ``settings`` overrides
    a preset's settings by name."""
    keep = list(keep)
    tr = EV.embed_split(encoder, train, keep, label, store, encoder_id, "train")
    te = EV.embed_split(encoder, test, keep, label, store, encoder_id, "test")
    return EV.train_and_evaluate(tr, te, label, keep, MD.switch(models), seed, settings)


def embed_file(spark: SparkSession, checkpoint: str, data: str, out: str, keep: list[str] | None = None) -> DataFrame:
    """Vectors of the texts at ``data`` by the encoder at ``checkpoint``, written to ``out`` with the ``keep``
    columns (default: all but the text). A missing checkpoint names those beside it; missing or unreadable
    data raises FileNotFoundError."""
    checkpoint = checkpoint.rstrip("/")
    if not FS.exists(spark, f"{checkpoint}/encoder.json"):
        others = CA.list_checkpoints(spark, checkpoint.rsplit("/", 1)[0])
        raise FileNotFoundError(f"no encoder at {checkpoint}; found {others}")
    rows = load_data(spark, data)
    if rows is None:
        raise FileNotFoundError(f"no readable dataset at {data}")
    enc = TextEncoder.load(spark, checkpoint)
    require_columns(rows, enc.text, *(keep or []), what="dataset")
    kept = keep if keep is not None else [c for c in rows.columns if c != enc.text]
    enc.transform(rows.select(*kept, enc.text)).select(*kept, "embedding").write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


RANGES = 8  # ranges of text hashes that are encoded and published one after the other


def update_vectors(encoder: TextEncoder, df: DataFrame, path: str, keep: list[str], ranges: int = RANGES) -> DataFrame:
    """``df``'s ``keep`` columns with their vectors, encoding only texts that the store at ``path`` does not
    hold yet. A vector is keyed by a 128-bit hash of its text, so copies are encoded once. Missing texts are
    encoded in ``ranges`` ranges of that hash, each published as a version of the store: an ended run goes on
    with the ranges that are missing. One store belongs to one encoder.

    Null texts have the vector of the empty text; every row of ``df`` is returned once."""
    spark = df.sparkSession
    require_columns(df, encoder.text, *keep, what="dataset")
    store = VersionedTable(spark, path)
    text = F.coalesce(F.col(encoder.text).cast("string"), F.lit(""))
    h1, h2 = F.xxhash64(text).alias("_h1"), F.xxhash64(F.lit(1), text).alias("_h2")
    rows = df.select(*keep, h1, h2)
    texts = df.select(text.alias(encoder.text), h1, h2)
    missing = texts if store.manifest() is None else texts.join(
        store.read().select("_h1", "_h2"), ["_h1", "_h2"], "left_anti")
    work = scratch_path(spark, "new-texts")
    part = F.pmod("_h1", F.lit(int(ranges))).alias("_part")
    (missing.dropDuplicates(["_h1", "_h2"]).select("*", part).write.partitionBy("_part").parquet(work))
    present = sorted(e.name for e in FS.list_children(spark, work) if e.name.startswith("_part="))
    for name in present:
        new = spark.read.parquet(f"{work}/{name}")
        store.append(encoder.transform(new).select("_h1", "_h2", "embedding"))
    FS.delete(spark, work)
    if store.manifest() is None:  # an empty table and a new store
        store.append(encoder.transform(texts.limit(0)).select("_h1", "_h2", "embedding"))
    return rows.join(store.read(), ["_h1", "_h2"]).select(*keep, "embedding")
