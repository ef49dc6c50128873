"""Stage 1: labelled look-back text datasets for a train and a test date range, cached as a set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.functions.text import parse_date
from vellum.operators import lookback as LB
from vellum.sources.cache import content_hash, materialize

SPLIT = "dataset_split"


def build_train_test(messages: DataFrame, spine: DataFrame, train_range: tuple[str, str],
                     test_range: tuple[str, str], days: int, max_tokens: int | None = 512,
                     separator: str = LB.DEFAULT_SEPARATOR, tokenizer: str = "words", method: str = "bucketed",
                     key: str = "UserLoanId", ts: str = "CreatedAt", body: str = "body",
                     label: str = "DefaultDPD21", cache_dir: str | None = None,
                     use_cache: bool = True, inputs: str | None = None,
                     prefilter: bool = False) -> tuple[DataFrame, DataFrame]:
    """One look-back plan over the spine rows of both ranges, then split by date. Without
    ``cache_dir`` the two frames are lazy and each evaluation runs the plan. With
    ``cache_dir`` that one pass is written once, partitioned by ``dataset_split`` (a row in both
    ranges is written to both), keyed by every parameter and by the contents of both tables, and each
    split is read back by partition pruning. ``inputs`` names the contents (a version, a snapshot id)
    and saves the pass that hashes them. The message scan gets the time range of all windows."""
    (a, b), (c, d) = train_range, test_range
    in_train = (F.col(ts) >= parse_date(a)) & (F.col(ts) < parse_date(b))
    in_test = (F.col(ts) >= parse_date(c)) & (F.col(ts) < parse_date(d))
    both = spine.filter(in_train | in_test)
    span = min(a, c), max(b, d)

    def dataset():
        return LB.build_dataset(messages, both, days, max_tokens, separator, key, ts, body, label,
                                method, tokenizer, anchor_range=span, prefilter=prefilter)

    if not cache_dir:
        ds = dataset()
        return ds.filter(in_train), ds.filter(in_test)
    spark = spine.sparkSession
    params = {"train": train_range, "test": test_range, "days": days, "max_tokens": max_tokens,
              "separator": separator, "tokenizer": tokenizer, "key": key, "ts": ts, "body": body,
              "label": label, "method": method,
              "inputs": inputs or [content_hash(messages, key, ts, body), content_hash(both, key, ts, label)],
              "layout": "one pass, partitioned by dataset_split"}

    def tagged():
        splits = F.array_compact(F.array(F.when(in_train, F.lit("train")), F.when(in_test, F.lit("test"))))
        return dataset().withColumn(SPLIT, F.explode(splits))

    got = materialize(spark, {"datasets": tagged}, cache_dir, params, use_cache, partition_by=[SPLIT])["datasets"]
    return (got.filter(F.col(SPLIT) == "train").drop(SPLIT),
            got.filter(F.col(SPLIT) == "test").drop(SPLIT))
