"""Ranked lexical search by pipelined term partitioning.

Every item (a query text) is scored against every document with integer term contributions; the ``k``
best documents per item are returned. Terms are owned by stages, rare terms first: stage ``s`` owns the
terms whose share of the documents lies in the ``s``-th band. Items travel in bundles of about ``BUNDLE``.
A bundle visits the owner stages one after the other and carries a sparse accumulator (documents and
integer scores) per item; at each stage a cogroup brings bundle and postings together and adds the
contributions. The selection follows the last stage.

Postings are cut into shards of at most ``SHARD_DOCS`` documents of one scan task, one row per (shard,
term), so a very frequent term is many short lists and a cogroup holds one bundle and one shard: at most
``BUNDLE x SHARD_DOCS`` scores, whatever the tables' sizes. Only terms of items are posted: a Bloom
filter of fixed size goes to the scan, the join with the owners' terms is exact.

Accumulators shrink without loss: what the later stages can still add to an item is bounded by the sum
of their weights times ``SCALE``. A document that cannot reach the shard's ``k``-th score any more is
dropped, and once a new document could not reach it either, later stages only update known ones.

Defined cases: rows of one item id (null ids too) are one item with the terms of all rows, each once;
null or empty texts have no terms; an item without terms, or whose terms occur nowhere, returns no rows;
every document row is a document of its own, also under a repeated id; null document ids come last among
equal scores; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vellum.llm.chunks import KeyTable, hash_runs, join_texts, runs
from vellum.llm.common import TEXT, as_bytes, blocks, map_texts
from vellum.session import require_columns, scratch_path

K = 10
SHARD_DOCS = 4096  # documents of a shard
SHARD_BYTES = 32 << 20  # text bytes of a shard (a longer document stands alone)
BUNDLE = 256  # items travelling together, about
BANDS = (1 / 256, 1 / 32, 1 / 8, 1 / 2)  # upper share of the documents of each owner stage but the last
BLOOM_BITS = 23
SCALE = 1_000_000  # a contribution is below SCALE times its term's weight

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.isin(np.arange(256), [*range(48, 58), *range(97, 123), *range(128, 256)])


def _terms(texts: list[bytes]):
    """Lowered bytes, starts and ends of all terms, two hashes of each, each text's first term."""
    data, bounds = join_texts(texts)
    low = _LOWER[data]
    starts, ends = runs(_TERM[low])
    key, check = hash_runs(low, starts, ends)
    return low, starts, ends, key, check, np.searchsorted(starts, bounds)


def _slots(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - BLOOM_BITS)
    return (key >> shift).astype(np.int64), (check >> shift).astype(np.int64)


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct ``(item_id, term)``."""
    def make():
        def found(texts: list[bytes]):
            low, starts, ends, _, _, first = _terms(texts)
            out = []
            for a, b in zip(first[:-1], first[1:]):
                out.append(sorted({low[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b])}))
            return [out]
        return found
    listed = map_texts(items, make, [T.StructField("terms", T.ArrayType(T.StringType()))], [item_id], text)
    return listed.select(F.col(f"`{item_id}`").alias("item_id"), F.explode("terms").alias("term")).distinct()


def _bloom(terms: DataFrame) -> np.ndarray:
    """A Bloom filter of the terms, ``2 ** BLOOM_BITS`` bits; the bitmap pieces are built on executors."""
    def make():
        def found(texts: list[bytes]):
            _, _, _, key, check, _ = _terms(texts)
            return [np.stack(_slots(key, check), axis=1).tolist()]
        return found
    at = map_texts(terms, make, [T.StructField("at", T.ArrayType(T.LongType()))], [], "term")
    at = at.select(F.explode("at").alias("at")).select((F.col("at") + 1).alias("at"))  # bitmaps count from 1
    parts = (at.groupBy(F.bitmap_bucket_number("at").alias("b"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect())  # at most 1 MB
    bits = np.zeros((1 << BLOOM_BITS) + 32768, bool)
    for row in parts:
        word = np.unpackbits(np.frombuffer(bytes(row["bits"]), np.uint8), bitorder="little")
        at = (row["b"] - 1) * 32768
        bits[at: at + 32768][: len(word)] = word
    return np.packbits(bits, bitorder="little")


POSTINGS = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("term", T.StringType()),
    T.StructField("docs", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType())),
    T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())),
    T.StructField("n_docs", T.LongType()), T.StructField("n_terms", T.LongType())])


class _Shard:
    """Documents of one shard while they are read."""

    def __init__(self) -> None:
        self.ids: list = []
        self.lengths: list[int] = []
        self.bytes = 0
        self.table = KeyTable(12)
        self.words: list[str] = []
        self.term, self.doc, self.tf = [], [], []

    def add(self, ids: list, texts: list[bytes], bloom: np.ndarray) -> None:
        low, starts, ends, key, check, first = _terms(texts)
        doc = np.repeat(np.arange(len(texts)) + len(self.ids), np.diff(first))
        a, b = _slots(key, check)
        hit = np.flatnonzero((bloom[a >> 3] >> (a & 7) & bloom[b >> 3] >> (b & 7) & 1) != 0)

        def new(places: np.ndarray) -> None:
            at = hit[places]
            self.words += [low[s:e].tobytes().decode() for s, e in zip(starts[at], ends[at])]

        number = self.table.number_all(key[hit], check[hit], new)
        pair, count = np.unique(number << 32 | doc[hit], return_counts=True)
        self.term.append((pair >> 32).astype(np.int32))
        self.doc.append((pair & 0xFFFFFFFF).astype(np.int32))
        self.tf.append(count.astype(np.int32))
        self.ids += ids
        self.lengths += np.diff(first).tolist()
        self.bytes += sum(map(len, texts))

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(POSTINGS)
        n = np.array(self.lengths, np.int64)
        yield pa.RecordBatch.from_pylist([{
            "shard": shard, "ids": self.ids, "lengths": self.lengths, "n_docs": int((n > 0).sum()),
            "n_terms": int(n.sum())}], schema=schema)
        term, doc, tf = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (self.term, self.doc, self.tf))
        if not len(term):
            return
        order = np.argsort(term, kind="stable")  # documents stay in ascending order within a term
        lists = np.searchsorted(term[order], np.arange(len(self.words) + 1)).astype(np.int32)
        off = pa.array(lists, pa.int32())
        rows = len(self.words)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.full(rows, shard)), pa.array(self.words),
            pa.ListArray.from_arrays(off, pa.array(doc[order])), pa.ListArray.from_arrays(off, pa.array(tf[order])),
            *[pa.nulls(rows, schema.field(i).type) for i in range(4, 8)]], schema=schema)


def shard_postings(docs: DataFrame, bloom, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``POSTINGS`` of all documents: per shard one row with its documents (``term`` null) and one row
    per term that the filter passes. Shards are named by their scan task and number."""
    src = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias(TEXT))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bloom.value
        name = TaskContext.get().partitionId() << 32
        shard = _Shard()
        for batch in batches:
            for part in blocks(batch, TEXT):
                for at in range(0, part.num_rows, SHARD_DOCS):
                    piece = part.slice(at, SHARD_DOCS)
                    if shard.ids and (len(shard.ids) + piece.num_rows > SHARD_DOCS or shard.bytes > SHARD_BYTES):
                        yield from shard.rows(name)
                        name, shard = name + 1, _Shard()
                    shard.add(piece.column("id").to_pylist(), as_bytes(piece.column(TEXT)), bits)
        if shard.ids:
            yield from shard.rows(name)

    return src.mapInArrow(run, POSTINGS)


CARRIED = T.StructType([
    T.StructField("bundle", T.LongType()), T.StructField("shard", T.LongType()),
    T.StructField("item_id", T.LongType()), T.StructField("is_item", T.BooleanType()),
    # the item's terms of the stages still to come
    T.StructField("bands", T.ArrayType(T.IntegerType())), T.StructField("tids", T.ArrayType(T.LongType())),
    T.StructField("weights", T.ArrayType(T.LongType())),
    # the accumulator: places in the shard and scores; closed: no new documents
    T.StructField("docs", T.ArrayType(T.IntegerType())), T.StructField("scores", T.ArrayType(T.LongType())),
    T.StructField("closed", T.BooleanType()),
    # of the one row with the shard's documents
    T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType()))])
FOUND = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("doc_id", T.LongType()),
                      T.StructField("score", T.LongType())])


def _ragged(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A list column as flat values and offsets."""
    col = table.column(name).combine_chunks()
    col = col if isinstance(col, pa.Array) else pa.concat_arrays(col.chunks)
    size = np.asarray(col.value_lengths().fill_null(0), np.int64)
    return np.asarray(col.flatten()), np.concatenate([[0], np.cumsum(size)])


def _lists(flat: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, kind))


def owner_stage(stage: int, last: bool, k: int, total_docs: int, total_terms: int):
    """The cogroup function of one owner stage: bundle rows and the stage's postings of one shard ->
    the bundle rows with the contributions added, or after the last stage the shard's ``k`` best."""
    schema, found = to_arrow_schema(CARRIED), to_arrow_schema(FOUND)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return (found if last else schema).empty_table()
        is_item = np.asarray(left.column("is_item"))
        head = left.filter(pa.array(~is_item))
        items = left.filter(pa.array(is_item))
        lengths, _ = _ragged(head, "lengths")
        m = 10 + (90 * lengths.astype(np.int64) * total_docs) // max(1, total_terms)
        n_items, n_docs = items.num_rows, len(lengths)
        acc = np.zeros((n_items, n_docs), np.int64)
        docs, off = _ragged(items, "docs")
        scores, _ = _ragged(items, "scores")
        acc[np.repeat(np.arange(n_items), np.diff(off)), docs] = scores
        closed = np.asarray(items.column("closed"))
        known = acc[closed] > 0
        bands, off = _ragged(items, "bands")
        owner = np.repeat(np.arange(n_items), np.diff(off))
        tids, _ = _ragged(items, "tids")
        weights, _ = _ragged(items, "weights")
        now = bands == stage
        # the pairs (term, item) of this stage, term by term, beside the postings
        order = np.argsort(tids[now], kind="stable")
        term, item, weight = tids[now][order], owner[now][order], weights[now][order]
        posted = np.asarray(right.column("tid").combine_chunks(), np.int64)
        pdocs, poff = _ragged(right, "docs")
        ptfs, _ = _ragged(right, "tfs")
        a, b = np.searchsorted(term, posted), np.searchsorted(term, posted, side="right")
        for p in np.flatnonzero(b > a):
            d, tf = pdocs[poff[p]: poff[p + 1]], ptfs[poff[p]: poff[p + 1]].astype(np.int64)
            gain = weight[a[p]] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[d]))
            acc[item[a[p]: b[p], None], d[None, :]] += gain
        acc[closed] *= known
        if last:
            return _best(items.column("item_id").to_pylist(), head, acc, k)
        later = bands > stage
        still = np.bincount(owner[later], weights[later], n_items).astype(np.int64) * SCALE
        kth = np.partition(acc, n_docs - k, axis=1)[:, n_docs - k] if n_docs >= k else np.zeros(n_items, np.int64)
        keep = (acc > 0) & (acc + still[:, None] >= kth[:, None])
        who, where = np.nonzero(keep)
        more = np.bincount(owner[later], minlength=n_items)
        made = pa.Table.from_arrays([
            items.column("bundle"), items.column("shard"), items.column("item_id"), items.column("is_item"),
            _lists(bands[later], more, pa.int32()), _lists(tids[later], more, pa.int64()),
            _lists(weights[later], more, pa.int64()),
            _lists(where.astype(np.int32), np.bincount(who, minlength=n_items), pa.int32()),
            _lists(acc[who, where], np.bincount(who, minlength=n_items), pa.int64()),
            pa.array(closed | (still < kth)),
            pa.nulls(n_items, schema.field("ids").type), pa.nulls(n_items, schema.field("lengths").type)],
            schema=schema)
        return pa.concat_tables([head.select(schema.names).cast(schema), made])

    return run


def _best(item_ids: list, head: pa.Table, acc: np.ndarray, k: int) -> pa.Table:
    ids = head.column("ids").combine_chunks().flatten()
    rank = np.asarray(ids.fill_null(0), np.int64)
    null = np.asarray(ids.is_null())
    n = acc.shape[1]
    kth = np.partition(acc, n - k, axis=1)[:, n - k] if n > k else np.zeros(len(acc), np.int64)
    who, where = np.nonzero((acc > 0) & (acc >= kth[:, None]))  # ties at the k-th score are all here
    score = acc[who, where]
    order = np.lexsort((where, rank[where], null[where], -score, who))
    who, where, score = who[order], where[order], score[order]
    place = np.arange(len(who)) - np.searchsorted(who, who)
    who, where, score = (x[place < k] for x in (who, where, score))
    return pa.Table.from_arrays([pa.array([item_ids[i] for i in who], pa.int64()), ids.take(pa.array(where)),
                                 pa.array(score)], schema=to_arrow_schema(FOUND))


def _stored(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return spark.read.parquet(path)


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", item_id: str = "item_id",
           text: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` highest-scoring documents of each item."""
    require_columns(docs, doc_id, text, what="documents")
    require_columns(items, item_id, text, what="items")
    spark = docs.sparkSession
    work = scratch_path(spark, "lexical")
    listed = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{text}`").alias("text"))
    asked = _stored(spark, item_terms(listed), f"{work}/items")
    bloom = spark.sparkContext.broadcast(_bloom(asked.select("term").distinct()))
    posted = _stored(spark, shard_postings(docs, bloom, doc_id, text), f"{work}/postings")
    shards = posted.filter("term IS NULL")
    total = shards.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n, length = int(total["n"] or 0), int(total["l"] or 0)
    # every item's terms with their weight and owner stage; terms that occur nowhere go
    df = posted.filter("term IS NOT NULL").groupBy("term").agg(F.sum(F.size("docs").cast("long")).alias("df"))
    terms = df.join(asked.select("term").distinct(), "term", "left_semi")
    band = F.lit(0)
    for share in BANDS:
        band = band + (F.col("df") > share * n).cast("int")
    weight = F.floor(1000 * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1)))
    terms = _stored(spark, terms.select("term", F.monotonically_increasing_id().alias("tid"), band.alias("band"),
                                        weight.cast("long").alias("weight")), f"{work}/terms")
    n_items = asked.select("item_id").distinct().count()
    bundles = max(1, math.ceil(n_items / BUNDLE))
    of = F.pmod(F.xxhash64("item_id"), F.lit(bundles)).cast("long").alias("bundle")
    wanted = asked.join(terms, "term").select(of, "item_id", "term", "tid", "band", "weight")
    wanted = _stored(spark, wanted, f"{work}/wanted")
    none = {f.name: F.lit(None).cast(f.dataType) for f in CARRIED}
    each = (shards.select("shard", "ids", "lengths", F.explode(F.sequence(F.lit(0), F.lit(bundles - 1))).alias("bundle"))
            .withColumn("bundle", F.col("bundle").cast("long")))
    heads = each.select(*[F.col(c) if c in ("bundle", "shard", "ids", "lengths") else
                          (F.lit(False) if c == "is_item" else none[c]).alias(c) for c in CARRIED.names])
    sets = (wanted.groupBy("bundle", "item_id").agg(F.collect_list(F.struct("band", "tid", "weight")).alias("t"))
            .select("bundle", "item_id", F.col("t.band").alias("bands"), F.col("t.tid").alias("tids"),
                    F.col("t.weight").alias("weights")))
    empty = {"docs": F.array().cast("array<int>"), "scores": F.array().cast("array<bigint>"),
             "closed": F.lit(False), "is_item": F.lit(True), "ids": none["ids"], "lengths": none["lengths"]}
    carried = heads.unionByName(each.select("bundle", "shard").join(sets, "bundle").select(
        *[empty[c].alias(c) if c in empty else F.col(c) for c in CARRIED.names]))
    routes = wanted.select("bundle", "term", "tid", "band").distinct()
    for stage in range(len(BANDS) + 1):
        lists = spark.read.parquet(f"{work}/postings").filter("term IS NOT NULL")
        own = (lists.join(routes.filter(F.col("band") == stage), "term")
               .select(*[F.col(c).alias(c) for c in ("bundle", "shard", "tid", "docs", "tfs")]))
        last = stage == len(BANDS)
        carried = (carried.groupBy("bundle", "shard").cogroup(own.groupBy("bundle", "shard"))
                   .applyInArrow(owner_stage(stage, last, k, n, length), FOUND if last else CARRIED))
    place = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = carried.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    return best.select("item_id", "rank", "doc_id", "score")
