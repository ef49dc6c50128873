"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Vectors are quantised to integers, ordered along a Hilbert curve (through the ``CURVE_DIMS`` dimensions
of the largest spread) and written as Parquet blocks of ``BLOCK_ROWS`` rows; each block has a zone map,
the least and greatest value per dimension. For an anchor ``a`` and a block with bounds ``lo, hi``
interval arithmetic bounds every inner product: between ``a+ lo + a- hi`` and ``a+ hi + a- lo``. An
anchor reads a block only if those bounds can change its answer:

1. positives: the own block gives a first ``p``-th best score of the same label; blocks that can reach
   it are read, and the ``p`` best rows are taken;
2. negatives: a positive's score makes a window of scores; the own block gives a first ``k``-th best in
   each window, and blocks are read whose bounds meet the window at or above it.

Anchors come in packs of about ``PACK``; a task holds one pack and one block (or the zones of
``ZONE_PACK`` blocks), never all anchors or all rows of a label or of a copied vector. Scores are exact
integers, so the bounds lose nothing; where nothing can be excluded, an anchor reads every block.

Defined cases: rows with a null label, vector or component, a non-finite component, or a component of
2**20 or more in size take no part, nor do rows without ``vec_id``; of rows with one ``vec_id`` the
smallest by (label, quantised vector) takes part; shorter vectors count as padded with zeros; copies
under other ids are rows of their own; an anchor without other rows of its label returns nothing, a
window without rows returns none; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vellum.session import require_columns, scratch_path

POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # window of negative scores, per cent of the positive's score
BLOCK_ROWS = 2048
CURVE_DIMS, CURVE_BITS = 8, 8  # 64 bits of the curve
PACK = 8192  # anchors of a pack, about
ZONE_PACK = 1024  # zone maps looked at together
SLICE = 1 << 22  # scores held at a time
LEAST = np.iinfo(np.int64).min


def quantised(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, label, q)``: one row per id, ``q`` = floor(256 x) as integers."""
    x = F.col(f"`{vector}`").cast("array<double>")
    fit = F.forall(x, lambda v: F.coalesce((F.abs(v) < float(1 << 20)) & ~F.isnan(v), F.lit(False)))
    src = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"),
                      x.alias("x"), fit.alias("fit"))
    src = src.filter("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND fit")
    q = F.transform("x", lambda v: F.floor(v * 256).cast("int"))
    src = src.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10)
                     .otherwise(F.col("label")).alias("label"), q.alias("q"))
    return src.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q")


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of ``cells`` (n x dims, values below ``2 ** bits``)."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):  # undo the turns of the coarser levels
        low = (1 << level) - 1
        for i in range(dims):
            high = (x[i] >> level) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[dims - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << np.uint64(1) | ((x[i] >> level) & 1).astype(np.uint64)
    return key


def _matrix(column, dims: int) -> np.ndarray:
    """A list column as an integer matrix, short rows padded with zeros."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(arr.value_lengths(), np.int64)
    flat = np.asarray(arr.flatten(), np.int64)
    if (size == dims).all():
        return flat.reshape(len(size), dims)
    out = np.zeros((len(size), dims), np.int64)
    out[np.arange(dims) < size[:, None]] = flat
    return out


def _packed(m: np.ndarray) -> bytes:
    """A matrix as bytes in the narrowest integer type; the first byte names it."""
    for kind, least in ((b"h", 1 << 15), (b"i", 1 << 31)):
        if not m.size or (m.max() < least and m.min() >= -least):
            return kind + m.astype(kind.decode()).tobytes()
    raise OverflowError("components beyond 32 bits")


def _unpacked(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, raw[:1].decode(), offset=1).astype(np.int64).reshape(-1, dims)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows: by floats where 53 bits hold every sum, else by integers."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


BLOCKS = T.StructType([T.StructField(n, t) for n, t in (
    ("block", T.LongType()), ("part", T.LongType()), ("ids", T.ArrayType(T.LongType())),
    ("labels", T.ArrayType(T.LongType())), ("data", T.BinaryType()), ("low", T.BinaryType()), ("high", T.BinaryType()),
    ("label_set", T.ArrayType(T.LongType())), ("n_anchors", T.LongType()))])


def write_blocks(rows: DataFrame, dims: int, every: int, path: str) -> DataFrame:
    """The rows in Hilbert order as blocks with their zone maps, written to ``path``. ``part`` is the
    number of the range partition."""
    spark = rows.sparkSession
    at = F.posexplode("q").alias("i", "x")
    spread = (rows.select(at).groupBy("i").agg(F.var_pop("x").alias("v"), F.min("x").alias("lo"), F.max("x").alias("hi"))
              .collect())  # one row per dimension
    best = sorted(spread, key=lambda r: (-(r["v"] or 0), r["i"]))[:CURVE_DIMS]
    use = [(r["i"], r["lo"], r["hi"]) for r in best]
    schema = T.StructType([*rows.schema.fields, T.StructField("key", T.LongType())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("q"), dims)
            cells = np.stack([(m[:, i] - lo) * ((1 << CURVE_BITS) - 1) // max(1, hi - lo) for i, lo, hi in use], axis=1)
            key = (hilbert_keys(cells, CURVE_BITS) ^ np.uint64(1 << 63)).view(np.int64)  # signed, same order
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], schema=to_arrow_schema(schema))

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def made(table: pa.Table) -> pa.RecordBatch:
            m = _matrix(table.column("q"), dims)
            ids, labels = table.column("vec_id").to_pylist(), table.column("label").to_pylist()
            return pa.RecordBatch.from_pylist([{
                "block": part << 32 | number, "part": part, "ids": ids, "labels": labels, "data": _packed(m),
                "low": _packed(m.min(0)), "high": _packed(m.max(0)), "label_set": sorted(set(labels)),
                "n_anchors": sum(i % every == 0 for i in ids)}], schema=to_arrow_schema(BLOCKS))

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= BLOCK_ROWS:
                table = pa.Table.from_batches(held)
                yield made(table.slice(0, BLOCK_ROWS))
                number, held = number + 1, table.slice(BLOCK_ROWS).to_batches()
        if sum(b.num_rows for b in held):
            yield made(pa.Table.from_batches(held))

    # equal keys (copies) are dealt on by id
    ordered = rows.mapInArrow(keyed, schema).repartitionByRange("key", "vec_id").sortWithinPartitions("key", "vec_id")
    ordered.select("vec_id", "label", "q").mapInArrow(blocked, BLOCKS).write.parquet(path)
    return spark.read.parquet(path)


#: An anchor on its way: windows are empty in the search for positives.
ASK = T.StructType([T.StructField(n, t) for n, t in (
    ("pack", T.LongType()), ("anchor_id", T.LongType()), ("label", T.LongType()), ("q", T.BinaryType()),
    ("floors", T.ArrayType(T.LongType())), ("tops", T.ArrayType(T.LongType())),
    ("positive_ids", T.ArrayType(T.LongType())), ("positive_scores", T.ArrayType(T.LongType())))])
READ = T.StructType([T.StructField("block", T.LongType()), *ASK.fields])
HIT = T.StructType([T.StructField(n, t) for n, t in (
    ("anchor_id", T.LongType()), ("slot", T.IntegerType()), ("vec_id", T.LongType()), ("score", T.LongType()))])


def window(score: int) -> tuple[int, int]:
    """Least and greatest negative score with ``LOW score <= 100 negative <= HIGH score``."""
    return -((-LOW * score) // 100), (HIGH * score) // 100


def _kth(scores: np.ndarray, k: int) -> int:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else LEAST


def _anchors(block: dict, dims: int, every: int, parts: int, packs: int) -> Iterator[tuple]:
    """Each anchor of a block with its scores and the masks of same and other labels."""
    ids, labels = np.array(block["ids"]), np.array(block["labels"])
    m = _unpacked(block["data"], dims)
    at = np.flatnonzero(ids % every == 0)
    scores = products(m[at], m)
    for r, i in enumerate(at):
        same = labels == labels[i]
        other = same & (ids != ids[i])
        pack = block["part"] * packs // parts
        yield pack, int(ids[i]), int(labels[i]), _packed(m[i]), scores[r], other, ~same


def _own_blocks(dims: int, every: int, parts: int, packs: int, positives: int):
    """Anchors with the ``positives``-th best score of their label in their own block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                out = [{"pack": pack, "anchor_id": a, "label": y, "q": q, "floors": [_kth(s[same], positives)],
                        "tops": [], "positive_ids": [], "positive_scores": []}
                       for pack, a, y, q, s, same, _ in _anchors(block, dims, every, parts, packs)]
                yield pa.RecordBatch.from_pylist(out, schema=to_arrow_schema(ASK))
    return run


def _own_windows(dims: int, every: int, parts: int, packs: int, negatives: int):
    """Anchors with their windows; a floor is the ``negatives``-th best score that the own block has in
    the window, else the window's least score."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = {r["anchor_id"]: r for r in right.to_pylist()}
        out = []
        for block in left.to_pylist():
            for pack, a, y, q, s, _, other in _anchors(block, dims, every, parts, packs):
                if a not in found:
                    continue
                got = found[a]["found"]
                lo, hi = zip(*(window(p["score"]) for p in got))
                floors = [max(lo[j], _kth(s[other & (s <= hi[j])], negatives)) for j in range(len(got))]
                out.append({"pack": pack, "anchor_id": a, "label": y, "q": q, "floors": floors, "tops": list(hi),
                            "positive_ids": [p["vec_id"] for p in got], "positive_scores": [p["score"] for p in got]})
        return pa.Table.from_pylist(out, schema=to_arrow_schema(ASK))
    return run


def _bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval bounds of the inner products of anchors ``q`` with the rows of each zone."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def _choose(dims: int):
    """The blocks that each anchor of a pack must read, from the zone maps of one zone pack."""
    def run(asks: pa.Table, zones: pa.Table) -> pa.Table:
        schema = to_arrow_schema(READ)
        if not asks.num_rows or not zones.num_rows:
            return schema.empty_table()
        low = np.concatenate([_unpacked(z, dims) for z in zones.column("low").to_pylist()])
        high = np.concatenate([_unpacked(z, dims) for z in zones.column("high").to_pylist()])
        sets = zones.column("label_set").to_pylist()
        blocks = np.array(zones.column("block").to_pylist())
        labels = np.array(asks.column("label").to_pylist())
        values, back = np.unique(labels, return_inverse=True)
        holds = np.array([[v in s for s in sets] for v in values.tolist()])
        beside = np.array([[any(x != v for x in s) for s in sets] for v in values.tolist()])
        q = np.concatenate([_unpacked(x, dims) for x in asks.column("q").to_pylist()])
        floors, tops = asks.column("floors").to_pylist(), asks.column("tops").to_pylist()
        who, where = [], []
        step = max(1, SLICE // len(blocks))
        for s in range(0, len(q), step):
            least, most = _bounds(q[s: s + step], low, high)
            for r in range(len(least)):
                i = s + r
                if tops[i]:
                    need = np.zeros(len(blocks), bool)
                    for f, t in zip(floors[i], tops[i]):
                        if f <= t:
                            need |= (most[r] >= f) & (least[r] <= t)
                    need &= beside[back[i]]
                else:
                    need = (most[r] >= floors[i][0]) & holds[back[i]]
                at = np.flatnonzero(need)
                who.append(np.full(len(at), i))
                where.append(at)
        who, where = np.concatenate(who), np.concatenate(where)
        picked = asks.select(ASK.names).take(pa.array(who))
        return pa.Table.from_arrays([pa.array(blocks[where]), *picked.columns], names=schema.names).cast(schema)
    return run


def _read(dims: int, positives: int, negatives: int):
    """The best rows of one block for the anchors of one pack that read it."""
    def run(asks: pa.Table, blocks: pa.Table) -> pa.Table:
        schema = to_arrow_schema(HIT)
        if not asks.num_rows or not blocks.num_rows:
            return schema.empty_table()
        block = blocks.to_pylist()[0]
        ids, labels = np.array(block["ids"]), np.array(block["labels"])
        m = _unpacked(block["data"], dims)
        q = np.concatenate([_unpacked(x, dims) for x in asks.column("q").to_pylist()])
        anchor, label = asks.column("anchor_id").to_pylist(), asks.column("label").to_pylist()
        floors, tops = asks.column("floors").to_pylist(), asks.column("tops").to_pylist()
        by_id = np.argsort(ids, kind="stable")
        ids, labels, m = ids[by_id], labels[by_id], m[by_id]
        out: list[tuple[np.ndarray, ...]] = []
        step = max(1, SLICE // len(ids))
        for s in range(0, len(q), step):
            scores = products(q[s: s + step], m)
            for r, row in enumerate(scores):
                i = s + r
                same = labels == label[i]
                # floors are reached by k known rows, so smaller scores cannot enter the answer
                slots = ([(j, ~same & (row >= f) & (row <= t), negatives) for j, (f, t) in enumerate(zip(floors[i], tops[i]))]
                         if tops[i] else [(0, same & (ids != anchor[i]) & (row >= floors[i][0]), positives)])
                for j, ok, k in slots:
                    at = np.flatnonzero(ok)
                    if len(at) > k:
                        at = at[np.argsort(-row[at], kind="stable")[:k]]
                    if len(at):
                        out.append((np.full(len(at), anchor[i]), np.full(len(at), j), ids[at], row[at]))
        if not out:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=schema.names).cast(schema)
    return run


def _each(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def mine(rows: DataFrame, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES,
         vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the anchors, the
    rows whose id ``every`` divides."""
    require_columns(rows, vec_id, vector, label, what="vectors")
    spark = rows.sparkSession
    work = scratch_path(spark, "hard-negatives")
    quantised(rows, vec_id, vector, label).write.parquet(f"{work}/rows")
    flat = spark.read.parquet(f"{work}/rows")
    dims = max(1, int(flat.agg(F.max(F.size("q"))).first()[0] or 1))
    write_blocks(flat, dims, every, f"{work}/blocks")

    def blocks() -> DataFrame:  # read anew, so that no two sides of a join share columns
        return spark.read.parquet(f"{work}/blocks")

    size = blocks().agg(F.count(F.lit(1)).alias("n"), F.max("part").alias("parts"), F.sum("n_anchors").alias("a")).first()
    parts = int(size["parts"] or 0) + 1
    packs = min(parts, max(1, math.ceil(int(size["a"] or 0) / PACK)))
    zone_packs = max(1, math.ceil(int(size["n"]) / ZONE_PACK))

    def hits(asks: DataFrame, name: str, best: int) -> DataFrame:
        zones = blocks().select("block", "low", "high", "label_set",
                                F.pmod(F.xxhash64("block"), F.lit(zone_packs)).alias("zones"),
                                _each(packs).alias("pack"))
        asked = asks.withColumn("zones", _each(zone_packs))
        (asked.groupBy("zones", "pack").cogroup(zones.groupBy("zones", "pack"))
         .applyInArrow(_choose(dims), READ).write.parquet(f"{work}/{name}"))
        reads = spark.read.parquet(f"{work}/{name}")
        pairs = reads.select("block", "pack").distinct()
        needed = blocks().select("block", "ids", "labels", "data").join(pairs, "block")
        found = (spark.read.parquet(f"{work}/{name}").groupBy("block", "pack").cogroup(needed.groupBy("block", "pack"))
                 .applyInArrow(_read(dims, positives, negatives), HIT))
        place = Window.partitionBy("anchor_id", "slot").orderBy(F.col("score").desc(), F.col("vec_id"))
        return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= best)

    own = blocks().mapInArrow(_own_blocks(dims, every, parts, packs, positives), ASK)
    chosen = (hits(own, "reads-positives", positives).groupBy("anchor_id")
              .agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found")))
    chosen.write.parquet(f"{work}/positives")
    with_block = (blocks().filter("n_anchors > 0").select("block", F.explode("ids").alias("anchor_id"))
                  .filter(F.col("anchor_id") % every == 0))
    chosen = spark.read.parquet(f"{work}/positives").join(with_block, "anchor_id")
    (blocks().filter("n_anchors > 0").groupBy("block").cogroup(chosen.groupBy("block"))
     .applyInArrow(_own_windows(dims, every, parts, packs, negatives), ASK).write.parquet(f"{work}/windows"))
    asks = spark.read.parquet(f"{work}/windows")
    best = hits(asks, "reads-negatives", negatives)
    pairs = spark.read.parquet(f"{work}/windows").select(
        "anchor_id", F.posexplode(F.arrays_zip("positive_ids", "positive_scores")).alias("slot", "p"))
    return (best.join(pairs, ["anchor_id", "slot"])
            .select("anchor_id", F.col("p.positive_ids").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
                    F.col("p.positive_scores").alias("positive_score"), F.col("score").alias("negative_score")))
