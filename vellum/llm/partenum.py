"""Exact set-similarity join by PartEnum signatures, and its connected components.

A document's set holds the distinct ``SHINGLE``-word runs of its text (A-Z lowered, words split at
ASCII blanks; fewer words: the whole sequence). Sets are compared as 64-bit shingle hashes. Equal
sets are one node; two nodes link when ``100 * |A & B| >= 75 * |A | B|``.

1. *Support filter.* A linked set shares three quarters of its shingles with another set. Over the
   fraction ``DOMAIN`` of the shingle domain, each shingle is counted by distinct sets; a set whose
   unshared shingles there exceed a quarter of the whole set cannot link and leaves. Exact.
2. *Signatures.* Sizes are cut into bands of ratio 4/3, so linked sets lie in one band or in two
   neighbouring ones; a set joins the instance of its own band and of the band below. Linked sets of
   instance ``i`` differ in at most ``k = top(i) / 3`` shingles. The shingle domain is partitioned
   into ``n = k + 1 + slack`` parts, and all subsets of one part are enumerated: linked sets agree
   on at least ``n - k`` parts, so they share signatures (the hash of a part's shingles). Parts that
   are empty are only enumerated for sets with at least ``n - k`` empty parts, since otherwise linked
   sets also agree on another part.
3. *Buckets.* Signatures go to hash parts as packed byte blocks (sorted 8-byte signatures), not as
   rows. Small buckets propose all their pairs (at most ``SMALL`` squared, no cap: larger ones have
   their own way), larger buckets first the pairs with one leader. Pairs are pruned by a parity
   sketch (one bit per hashed shingle class; its differing bits never exceed the sets' difference)
   and verified on the whole sets.
4. *Large buckets* whose sets the first links left in several components propose, block against
   block, pairs of different components that the sketch cannot exclude: in the first ``FORESTS``
   rounds only such as would join the components of a group, in the last round all that are left
   (most copies are one component by then). Together with 3 the last round covers every pair that shares a bucket, so no link between components is lost. A set that meets
   fewer than ``n - k`` large or empty parts needs no large bucket (it agrees on a small one too).
5. *Components* by repeated minimum labels over the links, cut with tables in the shared folder.

Defined cases: null, empty and blank texts have the empty set, link with nothing and are their own
component; repeated rows and equal texts are one node; rows of one id stand for themselves but carry
that id; texts that stand only on rows with a null id link like others (also as a bridge), and a
component without any id has a null ``component_id``; an empty table gives no rows; other columns pass
through in ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vellum.llm.chunks import hash_runs, join_texts, runs
from vellum.llm.common import TEXT, as_bytes, blocks, map_texts, mix64, spans_to_positions
from vellum.session import scratch_path

SHINGLE = 5
NUM, DEN = 75, 100  # linked: DEN * intersection >= NUM * union
DOMAIN = 0.33  # share of the shingle domain counted by the support filter
SMALL = 8  # members of a bucket whose pairs are all proposed at once
FORESTS = 1  # rounds in which large buckets propose only joining pairs
BLOCK = 1024  # members of a large bucket compared at a time
PART_BYTES = 24 << 20  # bytes of one hash part of the packed exchanges

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
U = np.uint64


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, joined, and the first of each (one more)."""
    data, bounds = join_texts(texts)
    low = _LOWER[data]
    starts, ends = runs(_WORD[low])
    (word,) = hash_runs(low, starts, ends, lanes=1)
    first = np.searchsorted(starts, bounds)
    n_words = np.diff(first)
    count = np.where(n_words >= size, n_words - size + 1, (n_words > 0).astype(np.int64))
    total = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(texts)), count)
    at = first[doc] + np.arange(int(total[-1])) - total[doc]
    left = np.minimum(n_words[doc], size)
    value = np.zeros(len(at), np.uint64)
    padded = np.concatenate([word, np.zeros(size, np.uint64)])
    with np.errstate(over="ignore"):
        for j in range(size):
            value = mix64(value * U(0x9E3779B97F4A7C15) + np.where(j < left, padded[at + j], U(j + 1)))
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(texts) + 1))


def _sums(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each list (zero when empty)."""
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    return upto[first[1:]] - upto[first[:-1]]


def node_ids(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 63-bit id of each set (equal sets, equal ids); 0 for the empty set."""
    size = np.diff(first).astype(np.uint64)
    node = mix64(_sums(mix64(value ^ U(0x5851F42D4C957F2D)), first) ^ mix64(_sums(mix64(value), first) + size))
    return np.where(size > 0, node >> U(1) | U(1), U(0)).astype(np.int64)


def band_tops() -> np.ndarray:
    """Largest set size of each band: a band ends at 4/3 of its start, the next one starts above it."""
    tops, low = [], 1
    while low < 1 << 40:
        top = max(low, low * DEN // NUM)
        tops.append(top)
        low = top + 1
    return np.array(tops, np.int64)


TOPS = band_tops()


def instance(i: int) -> tuple[int, int]:
    """(k, n) of a band's instance: linked sets of bands i and i + 1 with one in band i differ in at
    most k shingles, and the domain has n parts."""
    top = int(TOPS[i])
    # |A ^ B| <= (|A| + |B|) / 7 for a similarity of 3/4, with |B| <= 4/3 |A|
    k = (top + top * DEN // NUM) * (DEN - NUM) // (DEN + NUM)
    return k, k + 1 + (k + 1) // 4 + 6


def _filled(v: np.ndarray, own: np.ndarray, sets: int, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Non-empty parts of the sets in instance ``i``: owner, part, and the sum of the part's shingles."""
    _, n = instance(i)
    h = mix64(v ^ mix64(np.array([i + 1], np.uint64))[0])
    cell = own * n + ((h >> U(32)) * U(n) >> U(32)).astype(np.int64)
    order = np.argsort(cell, kind="stable")
    cell, h = cell[order], h[order]
    at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    return cell[at] // n, cell[at] % n, np.add.reduceat(mix64(h), at)


def _by_instance(first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(instance, its sets, their shingles' places, and each place's set among them)."""
    size = np.diff(first)
    band = np.searchsorted(TOPS, size)
    for b in np.unique(band[size > 0]).tolist():
        mine = np.flatnonzero((band == b) & (size > 0))
        place = spans_to_positions(first[mine], size[mine])
        own = np.repeat(np.arange(len(mine)), size[mine])
        for i in (b, b - 1):
            if i >= 0:
                yield i, mine, place, own


def signatures(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, owner) rows of all sets in both of their instances."""
    sigs, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, mine, place, own in _by_instance(first):
        k, n = instance(i)
        who, part, total = _filled(value[place], own, len(mine), i)
        sigs.append(mix64(total ^ mix64((part.astype(np.uint64) << U(8)) + U(i))))
        owners.append(mine[who])
        bare = np.flatnonzero(np.bincount(who, minlength=len(mine)) <= k)  # at least n - k empty parts
        if len(bare):
            empty = np.ones((len(mine), n), bool)
            empty[who, part] = False
            r, p = np.nonzero(empty[bare])
            sigs.append(mix64(mix64((p.astype(np.uint64) << U(8)) + U(i)) + U(0xE)))
            owners.append(mine[bare[r]])
    return np.concatenate(sigs), np.concatenate(owners)


def least_large(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each set, how many large buckets it must be in before they matter: its agreeing parts
    less its empty ones, the smaller of its two instances (0 where empty parts are enumerated)."""
    out = np.full(len(first) - 1, np.iinfo(np.int32).max, np.int64)
    for i, mine, place, own in _by_instance(first):
        k, _ = instance(i)
        who, _, _ = _filled(value[place], own, len(mine), i)
        out[mine] = np.minimum(out[mine], np.maximum(np.bincount(who, minlength=len(mine)) - k, 0))
    return out


def sketch_words(size: np.ndarray) -> np.ndarray:
    """64-bit words of a set's parity sketch: a power of two of at least four bits per shingle."""
    bits = np.maximum(4 * size, 64).astype(np.int64)
    return (1 << np.ceil(np.log2(bits / 64)).astype(np.int64)).astype(np.int64)


def parity_sketch(value: np.ndarray, words: int) -> bytes:
    bit = (mix64(value + U(0x1234567)) & U(64 * words - 1)).astype(np.int64)
    odd = (np.bincount(bit, minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


def sketch_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the number of shingles in just one of the two sets."""
    if len(a) > len(b):
        a, b = b, a
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)  # folds to the smaller sketch
    return int(np.bitwise_count(x ^ y).sum())


def most_different(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Largest symmetric difference of linked sets of sizes a and b."""
    return (a + b) * (DEN - NUM) // (DEN + NUM)


def _hash_parts(spark: SparkSession, total_bytes: int) -> int:
    return int(max(spark.sparkContext.defaultParallelism, -(-total_bytes // PART_BYTES)))


def _by_part(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys by (part, key), and the first of each part."""
    part = ((key >> U(32)) * U(parts) >> U(32)).astype(np.int64)
    order = np.argsort(key)  # the part is the leading digits of the key
    return order, np.searchsorted(part[order], np.arange(parts + 1))


NODE = T.StructField("node", T.LongType())
PACKED = "part int, owners binary, entries binary"


def _packed(key: np.ndarray, width: int, own: np.ndarray, owner: np.ndarray, cut: np.ndarray) -> pa.RecordBatch:
    """One row per part that has entries: the low ``width`` bytes of its keys, then its owners' places
    in the list of owners - or the owners themselves where a part has fewer entries than that list."""
    some = np.flatnonzero(np.diff(cut))
    low = key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    place = own.astype("<u2" if len(owner) < 65536 else "<u4")
    whole = owner.astype("<i8").tobytes()
    owners, entries = [], []
    for p in some.tolist():
        a, b = int(cut[p]), int(cut[p + 1])
        direct = b - a < len(owner)
        owners.append(owner[own[a:b]].astype("<i8").tobytes() if direct else whole)
        entries.append(low[a:b].tobytes() + (b"" if direct else place[a:b].tobytes()) + np.int64(b - a).tobytes())
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(owners, pa.binary()),
                                       pa.array(entries, pa.binary())], names=["part", "owners", "entries"])


def _unpacked(table: pa.Table, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for owners, entries in zip(table.column("owners").to_pylist(), table.column("entries").to_pylist()):
        n = int(np.frombuffer(entries, np.int64, 1, len(entries) - 8)[0])
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(entries, np.uint8, n * width).reshape(n, width)
        ids = np.frombuffer(owners, "<i8")
        if len(entries) > n * width + 8:
            ids = ids[np.frombuffer(entries, "<u2" if len(ids) < 65536 else "<u4", n, n * width)]
        yield wide.view("<u8").reshape(-1), ids


def _support(sets: DataFrame, parts: int) -> DataFrame:
    """node, shared: shingles of the counted domain that another set also has."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = U(int(DOMAIN * (1 << 32)))
        for batch in batches:
            for rows in blocks(batch, TEXT, 1 << 20):
                value, first = shingle_sets(as_bytes(rows.column(TEXT)))
                node = node_ids(value, first)
                own = np.repeat(np.arange(len(node)), np.diff(first))
                keep = (mix64(value) >> U(32)) < limit
                value, own = value[keep], own[keep]
                order, cut = _by_part(value, parts)
                # 40 bits within a part: a clash could only let one more set pass the filter
                yield _packed(value[order], 5, own[order], node, cut)

    def shared(table: pa.Table) -> pa.Table:
        keys, nodes = [], []
        for key, node in _unpacked(table, 5):
            keys.append(key)
            nodes.append(node)
        key, node = np.concatenate(keys), np.concatenate(nodes)
        order = np.argsort(key, kind="stable")
        key, node = key[order], node[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        several = np.minimum.reduceat(node, at) != np.maximum.reduceat(node, at)
        hit = np.repeat(several, np.diff(np.concatenate([at, [len(key)]])))
        # equal texts repeat whole sets: each (shingle, set) counts once
        key, node = key[hit], node[hit]
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        ids, counts = np.unique(node[new], return_counts=True)
        return pa.table({"node": ids, "shared": counts.astype(np.int64)})

    packed = sets.mapInArrow(pack, PACKED)
    return (packed.groupBy("part").applyInArrow(shared, "node long, shared long")
            .groupBy("node").agg(F.sum("shared").alias("shared")))


def _survivors(docs: DataFrame, nodes: DataFrame, parts: int) -> DataFrame:
    """doc_id (null where all rows of the set have none), node of one document for each set that
    passes the support filter."""
    support = _support(docs.select(F.col("text").cast("string").alias(TEXT)), parts)
    one = nodes.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"),
                                                           F.first("counted").alias("counted"))
    quarter = F.floor(F.col("n") * (DEN - NUM) / DEN)
    # a set without a row there shares no counted shingle; it may still link by the others
    shared = F.coalesce("shared", F.lit(0))
    return (one.join(support, "node", "left").where(F.col("counted") - shared <= quarter)
            .select("doc_id", "node"))


SET_SCHEMA = "node long, size long, need long, sketch binary, shingles binary"


def shingles_of(stored: bytes) -> np.ndarray:
    """The 48-bit shingle hashes of a stored set, sorted."""
    wide = np.zeros((len(stored) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(stored, np.uint8).reshape(-1, 6)
    return wide.view("<u8").reshape(-1)


def _nodes_of(texts: list[bytes]) -> list[np.ndarray]:
    return [node_ids(*shingle_sets(texts))]


def _write_sets(docs: DataFrame, survivors: DataFrame, path: str) -> None:
    """The shingle sets (48 bits of each hash) of the survivors."""
    rows = (docs.select("doc_id", F.col("text").cast("string").alias(TEXT))
            .join(small_side(survivors.where("doc_id IS NOT NULL")), "doc_id").select(TEXT, "node"))
    unnamed = survivors.where("doc_id IS NULL").select("node")
    if unnamed.limit(1).count():  # texts that stand on no row with an id are found by their node
        spare = map_texts(docs.where("doc_id IS NULL").select("text").distinct(), lambda: _nodes_of, [NODE], keep=["text"])
        rows = rows.union(spare.join(small_side(unnamed), "node").groupBy("node").agg(F.min("text").alias(TEXT))
                          .select(TEXT, "node"))
    schema = to_arrow_schema(T.StructType([NODE, T.StructField("size", T.LongType()), T.StructField("need", T.LongType()),
                                          T.StructField("sketch", T.BinaryType()), T.StructField("shingles", T.BinaryType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, TEXT, 1 << 20):
                value, first = shingle_sets(as_bytes(part.column(TEXT)))
                node = node_ids(value, first)
                want = np.asarray(part.column("node"))
                out = []
                words = sketch_words(np.diff(first))
                need = least_large(value >> U(16), first)
                for i in np.flatnonzero(node == want).tolist():  # other texts of a repeated id drop out
                    v = value[first[i]: first[i + 1]] >> U(16)
                    out.append({"node": int(node[i]), "size": len(v), "need": int(need[i]), "sketch": parity_sketch(v, int(words[i])),
                                "shingles": v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    rows.mapInArrow(run, SET_SCHEMA).write.parquet(path)


def _pack_signatures(sets: DataFrame, parts: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in blocks(batch, "shingles", 1 << 21):
                size = np.asarray(rows.column("size"))
                value = shingles_of(b"".join(rows.column("shingles").to_pylist()))
                sig, own = signatures(value, np.concatenate([[0], np.cumsum(size)]))
                order, cut = _by_part(sig, parts)
                yield _packed(sig[order], 8, own[order], np.asarray(rows.column("node")), cut)

    return sets.select("node", "size", "shingles").mapInArrow(pack, PACKED)


def _buckets(packed: DataFrame) -> DataFrame:
    """kind 0: pairs (a, b) to test; kind 1: (signature a, node b) rows of large buckets."""
    def run(table: pa.Table) -> pa.Table:
        sigs, nodes = zip(*_unpacked(table, 8))
        sig, node = np.concatenate(sigs), np.concatenate(nodes)
        order = np.argsort(sig, kind="stable")
        alone = np.ones(len(sig), bool)
        same = sig[order][1:] == sig[order][:-1]
        alone[1:][same] = False
        alone[:-1][same] = False
        order = order[~alone]  # most signatures stand alone; only the others are looked at further
        sig, node = sig[order], node[order]
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[new], node[new]
        at = np.flatnonzero(np.concatenate([np.ones(min(len(sig), 1), bool), sig[1:] != sig[:-1]]))
        size = np.diff(np.concatenate([at, [len(sig)]]))
        rank = np.arange(len(sig)) - np.repeat(at, size)
        members = np.repeat(size, size)
        pairs = [np.zeros((0, 2), np.int64)]
        for back in range(1, SMALL):  # all pairs of small buckets, by distance in the bucket
            i = np.flatnonzero((rank >= back) & (members <= SMALL))
            pairs.append(np.stack([node[i - back], node[i]], axis=1))
        i = np.flatnonzero((rank > 0) & (members > SMALL))
        pairs.append(np.stack([node[i - rank[i]], node[i]], axis=1))
        pair = np.unique(np.concatenate(pairs), axis=0)
        big = np.flatnonzero(members > SMALL)
        kind = np.concatenate([np.zeros(len(pair), np.int8), np.ones(len(big), np.int8)])
        return pa.table({"kind": kind, "a": np.concatenate([pair[:, 0], sig[big].astype(np.int64)]),
                         "b": np.concatenate([pair[:, 1], node[big]])})

    return packed.groupBy("part").applyInArrow(run, "kind byte, a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones of the distinct pairs (a, b)."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = np.asarray(batch.column("size_a")), np.asarray(batch.column("size_b"))
            ok = np.minimum(sa, sb) * DEN >= np.maximum(sa, sb) * NUM
            most = most_different(sa, sb)
            at = [i for i in np.flatnonzero(ok).tolist() if sketch_difference(
                batch.column("sketch_a")[i].as_py(), batch.column("sketch_b")[i].as_py()) <= most[i]]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(at, pa.int64())),
                                              batch.column("b").take(pa.array(at, pa.int64()))], names=["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = []
            for i in range(batch.num_rows):
                x, y = shingles_of(batch.column("set_a")[i].as_py()), shingles_of(batch.column("set_b")[i].as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                if DEN * both >= NUM * (len(x) + len(y) - both):
                    at.append(i)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(at, pa.int64())),
                                              batch.column("b").take(pa.array(at, pa.int64()))], names=["a", "b"])

    def side(name: str, *cols: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), *[F.col(c).alias(f"{n}_{name}") for c, n in zip(cols[::2], cols[1::2])])

    likely = (pairs.join(side("a", "size", "size", "sketch", "sketch"), "a")
              .join(side("b", "size", "size", "sketch", "sketch"), "b").mapInArrow(sketch, "a long, b long"))
    return (likely.join(side("a", "shingles", "set"), "a").join(side("b", "shingles", "set"), "b")
            .mapInArrow(exact, "a long, b long"))


def components(links: DataFrame, work: str) -> DataFrame:
    """node, label (smallest node of its component) of all nodes on links (a, b).

    Each round gives a node the smallest label of its neighbours and then the label of that label;
    rounds end when nothing changes. Every round is a table in the shared folder."""
    spark = links.sparkSession
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both.write.parquet(f"{work}/edges")
    edges = spark.read.parquet(f"{work}/edges")
    edges.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("label")).write.parquet(f"{work}/label-0")
    step = 0
    while True:
        old = spark.read.parquet(f"{work}/label-{step}")
        near = (edges.join(old.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
                .select(F.col("a").alias("node"), "near"))
        hop = old.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = (old.join(near, "node").join(hop, "label", "left")
               .select("node", F.least("label", "near", F.coalesce("far", "label")).alias("label"), F.col("label").alias("was")))
        step += 1
        new.write.parquet(f"{work}/label-{step}")
        if spark.read.parquet(f"{work}/label-{step}").where("label <> was").limit(1).count() == 0:
            return spark.read.parquet(f"{work}/label-{step}").select("node", "label")


def _large_buckets(big: DataFrame, labels: DataFrame, sets: DataFrame, forest: bool) -> DataFrame:
    """Pairs of different components within large buckets that the sketch cannot exclude: all of
    them, or (``forest``) of each group only such as join its components, each pair of them once."""
    # a set matters in large buckets only where it is in at least ``need`` of them (see 4 above)
    counts = big.groupBy("b").agg(F.count("*").alias("large"))
    heavy = counts.join(sets.select(F.col("node").alias("b"), "need"), "b").where("large >= need").select("b")
    rows = (big.join(heavy, "b").join(labels.select(F.col("node").alias("b"), "label"), "b", "left")
            .select("a", "b", F.coalesce("label", "b").alias("label")))
    mixed = rows.groupBy("a").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members"))
    mixed = mixed.where("lo <> hi").select("a", F.ceil(F.col("members") / BLOCK).cast("int").alias("cuts"))
    # a bucket is cut into blocks by a hash; each pair of blocks is one group of bounded size
    cut = F.pmod(F.xxhash64("b"), F.col("cuts")).cast("int")
    dealt = rows.join(mixed, "a").withColumn("mine", cut).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    full = dealt.join(sets.select(F.col("node").alias("b"), "size", "sketch"), "b")

    def run(table: pa.Table) -> pa.Table:
        node, label = np.asarray(table.column("b")), table.column("label").to_numpy().copy()
        size, mine = np.asarray(table.column("size")), np.asarray(table.column("mine"))
        stored = [np.frombuffer(x, np.uint64) for x in table.column("sketch").to_pylist()]
        least = min(map(len, stored))
        sketch = np.stack([np.bitwise_xor.reduce(x.reshape(-1, least), axis=0) for x in stored])
        across = len(np.unique(mine)) > 1
        out = [np.zeros((0, 2), np.int64)]
        for i in range(len(node)):
            ok = (node > node[i]) & (label != label[i]) & ((mine != mine[i]) if across else True)
            ok &= np.minimum(size, size[i]) * DEN >= np.maximum(size, size[i]) * NUM
            j = np.flatnonzero(ok)
            j = j[np.bitwise_count(sketch[j] ^ sketch[i]).sum(axis=1) <= most_different(size[j], size[i])]
            if forest and len(j):
                _, at = np.unique(label[j], return_index=True)
                j = j[at]
                # the joined components count as one from here on in this group
                label[np.isin(label, label[j])] = label[i]
            out.append(np.stack([np.full(len(j), node[i]), node[j]], axis=1))
        out = np.concatenate(out)
        return pa.table({"a": out[:, 0], "b": out[:, 1]})

    return full.groupBy("a", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi")
                        ).applyInArrow(run, "a long, b long").distinct()


def small_side(rows: DataFrame, max_rows: int = 1 << 20) -> DataFrame:
    """``rows`` (a few integers each) marked for broadcast where a count proves them few; otherwise
    the join is left to shuffle."""
    return F.broadcast(rows) if rows.count() <= max_rows else rows


def repeated_ids(nodes: DataFrame) -> bool:
    return nodes.where("n_shingles > 0").groupBy("doc_id", "node").count().where("count > 1").limit(1).count() > 0


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node, component_id; one row per row of ``docs``."""
    spark, work = docs.sparkSession, scratch_path(docs.sparkSession, "partenum")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def make():
        limit = U(int(DOMAIN * (1 << 32)))

        def run(texts: list[bytes]):
            value, first = shingle_sets(texts)
            upto = np.concatenate([[0], np.cumsum((mix64(value) >> U(32)) < limit)])
            return np.diff(first), node_ids(value, first), np.diff(upto[first])
        return run

    map_texts(docs, make, [T.StructField("n_shingles", T.LongType()), NODE, T.StructField("counted", T.LongType())]
              ).write.parquet(f"{work}/nodes")
    nodes = spark.read.parquet(f"{work}/nodes")
    shingles = nodes.agg(F.sum("n_shingles")).first()[0] or 0
    _survivors(docs, nodes, _hash_parts(spark, int(shingles * 7 * DOMAIN))).write.parquet(f"{work}/survivors")
    _write_sets(docs, spark.read.parquet(f"{work}/survivors"), f"{work}/sets")
    sets = spark.read.parquet(f"{work}/sets")
    if repeated_ids(nodes):  # rows that repeat an id and a text have repeated their set
        sets.dropDuplicates(["node"]).write.parquet(f"{work}/distinct-sets")
        sets = spark.read.parquet(f"{work}/distinct-sets")
    kept = sets.agg(F.sum("size")).first()[0] or 0
    _buckets(_pack_signatures(sets, _hash_parts(spark, kept * 10))).write.partitionBy("kind").parquet(f"{work}/buckets")
    schema = "a long, b long, kind int"
    found = spark.read.schema(schema).parquet(f"{work}/buckets")
    _verified(found.where("kind = 0").select("a", "b").distinct(), sets).write.parquet(f"{work}/links-1")
    links = spark.read.parquet(f"{work}/links-1")
    labels = components(links, f"{work}/components-1")
    big = found.where("kind = 1").select("a", "b")
    for step in range(FORESTS + 1):  # pairs that join components first; at last every pair left
        proposed = _large_buckets(big, labels, sets, step < FORESTS)
        proposed.write.parquet(f"{work}/pairs-{step + 2}")
        proposed = spark.read.parquet(f"{work}/pairs-{step + 2}")
        if proposed.limit(1).count() == 0:
            break  # no pair of different components is left that the sketch allows
        _verified(proposed, sets).write.parquet(f"{work}/links-{step + 2}")
        more = spark.read.parquet(f"{work}/links-{step + 2}")
        if more.limit(1).count():
            links = links.union(more)
            labels = components(links, f"{work}/components-{step + 2}")
    return _labelled(nodes, labels)


def _labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Each row with the smallest doc_id of its component; empty sets stay alone."""
    one = nodes.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    one = one.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = one.groupBy("label").agg(F.min("least").alias("component_id"))
    return (nodes.join(one.join(lowest, "label").select("node", "component_id"), "node", "left")
            .select("doc_id", "n_shingles", "node",
                    F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns. Documents
    without shingles or without an id stay; of rows that repeat an id and a text one stays. An id on
    different texts loses only the rows whose text is in a component of a smaller id."""
    found = scratch_path(docs.sparkSession, "partenum-kept")
    similar(docs).write.parquet(found)
    rows = docs.sparkSession.read.parquet(found)
    gone = rows.where("doc_id <> component_id").select("doc_id", F.col("node").alias("__node")).distinct()
    columns = [f"`{c}`" for c in docs.columns]
    kept = docs.join(small_side(gone.select("doc_id").distinct()), "doc_id", "left_anti").select(*columns)
    mixed = gone.join(rows.where("doc_id = component_id").select("doc_id").distinct(), "doc_id", "left_semi")
    if mixed.limit(1).count():  # ids that also stand on a text that stays
        some = docs.join(small_side(mixed.select("doc_id").distinct()), "doc_id", "left_semi")
        keyed = map_texts(some, lambda: _nodes_of, [T.StructField("__node", T.LongType())], keep=docs.columns)
        kept = kept.union(keyed.join(small_side(mixed), ["doc_id", "__node"], "left_anti").select(*columns))
    return kept.dropDuplicates(["doc_id", "text"]) if repeated_ids(rows) else kept
