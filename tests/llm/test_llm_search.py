"""Hard-negative mining, ranked lexical search and line dedup against brute force, with odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from vellum.llm import hard_negatives, lexical_search, line_dedup

# -- 11: hard negatives -----------------------------------------------------------------------


def _mined(rows, every=50, positives=5, negatives=3):
    ok = {}
    for i, y, v in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        y = (y + 1) % 10 if i % 7 == 0 else y
        one = (y, [math.floor(256 * float(x)) for x in v])
        ok[i] = min(ok.get(i, one), one)
    score = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = set()
    for a, (ya, qa) in ok.items():
        if a % every:
            continue
        best = sorted((-score(qa, q), i) for i, (y, q) in ok.items() if i != a and y == ya)[:positives]
        away = sorted((-score(qa, q), i) for i, (y, q) in ok.items() if y != ya)
        for s, p in best:
            fit = [(n, i) for n, i in away if 50 * -s <= 100 * -n <= 95 * -s][:negatives]
            out |= {(a, p, r + 1, i, -s, -n) for r, (n, i) in enumerate(fit)}
    return out


VECTORS = "vec_id long, embedding array<float>, label int, block string, q double, key int"


def _vector_rows(n=900, dims=6, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dims) / 2], int(rng.integers(0, 3))) for i in range(n)]
    rows += [(2000 + i, rows[7][1], i % 4) for i in range(60)]  # copies of one vector: ties
    rows += [(3000, None, 1), (3050, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (3100, rows[3][1], None),
             (3150, [float("nan")] * dims, 2), (3200, [float("inf")] * dims, 2), (None, rows[4][1], 1),
             (3250, [0.0] * dims, 0), (3300, [1.0, 2.0], 1), (50, rows[50][1], 2), rows[100], rows[100],
             (4950, rows[4][1], 9)]
    return rows


@pytest.mark.parametrize("block_rows", [2048, 32])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block_rows):
    rows = _vector_rows()
    monkeypatch.setattr(hard_negatives, "PACK", 4)
    monkeypatch.setattr(hard_negatives, "ZONE_PACK", 3)
    df = spark.createDataFrame([(i, v, y, "x", 1.0, 2) for i, v, y in rows], VECTORS).repartition(5)
    if block_rows != 2048:  # many blocks: the block size travels to the workers inside the function
        real = hard_negatives.write_blocks
        monkeypatch.setattr(hard_negatives, "write_blocks",
                            lambda r, d, e, p: real(r.repartition(40), d, e, p))
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = hard_negatives.mine(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = _mined([(i, y, v and [*v, *[0.0] * (6 - len(v))]) for i, v, y in rows])
    found = {(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got}
    assert len(got) == len(found)
    assert found == want and want


def test_hard_negatives_of_empty_and_lone_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(empty).count() == 0
    lone = spark.createDataFrame([(0, [1.0, 0.0], 3), (1, [1.0, 0.5], 4)], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(lone).count() == 0


def test_zone_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    rows = rng.integers(-200, 200, (64, 5))
    low, high = rows.min(0)[None], rows.max(0)[None]
    q = rng.integers(-200, 200, (40, 5))
    least, most = hard_negatives._bounds(q, low, high)
    scores = q @ rows.T
    assert (scores.max(1) <= most[:, 0]).all() and (scores.min(1) >= least[:, 0]).all()


def test_hilbert_neighbours_touch():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = hard_negatives.hilbert_keys(cells, 3)
    assert len(set(key.tolist())) == len(cells)
    assert np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1).max() == 1


def test_large_components_stay_exact():
    a = np.array([[2**27, 1, -(2**27)]])
    assert hard_negatives.products(a, a)[0, 0] == 2**54 + 1 + 2**54


# -- 12: ranked lexical search ----------------------------------------------------------------

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def _ranked(docs, items, k):
    bags = [(d, Counter(_TERM.findall(_lower(t)))) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(_TERM.findall(_lower(t)))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, b in bags:
            m = 10 + 90 * sum(b.values()) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m))
                    for t in terms if t in b)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def _corpus(n=300, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(80)] + ["Ñandú", "été", "naïve", "THE", "the", "x-1"]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 60)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(20)] + [(n + 50, None), (n + 51, ""), (n + 52, " .;\n"), (7, "w1 w70 again"),
                                                       (None, docs[3][1]), (n + 60, "w5 " * 30_000)]
    items = [(j, " ".join(rng.choices(words, k=12))) for j in range(25)]
    items += [(100, None), (101, ""), (102, "nowhere unseen"), (3, "w70 w71"), (None, "w60 w61"), (4, items[4][1])]
    return docs, items


@pytest.mark.parametrize("bundle", [256, 4])
def test_search_equals_brute_force(spark, monkeypatch, bundle):
    monkeypatch.setattr(lexical_search, "BUNDLE", bundle)
    docs, items = _corpus()
    d = spark.createDataFrame([(i, t, 1, "s") for i, t in docs], "doc_id long, text string, shard int, term string")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, bundle int")
    got = lexical_search.search(d.repartition(6), q)
    assert sorted((tuple(r) for r in got.collect()), key=str) == _ranked(docs, items, 10)


def test_search_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.search(d.limit(0), q).count() == 0
    assert lexical_search.search(d, q.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in lexical_search.search(d, q).collect()] == [(1, 1, 1)]


def test_accumulators_are_dropped_only_when_safe():
    """A shard with one strong document: the last stages must not lose a tie at the k-th place."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(lexical_search.CARRIED)
    base = {"bundle": 0, "shard": 0}
    head = {**base, "is_item": False, "ids": [5, 4, 3, 2], "lengths": [1, 1, 1, 1]}
    item = {**base, "item_id": 9, "is_item": True, "bands": [0, 1], "tids": [1, 2], "weights": [10, 1], "docs": [],
            "scores": [], "closed": False}
    left = pa.Table.from_pylist([head, item], schema=schema)
    post = [pa.table({"tid": pa.array(t, pa.int64()), "docs": pa.array(d, pa.list_(pa.int32())),
                      "tfs": pa.array(f, pa.list_(pa.int32()))}) for t, d, f in
            (([1], [[0, 2]], [[1, 1]]), ([2], [[0, 1, 2, 3]], [[1, 1, 1, 1]]))]
    mid = lexical_search.owner_stage(0, False, 2, 4, 4)(left, post[0])
    row = [r for r in mid.to_pylist() if r["is_item"]][0]
    assert row["docs"] == [0, 2] and row["closed"] and row["tids"] == [2]
    best = lexical_search.owner_stage(1, True, 2, 4, 4)(mid, post[1])
    assert best.column("doc_id").to_pylist() == [3, 5]  # equal scores by ascending id


# -- 13: line dedup ---------------------------------------------------------------------------


def _deduped(docs, least=10):
    blanks = " \t\n\x0b\x0c\r"
    key = lambda line: _lower(line.strip(blanks))
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            k = key(line)
            if len(k) >= least:
                first[k] = min(first.get(k, order(d)), order(d))
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or first[key(x)] == order(d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def _line_docs():
    rng = random.Random(8)
    pool = [f"Line number {i} of the pool" for i in range(40)] + ["short", "", "   ", "Ünïcode lines are lines", "ABCDEFGHIJ", "abcdefghij",
                                                                 "\t abcdefghij\r", "日本語の行は十文字以上です", "\x0b\x0cabcdefghi"]
    docs = [(i, "\n".join(rng.choices(pool, k=rng.randrange(1, 12)) + [f"own line of {i}"])) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "\n\n\n"), (503, docs[4][1]), (4, docs[5][1]), (4, docs[4][1]),
             (None, docs[9][1]), (None, docs[9][1]), (600, "\n".join(["every document has this line"] * 300)),
             (601, "\n".join(f"line {i % 1000} of a very long text" for i in range(200_000)) + "\n"),
             (602, "\n".join(f"line {i} of a very long text" for i in range(150)))]
    return docs + [(700 + i, "the frequent line\n" + f"another {i}") for i in range(300)]


def test_line_dedup_equals_brute_force(spark):
    docs = _line_docs()
    df = spark.createDataFrame([(d, t, 1, "x", 5) for d, t in docs], "doc_id long, text string, pos int, row string, h1 int")
    got = line_dedup.digests(df.repartition(7))
    assert sorted((tuple(r) for r in got.collect()), key=str) == _deduped(docs)
    assert line_dedup.digests(df.limit(0)).count() == 0


def test_line_dedup_bitmaps_are_runs(spark):
    docs = [(1, "\n".join(f"repeated line {i}" for i in range(640))), (2, "\n".join(f"repeated line {i}" for i in range(640))),
            (3, "x\n" * 200 + "repeated line 5")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    runs = {r.id: [tuple(x) for x in r.runs] for r in line_dedup.dedup_bitmaps(df).collect()}
    assert runs == {2: [(10, -1)], 3: [(3, 0), (1, 1 << 8)]}


def test_line_dedup_is_native(spark):
    df = spark.createDataFrame([(1, "a line of text\nb")], "doc_id long, text string")
    plan = line_dedup.digests(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


def test_queries_have_twins():
    from vellum.llm.queries import ORACLE, QUERIES

    assert {"op11_hard_negatives", "op12_lexical_search", "op13_line_dedup"} <= set(QUERIES) & set(ORACLE)
