"""Second-order histogram gradient boosting (M3) with AUC-tracked early stopping (M6).

The training rows are cut into quantile bins once and written as blocks (a byte per feature and row)
into the shared folder. A tree grows level by level: every block sends its rows through the tree so far
and adds their gradients and Hessians per (node, feature, bin); the sums are reduced by (node, group of
features), where the best split of the group is found, so the driver sees one row per node and group and
keeps the trees only. Between trees the margin is a stored column of the blocks: it is written anew every
``MARGIN_EVERY`` trees, and the few trees since then are replayed in the pass that needs them. A training
table of at most ``TASK_BINS`` bins is no work to deal out: one task reads its blocks and grows
``TREES_AT_ONCE`` trees, the same ones, instead of one job per level.

Objective per tree, with ``T(G) = sign(G) max(|G| - reg_alpha, 0)``: a leaf has the weight
``-T(G) / (H + reg_lambda)``, a split gains ``T(GL)^2/(HL+l) + T(GR)^2/(HR+l) - T(G)^2/(H+l)``; both sides
need a Hessian of ``min_child_weight``; after growth, splits into two leaves that gain less than ``gamma``
are pruned from the bottom. Gradients are rounded to multiples of 2**-24, so sums (below 2**29 in size) are
exact in any order and trees do not depend on how the rows are partitioned (row sampling does).

Early stopping watches an exact AUC (``metrics.roc_auc``) of the validation rows after every tree. The
margins of ``AUC_EVERY`` trees (or of those grown at once) are staged in one pass and scored in one job; the trees past the stop are
dropped, so the result is that of a check after each tree.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators import metrics as MT
from vellum.session import require_columns, scratch_path
from vellum.sources import fs as FS

MAX_BINS = 256
BLOCK_ROWS = 1 << 15
MARGIN_EVERY = 16  # trees between two writings of the margin column
AUC_EVERY = 16  # trees whose validation AUC is computed in one job
TASK_BINS = 1 << 25  # rows times features (64 at least) up to which one task grows the trees
TREES_AT_ONCE = 64  # trees that such a task grows
FEATURE_GROUP = 16  # features whose best split is found together
COLUMNS_AT_ONCE = 64  # features whose quantiles are sketched in one aggregate
GRID = float(1 << 24)

# Names and defaults of the boosted-tree settings.
DEFAULTS = {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.3, "subsample": 1.0, "colsample_bytree": 1.0,
            "min_child_weight": 1.0, "gamma": 0.0, "reg_alpha": 0.0, "reg_lambda": 1.0, "scale_pos_weight": 1.0,
            "early_stopping_rounds": None}


# ============================================================================================
# numpy parts, inside tasks

def soft(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def node_score(g, h, alpha: float, lam: float):
    den = h + lam
    return np.where(den > 0, soft(g, alpha) ** 2 / np.where(den > 0, den, 1.0), 0.0)


def leaf_weight(g: float, h: float, alpha: float, lam: float) -> float:
    return float(-soft(np.float64(g), alpha) / (h + lam)) if h + lam > 0 else 0.0


def best_split(G: np.ndarray, H: np.ndarray, cfg: dict) -> tuple[float, int, int, float, float]:
    """(gain, feature row, bin, left G, left H) of the best split of ``G, H`` (features x bins); rows
    with a bin up to the given one go left. No admissible split: gain -inf. Ties: first feature, bin."""
    gl, hl = np.cumsum(G, axis=1)[:, :-1], np.cumsum(H, axis=1)[:, :-1]
    g, h = G.sum(axis=1, keepdims=True), H.sum(axis=1, keepdims=True)
    gr, hr = g - gl, h - hl
    a, lam, least = cfg["reg_alpha"], cfg["reg_lambda"], cfg["min_child_weight"]
    gain = node_score(gl, hl, a, lam) + node_score(gr, hr, a, lam) - node_score(g, h, a, lam)
    gain = np.where((hl >= least) & (hr >= least) & (hl > 0) & (hr > 0), gain, -np.inf)
    if not gain.size:
        return -math.inf, 0, 0, 0.0, 0.0
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[f, b]), int(f), int(b), float(gl[f, b]), float(hl[f, b])


def gradients(margin: np.ndarray, y: np.ndarray, pos_weight: float) -> tuple[np.ndarray, np.ndarray]:
    p = 1.0 / (1.0 + np.exp(-margin))
    w = np.where(y == 1, pos_weight, 1.0)
    return np.round(w * (p - y) * GRID) / GRID, np.round(w * np.maximum(p * (1 - p), 1e-16) * GRID) / GRID


@dataclass
class Tree:
    """Nodes numbered like a heap (root 1, children 2i and 2i + 1); ``feature`` is -1 at leaves."""

    feature: np.ndarray
    cut: np.ndarray  # bins up to this one go left
    value: np.ndarray  # leaf weight times learning rate

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        n = 1 << (depth + 1)
        return cls(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n))

    @classmethod
    def of(cls, t: dict) -> "Tree":
        return cls(np.array(t["feature"], np.int32), np.array(t["cut"], np.int32), np.array(t["value"]))

    def body(self) -> str:
        return json.dumps({"feature": self.feature.tolist(), "cut": self.cut.tolist(), "value": self.value.tolist()})

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of bins reaches."""
        at = np.ones(len(bins), np.int64)
        rows = np.arange(len(bins))
        for _ in range(int(math.log2(len(self.feature)))):
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                break
            right = bins[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, 2 * at + right, at)
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)]


def tree_rows(df: DataFrame) -> list[dict]:
    """The bodies of ``(tree, body)`` rows by number; model-sized."""
    return [json.loads(r["body"]) for r in sorted(df.collect(), key=lambda r: r["tree"])]


def grown_tree(cfg: dict, splits: Callable[[Tree, list[int]], Iterable]) -> Tree:
    """One tree, grown level by level. ``splits`` gives rows as in ``SPLIT`` for the open nodes of a tree."""
    depth, rate = int(cfg["max_depth"]), float(cfg["learning_rate"])
    a, lam = cfg["reg_alpha"], cfg["reg_lambda"]
    tree = Tree.empty(depth)
    gains, sums = np.full(len(tree.feature), -math.inf), {}
    open_nodes = [1]
    for _ in range(depth):
        found: dict[int, tuple] = {}
        for r in sorted(splits(tree, open_nodes), key=lambda r: r["lead"]):  # ties: the first feature
            sums[r["node"]] = r["g"], r["h"]
            if r["gain"] is not None and r["gain"] > found.get(r["node"], (1e-6,))[0]:
                found[r["node"]] = (r["gain"], r["feature"], r["cut"], r["gl"], r["hl"])
        open_nodes = []
        for node in sorted(found):
            gain, f, cut, gl, hl = found[node]
            g, h = sums[node]
            tree.feature[node], tree.cut[node], gains[node] = f, cut, gain
            sums[2 * node], sums[2 * node + 1] = (gl, hl), (g - gl, h - hl)
            open_nodes += [2 * node, 2 * node + 1]
        if not open_nodes:
            break
    for node in range(len(tree.feature) // 2 - 1, 0, -1):  # pruned from the bottom
        if tree.feature[node] >= 0 and tree.feature[2 * node] < 0 and tree.feature[2 * node + 1] < 0 \
                and gains[node] < cfg["gamma"]:
            tree.feature[node] = -1
    for node, (g, h) in sums.items():
        tree.value[node] = rate * leaf_weight(g, h, a, lam)
    return tree


class RowsOfNodes:
    """The open nodes of one tree over rows held in memory. ``columns``: bins by feature; ``g, h`` belong to
    ``rows``. Of two children the one with fewer rows is summed; the other one is the rest, which is exact."""

    def __init__(self, columns: np.ndarray, rows: np.ndarray, use: np.ndarray, g: np.ndarray, h: np.ndarray,
                 bins_n: int, cfg: dict):
        self.columns = columns[use] if len(rows) == columns.shape[1] else np.stack([columns[f][rows] for f in use])
        self.use, self.g, self.h, self.bins_n, self.cfg = use, g, h, bins_n, cfg
        self.rows = {1: np.arange(len(rows))}
        self.sums: dict[int, np.ndarray] = {}

    def _summed(self, node: int) -> np.ndarray:
        rows, out = self.rows[node], np.empty((2, len(self.use), self.bins_n))
        g, h = self.g[rows], self.h[rows]
        for j, column in enumerate(self.columns):
            slot = column[rows].astype(np.intp)
            out[0, j] = np.bincount(slot, g, self.bins_n)
            out[1, j] = np.bincount(slot, h, self.bins_n)
        return out

    def _part(self, tree: Tree, node: int) -> None:
        """The rows and sums of both children of ``node``."""
        rows = self.rows.pop(node)
        right = self.columns[np.searchsorted(self.use, tree.feature[node])][rows] > tree.cut[node]
        self.rows[2 * node], self.rows[2 * node + 1] = rows[~right], rows[right]
        few, many = sorted((2 * node, 2 * node + 1), key=lambda n: len(self.rows[n]))
        self.sums[few] = self._summed(few)
        self.sums[many] = self.sums.pop(node) - self.sums[few]

    def splits(self, tree: Tree, nodes: list[int]) -> Iterator[dict]:
        for node in nodes:
            if node == 1:
                self.sums[1] = self._summed(1)
            elif node not in self.sums:
                self._part(tree, node // 2)
            G, H = self.sums[node]
            gain, f, cut, gl, hl = best_split(G, H, self.cfg)
            yield {"node": node, "lead": 0, "gain": gain if math.isfinite(gain) else None, "feature": int(self.use[f]),
                   "cut": cut, "gl": gl, "hl": hl, "g": float(G[0].sum()), "h": float(H[0].sum())}


def to_bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The bin of every value: the number of the feature's cuts that are not above it. NaN counts as
    smaller than every cut."""
    out = np.zeros(x.shape, np.uint8)
    for i, c in enumerate(cuts):
        col = x[:, i]
        out[:, i] = np.where(np.isnan(col), 0, np.searchsorted(c, col, side="right"))
    return out


def _matrix(column, dims: int) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    arr = arr if isinstance(arr, pa.Array) else pa.concat_arrays(arr.chunks)
    sizes = pc.list_value_length(arr)
    if arr.null_count or (len(arr) and pc.min_max(sizes).as_py() != {"min": dims, "max": dims}):
        raise ValueError(f"every feature vector must have {dims} values")
    flat = arr.flatten().cast(pa.float64())
    return np.asarray(pc.fill_null(flat, math.nan), np.float64).reshape(-1, dims)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def row_draws(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """A uniform number per row of a block, for one tree."""
    base = _mix(np.array([(seed * 1_000_003 + tree) & (2**64 - 1)], np.uint64)) ^ _mix(np.array([block], np.uint64))
    with np.errstate(over="ignore"):
        return _mix(base + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) / 2.0**64


def drawn_features(seed: int, tree: int, dims: int, share: float) -> np.ndarray:
    """The features of one tree, ascending."""
    k = max(1, int(share * dims))
    return np.arange(dims) if k >= dims else np.sort(np.random.default_rng((seed, tree)).choice(dims, k, replace=False))


# ============================================================================================
# the fitted model

@dataclass
class BoostedTrees:
    cuts: list[np.ndarray]
    base: float
    trees: list[Tree]
    info: dict = field(default_factory=dict)

    def margins(self, x: np.ndarray) -> np.ndarray:
        bins = to_bins(x, self.cuts)
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += tree.values(bins)
        return out

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds ``probability`` (vector of both classes) and ``prediction``."""
        model = df.sparkSession.sparkContext.broadcast(self)  # model-sized
        dims = len(self.cuts)
        src = F.col(features) if isinstance(df.schema[features].dataType, T.ArrayType) else vector_to_array(features)

        @F.arrow_udf("double")
        def score(col: pa.Array) -> pa.Array:
            return pa.array(1.0 / (1.0 + np.exp(-model.value.margins(_matrix(col, dims)))))

        p = df.withColumn("_p", score(src.cast("array<double>")))
        return (p.withColumn("probability", array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))))
                .withColumn("prediction", (F.col("_p") > 0.5).cast("double")).drop("_p"))

    def save(self, spark: SparkSession, path: str) -> None:
        """One Parquet row per tree and one with the bins; never pickled."""
        rows = [(-1, json.dumps({"base": self.base, "info": self.info, "cuts": [c.tolist() for c in self.cuts]}))]
        rows += [(i, t.body()) for i, t in enumerate(self.trees)]
        spark.createDataFrame(rows, "tree int, body string").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "BoostedTrees":
        head, *trees = tree_rows(spark.read.parquet(path))
        return cls([np.array(c) for c in head["cuts"]], head["base"], [Tree.of(t) for t in trees], head["info"])


# ============================================================================================
# the fit

BLOCK = "block long, n long, pos long, bins binary, y binary, margin binary, valid int"
SPLIT = "node int, lead int, gain double, feature int, cut int, gl double, hl double, g double, h double"


def quantile_cuts(df: DataFrame, features: str, dims: int, max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """At most ``max_bins`` - 1 cuts per feature from mergeable quantile sketches."""
    # one foldable text: as literals of their own, the marks of all features take the driver seconds to plan
    marks = F.split(F.lit(",".join(repr(k / max_bins) for k in range(max_bins))), ",").cast("array<double>")
    cuts: list[np.ndarray] = []
    for at in range(0, dims, COLUMNS_AT_ONCE):
        cols = [F.percentile_approx(F.when(~F.isnan(F.col(features)[i]), F.col(features)[i]), marks, 10000).alias(f"q{i}")
                for i in range(at, min(dims, at + COLUMNS_AT_ONCE))]
        row = df.agg(*cols).first()  # model-sized
        for values in row:
            found = np.unique(np.array(values if values else [], np.float64))
            cuts.append(found[1:])  # nothing lies below the least value
    return cuts


class HistogramBooster:
    """Fit on ``(features, label)``; settings as in ``DEFAULTS``. ``base_score`` None starts from the log
    odds of the weighted labels."""

    def __init__(self, seed: int = 42, max_bins: int = MAX_BINS, base_score: float | None = None,
                 validation_fraction: float = 0.1, **settings):
        unknown = set(settings) - set(DEFAULTS)
        if unknown:
            raise ValueError(f"unknown boosting settings {sorted(unknown)}")
        self.cfg = {**DEFAULTS, **{k: v for k, v in settings.items() if v is not None}}
        self.seed, self.max_bins, self.base_score = int(seed), max_bins, base_score
        self.validation_fraction = validation_fraction

    def fit(self, df: DataFrame, features: str = "features", label: str = "label",
            validation: DataFrame | None = None, cuts: list[np.ndarray] | None = None) -> BoostedTrees:
        """``validation`` is watched for early stopping; without it ``validation_fraction`` of the rows is
        set aside. A label other than 0 and 1 raises, as does a validation part with one class."""
        spark = df.sparkSession
        require_columns(df, features, label, what="training table")
        rows = self._rows(df, features, label)
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"), F.sum("y").alias("pos")).first()
        if not size["n"]:
            raise ValueError("empty training table")
        dims = int(size["d"])
        cuts = quantile_cuts(rows, "x", dims, self.max_bins) if cuts is None else cuts
        patience = self.cfg["early_stopping_rounds"]
        share = self.validation_fraction if patience and validation is None else 0.0
        work = scratch_path(spark, "boosting")
        self._blocks(rows, cuts, share).write.partitionBy("valid").parquet(f"{work}/0")
        if validation is not None:
            (self._blocks(self._rows(validation, features, label), cuts, 0.0).withColumn("valid", F.lit(1))
             .write.mode("append").partitionBy("valid").parquet(f"{work}/0"))
        try:
            return self._boost(spark, work, cuts, patience)
        finally:
            FS.delete(spark, work)

    def _rows(self, df: DataFrame, features: str, label: str) -> DataFrame:
        src = F.col(features) if isinstance(df.schema[features].dataType, T.ArrayType) else vector_to_array(features)
        y = F.col(label).cast("double")
        y = F.when(y.isin(0.0, 1.0), y.cast("int")).otherwise(F.raise_error(F.lit(f"'{label}' must be 0 or 1")).cast("int"))
        return df.select(src.cast("array<double>").alias("x"), y.alias("y"))

    def _blocks(self, rows: DataFrame, cuts: list[np.ndarray], share: float) -> DataFrame:
        """Rows as blocks of bins; ``share`` of the rows, drawn by place, go to blocks of their own."""
        dims, seed = len(cuts), self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            name = TaskContext.get().partitionId() << 32
            held: dict[bool, list] = {False: [], True: []}
            seen = 0

            def flush(valid: bool) -> pa.RecordBatch:
                nonlocal name
                bins, y = (np.concatenate(z) for z in zip(*held[valid]))
                held[valid] = []
                name += 1
                return pa.RecordBatch.from_pylist([{
                    "block": name - 1, "n": len(y), "pos": int(y.sum()), "bins": bins.tobytes(),
                    "y": y.astype(np.uint8).tobytes(), "margin": b"", "valid": int(valid)}], schema=schema)

            schema = pa.schema([("block", pa.int64()), ("n", pa.int64()), ("pos", pa.int64()), ("bins", pa.binary()),
                                ("y", pa.binary()), ("margin", pa.binary()), ("valid", pa.int32())])
            for batch in batches:
                bins = to_bins(_matrix(batch.column("x"), dims), cuts)
                y = np.asarray(batch.column("y"))
                aside = row_draws(seed, -1 & 0xFFFF, name + seen, len(y)) < share
                seen += len(y)
                for valid in (False, True):
                    pick = aside == valid
                    if pick.any():
                        held[valid].append((bins[pick], y[pick]))
                        if sum(len(z) for _, z in held[valid]) >= BLOCK_ROWS:
                            yield flush(valid)
            for valid in (False, True):
                if held[valid]:
                    yield flush(valid)

        return rows.mapInArrow(run, BLOCK)

    # -- passes over the blocks

    def _boost(self, spark: SparkSession, work: str, cuts: list[np.ndarray], patience: int | None) -> BoostedTrees:
        dims, cfg = len(cuts), self.cfg
        stored, generation = spark.read.parquet(f"{work}/0"), 0
        sums = stored.groupBy("valid").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
        count = {r["valid"]: r for r in sums.collect()}
        if 0 not in count:
            raise ValueError("no training rows beside the validation rows")
        if patience:
            v = count.get(1)
            if v is None or not 0 < v["pos"] < v["n"]:
                raise ValueError("early stopping needs validation rows of both classes")
        base = self._base(count[0])
        model = BoostedTrees(cuts, base, [], {"best_iteration": 0, "best_score": None, "history": []})
        since = 0  # trees already in the stored margin
        best, best_at, tracked = -math.inf, 0, 0
        rounds = int(cfg["n_estimators"])
        step = TREES_AT_ONCE if count[0]["n"] * max(dims, 64) <= TASK_BINS else 1
        for t in range(0, rounds, step):
            if step > 1:
                model.trees += self._grow_at_once(stored, model, since, t, min(step, rounds - t))
            else:
                model.trees.append(self._grow(stored, model, since, t, dims))
            done = len(model.trees)
            if patience and (done - tracked >= AUC_EVERY or done == rounds):
                stop = False
                for r, auc in self._aucs(stored, model, since, tracked):
                    model.info["history"].append(auc)
                    if auc > best:
                        best, best_at = auc, r
                    elif r - best_at >= int(patience):
                        stop = True
                        break
                tracked = done
                if stop:
                    model.info["stopped_at"] = len(model.info["history"])
                    break
            if done - since >= MARGIN_EVERY and done < rounds and (not patience or tracked == done):
                generation += 1
                self._with_margins(stored, model, since).write.partitionBy("valid").parquet(f"{work}/{generation}")
                FS.delete(spark, f"{work}/{generation - 1}")
                stored, since = spark.read.parquet(f"{work}/{generation}"), done
        if patience:
            model.trees = model.trees[:best_at]
            model.info.update(best_iteration=best_at, best_score=best)
        else:
            model.info["best_iteration"] = len(model.trees)
        return model

    def _base(self, row) -> float:
        if self.base_score is not None:
            return math.log(self.base_score / (1 - self.base_score))
        pos, neg = row["pos"] * self.cfg["scale_pos_weight"], row["n"] - row["pos"]
        return math.log(pos / neg) if pos > 0 and neg > 0 else 0.0

    def _grow(self, stored: DataFrame, model: BoostedTrees, since: int, number: int, dims: int) -> Tree:
        use = drawn_features(self.seed, number, dims, float(self.cfg["colsample_bytree"]))
        return grown_tree(self.cfg, lambda tree, nodes: self._level(stored, model, since, number, tree, nodes, use, dims).collect())

    def _grow_at_once(self, stored: DataFrame, model: BoostedTrees, since: int, first: int, trees: int) -> list[Tree]:
        """The trees that ``_grow`` gives one by one, grown by one task that holds all training rows."""
        cfg, seed, base, dims, bins_n = self.cfg, self.seed, model.base, len(model.cuts), self.max_bins
        late = model.trees[since:first]
        share, pos = float(cfg["subsample"]), float(cfg["scale_pos_weight"])

        def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = [b for batch in batches for b in batch.to_pylist()]
            bins, y, margin = (np.concatenate(z) for z in zip(*[unpack(b, dims, base, late) for b in blocks]))
            names = [(b["block"], b["n"]) for b in blocks]
            del blocks
            columns = np.ascontiguousarray(bins.T)
            for number in range(first, first + trees):
                use = drawn_features(seed, number, dims, float(cfg["colsample_bytree"]))
                rows = np.arange(len(y))
                if share < 1.0:
                    rows = rows[np.concatenate([row_draws(seed, number, b, n) for b, n in names]) < share]
                g, h = gradients(margin[rows], y[rows], pos)
                tree = grown_tree(cfg, RowsOfNodes(columns, rows, use, g, h, bins_n, cfg).splits)
                margin += tree.values(bins)
                yield pa.RecordBatch.from_pydict({"tree": pa.array([number], pa.int32()), "body": pa.array([tree.body()])})

        made = (stored.filter("valid = 0").select("block", "n", "bins", "y", "margin").coalesce(1)
                .mapInArrow(grow, "tree int, body string"))
        return [Tree.of(t) for t in tree_rows(made)]

    def _level(self, stored: DataFrame, model: BoostedTrees, since: int, number: int, tree: Tree,
               nodes: list[int], use: np.ndarray, dims: int) -> DataFrame:
        """One row per (open node, group of features): its best split and the node's sums."""
        cfg, seed, base = self.cfg, self.seed, model.base
        late, bins_n = model.trees[since:number], self.max_bins
        share, pos = float(cfg["subsample"]), float(cfg["scale_pos_weight"])
        groups = [use[i: i + FEATURE_GROUP] for i in range(0, len(use), FEATURE_GROUP)]
        place = np.full(len(tree.feature), -1)
        place[nodes] = np.arange(len(nodes))

        def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            G = np.zeros((len(nodes), len(use), bins_n))
            H = np.zeros_like(G)
            for batch in batches:
                for block in batch.to_pylist():
                    bins, y, margin = unpack(block, dims, base, late)
                    g, h = gradients(margin, y, pos)
                    at = place[tree.nodes(bins)]
                    ok = at >= 0
                    if share < 1.0:
                        ok &= row_draws(seed, number, block["block"], len(y)) < share
                    at, g, h = at[ok], g[ok], h[ok]
                    for j, f in enumerate(use):
                        slot = at * bins_n + bins[ok, f]
                        G[:, j] += np.bincount(slot, g, len(nodes) * bins_n).reshape(-1, bins_n)
                        H[:, j] += np.bincount(slot, h, len(nodes) * bins_n).reshape(-1, bins_n)
            for k, node in enumerate(nodes):
                for i in range(len(groups)):
                    part = slice(i * FEATURE_GROUP, i * FEATURE_GROUP + len(groups[i]))
                    yield pa.RecordBatch.from_pydict({
                        "node": pa.array([node], pa.int32()), "grp": pa.array([i], pa.int32()),
                        "hist": pa.array([np.stack([G[k, part], H[k, part]]).tobytes()])})

        def split(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            node, grp = key[0].as_py(), key[1].as_py()
            total = np.zeros((2, len(groups[grp]), bins_n))
            for batch in batches:  # streamed: one histogram at a time
                for raw in batch.column("hist").to_pylist():
                    total += np.frombuffer(raw).reshape(total.shape)
            gain, f, cut, gl, hl = best_split(total[0], total[1], cfg)
            yield pa.RecordBatch.from_pylist([{
                "node": node, "lead": grp, "gain": gain if math.isfinite(gain) else None,
                "feature": int(groups[grp][f]), "cut": cut, "gl": gl, "hl": hl,
                "g": float(total[0, 0].sum()), "h": float(total[1, 0].sum())}], schema=split_schema)

        split.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch],
                                 "return": Iterator[pa.RecordBatch]}
        split_schema = pa.schema([("node", pa.int32()), ("lead", pa.int32()), ("gain", pa.float64()),
                                  ("feature", pa.int32()), ("cut", pa.int32()), ("gl", pa.float64()), ("hl", pa.float64()),
                                  ("g", pa.float64()), ("h", pa.float64())])
        made = (stored.filter("valid = 0").select("block", "bins", "y", "margin")
                .mapInArrow(histograms, "node int, grp int, hist binary"))
        return made.groupBy("node", "grp").applyInArrow(split, SPLIT)

    def _with_margins(self, stored: DataFrame, model: BoostedTrees, since: int) -> DataFrame:
        base, late, dims = model.base, model.trees[since:], len(model.cuts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [unpack(b, dims, base, late)[2].tobytes() for b in batch.to_pylist()]
                at = batch.schema.get_field_index("margin")
                yield batch.set_column(at, "margin", pa.array(made, pa.binary()))

        return stored.select("block", "n", "pos", "bins", "y", "margin", "valid").mapInArrow(run, BLOCK)

    def _aucs(self, stored: DataFrame, model: BoostedTrees, since: int, tracked: int) -> list[tuple[int, float]]:
        """(round from 1, exact validation AUC) of the trees after ``tracked``: margins staged tree by
        tree in one pass, scored in one job."""
        base, dims = model.base, len(model.cuts)
        late = model.trees[since:]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in batch.to_pylist():
                    bins, y, margin = unpack(block, dims, base, [])
                    for k, tree in enumerate(late):
                        margin = margin + tree.values(bins)
                        if since + k >= tracked:
                            yield pa.RecordBatch.from_pydict({
                                "round": pa.array(np.full(len(y), since + k + 1, np.int32)),
                                "label": pa.array(y.astype(np.int32)), "score": pa.array(margin)})

        staged = stored.filter("valid = 1").select("bins", "y", "margin").mapInArrow(run, "round int, label int, score double")
        return sorted((r["round"], r["auc"]) for r in MT.roc_auc(staged, by=["round"]).collect())


def unpack(block: dict, dims: int, base: float, late: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, labels and margins of a block, the margins with the trees since they were stored."""
    bins = np.frombuffer(block["bins"], np.uint8).reshape(-1, dims)
    y = np.frombuffer(block["y"], np.uint8)
    margin = np.frombuffer(block["margin"]).copy() if block["margin"] else np.full(len(y), base)
    for tree in late:
        margin += tree.values(bins)
    return bins, y, margin
