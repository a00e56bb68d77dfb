"""Multi-output gradient-boosted trees with sketched split search, on Spark.

After the SketchBoost method (Iosipoi & Vakhrushev, NeurIPS 2022): one tree
serves all labels; splits are searched on a random projection of the
gradient matrix to ``sketch_dim`` outputs; leaf values use the full gradient.
Loss: binary cross-entropy on logits, no hessian (count + lambda in the
denominators).

Distribution (one Spark job per tree level, rows never leave their task):

* features are binned once into <= ``max_bin`` bins by mergeable quantile
  summaries: each task keeps SUMMARY weighted points per feature, and summaries
  are merged MERGED at a time, so no task sees more than these;
* per level, every partition routes its rows through the tree so far and
  emits histogram partials (node, feature, bin) -> (sketched g, count) of the
  left children only, in blocks of features of a bounded size; a
  ``groupBy().sum()`` merges them, and a right child is its parent less its
  sibling; each
  (node, feature) is searched for its best bin where its bins are, and the best
  feature of each node is one more aggregate: the driver gets a row per node;
* leaf sums (leaf, label) -> (g, count) are merged the same way and gathered
  into one vector per leaf;
* raw scores ``F`` live as a column; each tree writes a new cached table and
  lineage is cut with a reliable checkpoint every ``checkpoint_every`` trees
  (a deep lineage makes every later job slower to plan, and a lost executor
  would replay all trees).

Row subsampling hashes (row key, tree), and features and projection are drawn
anew from (seed, tree), so a tree does not depend on partitioning or on where
the fit was taken up again. With ``state_dir`` every round is kept there: raw
scores, trees and counters, the last complete one; a fit that finds one goes on
from it and ends in the same model as one that was never cut.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protea.operators.score import features_matrix, sigmoid_np
from protea.session import checkpoint_root, saved, ship


@dataclass
class BoostParams:
    ntrees: int = 20
    lr: float = 0.3
    max_depth: int = 4
    lambda_l2: float = 10.0
    min_data_in_leaf: int = 10
    min_gain_to_split: float = 0.0
    subsample: float = 0.8
    colsample: float = 0.8
    max_bin: int = 64
    sketch_dim: int | None = 3   # None: split on the whole gradient
    es_rounds: int = 5           # early stopping patience (trees) on val F1
    checkpoint_every: int = 2
    rows_per_partition: int = 50_000
    seed: int = 42


@dataclass
class Tree:
    feat: np.ndarray             # (2^depth - 1,) feature per internal node, -1 = pass left
    thr: np.ndarray              # (2^depth - 1,) go left if bin <= thr
    values: np.ndarray           # (2^depth, L) leaf values (lr applied)

    def leaf_of(self, codes: np.ndarray) -> np.ndarray:
        node = np.zeros(codes.shape[0], dtype=np.int64)
        depth = int(round(math.log2(self.values.shape[0])))
        rows = np.arange(codes.shape[0])
        for _ in range(depth):
            f = self.feat[node]
            left = (f < 0) | (codes[rows, np.maximum(f, 0)] <= self.thr[node])
            node = np.where(left, 2 * node + 1, 2 * node + 2)
        return node - (2 ** depth - 1)


@dataclass
class BoostModel:
    cuts: np.ndarray             # (D, max_bin - 1) ascending cut points
    base: np.ndarray             # (L,) initial logits
    trees: list = field(default_factory=list)

    def bin(self, X: np.ndarray) -> np.ndarray:
        return bin_features(X, self.cuts)

    def raw(self, X: np.ndarray) -> np.ndarray:
        codes = self.bin(X)
        out = np.tile(self.base, (X.shape[0], 1))
        for t in self.trees:
            out += t.values[t.leaf_of(codes)]
        return out

    def predict(self, X: np.ndarray, tax=None) -> np.ndarray:
        return sigmoid_np(self.raw(X))


def bin_features(X: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    codes = np.empty(X.shape, dtype=np.int16)
    for d in range(X.shape[1]):
        codes[:, d] = np.searchsorted(cuts[d], X[:, d], side="left")
    return codes


def _mix(h: np.ndarray, t: int) -> np.ndarray:
    """Uniform [0,1) per (row hash, tree): splitmix64 finaliser in uint64."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) ^ np.uint64((t * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return (z >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _list_column(mat: np.ndarray, typ) -> pa.Array:
    """(n, d) matrix -> Arrow list<typ> column without Python objects."""
    n, d = mat.shape
    offs = pa.array(np.arange(0, (n + 1) * d, d, dtype=np.int32))
    return pa.ListArray.from_arrays(offs, pa.array(mat.ravel(), type=typ))


SUMMARY = 2048   # points of a quantile summary
MERGED = 32      # summaries that are merged at once
HELD = 1 << 21   # values that a task sorts at once


def summarise(values: np.ndarray, weights: np.ndarray, size: int = SUMMARY) -> tuple[np.ndarray, np.ndarray]:
    """At most ``size`` weighted points of sorted order for weighted values: a
    rank is off by at most an ``size``-th of the weight."""
    order = np.argsort(values, kind="stable")
    values, total = values[order], np.cumsum(weights[order])
    if len(values) <= size:
        return values, weights[order]
    at = np.searchsorted(total, total[-1] * (np.arange(1, size + 1) / size) * (1 - 1e-12))
    at = np.minimum(at, len(values) - 1)
    return values[at], np.diff(total[at], prepend=0.0)


def quantile_cuts(df: DataFrame, features: str, max_bin: int, size: int = SUMMARY) -> np.ndarray:
    """(D, max_bin-1) cut points from quantile summaries of each feature. Each
    step (within a task, then a merge of MERGED at a time) adds at most a
    ``size``-th to the error of a rank."""
    schema = "d int, part int, v array<double>, w array<double>"

    def rows(part: int, points: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(range(len(points)), pa.int32()), pa.array([part] * len(points), pa.int32()),
             pa.array([p[0] for p in points], pa.list_(pa.float64())), pa.array([p[1] for p in points], pa.list_(pa.float64()))],
            ["d", "part", "v", "w"])

    def first(batches):
        from pyspark import TaskContext
        held, n, points = [], 0, None

        def fold():
            X = np.concatenate(held).astype(np.float64)
            ones = np.ones(len(X))
            if points is None:
                return [summarise(X[:, d], ones, size) for d in range(X.shape[1])]
            return [summarise(np.concatenate([points[d][0], X[:, d]]), np.concatenate([points[d][1], ones]), size)
                    for d in range(X.shape[1])]
        for rb in batches:
            if rb.num_rows:
                held.append(features_matrix(rb.column(0)))
                n += held[-1].size
                if n >= HELD:
                    points, held, n = fold(), [], 0
        if held:
            points = fold()
        if points is not None:
            yield rows(TaskContext.get().partitionId(), points)

    def merge(batches):
        for rb in batches:
            out = []
            for vs, ws in zip(rb.column(2).to_pylist(), rb.column(3).to_pylist()):
                out.append(summarise(np.concatenate(vs), np.concatenate(ws), size))
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array([p[0] for p in out], pa.list_(pa.float64())),
                                              pa.array([p[1] for p in out], pa.list_(pa.float64()))], ["d", "part", "v", "w"])
    sketches = saved(df.select(features).mapInArrow(first, schema), "quantile-summaries")
    parts = 1 + (sketches.agg(F.max("part")).first()[0] or 0)
    while True:  # log(parts) to the base MERGED
        sketches = (sketches.groupBy("d", F.floor(F.col("part") / MERGED).cast("int").alias("part"))
                    .agg(F.collect_list(F.struct("v", "w")).alias("s")).select("d", "part", "s.v", "s.w").mapInArrow(merge, schema))
        parts = -(-parts // MERGED)
        if parts <= 1:
            break
    probs = np.arange(1, max_bin) / max_bin
    cuts = []
    for r in sorted(sketches.collect(), key=lambda r: r["d"]):  # a summary per feature: bounded by parameters
        total = np.cumsum(r["w"])
        at = np.searchsorted(total, probs * total[-1] * (1 - 1e-12))
        cuts.append(np.asarray(r["v"])[np.minimum(at, len(total) - 1)])
    return np.maximum.accumulate(np.array(cuts), axis=1)


def _labels_dense(col: pa.Array, n_labels: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    Y = np.zeros((len(col), n_labels), dtype=np.float32)
    offs = col.offsets.to_numpy()
    vals = col.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(col)), np.diff(offs))
    Y[rows, vals] = 1.0
    return Y


def fit(train: DataFrame, n_labels: int, params: BoostParams | None = None,
        features: str = "embedding", labels: str = "label_idx", key: str = "EntryID",
        val_col: str = "is_val", cuts: np.ndarray | None = None, state_dir: str | None = None) -> tuple[BoostModel, list[dict]]:
    """Train on rows with ``is_val`` false; early-stop on micro F1 (threshold
    0.5) of rows with ``is_val`` true. ``cuts``: (features, max_bin - 1) cut
    points; quantiles of the training rows by default. ``state_dir``: a folder
    that all executors share, for rounds to go on from; it belongs to one fit
    (of one table and one set of parameters). Returns (model, per-tree history)."""
    p = params or BoostParams()
    spark = train.sparkSession
    ship(spark)
    checkpoint_root(spark)
    found = load_round(spark, state_dir) if state_dir else None
    if found is None:
        state, model, n_val = _start(train, n_labels, p, features, labels, key, val_col, cuts)
        history: list[dict] = []
        best_f1, best_n, since, stop = -1.0, 0, 0, False
    else:
        state, model, history, (n_val, best_f1, best_n, since, stop) = found
    base, D = model.base, model.cuts.shape[0]
    n_nodes = 2 ** p.max_depth - 1
    k = n_labels if p.sketch_dim is None else p.sketch_dim
    for t in range(len(model.trees), p.ntrees):
        if stop:
            break
        rng = np.random.default_rng([p.seed, t])
        P = (np.eye(n_labels, dtype=np.float32) if p.sketch_dim is None
             else rng.standard_normal((n_labels, k)).astype(np.float32))
        cols = np.sort(rng.choice(D, max(1, int(round(D * p.colsample))), replace=False))
        feat = np.full(n_nodes, -1, dtype=np.int64)
        thr = np.zeros(n_nodes, dtype=np.int64)
        above = None
        for level in range(p.max_depth):
            hist = _histograms(state, t, level, feat, thr, P, cols, base, n_labels, p, labels, val_col, above)
            for node, f, b in _best_splits(hist, P.shape[1], p):
                feat[2 ** level - 1 + node], thr[2 ** level - 1 + node] = cols[f], b
            above = hist
        leaf_g, leaf_n = _leaf_sums(state, t, feat, thr, base, n_labels, p, labels, val_col)
        tree = Tree(feat, thr, -p.lr * leaf_g / (leaf_n[:, None] + p.lambda_l2))
        model.trees.append(tree)
        prev, state = state, _apply_tree(state, tree, state.schema)
        if not state_dir and (t + 1) % p.checkpoint_every == 0:
            # reliable checkpoint: a flat plan again (planning cost grows with
            # every nested pass) and recovery without replaying all trees
            state = state.checkpoint(eager=True)
        state = state.persist()
        val = _val_counts(state, base, n_labels, labels, val_col)  # materialises the new state
        stop, best_f1, best_n, since = _early_stop(history, t, val, n_val, best_f1, best_n, since, p)
        if state_dir and ((t + 1) % p.checkpoint_every == 0 or stop or t + 1 == p.ntrees):
            kept = state
            state = save_round(state_dir, t, state, model, history, (n_val, best_f1, best_n, since, stop)).persist()
            kept.unpersist()
        prev.unpersist()
    state.unpersist()
    model.trees = model.trees[:best_n] if n_val else model.trees
    return model, history


def _start(train, n_labels, p, features, labels, key, val_col, cuts) -> tuple[DataFrame, BoostModel, int]:
    """The state table before the first tree (key, row hash, binned codes,
    labels, raw scores less the base, split flag), the empty model and the
    number of validation rows."""
    # several setup passes read the training table: compute it once
    train = train.select(key, features, labels, val_col).persist()
    if cuts is None:
        cuts = quantile_cuts(train.where(~F.col(val_col)), features, p.max_bin)
    pos = train.where(~F.col(val_col)).select(F.explode(labels).alias("j")).groupBy("j").count().collect()
    sizes = train.agg(F.count_if(~F.col(val_col)).alias("n_train"),
                      F.count_if(F.col(val_col)).alias("n_val")).first()
    n_train, n_val = sizes["n_train"], sizes["n_val"]
    rate = np.full(n_labels, 0.5)
    for r in pos:
        rate[r["j"]] = r["count"] / max(n_train, 1)
    rate = np.clip(rate, 1e-4, 1 - 1e-4)

    def init(batches):
        for rb in batches:
            X = features_matrix(rb.column(features))
            codes = bin_features(X, cuts)
            Fm = np.zeros((rb.num_rows, n_labels), dtype=np.float32)
            yield pa.RecordBatch.from_arrays(
                [rb.column(key), rb.column("_h"), _list_column(codes.astype(np.int16), pa.int16()),
                 rb.column(labels), _list_column(Fm.astype(np.float32), pa.float32()), rb.column(val_col)],
                names=[key, "_h", "codes", labels, "F", val_col])

    state_schema = T.StructType([
        T.StructField(key, train.schema[key].dataType), T.StructField("_h", T.LongType()),
        T.StructField("codes", T.ArrayType(T.ShortType())), T.StructField(labels, T.ArrayType(T.IntegerType())),
        T.StructField("F", T.ArrayType(T.FloatType())), T.StructField(val_col, T.BooleanType())])
    src = train.select(key, F.xxhash64(F.col(key).cast("string"), F.lit(p.seed)).alias("_h"),
                       features, labels, val_col)
    # one partition per ``rows_per_partition`` rows, so a task's work is the
    # same whatever the size of the table
    n_parts = max(1, -(-(n_train + n_val) // p.rows_per_partition))
    state = src.repartition(n_parts).mapInArrow(init, state_schema).persist()
    state.count()
    train.unpersist()
    return state, BoostModel(cuts=cuts, base=np.log(rate / (1 - rate))), n_val


ABOUT = "n_val long, best_f1 double, best_n long, since long, stop boolean, history array<double>"


def _folder(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def save_round(state_dir: str, t: int, state: DataFrame, model: BoostModel, history: list[dict], counters: tuple) -> DataFrame:
    """Keep the state after tree ``t`` and drop older rounds; what was written
    last says that the round is complete. Returns the state as read back."""
    spark, path = state.sparkSession, f"{state_dir}/round-{t:06d}"
    state.write.mode("overwrite").parquet(f"{path}/state")
    save_model(spark, model, range(len(model.base)), f"{path}/model")
    n_val, best_f1, best_n, since, stop = counters
    spark.createDataFrame([(n_val, best_f1, best_n, since, stop, [h["val_f1"] for h in history])], ABOUT) \
        .write.mode("overwrite").parquet(f"{path}/about")
    fs, here = _folder(spark, state_dir)
    for status in fs.listStatus(here):
        old = status.getPath()
        if old.getName().startswith("round-") and old.getName() < f"round-{t:06d}":
            fs.delete(old, True)
    return spark.read.schema(state.schema).parquet(f"{path}/state")


def load_round(spark, state_dir: str):
    """State, model, history and counters of the last complete round, or None."""
    fs, here = _folder(spark, state_dir)
    if not fs.exists(here):
        return None
    names = sorted((s.getPath().getName() for s in fs.listStatus(here)), reverse=True)
    for name in names:
        path = f"{state_dir}/{name}"
        if name.startswith("round-") and fs.exists(_folder(spark, f"{path}/about/_SUCCESS")[1]):
            model, _ = load_model(spark, f"{path}/model")
            x = spark.read.schema(ABOUT).parquet(f"{path}/about").first()
            history = [{"tree": i, "val_f1": f} for i, f in enumerate(x["history"])]
            state = spark.read.parquet(f"{path}/state").persist()
            return state, model, history, (x["n_val"], x["best_f1"], x["best_n"], x["since"], x["stop"])
    return None


def _early_stop(history, tree_idx, val, n_val, best_f1, best_n, since, p):
    tp, fp, fn = val
    den = 2 * tp + fp + fn
    f1 = 2 * tp / den if den else 0.0
    history.append({"tree": tree_idx, "val_f1": f1})
    if f1 > best_f1:
        return False, f1, tree_idx + 1, 0
    since += 1
    return bool(n_val) and since >= p.es_rounds, best_f1, best_n, since


def _route(codes: np.ndarray, feat, thr, depth: int) -> np.ndarray:
    node = np.zeros(codes.shape[0], dtype=np.int64)
    rows = np.arange(codes.shape[0])
    for _ in range(depth):
        f = feat[node]
        left = (f < 0) | (codes[rows, np.maximum(f, 0)] <= thr[node])
        node = np.where(left, 2 * node + 1, 2 * node + 2)
    return node - (2 ** depth - 1)


def _batch_arrays(rb, base, n_labels, labels):
    codes_col = rb.column("codes")
    if isinstance(codes_col, pa.ChunkedArray):
        codes_col = codes_col.combine_chunks()
    codes = codes_col.flatten().to_numpy(zero_copy_only=False).reshape(rb.num_rows, -1)
    Fm = features_matrix(rb.column("F")) + base
    Y = _labels_dense(rb.column(labels), n_labels)
    return codes, Fm, Y


def _sampled(rb, t: int, subsample: float, val_col: str) -> np.ndarray:
    """The training rows of a batch that tree ``t`` sees."""
    keep = ~rb.column(val_col).to_numpy(zero_copy_only=False).astype(bool)
    h = rb.column("_h").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return keep & (_mix(h, t) < subsample)


HIST_CELLS = 1 << 18  # cells of a task's histogram buffer at a time


def _histograms(state, t, level, feat, thr, P, cols, base, n_labels, p, labels, val_col, above) -> DataFrame:
    """(node, d, b) -> summed sketched gradients and rows of a level. Rows are
    counted for left children only; ``above``, the level before, gives the rest."""
    Dc, k, B = len(cols), P.shape[1], p.max_bin
    sides = 1 if level == 0 else 2 ** (level - 1)   # nodes that are counted
    block = max(1, HIST_CELLS // (sides * B))
    names = [f"g{j}" for j in range(k)] + ["n"]

    def part(batches):
        for rb in batches:
            if rb.num_rows == 0:
                continue
            keep = _sampled(rb, t, p.subsample, val_col)
            if not keep.any():
                continue
            codes, Fm, Y = _batch_arrays(rb, base, n_labels, labels)
            node = _route(codes, feat, thr, level)
            keep &= node % 2 == 0
            codes, G = codes[keep], (sigmoid_np(Fm[keep]) - Y[keep]) @ P
            node = node[keep] // 2
            for f0 in range(0, Dc, block):
                use = cols[f0:f0 + block]
                w = len(use)
                idx = ((node[:, None] * w + np.arange(w)[None, :]) * B + codes[:, use]).ravel()
                n = np.bincount(idx, minlength=sides * w * B)
                at = np.flatnonzero(n)
                g = [np.bincount(idx, weights=np.repeat(G[:, j], w), minlength=sides * w * B)[at] for j in range(k)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(2 * (at // (w * B))), pa.array(at // B % w + f0), pa.array(at % B),
                     *(pa.array(x) for x in g), pa.array(n[at].astype(np.float64))],
                    names=["node", "d", "b", *names])

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("node", "d", "b")]
                          + [T.StructField(c, T.DoubleType()) for c in names])
    left = state.mapInArrow(part, schema).groupBy("node", "d", "b").agg(*[F.sum(c).alias(c) for c in names])
    if above is None:
        return saved(left, "boost-histogram")
    left = saved(left, "boost-histogram")
    sibling = left.select(F.floor(F.col("node") / 2).alias("up"), F.col("d").alias("d_"), F.col("b").alias("b_"),
                          *[F.col(c).alias(f"{c}_") for c in names])
    right = (above.join(sibling, (F.col("node") == F.col("up")) & (F.col("d") == F.col("d_")) & (F.col("b") == F.col("b_")), "left")
             .select((2 * F.col("node") + 1).alias("node"), "d", "b",
                     *[(F.col(c) - F.coalesce(f"{c}_", F.lit(0.0))).alias(c) for c in names]).where("n > 0"))
    return left.unionByName(right)


def _best_splits(hist: DataFrame, k: int, p: BoostParams) -> list[tuple[int, int, int]]:
    """(node, feature column, bin) for every node of the level that splits."""
    B = p.max_bin
    names = [f"g{j}" for j in range(k)] + ["n"]

    def best(batches):
        for rb in batches:
            out = []
            for node, d, bins in zip(*(c.to_pylist() for c in rb.columns)):
                h = np.zeros((B, k + 1))
                for x in bins:
                    h[x["b"]] = x["v"]
                found = _best_bin(h, p)
                if found is not None:
                    out.append((node, d, *found))
            cs = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(
                cs, (pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["node", "d", "b", "gain"])

    per = (hist.groupBy("node", "d")  # at most max_bin rows each
           .agg(F.collect_list(F.struct("b", F.array(*names).alias("v"))).alias("bins")))
    top = F.max(F.struct("gain", (-F.col("d")).alias("d"), (-F.col("b")).alias("b"))).alias("x")
    rows = (per.mapInArrow(best, "node long, d long, b long, gain double").groupBy("node").agg(top).collect())
    return [(r["node"], -r["x"]["d"], -r["x"]["b"]) for r in rows]  # a row per node at most


def _best_bin(h: np.ndarray, p: BoostParams) -> tuple[int, float] | None:
    """(bins, k + 1) histogram -> (bin, gain) of the best split, if any."""
    k = h.shape[1] - 1
    cum = np.cumsum(h, axis=0)
    tot = cum[-1]
    GL, nL = cum[:, :k], cum[:, k]
    GR, nR = tot[:k] - GL, tot[k] - nL
    lam = p.lambda_l2
    gain = ((GL ** 2).sum(-1) / (nL + lam) + (GR ** 2).sum(-1) / (nR + lam)
            - (tot[:k] ** 2).sum() / (tot[k] + lam))
    gain[(nL < p.min_data_in_leaf) | (nR < p.min_data_in_leaf)] = -np.inf
    b = int(np.argmax(gain))
    return (b, float(gain[b])) if np.isfinite(gain[b]) and gain[b] > p.min_gain_to_split else None


def _leaf_sums(state, t, feat, thr, base, n_labels, p, labels, val_col):
    depth = p.max_depth
    n_leaves = 2 ** depth

    def part(batches):
        for rb in batches:
            if rb.num_rows == 0:
                continue
            keep = _sampled(rb, t, p.subsample, val_col)
            if not keep.any():
                continue
            codes, Fm, Y = _batch_arrays(rb, base, n_labels, labels)
            leaf = _route(codes[keep], feat, thr, depth)
            G = sigmoid_np(Fm[keep]) - Y[keep]
            for x in np.unique(leaf):
                mine = leaf == x
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n_labels, x)), pa.array(np.arange(n_labels)),
                     pa.array(G[mine].sum(axis=0, dtype=np.float64)), pa.array(np.full(n_labels, float(mine.sum())))],
                    names=["leaf", "label", "g", "n"])

    rows = (state.mapInArrow(part, "leaf long, label long, g double, n double").groupBy("leaf", "label")
            .agg(F.sum("g").alias("g"), F.sum("n").alias("n"))
            .groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("label", "g"))).alias("gs"), F.max("n").alias("n"))
            .select("leaf", F.col("gs.g").alias("g"), "n").collect())  # a vector per leaf
    G = np.zeros((n_leaves, n_labels))
    N = np.zeros(n_leaves)
    for r in rows:
        G[r["leaf"]] = r["g"]
        N[r["leaf"]] = r["n"]
    return G, N


def _apply_tree(state: DataFrame, tree: Tree, schema) -> DataFrame:
    def part(batches):
        for rb in batches:
            if rb.num_rows == 0:
                continue
            codes_col = rb.column("codes")
            codes = codes_col.flatten().to_numpy(zero_copy_only=False).reshape(rb.num_rows, -1)
            Fm = features_matrix(rb.column("F")) + tree.values[tree.leaf_of(codes)]
            cols = [rb.column(i) for i in range(rb.num_columns)]
            fi = rb.schema.get_field_index("F")
            cols[fi] = _list_column(Fm.astype(np.float32), pa.float32())
            yield pa.RecordBatch.from_arrays(cols, schema=rb.schema)
    return state.mapInArrow(part, schema)


def _val_counts(state: DataFrame, base, n_labels: int, labels: str, val_col: str) -> tuple[int, int, int]:
    def part(batches):
        tp = fp = fn = 0
        for rb in batches:
            m = rb.column(val_col).to_numpy(zero_copy_only=False).astype(bool)
            if not m.any():
                continue
            _, Fm, Y = _batch_arrays(rb, base, n_labels, labels)
            pred = sigmoid_np(Fm[m]).astype(np.float32) > np.float32(0.5)
            y = Y[m] > 0
            tp += int((pred & y).sum()); fp += int((pred & ~y).sum()); fn += int((~pred & y).sum())
        yield pa.RecordBatch.from_arrays([pa.array([tp]), pa.array([fp]), pa.array([fn])],
                                         names=["tp", "fp", "fn"])
    r = state.mapInArrow(part, "tp long, fp long, fn long").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).first()
    return (r["tp"] or 0), (r["fp"] or 0), (r["fn"] or 0)


MODEL = "kind string, tree int, node int, feature int, bin int, term string, values array<double>"


def model_table(spark, model: BoostModel, terms) -> DataFrame:
    """A model as rows (K5): cut points, base logits, terms, splits, leaves."""
    rows = [("cuts", None, d, None, None, None, [float(x) for x in c]) for d, c in enumerate(model.cuts)]
    rows += [("base", None, j, None, None, str(t), [float(model.base[j])]) for j, t in enumerate(terms)]
    for ti, t in enumerate(model.trees):
        rows += [("split", ti, i, int(f), int(b), None, None) for i, (f, b) in enumerate(zip(t.feat, t.thr))]
        rows += [("leaf", ti, i, None, None, None, [float(x) for x in v]) for i, v in enumerate(t.values)]
    return spark.createDataFrame(rows, MODEL)


def save_model(spark, model: BoostModel, terms, path: str) -> None:
    model_table(spark, model, terms).write.mode("overwrite").parquet(path)


def load_model(spark, path: str) -> tuple[BoostModel, list[str]]:
    """The model and its terms, as ``save_model`` wrote them."""
    rows = spark.read.schema(MODEL).parquet(path).collect()  # one model's worth
    by = {k: sorted((r for r in rows if r["kind"] == k), key=lambda r: (r["tree"] or 0, r["node"]))
          for k in ("cuts", "base", "split", "leaf")}
    model = BoostModel(np.array([r["values"] for r in by["cuts"]]), np.array([r["values"][0] for r in by["base"]]))
    for t in range(1 + max((r["tree"] for r in by["leaf"]), default=-1)):
        splits = [r for r in by["split"] if r["tree"] == t]
        model.trees.append(Tree(np.array([r["feature"] for r in splits], dtype=np.int64),
                                np.array([r["bin"] for r in splits], dtype=np.int64),
                                np.array([r["values"] for r in by["leaf"] if r["tree"] == t])))
    return model, [r["term"] for r in by["base"]]
