"""Two-branch MLP (taxonomy embedding branch + sequence vector), trained on
Spark by local SGD with weight averaging.

Network: tax_idx -> Embedding(n_tax, td) -> Linear(td, td) -> ReLU, concat
with the sequence vector -> [Linear -> BatchNorm -> ReLU -> Dropout] x 2
(h, h/2) -> Linear -> one logit per label. Loss: BCE-with-logits (mean).
Optimiser: AdamW; ReduceLROnPlateau (factor 0.5, patience 2, floor 1e-6) and
early stopping on validation micro F1; the best epoch's weights are kept.
``loss="focal"`` trains with the focal loss instead (gamma, optional alpha).

One Spark job per epoch: the training table is hash-partitioned by key and
sorted inside partitions (so the layout, and therefore the result, is
reproducible); each partition starts from the broadcast weights, scores its
validation rows with them, runs its shuffled mini-batches, and emits its
weights in fixed-size slices; a grouped weighted mean (weights = rows seen)
merges the slices, so the driver only ever receives one model's worth of
numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protea.operators.score import features_matrix, sigmoid_np

SLICE = 65536
BN_EPS = 1e-5
BN_MOMENTUM = 0.1


@dataclass
class MLPParams:
    hidden: int = 64
    tax_dim: int = 8
    dropout: float = 0.1
    lr: float = 1e-3
    weight_decay: float = 0.01
    batch_size: int = 64
    epochs: int = 10
    patience: int = 2
    lr_patience: int = 2
    min_lr: float = 1e-6
    rows_per_partition: int = 20_000
    loss: str = "bce"            # or "focal": alpha * (1 - pt)^gamma * bce
    gamma: float = 2.0
    alpha: float | None = None
    seed: int = 42


def init_params(D: int, n_tax: int, L: int, p: MLPParams) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    h, h2, td = p.hidden, p.hidden // 2, p.tax_dim

    def lin(i, o):
        b = 1.0 / np.sqrt(i)
        return rng.uniform(-b, b, (i, o)).astype(np.float32), rng.uniform(-b, b, o).astype(np.float32)

    P = {"E": rng.standard_normal((n_tax, td)).astype(np.float32)}
    P["Wt"], P["bt"] = lin(td, td)
    P["W1"], P["b1"] = lin(D + td, h)
    P["W2"], P["b2"] = lin(h, h2)
    P["W3"], P["b3"] = lin(h2, L)
    for i, n in ((1, h), (2, h2)):
        P[f"g{i}"], P[f"be{i}"] = np.ones(n, np.float32), np.zeros(n, np.float32)
        P[f"rm{i}"], P[f"rv{i}"] = np.zeros(n, np.float32), np.ones(n, np.float32)
    return P


TRAINABLE = ("E", "Wt", "bt", "W1", "b1", "W2", "b2", "W3", "b3", "g1", "be1", "g2", "be2")


def forward(P, X, tax, train: bool, rng=None, dropout: float = 0.0):
    cache = {}
    te = P["E"][tax]
    tz = te @ P["Wt"] + P["bt"]
    tf = np.maximum(tz, 0)
    a0 = np.concatenate([X, tf], axis=1)
    h = a0
    for i, W, b in ((1, "W1", "b1"), (2, "W2", "b2")):
        z = h @ P[W] + P[b]
        if train:
            mu, var = z.mean(0), z.var(0)
            n = z.shape[0]
            P[f"rm{i}"] = (1 - BN_MOMENTUM) * P[f"rm{i}"] + BN_MOMENTUM * mu
            P[f"rv{i}"] = (1 - BN_MOMENTUM) * P[f"rv{i}"] + BN_MOMENTUM * var * n / max(n - 1, 1)
        else:
            mu, var = P[f"rm{i}"], P[f"rv{i}"]
        inv = 1.0 / np.sqrt(var + BN_EPS)
        zh = (z - mu) * inv
        y = zh * P[f"g{i}"] + P[f"be{i}"]
        r = np.maximum(y, 0)
        if train and dropout > 0:
            m = (rng.random(r.shape) >= dropout).astype(np.float32) / (1 - dropout)
        else:
            m = None
        out = r * m if m is not None else r
        cache[i] = (h, z, zh, inv, y, m)
        h = out
    logits = h @ P["W3"] + P["b3"]
    cache.update(te=te, tz=tz, a0=a0, h2=h)
    return logits, cache


def loss_grad(logits, Y, loss: str = "bce", gamma: float = 2.0, alpha: float | None = None):
    """d(mean loss)/d(logit) per cell. Focal: with pt = exp(-bce),
    d/dx [a (1-pt)^g bce] = a (p-y) (1-pt)^(g-1) [g pt bce + (1-pt)]."""
    n, L = logits.shape
    p = sigmoid_np(logits)
    if loss == "bce":
        return (p - Y) / (n * L)
    if loss != "focal":
        raise ValueError("loss must be 'bce' or 'focal'")
    bce = np.maximum(logits, 0) - logits * Y + np.log1p(np.exp(-np.abs(logits)))
    pt = np.exp(-bce)
    d = (p - Y) * (1 - pt) ** (gamma - 1) * (gamma * pt * bce + (1 - pt))
    return (1.0 if alpha is None else alpha) * d / (n * L)


def backward(P, cache, logits, Y, tax, loss: str = "bce", gamma: float = 2.0, alpha: float | None = None):
    d = loss_grad(logits, Y, loss, gamma, alpha)
    g = {"W3": cache["h2"].T @ d, "b3": d.sum(0)}
    dh = d @ P["W3"].T
    for i, W, b in ((2, "W2", "b2"), (1, "W1", "b1")):
        hin, z, zh, inv, y, m = cache[i]
        if m is not None:
            dh = dh * m
        dy = dh * (y > 0)
        g[f"g{i}"] = (dy * zh).sum(0)
        g[f"be{i}"] = dy.sum(0)
        dzh = dy * P[f"g{i}"]
        nb = z.shape[0]
        dz = inv / nb * (nb * dzh - dzh.sum(0) - zh * (dzh * zh).sum(0))
        g[W] = hin.T @ dz
        g[b] = dz.sum(0)
        dh = dz @ P[W].T
    D = P["W1"].shape[0] - P["Wt"].shape[0]
    dtf = dh[:, D:] * (cache["tz"] > 0)
    g["Wt"] = cache["te"].T @ dtf
    g["bt"] = dtf.sum(0)
    dte = dtf @ P["Wt"].T
    gE = np.zeros_like(P["E"])
    np.add.at(gE, tax, dte)
    g["E"] = gE
    return g


def predict_params(P, X, tax):
    logits, _ = forward(P, X, tax, train=False)
    return sigmoid_np(logits)


@dataclass
class MLPModel:
    params: dict

    def predict(self, X: np.ndarray, tax: np.ndarray | None = None) -> np.ndarray:
        t = np.zeros(X.shape[0], dtype=np.int64) if tax is None else np.asarray(tax, dtype=np.int64)
        t = np.clip(t, 0, self.params["E"].shape[0] - 1)
        return predict_params(self.params, X.astype(np.float32), t)


def _flatten(P, keys):
    return np.concatenate([P[k].ravel().astype(np.float64) for k in keys])


def _unflatten(v, like, keys):
    out, o = {}, 0
    for k in keys:
        n = like[k].size
        out[k] = v[o:o + n].reshape(like[k].shape).astype(np.float32)
        o += n
    return out


def _dense_labels(col, L):
    from protea.operators.boost import _labels_dense
    return _labels_dense(col, L)


def fit(train: DataFrame, n_labels: int, n_tax: int, params: MLPParams | None = None,
        features: str = "embedding", labels: str = "label_idx", tax_col: str = "taxonomy_idx",
        key: str = "EntryID", val_col: str = "is_val") -> tuple[MLPModel, list[dict]]:
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    from protea.session import ship
    p = params or MLPParams()
    spark = train.sparkSession
    ship(spark)
    sc = spark.sparkContext
    train = train.select(key, features, labels, tax_col, val_col).persist()
    D = len(train.select(features).first()[0])
    P = init_params(D, max(n_tax, 1), n_labels, p)
    state_keys = list(P.keys())
    adam_m = {k: np.zeros_like(P[k]) for k in TRAINABLE}
    adam_v = {k: np.zeros_like(P[k]) for k in TRAINABLE}
    step = 0
    # one key-partitioned table holds train and validation rows: each epoch's
    # job trains on its train rows and scores its validation rows with the
    # incoming weights, so validation costs no extra job per epoch
    n_parts = max(1, -(-train.count() // p.rows_per_partition))
    data = (train.select(key, features, tax_col, labels, val_col)
            .repartition(n_parts, key).sortWithinPartitions(key).persist())
    lr, best, best_P, since, since_lr = p.lr, -1.0, None, 0, 0
    history = []
    all_keys = state_keys + [f"m_{k}" for k in TRAINABLE] + [f"v_{k}" for k in TRAINABLE]

    def record(epoch_idx, counts, params):
        nonlocal lr, best, best_P, since, since_lr
        tp, fp, fn = counts
        den = 2 * tp + fp + fn
        f1 = 2 * tp / den if den else 0.0
        history.append({"epoch": epoch_idx, "val_f1": f1, "lr": lr})
        if f1 > best:
            best, best_P, since, since_lr = f1, {k: v.copy() for k, v in params.items()}, 0, 0
            return False
        since += 1
        since_lr += 1
        if since_lr > p.lr_patience:
            lr, since_lr = max(lr * 0.5, p.min_lr), 0
        return since >= p.patience

    stopped = False
    for epoch in range(p.epochs):
        full = dict(P, **{f"m_{k}": adam_m[k] for k in TRAINABLE}, **{f"v_{k}": adam_v[k] for k in TRAINABLE})
        bc = sc.broadcast((full, step, lr))

        def run(batches, _bc=bc, _epoch=epoch):
            import pyspark
            pid = pyspark.TaskContext.get().partitionId()
            S, st, lr_ = _bc.value
            P0 = {k: S[k] for k in state_keys}
            Pl = {k: S[k].copy() for k in state_keys}
            m = {k: S[f"m_{k}"].copy() for k in TRAINABLE}
            v = {k: S[f"v_{k}"].copy() for k in TRAINABLE}
            rng = np.random.default_rng([p.seed, _epoch, pid])
            b1, b2, eps = 0.9, 0.999, 1e-8
            nrow = 0.0
            vc = np.zeros(3, dtype=np.int64)
            # stream Arrow batches (bounded memory); shuffle inside each batch
            for rb in batches:
                if rb.num_rows == 0:
                    continue
                Xa = features_matrix(rb.column(features))
                Ta = rb.column(tax_col).to_numpy(zero_copy_only=False).astype(np.int64)
                Ya = _dense_labels(rb.column(labels), n_labels)
                isv = rb.column(val_col).to_numpy(zero_copy_only=False).astype(bool)
                if isv.any():
                    pr = predict_params(P0, Xa[isv], Ta[isv]).astype(np.float32) > np.float32(0.5)
                    yv = Ya[isv] > 0
                    vc += [(pr & yv).sum(), (pr & ~yv).sum(), (~pr & yv).sum()]
                X, T_, Y = Xa[~isv], Ta[~isv], Ya[~isv]
                nrow += X.shape[0]
                order = rng.permutation(X.shape[0])
                for s in range(0, len(order), p.batch_size):
                    idx = order[s:s + p.batch_size]
                    if len(idx) < 2:
                        continue
                    logits, cache = forward(Pl, X[idx], T_[idx], True, rng, p.dropout)
                    g = backward(Pl, cache, logits, Y[idx], T_[idx], p.loss, p.gamma, p.alpha)
                    st += 1
                    for k in TRAINABLE:
                        Pl[k] *= (1 - lr_ * p.weight_decay)
                        m[k] = b1 * m[k] + (1 - b1) * g[k]
                        v[k] = b2 * v[k] + (1 - b2) * g[k] ** 2
                        mh, vh = m[k] / (1 - b1 ** st), v[k] / (1 - b2 ** st)
                        Pl[k] -= (lr_ * mh / (np.sqrt(vh) + eps)).astype(np.float32)
            out = dict(Pl, **{f"m_{k}": m[k] for k in TRAINABLE}, **{f"v_{k}": v[k] for k in TRAINABLE})
            flat = _flatten(out, all_keys)
            sl = list(range(0, flat.size, SLICE))
            zero = [0] * (len(sl) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(sl), dtype=np.int64)),
                 pa.array([flat[o:o + SLICE] for o in sl], type=pa.list_(pa.float64())),
                 pa.array([max(nrow, 1e-9)] * len(sl)), pa.array([float(st)] * len(sl)),
                 pa.array([int(vc[0])] + zero, type=pa.int64()), pa.array([int(vc[1])] + zero, type=pa.int64()),
                 pa.array([int(vc[2])] + zero, type=pa.int64())],
                names=["slice", "w", "n", "steps", "tp", "fp", "fn"])

        parts = data.mapInArrow(
            run, "slice long, w array<double>, n double, steps double, tp long, fp long, fn long")
        merged = (parts.groupBy("slice")
                  .agg(Summarizer.mean(array_to_vector("w"), F.col("n")).alias("w"), F.max("steps").alias("steps"),
                       F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
                  .select("slice", vector_to_array("w").alias("w"), "steps", "tp", "fp", "fn")
                  .orderBy("slice").collect())  # one model's worth of numbers
        bc.unpersist()
        if epoch > 0:  # validation of the weights this epoch started from
            counts = (merged[0]["tp"], merged[0]["fp"], merged[0]["fn"])
            if record(epoch - 1, counts, P):
                stopped = True
                break
        flat = np.concatenate([np.asarray(r["w"]) for r in merged])
        step = int(merged[0]["steps"])
        full_like = dict(P, **{f"m_{k}": adam_m[k] for k in TRAINABLE}, **{f"v_{k}": adam_v[k] for k in TRAINABLE})
        new = _unflatten(flat, full_like, all_keys)
        P = {k: new[k] for k in state_keys}
        adam_m = {k: new[f"m_{k}"] for k in TRAINABLE}
        adam_v = {k: new[f"v_{k}"] for k in TRAINABLE}
    if not stopped:
        va = data.where(F.col(val_col))
        record(p.epochs - 1, _val_counts(va, P, n_labels, features, tax_col, labels), P)
    data.unpersist()
    train.unpersist()
    return MLPModel(best_P if best_P is not None else P), history


def _val_counts(va: DataFrame, P, n_labels, features, tax_col, labels) -> tuple[int, int, int]:
    model = MLPModel(P)

    def part(batches):
        tp = fp = fn = 0
        for rb in batches:
            if rb.num_rows == 0:
                continue
            X = features_matrix(rb.column(features))
            t = rb.column(tax_col).to_numpy(zero_copy_only=False)
            Y = _dense_labels(rb.column(labels), n_labels) > 0
            pr = model.predict(X, t).astype(np.float32) > np.float32(0.5)
            tp += int((pr & Y).sum()); fp += int((pr & ~Y).sum()); fn += int((~pr & Y).sum())
        yield pa.RecordBatch.from_arrays([pa.array([tp]), pa.array([fp]), pa.array([fn])],
                                         names=["tp", "fp", "fn"])

    r = va.mapInArrow(part, "tp long, fp long, fn long").agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn")).first()
    return (r["tp"] or 0), (r["fp"] or 0), (r["fn"] or 0)


def model_table(spark, model: MLPModel) -> DataFrame:
    """Persist a model as rows (K5): one row per parameter tensor."""
    rows = [(k, list(v.shape), [float(x) for x in v.ravel()]) for k, v in model.params.items()]
    return spark.createDataFrame(rows, "name string, shape array<int>, values array<double>")


def load_model(df: DataFrame) -> MLPModel:
    """The model whose ``model_table`` was saved as ``df``."""
    return MLPModel({r["name"]: np.array(r["values"], dtype=np.float32).reshape(r["shape"]) for r in df.collect()})
