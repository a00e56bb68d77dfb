"""Trainers and scoring: learnability, determinism, gradients, in-batch melt."""

import numpy as np
import pytest

from paths import SF_ORACLE
from protea.operators import boost, mlp, score
from protea.plans import training_q


@pytest.fixture(scope="module")
def table(spark):
    t, terms, tv = training_q.training_table(spark, SF_ORACLE, 8)
    return t.persist(), terms, tv


def _majority_f1(t, n_labels):
    rows = t.where("is_val").select("label_idx").collect()
    pos = sum(len(r[0]) for r in rows)
    cells = len(rows) * n_labels
    # best constant predictor in micro F1: predict everything positive
    return 2 * pos / (2 * pos + (cells - pos))


def test_boosting_learns_and_is_deterministic(spark, table):
    t, terms, _ = table
    p = boost.BoostParams(ntrees=4, max_depth=3, lr=0.5, max_bin=32)
    m1, h1 = boost.fit(t, len(terms), p)
    assert h1[-1]["val_f1"] > _majority_f1(t, len(terms))
    assert h1[-1]["val_f1"] > h1[0]["val_f1"]
    m2, h2 = boost.fit(t.repartition(3), len(terms), p)
    assert [x["val_f1"] for x in h1] == [x["val_f1"] for x in h2]
    X = np.random.default_rng(0).standard_normal((5, 64)).astype(np.float32)
    assert np.allclose(m1.predict(X), m2.predict(X))


def test_mlp_gradients_match_finite_differences():
    p = mlp.MLPParams(hidden=6, tax_dim=3, dropout=0.0)
    P = {k: v.astype(np.float64) for k, v in mlp.init_params(5, 4, 3, p).items()}
    rng = np.random.default_rng(0)
    X, tax = rng.standard_normal((7, 5)), rng.integers(0, 4, 7)
    Y = (rng.random((7, 3)) > 0.5).astype(float)

    def loss(Q):
        lg, _ = mlp.forward(dict(Q), X, tax, True)
        return np.mean(np.maximum(lg, 0) - lg * Y + np.log1p(np.exp(-np.abs(lg))))

    lg, c = mlp.forward(dict(P), X, tax, True)
    g = mlp.backward(P, c, lg, Y, tax)
    for k in ("W1", "W3", "Wt", "E", "g1", "be2"):
        num = np.zeros_like(P[k])
        for i in np.ndindex(P[k].shape):
            o = P[k][i]
            P[k][i] = o + 1e-6
            a = loss(P)
            P[k][i] = o - 1e-6
            b = loss(P)
            P[k][i] = o
            num[i] = (a - b) / 2e-6
        assert np.allclose(num, g[k], atol=1e-6), k


def test_mlp_learns(spark, table):
    t, terms, tv = table
    model, hist = mlp.fit(t, len(terms), tv.count() + 1,
                          mlp.MLPParams(epochs=8, hidden=32, rows_per_partition=250, lr=1e-2, patience=8, batch_size=32))
    assert max(h["val_f1"] for h in hist) > _majority_f1(t, len(terms))


def test_score_melts_and_thresholds_in_batch(spark):
    df = spark.createDataFrame([("a", [0.0, 10.0]), ("b", [-10.0, 0.0])], "EntryID string, embedding array<float>")
    m = score.LinearModel(np.eye(2), np.zeros(2))
    got = {(r["EntryID"], r["term"]): r["score"] for r in score.score(df, [m], ["x", "y"], 0.01).collect()}
    assert set(got) == {("a", "x"), ("a", "y"), ("b", "y")}
    assert got[("a", "x")] == pytest.approx(0.5)
    # two models averaged
    m2 = score.LinearModel(np.zeros((2, 2)), np.zeros(2))
    got2 = {(r["EntryID"], r["term"]): r["score"] for r in score.score(df, [m, m2], ["x", "y"], None).collect()}
    assert got2[("a", "y")] == pytest.approx((1 / (1 + np.exp(-10)) + 0.5) / 2, rel=1e-6)


@pytest.mark.parametrize("alpha", [None, 0.25])
def test_focal_loss_gradient(alpha):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((5, 3)) * 3
    y = (rng.random((5, 3)) > 0.5).astype(float)

    def fl(z):
        b = np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))
        return ((1.0 if alpha is None else alpha) * (1 - np.exp(-b)) ** 2 * b).mean()

    g = mlp.loss_grad(x, y, "focal", 2.0, alpha)
    num = np.zeros_like(x)
    for i in np.ndindex(x.shape):
        e = np.zeros_like(x)
        e[i] = 1e-6
        num[i] = (fl(x + e) - fl(x - e)) / 2e-6
    assert np.allclose(num, g, atol=1e-8)


def test_score_skips_missing_features(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], "EntryID string, embedding array<float>")
    m = score.LinearModel(np.eye(2), np.zeros(2))
    assert {r["EntryID"] for r in score.score(df, [m], ["x", "y"], None).collect()} == {"a"}


def test_boosting_driver_gets_a_row_per_node(spark, monkeypatch):
    """256 bins x 1,000 features: what is collected per level is a row per node."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 1000)).astype(np.float32)
    rows = [(i, x[i].tolist(), [j for j in range(3) if x[i, j] > 0], i % 5 == 0) for i in range(400)]
    t = spark.createDataFrame(rows, "EntryID int, embedding array<float>, label_idx array<int>, is_val boolean")
    seen = []
    real = boost._best_splits
    monkeypatch.setattr(boost, "_best_splits", lambda *a: seen.append(real(*a)) or seen[-1])
    p = boost.BoostParams(ntrees=2, max_depth=2, lr=0.5, max_bin=256, min_data_in_leaf=5, subsample=1.0)
    model, hist = boost.fit(t, 3, p)
    assert [len(s) <= 2 ** (i % 2) for i, s in enumerate(seen)] == [True] * 4
    assert {int(f) for tree in model.trees for f in tree.feat} & {0, 1, 2}


def numpy_twin(rows, n_labels, p, cuts):
    """The same training, dense and in one place. rows: (hash, x, labels, is_val)."""
    h = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    X = np.array([r[1] for r in rows], np.float64)
    Y = np.zeros((len(rows), n_labels))
    for i, r in enumerate(rows):
        Y[i, r[2]] = 1
    val = np.array([r[3] for r in rows])
    codes = np.stack([np.searchsorted(cuts[d], X[:, d], side="left") for d in range(X.shape[1])], 1)
    rate = np.clip(Y[~val].mean(axis=0), 1e-4, 1 - 1e-4)
    base = np.log(rate / (1 - rate))
    raw = np.zeros(Y.shape, np.float32)
    history, best, since, scores = [], (-1.0, None), 0, None
    for t in range(p.ntrees):
        rng = np.random.default_rng([p.seed, t])
        P = rng.standard_normal((n_labels, p.sketch_dim)).astype(np.float32)
        cols = np.sort(rng.choice(X.shape[1], max(1, int(round(X.shape[1] * p.colsample))), replace=False))
        use = ~val & (boost._mix(h, t) < p.subsample)
        G = 1 / (1 + np.exp(-(raw + base))) - Y
        S = G @ P
        leaf = np.zeros(len(rows), int)
        for _ in range(p.max_depth):
            new = np.zeros_like(leaf)
            for node in np.unique(leaf):
                mine = use & (leaf == node)
                found = (p.min_gain_to_split, None)
                total, n = S[mine].sum(axis=0), mine.sum()
                for d in cols:
                    for b in range(p.max_bin):
                        left = mine & (codes[:, d] <= b)
                        nl = left.sum()
                        if nl < p.min_data_in_leaf or n - nl < p.min_data_in_leaf:
                            continue
                        g = S[left].sum(axis=0)
                        gain = ((g ** 2).sum() / (nl + p.lambda_l2) + ((total - g) ** 2).sum() / (n - nl + p.lambda_l2)
                                - (total ** 2).sum() / (n + p.lambda_l2))
                        if gain > found[0] + 1e-9:
                            found = (gain, (d, b))
                here = leaf == node
                new[here] = 2 * node
                if found[1]:
                    new[here & (codes[:, found[1][0]] > found[1][1])] = 2 * node + 1
            leaf = new
        for x in np.unique(leaf):
            mine = use & (leaf == x)
            raw[leaf == x] = raw[leaf == x] + -p.lr * G[mine].sum(axis=0) / (mine.sum() + p.lambda_l2)
        out = 1 / (1 + np.exp(-(raw + base)))
        pred, y = out[val] > 0.5, Y[val] > 0
        f1 = 2 * (pred & y).sum() / max(1, 2 * (pred & y).sum() + (pred ^ y).sum())
        history.append(f1)
        if f1 > best[0] or not val.any():
            best, since, scores = (f1, t), 0, out
        else:
            since += 1
            if since >= p.es_rounds:
                break
    return history, scores


SMALL = boost.BoostParams(ntrees=6, max_depth=3, lr=1.5, lambda_l2=1.0, max_bin=12, sketch_dim=2, subsample=0.7, colsample=0.6, es_rounds=6,
                          checkpoint_every=1)


@pytest.fixture(scope="module")
def small(spark):
    """Rows of the driver's embeddings, with the labels that are in them."""
    from pyspark.sql import functions as F
    t, _, _ = training_q.training_table(spark, SF_ORACLE, 6)
    # no validation rows: every tree stays
    t = t.withColumn("embedding", F.slice("embedding", 1, 12)).withColumn("is_val", F.lit(False)).persist()
    rows = [(r.h, r.embedding, r.label_idx, r.is_val) for r in
            t.withColumn("h", F.xxhash64(F.col("EntryID").cast("string"), F.lit(SMALL.seed))).collect()]
    return t, rows


def test_boosting_equals_a_numpy_twin(spark, small):
    t, rows = small
    model, history = boost.fit(t, 6, SMALL)
    want, scores = numpy_twin(rows, 6, SMALL, model.cuts)
    assert np.allclose([x["val_f1"] for x in history], want, atol=1e-6)
    got = model.predict(np.array([r[1] for r in rows], np.float32))
    assert np.abs(got - scores).max() < 1e-6
    assert len(model.trees) == 6 and {len(x.feat) for x in model.trees} == {7}


def test_forest_query_equals_the_twin(spark):
    from pyspark.sql import functions as F
    sf = "/root/testdata/sf0.001"
    t, terms, _ = training_q.training_table(spark, sf, method="lcg")
    p = boost.BoostParams(**{**training_q.FOREST, "ntrees": 3, "max_bin": 8})
    model, history = boost.fit(t, len(terms), p)
    rows = [(r.h, r.embedding, r.label_idx, r.is_val) for r in
            t.withColumn("h", F.xxhash64(F.col("EntryID").cast("string"), F.lit(p.seed))).collect()]
    want, scores = numpy_twin(rows, len(terms), p, model.cuts)
    assert np.allclose([x["val_f1"] for x in history], want, atol=1e-6)
    assert np.abs(model.predict(np.array([r[1] for r in rows], np.float32)) - scores).max() < 1e-6


def test_early_stopping(spark, small):
    t, _ = small
    # nothing can be split: the first tree is as good as any other
    from pyspark.sql import functions as F
    p = boost.BoostParams(ntrees=9, max_depth=1, max_bin=4, min_data_in_leaf=10 ** 6, es_rounds=2, lr=1e-9)
    model, history = boost.fit(t.withColumn("is_val", F.col("EntryID") % 3 == 0), 6, p)
    assert len(history) == 3 and len(model.trees) == 1


@pytest.mark.parametrize("cut", [1, 4])
def test_a_fit_goes_on_from_its_last_round(spark, small, tmpdir_path, cut):
    import dataclasses
    import os
    t, _ = small
    whole, history = boost.fit(t, 6, SMALL)
    path = f"{tmpdir_path}/rounds"
    boost.fit(t, 6, dataclasses.replace(SMALL, ntrees=cut), state_dir=path)
    os.makedirs(f"{path}/round-000099/state")  # a round that was not finished
    resumed, again = boost.fit(t.where("false"), 6, SMALL, state_dir=path)  # the table is not needed any more
    assert again == history and len(resumed.trees) == len(whole.trees)
    X = np.random.default_rng(1).standard_normal((50, 12)).astype(np.float32)
    assert (resumed.predict(X) == whole.predict(X)).all()


def test_quantile_summaries(spark):
    rng = np.random.default_rng(2)
    x = np.stack([rng.standard_normal(30_000), rng.exponential(size=30_000), np.round(rng.standard_normal(30_000)), np.arange(30_000.0)], 1)
    df = spark.createDataFrame([(r.tolist(),) for r in x], "embedding array<float>").repartition(70)
    size = 256
    cuts = boost.quantile_cuts(df, "embedding", 16, size)
    assert cuts.shape == (4, 15)
    for d in range(4):
        col = np.sort(x[:, d].astype(np.float32))
        for i, c in enumerate(cuts[d]):
            lo, hi = np.searchsorted(col, c, "left") / len(col), np.searchsorted(col, c, "right") / len(col)
            want = (i + 1) / 16
            assert lo - 4 / size <= want <= hi + 4 / size, (d, i, lo, hi)  # within a task, then two merges
    assert np.array_equal(cuts, boost.quantile_cuts(df, "embedding", 16, size))


def test_boosted_model_survives_saving(spark, table, tmpdir_path):
    t, terms, _ = table
    m, _ = boost.fit(t, len(terms), boost.BoostParams(ntrees=2, max_depth=2, lr=0.5, max_bin=16))
    boost.save_model(spark, m, terms, tmpdir_path + "/m")
    back, names = boost.load_model(spark, tmpdir_path + "/m")
    X = np.random.default_rng(0).standard_normal((20, 64)).astype(np.float32)
    assert names == list(terms) and (back.predict(X) == m.predict(X)).all()


def test_mlp_model_survives_saving(spark):
    P = mlp.init_params(5, 4, 3, mlp.MLPParams(hidden=6, tax_dim=3))
    m = mlp.MLPModel(P)
    back = mlp.load_model(mlp.model_table(spark, m))
    X, tax = np.random.default_rng(0).standard_normal((7, 5)).astype(np.float32), np.arange(7) % 4
    assert np.allclose(back.predict(X, tax), m.predict(X, tax))
