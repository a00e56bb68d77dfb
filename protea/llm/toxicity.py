"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (label 1) are the positives; every other text of the
training fold is unlabelled, whatever its label says. With the class prior
``p`` the risk of a scorer ``f`` is

    p * E_pos[loss(f, +)] + max(0, E_unl[loss(f, -)] - p * E_pos[loss(f, -)])

(the bracket is clamped at zero, so that a flexible model cannot drive it
negative by memorising the positives; where it is negative, the step ascends
it). Labels are learnt only from rows outside the held-out fold.

Features are saturating rates: the share of the text's words that are a given
word, or begin with a given prefix of 4 to 6 letters, times ``PER``, at most 1.
They do not grow with the length of a text; ``SMOOTH`` words that are nothing
are added to each, so that one word of a short text says less than a habit of
a long one. Which features exist is decided from counts: a feature must be
active (half of full strength or more) in a share
``min_share`` of the positives, which bounds the candidates by texts' lengths
and not by the size of the corpus, and the ``n_features`` with the highest
likelihood ratio between *all* positives and *all* training texts are kept. Of
the confirmed toxic rows at most ``max_positive`` are fitted, picked by hash.

Cases: a null or empty text has no features and gets the score of the bias;
with no confirmed toxic row in the training fold, or too few texts to choose a
feature, every score is 0.0; repeated
label rows of a document count once, and any 1 among them makes it positive;
a null doc_id has no label and is not held out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protea.llm.common import saved, ship, text_of

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
PER, SMOOTH = 150.0, 50
ACTIVE = 0.5
DEFAULTS = dict(n_features=512, min_share=0.01, n_models=4, max_positive=8_000,
                max_unlabelled=24_000, l2=2e-5, steps=400, rate=0.1)


def word_features(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in PREFIXES if len(word) >= n)]


def features(text: str | None) -> dict[str, float]:
    """Feature -> saturating rate."""
    counts = Counter(WORD.findall((text or "").lower()))
    scale = PER / (sum(counts.values()) + SMOOTH)
    found: Counter = Counter()
    for word, n in counts.items():
        for f in word_features(word):
            found[f] += n
    return {k: min(1.0, scale * n) for k, n in found.items()}


class Known:
    """The rates of given features only; what a word has of them is remembered
    for the last so many words."""

    LIMIT = 20_000

    def __init__(self, index: dict[str, int]):
        self.index, self.seen = index, {}

    def rates(self, text: str | None) -> dict[int, float]:
        counts = Counter(WORD.findall((text or "").lower()))
        seen, index, found = self.seen, self.index, {}
        for word, n in counts.items():
            ids = seen.get(word)
            if ids is None:
                if len(seen) >= self.LIMIT:
                    seen.clear()
                ids = seen[word] = tuple(index[f] for f in word_features(word) if f in index)
            for i in ids:
                found[i] = found.get(i, 0) + n
        scale = PER / (sum(counts.values()) + SMOOTH)
        return {i: min(1.0, scale * n) for i, n in found.items()}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def train_nnpu(xp: np.ndarray, xu: np.ndarray, prior: float, l2: float = 2e-5,
               steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """A linear scorer under the logistic loss and the clamped risk above."""
    prior = min(max(prior, 1e-4), 0.9)
    w, b = np.zeros(xp.shape[1]), math.log(prior / (1 - prior))
    mean, var = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        w32 = w.astype(xp.dtype)
        zp, zu = xp @ w32 + b, xu @ w32 + b
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if negative >= 0:
            gp, gu = -prior * (1 - sp) - prior * sp, su
        else:
            gp, gu = prior * sp, -su
        gp, gu = (gp / len(sp)).astype(xp.dtype), (gu / len(su)).astype(xp.dtype)
        grad = np.append(xp.T @ gp + xu.T @ gu + l2 * w, gp.sum() + gu.sum())
        mean = 0.9 * mean + 0.1 * grad
        var = 0.999 * var + 0.001 * grad * grad
        step = rate * (mean / (1 - 0.9 ** t)) / (np.sqrt(var / (1 - 0.999 ** t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


class Model:
    """Averaged linear scorers over a bounded feature list."""

    def __init__(self, names: list[str], weights: np.ndarray, biases: np.ndarray):
        self.known = Known({n: i for i, n in enumerate(names)})
        self.weights, self.biases = weights, biases

    def score(self, text: str | None) -> float:
        if not len(self.biases):
            return 0.0
        hit = self.known.rates(text)
        z = self.biases
        if hit:
            ix, x = zip(*sorted(hit.items()))
            z = z + self.weights[:, list(ix)] @ np.array(x)
        return float(_sigmoid(z).mean())


def _counts(allowed=None):
    """Batches of (text, pos) -> partial counts per active feature, of all
    features or only of the allowed: texts, positives."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = allowed.value if allowed is not None else None
        known = Known({k: i for i, k in enumerate(names)}) if names is not None else None
        for batch in batches:
            n: Counter = Counter()
            n_pos: Counter = Counter()
            for text, pos in zip(batch["text"], batch["pos"]):
                rates = features(text) if known is None else known.rates(text)
                active = [k for k, v in rates.items() if v >= ACTIVE]
                n.update(active)
                if pos:
                    n_pos.update(active)
            yield pd.DataFrame({"feature": [k if known is None else names[k] for k in n],
                                "n": list(n.values()), "n_pos": [n_pos[k] for k in n]})
    return run


_COUNTS = "feature string, n long, n_pos long"


def _summed(df: DataFrame, allowed=None) -> DataFrame:
    return (df.select("text", "pos").mapInPandas(_counts(allowed), _COUNTS)
            .groupBy("feature").agg(F.sum("n").alias("n"), F.sum("n_pos").alias("n_pos")))


def fit(docs: DataFrame, labels: DataFrame, **params) -> Model:
    """Learn the scorers. ``docs`` has doc_id and text, ``labels`` doc_id and
    toxic. The numpy step runs in one task per scorer, on at most
    ``max_positive`` and ``max_unlabelled`` texts, chosen by a hash of the
    text; scorer ``m`` leaves out the texts whose hash is ``m`` mod n_models."""
    p = DEFAULTS | params
    spark = docs.sparkSession
    ship(spark)
    sc = spark.sparkContext
    lab = (labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
           .groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null"))
    sizes = lab.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("long")).alias("p")).first()
    if not sizes["p"]:
        return Model([], np.zeros((0, 0)), np.zeros(0))
    prior = sizes["p"] / sizes["n"]
    base = docs.select("doc_id", text_of(docs).alias("text")).where(~held_out(F.col("doc_id")))
    # saved, so that its size is known when the join is planned
    toxic_ids = saved(lab.where("toxic = 1").select("doc_id"), "toxic-ids")
    all_pos = base.join(toxic_ids, "doc_id", "left_semi").withColumn("pos", F.lit(1))
    n_pos = all_pos.count()
    # a bounded sample of the labelled rows, so it may be broadcast
    pos_ids = (toxic_ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(p["max_positive"]))
    pos = base.join(F.broadcast(pos_ids), "doc_id", "left_semi").withColumn("pos", F.lit(1))
    if not n_pos:
        return Model([], np.zeros((0, 0)), np.zeros(0))

    # feature choice from counts over all training texts; each of the two
    # driver lists is bounded by the parameters, not by the corpus
    support = max(2, math.ceil(p["min_share"] * n_pos))
    candidates = {r["feature"]: r["n_pos"] for r in
                  _summed(all_pos).where(F.col("n_pos") >= support).toLocalIterator()}
    allowed = sc.broadcast(sorted(candidates))
    unl = base.withColumn("pos", F.lit(0))
    n_unl = base.count()
    share_p = F.col("n_pos") / F.lit(float(n_pos))
    share_u = F.col("n") / F.lit(float(n_unl))
    cand = spark.createDataFrame(sorted(candidates.items()), "feature string, n_pos long")
    gain = F.col("n_pos") * F.log(share_p / share_u) - n_pos * (share_p - share_u)
    names = [r["feature"] for r in
             _summed(unl, allowed).drop("n_pos").join(cand, "feature").where(share_p > share_u)
             .orderBy(F.round(gain, 9).desc(), "feature").limit(p["n_features"]).collect()]
    names.sort()

    # the sample: distinct texts, chosen by hash
    h = F.pmod(F.xxhash64(F.lit(7), F.col("text")), F.lit(1 << 30))
    rate_u = min(1.0, p["max_unlabelled"] / n_unl)
    sample = (pos.select("text", "pos")
              .unionByName(unl.where(h < int(rate_u * (1 << 30))).select("text", "pos"))
              .withColumn("h", F.xxhash64("text")))
    index = sc.broadcast({n: i for i, n in enumerate(names)})

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Known(index.value)
        for batch in batches:
            ids, vals = [], []
            for text in batch["text"]:
                hit = sorted(known.rates(text).items())
                ids.append([i for i, _ in hit])
                vals.append([v for _, v in hit])
            yield pd.DataFrame({"h": batch["h"], "pos": batch["pos"], "ids": ids, "vals": vals})

    vec = sample.mapInPandas(vectors, "h long, pos int, ids array<int>, vals array<double>")
    vec = vec.groupBy("h", "pos").agg(F.first("ids").alias("ids"), F.first("vals").alias("vals"))
    n_models, width = p["n_models"], len(names)
    dealt = (vec.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(n_models - 1))))
             .where((F.lit(n_models) == 1) | (F.pmod(F.col("h"), F.lit(n_models)) != F.col("m"))))

    def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["pos", "h"])  # the unlabelled first
        x = np.zeros((len(rows), width), np.float32)
        for r, (ids, vals) in enumerate(zip(rows["ids"], rows["vals"])):
            x[r, np.asarray(ids, dtype=int)] = vals
        unl = int((rows["pos"] == 0).sum())
        if unl in (0, len(rows)):
            return pd.DataFrame({"m": [int(key[0])], "w": [[]], "b": [0.0]})  # nothing to tell apart
        w, b = train_nnpu(x[unl:], x[:unl], prior, p["l2"], p["steps"], p["rate"])
        return pd.DataFrame({"m": [int(key[0])], "w": [w.tolist()], "b": [b]})

    got = sorted(r for r in dealt.groupBy("m").applyInPandas(learn, "m int, w array<double>, b double").collect()
                 if len(r["w"]) == width)
    if not got or not width:
        return Model([], np.zeros((0, 0)), np.zeros(0))
    return Model(names, np.array([r["w"] for r in got]), np.array([r["b"] for r in got]))


def scorer(docs: DataFrame, model: Model):
    """A column function: text -> toxicity score in 0..1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.score(t) for t in texts], dtype="float64")
    return score


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **params) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    docs = docs.select("doc_id", text_of(docs).alias("text"))
    score = scorer(docs, fit(docs, labels, **params))
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **params) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    name = "_toxicity" + "_" * sum(c.startswith("_toxicity") for c in docs.columns)
    score = scorer(docs, fit(docs, labels, **params))
    return docs.withColumn(name, score(text_of(docs))).where(F.col(name) < threshold).drop(name)
