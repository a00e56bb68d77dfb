"""Multi-label evaluation: pooled F-max, micro F1, losses, fold summaries.

Inputs are long *cell* tables ``(EntryID, term, score, y)`` — one row per
(entry, label) cell of the prediction matrix. ``cells_from`` builds them from
a prediction table and a truth table (a truth pair with no prediction is a
score-0 cell, so it counts as a false negative).

F-max is computed in one pass instead of one pass per threshold: every cell
is assigned the highest threshold index it passes, tp/fp weights are summed
per index (map-side partial aggregation -> at most 100 groups), and each of
those rows feeds every threshold (tp/fp at or below its index, fn above it),
<= 9,900 rows, to give tp/fp/fn at every threshold without an ordered window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protea.functions.math import bce_with_logits, f32, focal, safe_ratio, sigmoid


def cells_from(pred: DataFrame, truth: DataFrame, keys=("EntryID", "term")) -> DataFrame:
    """(keys..., score, y) from predictions (keys, score) and positive pairs."""
    keys = list(keys)
    t = truth.select(*keys).distinct().withColumn("y", F.lit(True))
    return (pred.select(*keys, "score").join(t, keys, "full_outer")
            .select(*keys, F.coalesce(F.col("score"), F.lit(0.0).cast("float")).alias("score"),
                    F.coalesce(F.col("y"), F.lit(False)).alias("y")))


def _threshold_bucket(score, n: int = 99):
    """Highest k in 1..n with score >= float32(k/100); 0 if none (NaN -> 0)."""
    s = score.cast("float")
    # all scores beyond the thresholds, infinite ones too, pass all or none
    g = F.floor(F.least(F.greatest(s.cast("double"), F.lit(-1.0)), F.lit(2.0)) * 100).cast("int")
    passes = lambda k: s >= f32(k.cast("double") / F.lit(100.0))
    b = (F.when(passes(g + 1), g + 1).when(passes(g), g).otherwise(g - 1))
    b = F.least(F.greatest(b, F.lit(0)), F.lit(n))
    return F.when(s.isNull() | F.isnan(s), F.lit(0)).otherwise(b)


def _or_fail(col, message: str, term: str = "term"):
    """``col``, or an error that names the term where it is null."""
    return F.coalesce(col, F.raise_error(F.concat(F.lit(message), F.col(term))).cast("double"))


def term_weights(ia: DataFrame) -> DataFrame:
    """(term, _w) of a weight table (term, score | weight); a term that occurs
    twice is an error."""
    col = "score" if "score" in ia.columns else "weight"
    g = ia.groupBy("term").agg(F.count("*").alias("_n"), F.max(F.col(col).cast("double")).alias("_s"))
    once = F.when(F.col("_n") == 1, F.col("_s"))
    return g.select("term", _or_fail(once, "null or repeated weight for term ").alias("_w"))


def cell_state(cells: DataFrame, n: int = 99) -> DataFrame:
    """What the metrics need of some cells: (term, b, tp, fp), the true and
    false cells of each term whose score reaches exactly the thresholds up to
    b/100; at most labels x (n + 1) rows. States of disjoint cells add up, so a
    metric can be brought up to date batch by batch (``merge_states``)."""
    yv = F.col("y").cast("boolean")
    return (cells.select("term", _threshold_bucket(F.col("score"), n).alias("b"), yv.alias("_y"))
            .groupBy("term", "b").agg(F.count_if(F.col("_y")).alias("tp"), F.count_if(~F.col("_y")).alias("fp")))


def merge_states(*states: DataFrame) -> DataFrame:
    """The state of all cells of several states."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    return every.groupBy("term", "b").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"))


def update_state(path: str, cells: DataFrame, batch_id: int, n: int = 99) -> None:
    """Add a batch's cells to the state table in the folder ``path`` (for
    ``foreachBatch``): a batch that runs again replaces its own part."""
    cell_state(cells, n).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The state of all batches that ``update_state`` has added."""
    return merge_states(spark.read.option("basePath", path).parquet(path).select("term", "b", "tp", "fp"))


def threshold_curve(cells: DataFrame, ia: DataFrame | None = None, n: int = 99) -> DataFrame:
    """(tau_idx, tau, tp, fp, fn, precision, recall, f) for tau = k/100, k=1..n.
    ``ia``: a weight for every term of the cells (see ``align.ia_weights``,
    which fills in the default); a missing one is an error."""
    return curve_of_state(cell_state(cells, n), ia, n)


def curve_of_state(state: DataFrame, ia: DataFrame | None = None, n: int = 99) -> DataFrame:
    """``threshold_curve`` of cells whose state was kept."""
    spark = state.sparkSession
    # cells came down to (term, bucket) counts map-side; IA weights apply to
    # those rows, so the cell table is never joined
    tb = state.select("term", "b", F.col("tp").alias("_tp"), F.col("fp").alias("_fp"))
    if ia is None:
        tb = tb.withColumn("_w", F.lit(1.0))
    else:
        tb = tb.join(term_weights(ia), "term", "left").withColumn("_w", _or_fail(F.col("_w"), "no weight for term "))
    per = tb.groupBy("b").agg(F.sum(F.col("_tp") * F.col("_w")).alias("tp_b"),
                              F.sum(F.col("_fp") * F.col("_w")).alias("fp_b"))
    # every (<= 100) bucket row b feeds every threshold k = 1..n: to tp/fp when
    # k <= b (predicted at k), to fn when k > b -> <= 9,900 rows and one
    # equi-aggregation; the cells are aggregated once, no ordered window
    k = F.col("tau_idx")
    fed = (per.select("b", "tp_b", "fp_b", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("tau_idx"))
           .groupBy("tau_idx")
           .agg(F.sum(F.when(k <= F.col("b"), F.col("tp_b")).otherwise(0.0)).alias("tp"),
                F.sum(F.when(k <= F.col("b"), F.col("fp_b")).otherwise(0.0)).alias("fp"),
                F.sum(F.when(k > F.col("b"), F.col("tp_b")).otherwise(0.0)).alias("fn")))
    grid = spark.range(1, n + 1).select(F.col("id").cast("int").alias("tau_idx"))
    cur = (grid.join(fed, "tau_idx", "left").fillna(0.0, ["tp", "fp", "fn"])
           .select("tau_idx", (F.col("tau_idx") / 100.0).alias("tau"), "tp", "fp", "fn"))
    p = safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    cur = cur.withColumn("precision", p).withColumn("recall", r)
    pr = F.col("precision") + F.col("recall")
    return cur.withColumn("f", F.when(pr > 0, 2 * F.col("precision") * F.col("recall") / pr)
                          .otherwise(F.lit(0.0)))


def fmax(cells: DataFrame, ia: DataFrame | None = None, n: int = 99) -> DataFrame:
    """One row (fmax, precision, recall, tau): the first strict maximum of F
    over ascending thresholds; (0, 0, 0, null) when no threshold has F > 0."""
    return fmax_of_state(cell_state(cells, n), ia, n)


def fmax_of_state(state: DataFrame, ia: DataFrame | None = None, n: int = 99) -> DataFrame:
    """``fmax`` of cells whose state was kept."""
    spark = state.sparkSession
    curve = curve_of_state(state, ia, n).where(F.col("f") > 0)
    best = curve.orderBy(F.desc("f"), F.asc("tau_idx")).limit(1)
    zero = spark.range(1).select(F.lit(0.0).alias("fmax"), F.lit(0.0).alias("precision"),
                                 F.lit(0.0).alias("recall"), F.lit(None).cast("double").alias("tau"),
                                 F.lit(1).alias("_o"))
    top = best.select(F.col("f").alias("fmax"), "precision", "recall", "tau", F.lit(0).alias("_o"))
    return top.unionByName(zero).orderBy("_o").limit(1).drop("_o")


def micro_f1(cells: DataFrame, threshold: float = 0.5, strict: bool = True) -> DataFrame:
    """Pooled F1 over all cells; predicted = score > t (``strict``) or >= t."""
    s = F.col("score").cast("float")
    pred = (s > f32(threshold)) if strict else (s >= f32(threshold))
    pred = pred & ~F.isnan(s)
    y = F.col("y").cast("boolean")
    agg = cells.agg(F.count_if(pred & y).alias("tp"), F.count_if(pred & ~y).alias("fp"),
                    F.count_if(~pred & y).alias("fn"))
    den = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return agg.select(safe_ratio(2 * F.col("tp").cast("double"), den.cast("double")).alias("micro_f1"),
                      "tp", "fp", "fn")


def bce_loss(cells: DataFrame) -> DataFrame:
    """Mean BCE-with-logits over (logit, y) cells."""
    return cells.agg(F.avg(bce_with_logits(F.col("logit"), F.col("y").cast("double"))).alias("loss"))


def focal_loss(cells: DataFrame, gamma: float = 2.0, alpha=None, reduction: str = "mean") -> DataFrame:
    """Focal loss. ``alpha``: None, a scalar, or a (term, alpha) DataFrame
    (per-class factor, one for every class: a missing one is an error).
    reduction: mean | sum | none. With a per-class table
    and a reducing mode, the cells are summed per term first and the factors
    applied to those rows (the cell table is never joined)."""
    y = F.col("y").cast("double")
    if isinstance(alpha, DataFrame):
        a = alpha.select("term", F.col("alpha").cast("double").alias("_alpha"))
        if reduction == "none":
            return cells.join(a, "term", "left").withColumn(
                "loss", focal(F.col("logit"), y, gamma, _or_fail(F.col("_alpha"), "no alpha for term "))).drop("_alpha")
        per = cells.groupBy("term").agg(F.sum(focal(F.col("logit"), y, gamma)).alias("_f"),
                                        F.count("*").alias("_n"))
        j = per.join(a, "term", "left").withColumn("_alpha", _or_fail(F.col("_alpha"), "no alpha for term "))
        tot = F.sum(F.col("_alpha") * F.col("_f"))
        return j.agg((tot if reduction == "sum" else tot / F.sum("_n")).alias("loss"))
    fl = focal(F.col("logit"), y, gamma, None if alpha is None else float(alpha))
    if reduction == "none":
        return cells.withColumn("loss", fl)
    if reduction == "sum":
        return cells.agg(F.sum(fl).alias("loss"))
    return cells.agg(F.avg(fl).alias("loss"))


def weighted_focal_loss(cells: DataFrame, weights: DataFrame | None = None,
                        gamma: float = 2.0, alpha: float | None = None) -> DataFrame:
    """sum(focal * w) / (B * sum_vocab(w)) over a dense (B entries x C labels)
    cell table; w from (term, score | weight), one for every term. A missing
    weight, or a term with fewer cells than another, is an error. Without
    weights: plain mean. One pass over the cells: a per-term partial aggregate (focal
    sum, cell count) -> C term rows joined with the IA table -> B = cells / C."""
    fl = focal(F.col("logit"), F.col("y").cast("double"), gamma, alpha)
    if weights is None:
        return cells.agg(F.avg(fl).alias("loss"))
    per = cells.groupBy("term").agg(F.sum(fl).alias("_f"), F.count("*").alias("_n"))
    j = per.join(term_weights(weights), "term", "left").withColumn("_w", _or_fail(F.col("_w"), "no weight for term "))
    agg = j.agg(F.sum(F.col("_f") * F.col("_w")).alias("num"), F.sum("_w").alias("sw"),
                F.sum("_n").alias("n"), F.count("*").alias("c"), F.min("_n").alias("least"), F.max("_n").alias("most"))
    loss = F.col("num") / ((F.col("n") / F.col("c")) * F.col("sw"))
    dense = F.when(F.col("least").eqNullSafe(F.col("most")), loss)
    return agg.select(dense.otherwise(F.raise_error(F.lit("the cell table is not dense")).cast("double")).alias("loss"))


def summarize_folds(per_fold: DataFrame, metric: str = "f1") -> DataFrame:
    """Mean and population standard deviation of a per-fold metric."""
    return per_fold.agg(F.count("*").alias("n_folds"), F.avg(metric).alias("mean_f1"),
                        F.stddev_pop(metric).alias("std_f1"))


def per_fold_micro_f1(cells: DataFrame, fold_col: str = "fold", threshold: float = 0.5) -> DataFrame:
    """Micro F1 per fold from (fold, score, y) cells; one grouped pass."""
    s = F.col("score").cast("float")
    pred = (s > f32(threshold)) & ~F.isnan(s)
    y = F.col("y").cast("boolean")
    agg = cells.groupBy(fold_col).agg(F.count_if(pred & y).alias("tp"),
                                      F.count_if(pred & ~y).alias("fp"),
                                      F.count_if(~pred & y).alias("fn"))
    den = (2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double")
    return agg.select(fold_col, safe_ratio(2 * F.col("tp").cast("double"), den).alias("f1"))


def logit_to_score(cells: DataFrame) -> DataFrame:
    return cells.withColumn("score", sigmoid(F.col("logit")).cast("float"))
