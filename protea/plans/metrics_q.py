"""Metric and loss queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from protea.functions.math import sigmoid
from protea.operators import align, metrics, split
from protea.plans.catalog import register
from protea.session import scratch_path
from protea.sources import driver

SQL_CELLS = """cells AS (
  SELECT l_orderkey AS EntryID, 'L' || CAST(l_linenumber AS VARCHAR) AS term,
         CAST(l_discount * 10 AS FLOAT) AS score, l_returnflag = 'R' AS y
  FROM lineitem)"""
SQL_IA_L = """ia AS (
  SELECT 'L' || CAST(n_nationkey AS VARCHAR) AS term, CAST(1 + n_regionkey AS DOUBLE) AS score
  FROM nation)"""
SQL_IA_D = """ia AS (
  SELECT 'D' || CAST(n_nationkey AS VARCHAR) AS term, CAST(1 + n_regionkey AS DOUBLE) AS score
  FROM nation)"""
SQL_LOGITS = """ex AS (
  SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS j
  FROM embeddings),
lc AS (
  SELECT vec_id AS EntryID, 'D' || CAST(j AS VARCHAR) AS term, CAST(v AS DOUBLE) * 3.0 AS logit,
         CASE WHEN ((label % 2) + 2) % 2 = j % 2 THEN 1.0 ELSE 0.0 END AS y
  FROM ex)"""


def _fmax_sql(weighted: bool) -> str:
    ia = f", {SQL_IA_L}" if weighted else ""
    wcol = "coalesce(ia.score, 1.0)" if weighted else "CAST(1.0 AS DOUBLE)"
    join = "LEFT JOIN ia ON cells.term = ia.term" if weighted else ""
    return f"""WITH {SQL_CELLS}{ia},
c AS (SELECT cells.score, cells.y, {wcol} AS w FROM cells {join}),
th AS (SELECT range AS k, CAST(CAST(range AS DOUBLE) / 100.0 AS FLOAT) AS t FROM range(1, 100)),
hitm AS (SELECT th.k, (c.score >= th.t AND NOT isnan(c.score)) AS p, c.y, c.w FROM c, th),
agg AS (
  SELECT k, sum(CASE WHEN p AND y THEN w ELSE 0 END) AS tp,
            sum(CASE WHEN p AND NOT y THEN w ELSE 0 END) AS fp,
            sum(CASE WHEN NOT p AND y THEN w ELSE 0 END) AS fn
  FROM hitm GROUP BY k),
pr AS (
  SELECT k, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p,
            CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r
  FROM agg),
f AS (SELECT k, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM pr),
best AS (SELECT * FROM f WHERE f > 0 ORDER BY f DESC, k ASC LIMIT 1)
SELECT round(f, 6) AS fmax, round(p, 6) AS precision, round(r, 6) AS recall,
       round(CAST(k AS DOUBLE) / 100.0, 6) AS tau FROM best
UNION ALL
SELECT CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE)
WHERE NOT EXISTS (SELECT 1 FROM best)"""


def _round_all(df, cols):
    return df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("fmax", _fmax_sql(False))
def fmax(spark, sf):
    r = metrics.fmax(driver.cells(spark, sf))
    return _round_all(r, {"fmax", "precision", "recall", "tau"})


@register("fmax_merged", _fmax_sql(True))
def fmax_merged(spark, sf):
    """The weighted metric brought up to date batch by batch: the cells of each
    line status are a batch (one of them arrives twice), kept as a state table."""
    path = scratch_path(spark, "metric-state")
    li = driver.table(spark, sf, "lineitem")
    modes = sorted(r[0] for r in li.select("l_linestatus").distinct().collect())  # a fixed, small set
    for i, mode in enumerate([*modes, modes[0]] if modes else []):
        rows = li.where(F.col("l_linestatus").eqNullSafe(mode))
        metrics.update_state(path, driver.cells_of(rows), i % len(modes))
    terms = driver.cells(spark, sf).select("term").distinct()
    r = metrics.fmax_of_state(metrics.read_state(spark, path), ia=align.ia_weights(terms, driver.ia(spark, sf, "L")))
    return _round_all(r, {"fmax", "precision", "recall", "tau"})


@register("fmax_infinite", _fmax_sql(False).replace(
    "CAST(l_discount * 10 AS FLOAT) AS score",
    "CASE WHEN l_linenumber = 1 THEN CAST('inf' AS FLOAT) WHEN l_linenumber = 2 THEN CAST('-inf' AS FLOAT) "
    "ELSE CAST(l_discount * 10 AS FLOAT) END AS score"))
def fmax_infinite(spark, sf):
    """Scores without bound: an infinite one passes every threshold or none."""
    c = driver.cells(spark, sf)
    s = (F.when(F.col("term") == "L1", F.lit(float("inf"))).when(F.col("term") == "L2", F.lit(float("-inf")))
         .otherwise(F.col("score")))
    return _round_all(metrics.fmax(c.withColumn("score", s.cast("float"))), {"fmax", "precision", "recall", "tau"})


@register("fmax_weighted", _fmax_sql(True))
def fmax_weighted(spark, sf):
    cells = driver.cells(spark, sf)
    r = metrics.fmax(cells, ia=align.ia_weights(cells, driver.ia(spark, sf, "L")))
    return _round_all(r, {"fmax", "precision", "recall", "tau"})


@register("fmax_curve", f"""WITH {SQL_CELLS},
th AS (SELECT range AS k, CAST(CAST(range AS DOUBLE) / 100.0 AS FLOAT) AS t FROM range(1, 100)),
agg AS (
  SELECT k, CAST(count(*) FILTER (WHERE score >= t AND NOT isnan(score) AND y) AS DOUBLE) AS tp,
            CAST(count(*) FILTER (WHERE score >= t AND NOT isnan(score) AND NOT y) AS DOUBLE) AS fp,
            CAST(count(*) FILTER (WHERE NOT (score >= t AND NOT isnan(score)) AND y) AS DOUBLE) AS fn
  FROM cells, th GROUP BY k)
SELECT CAST(k AS INTEGER) AS tau_idx, tp, fp, fn,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall
FROM agg""")
def fmax_curve(spark, sf):
    c = metrics.threshold_curve(driver.cells(spark, sf))
    return c.select("tau_idx", "tp", "fp", "fn", F.round("precision", 6).alias("precision"),
                    F.round("recall", 6).alias("recall"))


@register("micro_f1", f"""WITH {SQL_CELLS},
a AS (SELECT count(*) FILTER (WHERE score > CAST(0.5 AS FLOAT) AND NOT isnan(score) AND y) AS tp,
             count(*) FILTER (WHERE score > CAST(0.5 AS FLOAT) AND NOT isnan(score) AND NOT y) AS fp,
             count(*) FILTER (WHERE NOT (score > CAST(0.5 AS FLOAT) AND NOT isnan(score)) AND y) AS fn
      FROM cells)
SELECT round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END, 6)
       AS micro_f1, tp, fp, fn FROM a""")
def micro_f1(spark, sf):
    r = metrics.micro_f1(driver.cells(spark, sf), 0.5)
    return r.select(F.round("micro_f1", 6).alias("micro_f1"), "tp", "fp", "fn")


@register("bce_loss", f"""WITH {SQL_LOGITS}
SELECT round(avg(greatest(logit, 0) - logit * y + ln(1 + exp(-abs(logit)))), 6) AS loss FROM lc""")
def bce_loss(spark, sf):
    return metrics.bce_loss(driver.logit_cells(spark, sf)).select(F.round("loss", 6).alias("loss"))


@register("focal_loss", f"""WITH {SQL_LOGITS},
b AS (SELECT greatest(logit, 0) - logit * y + ln(1 + exp(-abs(logit))) AS bce FROM lc)
SELECT round(avg(0.25 * pow(1 - exp(-bce), 2) * bce), 6) AS loss FROM b""")
def focal_loss(spark, sf):
    r = metrics.focal_loss(driver.logit_cells(spark, sf), gamma=2.0, alpha=0.25)
    return r.select(F.round("loss", 6).alias("loss"))


@register("weighted_focal_loss", f"""WITH {SQL_LOGITS}, {SQL_IA_D},
w AS (SELECT v.term, coalesce(ia.score, 1.0) AS w
      FROM (SELECT DISTINCT term FROM lc) v LEFT JOIN ia ON v.term = ia.term),
b AS (SELECT lc.EntryID, greatest(logit, 0) - logit * y + ln(1 + exp(-abs(logit))) AS bce, w.w
      FROM lc JOIN w ON lc.term = w.term)
SELECT round(sum(pow(1 - exp(-bce), 2) * bce * w)
             / (count(DISTINCT EntryID) * (SELECT sum(w) FROM w)), 6) AS loss FROM b""")
def weighted_focal_loss(spark, sf):
    cells = driver.logit_cells(spark, sf)
    r = metrics.weighted_focal_loss(cells, align.ia_weights(cells, driver.ia(spark, sf, "D")), gamma=2.0)
    return r.select(F.round("loss", 6).alias("loss"))


@register("fold_summary", f"""WITH {SQL_LOGITS},
s AS (SELECT (((EntryID % 4294967296) * 1103515245 + 12387) % 4294967296) // 65536 % 5 AS fold,
             CAST(1.0 / (1.0 + exp(-logit)) AS FLOAT) AS score, y = 1.0 AS y FROM lc),
pf AS (SELECT fold, count(*) FILTER (WHERE score > CAST(0.5 AS FLOAT) AND y) AS tp,
              count(*) FILTER (WHERE score > CAST(0.5 AS FLOAT) AND NOT y) AS fp,
              count(*) FILTER (WHERE NOT score > CAST(0.5 AS FLOAT) AND y) AS fn
       FROM s GROUP BY fold),
f1 AS (SELECT CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM pf)
SELECT count(*) AS n_folds, round(avg(f1), 6) AS mean_f1, round(stddev_pop(f1), 6) AS std_f1 FROM f1""")
def fold_summary(spark, sf):
    lc = driver.logit_cells(spark, sf)
    c = split.assign_folds(lc, "EntryID", k=5, seed=42, method="lcg")
    c = c.select("fold", sigmoid(F.col("logit")).cast("float").alias("score"),
                 (F.col("y") == 1.0).alias("y"))
    r = metrics.summarize_folds(metrics.per_fold_micro_f1(c))
    return r.select("n_folds", F.round("mean_f1", 6).alias("mean_f1"), F.round("std_f1", 6).alias("std_f1"))
