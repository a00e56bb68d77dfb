"""Train-and-score plans.

Training table (T7/T8): embeddings keyed by EntryID, aligned with the
sequence table, taxonomy left-joined (-1) and indexed (0 = unknown),
positive labels restricted to a top-k vocabulary as ``label_idx`` arrays,
and a deterministic 80/20 hash split. The label target is ``emb_signs``
(term D_j when embedding[j] > 0), which is learnable from the features.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protea.operators import align, labels, score, split
from protea.plans.catalog import register
from protea.plans.labels_q import _lcg_sql
from protea.session import scratch_path
from protea.sources import driver

N_LABELS = 64  # dimensions of the driver's embeddings


def training_table(spark, sf, top_k: int = N_LABELS, method: str = "xxhash64") -> tuple[DataFrame, list[str], DataFrame]:
    """(table, vocabulary terms in index order, taxonomy vocab)."""
    emb = driver.emb(spark, sf)
    seqs = driver.seqs(spark, sf)
    pos = driver.emb_signs(spark, sf)
    entries = emb.select("EntryID")
    aligned = align.align_training(seqs, entries, emb, driver.taxonomy(spark, sf))
    tax_vocab = align.taxonomy_vocab(aligned)
    vocab = labels.top_k_labels(pos, top_k, entries=aligned.select("EntryID"))
    terms = [r["term"] for r in vocab.orderBy("rank").select("term").collect()]  # k rows
    pos_idx = labels.restrict_to_vocab(pos, vocab, top_k)
    t = align.labels_array(aligned, pos_idx)
    t = align.index_taxonomy(t, tax_vocab)
    t = split.assign_split(t, "EntryID", 0.2, seed=42, method=method)
    return t.select("EntryID", "embedding", "taxonomy_idx", "label_idx", "is_val"), terms, tax_vocab


def test_table(spark, sf, tax_vocab: DataFrame) -> DataFrame:
    """Every embedding is scored; taxonomy from the test-side left join."""
    e = align.with_taxonomy(driver.emb(spark, sf), driver.taxonomy(spark, sf))
    return align.index_taxonomy(e, tax_vocab).select("EntryID", "embedding", "taxonomy_idx")


@register("training_rows", f"""
SELECT e.vec_id AS EntryID, coalesce(s.s_nationkey, -1) AS taxonomyID,
       {_lcg_sql("e.vec_id", 1000)} < 200 AS is_val,
       CAST(len([x for x in e.embedding if x > 0]) AS INTEGER) AS n_labels
FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id LEFT JOIN supplier s ON s.s_suppkey = e.vec_id""")
def training_rows(spark, sf):
    """The training table itself (T7): alignment, taxonomy, split, labels."""
    t, _, tax_vocab = training_table(spark, sf, method="lcg")
    known = tax_vocab.select("taxonomy_idx", "taxonomyID")
    return (t.join(known, "taxonomy_idx", "left")
            .select("EntryID", F.coalesce("taxonomyID", F.lit(-1)).alias("taxonomyID"), "is_val",
                    F.size("label_idx").alias("n_labels")))


@register("test_rows", """
SELECT e.vec_id AS EntryID, coalesce(s.s_nationkey, -1) AS taxonomyID
FROM embeddings e LEFT JOIN supplier s ON s.s_suppkey = e.vec_id""")
def test_rows(spark, sf):
    """The test table (T8): every embedding, with its taxonomy where the
    training rows know it."""
    _, _, tax_vocab = training_table(spark, sf, method="lcg")
    t = test_table(spark, sf, tax_vocab)
    return (t.join(tax_vocab, "taxonomy_idx", "left")
            .select("EntryID", F.coalesce("taxonomyID", F.lit(-1)).alias("taxonomyID")))


# one tree of depth 1 on fixed cut points, so that SQL can state it
CUTS = [-0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3]


@register("boosted_scores", f"""WITH
ex AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings),
cell AS (
  SELECT vec_id, j, v > 0 AS y,
         {" + ".join(f"(CASE WHEN CAST(v AS DOUBLE) > {c} THEN 1 ELSE 0 END)" for c in CUTS)} AS b
  FROM ex),
tr AS (SELECT c.* FROM cell c JOIN documents d ON d.doc_id = c.vec_id
       WHERE NOT ({_lcg_sql("c.vec_id", 1000)} < 200)),
n AS (SELECT CAST(count(DISTINCT vec_id) AS DOUBLE) AS n FROM tr),
rate AS (SELECT j, least(greatest(sum(CASE WHEN y THEN 1.0 ELSE 0.0 END) / max(n.n), 1e-4), 1 - 1e-4) AS p
         FROM tr, n GROUP BY j),
g AS (SELECT tr.vec_id, tr.j, rate.p - CASE WHEN tr.y THEN 1.0 ELSE 0.0 END AS g FROM tr JOIN rate ON tr.j = rate.j),
h AS (SELECT f.j AS d, f.b, g.j AS l, sum(g.g) AS g FROM tr f JOIN g ON f.vec_id = g.vec_id GROUP BY f.j, f.b, g.j),
c AS (SELECT j AS d, b, count(*) AS n FROM tr GROUP BY j, b),
cut AS (SELECT range AS b FROM range(0, 8)),
left_n AS (SELECT c.d, cut.b, sum(CASE WHEN c.b <= cut.b THEN c.n ELSE 0 END) AS nl, sum(c.n) AS n FROM c, cut GROUP BY c.d, cut.b),
left_g AS (SELECT h.d, h.l, cut.b, sum(CASE WHEN h.b <= cut.b THEN h.g ELSE 0 END) AS gl, sum(h.g) AS g
           FROM h, cut GROUP BY h.d, h.l, cut.b),
gain AS (SELECT a.d, a.b, sum(a.gl * a.gl / (x.nl + 10) + (a.g - a.gl) * (a.g - a.gl) / (x.n - x.nl + 10) - a.g * a.g / (x.n + 10)) AS gain
         FROM left_g a JOIN left_n x ON a.d = x.d AND a.b = x.b
         WHERE x.nl >= 10 AND x.n - x.nl >= 10 GROUP BY a.d, a.b),
best AS (SELECT d, b FROM gain WHERE gain > 0 ORDER BY gain DESC, d, b LIMIT 1),
leaf AS (
  SELECT a.l, -0.5 * a.gl / (x.nl + 10) AS vl, -0.5 * (a.g - a.gl) / (x.n - x.nl + 10) AS vr
  FROM left_g a JOIN best ON a.d = best.d AND a.b = best.b JOIN left_n x ON x.d = best.d AND x.b = best.b),
side AS (SELECT cell.vec_id, cell.b <= best.b AS l FROM cell JOIN best ON cell.j = best.d),
p AS (
  SELECT side.vec_id AS EntryID, 'D' || CAST(leaf.l AS VARCHAR) AS term,
         CAST(1.0 / (1.0 + exp(-(ln(rate.p / (1 - rate.p)) + CASE WHEN side.l THEN leaf.vl ELSE leaf.vr END))) AS FLOAT) AS score
  FROM side, leaf JOIN rate ON rate.j = leaf.l)
SELECT EntryID, term, round(CAST(score AS DOUBLE), 6) AS score FROM p WHERE score > CAST(0.01 AS FLOAT)""")
def boosted_scores(spark, sf):
    """Training, saving the model, reading it back and scoring every embedding
    with the model that was read."""
    from protea.operators import boost
    t, terms, tax_vocab = training_table(spark, sf, method="lcg")
    params = boost.BoostParams(ntrees=1, max_depth=1, lr=0.5, max_bin=len(CUTS) + 1, subsample=1.0, colsample=1.0,
                               sketch_dim=None)
    model, _ = boost.fit(t, len(terms), params, cuts=np.tile(CUTS, (N_LABELS, 1)))
    path = scratch_path(spark, "model")
    boost.save_model(spark, model, terms, path)
    model, terms = boost.load_model(spark, path)
    p = score.score(test_table(spark, sf, tax_vocab), [model], terms, 0.01)
    return p.withColumn("score", F.round(F.col("score").cast("double"), 6))


FOREST = dict(ntrees=8, max_depth=3, lr=0.5, max_bin=32, sketch_dim=3, subsample=0.8, colsample=0.8, es_rounds=3)


@register("boosted_forest")
def boosted_forest(spark, sf):
    """Several trees over quantile bins, with sketched gradients, sampled rows
    and features and early stopping, kept by rounds in the shared folder; then
    every embedding is scored. (No SQL: a numpy twin in the tests.)"""
    from protea.operators import boost
    t, terms, tax_vocab = training_table(spark, sf, method="lcg")
    model, _ = boost.fit(t, len(terms), boost.BoostParams(**FOREST), state_dir=scratch_path(spark, "forest"))
    p = score.score(test_table(spark, sf, tax_vocab), [model], terms, 0.01)
    return p.withColumn("score", F.round(F.col("score").cast("double"), 6))
