"""Label, alignment, taxonomy, IA and split queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from protea.operators import align, labels, split
from protea.plans.catalog import register
from protea.plans.sequences_q import SQL_SEQS
from protea.sources import driver

SQL_EMB_LABELS = """emb_labels AS (
  SELECT vec_id AS EntryID, 'L' || CAST(label AS VARCHAR) AS term FROM embeddings)"""
SQL_EMB_SIGNS = """ex AS (
  SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings),
emb_signs AS (SELECT vec_id AS EntryID, 'D' || CAST(j AS VARCHAR) AS term FROM ex WHERE v > 0)"""
SQL_TAX = """tax AS (SELECT s_suppkey AS EntryID, CAST(s_nationkey AS BIGINT) AS taxonomyID FROM supplier)"""
SQL_ALIGNED = f"""{SQL_SEQS}, {SQL_TAX},
aligned AS (
  SELECT s.EntryID, s.seq, coalesce(t.taxonomyID, -1) AS taxonomyID, e.embedding
  FROM seqs s LEFT JOIN tax t ON s.EntryID = t.EntryID
  JOIN labels l ON s.EntryID = l.doc_id
  JOIN embeddings e ON s.EntryID = e.vec_id)"""


def _lcg_sql(key: str, n: int, seed: int = 42) -> str:
    return f"CAST(((({key} % 4294967296) * 1103515245 + {12345 + seed}) % 4294967296) // 65536 % {n} AS INTEGER)"


def _aligned(spark, sf):
    return align.align_training(driver.seqs(spark, sf), driver.wide_labels(spark, sf),
                                driver.emb(spark, sf), driver.taxonomy(spark, sf))


@register("labels_melt", """
SELECT doc_id AS EntryID, 'quality' AS term, quality AS value FROM labels
UNION ALL
SELECT doc_id AS EntryID, 'toxic' AS term, toxic AS value FROM labels""")
def labels_melt(spark, sf):
    return labels.melt_wide(driver.wide_labels(spark, sf))


@register("label_counts", """
WITH pos AS (
  SELECT doc_id, 'quality' AS term FROM labels WHERE quality = 1
  UNION ALL SELECT doc_id, 'toxic' AS term FROM labels WHERE toxic = 1)
SELECT term, count(*) AS pos, (SELECT count(DISTINCT doc_id) FROM labels) - count(*) AS neg
FROM pos GROUP BY term""")
def label_counts(spark, sf):
    wl = driver.wide_labels(spark, sf)
    return labels.label_counts(labels.positives(labels.melt_wide(wl)), wl)


@register("topk_labels_before", f"""WITH {SQL_EMB_LABELS},
c AS (SELECT term, count(*) AS n FROM emb_labels GROUP BY term)
SELECT term, n, CAST(row_number() OVER (ORDER BY n DESC, term) AS INTEGER) AS rank
FROM c ORDER BY n DESC, term LIMIT 5""")
def topk_labels_before(spark, sf):
    return labels.top_k_labels(driver.emb_labels(spark, sf), 5)


@register("topk_labels_after", f"""WITH {SQL_EMB_LABELS}, {SQL_SEQS},
ent AS (SELECT s.EntryID FROM seqs s JOIN labels l ON s.EntryID = l.doc_id),
c AS (SELECT term, count(*) AS n FROM emb_labels WHERE EntryID IN (SELECT EntryID FROM ent) GROUP BY term)
SELECT term, n, CAST(row_number() OVER (ORDER BY n DESC, term) AS INTEGER) AS rank
FROM c ORDER BY n DESC, term LIMIT 5""")
def topk_labels_after(spark, sf):
    ent = driver.seqs(spark, sf).join(driver.wide_labels(spark, sf).select("EntryID"), "EntryID")
    return labels.top_k_labels(driver.emb_labels(spark, sf), 5, entries=ent)


def _cw_sql(method: str) -> str:
    if method == "inverse_freq":
        w1, w0 = "1.0 / greatest(pos, 1)", "1.0 / greatest(neg, 1)"
    else:
        w1, w0 = "N / (2.0 * greatest(pos, 1))", "N / (2.0 * greatest(neg, 1))"
    return f"""WITH {SQL_EMB_SIGNS},
c AS (SELECT term, count(*) AS pos FROM emb_signs GROUP BY term),
n AS (SELECT count(DISTINCT vec_id) AS N FROM embeddings),
r AS (SELECT term, CAST(row_number() OVER (ORDER BY pos DESC, term) AS INTEGER) AS rank, pos,
             N - pos AS neg, N FROM c, n)
SELECT term, rank, pos, neg,
       round(CASE WHEN rank <= 10 THEN 1.0 ELSE least(greatest({w1}, 0.1), 10.0) END, 6) AS w_pos,
       round(CASE WHEN rank <= 10 THEN 1.0 ELSE least(greatest({w0}, 0.1), 10.0) END, 6) AS w_neg
FROM r"""


def _cw(spark, sf, method):
    pos = driver.emb_signs(spark, sf)
    vocab = labels.top_k_labels(pos, None)
    w = labels.class_weights(pos, driver.emb(spark, sf), vocab, method)
    return w.select("term", "rank", "pos", "neg", F.round("w_pos", 6).alias("w_pos"),
                    F.round("w_neg", 6).alias("w_neg"))


@register("class_weights_inverse", _cw_sql("inverse_freq"))
def class_weights_inverse(spark, sf):
    return _cw(spark, sf, "inverse_freq")


@register("class_weights_balanced", _cw_sql("balanced"))
def class_weights_balanced(spark, sf):
    return _cw(spark, sf, "balanced")


@register("align_inner", f"""WITH {SQL_ALIGNED}
SELECT EntryID, taxonomyID, CAST(length(seq) AS INTEGER) AS seq_len,
       CAST(len(embedding) AS INTEGER) AS emb_dim, CAST(embedding[1] AS DOUBLE) AS emb0
FROM aligned""")
def align_inner(spark, sf):
    a = _aligned(spark, sf)
    return a.select("EntryID", "taxonomyID", F.length("seq").alias("seq_len"),
                    F.size("embedding").alias("emb_dim"),
                    F.element_at("embedding", 1).cast("double").alias("emb0"))


@register("taxonomy_left_fill", f"""WITH {SQL_TAX}
SELECT d.doc_id AS EntryID, coalesce(t.taxonomyID, -1) AS taxonomyID
FROM documents d LEFT JOIN tax t ON d.doc_id = t.EntryID""")
def taxonomy_left_fill(spark, sf):
    s = driver.seqs(spark, sf).select("EntryID")
    return align.with_taxonomy(s, driver.taxonomy(spark, sf))


@register("taxonomy_vocab", f"""WITH {SQL_ALIGNED}
SELECT taxonomyID, CAST(row_number() OVER (ORDER BY taxonomyID) AS INTEGER) AS taxonomy_idx
FROM (SELECT DISTINCT taxonomyID FROM aligned WHERE taxonomyID <> -1)""")
def taxonomy_vocab(spark, sf):
    return align.taxonomy_vocab(_aligned(spark, sf))


@register("taxonomy_index", f"""WITH {SQL_ALIGNED},
vocab AS (SELECT taxonomyID, CAST(row_number() OVER (ORDER BY taxonomyID) AS INTEGER) AS taxonomy_idx
          FROM (SELECT DISTINCT taxonomyID FROM aligned WHERE taxonomyID <> -1)),
test AS (SELECT e.vec_id AS EntryID, coalesce(t.taxonomyID, -1) AS taxonomyID
         FROM embeddings e LEFT JOIN tax t ON e.vec_id = t.EntryID)
SELECT test.EntryID, test.taxonomyID, coalesce(v.taxonomy_idx, 0) AS taxonomy_idx
FROM test LEFT JOIN vocab v ON test.taxonomyID = v.taxonomyID""")
def taxonomy_index(spark, sf):
    vocab = align.taxonomy_vocab(_aligned(spark, sf))
    test = align.with_taxonomy(driver.emb(spark, sf).select("EntryID"), driver.taxonomy(spark, sf))
    return align.index_taxonomy(test, vocab).select("EntryID", "taxonomyID", "taxonomy_idx")


@register("ia_weights", f"""WITH {SQL_EMB_SIGNS},
ia AS (SELECT 'D' || CAST(n_nationkey AS VARCHAR) AS term, CAST(1 + n_regionkey AS DOUBLE) AS score FROM nation)
SELECT v.term, coalesce(ia.score, 1.0) AS weight
FROM (SELECT DISTINCT term FROM emb_signs) v LEFT JOIN ia ON v.term = ia.term""")
def ia_weights(spark, sf):
    vocab = driver.emb_signs(spark, sf).select("term").distinct()
    return align.ia_weights(vocab, driver.ia(spark, sf, "D"))


@register("ia_weights_last", f"""WITH {SQL_EMB_SIGNS},
ia AS (SELECT 'D' || CAST(c_nationkey AS VARCHAR) AS term, arg_max(CAST(c_acctbal AS DOUBLE), c_custkey) AS score
       FROM customer GROUP BY 1)
SELECT v.term, coalesce(ia.score, 1.0) AS weight
FROM (SELECT DISTINCT term FROM emb_signs) v LEFT JOIN ia ON v.term = ia.term""")
def ia_weights_last(spark, sf):
    """A weight table with many rows per term, of which the last one counts."""
    vocab = driver.emb_signs(spark, sf).select("term").distinct()
    ia = driver.table(spark, sf, "customer").select(F.concat(F.lit("D"), F.col("c_nationkey").cast("string")).alias("term"),
                                                    F.col("c_acctbal").cast("double").alias("score"), F.col("c_custkey").alias("row"))
    return align.ia_weights(vocab, ia, on_duplicate="last", order="row")


@register("hash_split", f"""
SELECT vec_id AS EntryID, {_lcg_sql('vec_id', 1000)} < 200 AS is_val FROM embeddings""")
def hash_split(spark, sf):
    e = driver.emb(spark, sf).select("EntryID")
    return split.assign_split(e, "EntryID", 0.2, seed=42, method="lcg")


@register("kfold", f"""
SELECT doc_id AS EntryID, {_lcg_sql('doc_id', 5)} AS fold FROM documents""")
def kfold(spark, sf):
    s = driver.seqs(spark, sf).select("EntryID")
    return split.assign_folds(s, "EntryID", 5, seed=42, method="lcg")


@register("key_checks", f"""WITH {SQL_SEQS},
l AS (SELECT EntryID, count(*) AS cl FROM seqs GROUP BY EntryID),
r AS (SELECT vec_id AS EntryID, count(*) AS cr FROM embeddings GROUP BY vec_id),
j AS (SELECT l.cl, r.cr FROM l FULL OUTER JOIN r ON l.EntryID = r.EntryID)
SELECT CAST(coalesce(sum(cl), 0) AS BIGINT) AS n_left, CAST(coalesce(sum(cr), 0) AS BIGINT) AS n_right,
       count(*) FILTER (WHERE cl > 1) AS dup_left, count(*) FILTER (WHERE cr > 1) AS dup_right,
       count(*) FILTER (WHERE cr IS NULL) AS left_only, count(*) FILTER (WHERE cl IS NULL) AS right_only
FROM j""")
def key_checks(spark, sf):
    return align.key_report(driver.seqs(spark, sf), driver.emb(spark, sf))
