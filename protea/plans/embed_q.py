"""Embedding and scoring queries over the driver tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from protea.functions import seq as S
from protea.operators import embed, score
from protea.plans.catalog import register
from protea.plans.sequences_q import SQL_CLEAN, SQL_SEQS
from protea.sources import driver

N_DIMS = 64  # embedding width of the driver's table


def _long_nonzero(df, col="embedding"):
    x = df.select("EntryID", F.posexplode(col).alias("dim", "value"))
    return x.where(F.col("value") != 0).select("EntryID", F.col("dim").cast("int").alias("dim"),
                                              F.round(F.col("value").cast("double"), 6).alias("value"))


@register("kmer_embed", f"""WITH {SQL_SEQS},
c AS (SELECT EntryID, {SQL_CLEAN} AS s FROM seqs),
w AS (SELECT EntryID, s, unnest(generate_series(1, length(s) - 1)) AS i FROM c WHERE length(s) >= 2),
k AS (SELECT EntryID, substring(s, CAST(i AS BIGINT), 2) AS km FROM w),
v AS (SELECT * FROM k WHERE regexp_full_match(km, '[A-Z]{{2}}')),
n AS (SELECT EntryID, count(*) AS total FROM v GROUP BY EntryID)
SELECT v.EntryID,
       CAST((ascii(km[1]) - 65) * 26 + (ascii(km[2]) - 65) AS INTEGER) AS dim,
       round(count(*) / max(n.total), 6) AS value
FROM v JOIN n ON v.EntryID = n.EntryID
GROUP BY v.EntryID, km""")
def kmer_embed(spark, sf):
    s = driver.seqs(spark, sf).select("EntryID", S.clean("seq").alias("seq"))
    return embed.kmer_table(s, 2).withColumn("value", F.round("value", 6))


@register("chunk_mean", f"""WITH {SQL_SEQS},
p AS (SELECT EntryID, '[NLU]' || {SQL_CLEAN} AS t FROM seqs),
j AS (SELECT EntryID, t, (length(t) - 1) // 2048 + 1 AS n_chunks,
             unnest(generate_series(0, (length(t) - 1) // 2048)) AS j FROM p),
ch AS (SELECT EntryID, n_chunks, j, substring(t, CAST(j * 2048 + 1 AS BIGINT), 2048) AS c FROM j),
pos AS (SELECT EntryID, n_chunks, j, c, unnest(generate_series(1, length(c))) AS i FROM ch),
let AS (SELECT EntryID, n_chunks, j, substring(c, CAST(i AS BIGINT), 1) AS ch FROM pos),
v AS (SELECT * FROM let WHERE ch BETWEEN 'A' AND 'Z'),
tot AS (SELECT EntryID, j, count(*) AS total FROM v GROUP BY EntryID, j),
f AS (SELECT v.EntryID, max(v.n_chunks) AS n_chunks, v.j, v.ch, count(*) / max(tot.total) AS freq
      FROM v JOIN tot ON v.EntryID = tot.EntryID AND v.j = tot.j GROUP BY v.EntryID, v.j, v.ch)
SELECT EntryID, CAST(ascii(ch) - 65 AS INTEGER) AS dim, round(sum(freq) / max(n_chunks), 6) AS value
FROM f GROUP BY EntryID, ch""")
def chunk_mean(spark, sf):
    s = driver.seqs(spark, sf).select("EntryID", S.prefixed("seq").alias("seq"))
    e = embed.embed_long(s, lambda c: embed.kmer_composition(c, 1, dtype="double"), "seq", 2048)
    return _long_nonzero(e)


SQL_TABLE_MODEL = f"""WITH {SQL_SEQS},
c AS (SELECT EntryID, {SQL_CLEAN} AS s FROM seqs),
l AS (SELECT EntryID, s, unnest(generate_series(1, 26)) AS c FROM c),
n AS (SELECT EntryID, c, length(s) - length(replace(s, chr(CAST(64 + c AS INTEGER)), '')) AS n FROM l),
d AS (SELECT EntryID, c, n, unnest(generate_series(0, 7)) AS d FROM n)
SELECT EntryID, CAST(d AS INTEGER) AS dim,
       round(CAST(CAST(CASE WHEN sum(n) > 0 THEN sum(n * (c * (d + 3) % 11)) / sum(n) ELSE 0 END AS FLOAT) AS DOUBLE), 4) AS value
FROM d GROUP BY EntryID, d"""


@register("batch_embed", SQL_TABLE_MODEL)
def batch_embed(spark, sf):
    """A batch model through predict_batch_udf on length-sorted partitions,
    over whole texts; its integer table lets SQL state the result."""
    s = driver.seqs(spark, sf).select("EntryID", S.clean("seq").alias("seq"))
    e = embed.embed(s, embed.table_model(8), dim=8, batch_size=64)
    return e.select("EntryID", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 4))


@register("token_embed", SQL_TABLE_MODEL)
def token_embed(spark, sf):
    """The same model by tokens, in batches of padded cells, masked mean."""
    s = driver.seqs(spark, sf).select("EntryID", S.clean("seq").alias("seq"))
    e = embed.embed_tokens(s, embed.table_token_model(8))
    return e.select("EntryID", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 4))


def _shift_model(shift: int, d: int = N_DIMS) -> score.LinearModel:
    W = np.zeros((d, d))
    W[np.arange(d), (np.arange(d) + shift) % d] = 1.0
    return score.LinearModel(W, np.zeros(d))


TERMS_D = [f"D{j}" for j in range(N_DIMS)]

SQL_SIG = """ex AS (
  SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings)"""


@register("score_threshold", f"""WITH {SQL_SIG},
p AS (SELECT vec_id AS EntryID, 'D' || CAST(j AS VARCHAR) AS term,
             CAST(1.0 / (1.0 + exp(-CAST(v AS DOUBLE))) AS FLOAT) AS score FROM ex)
SELECT EntryID, term, round(CAST(score AS DOUBLE), 6) AS score FROM p WHERE score > CAST(0.01 AS FLOAT)""")
def score_threshold(spark, sf):
    p = score.score(driver.emb(spark, sf), [_shift_model(0)], TERMS_D, 0.01, dtype=np.float64)
    return p.select("EntryID", "term", F.round(F.col("score").cast("double"), 6).alias("score"))


@register("fold_mean", f"""WITH {SQL_SIG},
sig AS (SELECT vec_id, j, 1.0 / (1.0 + exp(-CAST(v AS DOUBLE))) AS p FROM ex),
folds AS (SELECT range AS f FROM range(0, 5)),
m AS (SELECT s.vec_id AS EntryID, (s.j - f.f + 64) % 64 AS label, avg(s.p) AS p
      FROM sig s, folds f GROUP BY s.vec_id, (s.j - f.f + 64) % 64),
q AS (SELECT EntryID, 'D' || CAST(label AS VARCHAR) AS term, CAST(p AS FLOAT) AS score FROM m)
SELECT EntryID, term, round(CAST(score AS DOUBLE), 6) AS score FROM q WHERE score > CAST(0.01 AS FLOAT)""")
def fold_mean(spark, sf):
    """Five fold models (label j reads feature j+f) averaged inside the batch."""
    models = [_shift_model(f) for f in range(5)]
    p = score.score(driver.emb(spark, sf), models, TERMS_D, 0.01, dtype=np.float64)
    return p.select("EntryID", "term", F.round(F.col("score").cast("double"), 6).alias("score"))


@register("predictions_parquet", f"""WITH {SQL_SIG},
p AS (SELECT vec_id AS EntryID, 'D' || CAST(j AS VARCHAR) AS term,
             CAST(1.0 / (1.0 + exp(-CAST(v AS DOUBLE))) AS FLOAT) AS score FROM ex)
SELECT CAST(EntryID AS VARCHAR) AS EntryID, term, round(CAST(score AS DOUBLE), 6) AS score
FROM p WHERE score > CAST(0.01 AS FLOAT)""")
def predictions_parquet(spark, sf):
    """Score, write the long prediction table (snappy Parquet), read it back."""
    from protea.session import scratch_path
    from protea.sources import tables
    p = score.score(driver.emb(spark, sf), [_shift_model(0)], TERMS_D, 0.01, dtype=np.float64)
    path = scratch_path(spark, "predictions")
    tables.write_predictions(p.withColumn("EntryID", F.col("EntryID").cast("string")), path)
    back = spark.read.parquet(path)
    return back.select("EntryID", "term", F.round(F.col("score").cast("double"), 6).alias("score"))


@register("embeddings_parquet", f"""WITH {SQL_SEQS},
c AS (SELECT EntryID, {SQL_CLEAN} AS s FROM seqs),
pos AS (SELECT EntryID, unnest(generate_series(1, length(s))) AS i, s FROM c),
let AS (SELECT EntryID, substring(s, CAST(i AS BIGINT), 1) AS ch FROM pos),
v AS (SELECT * FROM let WHERE ch BETWEEN 'A' AND 'Z'),
n AS (SELECT EntryID, count(*) AS total FROM v GROUP BY EntryID)
SELECT v.EntryID, CAST(ascii(ch) - 65 AS INTEGER) AS dim,
       round(CAST(CAST(count(*) / max(n.total) AS FLOAT) AS DOUBLE), 6) AS value
FROM v JOIN n ON v.EntryID = n.EntryID GROUP BY v.EntryID, ch""")
def embeddings_parquet(spark, sf):
    """Default embedder (letter composition, float32 at rest) -> embedding
    Parquet sink -> read back."""
    from protea.session import scratch_path
    from protea.sources import tables
    s = driver.seqs(spark, sf).select("EntryID", S.clean("seq").alias("seq"))
    path = scratch_path(spark, "embeddings")
    tables.write_embeddings(embed.composition(s, k=1), path)
    return _long_nonzero(spark.read.parquet(path))
