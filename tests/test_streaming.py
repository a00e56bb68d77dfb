"""Streaming scoring equals batch scoring on the same rows."""

import os

import numpy as np

from paths import SF_SMALL
from protea.operators import score
from protea.streaming import start_prediction_stream


def test_stream_scores_like_batch(spark, tmpdir_path):
    src = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").selectExpr("vec_id AS EntryID", "embedding")
    m = score.LinearModel(np.eye(64)[:4], np.zeros(4))
    terms = ["a", "b", "c", "d"]
    out = os.path.join(tmpdir_path, "pred")
    q = start_prediction_stream(spark, SF_SMALL, "vec_id long, embedding array<float>, label int", [m], terms,
                                out, glob="embeddings.parquet", key="vec_id")
    q.awaitTermination(120)
    # the stream reads vec_id; batch on the same rows
    streamed = spark.read.parquet(out)
    batch = score.score(src.withColumnRenamed("EntryID", "vec_id"), [m], terms, 0.01, key="vec_id")
    a = sorted(map(tuple, streamed.select("vec_id", "term", "score").collect()))
    b = sorted(map(tuple, batch.collect()))
    assert a == b and len(a) > 0


def test_stream_restart_is_exactly_once(spark, tmpdir_path):
    m = score.LinearModel(np.eye(64)[:2], np.zeros(2))
    out = os.path.join(tmpdir_path, "pred")
    ckpt = os.path.join(tmpdir_path, "ckpt")
    schema = "vec_id long, embedding array<float>, label int"
    for _ in range(2):  # second start resumes from the checkpoint: nothing new
        q = start_prediction_stream(spark, SF_SMALL, schema, [m], ["a", "b"], out,
                                    checkpoint=ckpt, glob="embeddings.parquet", key="vec_id")
        q.awaitTermination(120)
        n = spark.read.parquet(out).count()
    first = spark.read.parquet(out).select("vec_id", "term").distinct().count()
    assert n == first > 0
