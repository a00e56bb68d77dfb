"""Scoring: feature rows -> long thresholded predictions (EntryID, term, score).

Models travel to executors as one broadcast (their size is fixed by their
parameters, not by the data). Each Arrow batch is scored in numpy,
averaged across fold models, melted and thresholded *inside* the batch, so
the dense entries x labels matrix is never materialised or shuffled. The same
function works on a streaming DataFrame (``mapInArrow`` is stateless).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sigmoid_np(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-z))


@dataclass
class LinearModel:
    """probabilities = sigmoid(X W^T + b)."""
    W: np.ndarray  # (labels, features)
    b: np.ndarray  # (labels,)

    def predict(self, X: np.ndarray, tax: np.ndarray | None = None) -> np.ndarray:
        return sigmoid_np(X @ self.W.T.astype(X.dtype) + self.b.astype(X.dtype))


def features_matrix(col: pa.Array, dtype=np.float32) -> np.ndarray:
    """list<float> Arrow column -> dense (n, d) matrix (equal-length rows)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0), dtype=dtype)


def score(df: DataFrame, models: Sequence, terms: Sequence[str], threshold: float | None = 0.01,
          key: str = "EntryID", features: str = "embedding", tax_col: str | None = None,
          dtype=np.float32) -> DataFrame:
    """(EntryID, term, score float) with score > float32(threshold).

    ``models``: objects with ``predict(X, tax) -> (n, len(terms))``
    probabilities; several are averaged elementwise (fold ensemble).
    """
    from protea.session import ship
    ship(df.sparkSession)
    # one copy per executor (cached), not one per task closure: models grow
    # with labels x features and there can be thousands of scoring tasks
    bc = df.sparkSession.sparkContext.broadcast(list(models))
    names = np.asarray(list(terms), dtype=object)
    thr = None if threshold is None else np.float32(threshold)
    cols = [key, features] + ([tax_col] if tax_col else [])
    key_type = df.schema[key].dataType
    out_schema = T.StructType([T.StructField(key, key_type), T.StructField("term", T.StringType()),
                               T.StructField("score", T.FloatType())])

    def run(batches):
        models = bc.value
        for rb in batches:
            if rb.num_rows == 0:
                continue
            X = features_matrix(rb.column(features), dtype)
            tax = rb.column(tax_col).to_numpy(zero_copy_only=False) if tax_col else None
            P = models[0].predict(X, tax)
            for m in models[1:]:
                P = P + m.predict(X, tax)
            P = (P / len(models)).astype(np.float32)
            if thr is None:
                r, c = np.indices(P.shape).reshape(2, -1)
            else:
                r, c = np.nonzero(P > thr)
            yield pa.RecordBatch.from_arrays(
                [rb.column(key).take(pa.array(r)), pa.array(names[c], type=pa.string()),
                 pa.array(P[r, c], type=pa.float32())],
                names=[key, "term", "score"])

    # an entry without a feature vector gets no prediction
    return df.select(*cols).where(F.col(features).isNotNull()).mapInArrow(run, out_schema)


def melt_scores(wide: DataFrame, key: str = "EntryID", threshold: float | None = None) -> DataFrame:
    """Wide per-label score columns -> long (key, term, score) [+ threshold]."""
    from pyspark.sql import functions as F
    cols = [c for c in wide.columns if c != key]
    long = wide.select(key, *[F.col(c).cast("float").alias(c) for c in cols]).unpivot(
        [key], cols, "term", "score")
    if threshold is not None:
        long = long.where(F.col("score") > F.lit(float(threshold)).cast("float"))
    return long
