"""Label tables: wide -> long, frequencies, top-k vocabulary, class weights.

Labels live as a long table of positive pairs ``(EntryID, term)`` plus an
explicit entry set (an entry may have no positive label). Wide 0/1 tables
are melted at the scan so thousands of label columns never travel through
joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protea.operators.common import dense_index

# columns that are never labels in a wide label table
NON_LABEL_COLUMNS = ("EntryID", "original_index", "seq", "taxonomyID")


def label_columns(df: DataFrame, id_col: str = "EntryID",
                  exclude: Sequence[str] = NON_LABEL_COLUMNS) -> list[str]:
    return [c for c in df.columns if c not in exclude and c != id_col]


def melt_wide(df: DataFrame, id_col: str = "EntryID", exclude: Sequence[str] = NON_LABEL_COLUMNS,
              term: str = "term", value: str = "value") -> DataFrame:
    """(EntryID, term, value int) for every label column (schema introspection)."""
    cols = label_columns(df, id_col, exclude)
    base = df.select(id_col, *[F.col(c).cast("int").alias(c) for c in cols])
    return base.unpivot([id_col], cols, term, value)


def positives(long_labels: DataFrame, value: str = "value") -> DataFrame:
    return long_labels.where(F.col(value) == 1).select("EntryID", "term")


def label_counts(pos: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(term, pos, neg): positives per label; negatives = N - pos over the
    entry set (0/1 labels). Without ``entries`` neg is null."""
    if entries is not None:
        pos = pos.join(entries.select("EntryID").distinct(), "EntryID", "left_semi")
    counts = pos.groupBy("term").agg(F.count("*").alias("pos"))
    if entries is None:
        return counts.withColumn("neg", F.lit(None).cast("long"))
    n = entries.select("EntryID").distinct().agg(F.count("*")).scalar()
    return counts.select("term", "pos", (n - F.col("pos")).alias("neg"))


def top_k_labels(pos: DataFrame, k: int | None, entries: DataFrame | None = None) -> DataFrame:
    """Vocabulary (term, n, rank): the k most frequent labels, ties broken by
    term. Counting over ``entries`` gives the after-join variant; without it,
    every label row counts (the before-join variant). k None/<=0 -> all."""
    if entries is not None:
        pos = pos.join(entries.select("EntryID").distinct(), "EntryID", "left_semi")
    counts = pos.groupBy("term").agg(F.count("*").alias("n"))
    if k is not None and k > 0:
        # per-partition top-k then one k-row merge (TakeOrderedAndProject)
        top = counts.orderBy(F.desc("n"), F.asc("term")).limit(k)
        return dense_index(top, [F.desc("n"), F.asc("term")], "rank")
    return dense_index(counts, [F.desc("n"), F.asc("term")], "rank")


def restrict_to_vocab(pos: DataFrame, vocab: DataFrame, k: int | None = None) -> DataFrame:
    """Positive pairs whose term is in the vocabulary, with its 0-based index."""
    v = vocab.select("term", (F.col("rank") - 1).cast("int").alias("label_idx"))
    return pos.join(v, "term")


def class_weights(pos: DataFrame, entries: DataFrame, vocab: DataFrame,
                  method: str = "inverse_freq", clip_min: float = 0.1, clip_max: float = 10.0,
                  n_unit: int = 10) -> DataFrame:
    """(term, rank, pos, neg, w_pos, w_neg) per vocabulary label.

    inverse_freq: 1/max(n,1); balanced: N/(2*max(n,1)); clipped to
    [clip_min, clip_max]; the ``n_unit`` first vocabulary labels get 1.0.
    """
    if method not in ("inverse_freq", "balanced"):
        raise ValueError("method must be 'inverse_freq' or 'balanced'")
    cnt = label_counts(pos, entries)
    n_entries = entries.select("EntryID").distinct().agg(F.count("*")).scalar()
    v = (vocab.select("term", "rank").join(cnt, "term", "left")
         .withColumn("N", n_entries))
    p = F.coalesce(F.col("pos"), F.lit(0))
    ng = F.col("N") - p
    if method == "inverse_freq":
        w1, w0 = 1.0 / F.greatest(p, F.lit(1)), 1.0 / F.greatest(ng, F.lit(1))
    else:
        w1 = F.col("N") / (2.0 * F.greatest(p, F.lit(1)))
        w0 = F.col("N") / (2.0 * F.greatest(ng, F.lit(1)))
    clip = lambda w: F.least(F.greatest(w, F.lit(clip_min)), F.lit(clip_max))
    unit = F.col("rank") <= n_unit
    return v.select("term", "rank", p.alias("pos"), ng.alias("neg"),
                    F.when(unit, 1.0).otherwise(clip(w1)).alias("w_pos"),
                    F.when(unit, 1.0).otherwise(clip(w0)).alias("w_neg"))
