"""Sequence-table operators: dedupe, chunk explosion, length regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def dedupe(df: DataFrame, keys=("EntryID", "seq")) -> DataFrame:
    """Drop records repeated on (id, sequence). Rows equal on the key are
    identical, so which copy survives is immaterial. A hash aggregate with a
    map-side partial step: copies of a hot record collapse before the shuffle."""
    return df.dropDuplicates(list(keys))


def dedupe_report(df: DataFrame, keys=("EntryID", "seq")) -> DataFrame:
    """One row (n_in, n_out, has_duplicates) from one grouped pass: the group
    sizes sum to n_in, the number of groups is n_out."""
    g = df.groupBy(*keys).agg(F.count("*").alias("_c"))
    return (g.agg(F.sum("_c").alias("n_in"), F.count("*").alias("n_out"))
            .select(F.coalesce("n_in", F.lit(0)).cast("long").alias("n_in"), "n_out")
            .withColumn("has_duplicates", F.col("n_in") != F.col("n_out")))


def explode_chunks(df: DataFrame, seq_col: str = "seq", size: int = 2048,
                   keep: tuple[str, ...] = ("EntryID",)) -> DataFrame:
    """(keep..., chunk_idx, n_chunks, chunk): one row per fixed-stride chunk.
    Rows stay in their partition (no shuffle); chunks of one long text spread
    the following per-chunk work evenly."""
    # cut by a pattern: one pass over the text, however many chunks
    s = F.col(seq_col)
    chunks = F.when(F.length(s) > 0, F.regexp_extract_all(s, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))).otherwise(F.array(s))
    x = df.select(*keep, chunks.alias("_c")).withColumn("n_chunks", F.size("_c"))
    return x.select(*keep, "n_chunks", F.posexplode("_c").alias("chunk_idx", "chunk")) \
            .select(*keep, "chunk_idx", "n_chunks", "chunk")
