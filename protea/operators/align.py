"""Building aligned training/test tables by key (never by row position).

sequence ⋈ label entries ⋈ embeddings (inner), taxonomy left-joined with
-1 for missing, a dense taxonomy vocabulary (0 = unknown), IA weights per
label, and key checks that replace the reference's length-equality test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from protea.operators.common import dense_index

MISSING_TAXON = -1


def key_report(left: DataFrame, right: DataFrame, key: str = "EntryID") -> DataFrame:
    """One row: n_left, n_right, dup_left, dup_right, left_only, right_only.
    One full-outer join of per-key counts (both sides pre-aggregated)."""
    lc = left.groupBy(key).agg(F.count("*").alias("cl"))
    rc = right.groupBy(key).agg(F.count("*").alias("cr"))
    j = lc.join(rc, key, "full_outer")
    return j.agg(F.coalesce(F.sum("cl"), F.lit(0)).alias("n_left"),
                 F.coalesce(F.sum("cr"), F.lit(0)).alias("n_right"),
                 F.count_if(F.col("cl") > 1).alias("dup_left"),
                 F.count_if(F.col("cr") > 1).alias("dup_right"),
                 F.count_if(F.col("cr").isNull()).alias("left_only"),
                 F.count_if(F.col("cl").isNull()).alias("right_only"))


def assert_aligned(left: DataFrame, right: DataFrame, key: str = "EntryID") -> None:
    """Raise ValueError unless both sides have the same unique keys."""
    r = key_report(left, right, key).first()
    bad = {k: r[k] for k in ("dup_left", "dup_right", "left_only", "right_only") if r[k]}
    if bad:
        raise ValueError(f"Mismatch: {r['n_left']} vs {r['n_right']} rows; {bad}")


def with_taxonomy(entries: DataFrame, taxonomy: DataFrame | None, key: str = "EntryID",
                  tax_key: str = "EntryID") -> DataFrame:
    """Left join taxonomy, missing -> -1 (int). No table -> all -1.
    Duplicate taxonomy rows fan out (check with ``key_report``)."""
    if taxonomy is None or "taxonomyID" not in taxonomy.columns or tax_key not in taxonomy.columns:
        return entries.withColumn("taxonomyID", F.lit(MISSING_TAXON).cast("long"))
    t = taxonomy.select(F.col(tax_key).alias("_tk"), F.col("taxonomyID").cast("long").alias("_tax"))
    j = entries.join(t, entries[key] == t["_tk"], "left").drop("_tk")
    return (j.withColumn("taxonomyID", F.coalesce(F.col("_tax"), F.lit(MISSING_TAXON).cast("long")))
            .drop("_tax"))


def taxonomy_vocab(aligned: DataFrame) -> DataFrame:
    """(taxonomyID, taxonomy_idx): distinct known taxonomies indexed from 1 in
    taxonomyID order (a table has no row order); 0 is reserved for unknown."""
    d = aligned.where(F.col("taxonomyID") != MISSING_TAXON).select("taxonomyID").distinct()
    return dense_index(d, [F.asc("taxonomyID")], "taxonomy_idx", start=1)


def index_taxonomy(df: DataFrame, vocab: DataFrame) -> DataFrame:
    """Map taxonomyID -> taxonomy_idx; unseen or missing -> 0."""
    j = df.join(vocab, "taxonomyID", "left")
    return j.withColumn("taxonomy_idx", F.coalesce(F.col("taxonomy_idx"), F.lit(0)))


def ia_weights(vocab: DataFrame, ia: DataFrame | None, default: float = 1.0,
               on_duplicate: str = "error", order: str | None = None) -> DataFrame:
    """(term, weight) for every vocabulary term; missing -> ``default``.
    Duplicate terms in the IA table: 'error' raises, 'max' keeps the largest,
    'last' keeps the row with the largest value of the column ``order`` (a
    table has no row order of its own; two rows of a term that share that value
    are an error, unless they have the same score)."""
    if on_duplicate not in ("error", "max", "last"):
        raise ValueError(f"on_duplicate: {on_duplicate}")
    if on_duplicate == "last" and order is None:
        raise ValueError("the last of several rows needs a column to order them by")
    v = vocab.select("term").distinct()
    if ia is None:
        return v.withColumn("weight", F.lit(float(default)))
    if on_duplicate == "last":
        g = ia.groupBy("term", order).agg(F.min("score").alias("_s"), F.max("score").alias("_t"))
        one = F.when(F.col("_s").eqNullSafe(F.col("_t")), F.col("_s")) \
               .otherwise(F.raise_error(F.concat(F.lit("no last one of the rows of IA term "), F.col("term"))).cast("double"))
        g = g.groupBy("term").agg(F.count("*").alias("_n"), F.max(F.struct(order, F.col("_s").alias("_s"), F.col("_t").alias("_t"))).alias("_x"))
        g = g.select("term", "_n", F.col("_x._s").alias("_s"), F.col("_x._t").alias("_t")).select("term", "_n", one.alias("_s"))
    else:
        g = ia.groupBy("term").agg(F.count("*").alias("_n"), F.max("score").alias("_s"))
    if on_duplicate == "error":
        s = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate IA term "), F.col("term")))) \
             .otherwise(F.col("_s"))
    else:
        s = F.col("_s")
    g = g.select("term", s.cast("double").alias("_w"))
    return v.join(g, "term", "left").select("term", F.coalesce("_w", F.lit(float(default))).alias("weight"))


def align_training(seqs: DataFrame, label_entries: DataFrame, emb: DataFrame,
                   taxonomy: DataFrame | None = None, key: str = "EntryID") -> DataFrame:
    """(EntryID, seq, taxonomyID, embedding): sequences inner-joined with the
    label table's entries (duplicates fan out) and the embeddings by key."""
    le = label_entries.select(key)
    # selective inner joins first, then the taxonomy left join on the
    # (smaller) aligned rows: same result, fewer rows through the shuffle
    a = seqs.join(le, key, "inner").join(emb.select(key, "embedding"), key, "inner")
    return with_taxonomy(a, taxonomy, key) if taxonomy is not None else a


def labels_array(aligned: DataFrame, pos_idx: DataFrame) -> DataFrame:
    """Attach ``label_idx array<int>``: the sorted vocabulary indices of each
    entry's positive labels (bounded by the vocabulary size per entry)."""
    per = pos_idx.groupBy("EntryID").agg(F.array_sort(F.collect_set("label_idx")).alias("label_idx"))
    j = aligned.join(per, "EntryID", "left")
    return j.withColumn("label_idx", F.coalesce(F.col("label_idx"), F.array().cast("array<int>")))


__all__ = ["key_report", "assert_aligned", "with_taxonomy", "taxonomy_vocab", "index_taxonomy",
           "ia_weights", "align_training", "labels_array", "id_column"]


def id_column(df: DataFrame) -> str:
    """The entry-id column: ``EntryID``, else ``id``, else the first column."""
    if "EntryID" in df.columns:
        return "EntryID"
    if "id" in df.columns:
        return "id"
    return df.columns[0]
