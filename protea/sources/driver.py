"""The driver's synthetic tables, mapped onto the schemas the operators read.

Each function takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
*whole* table; nothing is sampled, filtered by id, or capped. The mapping:

* hits      lineitem: source = l_returnflag (three reference sets),
            query = l_orderkey, subject = l_partkey,
            evalue = l_discount * l_tax, bitscore = l_quantity
* terms     part: (p_partkey, p_brand) and (p_partkey, p_type)
* seqs      documents: letters only, upper-cased (strip first, then upper)
* queries   benchmark: the same cleaning; searched against ``seqs``
* emb       embeddings: (vec_id, embedding array<float>)
* labels    wide 0/1 label table ``labels`` (quality, toxic)
* emb_labels   term 'L' || label per vec_id (one positive per entry)
* emb_signs    term 'D' || j where embedding[j] > 0 (learnable multi-label)
* taxonomy  supplier: (s_suppkey, s_nationkey); entries without one get -1
* ia        nation: term 'D' || n_nationkey, weight 1 + n_regionkey
* cells     lineitem as a prediction table for the metrics
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def letters_upper(col: F.Column) -> F.Column:
    """ASCII letters only, then upper case (strip first: upper('ß') = 'SS')."""
    return F.upper(F.regexp_replace(col, "[^A-Za-z]", ""))


def hits(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("source"),
        F.col("l_orderkey").alias("query_id"),
        F.col("l_partkey").alias("subject_id"),
        (F.col("l_discount") * F.col("l_tax")).alias("evalue"),
        F.col("l_quantity").alias("bitscore"),
    )


def terms(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return (p.select(F.col("p_partkey").alias("EntryID"), F.col("p_brand").alias("term"))
            .unionByName(p.select(F.col("p_partkey").alias("EntryID"),
                                  F.col("p_type").alias("term"))))


def seqs(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("EntryID"), letters_upper(F.col("text")).alias("seq"))


def query_seqs(spark, sf_dir) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("EntryID"), letters_upper(F.col("text")).alias("seq"))


def emb(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("EntryID"), "embedding")


def wide_labels(spark, sf_dir) -> DataFrame:
    lb = table(spark, sf_dir, "labels")
    return lb.select(F.col("doc_id").alias("EntryID"), "quality", "toxic")


def emb_labels(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("EntryID"),
                    F.concat(F.lit("L"), F.col("label").cast("string")).alias("term"))


def emb_signs(spark, sf_dir, n_dims: int | None = None) -> DataFrame:
    """Positive pairs (EntryID, 'D'||j) for embedding[j] > 0, j < n_dims."""
    e = table(spark, sf_dir, "embeddings")
    x = e.select(F.col("vec_id").alias("EntryID"), F.posexplode("embedding").alias("j", "v"))
    cond = F.col("v") > 0
    if n_dims is not None:
        cond = cond & (F.col("j") < n_dims)
    return x.where(cond).select("EntryID", F.concat(F.lit("D"), F.col("j").cast("string")).alias("term"))


def taxonomy(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("EntryID"),
                    F.col("s_nationkey").cast("long").alias("taxonomyID"))


def ia(spark, sf_dir, prefix: str = "D") -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit(prefix), F.col("n_nationkey").cast("string")).alias("term"),
                    (F.lit(1.0) + F.col("n_regionkey")).alias("score"))


def cells(spark, sf_dir) -> DataFrame:
    """Prediction cells: (EntryID, term, score float, y boolean)."""
    return cells_of(table(spark, sf_dir, "lineitem"))


def cells_of(li: DataFrame) -> DataFrame:
    """The cells of some rows of lineitem."""
    return li.select(
        F.col("l_orderkey").alias("EntryID"),
        F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("term"),
        (F.col("l_discount") * 10).cast("float").alias("score"),
        (F.col("l_returnflag") == "R").alias("y"),
    )


def logit_cells(spark, sf_dir) -> DataFrame:
    """Dense logit matrix from embeddings: every (vec, dim) cell, target = the
    entry's label parity equals the dim parity. (EntryID, term, logit, y)."""
    e = table(spark, sf_dir, "embeddings")
    x = e.select(F.col("vec_id").alias("EntryID"), "label",
                 F.posexplode("embedding").alias("j", "v"))
    return x.select(
        "EntryID",
        F.concat(F.lit("D"), F.col("j").cast("string")).alias("term"),
        (F.col("v").cast("double") * 3.0).alias("logit"),
        (F.pmod(F.col("label"), F.lit(2)) == F.pmod(F.col("j"), F.lit(2))).cast("double").alias("y"),
    )
