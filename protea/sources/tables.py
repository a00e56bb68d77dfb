"""Delimited-text and Parquet scans, and the table sinks.

All scans take explicit schemas (no inference pass over the data) and an
explicit ``nullValue`` so that identifiers such as ``NA`` stay strings.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protea.functions.math import half_precision
from protea.operators.align import id_column

# similarity-hit table: header-less TSV with these 12 columns
HITS_SCHEMA = T.StructType([
    T.StructField("query_id", T.StringType()),
    T.StructField("subject_id", T.StringType()),
    T.StructField("pid", T.DoubleType()),
    T.StructField("aln_len", T.IntegerType()),
    T.StructField("mismatch", T.IntegerType()),
    T.StructField("gap", T.IntegerType()),
    T.StructField("qstart", T.IntegerType()),
    T.StructField("qend", T.IntegerType()),
    T.StructField("sstart", T.IntegerType()),
    T.StructField("send", T.IntegerType()),
    T.StructField("evalue", T.DoubleType()),
    T.StructField("bitscore", T.DoubleType()),
])

def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop FileSystem of the path (local, HDFS,
    object stores alike)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def _missing(path: str, what: str, required: bool):
    if required:
        raise FileNotFoundError(f"{what} not found: {path}")
    print(f"SKIP: missing {what} {path}")
    return None


def _csv(spark: SparkSession, sep: str, header: bool, schema=None, null_value: str = "",
         mode: str = "PERMISSIVE"):
    r = (spark.read.option("sep", sep).option("header", str(header).lower())
         .option("nullValue", null_value).option("mode", mode))
    if schema is not None:
        r = r.schema(schema)
    return r


def read_tsv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Tab-separated table with a header line. Without a schema every column is
    a string (no inference scan); cast downstream as needed."""
    if schema is None:
        return _csv(spark, "\t", True).option("inferSchema", "false").csv(path)
    return _csv(spark, "\t", True, schema).csv(path)


def read_strict_tsv3(spark: SparkSession, path: str,
                     names: tuple[str, str] = ("EntryID", "seq")) -> DataFrame:
    """Header + exactly three tab-separated fields per line; keep the first two.
    A line with another field count fails the job; an empty third field fails
    too (stripping the line would have removed it)."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("_a", "_b", "_c")])
    df = _csv(spark, "\t", True, schema, mode="FAILFAST").csv(path)
    c = F.col("_c")
    return df.select(
        F.col("_a").alias(names[0]),
        F.when(c.isNull() | (F.trim(c) == ""),
               F.raise_error(F.concat(F.lit("expected 3 fields, line of "), F.col("_a"))))
         .otherwise(F.col("_b")).alias(names[1]),
    )


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Header-less 12-column hit table (the aligner's tabular output). A folder
    of ``source=NAME`` folders gives the set of each hit as ``source``."""
    return _csv(spark, "\t", False, HITS_SCHEMA).csv(path)


def read_terms(spark: SparkSession, path: str, csv: bool = False) -> DataFrame:
    """Annotation table with header, ``EntryID`` and ``term`` columns; comma or
    tab separated. Stays a long table (no per-entry lists)."""
    df = _csv(spark, "," if csv else "\t", True).csv(path)
    missing = {"EntryID", "term"} - set(df.columns)
    if missing:
        raise ValueError(f"term table {path} lacks columns {sorted(missing)}")
    return df.select("EntryID", "term")


def read_sequences(spark: SparkSession, path: str, id_col: str | None = None,
                   seq_col: str = "seq", required: bool = True) -> DataFrame | None:
    """Parquet sequence table projected to (EntryID, seq); column pruning and
    any later filter reach the scan. The sequence column may be ``Seq``; the
    id column is found like ``read_keyed`` does unless it is named.
    A missing input is skipped (None) unless ``required``."""
    if not path_exists(spark, path):
        return _missing(path, "sequence file", required)
    df = spark.read.parquet(path)
    if seq_col not in df.columns and seq_col.capitalize() in df.columns:
        seq_col = seq_col.capitalize()
    return df.select(F.col(id_col or id_column(df)).alias("EntryID"), F.col(seq_col).alias("seq"))


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table with its id column (``EntryID``, else ``id``, else the
    first) named ``EntryID``: embedding and label files."""
    df = spark.read.parquet(path)
    return df.withColumnRenamed(id_column(df), "EntryID")


def read_test_ids(spark: SparkSession, path: str) -> DataFrame | None:
    """Test entry list (CSV with header); ``id`` is renamed to ``EntryID``.
    No file -> None (nothing to predict)."""
    if not path_exists(spark, path):
        return _missing(path, "test file", False)
    df = _csv(spark, ",", True).csv(path)
    return df.withColumnRenamed("id", "EntryID") if "id" in df.columns else df


def read_taxonomy(spark: SparkSession, path: str, required: bool = True) -> DataFrame | None:
    """Taxonomy CSV; ``EntryID`` and ``taxonomyID`` are required columns. The
    training taxonomy is mandatory; a missing optional one (test side) gives
    None, which ``align.with_taxonomy`` turns into -1 for every entry."""
    if not path_exists(spark, path):
        return _missing(path, "taxonomy file", required)
    df = _csv(spark, ",", True).csv(path)
    if "EntryID" not in df.columns or "taxonomyID" not in df.columns:
        raise ValueError(f"{path}: a taxonomy table needs EntryID and taxonomyID, found {df.columns}")
    return df.select("EntryID", F.col("taxonomyID").cast("long").alias("taxonomyID"))


def normalise_ia(df: DataFrame) -> DataFrame:
    """(term, score): if the names are absent, the first two columns are used."""
    cols = df.columns
    term = "term" if "term" in cols else cols[0]
    score = "score" if "score" in cols else cols[1]
    return df.select(F.col(term).cast("string").alias("term"),
                     F.col(score).cast("double").alias("score"))


def read_ia(spark: SparkSession, path: str) -> DataFrame | None:
    """IA weights (term, score); no file -> None (equal weights downstream)."""
    if not path_exists(spark, path):
        return _missing(path, "IA file", False)
    return normalise_ia(_csv(spark, ",", True).csv(path))


# ---------------------------------------------------------------- sinks

@F.pandas_udf(T.StringType())
def _fmt6(s: pd.Series) -> pd.Series:
    # Python/C printf rounding of the exact binary value; Spark's
    # format_string rounds the decimal rendering half-up, which differs.
    a = s.to_numpy(dtype="float64", na_value=np.nan)
    out = np.char.mod("%.6f", a).astype(object)
    out[np.isnan(a)] = None
    return pd.Series(out)


def format_scores(scores: DataFrame, query_col: str = "query_id", term_col: str = "term",
                  score_col: str = "score") -> DataFrame:
    """(query_id, GO_term, score '%.6f') rows, the submission format."""
    from protea.session import ship
    ship(scores.sparkSession)
    return scores.select(F.col(query_col).cast("string").alias("query_id"),
                         F.col(term_col).alias("GO_term"),
                         _fmt6(F.col(score_col)).alias("score"))


def write_scores_tsv(scores: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tab-separated submission with header ``query_id GO_term score``."""
    (format_scores(scores).write.mode(mode).option("sep", "\t").option("header", "true")
     .csv(path))


def write_predictions(pred: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Long prediction table (EntryID, term, score float), snappy Parquet.
    Tasks stream their rows; there is no driver-side chunk loop."""
    (pred.select(F.col("EntryID"), F.col("term"), F.col("score").cast("float"))
     .write.mode(mode).option("compression", "snappy").parquet(path))


def write_embeddings(emb: DataFrame, path: str, mode: str = "overwrite", half: bool = False) -> None:
    """Keyed embedding table (EntryID, embedding array<float>); ``half``: the
    values rounded to half precision first."""
    vec = F.transform("embedding", half_precision) if half else F.col("embedding")
    (emb.select("EntryID", vec.cast("array<float>").alias("embedding"))
     .write.mode(mode).option("compression", "snappy").parquet(path))
