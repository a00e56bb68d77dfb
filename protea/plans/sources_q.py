"""File round trips: tables written the way the reference's inputs look, and
read back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from protea.operators import align, vote
from protea.operators.common import dense_index
from protea.plans.catalog import register
from protea.plans.sequences_q import SQL_SEQS
from protea.session import scratch_path
from protea.sources import driver, fasta_format, matrix, tables


def _csv(df, spark, name: str, sep: str = ",") -> str:
    path = scratch_path(spark, name)
    df.write.option("header", "true").option("sep", sep).csv(path)
    return path


@register("strict_tsv", f"""WITH {SQL_SEQS}
SELECT CAST(EntryID AS VARCHAR) AS EntryID, seq FROM seqs WHERE seq <> ''""")
def strict_tsv(spark, sf):
    s = driver.seqs(spark, sf).where("seq <> ''")
    path = _csv(s.select("EntryID", "seq", F.lit("x").alias("rest")), spark, "strict", "\t")
    return tables.read_strict_tsv3(spark, path)


@register("sequence_parquet", f"""WITH {SQL_SEQS}
SELECT EntryID, length(seq) AS n FROM seqs""")
def sequence_parquet(spark, sf):
    """A sequence file with an id column of another name and ``Seq``."""
    path = scratch_path(spark, "sequences")
    driver.seqs(spark, sf).select(F.col("EntryID").alias("id"), F.col("seq").alias("Seq"), F.lit(1).alias("other")) \
        .write.parquet(path)
    return tables.read_sequences(spark, path).select("EntryID", F.length("seq").cast("long").alias("n"))


@register("keyed_parquet", "SELECT vec_id AS EntryID, label FROM embeddings")
def keyed_parquet(spark, sf):
    """The id column is the first where neither known name is there."""
    path = scratch_path(spark, "keyed")
    driver.table(spark, sf, "embeddings").select(F.col("vec_id").alias("protein"), "label").write.parquet(path)
    return tables.read_keyed(spark, path)


@register("matrix_rows", """
WITH ids AS (SELECT vec_id AS EntryID, row_number() OVER (ORDER BY vec_id) - 1 AS row_no, embedding FROM embeddings),
v AS (SELECT EntryID, row_no, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS dim FROM ids)
SELECT EntryID, CAST(row_no AS INTEGER) AS row_no, CAST(dim AS INTEGER) AS dim,
       round(CAST(CAST(x AS FLOAT) AS DOUBLE), 6) AS value FROM v""")
def matrix_rows(spark, sf):
    """Embeddings to a matrix without ids (``.npy`` files by row number) and
    back to their ids by row number."""
    keyed = driver.table(spark, sf, "embeddings").select(F.col("vec_id").alias("EntryID"), "embedding")
    ids = dense_index(keyed.select("EntryID"), [F.col("EntryID")], "row_no", 0)
    path = scratch_path(spark, "matrix")
    matrix.write_matrix(keyed.join(ids, "EntryID"), path, row="row_no")
    back = matrix.read_matrix(spark, path, ids, row="row_no")
    return (back.select("EntryID", "row_no", F.posexplode("embedding").alias("dim", "x"))
            .select("EntryID", "row_no", "dim", F.round(F.col("x").cast("double"), 6).alias("value")))


@register("fasta_ranges", f"""WITH {SQL_SEQS}
SELECT CAST(s.EntryID AS VARCHAR) AS EntryID, seq, 'lang=' || coalesce(d.lang, '') AS description
FROM seqs s JOIN documents d ON s.EntryID = d.doc_id""")
def fasta_ranges(spark, sf):
    """The sequences as block-gzipped FASTA by the format's writer, read back in
    ranges of 1 MB that start anywhere in a block."""
    fasta_format.register(spark)
    d = driver.table(spark, sf, "documents").select(
        F.col("doc_id").alias("EntryID"), F.concat(F.lit("lang="), F.coalesce("lang", F.lit(""))).alias("description"))
    s = driver.seqs(spark, sf).join(d, "EntryID").withColumn("EntryID", F.col("EntryID").cast("string"))
    path = scratch_path(spark, "fasta-ranges")
    s.write.format("fasta").option("compression", "bgzf").mode("overwrite").save(path)
    return spark.read.format("fasta").option("range_bytes", 1 << 20).load(path)


@register("test_ids_csv", "SELECT CAST(item_id AS VARCHAR) AS EntryID FROM benchmark")
def test_ids_csv(spark, sf):
    path = _csv(driver.query_seqs(spark, sf).select(F.col("EntryID").alias("id")), spark, "test")
    return tables.read_test_ids(spark, path)


@register("taxonomy_csv", """
SELECT d.doc_id AS EntryID, coalesce(s.s_nationkey, -1) AS taxonomyID
FROM documents d LEFT JOIN supplier s ON s.s_suppkey = d.doc_id""")
def taxonomy_csv(spark, sf):
    path = _csv(driver.taxonomy(spark, sf), spark, "taxonomy")
    t = tables.read_taxonomy(spark, path)
    entries = driver.table(spark, sf, "documents").select(F.col("doc_id").alias("EntryID"))
    return align.with_taxonomy(entries, t).select("EntryID", "taxonomyID")


@register("ia_csv", """
SELECT 'D' || CAST(n_nationkey AS VARCHAR) AS term, CAST(1 + n_regionkey AS DOUBLE) AS score FROM nation""")
def ia_csv(spark, sf):
    """An IA file without the known names: the first two columns count."""
    ia = driver.ia(spark, sf)
    path = _csv(ia.select(F.col("term").alias("GO"), F.col("score").alias("IA")), spark, "ia")
    return tables.read_ia(spark, path)


@register("term_lists", """
SELECT p_partkey AS EntryID, array_to_string(list_sort([p_brand, p_type]), '|') AS terms FROM part""")
def term_lists(spark, sf):
    t = vote.term_lists(driver.terms(spark, sf))
    return t.select("EntryID", F.array_join(F.sort_array("terms"), "|").alias("terms"))
