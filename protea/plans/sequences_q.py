"""Sequence cleaning, chunking, dedupe and FASTA round-trip queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from protea.functions import seq as S
from protea.operators import seqops
from protea.plans.catalog import register
from protea.session import scratch_path
from protea.sources import driver, fasta

SQL_SEQS = """seqs AS (
  SELECT doc_id AS EntryID, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq
  FROM documents)"""
SQL_CLEAN = """CASE WHEN coalesce(seq, '') = '' THEN 'X' ELSE translate(seq, 'UZOB', 'XXXX') END"""


@register("seq_clean", f"""WITH {SQL_SEQS}
SELECT EntryID, {SQL_CLEAN} AS seq FROM seqs""")
def seq_clean(spark, sf):
    s = driver.seqs(spark, sf)
    return s.select("EntryID", S.clean("seq").alias("seq"))


@register("seq_space", f"""WITH {SQL_SEQS}
SELECT EntryID, rtrim(regexp_replace({SQL_CLEAN}, '(.)', '\\1 ', 'g'), ' ') AS seq FROM seqs""")
def seq_space(spark, sf):
    s = driver.seqs(spark, sf)
    return s.select("EntryID", S.spaced("seq").alias("seq"))


@register("seq_truncate", f"""WITH {SQL_SEQS}
SELECT EntryID, substring({SQL_CLEAN}, 1, 1022) AS seq FROM seqs""")
def seq_truncate(spark, sf):
    s = driver.seqs(spark, sf)
    return s.select("EntryID", S.truncate(S.clean("seq"), 1024, 2).alias("seq"))


@register("seq_prefix_chunk", f"""WITH {SQL_SEQS},
p AS (SELECT EntryID, '[NLU]' || {SQL_CLEAN} AS t FROM seqs),
j AS (SELECT EntryID, t, unnest(generate_series(0, (length(t) - 1) // 2048)) AS j FROM p)
SELECT EntryID, CAST(j AS INTEGER) AS chunk_idx,
       CAST((length(t) - 1) // 2048 + 1 AS INTEGER) AS n_chunks,
       length(t) >= 2048 AS is_long,
       substring(t, CAST(j * 2048 + 1 AS BIGINT), 2048) AS chunk
FROM j""")
def seq_prefix_chunk(spark, sf):
    s = driver.seqs(spark, sf).select("EntryID", S.prefixed("seq").alias("t"))
    s = s.withColumn("is_long", S.is_long("t", 2048))
    c = seqops.explode_chunks(s, "t", 2048, keep=("EntryID", "is_long"))
    return c.select("EntryID", "chunk_idx", "n_chunks", "is_long", "chunk")


@register("seq_dedupe", f"""WITH {SQL_SEQS},
annotated AS (SELECT s.EntryID, s.seq FROM seqs s JOIN labels l ON s.EntryID = l.doc_id),
both_sets AS (SELECT * FROM seqs UNION ALL SELECT * FROM annotated)
SELECT DISTINCT EntryID, seq FROM both_sets""")
def seq_dedupe(spark, sf):
    # the full sequence file concatenated with the annotated subset: every
    # annotated record appears twice and must come out once
    s = driver.seqs(spark, sf)
    ann = s.join(driver.wide_labels(spark, sf).select("EntryID"), "EntryID", "left_semi")
    return seqops.dedupe(s.unionByName(ann))


@register("seq_dedupe_report", f"""WITH {SQL_SEQS},
annotated AS (SELECT s.EntryID, s.seq FROM seqs s JOIN labels l ON s.EntryID = l.doc_id),
both_sets AS (SELECT * FROM seqs UNION ALL SELECT * FROM annotated)
SELECT (SELECT count(*) FROM both_sets) AS n_in,
       (SELECT count(*) FROM (SELECT DISTINCT EntryID, seq FROM both_sets)) AS n_out,
       (SELECT count(*) FROM both_sets) <> (SELECT count(*) FROM (SELECT DISTINCT EntryID, seq FROM both_sets))
         AS has_duplicates""")
def seq_dedupe_report(spark, sf):
    s = driver.seqs(spark, sf)
    ann = s.join(driver.wide_labels(spark, sf).select("EntryID"), "EntryID", "left_semi")
    return seqops.dedupe_report(s.unionByName(ann))


@register("fasta_records", f"""WITH {SQL_SEQS}
SELECT CAST(EntryID AS VARCHAR) AS EntryID, seq FROM seqs""")
def fasta_records(spark, sf):
    """Write the sequence table as FASTA with 'db|id|name desc' headers into the
    shared scratch folder, then scan it back with header parsing."""
    s = driver.seqs(spark, sf)
    d = driver.table(spark, sf, "documents").select(F.col("doc_id").alias("EntryID"), "source", "lang")
    s = s.join(d, "EntryID")
    path = scratch_path(spark, "fasta")
    hdr = F.concat_ws("|", F.lit("sp"), F.col("EntryID").cast("string"), F.col("source"))
    fasta.write_fasta(s, path, header=F.concat(hdr, F.lit(" lang="), F.col("lang")))
    return fasta.read_fasta(spark, path, has_metadata=True)
