"""End-to-end workflows on files derived from the driver tables (sf0.001)."""

import os

import pytest

from pyspark.sql import functions as F

from paths import SF_SMALL
from protea.plans import workflows
from protea.sources import driver, fasta


def test_homology_vote_from_fasta_and_hits(spark, tmpdir_path):
    seqs = driver.seqs(spark, SF_SMALL)
    q = driver.query_seqs(spark, SF_SMALL)
    qf, rf = os.path.join(tmpdir_path, "q.fa"), os.path.join(tmpdir_path, "r.fa")
    fasta.write_fasta(q, qf)
    fasta.write_fasta(seqs, rf)
    terms = os.path.join(tmpdir_path, "terms.tsv")
    d = driver.table(spark, SF_SMALL, "documents")
    d.select(F.col("doc_id").cast("string").alias("EntryID"), F.col("lang").alias("term")) \
        .write.option("sep", "\t").option("header", "true").csv(terms)
    # second reference set given as a precomputed hit table
    hits = os.path.join(tmpdir_path, "hits")
    h = driver.hits(spark, SF_SMALL).where("source = 'A'")
    h.select(F.col("query_id").cast("string"), F.col("subject_id").cast("string"), F.lit(100.0), F.lit(1),
             F.lit(0), F.lit(0), F.lit(1), F.lit(1), F.lit(1), F.lit(1), "evalue", "bitscore") \
        .write.option("sep", "\t").csv(hits)
    pterms = os.path.join(tmpdir_path, "pterms.tsv")
    driver.terms(spark, SF_SMALL).select(F.col("EntryID").cast("string"), "term") \
        .write.option("sep", "\t").option("header", "true").csv(pterms)
    out = os.path.join(tmpdir_path, "submission")
    merged = workflows.homology_vote(spark, qf, [workflows.ReferenceSet("docs", terms, fasta=rf),
                                                 workflows.ReferenceSet("parts", pterms, hits=hits)], out)
    n = merged.count()
    back = spark.read.option("sep", "\t").option("header", "true").csv(out)
    assert back.columns == ["query_id", "GO_term", "score"] and back.count() == n > 0
    # every benchmark passage is found in the documents and gets its language
    assert merged.where(F.col("term").isin("en", "de", "fr", "es")).select("query_id").distinct().count() > 0


def test_homology_vote_reads_each_record_once(spark, tmpdir_path, monkeypatch):
    q, r = os.path.join(tmpdir_path, "q.fa"), os.path.join(tmpdir_path, "r.fa")
    fasta.write_fasta(driver.query_seqs(spark, SF_SMALL), q)
    fasta.write_fasta(driver.seqs(spark, SF_SMALL), r)
    terms = os.path.join(tmpdir_path, "terms.tsv")
    driver.table(spark, SF_SMALL, "documents").select(F.col("doc_id").cast("string").alias("EntryID"), F.col("lang").alias("term")) \
        .write.option("sep", "\t").option("header", "true").csv(terms)
    read, seen = fasta.read_fasta, {}

    def counted(spark, path, *a):
        df, n = read(spark, path, *a), spark.sparkContext.accumulator(0)
        seen[path] = (df.count(), n)

        def count(batches):
            for b in batches:
                n.add(b.num_rows)
                yield b
        return df.mapInArrow(count, df.schema)
    monkeypatch.setattr(workflows.fasta, "read_fasta", counted)
    out = workflows.homology_vote(spark, q, [workflows.ReferenceSet("a", terms, fasta=r),
                                             workflows.ReferenceSet("b", terms, fasta=r)], os.path.join(tmpdir_path, "out"))
    out.count()
    assert seen[q][1].value == seen[q][0]
    assert seen[r][1].value == seen[r][0]  # of the second set; each has its own counter


def test_embed_styles(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "seq.parquet")
    driver.seqs(spark, SF_SMALL).write.parquet(src)
    for style in ("truncated", "spaced", "chunked"):
        out = os.path.join(tmpdir_path, f"emb-{style}")
        e = workflows.embed_sequences(spark, src, out, style=style)
        assert e.count() == driver.seqs(spark, SF_SMALL).count()
        assert e.select(F.size("embedding").alias("n")).distinct().collect()[0]["n"] == 26
    assert workflows.embed_sequences(spark, os.path.join(tmpdir_path, "none"), out) is None


def test_train_and_score_files(spark, tmpdir_path):
    seq = os.path.join(tmpdir_path, "seq.parquet")
    emb = os.path.join(tmpdir_path, "emb.parquet")
    lab = os.path.join(tmpdir_path, "labels.parquet")
    test = os.path.join(tmpdir_path, "test.csv")
    d, e = driver.seqs(spark, SF_SMALL), driver.emb(spark, SF_SMALL)
    keys = d.select("EntryID").intersect(e.select("EntryID"))
    d.join(keys, "EntryID").write.parquet(seq)
    e = e.join(keys, "EntryID")
    e.write.parquet(emb)
    tax = os.path.join(tmpdir_path, "tax.csv")
    driver.taxonomy(spark, SF_SMALL).coalesce(1).write.option("header", "true").csv(tax)
    wide = e.select("EntryID", *[(F.col("embedding")[j] > 0).cast("int").alias(f"D{j}") for j in range(4)])
    wide.write.parquet(lab)
    e.select(F.col("EntryID").alias("id")).coalesce(1).write.option("header", "true").csv(test)
    from protea.operators import boost, mlp
    out = os.path.join(tmpdir_path, "pred-boost")
    p = workflows.train_and_score(spark, seq, emb, lab, test, emb, out, "boost",
                                  params=boost.BoostParams(ntrees=3, max_depth=2, max_bin=16))
    assert p.count() > 0 and set(p.columns) == {"EntryID", "term", "score"}
    out2 = os.path.join(tmpdir_path, "pred-mlp")
    p2 = workflows.train_and_score(spark, seq, emb, lab, test, emb, out2, "mlp", top_k=3,
                                   taxonomy_path=tax, params=mlp.MLPParams(epochs=2, hidden=16, rows_per_partition=50))
    assert p2.select("term").distinct().count() <= 3
    with pytest.raises(ValueError, match="taxonomy"):
        workflows.train_and_score(spark, seq, emb, lab, test, emb, out2, "mlp")
    # a sequence without a vector is an error, not a lost row
    fewer = os.path.join(tmpdir_path, "fewer.parquet")
    e.where("EntryID % 7 != 0").write.parquet(fewer)
    with pytest.raises(ValueError, match="Mismatch"):
        workflows.train_and_score(spark, seq, fewer, lab, test, emb, out, "boost")
    with pytest.raises(ValueError, match="Mismatch"):
        workflows.train_and_score(spark, seq, emb, lab, test, fewer, out, "boost")


def test_embed_with_batch_model(spark, tmpdir_path):
    from protea.operators import embed
    src = os.path.join(tmpdir_path, "seq.parquet")
    driver.seqs(spark, SF_SMALL).write.parquet(src)
    n = driver.seqs(spark, SF_SMALL).count()
    for style in ("spaced", "chunked"):
        out = os.path.join(tmpdir_path, f"m-{style}")
        e = workflows.embed_sequences(spark, src, out, style=style,
                                      make_predict_fn=embed.table_model(8), dim=8)
        rows = e.collect()
        assert len(rows) == n and all(len(r["embedding"]) == 8 for r in rows)


def test_cli_embed(spark, tmpdir_path):
    from protea.__main__ import main
    src = os.path.join(tmpdir_path, "seq.parquet")
    driver.seqs(spark, SF_SMALL).write.parquet(src)
    out = os.path.join(tmpdir_path, "emb")
    main(["embed", "--input", src, "--output", out, "--style", "truncated"])
    assert spark.read.parquet(out).count() == driver.seqs(spark, SF_SMALL).count()


def test_cli_reference_specs():
    from protea.__main__ import _ref
    a = _ref("setA:terms.tsv:meta=train.fasta")
    b = _ref("setB:t.tsv:hits=h.tsv")
    c = _ref("setC:t.tsv:plain.fasta")
    assert (a.name, a.terms, a.fasta, a.has_metadata) == ("setA", "terms.tsv", "train.fasta", True)
    assert (b.hits, b.fasta) == ("h.tsv", None)
    assert (c.fasta, c.has_metadata) == ("plain.fasta", False)
