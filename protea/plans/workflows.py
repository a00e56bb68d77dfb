"""User-level workflows: files in, files out, composed from the operators.

These are what the reference's notebook and scripts do end to end, as Spark
jobs:

* ``homology_vote``: query FASTA + per-reference-set FASTA (or precomputed
  hit tables) and term tables -> similarity hits -> weighted vote per set ->
  max-merge -> submission TSV.
* ``embed_sequences``: sequence Parquet -> preprocessing style
  (truncated / spaced / prefixed+chunked) -> batch embedder -> embedding Parquet.
* ``train_and_score``: sequence, embedding and wide-label Parquet (+ optional
  taxonomy files) -> aligned training table -> booster or MLP -> scored test
  entries -> prediction Parquet. (IA weights feed the metrics and the
  weighted focal loss; the reference's training loss does not use them.)
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protea.functions import seq as S
from protea.operators import align, embed, labels, score, seqops, simsearch, split, vote
from protea.session import saved, ship
from protea.sources import fasta, tables


@dataclass
class ReferenceSet:
    """One annotated reference set: sequences (FASTA) or a precomputed hit
    table for the queries, plus its term table."""
    name: str
    terms: str
    fasta: str | None = None
    hits: str | None = None
    has_metadata: bool = False
    terms_csv: bool = False


def _letters(df: DataFrame) -> DataFrame:
    return df.select("EntryID", F.upper(F.regexp_replace("seq", "[^A-Za-z]", "")).alias("seq"))


def homology_vote(spark: SparkSession, query_fasta: str, refs: Sequence[ReferenceSet], out_tsv: str,
                  evalue: float = 1e-3, max_targets: int = 16, K: int = 12, max_freq: int | None = None,
                  query_has_metadata: bool = False) -> DataFrame:
    """Search (or read hits), vote per reference set, max-merge, write TSV.
    Returns the merged (query_id, term, score) table."""
    ship(spark)
    queries = None
    hit_sets, term_sets = [], []
    for ref in refs:
        if ref.hits is not None:
            h = tables.read_hits(spark, ref.hits)
        else:
            if queries is None:
                q = fasta.read_fasta(spark, query_fasta, query_has_metadata)
                queries = simsearch.prepare(saved(_letters(seqops.dedupe(q)), "queries"), K)
            r = saved(_letters(seqops.dedupe(fasta.read_fasta(spark, ref.fasta, ref.has_metadata))), "references")
            h = simsearch.search(queries, r, max_freq=max_freq, max_targets=max_targets)
        h = h.select(F.col("query_id").cast("string"), F.col("subject_id").cast("string"),
                     "evalue", "bitscore").withColumn("source", F.lit(ref.name))
        hit_sets.append(h)
        t = tables.read_terms(spark, ref.terms, ref.terms_csv).withColumn("source", F.lit(ref.name))
        term_sets.append(t.select("source", F.col("EntryID").cast("string").alias("EntryID"), "term"))
    hits = hit_sets[0]
    for h in hit_sets[1:]:
        hits = hits.unionByName(h)
    terms = term_sets[0]
    for t in term_sets[1:]:
        terms = terms.unionByName(t)
    merged = vote.vote_and_merge(hits, terms, evalue, source_col="source")
    tables.write_scores_tsv(merged, out_tsv)
    return merged


# fixed values: per preprocessing style, tokens per sequence (incl. specials),
# special tokens added, and the chunk length of the chunked style
PREPROCESS = {
    "truncated": dict(max_tokens=1024, n_special=2),
    "spaced": dict(max_tokens=1024, n_special=1),
    "chunked": dict(chunk=2048),
}


def _prepare(seq: str, style: str):
    cfg = PREPROCESS[style]
    if style == "truncated":
        return S.truncate(S.clean(seq), cfg["max_tokens"], cfg["n_special"])
    if style == "spaced":  # limit residues first, then space them
        return S.spaced(S.truncate(S.clean(seq), cfg["max_tokens"], cfg["n_special"]))
    return S.prefixed(seq)


def embed_sequences(spark: SparkSession, in_parquet: str, out_parquet: str, style: str = "truncated",
                    make_predict_fn: Callable | None = None, dim: int | None = None,
                    batch_size: int = 64, k: int = 1, half: bool = True) -> DataFrame | None:
    """Embed a sequence Parquet file. ``make_predict_fn`` is a batch model
    (strings -> (n, dim)); without one, the k-mer composition embedder is
    used. ``style`` picks the preprocessing: truncated = clean + truncate to
    1024 tokens with 2 specials; spaced = clean + truncate (1 special) + one
    space between residues; chunked = '[NLU]' prefix + 2048-letter chunks with
    the chunk mean. Values are stored in half precision unless told otherwise."""
    ship(spark)
    seqs = tables.read_sequences(spark, in_parquet, required=False)
    if seqs is None:
        return None
    s = seqs.select("EntryID", _prepare("seq", style).alias("seq"))
    if make_predict_fn is None:
        embedder = lambda c: embed.kmer_composition(c, k)
    else:
        def embedder(c):
            from pyspark.ml.functions import predict_batch_udf
            from pyspark.sql import types as T
            return predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()),
                                     batch_size=batch_size)(c)
    if style == "chunked":
        out = embed.embed_long(s, embedder, "seq", PREPROCESS["chunked"]["chunk"])
    else:
        out = embed.length_sorted(s).select("EntryID", embedder(F.col("seq")).alias("embedding"))
    tables.write_embeddings(out, out_parquet, half=half)
    return spark.read.parquet(out_parquet)


def train_and_score(spark: SparkSession, seq_path: str, emb_path: str, label_path: str,
                    test_path: str, test_emb_path: str, out_path: str, model: str = "boost",
                    top_k: int | None = None, taxonomy_path: str | None = None,
                    test_taxonomy_path: str | None = None, threshold: float = 0.01,
                    params=None, max_folds: int = 1, n_folds: int = 5) -> DataFrame | None:
    """Aligned training table -> model -> scored test entries (long Parquet).

    ``model``: 'boost' (fold models on hash folds, the first ``max_folds``
    trained and averaged at scoring) or 'mlp' (80/20 hash split, taxonomy
    branch). Embedding files are keyed Parquet (EntryID, embedding).
    """
    from protea.operators import boost, mlp
    ship(spark)
    seqs = tables.read_sequences(spark, seq_path)
    emb = tables.read_keyed(spark, emb_path).select("EntryID", "embedding")
    wide = tables.read_keyed(spark, label_path)
    align.assert_aligned(seqs, emb)  # a sequence without a vector, or the reverse, is an error
    if model == "mlp" and not taxonomy_path:
        raise ValueError("the two-branch model needs the training taxonomy")
    tax = tables.read_taxonomy(spark, taxonomy_path) if (model == "mlp" and taxonomy_path) else None
    if model == "mlp" and taxonomy_path and tax is None:
        raise FileNotFoundError(taxonomy_path)
    aligned = align.align_training(seqs, wide.select("EntryID"), emb, tax)
    if tax is None:
        aligned = aligned.withColumn("taxonomyID", F.lit(-1).cast("long"))
    pos = labels.positives(labels.melt_wide(wide))
    # boosting counts labels over the label table, the MLP over aligned rows
    entries = aligned.select("EntryID") if model == "mlp" else None
    vocab = labels.top_k_labels(pos, top_k, entries=entries)
    terms = [r["term"] for r in vocab.orderBy("rank").select("term").collect()]  # vocabulary
    tax_vocab = align.taxonomy_vocab(aligned)
    t = align.labels_array(aligned, labels.restrict_to_vocab(pos, vocab, top_k))
    t = align.index_taxonomy(t, tax_vocab)

    test = tables.read_test_ids(spark, test_path)
    if test is None or not tables.path_exists(spark, test_emb_path):
        return None
    test_emb = tables.read_keyed(spark, test_emb_path).select("EntryID", "embedding")
    align.assert_aligned(test.select("EntryID"), test_emb)
    test_tax = (tables.read_taxonomy(spark, test_taxonomy_path, required=False)
                if test_taxonomy_path else None)
    test = align.with_taxonomy(test.select("EntryID").join(test_emb, "EntryID"), test_tax)
    test = align.index_taxonomy(test, tax_vocab)

    if model == "boost":
        models = []
        for fold in range(min(max_folds, n_folds)):
            ft = split.assign_folds(t, "EntryID", n_folds).withColumn("is_val", F.col("fold") == fold)
            m, _ = boost.fit(ft.drop("fold"), len(terms), params)
            models.append(m)
        pred = score.score(test, models, terms, threshold)
    else:
        st = split.assign_split(t, "EntryID", 0.2)
        m, _ = mlp.fit(st, len(terms), tax_vocab.count() + 1, params)
        pred = score.score(test, [m], terms, threshold, tax_col="taxonomy_idx")
    tables.write_predictions(pred, out_path)
    return spark.read.parquet(out_path)
