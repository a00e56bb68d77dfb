"""Homology vote: similarity hits -> bitscore-weighted term scores.

For a query q and a term t (per reference set):

    score(q, t) = sum(bitscore of kept hits q -> s, for every annotation (s, t))
                  / sum(bitscore of all kept hits of q)

A hit is kept when ``evalue < threshold`` (strict; NaN never passes). Hits to
subjects without annotations add nothing to the numerator but stay in the
denominator. A duplicated (subject, term) annotation counts twice. Queries
whose kept hits carry no term produce no rows. A zero denominator yields
null (``try_divide``) instead of an error.

Plan shape (all partial/map-side aggregations, so a hot query or a hot
subject collapses before any shuffle):

    kept hits --agg(src,q,s)--> pair bits --join terms on s (AQE skew split /
              runtime broadcast) --agg(src,q,t)--> term bits --join totals
                                  pair bits --agg(src,q)--> totals
    (one scan and one shuffle of the hit table, reused by both branches)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def filter_hits(hits: DataFrame, evalue_threshold: float = 1e-3) -> DataFrame:
    """Strict e-value filter; pushed into the scan by Catalyst when possible."""
    e = F.col("evalue")
    return hits.where((e < F.lit(float(evalue_threshold))) & ~F.isnan(e))


def weighted_vote(hits: DataFrame, terms: DataFrame, evalue_threshold: float = 1e-3,
                  by: Sequence[str] = ("source",), subject_key: str = "EntryID") -> DataFrame:
    """(by..., query_id, term, score). ``by`` names the reference-set column(s);
    pass ``by=()`` for a single hit table. Where ``terms`` has those columns
    too, each reference set is voted with its own annotations."""
    by = list(by)
    own = [c for c in by if c in terms.columns]
    kept = filter_hits(hits, evalue_threshold).select(*by, "query_id", "subject_id", "bitscore")
    pair, total = _pair_and_total(kept, by)
    ann = (terms.where(F.col(subject_key).isNotNull())
           .select(F.col(subject_key).alias("_subj"), F.col("term"), *[F.col(c).alias(f"_own_{c}") for c in own]))
    # null-safe key: no inferred not-null filter on the pair side, so both
    # consumers of ``pair`` share one scan and one shuffle of the hit table
    match = pair["subject_id"].eqNullSafe(ann["_subj"])
    for c in own:
        match = match & pair[c].eqNullSafe(ann[f"_own_{c}"])
    term_bits = (pair.join(ann, match, "inner")
                 .groupBy(*by, "query_id", "term").agg(F.sum("bits").alias("term_bits")))
    return (term_bits.join(total, [*by, "query_id"], "inner")
            .select(*by, "query_id", "term",
                    F.try_divide(F.col("term_bits"), F.col("total_bits")).alias("score")))


def _pair_and_total(kept: DataFrame, by: list[str]):
    """Per (set, query, subject) bits, and per (set, query) totals summed from
    those pairs (the same aggregated table feeds both). Several HSPs to one
    subject are additive in numerator and denominator, so pre-summing per
    pair is exact; a hot query or subject collapses map-side."""
    keys = [*by, "query_id"]
    pair = kept.groupBy(*keys, "subject_id").agg(F.sum("bitscore").alias("bits"))
    total = pair.groupBy(*keys).agg(F.sum("bits").alias("total_bits"))
    return pair, total


def max_merge(votes: DataFrame, keys: Sequence[str] = ("query_id", "term"),
              score: str = "score") -> DataFrame:
    """Max over reference sets per (query, term). NaN is filtered first: Spark
    ranks NaN above every number, Python's max() is order dependent on it."""
    keys = list(keys)
    s = F.col(score)
    return (votes.where(s.isNotNull() & ~F.isnan(s))
            .groupBy(*keys).agg(F.max(s).alias(score)))


def vote_and_merge(hit_sets: DataFrame, terms: DataFrame, evalue_threshold: float = 1e-3,
                   source_col: str = "source") -> DataFrame:
    """All reference sets in one plan (union of hit tables tagged by
    ``source_col``, each with its own annotations when ``terms`` carries the
    same column) -> merged (query_id, term, score)."""
    return max_merge(weighted_vote(hit_sets, terms, evalue_threshold, by=[source_col]))


def term_lists(terms: DataFrame, key: str = "EntryID") -> DataFrame:
    """(EntryID, terms array) with duplicates kept, for display only; the
    vote itself stays on the long table."""
    return terms.groupBy(key).agg(F.collect_list("term").alias("terms"))
