"""Votes that are repeated: hits and annotations kept in the same buckets.

Annotations change more often than hits (a new release of the term table, a
vote per subset of terms), and each vote joins all hits to them by subject.
``save_pairs`` keeps what a vote needs of a hit table: the bits of each (set,
query, subject), bucketed by subject, and the totals of each query.
``save_terms`` buckets annotations likewise. A vote over the two reads both in
their buckets: below the join nothing is shuffled or aggregated again.

A subject with more than ``hot`` pairs would make its bucket long. Such pairs
lie apart, in no buckets, and are joined as ``vote.weighted_vote`` joins them
(AQE splits them); their annotations are looked up in the same term table.

The threshold on e-values belongs to the stored pairs. The scores are those of
``vote.weighted_vote`` with one term table for all sets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protea.operators.common import read_bucketed, write_bucketed
from protea.operators.vote import _pair_and_total, filter_hits
from protea.session import saved

HOT = 1_000_000


def _ddl(df: DataFrame) -> str:
    """The schema as text; a bucketed table without rows has no file that states it."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _default_buckets(spark: SparkSession, buckets: int | None) -> int:
    return buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))


def save_terms(terms: DataFrame, path: str, buckets: int | None = None, subject_key: str = "EntryID") -> DataFrame:
    """Annotations bucketed by subject, in the new folder ``path``; repeated
    ones stay, as they count twice."""
    spark = terms.sparkSession
    n = _default_buckets(spark, buckets)
    rows = terms.where(F.col(subject_key).isNotNull()).select(F.col(subject_key).alias("subject_id"), "term")
    write_bucketed(rows, f"{path}/terms", "subject_id", n)
    spark.range(1).select(F.lit(n).alias("buckets"), F.lit(_ddl(rows)).alias("ddl")).write.parquet(f"{path}/about")
    return open_terms(spark, path)


def open_terms(spark: SparkSession, path: str) -> DataFrame:
    about = spark.read.parquet(f"{path}/about").first()
    return read_bucketed(spark, f"{path}/terms", about.ddl, "subject_id", about.buckets)


@dataclass
class StoredPairs:
    by: list[str]
    pairs: DataFrame   # by..., query_id, subject_id, bits; bucketed by subject
    hubs: DataFrame    # the same, of subjects with many pairs
    totals: DataFrame  # by..., query_id, total_bits

    def vote(self, terms: DataFrame) -> DataFrame:
        """(by..., query_id, term, score) with the annotations of
        ``open_terms`` (those in other buckets, or in none, are shuffled)."""
        keys = [*self.by, "query_id"]
        bits = [*keys, "term", "bits"]
        each = (self.pairs.join(terms, "subject_id").select(*bits)
                .unionByName(self.hubs.join(terms, "subject_id").select(*bits)))
        term_bits = each.groupBy(*keys, "term").agg(F.sum("bits").alias("term_bits"))
        match = [term_bits[k].eqNullSafe(self.totals[k]) if k != "query_id" else term_bits[k] == self.totals[k] for k in keys]
        return term_bits.join(self.totals, match).select(
            *[term_bits[k] for k in keys], "term", F.try_divide("term_bits", "total_bits").alias("score"))


def save_pairs(hits: DataFrame, path: str, evalue_threshold: float = 1e-3, by: Sequence[str] = ("source",),
               buckets: int | None = None, hot: int = HOT) -> StoredPairs:
    """Kept hits as pairs and totals in the new folder ``path``."""
    spark, by = hits.sparkSession, list(by)
    n = _default_buckets(spark, buckets)
    pair, total = _pair_and_total(filter_hits(hits, evalue_threshold).select(*by, "query_id", "subject_id", "bitscore"), by)
    total.write.parquet(f"{path}/totals")
    pair = saved(pair.where(F.col("subject_id").isNotNull()), "vote-pairs")
    often = saved(pair.groupBy("subject_id").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("subject_id"), "vote-hubs")
    pair.join(often, "subject_id", "left_semi").select(*pair.columns).write.parquet(f"{path}/hubs")
    write_bucketed(pair.join(often, "subject_id", "left_anti").select(*pair.columns), f"{path}/pairs", "subject_id", n)
    (spark.range(1).select(F.lit(n).alias("buckets"), F.lit(_ddl(pair)).alias("ddl"),
                           F.array(*map(F.lit, by)).cast("array<string>").alias("by"))
     .write.parquet(f"{path}/about"))
    return open_pairs(spark, path)


def open_pairs(spark: SparkSession, path: str) -> StoredPairs:
    about = spark.read.parquet(f"{path}/about").first()
    return StoredPairs(about.by, read_bucketed(spark, f"{path}/pairs", about.ddl, "subject_id", about.buckets),
                       spark.read.parquet(f"{path}/hubs"), spark.read.parquet(f"{path}/totals"))
