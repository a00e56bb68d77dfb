"""The corpus pipeline: five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that the stage before has
kept, and returns a DataFrame that is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents:

1. toxicity: documents that the classifier rejects go
2. near duplicates: of each group the document with the smallest id stays
3. benchmark decontamination: contaminated documents go
4. secret scans: reported spans are replaced in the texts; no document goes
5. BPE: every document's ids, and whether decoding gives its text again
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protea.llm import bpe, decontaminate, minmax, secrets, toxicity
from protea.llm.common import read, saved, ship


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, read(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minmax.without_near_duplicates(docs, threshold=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.without_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    both = bpe.encode(docs, bpe.build_lexicon(docs), decoded=True)
    return both.withColumn("lossless", F.col("decoded") == F.coalesce("text", F.lit(""))).drop("decoded", "text")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

# classifiers, hashing and merges are beyond SQL; tests/llm compares each stage
# with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
