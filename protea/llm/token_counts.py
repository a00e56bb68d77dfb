"""Token counts through a digest cache.

A cache table in the shared folder holds (tokenizer, content, n_tokens): the
digest of a tokenizer's file and library version, the digest of a normalised
content (null as the empty text; tokenizers see every other difference, so
nothing else is normalised) and its count. Contents are joined to the cache by
digest; of those it lacks, one row each is encoded, and the counts are
appended. The digests decide; texts move once, without their copies' counts
being computed again.

Cases: a null or empty text has the count of the empty text; repeated rows get
the same count from one encoding; null ids stay; an empty table appends
nothing; a cache written twice by a repeated run has equal rows, of which one
counts.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from protea.llm.bpe import SLICE_BYTES, TOKENIZER, codec, is_byte_level, other_letters, tokenizer_path
from protea.llm.common import scratch_path, ship, text_of

LIMIT = 512
CACHE = "tokenizer string, content binary, n_tokens long"


def library(tokenizer: str) -> str:
    return "sentencepiece" if tokenizer.endswith(".model") else "tokenizers"


def tokenizer_digest(tokenizer: str) -> str:
    """Of the file's bytes and the library's version."""
    lib = importlib.import_module(library(tokenizer))
    h = hashlib.sha256(f"{lib.__name__} {lib.__version__}\n".encode())
    h.update(open(tokenizer_path(tokenizer), "rb").read())
    return h.hexdigest()


def counter(tokenizer: str, other: str = ""):
    """Texts -> counts, without begin, end or added special tokens."""
    path = tokenizer_path(tokenizer)
    if library(tokenizer) == "sentencepiece":
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    with open(path, encoding="utf-8") as f:
        byte_level = is_byte_level(json.load(f))
    if byte_level:  # the same ids in half the library's time (tests compare them)
        c = codec(tokenizer, None, other)
        return lambda texts: [len(ids) // 4 for ids in c.encode(texts)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers
    model = tokenizers.Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def _encode(tokenizer: str):
    other = other_letters() if library(tokenizer) == "tokenizers" else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer, other)
        for batch in batches:
            texts, counts, size = [], [], 0
            for t in batch.column(1).to_pylist():
                texts.append(t)
                size += len(t)
                if size > SLICE_BYTES:
                    counts += count(texts)
                    texts, size = [], 0
            counts += count(texts) if texts else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["content", "n_tokens"])
    return run


def _cached(spark: SparkSession, path: str, digest: str) -> DataFrame:
    try:
        rows = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "content binary, n_tokens long")
    return rows.where(F.col("tokenizer") == digest).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, cache: str | None = None, tokenizer: str = TOKENIZER,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens of every row. ``cache`` is a folder all executors
    share; without one, a new one is made for this call."""
    spark = docs.sparkSession
    ship(spark)
    cache = cache or scratch_path(spark, "token-cache")
    digest = tokenizer_digest(tokenizer)
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"),
                       F.unhex(F.sha2(text.cast("binary"), 256)).alias("content"))
    light = rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "content")
    # one row for each content that the cache lacks
    missing = (rows.groupBy("content").agg(F.min("id").alias("id"))
               .join(_cached(spark, cache, digest), "content", "left_anti")
               .select(F.col("content").alias("c"), F.col("id").alias("i")))
    first = rows.join(missing.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("i")) & (F.col("content") == F.col("c")),
                      "left_semi").select("content", "text")
    counted = first.mapInArrow(_encode(tokenizer), "content binary, n_tokens long")
    counted.select(F.lit(digest).alias("tokenizer"), "content", "n_tokens").write.mode("append").parquet(cache)
    return light.join(_cached(spark, cache, digest), "content").select(F.col("id").alias(id_col), "n_bytes", "n_tokens")


def report(docs: DataFrame, cache: str | None = None, tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    return count_tokens(docs, cache, tokenizer).withColumn("over_limit", F.col("n_tokens") > limit)
