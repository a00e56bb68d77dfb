"""Sequence embedding: pluggable batch embedders and long-sequence chunking.

* ``kmer_composition``: the shipped default embedder. Frequencies of the
  26^k letter k-mers (k = 1 or 2) among valid windows, indexed by letter
  arithmetic (A=0 .. Z=25, base 26). Column expressions for k = 1, Arrow
  batches for the 676 dimensions of k = 2.
* ``kmer_table``: the same frequencies as sparse rows (key, dim, value),
  without Python for either k.
* ``embed``: any user model through ``predict_batch_udf`` (model loaded once
  per Python worker, fed fixed-size batches). Rows are sorted by length
  inside their partitions (no shuffle) so batches hold similar lengths.
* ``embed_tokens``: a model that gives a vector per token, fed batches of a
  bounded number of padded cells (rows x longest), and the mean over each
  text's own tokens.
* ``embed_long``: fixed-stride chunks, embed every chunk (chunks of all rows
  batch together), unweighted mean of chunk vectors per entry (a partial
  aggregate, so one long sequence spreads over tasks).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from protea.operators.seqops import explode_chunks
from protea.session import ship


def kmer_counts(s: str, k: int) -> tuple[np.ndarray, int]:
    """Counts of valid k-mers of ``s`` (letters A-Z) and their total."""
    dim = 26 ** k
    if s is None:
        return np.zeros(dim, dtype=np.float64), 0
    b = np.frombuffer(s.encode("utf-8"), dtype=np.uint8).astype(np.int64) - 65
    ok = (b >= 0) & (b < 26)
    n = b.shape[0] - k + 1
    if n <= 0:
        return np.zeros(dim, dtype=np.float64), 0
    idx = np.zeros(n, dtype=np.int64)
    valid = np.ones(n, dtype=bool)
    for j in range(k):
        idx = idx * 26 + np.where(ok[j:j + n], b[j:j + n], 0)
        valid &= ok[j:j + n]
    c = np.bincount(idx[valid], minlength=dim).astype(np.float64)
    return c, int(valid.sum())


def _composition_udf(k: int, dtype: str):
    el = T.DoubleType() if dtype == "double" else T.FloatType()
    np_t = np.float64 if dtype == "double" else np.float32
    pa_t = pa.float64() if dtype == "double" else pa.float32()
    dim = 26 ** k

    @F.arrow_udf(T.ArrayType(el))
    def comp(seqs: pa.Array) -> pa.Array:
        # one (n, dim) matrix per Arrow batch, emitted as a list column by
        # offsets (no per-row Python objects on the way out)
        out = np.zeros((len(seqs), dim), dtype=np_t)
        for i, s in enumerate(seqs.to_pylist()):
            c, n = kmer_counts(s, k)
            if n:
                out[i] = c / n
        offs = pa.array(np.arange(0, (len(seqs) + 1) * dim, dim, dtype=np.int32))
        return pa.ListArray.from_arrays(offs, pa.array(out.ravel(), type=pa_t))

    return comp


def kmer_composition(seq: str | Column, k: int = 1, dtype: str = "float") -> Column:
    """array<float|double> of 26^k k-mer frequencies (zeros if no valid k-mer)."""
    if k not in (1, 2):
        raise ValueError("k must be 1 or 2 (26 or 676 dimensions)")
    c = F.col(seq) if isinstance(seq, str) else seq
    if k == 1:
        return _letter_frequencies(c).cast(f"array<{dtype}>")
    from protea.session import ship_active
    ship_active()
    return _composition_udf(k, dtype)(c)


def _letter_frequencies(seq: Column) -> Column:
    """array<double> of the 26 letters' shares: a letter's count is what its
    removal shortens the text by."""
    s = F.coalesce(seq, F.lit(""))

    def shares(counts: Column) -> Column:
        total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
        return F.transform(F.array(total), lambda n: F.transform(
            counts, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))[0]

    def counted(text: Column) -> Column:
        return F.array(*[F.length(text) - F.length(F.replace(text, F.lit(chr(65 + i)), F.lit(""))) for i in range(26)])
    # one-element arrays bind the text and the counts, so each is computed once
    return F.transform(F.array(s), lambda text: F.transform(F.array(counted(text)), shares)[0])[0]


def kmer_table(df: DataFrame, k: int = 1, key: str = "EntryID", seq_col: str = "seq") -> DataFrame:
    """(key, dim, value): the k-mer frequencies that are not zero. Windows that
    touch another character than A-Z do not count. A text's windows are
    neighbours in its task, so the partial aggregation leaves 26^k rows of it
    at most."""
    if k not in (1, 2):
        raise ValueError("k must be 1 or 2 (26 or 676 dimensions)")
    # texts between other characters; windows are cut by patterns, in one pass
    # for each of the k offsets
    runs = F.filter(F.split(F.coalesce(F.col(seq_col), F.lit("")), "[^A-Z]+"), lambda x: F.length(x) >= k)
    windows = F.flatten(F.transform(runs, lambda x: F.flatten(F.array(*[
        F.regexp_extract_all(F.substr(x, F.lit(o + 1)), F.lit(f"[A-Z]{{{k}}}"), F.lit(0)) for o in range(k)]))))
    each = df.select(key, F.explode(windows).alias("w"))
    dim = F.lit(0)
    for i in range(k):
        dim = dim * 26 + F.ascii(F.substring("w", i + 1, 1)) - 65
    counts = each.groupBy(key, "w").agg(F.count("*").alias("n"))
    total = counts.groupBy(key).agg(F.sum("n").alias("total"))
    return counts.join(total, key).select(key, dim.cast("int").alias("dim"), (F.col("n") / F.col("total")).alias("value"))


def table_model(dim: int = 8):
    """A deterministic batch model with integer weights: the vector of letter
    number c (A=1 .. Z=26) is c * (d + 3) mod 11 in dimension d, and a text's
    vector is the mean over its letters (zeros if it has none)."""
    def make():
        table = (np.arange(1, 27)[:, None] * (np.arange(dim)[None, :] + 3)) % 11

        def predict(seqs: np.ndarray) -> np.ndarray:
            out = np.zeros((len(seqs), dim), dtype=np.float32)
            for i, text in enumerate(seqs):
                counts, n = kmer_counts(text, 1)
                if n:
                    out[i] = counts @ table / n
            return out

        return predict

    return make


def composition(df: DataFrame, k: int = 1, seq_col: str = "seq", out_col: str = "embedding",
                dtype: str = "float") -> DataFrame:
    """Default embedder as an operator: k-mer composition of every sequence."""
    return df.withColumn(out_col, kmer_composition(seq_col, k, dtype))


def length_sorted(df: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Sort each partition longest-first, so consecutive model batches hold
    similar lengths (little padding). No shuffle: a partition holds many
    batches' worth of rows at scale, so a local sort captures the benefit of
    the single-machine global sort without moving the texts or creating a
    skewed range partition."""
    return df.sortWithinPartitions(F.desc(F.length(F.col(seq_col))))


def embed(df: DataFrame, make_predict_fn: Callable, dim: int, batch_size: int = 64,
          seq_col: str = "seq", out_col: str = "embedding", sort_by_length: bool = True) -> DataFrame:
    """Apply a user batch model: ``make_predict_fn()`` returns a function from a
    numpy array of strings to an (n, dim) float array (order kept)."""
    from pyspark.ml.functions import predict_batch_udf

    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()),
                            batch_size=batch_size)
    src = length_sorted(df, seq_col) if sort_by_length else df
    return src.withColumn(out_col, udf(F.col(seq_col)))


def cell_batches(lengths: np.ndarray, cells: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive batches with rows x longest <= ``cells``; a text
    longer than that is a batch by itself."""
    lo, longest = 0, 0
    for i, n in enumerate(lengths):
        longest = max(longest, int(n))
        if i > lo and (i + 1 - lo) * longest > cells:
            yield lo, i
            lo, longest = i, int(n)
    if lo < len(lengths):
        yield lo, len(lengths)


def masked_mean(vectors: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """(n, L, dim) token vectors and (n, L) mask to (n, dim): the mean over a
    row's masked tokens, zeros without one."""
    weight = mask.astype(np.float32)
    total = np.einsum("nld,nl->nd", vectors, weight)
    return total / np.maximum(weight.sum(axis=1, keepdims=True), 1)


def embed_tokens(df: DataFrame, make_token_fn: Callable, cells: int = 1 << 15, seq_col: str = "seq",
                 out_col: str = "embedding", padded_col: str | None = None) -> DataFrame:
    """Apply a token model: ``make_token_fn()`` returns a function from a list
    of texts to their (n, L, dim) token vectors and (n, L) mask; the result is
    the masked mean. A batch has at most ``cells`` characters with padding, so
    it needs the same memory whether texts are long or short; partitions are
    sorted by length, so little of it is padding. ``padded_col``: the length
    that a row was padded to (its sum over that of the lengths is the padding
    ratio). A null text is an empty one."""
    ship(df.sparkSession)
    added = [T.StructField(out_col, T.ArrayType(T.FloatType()))]
    if padded_col:
        added.append(T.StructField(padded_col, T.IntegerType()))
    schema = T.StructType([*df.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_token_fn()
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(seq_col)).to_pylist()]
            lengths = np.array([len(t) for t in texts], dtype=np.int64)
            for lo, hi in cell_batches(lengths, cells):
                v = masked_mean(*model(texts[lo:hi])).astype(np.float32)
                columns = [*batch.slice(lo, hi - lo).columns,
                           pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))]
                if padded_col:
                    columns.append(pa.array(np.full(hi - lo, lengths[lo:hi].max()), pa.int32()))
                yield pa.RecordBatch.from_arrays(columns, schema.names)
    return length_sorted(df, seq_col).mapInArrow(run, schema)


def table_token_model(dim: int = 8):
    """``table_model`` by tokens: letters' vectors, and a mask of the letters."""
    def make():
        table = np.zeros((27, dim), np.float32)
        table[1:] = (np.arange(1, 27)[:, None] * (np.arange(dim)[None, :] + 3)) % 11

        def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            ids = np.zeros((len(texts), max(map(len, texts), default=0)), np.int64)
            for i, t in enumerate(texts):
                b = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) - 64
                ids[i, :len(b)] = np.where((b >= 1) & (b <= 26), b, 0)
            return table[ids], ids > 0

        return tokens

    return make


def mean_vectors(df: DataFrame, key: str, vec_col: str, out_col: str = "embedding") -> DataFrame:
    """Unweighted elementwise mean of array vectors per key (partial aggregate)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    return (df.groupBy(key).agg(Summarizer.mean(array_to_vector(F.col(vec_col))).alias("_m"))
            .select(key, vector_to_array("_m", "float64").alias(out_col)))


def embed_long(df: DataFrame, embedder: Callable[[Column], Column], seq_col: str = "seq",
               chunk: int = 2048, key: str = "EntryID", out_col: str = "embedding") -> DataFrame:
    """Chunk -> embed each chunk -> mean over chunks. A short text is a single
    chunk, so its vector is its own embedding."""
    ch = explode_chunks(df, seq_col, chunk, keep=(key,))
    ch = ch.withColumn("_v", embedder(F.col("chunk")))
    return mean_vectors(ch, key, "_v", out_col)
