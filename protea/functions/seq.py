"""Sequence column expressions: cleaning, spacing, prefixing, truncation,
fixed-stride chunking. All built-in expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: residue letters replaced by X, and the model-specific prefix
NONSTANDARD = "UZOB"
PREFIX_NLU = "[NLU]"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(seq: str | Column) -> Column:
    """null/empty -> 'X'; upper-case U, Z, O, B -> 'X' (case sensitive)."""
    s = _c(seq)
    return (F.when(F.coalesce(s, F.lit("")) == "", F.lit("X"))
            .otherwise(F.translate(s, NONSTANDARD, "X" * len(NONSTANDARD))))


def spaced(seq: str | Column) -> Column:
    """clean, then one space between residues ('AXY' -> 'A X Y'): split into
    characters and join (cheaper than a look-ahead regex per character)."""
    return F.array_join(F.split(clean(seq), ""), " ")


def prefixed(seq: str | Column, prefix: str = PREFIX_NLU) -> Column:
    """prefix + clean; the prefix counts toward length tests and chunking."""
    return F.concat(F.lit(prefix), clean(seq))


def truncate(seq: str | Column, max_tokens: int = 1024, n_special: int = 2) -> Column:
    """Keep what fits in ``max_tokens`` once special tokens are counted, as a
    character limit (one residue per token)."""
    return F.substring(_c(seq), 1, max(max_tokens - n_special, 0))


def chunk_array(seq: str | Column, size: int = 2048) -> Column:
    """array<struct<chunk_idx int, chunk string>>: text[j*size : (j+1)*size],
    no overlap; an empty/short text is one chunk."""
    s = _c(seq)
    n = F.floor(F.greatest(F.length(s) - 1, F.lit(0)) / F.lit(size)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), n),
        lambda j: F.struct(j.alias("chunk_idx"),
                           s.substr(j * F.lit(size) + F.lit(1), F.lit(size)).alias("chunk")))


def is_long(seq: str | Column, size: int = 2048) -> Column:
    """The short/long regime split: long when length >= size."""
    return F.length(_c(seq)) >= F.lit(size)
