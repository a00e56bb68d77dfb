"""Deterministic, partitioning-independent splits.

A row's side depends only on its key and the seed (not on partition layout or
row order, unlike ``randomSplit``), so a re-run after executor loss or a
repartition gives the same split. ``xxhash64`` works for any key type; the
``lcg`` method is plain 64-bit integer arithmetic on a numeric key (one LCG
step, high bits), which any SQL engine can reproduce.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_M32 = 4294967296


def bucket(key: str | Column, n: int, seed: int = 42, method: str = "xxhash64") -> Column:
    k = F.col(key) if isinstance(key, str) else key
    if method == "xxhash64":
        return F.pmod(F.xxhash64(k, F.lit(seed)), F.lit(n)).cast("int")
    if method == "lcg":
        h = F.pmod(F.pmod(k.cast("long"), F.lit(_M32)) * F.lit(1103515245) + F.lit(12345 + seed),
                   F.lit(_M32))
        return F.pmod(F.floor(h / F.lit(65536)), F.lit(n)).cast("int")
    raise ValueError(f"unknown split method {method!r}")


def assign_split(df: DataFrame, key: str = "EntryID", val_fraction: float = 0.2, seed: int = 42,
                 method: str = "xxhash64", col: str = "is_val") -> DataFrame:
    """Adds a boolean ``is_val`` column: ~val_fraction of keys (per mille grid)."""
    return df.withColumn(col, bucket(key, 1000, seed, method) < F.lit(int(round(val_fraction * 1000))))


def train_val(df: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    s = assign_split(df, **kw)
    return s.where(~F.col("is_val")).drop("is_val"), s.where(F.col("is_val")).drop("is_val")


def assign_folds(df: DataFrame, key: str = "EntryID", k: int = 5, seed: int = 42,
                 method: str = "xxhash64", col: str = "fold") -> DataFrame:
    return df.withColumn(col, bucket(key, k, seed, method))


def fold_frames(df: DataFrame, fold: int, **kw) -> tuple[DataFrame, DataFrame]:
    """(train, val) for one fold; ``max_folds=1`` in the trainers reproduces
    the reference's loop that stops after the first fold."""
    s = assign_folds(df, **kw)
    return s.where(F.col("fold") != fold).drop("fold"), s.where(F.col("fold") == fold).drop("fold")
