"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from protea import session
from protea.session import saved, scratch_path

BATCH_ROWS = 500


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, and let them be fed in
    batches of texts that are small beside their memory (the session's setting
    stays where it is lower)."""
    session.ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def text_of(df: DataFrame, text_col: str = "text") -> Column:
    """The text column, null as the empty text."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as make it a name that
    no column of ``df`` has (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sha256_hex(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


__all__ = ["free_names", "read", "saved", "text_of", "sha256_hex", "ship", "scratch_path"]
