"""Streaming scoring: new feature rows -> thresholded long predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from protea.operators.score import score
from protea.session import scratch_path


def score_stream(stream: DataFrame, models: Sequence, terms: Sequence[str],
                 threshold: float = 0.01, **kw) -> DataFrame:
    """The batch scoring operator applied to a streaming DataFrame."""
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame (spark.readStream...)")
    return score(stream, models, terms, threshold, **kw)


def start_prediction_stream(spark: SparkSession, source_dir: str, schema, models, terms,
                            out_path: str, threshold: float = 0.01, checkpoint: str | None = None,
                            glob: str | None = None, available_now: bool = True,
                            max_files_per_trigger: int | None = None, key: str = "EntryID") -> StreamingQuery:
    """Watch ``source_dir`` for Parquet files of (EntryID, embedding[, tax])
    and append predictions to ``out_path`` (file sink: exactly-once, restart
    from the checkpoint after a failure)."""
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    src = r.parquet(source_dir)
    pred = score_stream(src, models, terms, threshold, key=key)
    w = (pred.writeStream.format("parquet").option("path", out_path)
         .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt"))
         .outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
