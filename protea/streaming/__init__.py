"""Structured Streaming entry points.

The reference has no streaming operators; its only incremental behaviour is
writing predictions chunk by chunk. Here the same stateless scoring operator
runs on a file stream of new entries (``mapInArrow`` is stateless, so it
works unchanged on a streaming DataFrame) into the exactly-once Parquet file
sink, with its checkpoint in the shared checkpoint folder.
"""

from protea.streaming.scoring import score_stream, start_prediction_stream  # noqa: F401
