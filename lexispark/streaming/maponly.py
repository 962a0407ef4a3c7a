"""Streaming use of the map-only operators.

The reference has no streams.  Every row-local operator (first POS, sense depth, masking,
marking, label alignment, per-sentence scores) is a pure column expression, so it runs
unchanged on a streaming DataFrame; this module wires one up from a folder of parquet
files with an available-now trigger and a checkpoint under the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexispark.sources.io import scratch


def stream_map(spark: SparkSession, src: str, schema, fn: Callable[[DataFrame], DataFrame],
               sink: str, fmt: str = "parquet") -> str:
    """Apply ``fn`` to every micro-batch of new files under ``src``; write to ``sink``.
    Returns the sink path once all available input has been processed."""
    stream = spark.readStream.schema(schema).parquet(src)
    q = (fn(stream).writeStream.format(fmt).option("path", sink)
         .option("checkpointLocation", scratch(spark, "stream-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return sink
