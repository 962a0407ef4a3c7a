"""Rows packed into tiles, for work on a whole tile at once."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def packed(df: DataFrame, size: int) -> DataFrame:
    """``df`` with at most ``size`` rows a row: each column becomes an array.  No shuffle: tiles are made
    within Arrow batches, so a partition's last ones may be smaller."""
    schema = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in df.schema])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                ends = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, c) for c in part.columns],
                                                 names=part.schema.names)
    return df.mapInArrow(run, schema)
