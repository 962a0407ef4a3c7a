"""Seeded, content-keyed randomness.

Every random choice in the library is a function of (seed, row content), never of
partitioning or row order.  md5 hex strings order identically in Spark and DuckDB,
so the same choice can be written as an SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_60 = float(1 << 60)


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rkey(seed, *cols) -> Column:
    """md5(seed:col1:col2...) as hex; a uniform sort key."""
    parts = [F.lit(str(seed))] + [_as_col(c).cast("string") for c in cols]
    return F.md5(F.concat_ws(":", *parts))


def seeded_int(seed, *cols) -> Column:
    """Uniform integer in [0, 2^60) drawn from the first 15 hex digits of rkey."""
    return F.conv(F.substring(rkey(seed, *cols), 1, 15), 16, 10).cast("bigint")


def seeded_unit(seed, *cols) -> Column:
    """Uniform double in [0, 1)."""
    return seeded_int(seed, *cols) / F.lit(TWO_60)


def hex_bucket(key: Column, digits: int = 3) -> Column:
    """Leading hex digits of an md5 key: 16**digits ordered buckets."""
    return F.substring(key, 1, digits)


def r6(c) -> Column:
    """Round a double to 6 places; all oracle-compared doubles pass through this."""
    return F.round(_as_col(c).cast("double"), 6)
