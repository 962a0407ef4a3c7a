"""Session helper: sane defaults that never override what a cluster already set."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

# Defaults applied only when the running session has no value of its own.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Bound every Arrow batch by bytes as well as rows: kNN tiles are large rows.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def get_session(master: str | None = None, app: str = "lexispark",
                shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false") \
        .config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    apply_defaults(spark)
    return spark


def ship_package() -> None:
    """Pickle this package's functions by value, so Python workers need not have it installed
    (the Arrow operators run our functions inside tasks)."""
    import lexispark
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(lexispark)


def apply_defaults(spark: SparkSession) -> SparkSession:
    ship_package()
    for key, value in DEFAULTS.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    A cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a session within one
    process (tests) gets a private folder; on a cluster it is an error, as every executor would
    write to a disk of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lexispark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path
