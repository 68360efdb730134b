"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: SQL settings that every job relies on. They are runtime settings, so they can
#: be applied to a session that somebody else has created.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app_name: str = "tallgrass", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the engine's settings; ``conf`` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for lineage cuts.

    A cluster names a shared folder in ``spark.checkpoint.dir`` and that one is used.
    Where neither it nor a context-level folder is set, one machine (tests) gets a
    fresh temporary folder; a cluster is refused, as its machines share none.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tallgrass-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: the result survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read ``folder/name.parquet``."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def read_spread(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``read_table`` for work that is heavy per row: over all cores, however few files the table has.

    A scan that has a split per core is left alone, so large tables are never shuffled
    for this; only tables smaller than that are dealt out. Only a bare scan is asked
    for its partitions, which costs no job.
    """
    df = read_table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def distinct_by_key(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key; which of the repeated rows stays is decided by the rest of
    the columns (smallest values first, nulls first), so reruns agree.

    ``first(struct)`` after a sort is avoided: ``min`` over a struct is combined on
    the map side, hence a hot key costs one row per input partition.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    packed = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"))
    return packed.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)
