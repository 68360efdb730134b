"""The retrieval log as JSON lines."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession

from tallgrass import model

_JSON = {"viaId": "via_id", "idHits": "id_hits"}


def _schema() -> str:
    text = model.TELEMETRY
    for json_name, name in _JSON.items():
        text = text.replace(f"{name} ", f"{json_name} ", 1)
    return text


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of a log file or folder; malformed and blank lines are dropped."""
    return spark.read.schema(_schema()).option("mode", "DROPMALFORMED").json(path).withColumnsRenamed(_JSON)


def stream_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(_schema()).option("mode", "DROPMALFORMED").json(path).withColumnsRenamed(_JSON)


def append_log(events: DataFrame, path: str) -> bool:
    """Append events; a failure is logged and never reaches the search that caused it."""
    try:
        events.withColumnsRenamed({v: k for k, v in _JSON.items()}).write.mode("append").json(path)
        return True
    except Exception:
        logging.getLogger(__name__).warning("the retrieval log could not be written", exc_info=True)
        return False


def read_documents(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``path, source`` of all files under a folder, whole."""
    from pyspark.sql import functions as F

    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(folder, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("source"))


def verdicts_under(spark: SparkSession, folder: str) -> DataFrame:
    """Memory-impact lines of all learnings files under a folder."""
    from pyspark.sql import functions as F

    from tallgrass.operators import usage

    return usage.verdict_lines(read_documents(spark, folder, "learnings.md").withColumn("repo", F.lit(None).cast("string"))).drop("repo")
