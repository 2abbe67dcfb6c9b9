"""The judgment log as a stream: the same consensus as the batch, kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qaloom.operators.panel import CRITERION, consensus

SCHEMA = "QA_Type string, Batch string, Seed_Type string, Root_ID long, Criterion_No int, Judge string, Verdict string"


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(folder)


def running_consensus(log: DataFrame, unsure: str = "exclude") -> DataFrame:
    """Consensus of each criterion from one vote a judge (of conflicting ones the least word).  For complete output: every
    criterion's state is kept, as votes may arrive at any time and carry none."""
    return consensus(log, unsure, CRITERION)


def deduplicated(log: DataFrame) -> DataFrame:
    """Votes delivered more than once count once."""
    return log.dropDuplicates([*CRITERION, "Judge"])


def to_table(log: DataFrame, path: str, checkpoint: str):
    """Appends new votes to a table exactly once."""
    return log.withColumn("arrived", F.current_timestamp()).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
