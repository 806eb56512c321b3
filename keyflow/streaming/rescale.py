"""Rescaling a stopped query: read its keyed state, take it over into a new query of another parallelism.

Structured Streaming pins a query's state partitions in its checkpoint, so rescaling is a stop and a restart with a new
checkpoint and the old state as the initial state: a short pause instead of an online hand-over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyflow.streaming.queries import configure, running_count_stream


def counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, count) that a running count had when it stopped."""
    state = spark.read.format("statestore").option("stateVarName", "count").load(checkpoint)
    return state.select(F.col("key.key").alias("key"), F.col("value.count").alias("count"))


def partitions(spark: SparkSession, checkpoint: str) -> int:
    """How many partitions a query's state has."""
    return spark.read.format("state-metadata").load(checkpoint).agg(F.max("numPartitions")).first()[0]


def rescaled(spark: SparkSession, events: DataFrame, checkpoint: str, parallelism: int) -> DataFrame:
    """The running count of ``events`` going on from the state of ``checkpoint`` with another parallelism."""
    configure(spark, parallelism)
    return running_count_stream(events, counts(spark, checkpoint))
