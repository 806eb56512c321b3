"""Barriers on channels, and the records that wait behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyflow.operators.aggregates import numbered


def arrivals(barriers: DataFrame) -> DataFrame:
    """The first barrier of each channel of a migration: (migration_id, channel, arrival); repeats don't count."""
    return barriers.groupBy("migration_id", "channel").agg(F.min("arrival").alias("arrival"), (F.count("*") - 1).alias("repeats"))


def alignment(barriers: DataFrame, channels: int) -> DataFrame:
    """Whether all channels of a migration have its barrier, and when the last came."""
    grouped = arrivals(barriers).groupBy("migration_id").agg(F.count("*").alias("n_channels"), F.max("arrival").alias("last"), F.sum("repeats").alias("n_repeats"))
    whole = F.col("n_channels") == channels
    return grouped.select("migration_id", "n_channels", "n_repeats", whole.alias("aligned"), F.when(whole, F.col("last")).alias("aligned_at"))


def blocked(barriers: DataFrame, channels: int) -> DataFrame:
    """How long each channel is blocked: from its barrier to alignment, open if that never comes."""
    whole = alignment(barriers, channels).select("migration_id", "aligned_at")
    return arrivals(barriers).join(whole, "migration_id").select("migration_id", "channel", F.col("arrival").alias("blocked_from"), F.col("aligned_at").alias("blocked_to"))


def affects(plans: str, partition: int) -> Column:
    """Whether any plan of a barrier moves the partition."""
    return F.exists(plans, lambda p: p.partition_id == partition)


def plan_for(plans: str, partition: int) -> Column:
    """The first plan of a barrier for the partition, or null."""
    return F.try_element_at(F.filter(plans, lambda p: p.partition_id == partition), F.lit(1))


def kinds(barriers: DataFrame) -> DataFrame:
    """Barriers that only migrate (their checkpoint id is below 0) and those of a checkpoint."""
    return barriers.withColumn("kind", F.when(F.col("checkpoint_id") < 0, "MIGRATION").otherwise("CHECKPOINT"))


def size(plans: str) -> Column:
    """Estimated bytes of a serialised barrier."""
    return F.lit(33) + F.size(plans) * 300


_PLANS = "array<struct<partition_id:int,source:int,target:int>>"
_FIELDS = f"migration_id bigint, checkpoint_id bigint, plans {_PLANS}"


def standalone(migrations: DataFrame) -> DataFrame:
    """Barriers of migrations (migration_id, plans) that belong to no checkpoint: their id is below 0."""
    return migrations.select("migration_id", (-F.col("migration_id") - 1).alias("checkpoint_id"), "plans")


def final(migrations: DataFrame, checkpoint_id: int) -> DataFrame:
    """Barriers that close migrations with a checkpoint: they carry its id and leave no plan open."""
    if checkpoint_id < 0:
        raise ValueError("the id of a checkpoint isn't below 0")
    return migrations.select("migration_id", F.lit(checkpoint_id).cast("long").alias("checkpoint_id"), F.array().cast(_PLANS).alias("plans"))


def encode(barriers: DataFrame) -> DataFrame:
    """Each barrier as one JSON text, without loss."""
    return barriers.select(F.to_json(F.struct("migration_id", "checkpoint_id", "plans")).alias("message"))


def decode(messages: DataFrame) -> DataFrame:
    return messages.select(F.from_json("message", _FIELDS).alias("b")).select("b.*")


def waiting(records: DataFrame, partitions: list[int], barrier_seq: float) -> DataFrame:
    """The records behind the barrier of migrating partitions; ``seq`` is their order."""
    return records.where(F.col("key_group").isin(partitions) & (F.col("seq") > barrier_seq))


def bounded(records: DataFrame, capacity: int) -> DataFrame:
    """Records with their place in the buffer of their partition, and whether it still had room for them."""
    return numbered(records, "key_group", "seq", "place").withColumn("accepted", F.col("place") <= capacity)


def flush(records: DataFrame) -> DataFrame:
    """Records with their place in the order in which the buffers of their partitions are replayed."""
    return numbered(records, "key_group", "seq", "place").withColumn("place", F.col("place").cast("int"))


def replay(counts: DataFrame, records: DataFrame) -> DataFrame:
    """Buffered records replayed in order at their target: each goes on from the count (key_group, count) that the state of
    its partition had at the barrier."""
    at = counts.select("key_group", F.col("count").alias("__before"))
    placed = numbered(records, "key_group", "seq", "place").join(F.broadcast(at), "key_group", "left")  # a row for each key group
    return placed.select("seq", "key_group", (F.col("place") + F.coalesce("__before", F.lit(0))).cast("long").alias("count"))


def buffer_stats(records: DataFrame, bytes_each: int = 100) -> DataFrame:
    return records.groupBy("key_group").agg(F.count("*").alias("n_records"), (F.count("*") * bytes_each).alias("n_bytes"))
