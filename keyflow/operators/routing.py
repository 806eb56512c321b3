"""Routing tables: which subtask has which partition, in versions. Tables of partitions, bounded by the key groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyflow.operators.aggregates import numbered


def default_routes(spark: SparkSession, operators: list[str], partitions: int, parallelism: int) -> DataFrame:
    """Partition p of each operator at subtask p modulo the parallelism, version 0."""
    names = F.explode(F.array(*map(F.lit, operators))).alias("operator_id")
    routes = spark.range(partitions).select(names, F.col("id").cast("int").alias("partition_id"))
    return routes.select("operator_id", "partition_id", F.pmod("partition_id", F.lit(parallelism)).alias("subtask"), F.lit(0).cast("long").alias("version"))


def skewed(partition: Column) -> Column:
    """A subtask of 4 with half of 32 partitions at the first, a quarter at the second."""
    return F.when(partition < 16, 0).when(partition < 24, 1).when(partition < 28, 2).otherwise(3)


def route_records(records: DataFrame, routes: DataFrame) -> DataFrame:
    """Records (with ``key_group``) and the subtask that their group is routed to."""
    few = F.broadcast(routes.select(F.col("partition_id").alias("key_group"), "subtask"))  # a row for each key group
    return records.join(few, "key_group")


def distribution_stats(routes: DataFrame, parallelism: int) -> DataFrame:
    """Least, greatest and mean partitions of the subtasks of each operator, empty subtasks included, and imbalance."""
    counts = routes.groupBy("operator_id", "subtask").agg(F.count("*").alias("n"))
    stats = counts.groupBy("operator_id").agg(F.count("*").alias("full"), F.min("n").alias("low"), F.max("n").alias("high"), F.sum("n").alias("total"))
    least = F.when(F.col("full") < parallelism, F.lit(0).cast("long")).otherwise(F.col("low"))
    mean = F.col("total") / F.lit(float(parallelism))
    out = stats.select("operator_id", least.alias("min_partitions"), F.col("high").alias("max_partitions"), mean.alias("avg_partitions"))
    ratio = (F.col("max_partitions") - F.col("min_partitions")) / F.col("avg_partitions")
    return out.withColumn("imbalance", F.round(F.when(F.col("avg_partitions") == 0, 0.0).otherwise(ratio), 6))


def updates(barriers: DataFrame) -> DataFrame:
    """Route changes of barriers, one version for each barrier in their order: (partition_id, target, version). Versions
    are numbered in strides of the migration's id, as there is a barrier for every few records."""
    heads = barriers.select("migration_id").distinct().withColumn("__one", F.lit(1))
    heads = numbered(heads, "__one", "migration_id", "version").drop("__one")
    plans = barriers.select("migration_id", F.posexplode("plans").alias("pos", "plan"))
    return plans.join(heads, "migration_id").select(F.col("plan.partition_id").alias("partition_id"), F.col("plan.target").alias("subtask"), "version", "pos")


def apply_barriers(routes: DataFrame, changes: DataFrame) -> DataFrame:
    """Routes after all changes: the latest change of a partition, or its old route."""
    latest = changes.groupBy("partition_id").agg(F.max_by(F.struct("subtask", "version"), F.struct("version", "pos")).alias("c"))
    joined = routes.join(latest, "partition_id", "left")
    return joined.select("operator_id", "partition_id", F.coalesce("c.subtask", "subtask").cast("int").alias("subtask"), F.coalesce("c.version", "version").alias("version"))


def history(routes: DataFrame, changes: DataFrame, stride: int = 4096) -> DataFrame:
    """All routes that partitions have had: (partition_id, version, subtask, previous); a change back is a change.

    The route before a change is looked for in its stride of versions, and for the first of a stride it is the last of the
    strides before, so a partition with many changes is many tasks.
    """
    every = routes.select("partition_id", "subtask", "version", F.lit(-1).alias("pos")).unionByName(changes.select("partition_id", "subtask", "version", "pos"))
    cut = every.withColumn("stride", F.floor(F.col("version") / stride))
    lasts = cut.groupBy("partition_id", "stride").agg(F.max_by("subtask", F.struct("version", "pos")).alias("last"))
    earlier = F.lag("last").over(Window.partitionBy("partition_id").orderBy("stride"))
    lasts = lasts.select("partition_id", "stride", earlier.alias("earlier"))
    before = F.lag("subtask").over(Window.partitionBy("partition_id", "stride").orderBy("version", "pos"))
    here = F.row_number().over(Window.partitionBy("partition_id", "stride").orderBy("version", "pos"))
    placed = cut.withColumn("before", before).withColumn("first", here == 1).join(lasts, ["partition_id", "stride"])
    return placed.select("partition_id", "version", "pos", "subtask", F.when(F.col("first"), F.col("earlier")).otherwise(F.col("before")).alias("previous"))


def as_of(routes: DataFrame, changes: DataFrame, version: int) -> DataFrame:
    """The route of each partition at a version."""
    return apply_barriers(routes, changes.where(F.col("version") <= version))
