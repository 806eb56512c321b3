"""Load metrics of partitions, operators and jobs, and what the policy reads from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_EXACT = "decimal(18,2)"
#: Seconds that the event table spans, for rates.
SPAN = 2_592_000


def _mean(column: str = "value") -> Column:
    return F.sum(F.col(column).cast(_EXACT)).cast("double") / F.count("*")


def partition_metrics(events: DataFrame, *by: str) -> DataFrame:
    """Rows, input rate, processing time and state size of each key group (and operator)."""
    grouped = events.groupBy(*by, "key_group")
    return grouped.agg(
        F.count("*").alias("n"),
        F.round(F.count("*") / F.lit(float(SPAN)), 9).alias("input_rate"),
        F.round(_mean(), 6).alias("processing_time"),
        F.sum(F.octet_length("props")).cast("long").alias("state_size"),
    )


def load_imbalance(metrics: DataFrame) -> DataFrame:
    """Imbalance of input rate times processing time over the occupied subtasks of each operator: (max - min) / mean."""
    cost = F.col("input_rate").cast("decimal(20,9)") * F.col("processing_time").cast("decimal(18,6)")
    loads = metrics.groupBy("operator_id", "subtask").agg(F.sum(cost).cast("double").alias("load"))
    stats = loads.groupBy("operator_id").agg(F.count("*").alias("subtasks"), F.min("load").alias("low"), F.max("load").alias("high"), F.avg("load").alias("mean"))
    ratio = F.when((F.col("subtasks") <= 1) | (F.col("mean") <= 0), 0.0).otherwise((F.col("high") - F.col("low")) / F.col("mean"))
    return stats.select("operator_id", "subtasks", F.round(ratio, 6).alias("imbalance"))


def operator_metrics(events: DataFrame) -> DataFrame:
    """Input rate, processor use and backpressure (share of errors) of each operator."""
    return events.groupBy("operator_id").agg(
        F.round(F.count("*") / F.lit(float(SPAN)), 9).alias("input_rate"),
        F.round(_mean() / 100.0, 6).alias("cpu"),
        F.round(F.count(F.when(F.col("key") == "error", 1)) / F.count("*"), 6).alias("backpressure"),
    )


def bottleneck(operators: DataFrame) -> DataFrame:
    """The operator with the most backpressure, if any has some; of equal ones the smallest id."""
    pressed = operators.where(F.col("backpressure") > 0)
    best = pressed.agg(F.min_by(F.struct("operator_id", "backpressure"), F.struct(-F.col("backpressure"), F.col("operator_id"))).alias("b"))
    return best.where("b is not null").select("b.operator_id", "b.backpressure")


def scale_in_target(operators: DataFrame) -> DataFrame:
    """The operator with the least processor use times input rate; of equal ones the smallest id."""
    load = F.round(F.col("cpu") * F.col("input_rate"), 12).alias("load")
    loads = operators.select("operator_id", load)
    return loads.agg(F.min_by(F.struct("operator_id", "load"), F.struct("load", "operator_id")).alias("b")).where("b is not null").select("b.operator_id", "b.load")


def _percentile(events: DataFrame, share: float) -> DataFrame:
    """(hour, p): the interpolated percentile of the values of each hour, from counts of its different values in order, so
    no task holds an hour's values."""
    counts = events.where("value is not null").groupBy(F.date_trunc("hour", "ts").alias("hour"), "value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("hour").orderBy("value"))
    total = counts.groupBy("hour").agg(F.sum("n").alias("total"))
    placed = counts.withColumn("upto", upto).join(total, "hour").withColumn("at", (F.col("total") - 1) * F.lit(share))
    ends = placed.groupBy("hour").agg(
        F.min(F.when(F.col("upto") > F.floor("at"), F.col("value"))).alias("low"), F.min(F.when(F.col("upto") > F.ceil("at"), F.col("value"))).alias("high"), F.first("at").alias("at")
    )
    near = (F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high")
    return ends.select("hour", F.when(F.floor("at") == F.ceil("at"), F.col("low")).otherwise(near).alias("p"))


def job_metrics(events: DataFrame) -> DataFrame:
    """Hourly job metrics: processor and memory use against the table's means, latency, backpressure, throughput."""
    hours = events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count("*").alias("n"),
        F.sum(F.col("value").cast(_EXACT)).alias("total"),
        F.round(F.count(F.when(F.col("key") == "error", 1)) / F.count("*"), 4).alias("bp"),
    )
    hours = hours.join(_percentile(events, 0.99), "hour", "left").withColumn("p99", F.round(F.col("p") * 4, 2))
    mean = hours.agg(F.sum("n") / F.count("*"), F.sum("total").cast("double") / F.count("*")).first()  # two numbers
    n, total = (float(x or 1.0) for x in mean)
    cpu, mem = F.round(F.col("n") / F.lit(1.8 * n), 4), F.round(F.col("total").cast("double") / F.lit(2.5 * total), 4)
    return hours.select("hour", cpu.alias("cpu"), mem.alias("mem"), "p99", "bp", (F.col("bp") > 0.25).alias("backpressured"), F.round(F.col("n") / 3600.0, 9).alias("throughput"))


def hourly_bottleneck(events: DataFrame) -> DataFrame:
    """(hour, bottleneck_bp): the backpressure of the operator that has the most in each hour; 0 if none has any."""
    share = F.round(F.count(F.when(F.col("key") == "error", 1)) / F.count("*"), 6)
    operators = events.groupBy(F.date_trunc("hour", "ts").alias("hour"), "operator_id").agg(share.alias("backpressure"))
    return operators.groupBy("hour").agg(F.max("backpressure").alias("bottleneck_bp"))


def hourly_imbalance(events: DataFrame, limit: float) -> DataFrame:
    """(hour, imbalance): the imbalance of the first operator by id that exceeds ``limit`` in each hour; 0 if none does."""
    parts = events.withColumn("hour", F.date_trunc("hour", "ts")).groupBy("hour", "operator_id", "subtask", "key_group")
    cost = (F.round(F.count("*") / 3600.0, 9).cast("decimal(20,9)") * F.round(_mean(), 6).cast("decimal(18,6)")).alias("cost")
    loads = parts.agg(cost).groupBy("hour", "operator_id", "subtask").agg(F.sum("cost").cast("double").alias("load"))
    stats = loads.groupBy("hour", "operator_id").agg(F.count("*").alias("subtasks"), F.min("load").alias("low"), F.max("load").alias("high"), F.avg("load").alias("mean"))
    ratio = F.round(F.when((F.col("subtasks") <= 1) | (F.col("mean") <= 0), 0.0).otherwise((F.col("high") - F.col("low")) / F.col("mean")), 6)
    uneven = stats.withColumn("imbalance", ratio).groupBy("hour").agg(F.min_by("imbalance", F.when(F.col("imbalance") > limit, F.col("operator_id"))).alias("imbalance"))
    return uneven.select("hour", F.coalesce("imbalance", F.lit(0.0)).alias("imbalance"))


def memory_ratio(partitions: DataFrame) -> DataFrame:
    """State of each subtask (subtask, state_size, memory_capacity) as a share of its capacity; null without a capacity."""
    used = partitions.groupBy("subtask").agg(F.sum("state_size").alias("used"), F.max("memory_capacity").alias("capacity"))
    return used.select("subtask", "used", "capacity", F.round(F.col("used") / F.when(F.col("capacity") > 0, F.col("capacity")), 9).alias("ratio"))
