"""The threshold policy: metrics to decisions, decisions to migration plans.

Decisions are expressions over a table of metrics, so a replay over any number of samples is one pass. Plans are tables of
partitions. All comparisons with thresholds are strict.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields, replace
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PolicyConfig:
    """Thresholds, factors and periods of the policy, of the planner and of migrations."""

    cpu_out: float = 0.8
    cpu_in: float = 0.3
    memory_out: float = 0.85
    memory_in: float = 0.4
    latency_ms: float = 1000.0
    backpressure: float = 0.5
    throughput_drop: float = 0.2
    imbalance: float = 0.3
    min_parallelism: int = 1
    max_parallelism: int = 128
    out_factor: float = 1.5
    in_factor: float = 0.75
    cooldown_ms: int = 60_000
    max_concurrent: int = 10
    convergence_bytes: int = 5 << 20
    max_rounds: int = 10
    bandwidth_mbps: float = 100.0
    metrics_window_ms: int = 300_000
    metrics_interval_ms: int = 5_000
    evaluation_interval_ms: int = 30_000

    def with_options(self, **options) -> PolicyConfig:
        return replace(self, **options)

    @classmethod
    def from_options(cls, spark: SparkSession, prefix: str = "spark.keyflow.") -> PolicyConfig:
        """What a job's settings say: ``prefix`` and a field's name, such as spark.keyflow.cpu_out; the rest by default."""
        found = {}
        for f in fields(cls):
            value = spark.conf.get(prefix + f.name, None)
            if value is not None:
                found[f.name] = type(f.default)(float(value)) if isinstance(f.default, int) else float(value)
        return cls(**found)


class Policy(Protocol):
    """What the planner asks of a policy. ``evaluate`` gives a decision for each sample, none while it keeps still."""

    config: PolicyConfig

    def evaluate(self, metrics: DataFrame) -> DataFrame: ...

    def acted(self) -> None: ...

    def update(self, config: PolicyConfig) -> None: ...

    def reset(self) -> None: ...


def scale_targets(parallelism: DataFrame, config: PolicyConfig = PolicyConfig()) -> DataFrame:
    """The parallelism after a step out and a step in."""
    p = F.col("parallelism")
    out = F.least(F.ceil(p * config.out_factor), F.lit(config.max_parallelism)).cast("int")
    inward = F.greatest(F.floor(p * config.in_factor), F.lit(config.min_parallelism)).cast("int")
    return parallelism.select("parallelism", out.alias("scale_out"), inward.alias("scale_in"))


def _percent(x: Column) -> Column:
    return F.format_string("%.2f", F.round(x * 100, 2))


def decide(metrics: DataFrame, config: PolicyConfig = PolicyConfig()) -> DataFrame:
    """Decision, target and reason for each sample (cpu, mem, p99, backpressured, bottleneck_bp, imbalance, parallelism).

    Scaling out is tried for the first cause that holds (processor, memory, latency, backpressure); where its target
    would be the same, scaling in is tried, and where that doesn't apply or would change nothing, rebalancing.
    """
    c = F.col
    p = c("parallelism")
    over = lambda what, value, limit, unit: F.concat(F.lit(f"{what} at "), value, F.lit(f"{unit}, limit "), limit, F.lit(unit))
    plain = lambda x: F.format_string("%.2f", F.round(x, 2))
    cause = (
        F.when(c("cpu") > config.cpu_out, over("cpu", _percent(c("cpu")), _percent(F.lit(config.cpu_out)), "%"))
        .when(c("mem") > config.memory_out, over("memory", _percent(c("mem")), _percent(F.lit(config.memory_out)), "%"))
        .when(c("p99") > config.latency_ms, over("p99", plain(c("p99")), plain(F.lit(config.latency_ms)), " ms"))
        .when(c("backpressured") & (c("bottleneck_bp") > config.backpressure), over("backpressure", _percent(c("bottleneck_bp")), _percent(F.lit(config.backpressure)), "%"))
    )
    idle = F.when((c("cpu") < config.cpu_in) & (c("mem") < config.memory_in), F.concat(F.lit("idle: cpu "), _percent(c("cpu")), F.lit("%, memory "), _percent(c("mem")), F.lit("%")))
    uneven = F.when(c("imbalance") > config.imbalance, F.concat(F.lit("uneven by "), _percent(c("imbalance")), F.lit("%")))
    out = F.least(F.ceil(p * config.out_factor), F.lit(config.max_parallelism)).cast("int")
    inward = F.greatest(F.floor(p * config.in_factor), F.lit(config.min_parallelism)).cast("int")
    named = metrics.withColumns({"__out": F.when(out != p, cause), "__in": F.when(inward != p, idle), "__even": uneven})
    has = lambda x: c(x).isNotNull()
    return named.withColumns({
        "decision": F.when(has("__out"), "SCALE_OUT").when(has("__in"), "SCALE_IN").when(has("__even"), "REBALANCE").otherwise("NONE"),
        "target": F.when(has("__out"), out).when(has("__in"), inward).when(has("__even"), p).cast("int"),
        "reason": F.coalesce("__out", "__in", "__even"),
    }).drop("__out", "__in", "__even")


def cooled(decisions: DataFrame, period_ms: int, *by: str) -> DataFrame:
    """The actions that a cooldown lets through: each one at least the period after the last that went through.

    The last action decides on the next, so the actions of a job (a row for each evaluation that led to one) are gone
    through in order of time, in one task a job, in batches and with one number kept.
    """
    acts = decisions.where(F.col("decision") != "NONE").withColumn("__t", F.unix_millis(F.col("hour").cast("timestamp")))
    job = F.xxhash64(*by) if by else F.lit(0).cast("long")
    times = acts.select(*by, job.alias("__job"), "__t").where("__t is not null").distinct()
    dealt = times.repartition("__job").sortWithinPartitions("__job", *by, "__t")
    names = [*by, "__t"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, last = None, None
        for batch in batches:
            keep = []
            for i, row in enumerate(zip(*(batch.column(n).to_pylist() for n in names), strict=True)):
                if row[:-1] != job or last is None or row[-1] - last >= period_ms:
                    job, last = row[:-1], row[-1]
                    keep.append(i)
            yield batch.select(names).take(pa.array(keep, pa.int64()))

    kept = dealt.mapInArrow(walk, dealt.select(*names).schema)
    same = [acts[n].eqNullSafe(kept[n]) for n in names]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return acts.join(kept, condition, "left_semi").drop("__t")


def retry_delays(attempts: DataFrame, base_ms: int = 1000) -> DataFrame:
    """How long to wait after each failed attempt (from 0): it grows by ``base_ms`` each time."""
    return attempts.select("attempt", ((F.col("attempt") + 1) * base_ms).cast("long").alias("delay_ms"))


def scaling_history(decisions: DataFrame, keep: int = 100) -> DataFrame:
    """The latest ``keep`` actions."""
    return decisions.where(F.col("decision") != "NONE").orderBy(F.desc("hour")).limit(keep)


def scale_plan(partitions: DataFrame, target: int) -> DataFrame:
    """Moves of an operator's partitions (partition_id, subtask, state_size) to the modulo routes of a new parallelism."""
    to = F.pmod("partition_id", F.lit(target))
    return partitions.where(F.col("subtask") != to).select("partition_id", F.col("subtask").alias("source"), to.cast("int").alias("target"), "state_size")


def rebalance_plan(partitions: DataFrame, parallelism: int, include_empty: bool = False) -> DataFrame:
    """Moves from subtasks with more than one partition above the even share to occupied ones below it.

    Donors give their first partitions; receivers are filled from the least loaded up, of equal ones the smallest first:
    the n-th partition given goes to the n-th free place, places in order of (load before it, subtask).
    ``include_empty`` lets subtasks without partitions receive.
    """
    counts = partitions.groupBy("subtask").agg(F.count("*").alias("n"))
    base = F.floor(F.sum("n").over(Window.partitionBy(F.lit(0))) / parallelism)
    if include_empty:
        every = partitions.sparkSession.range(parallelism).select(F.col("id").cast("int").alias("subtask"))
        counts = every.join(counts, "subtask", "left").select("subtask", F.coalesce("n", F.lit(0)).alias("n"))
    counts = counts.withColumn("base", base)
    rank = F.row_number().over(Window.partitionBy("subtask").orderBy("partition_id"))
    donors = partitions.withColumn("nth", rank).join(F.broadcast(counts.where("n > base + 1")), "subtask").where("nth <= n - base")
    order = Window.partitionBy(F.lit(0)).orderBy("subtask", "partition_id")
    given = donors.select("partition_id", F.col("subtask").alias("source"), "state_size", F.row_number().over(order).alias("turn"))
    free = counts.where("n < base").select("subtask", F.explode(F.sequence(F.col("n"), F.col("base") - 1)).alias("load"))
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("load", "subtask"))
    places = free.select(F.col("subtask").alias("target"), turn.alias("turn"))
    return given.join(places, "turn").select("partition_id", "source", "target", "state_size")


def filter_overlapping(plans: DataFrame, cap: int = 10) -> DataFrame:
    """The first plan (by pos) of each partition of an operator, the first ``cap`` of them."""
    first = plans.withColumn("__n", F.row_number().over(Window.partitionBy("operator_id", "partition_id").orderBy("pos"))).where("__n = 1").drop("__n")
    return first.orderBy("pos").limit(cap)


def reject_overlapping(plans: DataFrame, active: DataFrame) -> DataFrame:
    """Plans of partitions that no active migration moves."""
    return plans.join(F.broadcast(active.select("operator_id", "partition_id")), ["operator_id", "partition_id"], "left_anti")


def start_migrations(plans: DataFrame, active: DataFrame, next_id: int = 1) -> DataFrame:
    """Accepted plans with migration ids in order of pos."""
    free = reject_overlapping(plans, active)
    return free.withColumn("migration_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("pos")) + F.lit(next_id - 1))
