"""The control loop: collect metrics, ask the policy, filter plans, record what was decided, hand plans over.

The driver holds decisions, plans and progress reports, bounded by the history kept, by the cap on migrations and by the
reports kept; metrics of records stay tables.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from keyflow.operators.policy import Policy, PolicyConfig, decide, filter_overlapping, reject_overlapping
from keyflow.sources.tables import PROGRESS, progress_tuples

ACTIVE = "migration_id int, operator_id string, partition_id int, source int, target int"


class ThresholdPolicy:
    """Decides by thresholds, and keeps still for the cooldown after an action."""

    def __init__(self, config: PolicyConfig = PolicyConfig(), clock: Callable[[], float] = time.time):
        self.config, self.clock, self.last = config, clock, float("-inf")

    def evaluate(self, metrics: DataFrame) -> DataFrame:
        """Decisions of a table of samples; no rows while the cooldown lasts."""
        decided = decide(metrics, self.config)
        return decided.where("false") if (self.clock() - self.last) * 1000 < self.config.cooldown_ms else decided

    def acted(self) -> None:
        self.last = self.clock()

    def update(self, config: PolicyConfig) -> None:
        self.config = config

    def reset(self) -> None:
        self.last = float("-inf")


class Progress(StreamingQueryListener):
    """Live metrics: keeps the latest progress reports of running queries as rows of their stateful operators."""

    def __init__(self, keep: int = 1000):
        self.rows: deque = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        states = [{"numRowsTotal": s.numRowsTotal, "memoryUsedBytes": s.memoryUsedBytes, "numRowsDroppedByWatermark": s.numRowsDroppedByWatermark} for s in p.stateOperators]
        busy = float((p.durationMs or {}).get("triggerExecution", 0))
        for row in progress_tuples({"id": p.id, "batchId": p.batchId, "inputRowsPerSecond": p.inputRowsPerSecond, "stateOperators": states}):
            self.rows.append((*row, float(p.processedRowsPerSecond or 0.0), busy))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), PROGRESS + ", processed_rate double, busy_ms double")

    def samples(self, spark: SparkSession, parallelism: int, memory_capacity: int, interval_ms: float) -> DataFrame:
        """A sample of metrics for the policy from the latest batch of each query, all its operators together: use is the
        share of the interval that the batch took, memory that of the capacity, and what comes in faster than it is
        processed is backpressure."""
        rows = self.table(spark)
        latest = rows.groupBy("query_id").agg(F.max("batch_id").alias("batch_id"))
        batch = rows.join(F.broadcast(latest), ["query_id", "batch_id"]).groupBy("query_id", "batch_id").agg(
            F.max("busy_ms").alias("p99"), F.sum("state_bytes").alias("bytes"), F.max("input_rate").alias("rate"), F.max("processed_rate").alias("processed")
        )
        behind = F.when(F.col("rate") > F.col("processed"), 1 - F.col("processed") / F.col("rate")).otherwise(0.0)
        return batch.select(
            "query_id", "batch_id", F.least(F.col("p99") / interval_ms, F.lit(1.0)).alias("cpu"), (F.col("bytes") / memory_capacity).alias("mem"), "p99",
            (behind > 0).alias("backpressured"), behind.alias("bottleneck_bp"), F.lit(0.0).alias("imbalance"), F.lit(parallelism).alias("parallelism"),
        )


class Controller:
    """Evaluates on request (``trigger``) or in a loop (``run``); ``planner`` makes the plans of a decision.

    A table of several samples is several operators or queries: the first of them, in order of ``order`` where the table
    has those columns, that calls for an action is acted on. Plans of partitions that are already migrating are left out;
    those handed over are active until ``finished`` or ``abort``.
    """

    def __init__(
        self, collect: Callable[[], DataFrame], planner: Callable[[str, int], DataFrame], deliver: Callable[[DataFrame], None], policy: Policy | None = None,
        order: tuple[str, ...] = ("hour", "batch_id", "query_id", "operator_id"), aborted: Callable[[dict], None] = lambda migration: None,
    ):
        self.collect, self.planner, self.deliver, self.order, self.aborted = collect, planner, deliver, order, aborted
        self.policy = policy or ThresholdPolicy()
        self.history: deque = deque(maxlen=100)
        self.migrations: dict[int, dict] = {}
        self.active = self.started = False
        self.next_id = 1

    def trigger(self) -> str | None:
        """One evaluation: the decision that was acted on, if any."""
        decided = self.policy.evaluate(self.collect()).where("decision <> 'NONE'")
        row = decided.orderBy(*(c for c in self.order if c in decided.columns), "decision", "reason").select("decision", "target", "reason").first()
        if row is None:
            return None
        plans = self.planner(row.decision, row.target)
        taken = [tuple(m[c] for c in ("migration_id", "operator_id", "partition_id", "source", "target")) for m in self.migrations.values()]
        free = reject_overlapping(plans, plans.sparkSession.createDataFrame(taken, ACTIVE)) if taken else plans
        chosen = filter_overlapping(free, self.policy.config.max_concurrent)
        self.deliver(chosen)
        for p in chosen.orderBy("pos").collect():  # max_concurrent at most
            self.migrations[self.next_id] = {"migration_id": self.next_id, **{c: p[c] for c in ("operator_id", "partition_id", "source", "target")}}
            self.next_id += 1
        self.policy.acted()
        self.history.append((time.time(), row.decision, row.reason))
        return row.decision

    def run(self, rounds: int | None = None, sleep: Callable[[float], None] = time.sleep) -> None:
        """Evaluate every interval until stopped, or for a number of rounds."""
        self.active = self.started = True
        while self.active and rounds != 0:
            self.trigger()
            rounds = None if rounds is None else rounds - 1
            if self.active and rounds != 0:
                sleep(self.policy.config.evaluation_interval_ms / 1000)

    def migration(self, migration_id: int) -> dict | None:
        return self.migrations.get(migration_id)

    def finished(self, migration_id: int) -> None:
        self.migrations.pop(migration_id, None)

    def abort(self, migration_id: int) -> None:
        migration = self.migrations.pop(migration_id, None)
        if migration:
            self.aborted(migration)

    def update(self, config: PolicyConfig) -> None:
        self.policy.update(config)

    def use(self, policy: Policy) -> None:
        self.policy = policy

    def stop(self) -> None:
        """Stop evaluating; migrations go on."""
        self.active = False

    def shutdown(self) -> None:
        """Stop, and abort all that is under way."""
        self.stop()
        self.started = False
        for migration_id in list(self.migrations):
            self.abort(migration_id)

    def status(self) -> dict:
        return {"started": self.started, "active": self.active, "history": len(self.history), "migrations": len(self.migrations)}
