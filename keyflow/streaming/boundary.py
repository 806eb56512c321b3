"""Barriers of a running stream: the boundary between two micro-batches.

A micro-batch is finished in all partitions before the next one starts, so a boundary is a barrier that is aligned on every
channel. ``Boundary`` is a foreachBatch function. Migrations that were injected take effect at the next boundary, in this
order: the batch is written with the routes that held for it, the barrier is written to the log, routes are updated, the
listener is told, and the next batch goes on with the new routes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyflow.operators import routing

ROUTES = "operator_id string, partition_id int, subtask int, version long"
BARRIERS = "migration_id long, checkpoint_id long, plans array<struct<partition_id:int,source:int,target:int>>, batch_id long"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


class Boundary:
    """Writes routed batches to ``folder``/out and barriers to ``folder``/barriers, a folder for each batch.

    A batch that is run again after a failure writes the same folders again, with the same barriers: what was injected
    since waits for the next boundary, and routes are those of the barriers before it. So restarts lose and repeat nothing.
    """

    def __init__(self, folder: str, routes: DataFrame, told: Callable[[int, list[int]], None] = lambda batch_id, migrations: None):
        self.folder, self.routes, self.told = folder, routes, told
        self.waiting: list[tuple[int, list[tuple[int, int, int]]]] = []

    def inject(self, migration_id: int, plans: list[tuple[int, int, int]]) -> None:
        """Have a barrier with plans (partition, source, target) at the next boundary."""
        self.waiting.append((migration_id, plans))

    def barriers(self, spark: SparkSession) -> DataFrame:
        return _read(spark, f"{self.folder}/barriers", BARRIERS)

    def routes_at(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """The routes that hold for a batch: those after all barriers of earlier batches."""
        return routing.apply_barriers(self.routes, routing.updates(self.barriers(spark).where(F.col("batch_id") < batch_id)))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        routed = routing.route_records(batch, self.routes_at(spark, batch_id))
        routed.write.mode("overwrite").parquet(f"{self.folder}/out/batch_id={batch_id}")
        done = [r.migration_id for r in self.barriers(spark).where(F.col("batch_id") == batch_id).select("migration_id").collect()]
        if not done and self.waiting:
            rows = [(m, -m - 1, plans) for m, plans in self.waiting]
            made = spark.createDataFrame(rows, BARRIERS.rsplit(", batch_id", 1)[0])
            made.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/barriers/batch_id={batch_id}")
            done, self.waiting = [m for m, _ in self.waiting], []
        if done:
            self.told(batch_id, sorted(done))
