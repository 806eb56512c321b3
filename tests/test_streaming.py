import time

import pytest
from pyspark.sql import functions as F

from keyflow.operators import aggregates, routing
from keyflow.operators.policy import PolicyConfig
from keyflow.streaming import queries, rescale
from keyflow.streaming.boundary import Boundary
from keyflow.streaming.controller import Controller, Progress, ThresholdPolicy

SCHEMA = "event_id long, key string, value double, ts timestamp"


@pytest.fixture
def stream(spark, folder, tmp_path):
    """Events in files by time, with one at the end that closes all windows before it."""
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.streaming.stateStore.providerClass")}
    events = spark.read.parquet(f"{folder}/events.parquet").select("event_id", F.col("event_type").alias("key"), "value", F.col("ts").cast("timestamp").alias("ts"))
    last = events.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), F.lit("end").alias("key"), F.lit(0.0).alias("value"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    path = str(tmp_path / "events")
    events.coalesce(1).write.parquet(f"{path}")
    last.write.mode("append").parquet(f"{path}")
    queries.configure(spark, 3)
    yield events, path
    for k, v in kept.items():
        spark.conf.set(k, v) if v else spark.conf.unset(k)


def read(spark, path, files=1):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).option("latestFirst", "false").parquet(path)


def test_closed_windows_equal_the_batch(spark, stream, tmp_path):
    events, path = stream
    q = queries.write(queries.tumbling_stream(read(spark, path)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    expected = aggregates.tumbling_agg(events).select(*found.columns)
    assert found.exceptAll(expected).count() == 0
    assert expected.count() - found.count() == 0


def test_running_count_goes_on_after_rescaling(spark, stream, tmp_path):
    events, path = stream
    only = read(spark, path).where("event_id >= 0")
    queries.write(queries.running_count_stream(only), str(tmp_path / "a"), str(tmp_path / "cpa")).awaitTermination()
    total = {r.key: r["count"] for r in events.groupBy("key").count().collect()}
    assert {r.key: r["n"] for r in spark.read.parquet(str(tmp_path / "a")).groupBy("key").agg(F.max("count").alias("n")).collect()} == total
    assert rescale.partitions(spark, str(tmp_path / "cpa")) == 3
    assert {r.key: r["count"] for r in rescale.counts(spark, str(tmp_path / "cpa")).collect()} == total
    again = rescale.rescaled(spark, read(spark, path).where("event_id >= 0"), str(tmp_path / "cpa"), 5)
    queries.write(again, str(tmp_path / "b"), str(tmp_path / "cpb")).awaitTermination()
    assert {r.key: r["n"] for r in spark.read.parquet(str(tmp_path / "b")).groupBy("key").agg(F.max("count").alias("n")).collect()} == {k: 2 * n for k, n in total.items()}
    assert rescale.partitions(spark, str(tmp_path / "cpb")) == 5


COLUMNS = "query_id string, cpu double, mem double, p99 double, backpressured boolean, bottleneck_bp double, imbalance double, parallelism int"


def test_controller_acts_and_cools_down(spark):
    now, sent, aborted = [0.0], [], []
    sample = spark.createDataFrame([("b", 0.1, 0.1, 1.0, False, 0.0, 0.0, 4), ("a", 0.5, 0.5, 1.0, False, 0.0, 0.0, 4), ("c", 0.9, 0.1, 1.0, False, 0.0, 0.0, 4)], COLUMNS)
    plans = spark.createDataFrame([("x", i, i % 6, 0, 1) for i in range(8)], "operator_id string, pos int, partition_id int, source int, target int")
    control = Controller(lambda: sample, lambda decision, target: plans, sent.append, ThresholdPolicy(PolicyConfig(max_concurrent=4), clock=lambda: now[0]), aborted=aborted.append)
    assert control.trigger() == "SCALE_IN" and sent[0].count() == 4  # the first query, a, asks for nothing
    assert control.trigger() is None and control.policy.evaluate(sample).count() == 0
    now[0] = 61.0
    assert control.trigger() == "SCALE_IN"
    assert sorted(r.partition_id for r in sent[1].collect()) == [4, 5]  # those of the others are under way
    assert control.status() == {"started": False, "active": False, "history": 2, "migrations": 6}
    assert control.migration(1)["partition_id"] == 0 and control.migration(99) is None
    control.finished(1)
    control.policy.reset()
    control.run(rounds=1, sleep=lambda s: None)
    assert len(control.history) == 3 and control.started and control.migration(7)["partition_id"] == 0
    control.update(PolicyConfig(cpu_in=0.05))
    control.policy.reset()
    assert control.trigger() == "SCALE_OUT"
    control.shutdown()
    assert not control.migrations and len(aborted) == 6 and not control.started


def test_live_metrics_reach_the_policy(spark, stream, tmp_path):
    _, path = stream
    progress = Progress()
    spark.streams.addListener(progress)
    try:
        queries.write(queries.running_count_stream(read(spark, path)), str(tmp_path / "a"), str(tmp_path / "cpa")).awaitTermination()
        for _ in range(100):
            if progress.rows and progress.rows[-1][4]:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    table = progress.table(spark)
    assert table.agg(F.max("state_rows")).first()[0] > 1 and table.columns[:2] == ["query_id", "batch_id"]
    samples = progress.samples(spark, 4, 1, 1.0)
    row = samples.first()
    assert samples.count() == 1 and row.cpu == 1.0 and row.mem > 0.85 and row.parallelism == 4
    sent = []
    plan = spark.createDataFrame([("x", 0, 1, 0, 1)], "operator_id string, pos int, partition_id int, source int, target int")
    assert Controller(lambda: samples, lambda decision, target: plan, sent.append).trigger() == "SCALE_OUT" and len(sent) == 1


def test_barriers_take_effect_at_the_boundary(spark, tmp_path):
    """Batches keep the routes that held when they began; a batch that runs again gives the same and tells again."""
    routes = routing.default_routes(spark, ["job"], 4, 2)
    told = []
    boundary = Boundary(str(tmp_path / "log"), routes, lambda batch, migrations: told.append((batch, migrations)))
    batches = [spark.range(i * 8, i * 8 + 8).select(F.col("id").alias("seq"), F.pmod("id", F.lit(4)).cast("int").alias("key_group")) for i in range(4)]
    boundary(batches[0], 0)
    boundary.inject(7, [(0, 0, 1), (1, 1, 0)])
    boundary(batches[1], 1)
    boundary(batches[2], 2)
    boundary.inject(9, [(0, 1, 0)])
    boundary(batches[1], 1)  # run again: what was injected later waits
    boundary(batches[3], 3)
    assert told == [(1, [7]), (1, [7]), (3, [9])]
    out = spark.read.parquet(str(tmp_path / "log" / "out"))
    assert out.count() == 32
    seen = {(r.batch_id, r.key_group): r.subtask for r in out.select("batch_id", "key_group", "subtask").distinct().collect()}
    assert {k: v for k, v in seen.items() if k[0] < 2} == {(b, g): g % 2 for b in (0, 1) for g in range(4)}
    assert {g: seen[2, g] for g in range(4)} == {0: 1, 1: 0, 2: 0, 3: 1} == {g: seen[3, g] for g in range(4)}
    assert {r.partition_id: r.subtask for r in boundary.routes_at(spark, 4).collect()} == {0: 0, 1: 0, 2: 0, 3: 1}


def test_boundaries_of_a_stream(spark, stream, tmp_path):
    events, path = stream
    boundary = Boundary(str(tmp_path / "log"), routing.default_routes(spark, ["job"], 32, 4))
    boundary.inject(1, [(5, 1, 3)])
    source = read(spark, path).select("event_id", F.pmod("event_id", F.lit(32)).cast("int").alias("key_group"))
    source.writeStream.foreachBatch(boundary).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log" / "out")).count() == events.count() + 1
    assert boundary.barriers(spark).count() == 1 and not boundary.waiting
    assert {r.subtask for r in boundary.routes_at(spark, 99).where("partition_id = 5").collect()} == {3}


def test_keyed_store(spark, stream, tmp_path):
    schema = "seq long, key string, op string, value double"
    rows = [(1, "a", "PUT", 1.0), (2, "a", "GET", None), (3, "b", "GET", None), (4, "a", "DELETE", None), (5, "b", "PUT", 2.0), (6, "a", "GET", None)]
    more = [(7, "b", "GET", None), (8, "a", "PUT", 3.0)]
    for some in (rows, more):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    queries.write(queries.store_stream(source), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    found = {r.seq: r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {1: 1.0, 2: 1.0, 3: None, 4: None, 5: 2.0, 6: None, 7: 2.0, 8: 3.0}


def test_intervals(spark, stream, tmp_path):
    _, path = stream
    q = queries.write(queries.tumbling_stream(read(spark, path)), str(tmp_path / "out"), str(tmp_path / "cp"), interval_ms=200)
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0 and queries.INTERVALS == {"word_count": 60_000, "windowed": 30_000}
