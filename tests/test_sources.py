import pytest
from pyspark.sql import functions as F

from keyflow.operators import barriers
from keyflow.operators.policy import PolicyConfig
from keyflow.sources import tables
from keyflow.streaming import queries


def drain(stream, name, spark):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    while not spark.table(name).take(1):
        q.processAllAvailable()
    return q


def test_generators(spark):
    q = drain(tables.word_source(spark, 50), "generated_words", spark)
    assert {r.word for r in spark.table("generated_words").collect()} <= set(tables.WORDS)
    assert tables.progress_rows(spark, q).columns[:2] == ["query_id", "batch_id"]
    q.stop()
    q = drain(tables.event_source(spark, 50), "generated_events", spark)
    q.stop()
    rows = spark.table("generated_events").orderBy("event_id").collect()
    assert {r.key for r in rows} <= set(tables.SENSORS) and all(0 <= r.value < 100 for r in rows)
    assert [r.ts for r in rows] == sorted(r.ts for r in rows)
    assert tables.sample_words(spark, 500).select("word").distinct().count() == len(tables.WORDS)


def test_late_records_are_dropped_by_the_watermark(spark, tmp_path):
    """A record behind the watermark of an earlier batch is dropped; the filter lags one batch behind a per-record one."""
    at = lambda s: f"timestamp'2024-01-01 00:00:00' + interval {s} second"
    files = [(1, 30), (2, 200), (3, 210), (4, 20), (5, 400)]
    for i, second in files:
        row = spark.range(1).selectExpr(f"cast({i} as long) event_id", "'k' key", "1.0D value", f"{at(second)} ts")
        row.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "event_id long, key string, value double, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = queries.write(queries.tumbling_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    found = {r.window_start.minute: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {0: 1, 3: 2}
    assert sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"]) == 1


def test_word_counts_of_a_stream(spark, tmp_path):
    words = tables.sample_words(spark, 300)
    words.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("word string, id long").parquet(str(tmp_path / "in"))
    q = queries.word_count_stream(stream).writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, words.groupBy("word").count().collect()))


def test_standalone_barriers_go_through_messages(spark):
    plans = spark.createDataFrame([(0, [(1, 2, 3)]), (7, [])], "migration_id long, plans array<struct<partition_id:int,source:int,target:int>>")
    made = barriers.standalone(plans)
    assert made.exceptAll(barriers.decode(barriers.encode(made))).count() == 0
    assert {r.kind for r in barriers.kinds(made).collect()} == {"MIGRATION"}
    assert [r.n for r in made.orderBy("migration_id").select(barriers.size("plans").alias("n")).collect()] == [333, 33]


def test_configuration():
    config = PolicyConfig()
    other = config.with_options(cpu_out=0.5)
    assert (config.cpu_out, other.cpu_out, other.memory_out) == (0.8, 0.5, 0.85)
    assert len(vars(config)) == 20


def test_options_of_a_job(spark):
    spark.conf.set("spark.keyflow.cpu_out", "0.7")
    spark.conf.set("spark.keyflow.max_rounds", "4")
    try:
        config = PolicyConfig.from_options(spark)
    finally:
        spark.conf.unset("spark.keyflow.cpu_out")
        spark.conf.unset("spark.keyflow.max_rounds")
    assert config == PolicyConfig(cpu_out=0.7, max_rounds=4) and PolicyConfig.from_options(spark) == PolicyConfig()


def test_final_barriers_carry_a_checkpoint(spark):
    made = barriers.final(spark.createDataFrame([(0,), (7,)], "migration_id long"), 12)
    assert {(r.checkpoint_id, len(r.plans), r.kind) for r in barriers.kinds(made).collect()} == {(12, 0, "CHECKPOINT")}
    with pytest.raises(ValueError):
        barriers.final(made, -1)


def test_state_rows(spark, tmp_path):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    tables.sample_words(spark, 100).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("word string, id long").parquet(str(tmp_path / "in"))
    q = queries.word_count_stream(stream).writeStream.format("memory").queryName("kept_state").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    state = tables.state_rows(spark, str(tmp_path / "cp"))
    assert state.agg(F.sum("value.count")).first()[0] == 100
    spark.conf.set("spark.sql.shuffle.partitions", kept)
