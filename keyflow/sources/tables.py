"""Sources: the engine's streams and tables from files, and generators of the same shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vocabulary of the word generator.
WORDS = ("amber", "basalt", "cedar", "dune", "fjord", "glacier", "heron", "juniper")
SENSORS = tuple(f"sensor-{i}" for i in range(1, 11))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The event stream as a table: (event_id, key, value, ts), in order of event_id."""
    return table(spark, folder, "events").select("event_id", F.col("event_type").alias("key"), "value", "ts")


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """The same as a stream of files; event times are cast for watermarks."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", files_per_batch)
    raw = reader.parquet(f"{folder}/events.parquet/" if not folder.endswith(".parquet") else folder)
    return raw.select("event_id", F.col("event_type").alias("key"), "value", F.col("ts").cast("timestamp").alias("ts"))


def _pick(values: tuple[str, ...], *of: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(*of), F.lit(len(values))) + 1).cast("int"))


def word_source(spark: SparkSession, rows_per_second: int = 1000, words: tuple[str, ...] = WORDS) -> DataFrame:
    """An unbounded stream of words drawn evenly from ``words``."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    return rate.select(_pick(words, "value").alias("word"), "timestamp")


def event_source(spark: SparkSession, rows_per_second: int = 1000, keys: tuple[str, ...] = SENSORS) -> DataFrame:
    """An unbounded stream of events: a key drawn evenly, a value in [0, 100), event times that never go back."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    value = F.pmod(F.xxhash64("value", F.lit(1)), F.lit(10000)) / 100.0
    return rate.select(F.col("value").alias("event_id"), _pick(keys, "value").alias("key"), value.alias("value"), F.col("timestamp").alias("ts"))


def sample_words(spark: SparkSession, rows: int, words: tuple[str, ...] = WORDS) -> DataFrame:
    """A bounded table of the word generator."""
    return spark.range(rows).select(_pick(words, "id").alias("word"), "id")


def state_rows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The keyed state of a stopped query, a row for each key with the partition that holds it."""
    return spark.read.format("statestore").load(checkpoint)


PROGRESS = "query_id string, batch_id long, operator int, input_rate double, state_rows long, state_bytes long, dropped long"


def progress_tuples(progress: dict) -> list[tuple]:
    """The rows of one progress report of a query: one for each stateful operator."""
    rate = float(progress.get("inputRowsPerSecond") or 0.0)
    return [
        (str(progress["id"]), int(progress["batchId"]), i, rate, int(s["numRowsTotal"]), int(s["memoryUsedBytes"]), int(s.get("numRowsDroppedByWatermark", 0)))
        for i, s in enumerate(progress["stateOperators"])
    ]


def progress_rows(spark: SparkSession, query) -> DataFrame:
    """Operator metrics of a running query, from its recent progress."""
    return spark.createDataFrame([row for p in query.recentProgress for row in progress_tuples(p)], PROGRESS)
