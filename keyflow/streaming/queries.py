"""The engine's queries as Structured Streaming: windowed aggregates, running counts, and the source and sink around them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession, parallelism: int = 4) -> None:
    """Keep state in RocksDB with a change log, in ``parallelism`` partitions (pinned by a query's first checkpoint)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", str(parallelism))


def tumbling_stream(events: DataFrame, width: str = "1 minute", delay: str = "5 seconds") -> DataFrame:
    """Count and mean of each key and window of a stream, given out when the watermark passes the window's end."""
    grouped = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), "key")
    counted = grouped.agg(F.count("*").alias("count"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))
    mean = F.round(F.col("total") / F.col("count"), 6)
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "key", "count", mean.alias("avg_value"))


class RunningCount(StatefulProcessor):
    """Keeps a count for each key and gives it out with every record; starts from ``initial`` state if there is one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "count long")

    def handleInitialState(self, key, initial, timerValues) -> None:
        self.count.update((int(initial["count"].iloc[0]),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        so_far = self.count.get()[0] if self.count.exists() else 0
        for some in rows:
            n = len(some)
            yield pd.DataFrame({"key": [key[0]] * n, "count": range(so_far + 1, so_far + n + 1)})
            so_far += n
        self.count.update((so_far,))

    def close(self) -> None:
        pass


def running_count_stream(events: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """For every record of a stream (key, ...) its key's count so far. ``initial`` (key, count) is where counts start."""
    start = initial.groupBy("key") if initial is not None else None
    return events.groupBy("key").transformWithStateInPandas(RunningCount(), "key string, count long", "Append", "None", start)


def word_count_stream(words: DataFrame) -> DataFrame:
    return words.groupBy("word").count()


class KeyedStore(StatefulProcessor):
    """State of keys under commands (key, op, value): put replaces, delete removes, get answers. Each command gives out the
    value that its key has after it, null for none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.value.get()[0] if self.value.exists() else None
        commands = pd.concat(list(rows)).sort_values("seq")
        out = []
        for seq, op, value in zip(commands["seq"], commands["op"], commands["value"], strict=True):
            held = float(value) if op == "PUT" else None if op == "DELETE" else held
            out.append((int(seq), key[0], op, held))
        if held is None:
            self.value.clear()
        else:
            self.value.update((held,))
        yield pd.DataFrame(out, columns=["seq", "key", "op", "value"])

    def close(self) -> None:
        pass


def store_stream(commands: DataFrame) -> DataFrame:
    """(seq, key, op, value) for every command (seq, key, op, value) of a stream; op is PUT, DELETE or GET."""
    return commands.groupBy("key").transformWithStateInPandas(KeyedStore(), "seq long, key string, op string, value double", "Append", "None")


#: Milliseconds between the micro-batches of the two jobs, each of which is a checkpoint.
INTERVALS = {"word_count": 60_000, "windowed": 30_000}


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = True, interval_ms: int | None = None) -> StreamingQuery:
    """Write a stream as Parquet with a checkpoint; by default all there is now, in micro-batches, and stop. ``interval_ms``
    has it go on with a micro-batch, and its checkpoint, at such intervals."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
    if interval_ms is not None:
        return writer.trigger(processingTime=f"{interval_ms} milliseconds").start()
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def show(stream: DataFrame, mode: str = "append") -> StreamingQuery:
    """Write a stream to the console."""
    return stream.writeStream.format("console").outputMode(mode).start()
