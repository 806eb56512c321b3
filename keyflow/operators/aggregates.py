"""Windowed and running aggregates over keyed events. Sums are taken in decimals, so no order of rows changes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_EXACT = "decimal(18,2)"


def _bounds() -> list[Column]:
    return [F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end")]


def _sum() -> Column:
    return F.sum(F.col("value").cast(_EXACT)).cast("double")


def tumbling_agg(events: DataFrame, width: str = "1 minute") -> DataFrame:
    """Count and mean of the values of each key in each window of event time."""
    grouped = events.groupBy(F.window("ts", width).alias("w"), "key").agg(F.count("*").alias("count"), _sum().alias("total"))
    mean = F.when(F.col("count") > 0, F.round(F.col("total") / F.col("count"), 6)).otherwise(0.0)
    return grouped.select(*_bounds(), "key", "count", mean.alias("avg_value"))


def tumbling_stats(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Count, sum, least and greatest value of each key in each window."""
    grouped = events.groupBy(F.window("ts", width).alias("w"), "key")
    stats = grouped.agg(F.count("*").alias("count"), _sum().alias("sum_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    return stats.select(*_bounds(), "key", "count", "sum_value", "min_value", "max_value")


def partial_stats(events: DataFrame, part: Column, width: str = "1 hour") -> DataFrame:
    """Accumulators of each key, window and part, to be merged."""
    grouped = events.groupBy(F.window("ts", width).alias("w"), "key", part.alias("part"))
    return grouped.agg(F.count("*").alias("count"), F.sum(F.col("value").cast(_EXACT)).alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))


def merge_partials(partials: DataFrame) -> DataFrame:
    """Merge accumulators: counts and sums add, extremes combine."""
    merged = partials.groupBy("w", "key").agg(F.sum("count").alias("count"), F.sum("total").cast("double").alias("sum_value"), F.min("low").alias("min_value"), F.max("high").alias("max_value"))
    return merged.select(*_bounds(), "key", "count", "sum_value", "min_value", "max_value")


def last_n_values(events: DataFrame, n: int = 1000, width: str = "1 day") -> DataFrame:
    """The last ``n`` values of each key and window in order of arrival; pos 1 is the latest.

    A key's rows meet in one task only after each task has cut its own to ``n`` (a limit on the window's rank).
    """
    w = F.window("ts", width)
    latest = Window.partitionBy("window_start", "key").orderBy(F.desc("event_id"))
    ranked = events.select(w.start.alias("window_start"), "key", "event_id", "value").withColumn("pos", F.row_number().over(latest))
    return ranked.where(F.col("pos") <= n).select("window_start", "key", "pos", "value")


def tokenize(docs: DataFrame) -> DataFrame:
    """Each word of each text with a count of one, as split at spaces."""
    words = docs.select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("pos", "word"))
    return words.select("doc_id", "pos", "word", F.lit(1).alias("one"))


def word_count(words: DataFrame) -> DataFrame:
    return words.groupBy("word").agg(F.sum("one").cast("long").alias("count"))


def numbered(rows: DataFrame, key: str, seq: str, name: str, stride: int = 4096) -> DataFrame:
    """``rows`` with the place of each among those of its key by ``seq``, from 1; a null key is a key.

    Records are numbered within strides of ``seq`` first; a key's strides, far fewer than its records, give the offsets, so
    a frequent key is spread over as many tasks as it has strides.
    """
    cut = rows.withColumn("__stride", F.floor(F.col(seq) / stride))
    strides = cut.groupBy(F.col(key).alias("__k"), F.col("__stride").alias("__s")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__k").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = strides.select("__k", "__s", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    within = F.row_number().over(Window.partitionBy(key, "__stride").orderBy(seq))
    joined = cut.withColumn("__within", within).join(offsets, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__stride") == F.col("__s")))
    return joined.select(*rows.columns, (F.col("__offset") + F.col("__within")).cast("long").alias(name))


def running_count(rows: DataFrame, key: str, seq: str, stride: int = 4096) -> DataFrame:
    """(seq, key, count): for every record how many of its key have come so far, in strides of ``seq``."""
    return numbered(rows.select(F.col(seq).alias("seq"), F.col(key).alias("key")), "key", "seq", "count", stride)


def state_estimate(rows: DataFrame, key: str) -> DataFrame:
    """Estimated state of each key: a unit for every hundred records."""
    return rows.groupBy(F.col(key).alias("key")).agg(F.floor(F.count("*") / 100).cast("long").alias("state_size"))


def late_rows(events: DataFrame, delay: int, width: int = 60, bound: int = 5, stride: int = 3600) -> DataFrame:
    """The events that a watermark taken after each record would drop, in a stream that comes out of order.

    An event with number i arrives ``delay`` * (i % 7) seconds late. The watermark before it is the greatest event time so
    far less ``bound`` seconds; the event is late if its window of ``width`` seconds had ended by then. The greatest time so
    far is that of all earlier strides of arrival time, and within the stride, so no task sees all events.
    """
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    timed = events.select("event_id", "key", "ts", ts.alias("t")).withColumn("arrival", F.col("t") + F.pmod("event_id", F.lit(7)) * (delay * 1_000_000))
    timed = timed.withColumn("stride", F.floor(F.col("arrival") / (stride * 1_000_000)))
    peaks = timed.groupBy("stride").agg(F.max("t").alias("peak"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("stride").rowsBetween(Window.unboundedPreceding, -1)
    peaks = peaks.select(F.col("stride").alias("s"), F.max("peak").over(earlier).alias("before"))
    here = Window.partitionBy("stride").orderBy("arrival", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest(F.max("t").over(here), F.col("before"))
    ends = (F.floor(F.col("t") / (width * 1_000_000)) + 1) * (width * 1_000_000)
    marked = timed.join(peaks, F.col("stride") == F.col("s")).withColumn("seen", seen)
    return marked.where(ends <= F.col("seen") - bound * 1_000_000).select("event_id", "key", "ts")
