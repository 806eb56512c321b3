"""Change logs of keyed state: compaction, rounds, and applying them to snapshots. Order is by ``seq``, never by clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUT, DELETE = "PUT", "DELETE"


def change_log(orders: DataFrame) -> DataFrame:
    """Orders as changes of their customer's state: finished ones delete, others put the price."""
    gone = F.col("o_orderstatus") == "F"
    return orders.select(
        F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("key"), F.when(gone, DELETE).otherwise(PUT).alias("op"), F.when(~gone, F.col("o_totalprice")).alias("value")
    )


def last_seq(log: DataFrame) -> int:
    """The last seq of a log: one number, so bounds become literals that reach the scan."""
    return log.agg(F.max("seq")).first()[0] or 0


def between(log: DataFrame, low: float, high: float, last: int | None = None) -> DataFrame:
    """Changes whose seq lies in (low, high] as shares of the last seq, by default that of this log."""
    last = last_seq(log) if last is None else last
    return log.where((F.col("seq") > last * low) & (F.col("seq") <= last * high))


def compact(log: DataFrame, *by: str) -> DataFrame:
    """The latest change of each key (within ``by``), from partial maxima: a key sends one row a task."""
    latest = log.groupBy(*by, "key").agg(F.max_by(F.struct("seq", "op", "value"), "seq").alias("c"))
    return latest.select(*by, "c.seq", "key", "c.op", "c.value")


def entry_size() -> Column:
    """Bytes of an entry: 17 of its own, those of its key's digits, and 8 of a value."""
    return F.lit(17) + F.octet_length(F.col("key").cast("string")) + F.when(F.col("value").isNotNull(), 8).otherwise(0)


def log_size(log: DataFrame, *by: str) -> DataFrame:
    """Entries, bytes and serialised bytes of a compacted log."""
    sized = compact(log, *by).groupBy(*by).agg(F.count("*").alias("entries"), F.coalesce(F.sum(entry_size()), F.lit(0)).cast("long").alias("bytes"))
    return sized.withColumn("serialized_bytes", F.col("bytes") + 16)


def _hex(value: Column, digits: int) -> Column:
    return F.lpad(F.hex(value.cast("long")), digits, "0")


def serialise(log: DataFrame, *by: str) -> DataFrame:
    """(by..., bytes): each compacted log (of a partition and round, say) as bytes that ``log_size`` counts. Big-endian: a
    header of round, time (0, as order is by seq) and number of entries in 4, 8 and 4 bytes; then for each entry in order of
    key 1 byte for its kind (1 put, 2 delete), the key's digits and the value after their lengths in 4 bytes each, the value
    in hundredths in 8 bytes, and seq in 8. A log's entries meet in one task, as its bytes do."""
    key = F.col("key").cast("string")
    value = F.when(F.col("value").isNull(), F.lit("00000000")).otherwise(F.concat(F.lit("00000008"), _hex(F.round(F.col("value") * 100), 16)))
    entry = F.concat(F.when(F.col("op") == PUT, "01").otherwise("02"), _hex(F.octet_length(key), 8), F.hex(key), value, _hex(F.col("seq"), 16))
    grouped = compact(log, *by).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("key", entry.alias("entry")))).alias("entries"))
    number = F.col("round") if "round" in by else F.lit(0)
    head = F.concat(_hex(number, 8), _hex(F.lit(0), 16), _hex(F.size("entries"), 8))
    return grouped.select(*by, F.unhex(F.concat(head, F.array_join(F.transform("entries", lambda e: e.entry), ""))).alias("bytes"))


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union of two logs in which an entry of the second replaces one of the first, whatever their seq."""
    both = first.withColumn("log", F.lit(1)).unionByName(second.withColumn("log", F.lit(2)))
    latest = both.groupBy("key").agg(F.max_by(F.struct("seq", "op", "value"), F.struct("log", "seq")).alias("c"))
    return latest.select("c.seq", "key", "c.op", "c.value")


def cleared(log: DataFrame, upto: int) -> DataFrame:
    """A log after it was cleared: the changes that came later."""
    return log.where(F.col("seq") > upto)


def snapshot(log: DataFrame) -> DataFrame:
    """The state that a log leaves: the keys whose latest change put a value."""
    return compact(log).where(F.col("op") == PUT).select("key", "value")


def apply(state: DataFrame, log: DataFrame) -> DataFrame:
    """State after a log: puts replace and add, deletes remove, other keys stay."""
    change = compact(log).select("key", "op", F.col("value").alias("new"))
    joined = state.join(change, "key", "full_outer").where(F.col("op").isNull() | (F.col("op") == PUT))
    return joined.select("key", F.when(F.col("op").isNull(), F.col("value")).otherwise(F.col("new")).alias("value"))


def rounds(log: DataFrame, low: float, high: float, n: int, last: int | None = None) -> DataFrame:
    """Pre-copy rounds: the changes in (low, high] of the last seq, in ``n`` rounds of equal width, from 1."""
    last = last_seq(log) if last is None else last
    part = (F.col("seq") - last * low) / F.lit((high - low) * last / n)
    return between(log, low, high, last).withColumn("round", F.least(F.greatest(F.ceil(part), F.lit(1)), F.lit(n)).cast("int"))


def modified_keys(log: DataFrame) -> DataFrame:
    return log.select("key").distinct()


def convergence(sizes: DataFrame, threshold: int, bandwidth: float, dirty_rate: float) -> DataFrame:
    """For each round whether its log is small enough, and whether it also drains faster than it fills."""
    small = F.col("bytes") < threshold
    flags = sizes.withColumn("small", small).withColumn("converged", small & F.lit(bandwidth > dirty_rate))
    first = F.min(F.when(F.col("small"), F.col("round"))).over(Window.partitionBy(F.lit(0)))
    return flags.withColumn("first_converged", first).select("round", "entries", "bytes", "small", "converged", "first_converged")


def transfer_time(sizes: DataFrame, bytes_per_second: int = 104_857_600) -> DataFrame:
    """Milliseconds that a rate limit allows for each round."""
    return sizes.select("round", "bytes", F.round(F.col("bytes") * 1000.0 / bytes_per_second, 9).alias("transfer_ms"))


def state_size(state: DataFrame, group: Column) -> DataFrame:
    """Keys and bytes of the state of each key group."""
    return state.groupBy(group.alias("key_group")).agg(F.count("*").alias("n_keys"), F.sum(entry_size()).cast("long").alias("state_bytes"))
