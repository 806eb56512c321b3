"""Migrations as event logs: the state machine, its history, and moving keyed state from subtask to subtask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyflow.operators import changelog

#: The states, what each may turn into, and which count as final, active and free for copying.
STATES = ("IDLE", "INIT", "PRE_COPY", "AWAIT_BARRIER", "FINALIZING", "COMMITTED", "ABORTED")
TRANSITIONS = {
    "IDLE": ("INIT",),
    "INIT": ("PRE_COPY", "ABORTED"),
    "PRE_COPY": ("AWAIT_BARRIER", "ABORTED"),
    "AWAIT_BARRIER": ("FINALIZING", "ABORTED"),
    "FINALIZING": ("COMMITTED", "ABORTED"),
}
ACTIVE = ("INIT", "PRE_COPY", "AWAIT_BARRIER", "FINALIZING")
BACKGROUND = ("PRE_COPY", "AWAIT_BARRIER")


def can_turn(old: str, new: str) -> bool:
    return new in TRANSITIONS.get(old, ())


def legal(old: Column, new: Column) -> Column:
    """Whether a transition is legal, as a column."""
    out = F.lit(False)
    for state, after in TRANSITIONS.items():
        out = out | ((old == state) & new.isin(*after))
    return out


def states(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(s, s not in ACTIVE, s in ACTIVE, s in BACKGROUND) for s in STATES], "state string, terminal boolean, active boolean, background boolean")


def transition_matrix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, can_turn(a, b)) for a in STATES for b in STATES], "from_state string, to_state string, valid boolean")


def history(log: DataFrame) -> DataFrame:
    """Each event (migration_id, seq, state) of a log with the state before it and whether the step is legal."""
    order = Window.partitionBy("migration_id").orderBy("seq")
    steps = log.withColumn("previous", F.lag("state").over(order))
    first = F.col("state") == "IDLE"
    return steps.select("migration_id", "seq", "previous", "state", F.when(F.col("previous").isNull(), first).otherwise(legal(F.col("previous"), F.col("state"))).alias("valid"))


def illegal(log: DataFrame) -> DataFrame:
    return history(log).where(~F.col("valid")).select("migration_id", "seq", "previous", "state")


def progress(rounds: DataFrame) -> DataFrame:
    """Rounds, bytes, latest delta and duration of each migration from its round events (round, bytes, ts)."""
    grouped = rounds.groupBy("migration_id").agg(
        F.max("round").alias("rounds"), F.sum("bytes").cast("long").alias("bytes"), F.max_by("bytes", "round").alias("delta_bytes"),
        F.min(F.unix_millis(F.col("ts").cast("timestamp"))).alias("began"), F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("ended"),
    )
    return grouped.select("migration_id", "rounds", "bytes", "delta_bytes", (F.col("ended") - F.col("began")).alias("duration_ms"))


def timeouts(durations: DataFrame, init_ms: int, barrier_ms: int) -> DataFrame:
    """What a migration's waiting leads to: an abort beyond either limit, as alignment is required."""
    late = F.when(F.col("duration_ms") > barrier_ms, "BARRIER_TIMEOUT").when(F.col("duration_ms") > init_ms, "INIT_TIMEOUT").otherwise("OK")
    return durations.select("migration_id", "duration_ms", late.alias("outcome"))


def precopy_monitor(rounds: DataFrame, threshold: int, max_rounds: int) -> DataFrame:
    """What becomes of each migration's pre-copy (migration_id, round, bytes): it ends at the first round whose delta is
    below the threshold and awaits the barrier, or is aborted when the greatest number of rounds has passed without one."""
    small = F.min(F.when((F.col("bytes") < threshold) & (F.col("round") <= max_rounds), F.col("round")))
    grouped = rounds.groupBy("migration_id").agg(small.alias("converged"), F.max("round").alias("last"))
    state = F.when(F.col("converged").isNotNull(), "AWAIT_BARRIER").when(F.col("last") >= max_rounds, "ABORTED").otherwise("PRE_COPY")
    used = F.coalesce("converged", F.least(F.col("last"), F.lit(max_rounds)))
    return grouped.select("migration_id", used.alias("rounds"), state.alias("state"))


def migrate(log: DataFrame, moved: Column, low: float, high: float, n_rounds: int, cut: float = 1.0) -> DataFrame:
    """State of the migrating keys at their target: the snapshot up to ``low``, each round of changes up to ``high``, the
    final delta up to the barrier at ``cut``, and what was buffered behind it, replayed in order at the commit. ``moved``
    says which keys migrate."""
    return replayed(committed(log, moved, low, high, n_rounds, cut), buffered(log, moved, cut)).select("key", "value")


def committed(log: DataFrame, moved: Column, low: float, high: float, n_rounds: int, cut: float = 1.0) -> DataFrame:
    """State at the target when the final delta up to the barrier has been applied and nothing replayed yet."""
    last, mine = changelog.last_seq(log), log.where(moved)
    state = changelog.snapshot(changelog.between(mine, -1.0, low, last))
    parts = changelog.rounds(mine, low, high, n_rounds, last)
    for r in range(1, n_rounds + 1):
        state = changelog.apply(state, parts.where(F.col("round") == r).drop("round"))
    return changelog.apply(state, changelog.between(mine, high, cut, last))


def buffered(log: DataFrame, moved: Column, cut: float) -> DataFrame:
    """The changes of migrating keys that came behind the barrier at ``cut``."""
    return changelog.between(log.where(moved), cut, 1.0, changelog.last_seq(log))


def replayed(state: DataFrame, records: DataFrame) -> DataFrame:
    """(key, value, n_replayed): state after the buffered records, in order, and how many of them each key had. A key that
    they delete is gone; one that they put first is new."""
    counts = records.groupBy("key").agg(F.count("*").alias("n"))
    after = changelog.apply(state, records)
    return after.join(counts, "key", "left").select("key", "value", F.coalesce("n", F.lit(0)).cast("long").alias("n_replayed"))


#: Kinds of messages between coordinator, source and target, with the state that each brings a migration into.
MESSAGES = {
    "SOURCE_READY": "INIT", "TARGET_READY": "INIT", "COPY_START": "PRE_COPY", "COPY_ROUND": "PRE_COPY", "DELTA_SEND": "FINALIZING", "DELTA_DONE": "FINALIZING",
    "ABORT": "ABORTED", "COMMIT": "COMMITTED", "STATE": None, "REPLY": None, "ROUTES": None, "STATS": None,
}
_EVENT = "migration_id long, seq long, kind string, partition_id int, detail map<string,string>"


def events_of(log: DataFrame) -> DataFrame:
    """Messages (migration_id, seq, kind, state) with the state that each brings: that of its kind, or the one that it
    states itself."""
    pairs = [x for kind, state in MESSAGES.items() if state for x in (F.lit(kind), F.lit(state))]
    implied = F.create_map(*pairs)[F.col("kind")]
    return log.select("migration_id", "seq", "kind", F.coalesce(implied, F.when(F.col("kind") == "STATE", F.col("state"))).alias("state"))


def fold(log: DataFrame) -> DataFrame:
    """(migration_id, state, seq, n_messages): where its messages have brought each migration. A final state stays, whatever
    comes after it; messages that bring no state are only counted."""
    events = events_of(log)
    final = F.min(F.when(F.col("state").isin("COMMITTED", "ABORTED"), F.col("seq")))
    ends = events.groupBy("migration_id").agg(final.alias("end"), F.count("*").alias("n_messages"))
    upto = events.where("state is not null").join(ends, "migration_id").where("end is null or seq <= end")
    latest = upto.groupBy("migration_id").agg(F.max_by(F.struct("state", "seq"), "seq").alias("l"))
    return ends.join(latest, "migration_id", "left").select("migration_id", F.coalesce("l.state", F.lit("IDLE")).alias("state"), F.col("l.seq").alias("seq"), "n_messages")


def encode(events: DataFrame) -> DataFrame:
    """Each message (migration_id, seq, kind, partition_id, detail) as one JSON text, without loss."""
    return events.select(F.to_json(F.struct("migration_id", "seq", "kind", "partition_id", "detail")).alias("message"))


def decode(messages: DataFrame) -> DataFrame:
    return messages.select(F.from_json("message", _EVENT).alias("e")).select("e.*")


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of either side, and those that the other side lacks: a migration must leave none."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    missing, extra = before.exceptAll(after), after.exceptAll(before)
    sides = [count(before, "n"), count(after, "n"), count(missing, "n"), count(extra, "n")]
    named = None
    for side, name in zip(sides, ("before", "after", "missing", "extra"), strict=True):
        row = side.select(F.lit(name).alias("side"), "n")
        named = row if named is None else named.unionByName(row)
    return named
