"""Every query over the tables of a folder, wired from the operators. Each takes (spark, folder) and gives a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyflow.functions import keygroups
from keyflow.operators import aggregates, barriers, changelog, metrics, migration, policy, routing
from keyflow.sources import tables

GROUPS, PARALLELISM = 32, 4
LOW, HIGH, ROUNDS = 0.5, 0.9, 4
#: Where the barrier stands in the change log: what comes later is buffered and replayed.
CUT = 0.97
#: Bytes below which a round of a migration's pre-copy ends it.
DELTA = 8_500
MOVED = [8, 9, 10]
#: Bytes below which a round of the fixture counts as small.
SMALL = 26_000


def _key_group():
    return F.pmod("event_id", F.lit(GROUPS)).cast("int")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with key group, subtask under the skewed assignment, operator, and the migration that they belong to."""
    raw = tables.table(spark, folder, "events").withColumnRenamed("event_type", "key")
    placed = raw.withColumn("key_group", _key_group()).withColumn("subtask", routing.skewed(F.col("key_group")))
    return placed.withColumns({
        "operator_id": F.concat(F.lit("op"), F.pmod("event_id", F.lit(8)).cast("string")),
        "migration_id": F.floor(F.col("event_id") / 8).cast("long"),
    })


def _log(spark, folder):
    return changelog.change_log(tables.table(spark, folder, "orders"))


def _arrivals(spark, folder):
    kept = _events(spark, folder).where(F.pmod("user_id", F.lit(5)) != 0)
    return kept.select("migration_id", F.pmod(F.col("event_id") * 7, F.lit(4)).cast("int").alias("channel"), F.col("event_id").alias("arrival"))


def _barriers(spark, folder):
    """A barrier for each migration with a plan for each of its events, at most 8."""
    plan = F.struct("event_id", F.col("key_group").alias("partition_id"), F.col("subtask").alias("source"), F.pmod(F.col("subtask") + 1, F.lit(PARALLELISM)).alias("target"))
    grouped = _events(spark, folder).groupBy("migration_id").agg(F.sort_array(F.collect_list(plan)).alias("p"))
    plans = F.transform("p", lambda x: F.struct(x.partition_id.alias("partition_id"), x.source.alias("source"), x.target.alias("target")))
    even = F.pmod("migration_id", F.lit(2)) == 0
    return grouped.select("migration_id", F.when(even, -F.col("migration_id") - 1).otherwise(F.col("migration_id")).alias("checkpoint_id"), plans.alias("plans"))


def _routes(spark):
    return routing.default_routes(spark, ["job"], GROUPS, PARALLELISM).withColumn("subtask", routing.skewed(F.col("partition_id")))


def _partitions(spark, folder):
    """Key groups with their subtask and state."""
    sized = metrics.partition_metrics(_events(spark, folder), "subtask")
    return sized.select(F.col("key_group").alias("partition_id"), "subtask", "state_size")


def _states(spark, folder):
    """State events of migrations: the whole path, with steps left out or an abort in some."""
    k, m = F.pmod("event_id", F.lit(8)), F.col("migration_id")
    path = F.element_at(F.array(*map(F.lit, migration.STATES)), (k + 1).cast("int"))
    state = F.when((F.pmod(m, F.lit(7)) == 0) & (k == 4), F.lit("ABORTED")).otherwise(path)
    left_out = (F.pmod(m, F.lit(5)) == 0) & (k == 3)
    return _events(spark, folder).where((k < 6) & ~left_out).select("migration_id", F.col("event_id").alias("seq"), state.alias("state"))


def _rounds(spark, folder):
    return _events(spark, folder).select("migration_id", (F.pmod("event_id", F.lit(8)) + 1).cast("int").alias("round"), (F.octet_length("props") * 1000).cast("long").alias("bytes"), "ts")


def _messages(spark, folder):
    """A log of messages of migrations: kinds in a mixed order, some of them with a state of their own."""
    kinds = F.array(*map(F.lit, sorted(migration.MESSAGES)))
    kind = F.element_at(kinds, (F.pmod(F.col("event_id") * 7 + F.col("migration_id"), F.lit(len(migration.MESSAGES))) + 1).cast("int"))
    state = F.element_at(F.array(*map(F.lit, migration.STATES)), (F.pmod("event_id", F.lit(len(migration.STATES))) + 1).cast("int"))
    return _events(spark, folder).select("migration_id", F.col("event_id").alias("seq"), kind.alias("kind"), state.alias("state"))


def _records(spark, folder):
    """Records behind the barrier of the migrating key groups."""
    events = _events(spark, folder).withColumn("seq", F.col("event_id"))
    last = events.agg(F.max("seq")).first()[0] or 0
    return barriers.waiting(events, MOVED, last * 0.6).select("seq", "key_group", "key", "value")


def _samples(spark, folder):
    """Hourly samples of the job, and scenarios that reach every branch of the policy and every exact threshold."""
    events = _events(spark, folder)
    jobs = metrics.job_metrics(events).join(metrics.hourly_bottleneck(events), "hour").join(metrics.hourly_imbalance(events, policy.PolicyConfig().imbalance), "hour")
    jobs = jobs.withColumn("scenario", F.lit("hour"))
    cases = [
        ("cpu", 0.9, 0.1, 10.0, False, 0.0, 0.0, 4), ("cpu at limit", 0.8, 0.5, 10.0, False, 0.0, 0.0, 4), ("memory", 0.5, 0.9, 10.0, False, 0.0, 0.0, 4),
        ("memory at limit", 0.5, 0.85, 10.0, False, 0.0, 0.0, 4), ("latency", 0.5, 0.5, 1500.0, False, 0.0, 0.0, 4), ("latency at limit", 0.5, 0.5, 1000.0, False, 0.0, 0.0, 4),
        ("backpressure", 0.5, 0.5, 10.0, True, 0.75, 0.0, 4), ("backpressure at limit", 0.5, 0.5, 10.0, True, 0.5, 0.0, 4), ("not backpressured", 0.5, 0.5, 10.0, False, 0.75, 0.0, 4),
        ("idle", 0.1, 0.1, 10.0, False, 0.0, 0.0, 4), ("idle at limit", 0.3, 0.1, 10.0, False, 0.0, 0.0, 4), ("uneven", 0.5, 0.5, 10.0, False, 0.0, 0.5, 4),
        ("uneven at limit", 0.5, 0.5, 10.0, False, 0.0, 0.3, 4), ("at most", 0.9, 0.1, 10.0, False, 0.0, 0.5, 128), ("at least", 0.1, 0.1, 10.0, False, 0.0, 0.5, 1), ("one up", 0.9, 0.1, 10.0, False, 0.0, 0.0, 1),
    ]
    fixed = spark.createDataFrame(cases, "scenario string, cpu double, mem double, p99 double, backpressured boolean, bottleneck_bp double, imbalance double, parallelism int")
    hourly = jobs.select("scenario", "hour", "cpu", "mem", "p99", "backpressured", "bottleneck_bp", "imbalance", F.lit(PARALLELISM).alias("parallelism"), "throughput")
    return hourly.unionByName(fixed.withColumns({"hour": F.lit(None).cast("timestamp_ntz"), "throughput": F.lit(0.0)}).select(*hourly.columns))


def _decisions(spark, folder):
    return policy.decide(_samples(spark, folder))


def _plans(spark, folder):
    """Plans of the skewed partitions, repeated with other targets, in an order of their own."""
    moves = policy.scale_plan(_partitions(spark, folder), 6)
    twice = moves.withColumn("pos", F.pmod(F.col("partition_id") * 11, F.lit(GROUPS))).unionByName(moves.withColumns({"pos": F.lit(GROUPS) + F.col("partition_id"), "target": F.lit(0)}))
    return twice.withColumn("operator_id", F.lit("job")).select("operator_id", "pos", "partition_id", "source", "target")


def _active(spark):
    return spark.createDataFrame([("job", p) for p in (1, 5, 17)], "operator_id string, partition_id int")


def _sizes(spark, folder):
    return changelog.log_size(changelog.rounds(_log(spark, folder), LOW, HIGH, ROUNDS), "round")


def _moved():
    return F.pmod("key", F.lit(GROUPS)).isin(MOVED)


def scan_events(spark, folder):
    return tables.events(spark, folder).select("event_id", "key", "value", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))


def tumbling_agg(spark, folder):
    return aggregates.tumbling_agg(tables.events(spark, folder), "1 minute")


def tumbling_agg_hour(spark, folder):
    return aggregates.tumbling_agg(tables.events(spark, folder), "1 hour")


def tumbling_stats(spark, folder):
    return aggregates.tumbling_stats(tables.events(spark, folder))


def merge_partials(spark, folder):
    return aggregates.merge_partials(aggregates.partial_stats(tables.events(spark, folder), F.pmod("event_id", F.lit(4))))


def last_n_values(spark, folder):
    return aggregates.last_n_values(tables.events(spark, folder), 1000, "1 minute")


def tokenize(spark, folder):
    return aggregates.tokenize(tables.table(spark, folder, "documents"))


def word_count(spark, folder):
    return aggregates.word_count(tokenize(spark, folder))


def running_count(spark, folder):
    return aggregates.running_count(tables.events(spark, folder), "key", "event_id")


def state_estimate(spark, folder):
    return aggregates.state_estimate(tables.events(spark, folder), "key")


def late_rows(spark, folder):
    return aggregates.late_rows(tables.events(spark, folder), 60)


def murmur(spark, folder):
    return keygroups.with_murmur(tables.events(spark, folder).select("event_id"), F.col("event_id").cast("int"), "hash")


def key_groups(spark, folder):
    events = tables.events(spark, folder).select("event_id", "key").withColumn("key_hash", keygroups.hash_of_string(F.col("key")))
    grouped = keygroups.with_key_group(events, keygroups.hash_of_long(F.col("event_id")), 128, "key_group")
    return keygroups.with_key_group(grouped, F.col("key_hash"), 128, "string_group")


def default_routes(spark, folder):
    return routing.default_routes(spark, ["counter", "window"], 128, PARALLELISM)


def routes_snapshot(spark, folder):
    return _routes(spark)


def route_records(spark, folder):
    events = tables.events(spark, folder).select("event_id", _key_group().alias("key_group"))
    return routing.route_records(events, _routes(spark))


def distribution_stats(spark, folder):
    return routing.distribution_stats(_routes(spark), 6)


def apply_barrier_routes(spark, folder):
    return routing.apply_barriers(_routes(spark), routing.updates(_barriers(spark, folder)))


def route_asof(spark, folder):
    return routing.as_of(_routes(spark), routing.updates(_barriers(spark, folder)), 3)


def route_changes(spark, folder):
    return routing.history(_routes(spark), routing.updates(_barriers(spark, folder))).drop("pos")


def delta_log_scan(spark, folder):
    return changelog.between(_log(spark, folder), LOW, 1.0)


def state_snapshot(spark, folder):
    return changelog.snapshot(changelog.between(_log(spark, folder), -1.0, LOW))


def delta_window(spark, folder):
    return changelog.between(_log(spark, folder), LOW, HIGH)


def compact_delta(spark, folder):
    return changelog.compact(_log(spark, folder))


def delta_size(spark, folder):
    return changelog.log_size(_log(spark, folder))


def modified_keys(spark, folder):
    return changelog.modified_keys(delta_window(spark, folder))


def merge_deltas(spark, folder):
    log = _log(spark, folder)
    return changelog.merge(changelog.between(log, LOW, 1.0), changelog.between(log, -1.0, LOW))


def precopy_rounds(spark, folder):
    return _sizes(spark, folder)


def delta_bytes(spark, folder):
    """Length and digest of the serialised deltas of each key group and round."""
    parts = changelog.rounds(_log(spark, folder), LOW, HIGH, ROUNDS).withColumn("key_group", F.pmod("key", F.lit(GROUPS)).cast("int"))
    made = changelog.serialise(parts, "round", "key_group")
    return made.select("round", "key_group", F.octet_length("bytes").cast("long").alias("n_bytes"), F.sha2(F.hex("bytes"), 256).alias("digest"))


def convergence(spark, folder):
    return changelog.convergence(_sizes(spark, folder), SMALL, 2.0, 1.0)


def transfer_time(spark, folder):
    return changelog.transfer_time(_sizes(spark, folder))


def final_delta(spark, folder):
    return changelog.compact(changelog.between(_log(spark, folder), HIGH, 1.0))


def apply_delta(spark, folder):
    log = _log(spark, folder)
    return changelog.apply(changelog.snapshot(changelog.between(log, -1.0, LOW)), changelog.between(log, LOW, 1.0))


def partition_state_size(spark, folder):
    return changelog.state_size(changelog.snapshot(_log(spark, folder)), F.pmod("key", F.lit(GROUPS)).cast("int"))


def partition_metrics(spark, folder):
    return metrics.partition_metrics(_events(spark, folder))


def load_imbalance(spark, folder):
    return metrics.load_imbalance(metrics.partition_metrics(_events(spark, folder).withColumn("operator_id", F.col("key")), "operator_id", "subtask"))


def bottleneck(spark, folder):
    return metrics.bottleneck(metrics.operator_metrics(_events(spark, folder)))


def scale_in_target(spark, folder):
    return metrics.scale_in_target(metrics.operator_metrics(_events(spark, folder)))


def scale_targets(spark, folder):
    return policy.scale_targets(spark.range(1, 129).select(F.col("id").cast("int").alias("parallelism")))


def policy_decision(spark, folder):
    return _decisions(spark, folder).select("scenario", "hour", "cpu", "mem", "p99", "decision", "target", "reason")


def cooldown(spark, folder):
    acts = _decisions(spark, folder).where("hour is not null")
    return policy.cooled(acts, 3 * 3_600_000).select("hour", "decision", "reason")


def scaling_history(spark, folder):
    acts = _decisions(spark, folder).where("hour is not null")
    return policy.scaling_history(acts).select("hour", "decision", "reason", "throughput", "p99")


def scale_out_plan(spark, folder):
    return policy.scale_plan(_partitions(spark, folder), 6)


def scale_in_plan(spark, folder):
    return policy.scale_plan(_partitions(spark, folder), 3)


def rebalance_plan(spark, folder):
    return policy.rebalance_plan(_partitions(spark, folder), PARALLELISM)


def filter_overlapping(spark, folder):
    return policy.filter_overlapping(_plans(spark, folder))


def reject_overlapping(spark, folder):
    return policy.reject_overlapping(_plans(spark, folder), _active(spark)).select("operator_id", "pos", "partition_id", "source", "target")


def start_migrations(spark, folder):
    return policy.start_migrations(policy.filter_overlapping(_plans(spark, folder), GROUPS), _active(spark)).select("migration_id", "pos", "partition_id", "source", "target")


def barrier_alignment(spark, folder):
    return barriers.alignment(_arrivals(spark, folder), PARALLELISM)


def blocked_channels(spark, folder):
    return barriers.blocked(_arrivals(spark, folder), PARALLELISM)


def barrier_kinds(spark, folder):
    return barriers.kinds(_barriers(spark, folder)).select("migration_id", "checkpoint_id", "kind")


def barrier_size(spark, folder):
    return _barriers(spark, folder).select("migration_id", barriers.size("plans").alias("n_bytes"))


def affected_partitions(spark, folder):
    return _barriers(spark, folder).select("migration_id", barriers.affects("plans", 8).alias("affected"))


def plan_for_partition(spark, folder):
    plan = barriers.plan_for("plans", 8)
    return _barriers(spark, folder).select("migration_id", plan.source.alias("source"), plan.target.alias("target"))


def barrier_match(spark, folder):
    """Plans of barriers and the active migrations of the same partition of the same operator."""
    plans = _barriers(spark, folder).select("migration_id", F.lit("job").alias("operator_id"), F.explode("plans").alias("p")).select("migration_id", "operator_id", "p.*")
    active = start_migrations(spark, folder).select(F.col("migration_id").alias("active_id"), F.lit("job").alias("operator_id"), "partition_id")
    return plans.join(F.broadcast(active), ["operator_id", "partition_id"]).select("migration_id", "partition_id", "source", "target", "active_id")


def post_barrier_buffer(spark, folder):
    return _records(spark, folder)


def flush_order(spark, folder):
    return barriers.flush(_records(spark, folder)).select("seq", "key_group", "place")


def buffer_replay(spark, folder):
    """Counts of the migrating key groups going on behind the barrier from what they were at it."""
    events = _events(spark, folder).withColumn("seq", F.col("event_id"))
    last = events.agg(F.max("seq")).first()[0] or 0
    before = events.where(F.col("key_group").isin(MOVED) & (F.col("seq") <= last * 0.6)).groupBy("key_group").count()
    return barriers.replay(before, _records(spark, folder))


def buffer_stats(spark, folder):
    return barriers.buffer_stats(_records(spark, folder))


def buffer_overflow(spark, folder):
    return barriers.bounded(_records(spark, folder), 100).select("seq", "key_group", "accepted")


def state_flags(spark, folder):
    return migration.states(spark)


def transition_matrix(spark, folder):
    return migration.transition_matrix(spark)


def migration_history(spark, folder):
    return migration.history(_states(spark, folder))


def illegal_transitions(spark, folder):
    return migration.illegal(_states(spark, folder))


def migration_progress(spark, folder):
    return migration.progress(_rounds(spark, folder))


def timeouts(spark, folder):
    return migration.timeouts(migration_progress(spark, folder), 30 * 60_000, 40 * 60_000)


def target_after_commit(spark, folder):
    return migration.migrate(_log(spark, folder), _moved(), LOW, HIGH, ROUNDS, CUT)


def commit_replay(spark, folder):
    log = _log(spark, folder)
    return migration.replayed(migration.committed(log, _moved(), LOW, HIGH, ROUNDS, CUT), migration.buffered(log, _moved(), CUT))


def precopy_monitor(spark, folder):
    return migration.precopy_monitor(_rounds(spark, folder), DELTA, 5)


def migration_events(spark, folder):
    return migration.events_of(_messages(spark, folder))


def message_states(spark, folder):
    return migration.fold(_messages(spark, folder))


def memory_ratio(spark, folder):
    capacity = F.when(F.col("subtask") < 3, (F.col("subtask") + 1) * 50_000)
    return metrics.memory_ratio(_partitions(spark, folder).withColumn("memory_capacity", capacity))


def source_after_commit(spark, folder):
    return changelog.snapshot(_log(spark, folder).where(~_moved()))


def abort_rollback(spark, folder):
    state = changelog.snapshot(_log(spark, folder)).withColumn("partition_id", F.pmod("key", F.lit(GROUPS)).cast("int"))
    return state.join(F.broadcast(_routes(spark)), "partition_id").select("key", "value", "subtask")


def migration_equivalence(spark, folder):
    after = source_after_commit(spark, folder).unionByName(target_after_commit(spark, folder))
    return migration.differences(changelog.snapshot(_log(spark, folder)), after)


def retry_delays(spark, folder):
    return policy.retry_delays(spark.range(3).select(F.col("id").cast("int").alias("attempt")))


def barrier_messages(spark, folder):
    """Plans of barriers after a trip through their messages."""
    back = barriers.decode(barriers.encode(_barriers(spark, folder)))
    return back.select("migration_id", "checkpoint_id", F.explode("plans").alias("p")).select("migration_id", "checkpoint_id", "p.*")


def service_status(spark, folder):
    history = scaling_history(spark, folder).agg(F.count("*").alias("history_size"))
    active = start_migrations(spark, folder).agg(F.count("*").alias("active_migrations"))
    on = spark.createDataFrame([("started", 1), ("planner_active", 1)], "name string, n long")
    counts = [f.select(F.lit(f.columns[0]).alias("name"), F.col(f.columns[0]).alias("n")) for f in (history, active)]
    return on.unionByName(counts[0]).unionByName(counts[1])


QUERIES = {
    f.__name__: f
    for f in (
        tumbling_agg, tumbling_agg_hour, tumbling_stats, merge_partials, last_n_values, scan_events, tokenize, word_count, running_count, state_estimate, late_rows,
        murmur, key_groups, default_routes, routes_snapshot, route_records, distribution_stats, apply_barrier_routes, route_asof, route_changes,
        delta_log_scan, state_snapshot, delta_window, compact_delta, delta_size, modified_keys, merge_deltas, precopy_rounds, convergence, transfer_time, final_delta,
        apply_delta, partition_state_size, partition_metrics, load_imbalance, bottleneck, scale_in_target, scale_targets, policy_decision, cooldown, scaling_history,
        scale_out_plan, scale_in_plan, rebalance_plan, filter_overlapping, reject_overlapping, start_migrations, barrier_alignment, blocked_channels, barrier_kinds,
        barrier_size, affected_partitions, plan_for_partition, barrier_match, post_barrier_buffer, flush_order, buffer_stats, buffer_overflow, state_flags,
        transition_matrix, migration_history, illegal_transitions, migration_progress, timeouts, target_after_commit, source_after_commit, abort_rollback,
        migration_equivalence, service_status, retry_delays, barrier_messages, commit_replay, precopy_monitor, migration_events, message_states, memory_ratio,
        buffer_replay, delta_bytes,
    )
}
