import datetime
import random

import pytest
from pyspark.sql import functions as F

from keyflow.functions import keygroups
from keyflow.operators import aggregates, changelog, migration, policy, routing

LOG = "seq long, key long, op string, value double"


def log(spark, *rows):
    return spark.createDataFrame(list(rows), LOG)


def java_murmur(x):
    m = 0xFFFFFFFF
    rot = lambda a, r: ((a << r) | (a >> (32 - r))) & m
    k = rot((x & m) * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    h = (rot(k, 13) * 5 + 0xE6546B64) & m
    h ^= 4
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_murmur_of_any_int(spark):
    rng = random.Random(1)
    values = [0, 1, -1, 2**31 - 1, -(2**31), *(rng.randrange(-(2**31), 2**31) for _ in range(500))]
    frame = spark.createDataFrame([(v,) for v in values], "v int")
    for r in frame.select("v", keygroups.murmur(F.col("v")).alias("h"), keygroups.key_group(F.col("v"), 128).alias("g")).collect():
        assert r.h == java_murmur(r.v)
        assert r.g == abs(r.h) % 128
    staged = keygroups.with_key_group(keygroups.with_murmur(frame, F.col("v"), "h"), F.col("v"), 128, "g")
    assert all(r.h == java_murmur(r.v) and r.g == abs(r.h) % 128 for r in staged.collect())


def test_string_hash(spark):
    frame = spark.createDataFrame([("",), ("a",), ("hello world",), ("sensor-10",)], "s string")
    found = {r.s: r.h for r in frame.select("s", keygroups.hash_of_string(F.col("s")).alias("h")).collect()}
    assert found == {"": 0, "a": 97, "hello world": 1794106052, "sensor-10": found["sensor-10"]}


def test_string_hash_counts_units(spark):
    """Characters beyond the basic plane are two units, as in Java."""
    texts = ["\U0001f600", "a\U0001f600b", "\u00e9\u4e2d", "\U0010ffff" * 5]

    def java(text):
        h = 0
        for i in range(0, len(raw := text.encode("utf-16-be")), 2):
            h = (h * 31 + int.from_bytes(raw[i : i + 2], "big")) & 0xFFFFFFFF
        return h - (1 << 32) if h >> 31 else h

    frame = spark.createDataFrame([(t,) for t in texts], "s string")
    assert [r.h for r in frame.select(keygroups.hash_of_string(F.col("s")).alias("h")).collect()] == [java(t) for t in texts]


def test_long_hash(spark):
    frame = spark.createDataFrame([(0,), (5,), (-1,), (1 << 40,)], "v long")
    assert [r.h for r in frame.select(keygroups.hash_of_long(F.col("v")).alias("h")).collect()] == [0, 5, 0, 256]


def test_single_put_and_delete(spark):
    put = changelog.log_size(log(spark, (1, 10, "PUT", 1.0))).first()
    assert (put.entries, put.bytes) == (1, 17 + 2 + 8)
    gone = changelog.log_size(log(spark, (1, 10, "DELETE", None))).first()
    assert (gone.entries, gone.bytes) == (1, 17 + 2)


def test_later_entry_replaces_earlier(spark):
    rows = log(spark, (1, 1, "PUT", 1.0), (2, 1, "PUT", 2.0), (3, 2, "PUT", 3.0), (4, 2, "DELETE", None))
    found = {r.key: (r.op, r.value) for r in changelog.compact(rows).collect()}
    assert found == {1: ("PUT", 2.0), 2: ("DELETE", None)}
    assert changelog.log_size(rows).first().entries == 2


def test_empty_log(spark):
    empty = log(spark)
    assert changelog.compact(empty).count() == 0
    size = changelog.log_size(empty).first()
    assert (size.entries, size.bytes, size.serialized_bytes) == (0, 0, 16)
    assert changelog.snapshot(empty).count() == 0


def test_merge_prefers_the_second_log(spark):
    first = log(spark, (9, 1, "PUT", 1.0), (2, 2, "PUT", 2.0))
    second = log(spark, (1, 1, "PUT", 5.0), (3, 3, "PUT", 3.0))
    assert {r.key: r.value for r in changelog.merge(first, second).collect()} == {1: 5.0, 2: 2.0, 3: 3.0}


def test_apply_puts_and_removes(spark):
    state = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "key long, value double")
    changes = log(spark, (1, 2, "DELETE", None), (2, 4, "PUT", 4.0), (3, 1, "PUT", 9.0))
    assert {r.key: r.value for r in changelog.apply(state, changes).collect()} == {1: 9.0, 3: None, 4: 4.0}


def test_round_trip_through_parquet(spark, tmp_path):
    rows = log(spark, (1, 1, "PUT", 1.0), (2, 2, "PUT", 0.0), (3, 1, "DELETE", None))
    rows.write.parquet(str(tmp_path / "log"))
    assert rows.exceptAll(spark.read.parquet(str(tmp_path / "log"))).count() == 0


def test_transitions():
    path = ["IDLE", "INIT", "PRE_COPY", "AWAIT_BARRIER", "FINALIZING", "COMMITTED"]
    assert all(migration.can_turn(a, b) for a, b in zip(path, path[1:], strict=False))
    assert all(migration.can_turn(s, "ABORTED") for s in migration.ACTIVE)
    for a, b in (("IDLE", "PRE_COPY"), ("INIT", "COMMITTED"), ("COMMITTED", "INIT"), ("ABORTED", "INIT"), ("PRE_COPY", "INIT")):
        assert not migration.can_turn(a, b)


def test_migration_moves_state_whole(spark, folder):
    orders = changelog.change_log(spark.read.parquet(f"{folder}/orders.parquet"))
    moved = F.pmod("key", F.lit(32)) < 5
    after = changelog.snapshot(orders.where(~moved)).unionByName(migration.migrate(orders, moved, 0.5, 0.9, 4))
    found = {r.side: r.n for r in migration.differences(changelog.snapshot(orders), after).collect()}
    assert found["before"] == found["after"] > 0 and found["missing"] == found["extra"] == 0


def greedy(assignment, parallelism):
    """The plan, one partition at a time, from subtask to subtask in ascending order."""
    load = {}
    for p, s in assignment:
        load.setdefault(s, []).append(p)
    base, moves = len(assignment) // parallelism, []
    for s in range(parallelism):
        mine = load.get(s, [])
        if len(mine) > base + 1:
            for p in mine[: len(mine) - base]:
                best = min((t for t in sorted(load) if len(load[t]) < base), key=lambda t: len(load[t]), default=None)
                if best is not None and best != s:
                    moves.append((p, s, best))
                    load[best].append(p)
    return sorted(moves)


@pytest.mark.parametrize("seed", range(12))
def test_rebalance_is_the_greedy_plan(spark, seed):
    rng = random.Random(seed)
    parallelism = rng.randint(2, 6)
    assignment = [(p, min(rng.randrange(parallelism), rng.randrange(parallelism))) for p in range(rng.randint(5, 40))]
    frame = spark.createDataFrame([(p, s, 1) for p, s in assignment], "partition_id int, subtask int, state_size long")
    found = sorted((r.partition_id, r.source, r.target) for r in policy.rebalance_plan(frame, parallelism).collect())
    assert found == greedy(assignment, parallelism)


def test_rebalance_can_fill_empty_subtasks(spark):
    frame = spark.createDataFrame([(p, 0, 1) for p in range(8)], "partition_id int, subtask int, state_size long")
    assert policy.rebalance_plan(frame, 4).count() == 0
    assert {r.target for r in policy.rebalance_plan(frame, 4, include_empty=True).collect()} == {1, 2, 3}


def test_running_count_does_not_depend_on_strides(spark):
    rows = spark.range(500).select(F.col("id").alias("seq"), F.pmod("id", F.lit(3)).alias("key"))
    a = aggregates.running_count(rows, "key", "seq", 7)
    b = aggregates.running_count(rows, "key", "seq", 10_000)
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_statistics_count_empty_subtasks(spark):
    routes = routing.default_routes(spark, ["x"], 3, 2)
    row = routing.distribution_stats(routes, 4).first()
    assert (row.min_partitions, row.max_partitions, row.avg_partitions) == (0, 2, 0.75)


def test_places_do_not_depend_on_strides(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([1, 1, 1, 2, None])) for i in rng.sample(range(100_000), 600)]
    frame = spark.createDataFrame(rows, "seq long, key_group int").repartition(5)
    expected, so_far = {}, {}
    for seq, key in sorted(rows):
        so_far[key] = expected[seq] = so_far.get(key, 0) + 1
    for stride in (1, 100, 10**6):
        found = aggregates.numbered(frame, "key_group", "seq", "place", stride)
        assert found.columns == ["seq", "key_group", "place"] and {r.seq: r.place for r in found.collect()} == expected


def test_route_history_does_not_depend_on_strides(spark):
    rng = random.Random(5)
    changes = [(rng.randrange(3), rng.randrange(4), v + 1, p) for v in range(200) for p in range(rng.randint(1, 3))]
    frame = spark.createDataFrame(changes, "partition_id int, subtask int, version long, pos int")
    routes = routing.default_routes(spark, ["x"], 3, 2)
    whole = sorted(map(tuple, routing.history(routes, frame, 10**6).collect()), key=str)
    assert sorted(map(tuple, routing.history(routes, frame, 7).collect()), key=str) == whole
    previous = {0: 0, 1: 1, 2: 0}
    expected = {}
    for p, s, v, pos in sorted(changes, key=lambda c: (c[2], c[3])):
        expected[p, v, pos] = previous[p]
        previous[p] = s
    assert {(r[0], r[1], r[2]): r[4] for r in whole if r[2] >= 0} == expected


def test_cooldown_is_greedy(spark):
    rng = random.Random(6)
    rows = [(job, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=rng.randrange(20_000)), rng.choice(["SCALE_OUT", "NONE", "SCALE_IN"])) for job in ("a", "b", None) for _ in range(400)]
    frame = spark.createDataFrame(rows, "job string, hour timestamp_ntz, decision string").repartition(6)
    expected = set()
    for job in ("a", "b", None):
        last = None
        for t in sorted({t for j, t, d in rows if j == job and d != "NONE"}):
            if last is None or (t - last).total_seconds() >= 300:
                last = t
                expected.add((job, t))
    assert {(r.job, r.hour) for r in policy.cooled(frame, 300_000, "job").collect()} == expected


def test_replay_after_the_commit(spark):
    changes = log(spark, (1, 1, "PUT", 1.0), (5, 2, "PUT", 2.0), (8, 1, "PUT", 5.0), (9, 2, "DELETE", None), (10, 3, "PUT", 7.0))
    state = migration.committed(changes, F.lit(True), 0.3, 0.6, 2, 0.7)
    assert {r.key: r.value for r in state.collect()} == {1: 1.0, 2: 2.0}
    after = migration.replayed(state, migration.buffered(changes, F.lit(True), 0.7))
    assert {r.key: (r.value, r.n_replayed) for r in after.collect()} == {1: (5.0, 1), 3: (7.0, 1)}


def test_precopy_is_aborted_when_it_does_not_converge(spark):
    rows = [(m, r, b) for m, sizes in {1: [9, 5, 1], 2: [9, 9, 9, 9, 1], 3: [9], 4: [1]}.items() for r, b in enumerate(sizes, 1)]
    found = migration.precopy_monitor(spark.createDataFrame(rows, "migration_id long, round int, bytes long"), 5, 3)
    assert {r.migration_id: (r.rounds, r.state) for r in found.collect()} == {1: (3, "AWAIT_BARRIER"), 2: (3, "ABORTED"), 3: (1, "PRE_COPY"), 4: (1, "AWAIT_BARRIER")}


def test_messages_fold_to_states(spark):
    kinds = {
        1: ["SOURCE_READY", "TARGET_READY", "COPY_START", "COPY_ROUND", "DELTA_SEND", "DELTA_DONE", "COMMIT", "STATS"],
        2: ["SOURCE_READY", "COPY_START", "ABORT", "COPY_ROUND", "COMMIT"],
        3: ["REPLY"],
        4: ["SOURCE_READY", "STATE", "ROUTES"],
    }
    rows = [(m, i, k, "AWAIT_BARRIER" if k == "STATE" else None, 3, {"round": str(i)}) for m, some in kinds.items() for i, k in enumerate(some)]
    frame = spark.createDataFrame(rows, "migration_id long, seq long, kind string, state string, partition_id int, detail map<string,string>")
    found = {r.migration_id: (r.state, r.seq, r.n_messages) for r in migration.fold(frame).collect()}
    assert found == {1: ("COMMITTED", 6, 8), 2: ("ABORTED", 2, 5), 3: ("IDLE", None, 1), 4: ("AWAIT_BARRIER", 1, 3)}
    assert set(migration.MESSAGES) == {k for some in kinds.values() for k in some}
    back = migration.decode(migration.encode(frame))
    assert sorted(map(str, back.collect())) == sorted(map(str, frame.drop("state").collect()))
    assert changelog.cleared(log(spark, (1, 1, "PUT", 1.0), (2, 1, "PUT", 2.0)), 1).count() == 1


def test_serialised_logs_are_read_back(spark):
    rows = log(spark, (1, 10, "PUT", 1.25), (2, 10, "PUT", 3.5), (3, 7, "DELETE", None), (9, 123, "PUT", 0.0))
    raw = bytes(changelog.serialise(rows).first().bytes)
    assert len(raw) == changelog.log_size(rows).first().serialized_bytes
    assert raw[:16] == bytes(15) + b"\x03"
    found, at = {}, 16
    while at < len(raw):
        op, n = raw[at], int.from_bytes(raw[at + 1 : at + 5], "big")
        key, at = int(raw[at + 5 : at + 5 + n]), at + 5 + n
        n, at = int.from_bytes(raw[at : at + 4], "big"), at + 4
        value = int.from_bytes(raw[at : at + n], "big") / 100 if n else None
        found[key] = ({1: "PUT", 2: "DELETE"}[op], value, int.from_bytes(raw[at + n : at + n + 8], "big"))
        at += n + 8
    assert found == {7: ("DELETE", None, 3), 10: ("PUT", 3.5, 2), 123: ("PUT", 0.0, 9)}
