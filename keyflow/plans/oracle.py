"""The SQL that each query must agree with, run by another engine on the same tables. Written apart from the operators."""

from __future__ import annotations

_EV = """ev AS (
  SELECT event_id, event_type AS key, value, ts, props, user_id, CAST(event_id % 32 AS INTEGER) AS key_group,
         CASE WHEN event_id % 32 < 16 THEN 0 WHEN event_id % 32 < 24 THEN 1 WHEN event_id % 32 < 28 THEN 2 ELSE 3 END AS subtask,
         'op' || (event_id % 8) AS operator_id, CAST(event_id // 8 AS BIGINT) AS migration_id FROM events)"""
_LOG = """log AS (
  SELECT o_orderkey AS seq, o_custkey AS key, CASE WHEN o_orderstatus = 'F' THEN 'DELETE' ELSE 'PUT' END AS op,
         CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS value, (SELECT max(o_orderkey) FROM orders) AS m FROM orders)"""
_SIZE = "17 + strlen(CAST(key AS VARCHAR)) + CASE WHEN value IS NOT NULL THEN 8 ELSE 0 END"
_ROUTES = """routes AS (
  SELECT 'job' AS operator_id, CAST(p AS INTEGER) AS partition_id, CASE WHEN p < 16 THEN 0 WHEN p < 24 THEN 1 WHEN p < 28 THEN 2 ELSE 3 END AS subtask,
         CAST(0 AS BIGINT) AS version FROM range(32) r(p))"""
_CHANGES = """changes AS (
  SELECT key_group AS partition_id, (subtask + 1) % 4 AS subtask, CAST(dense_rank() OVER (ORDER BY migration_id) AS BIGINT) AS version FROM ev)"""


def _latest(source: str, *by: str) -> str:
    keys = ", ".join((*by, "key"))
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY seq DESC) AS rn FROM {source}) WHERE rn = 1)"


def _snapshot(source: str) -> str:
    return f"(SELECT key, value FROM {_latest(source)} WHERE op = 'PUT')"


_ROUNDS_LOG = f"""{_LOG}, rounds AS (
  SELECT *, CAST(least(greatest(ceil((seq - m * 0.5e0) / ((0.9e0 - 0.5e0) * m / 4)), 1), 4) AS INTEGER) AS round
  FROM log WHERE seq > m * 0.5e0 AND seq <= m * 0.9e0)"""
_ROUNDS = f"""{_ROUNDS_LOG}, sizes AS (
  SELECT round, count(*) AS entries, CAST(sum({_SIZE}) AS BIGINT) AS bytes FROM {_latest("rounds", "round")} GROUP BY round)"""

_AVG = "round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*), 6)"


def _tumbling(width: str) -> str:
    return f"""SELECT time_bucket(INTERVAL '{width}', ts) AS window_start, time_bucket(INTERVAL '{width}', ts) + INTERVAL '{width}' AS window_end,
  event_type AS key, count(*) AS count, {_AVG} AS avg_value FROM events GROUP BY ALL"""


_STATS = """SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end,
  event_type AS key, count(*) AS count, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS sum_value, min(value) AS min_value, max(value) AS max_value
FROM events GROUP BY ALL"""

_WORDS = "SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents"


def _times(a: str, c: int) -> str:
    return f"((({a} & 65535) * {c} + (((({a} >> 16) & 65535) * {c} & 65535) << 16)) & 4294967295)"


def _murmur(table: str, column: str, keep: str) -> str:
    """Steps of the hash as nested selects, each with one step more."""
    rotate = lambda x, r: f"((({x} << {r}) | ({x} >> {32 - r})) & 4294967295)"
    steps = [
        _times("a0", 3432918353), rotate("a1", 15), _times("a2", 461845907), rotate("a3", 13), f"xor(({_times('a4', 5)} + 3864292196) & 4294967295, 4)",
        "xor(a5, a5 >> 16)", _times("a6", 2246822507), "xor(a7, a7 >> 13)", _times("a8", 3266489909), "xor(a9, a9 >> 16)",
    ]
    sql = f"SELECT {keep}, CAST({column} AS BIGINT) & 4294967295 AS a0 FROM {table}"
    for i, step in enumerate(steps, 1):
        sql = f"SELECT {keep}, {step} AS a{i} FROM ({sql})"
    return f"SELECT {keep}, CAST(CASE WHEN a10 >= 2147483648 THEN a10 - 4294967296 ELSE a10 END AS INTEGER) AS hash FROM ({sql})"


_JOBS = f"""{_EV}, hours AS (
  SELECT date_trunc('hour', ts) AS hour, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
         round(quantile_cont(value, 0.99) * 4, 2) AS p99, round(CAST(count(*) FILTER (WHERE key = 'error') AS DOUBLE) / count(*), 4) AS bp FROM ev GROUP BY ALL
), pressed AS (
  SELECT date_trunc('hour', ts) AS hour, operator_id, round(CAST(count(*) FILTER (WHERE key = 'error') AS DOUBLE) / count(*), 6) AS share FROM ev GROUP BY ALL
), most AS (SELECT hour, max(share) AS bottleneck_bp FROM pressed GROUP BY hour
), costs AS (
  SELECT date_trunc('hour', ts) AS hour, operator_id, subtask, CAST(round(count(*) / 3600.0e0, 9) AS DECIMAL(18,9)) * CAST({_AVG} AS DECIMAL(18,6)) AS cost FROM ev GROUP BY 1, 2, 3, key_group
), loads AS (SELECT hour, operator_id, subtask, CAST(sum(cost) AS DOUBLE) AS load FROM costs GROUP BY ALL
), ratios AS (
  SELECT hour, operator_id, round(CASE WHEN count(*) <= 1 OR avg(load) <= 0 THEN 0 ELSE (max(load) - min(load)) / avg(load) END, 6) AS ratio FROM loads GROUP BY ALL
), worst AS (SELECT hour, coalesce(arg_min(ratio, operator_id) FILTER (WHERE ratio > 0.3e0), 0) AS imbalance FROM ratios GROUP BY hour
), jobs AS (
  SELECT 'hour' AS scenario, CAST(hour AS TIMESTAMP) AS hour, round(n / (1.8e0 * (SELECT CAST(sum(n) AS DOUBLE) / count(*) FROM hours)), 4) AS cpu,
         round(total / (2.5e0 * (SELECT sum(total) / count(*) FROM hours)), 4) AS mem, p99, bp > 0.25 AS backpressured, bottleneck_bp,
         imbalance, 4 AS parallelism, round(n / 3600.0e0, 9) AS throughput FROM hours JOIN most USING (hour) JOIN worst USING (hour)
), samples AS (
  SELECT * FROM jobs UNION ALL
  SELECT s, NULL, c, m, l, b, x, i, p, 0.0e0 FROM (VALUES
    ('cpu', 0.9e0, 0.1e0, 10.0e0, false, 0.0e0, 0.0e0, 4), ('cpu at limit', 0.8e0, 0.5e0, 10.0e0, false, 0.0e0, 0.0e0, 4),
    ('memory', 0.5e0, 0.9e0, 10.0e0, false, 0.0e0, 0.0e0, 4), ('memory at limit', 0.5e0, 0.85e0, 10.0e0, false, 0.0e0, 0.0e0, 4),
    ('latency', 0.5e0, 0.5e0, 1500.0e0, false, 0.0e0, 0.0e0, 4), ('latency at limit', 0.5e0, 0.5e0, 1000.0e0, false, 0.0e0, 0.0e0, 4),
    ('backpressure', 0.5e0, 0.5e0, 10.0e0, true, 0.75e0, 0.0e0, 4), ('backpressure at limit', 0.5e0, 0.5e0, 10.0e0, true, 0.5e0, 0.0e0, 4),
    ('not backpressured', 0.5e0, 0.5e0, 10.0e0, false, 0.75e0, 0.0e0, 4), ('idle', 0.1e0, 0.1e0, 10.0e0, false, 0.0e0, 0.0e0, 4),
    ('idle at limit', 0.3e0, 0.1e0, 10.0e0, false, 0.0e0, 0.0e0, 4), ('uneven', 0.5e0, 0.5e0, 10.0e0, false, 0.0e0, 0.5e0, 4),
    ('uneven at limit', 0.5e0, 0.5e0, 10.0e0, false, 0.0e0, 0.3e0, 4), ('at most', 0.9e0, 0.1e0, 10.0e0, false, 0.0e0, 0.5e0, 128),
    ('at least', 0.1e0, 0.1e0, 10.0e0, false, 0.0e0, 0.5e0, 1), ('one up', 0.9e0, 0.1e0, 10.0e0, false, 0.0e0, 0.0e0, 1)) v(s, c, m, l, b, x, i, p)
), steps AS (
  SELECT *, CAST(least(ceil(parallelism * 1.5), 128) AS INTEGER) AS up, CAST(greatest(floor(parallelism * 0.75), 1) AS INTEGER) AS down,
    CASE WHEN cpu > 0.8e0 THEN 'cpu at ' || printf('%.2f', round(cpu * 100, 2)) || '%, limit 80.00%'
         WHEN mem > 0.85e0 THEN 'memory at ' || printf('%.2f', round(mem * 100, 2)) || '%, limit 85.00%'
         WHEN p99 > 1000 THEN 'p99 at ' || printf('%.2f', round(p99, 2)) || ' ms, limit 1000.00 ms'
         WHEN backpressured AND bottleneck_bp > 0.5e0 THEN 'backpressure at ' || printf('%.2f', round(bottleneck_bp * 100, 2)) || '%, limit 50.00%' END AS cause,
    CASE WHEN cpu < 0.3e0 AND mem < 0.4e0 THEN 'idle: cpu ' || printf('%.2f', round(cpu * 100, 2)) || '%, memory ' || printf('%.2f', round(mem * 100, 2)) || '%' END AS idle,
    CASE WHEN imbalance > 0.3e0 THEN 'uneven by ' || printf('%.2f', round(imbalance * 100, 2)) || '%' END AS uneven FROM samples
), decided AS (
  SELECT *, CASE WHEN cause IS NOT NULL AND up <> parallelism THEN 'SCALE_OUT' WHEN idle IS NOT NULL AND down <> parallelism THEN 'SCALE_IN'
                 WHEN uneven IS NOT NULL THEN 'REBALANCE' ELSE 'NONE' END AS decision FROM steps
), policy AS (
  SELECT scenario, hour, cpu, mem, p99, throughput, decision,
    CASE decision WHEN 'SCALE_OUT' THEN up WHEN 'SCALE_IN' THEN down WHEN 'REBALANCE' THEN parallelism END AS target,
    CASE decision WHEN 'SCALE_OUT' THEN cause WHEN 'SCALE_IN' THEN idle WHEN 'REBALANCE' THEN uneven END AS reason FROM decided)"""

_PARTS = f"{_EV}, parts AS (SELECT key_group AS partition_id, subtask, CAST(sum(strlen(props)) AS BIGINT) AS state_size FROM ev GROUP BY ALL)"


def _moves(target: int) -> str:
    return f"SELECT partition_id, subtask AS source, partition_id % {target} AS target, state_size FROM parts WHERE subtask <> partition_id % {target}"


_PLANS = f"""{_PARTS}, moves AS ({_moves(6)}), plans AS (
  SELECT 'job' AS operator_id, (partition_id * 11) % 32 AS pos, partition_id, source, target FROM moves UNION ALL
  SELECT 'job', 32 + partition_id, partition_id, source, 0 FROM moves
), firsts AS (SELECT * FROM plans QUALIFY row_number() OVER (PARTITION BY operator_id, partition_id ORDER BY pos) = 1)"""
_STARTED = f"""{_PLANS}, started AS (
  SELECT CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS migration_id, pos, partition_id, source, target FROM firsts WHERE partition_id NOT IN (1, 5, 17))"""
_ARRIVALS = f"""{_EV}, arrivals AS (
  SELECT migration_id, CAST((event_id * 7) % 4 AS INTEGER) AS channel, min(event_id) AS arrival, count(*) - 1 AS repeats FROM ev WHERE user_id % 5 <> 0 GROUP BY ALL
), aligned AS (
  SELECT migration_id, count(*) AS n_channels, CAST(sum(repeats) AS BIGINT) AS n_repeats, count(*) = 4 AS aligned, CASE WHEN count(*) = 4 THEN max(arrival) END AS aligned_at
  FROM arrivals GROUP BY migration_id)"""
_WAITING = f"{_EV}, waiting AS (SELECT event_id AS seq, key_group, key, value FROM ev WHERE key_group IN (8, 9, 10) AND event_id > (SELECT max(event_id) FROM events) * 0.6e0)"
_STATE_NAMES = ("IDLE", "INIT", "PRE_COPY", "AWAIT_BARRIER", "FINALIZING", "COMMITTED", "ABORTED")
_LEGAL = """(a = 'IDLE' AND b = 'INIT' OR a = 'INIT' AND b IN ('PRE_COPY', 'ABORTED') OR a = 'PRE_COPY' AND b IN ('AWAIT_BARRIER', 'ABORTED')
  OR a = 'AWAIT_BARRIER' AND b IN ('FINALIZING', 'ABORTED') OR a = 'FINALIZING' AND b IN ('COMMITTED', 'ABORTED'))"""
_NAMES = f"(VALUES {', '.join(f'({i}, {s!r})' for i, s in enumerate(_STATE_NAMES))})"
_HISTORY = f"""{_EV}, path AS (
  SELECT migration_id, event_id AS seq, CASE WHEN migration_id % 7 = 0 AND event_id % 8 = 4 THEN 'ABORTED' ELSE s END AS state
  FROM ev JOIN {_NAMES} n(i, s) ON i = event_id % 8 WHERE event_id % 8 < 6 AND NOT (migration_id % 5 = 0 AND event_id % 8 = 3)
), lagged AS (
  SELECT *, lag(state) OVER (PARTITION BY migration_id ORDER BY seq) AS previous FROM path
), history AS (
  SELECT migration_id, seq, previous, state, CASE WHEN a IS NULL THEN b = 'IDLE' ELSE {_LEGAL} END AS valid FROM (SELECT *, previous AS a, state AS b FROM lagged))"""
_PROGRESS = f"""{_EV}, progress AS (
  SELECT migration_id, CAST(max(event_id % 8 + 1) AS INTEGER) AS rounds, CAST(sum(strlen(props) * 1000) AS BIGINT) AS bytes, arg_max(strlen(props) * 1000, event_id % 8) AS delta_bytes,
         epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS duration_ms FROM ev GROUP BY migration_id)"""
_OPERATORS = f"""{_EV}, operators AS (
  SELECT operator_id, round(count(*) / 2592000.0e0, 9) AS input_rate, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 100.0e0, 6) AS cpu,
         round(CAST(count(*) FILTER (WHERE key = 'error') AS DOUBLE) / count(*), 6) AS backpressure FROM ev GROUP BY operator_id)"""
_KINDS = "(VALUES (0, 'ABORT', 'ABORTED'), (1, 'COMMIT', 'COMMITTED'), (2, 'COPY_ROUND', 'PRE_COPY'), (3, 'COPY_START', 'PRE_COPY'), (4, 'DELTA_DONE', 'FINALIZING'), (5, 'DELTA_SEND', 'FINALIZING'), (6, 'REPLY', NULL), (7, 'ROUTES', NULL), (8, 'SOURCE_READY', 'INIT'), (9, 'STATE', NULL), (10, 'STATS', NULL), (11, 'TARGET_READY', 'INIT'))"
_MESSAGES = f"""{_EV}, messages AS (
  SELECT migration_id, event_id AS seq, kind, CASE WHEN kind = 'STATE' THEN s ELSE implied END AS state
  FROM ev JOIN {_KINDS} k(i, kind, implied) ON i = (event_id * 7 + migration_id) % 12 JOIN {_NAMES} n(j, s) ON j = event_id % 7)"""
_FINAL = "SELECT key, value FROM " + _snapshot("log")

SQL = {
    "tumbling_agg": _tumbling("1 minute"),
    "tumbling_agg_hour": _tumbling("1 hour"),
    "tumbling_stats": _STATS,
    "merge_partials": _STATS,
    "last_n_values": """SELECT window_start, key, CAST(pos AS INTEGER) AS pos, value FROM (
  SELECT time_bucket(INTERVAL '1 minute', ts) AS window_start, event_type AS key, value,
         row_number() OVER (PARTITION BY time_bucket(INTERVAL '1 minute', ts), event_type ORDER BY event_id DESC) AS pos FROM events) WHERE pos <= 1000""",
    "scan_events": "SELECT event_id, event_type AS key, value, epoch_us(ts) // 1000 AS ts_ms FROM events",
    "tokenize": f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, word, 1 AS one FROM ({_WORDS})",
    "word_count": f"SELECT word, count(*) AS count FROM ({_WORDS}) GROUP BY word",
    "running_count": "SELECT event_id AS seq, event_type AS key, count(*) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS count FROM events",
    "state_estimate": "SELECT event_type AS key, CAST(count(*) // 100 AS BIGINT) AS state_size FROM events GROUP BY event_type",
    "late_rows": """WITH a AS (SELECT event_id, event_type AS key, ts, epoch_us(ts) AS t, epoch_us(ts) + (event_id % 7) * 60000000 AS arrival FROM events),
b AS (SELECT *, max(t) OVER (ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a)
SELECT event_id, key, ts FROM b WHERE (t // 60000000 + 1) * 60000000 <= seen - 5000000""",
    "murmur": _murmur("events", "event_id", "event_id"),
    "key_groups": f"""WITH text AS (
  SELECT event_type, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(event_type, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: (a * 31 + c) & 4294967295) AS h
  FROM (SELECT DISTINCT event_type FROM events)
), codes AS (SELECT event_type, CAST(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS INTEGER) AS key_hash FROM text),
hashed AS ({_murmur("codes", "key_hash", "event_type, key_hash")}), ids AS ({_murmur("events", "event_id", "event_id, event_type")})
SELECT event_id, event_type AS key, key_hash, CAST(abs(ids.hash % 128) AS INTEGER) AS key_group, CAST(abs(hashed.hash % 128) AS INTEGER) AS string_group
FROM ids JOIN hashed USING (event_type)""",
    "default_routes": """SELECT o AS operator_id, CAST(p AS INTEGER) AS partition_id, CAST(p % 4 AS INTEGER) AS subtask, CAST(0 AS BIGINT) AS version
FROM range(128) r(p), (VALUES ('counter'), ('window')) n(o)""",
    "routes_snapshot": f"WITH {_ROUTES} SELECT * FROM routes",
    "route_records": f"WITH {_ROUTES} SELECT event_id, partition_id AS key_group, subtask FROM events JOIN routes ON partition_id = event_id % 32",
    "distribution_stats": f"""WITH {_ROUTES}, counts AS (SELECT s, count(partition_id) AS n FROM range(6) r(s) LEFT JOIN routes ON subtask = s GROUP BY s)
SELECT 'job' AS operator_id, min(n) AS min_partitions, max(n) AS max_partitions, CAST(sum(n) AS DOUBLE) / 6 AS avg_partitions,
  round((max(n) - min(n)) / (CAST(sum(n) AS DOUBLE) / 6), 6) AS imbalance FROM counts""",
    "apply_barrier_routes": f"""WITH {_EV}, {_ROUTES}, {_CHANGES}, latest AS (SELECT partition_id, arg_max(subtask, version) AS s, max(version) AS v FROM changes GROUP BY partition_id)
SELECT operator_id, partition_id, coalesce(s, subtask) AS subtask, coalesce(v, version) AS version FROM routes LEFT JOIN latest USING (partition_id)""",
    "route_asof": f"""WITH {_EV}, {_ROUTES}, {_CHANGES}, latest AS (SELECT partition_id, arg_max(subtask, version) AS s, max(version) AS v FROM changes WHERE version <= 3 GROUP BY partition_id)
SELECT operator_id, partition_id, coalesce(s, subtask) AS subtask, coalesce(v, version) AS version FROM routes LEFT JOIN latest USING (partition_id)""",
    "route_changes": f"""WITH {_EV}, {_ROUTES}, {_CHANGES}, every AS (SELECT partition_id, subtask, version FROM routes UNION ALL SELECT * FROM changes)
SELECT partition_id, version, subtask, lag(subtask) OVER (PARTITION BY partition_id ORDER BY version) AS previous FROM every""",
    "delta_log_scan": f"WITH {_LOG} SELECT seq, key, op, value FROM log WHERE seq > m * 0.5e0",
    "state_snapshot": f"WITH {_LOG}, early AS (SELECT * FROM log WHERE seq <= m * 0.5e0) SELECT * FROM {_snapshot('early')}",
    "delta_window": f"WITH {_LOG} SELECT seq, key, op, value FROM log WHERE seq > m * 0.5e0 AND seq <= m * 0.9e0",
    "compact_delta": f"WITH {_LOG} SELECT seq, key, op, value FROM {_latest('log')}",
    "delta_size": f"WITH {_LOG} SELECT count(*) AS entries, CAST(sum({_SIZE}) AS BIGINT) AS bytes, CAST(sum({_SIZE}) AS BIGINT) + 16 AS serialized_bytes FROM {_latest('log')}",
    "modified_keys": f"WITH {_LOG} SELECT DISTINCT key FROM log WHERE seq > m * 0.5e0 AND seq <= m * 0.9e0",
    "merge_deltas": f"""WITH {_LOG}, ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq <= m * 0.5e0 DESC, seq DESC) AS rn FROM log)
SELECT seq, key, op, value FROM ranked WHERE rn = 1""",
    "precopy_rounds": f"WITH {_ROUNDS} SELECT round, entries, bytes, bytes + 16 AS serialized_bytes FROM sizes",
    "convergence": f"""WITH {_ROUNDS} SELECT round, entries, bytes, bytes < 26000 AS small, bytes < 26000 AS converged,
  (SELECT min(round) FROM sizes WHERE bytes < 26000) AS first_converged FROM sizes""",
    "transfer_time": f"WITH {_ROUNDS} SELECT round, bytes, round(bytes * 1000.0e0 / 104857600, 9) AS transfer_ms FROM sizes",
    "final_delta": f"WITH {_LOG}, late AS (SELECT * FROM log WHERE seq > m * 0.9e0) SELECT seq, key, op, value FROM {_latest('late')}",
    "apply_delta": f"WITH {_LOG} {_FINAL}",
    "partition_state_size": f"WITH {_LOG} SELECT CAST(key % 32 AS INTEGER) AS key_group, count(*) AS n_keys, CAST(sum({_SIZE}) AS BIGINT) AS state_bytes FROM {_snapshot('log')} GROUP BY key % 32",
    "partition_metrics": f"""WITH {_EV} SELECT key_group, count(*) AS n, round(count(*) / 2592000.0e0, 9) AS input_rate, {_AVG} AS processing_time,
  CAST(sum(strlen(props)) AS BIGINT) AS state_size FROM ev GROUP BY key_group""",
    "load_imbalance": f"""WITH {_EV}, pm AS (
  SELECT key AS operator_id, subtask, key_group, round(count(*) / 2592000.0e0, 9) AS r, {_AVG} AS t FROM ev GROUP BY ALL
), loads AS (SELECT operator_id, subtask, CAST(sum(CAST(r AS DECIMAL(18,9)) * CAST(t AS DECIMAL(18,6))) AS DOUBLE) AS load FROM pm GROUP BY ALL)
SELECT operator_id, count(*) AS subtasks, round(CASE WHEN count(*) <= 1 OR avg(load) <= 0 THEN 0 ELSE (max(load) - min(load)) / avg(load) END, 6) AS imbalance FROM loads GROUP BY operator_id""",
    "bottleneck": f"WITH {_OPERATORS} SELECT operator_id, backpressure FROM operators WHERE backpressure > 0 ORDER BY backpressure DESC, operator_id LIMIT 1",
    "scale_in_target": f"WITH {_OPERATORS} SELECT operator_id, round(cpu * input_rate, 12) AS load FROM operators ORDER BY load, operator_id LIMIT 1",
    "scale_targets": "SELECT CAST(p AS INTEGER) AS parallelism, CAST(least(ceil(p * 1.5), 128) AS INTEGER) AS scale_out, CAST(greatest(floor(p * 0.75), 1) AS INTEGER) AS scale_in FROM range(1, 129) r(p)",
    "policy_decision": f"WITH {_JOBS} SELECT scenario, hour, cpu, mem, p99, decision, target, reason FROM policy",
    "cooldown": f"""WITH RECURSIVE {_JOBS}, acts AS (
  SELECT hour, decision, reason, row_number() OVER (ORDER BY hour) AS n FROM policy WHERE hour IS NOT NULL AND decision <> 'NONE'
), walk AS (
  SELECT n, hour AS last, true AS kept FROM acts WHERE n = 1 UNION ALL
  SELECT acts.n, CASE WHEN acts.hour >= walk.last + INTERVAL 3 HOUR THEN acts.hour ELSE walk.last END, acts.hour >= walk.last + INTERVAL 3 HOUR FROM walk JOIN acts ON acts.n = walk.n + 1
) SELECT hour, decision, reason FROM acts JOIN walk USING (n) WHERE kept""",
    "scaling_history": f"WITH {_JOBS} SELECT hour, decision, reason, throughput, p99 FROM policy WHERE hour IS NOT NULL AND decision <> 'NONE' ORDER BY hour DESC LIMIT 100",
    "scale_out_plan": f"WITH {_PARTS} {_moves(6)}",
    "scale_in_plan": f"WITH {_PARTS} {_moves(3)}",
    "rebalance_plan": f"""WITH {_PARTS}, counts AS (SELECT subtask, count(*) AS n, (SELECT count(*) FROM parts) // 4 AS base FROM parts GROUP BY subtask),
given AS (
  SELECT partition_id, subtask AS source, state_size, row_number() OVER (ORDER BY subtask, partition_id) AS turn FROM (
    SELECT *, row_number() OVER (PARTITION BY subtask ORDER BY partition_id) AS nth FROM parts JOIN counts USING (subtask)) WHERE n > base + 1 AND nth <= n - base
), places AS (SELECT subtask AS target, row_number() OVER (ORDER BY level, subtask) AS turn FROM (SELECT subtask, unnest(range(n, base)) AS level FROM counts WHERE n < base))
SELECT partition_id, source, target, state_size FROM given JOIN places USING (turn)""",
    "filter_overlapping": f"WITH {_PLANS} SELECT operator_id, pos, partition_id, source, target FROM firsts ORDER BY pos LIMIT 10",
    "reject_overlapping": f"WITH {_PLANS} SELECT operator_id, pos, partition_id, source, target FROM plans WHERE partition_id NOT IN (1, 5, 17)",
    "start_migrations": f"WITH {_STARTED} SELECT * FROM started",
    "barrier_alignment": f"WITH {_ARRIVALS} SELECT migration_id, n_channels, n_repeats, aligned, aligned_at FROM aligned",
    "blocked_channels": f"WITH {_ARRIVALS} SELECT migration_id, channel, arrival AS blocked_from, aligned_at AS blocked_to FROM arrivals JOIN aligned USING (migration_id)",
    "barrier_kinds": f"""WITH {_EV} SELECT DISTINCT migration_id, CASE WHEN migration_id % 2 = 0 THEN -migration_id - 1 ELSE migration_id END AS checkpoint_id,
  CASE WHEN migration_id % 2 = 0 THEN 'MIGRATION' ELSE 'CHECKPOINT' END AS kind FROM ev""",
    "barrier_size": f"WITH {_EV} SELECT migration_id, CAST(33 + 300 * count(*) AS INTEGER) AS n_bytes FROM ev GROUP BY migration_id",
    "affected_partitions": f"WITH {_EV} SELECT migration_id, bool_or(key_group = 8) AS affected FROM ev GROUP BY migration_id",
    "plan_for_partition": f"""WITH {_EV} SELECT migration_id, CAST(min(CASE WHEN key_group = 8 THEN subtask END) AS INTEGER) AS source,
  CAST(min(CASE WHEN key_group = 8 THEN (subtask + 1) % 4 END) AS INTEGER) AS target FROM ev GROUP BY migration_id""",
    "barrier_match": f"""WITH {_STARTED} SELECT ev.migration_id, ev.key_group AS partition_id, ev.subtask AS source, (ev.subtask + 1) % 4 AS target, started.migration_id AS active_id
FROM ev JOIN started ON started.partition_id = ev.key_group""",
    "post_barrier_buffer": f"WITH {_WAITING} SELECT * FROM waiting",
    "flush_order": f"WITH {_WAITING} SELECT seq, key_group, CAST(row_number() OVER (PARTITION BY key_group ORDER BY seq) AS INTEGER) AS place FROM waiting",
    "buffer_stats": f"WITH {_WAITING} SELECT key_group, count(*) AS n_records, count(*) * 100 AS n_bytes FROM waiting GROUP BY key_group",
    "buffer_overflow": f"WITH {_WAITING} SELECT seq, key_group, row_number() OVER (PARTITION BY key_group ORDER BY seq) <= 100 AS accepted FROM waiting",
    "state_flags": f"""SELECT s AS state, s IN ('IDLE', 'COMMITTED', 'ABORTED') AS terminal, s NOT IN ('IDLE', 'COMMITTED', 'ABORTED') AS active,
  s IN ('PRE_COPY', 'AWAIT_BARRIER') AS background FROM {_NAMES} n(i, s)""",
    "transition_matrix": f"SELECT a AS from_state, b AS to_state, {_LEGAL} AS valid FROM {_NAMES} x(i, a), {_NAMES} y(j, b)",
    "migration_history": f"WITH {_HISTORY} SELECT * FROM history",
    "illegal_transitions": f"WITH {_HISTORY} SELECT migration_id, seq, previous, state FROM history WHERE NOT valid",
    "migration_progress": f"WITH {_PROGRESS} SELECT * FROM progress",
    "timeouts": f"""WITH {_PROGRESS} SELECT migration_id, duration_ms,
  CASE WHEN duration_ms > 2400000 THEN 'BARRIER_TIMEOUT' WHEN duration_ms > 1800000 THEN 'INIT_TIMEOUT' ELSE 'OK' END AS outcome FROM progress""",
    "target_after_commit": f"WITH {_LOG} {_FINAL} WHERE key % 32 IN (8, 9, 10)",
    "source_after_commit": f"WITH {_LOG} {_FINAL} WHERE key % 32 NOT IN (8, 9, 10)",
    "abort_rollback": f"WITH {_LOG}, {_ROUTES} SELECT key, value, subtask FROM {_snapshot('log')} JOIN routes ON partition_id = key % 32",
    "migration_equivalence": f"""WITH {_LOG}, n AS (SELECT count(*) AS n FROM {_snapshot('log')})
SELECT 'before' AS side, n FROM n UNION ALL SELECT 'after', n FROM n UNION ALL SELECT 'missing', 0 UNION ALL SELECT 'extra', 0""",
    "service_status": f"""WITH {_JOBS}, {_STARTED.removeprefix(_EV + ', ')}
SELECT 'history_size' AS name, least(count(*), 100) AS n FROM policy WHERE hour IS NOT NULL AND decision <> 'NONE' UNION ALL SELECT 'active_migrations', count(*) FROM started
UNION ALL SELECT 'started', 1 UNION ALL SELECT 'planner_active', 1""",
    "retry_delays": "SELECT CAST(i AS INTEGER) AS attempt, (i + 1) * 1000 AS delay_ms FROM range(3) r(i)",
    "barrier_messages": f"""WITH {_EV} SELECT migration_id, CASE WHEN migration_id % 2 = 0 THEN -migration_id - 1 ELSE migration_id END AS checkpoint_id,
  key_group AS partition_id, subtask AS source, (subtask + 1) % 4 AS target FROM ev""",
    "commit_replay": f"""WITH {_LOG}, late AS (SELECT key, count(*) AS n FROM log WHERE seq > m * 0.97e0 GROUP BY key)
SELECT key, value, coalesce(n, 0) AS n_replayed FROM {_snapshot('log')} LEFT JOIN late USING (key) WHERE key % 32 IN (8, 9, 10)""",
    "precopy_monitor": f"""WITH {_EV}, sizes AS (SELECT migration_id, CAST(event_id % 8 + 1 AS INTEGER) AS round, strlen(props) * 1000 AS bytes FROM ev),
ends AS (SELECT migration_id, min(round) FILTER (WHERE bytes < 8500 AND round <= 5) AS c, max(round) AS last FROM sizes GROUP BY migration_id)
SELECT migration_id, coalesce(c, least(last, 5)) AS rounds, CASE WHEN c IS NOT NULL THEN 'AWAIT_BARRIER' WHEN last >= 5 THEN 'ABORTED' ELSE 'PRE_COPY' END AS state FROM ends""",
    "migration_events": f"WITH {_MESSAGES} SELECT * FROM messages",
    "message_states": f"""WITH {_MESSAGES}, ends AS (
  SELECT migration_id, min(seq) FILTER (WHERE state IN ('COMMITTED', 'ABORTED')) AS e, count(*) AS n FROM messages GROUP BY migration_id
), latest AS (
  SELECT migration_id, arg_max(state, seq) AS state, max(seq) AS seq FROM messages JOIN ends USING (migration_id) WHERE state IS NOT NULL AND (e IS NULL OR seq <= e) GROUP BY migration_id
) SELECT migration_id, coalesce(state, 'IDLE') AS state, seq, n AS n_messages FROM ends LEFT JOIN latest USING (migration_id)""",
    "memory_ratio": f"""WITH {_PARTS}, used AS (SELECT subtask, CAST(sum(state_size) AS BIGINT) AS used, CAST(CASE WHEN subtask < 3 THEN (subtask + 1) * 50000 END AS INTEGER) AS capacity FROM parts GROUP BY subtask)
SELECT subtask, used, capacity, round(CAST(used AS DOUBLE) / capacity, 9) AS ratio FROM used""",
    "buffer_replay": f"""WITH {_EV}, counted AS (SELECT event_id AS seq, key_group, count(*) OVER (PARTITION BY key_group ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS count FROM ev WHERE key_group IN (8, 9, 10))
SELECT seq, key_group, count FROM counted WHERE seq > (SELECT max(event_id) FROM events) * 0.6e0""",
    "delta_bytes": f"""WITH {_ROUNDS_LOG}, latest AS (SELECT * FROM {_latest("rounds", "round")}), entries AS (
  SELECT round, CAST(key % 32 AS INTEGER) AS key_group, key,
         CASE WHEN op = 'PUT' THEN '01' ELSE '02' END || printf('%08X', strlen(CAST(key AS VARCHAR))) || hex(CAST(key AS VARCHAR)) || CASE WHEN value IS NULL THEN '00000000' ELSE '00000008' || printf('%016X', CAST(round(value * 100) AS BIGINT)) END || printf('%016X', seq) AS e
  FROM latest
), texts AS (SELECT round, key_group, printf('%08X', round) || repeat('0', 16) || printf('%08X', count(*)) || string_agg(e, '' ORDER BY key) AS t FROM entries GROUP BY round, key_group)
SELECT round, key_group, CAST(strlen(t) // 2 AS BIGINT) AS n_bytes, sha256(t) AS digest FROM texts""",
}
