"""Schemas of the tables that state movement and scaling decisions are made of."""

EVENT = "event_id long, key string, value double, ts timestamp"
CHANGE = "seq long, key long, op string, value double"
STATE = "key long, value double"
ROUTE = "operator_id string, partition_id int, subtask int, version long"
PLAN = "operator_id string, partition_id int, source int, target int, state_size long"
BARRIER = "migration_id long, checkpoint_id long, plans array<struct<partition_id:int,source:int,target:int>>"
HISTORY = "ts timestamp, decision string, reason string, throughput double, p99_ms double"
