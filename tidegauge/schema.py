"""Table shapes shared by sources and operators."""

from __future__ import annotations

LABELS = "map<string,string>"

SAMPLE = (
    f"node_id string, name string, value double, ts timestamp, ts_ns bigint, labels {LABELS}, "
    "type string, help string, unit string"
)

METRIC_BATCH = (
    "node_id string, session_id string, batch_seq bigint, sent_at timestamp, "
    f"metrics array<struct<name:string,value:double,timestamp:bigint,labels:{LABELS},"
    "type:int,help:string,unit:string>>"
)

STORED_VALUE = f"v double, l {LABELS}, n string, t string, h string, u string"

ALERT = (
    f"id string, name string, expression string, labels {LABELS}, annotations {LABELS}, state string, "
    "value double, active_at timestamp, resolved_at timestamp, created_at timestamp"
)

# What identifies a sample: a rewrite of the same three replaces the earlier value.
SAMPLE_KEY = ["name", "ts_ns", "labels_hash"]
