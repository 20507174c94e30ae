from hitfeed.sources.logs import (
    read_logs, read_dns, read_proxy, read_table, split_kind, union_view, source_names,
)
from hitfeed.sources.partitions import (
    stored_partitions, registered_partitions, missing_partitions, add_partitions,
    repair_partitions, partition_spec_sql,
)
from hitfeed.sources.snapshots import list_csv, latest_snapshot, read_snapshot

__all__ = [
    "read_logs", "read_dns", "read_proxy", "read_table", "split_kind", "union_view", "source_names",
    "stored_partitions", "registered_partitions", "missing_partitions", "add_partitions",
    "repair_partitions", "partition_spec_sql",
    "list_csv", "latest_snapshot", "read_snapshot",
]
