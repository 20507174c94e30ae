"""Write PLANS.md: the physical plans of the core jobs over a real partitioned layout.

    python tools/explain_plans.py [sf_dir]
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from hitfeed.fixtures import NOW, POLICY_LOG_DDL, policy_log, write_partitioned  # noqa: E402
from hitfeed.operators.multifeed import multi_feed_hits  # noqa: E402
from hitfeed.operators.ordering import with_global_ordinal  # noqa: E402
from hitfeed.plans.export import export_feed, export_multi  # noqa: E402
from hitfeed.plans.refresh import refresh_plan  # noqa: E402
from hitfeed.registry import FEEDS, FLAGSHIP, HIT_COLUMNS  # noqa: E402
from hitfeed.schemas import struct_from_ddl  # noqa: E402
from hitfeed.session import build_session, scratch_path  # noqa: E402
from hitfeed.sinks.csv import write_csv  # noqa: E402
from hitfeed.sources.logs import read_logs  # noqa: E402
from hitfeed.sources.partitions import missing_partitions, stored_partitions  # noqa: E402
from hitfeed.sources.snapshots import read_snapshot  # noqa: E402


def formatted(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue().strip()


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session("local[8]", 8, app_name="hitfeed-plans")
    root = scratch_path(spark, "plans")
    write_partitioned(policy_log(spark, sf), root)
    logs = read_logs(spark, root, struct_from_ddl(POLICY_LOG_DDL), "dns")
    prev = write_csv(export_feed(logs, FLAGSHIP, NOW - 3600), scratch_path(spark, "prev"), order_by="start_time")
    tagged, cols, _, _ = refresh_plan(spark, logs, FLAGSHIP, NOW, read_snapshot(spark, prev, HIT_COLUMNS),
                                      hourly=True)
    other = stored_partitions(spark, root).filter(F.col("hour") < NOW - 86400)
    plans = [
        ("Export (flagship): one stage, partition + pushed filters, pruned ReadSchema",
         export_feed(logs, FLAGSHIP, NOW)),
        ("Many feeds, one scan: merged windows as partition filters, hash join on (source, policy)",
         export_multi(logs, FEEDS, NOW)),
        ("The same with a feed table above the broadcast threshold, and salting (shown with "
         "auto-broadcast off)",
         ("no-auto-broadcast", multi_feed_hits(logs, FEEDS, NOW, salt_buckets=4))),
        ("Refresh: fresh hits UNION slimmed old rows, one range exchange",
         tagged.orderBy("start_time").filter("_keep").select(*cols)),
        ("Global ordinal: stored ranges + counts per range broadcast back",
         with_global_ordinal(export_feed(logs, FLAGSHIP, NOW))),
        ("Partition diff: path-only listing, partial distinct, anti join",
         missing_partitions(stored_partitions(spark, root), other)),
    ]
    out = ["# Physical plans", "",
           "Generated by `tools/explain_plans.py` (sf0.001 `policy_log` written as `subscriber=/…/hour=` Parquet, "
           "DNS kind). Scan locations are scratch paths.", ""]
    for title, df in plans:
        if isinstance(df, tuple):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
            text = formatted(df[1])
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        else:
            text = formatted(df)
        out += [f"## {title}", "", "```", text, "```", ""]
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as fh:
        fh.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
