"""hitfeed: policy-hit feeds over hourly-partitioned DNS and proxy logs, on Spark.

Everything here is DataFrame / SQL / Structured Streaming work.  The modules are:

* ``sources``   -- log readers, kind split, union view, partition listing and
                   registration, feed snapshot discovery and reading
* ``functions`` -- time bounds, policy lists, nested-value rendering, feed location hash
* ``operators`` -- policy explode (lateral unnest), ordering, run metrics, multi-feed join
* ``plans``     -- the jobs: export, incremental refresh, partition sync
* ``sinks``     -- CSV feed writer
* ``streaming`` -- the "new files since last run" job as a Structured Streaming query
"""

from hitfeed.plans.feed import FeedSpec
from hitfeed.plans.export import export_feed, export_multi
from hitfeed.plans.refresh import refresh_feed, RefreshResult
from hitfeed.plans.sync import sync_partitions
from hitfeed.plans.jobs import FeedTarget, export_job, refresh_job
from hitfeed.session import build_session, scratch_path

__all__ = [
    "FeedSpec",
    "export_feed",
    "export_multi",
    "refresh_feed",
    "RefreshResult",
    "sync_partitions",
    "FeedTarget",
    "export_job",
    "refresh_job",
    "build_session",
    "scratch_path",
]
