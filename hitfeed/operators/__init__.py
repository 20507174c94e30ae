from hitfeed.operators.hits import explode_policies
from hitfeed.operators.ordering import sort_by_start_time, with_global_ordinal
from hitfeed.operators.multifeed import multi_feed_hits, feeds_frame

__all__ = [
    "explode_policies", "sort_by_start_time", "with_global_ordinal",
    "multi_feed_hits", "feeds_frame",
]
