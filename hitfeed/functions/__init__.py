from hitfeed.functions.timebounds import (
    HOUR, DAY, floor_to, hours_ago_bound, day_range_bounds, window_bounds,
    strict_seam, catchup_seam,
)
from hitfeed.functions.policies import parse_policy_list, unique_policies
from hitfeed.functions.render import render_column, render_nested, csv_safe

__all__ = [
    "HOUR", "DAY", "floor_to", "hours_ago_bound", "day_range_bounds", "window_bounds",
    "strict_seam", "catchup_seam", 
    "parse_policy_list", "unique_policies",
    "render_column", "render_nested", "csv_safe",
]
