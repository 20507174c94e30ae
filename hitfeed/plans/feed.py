"""Feed specification: which policies, from which array column, over which time window."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from hitfeed.functions.policies import parse_policy_list
from hitfeed.functions.timebounds import window_bounds


def _is_set(v) -> bool:
    return v is not None and v != "" and v != ()


@dataclass(frozen=True)
class FeedSpec:
    """Exactly one of ``policies`` / ``parent_policies`` (delimiter-joined text or a
    sequence) and exactly one of ``hours_ago`` / ``day_range``.

    * ``hours_ago``: keep ``hour >= floor(now - hours_ago)``, no upper bound; 0 = current
      hour (current day with ``full_days``).
    * ``day_range``: ``YYYYMMDD-YYYYMMDD``, both days inclusive.
    * ``full_days``: align the hours-ago bound to the UTC day.
    """

    policies: str | Sequence[str] | None = None
    parent_policies: str | Sequence[str] | None = None
    hours_ago: int | None = None
    day_range: str | None = None
    full_days: bool = False
    delimiter: str = ","

    def __post_init__(self):
        if _is_set(self.policies) == _is_set(self.parent_policies):
            raise ValueError("exactly one of policies and parent_policies must be set")
        if not isinstance(self.full_days, bool):
            raise ValueError(f"full_days must be a bool, got {self.full_days!r}")
        if self.day_range is not None and self.full_days:
            raise ValueError("full_days applies to hours_ago windows only")
        # validates hours / day range (raises ValueError)
        window_bounds(0, self.hours_ago, self.day_range, self.full_days)
        # validates the list (raises ValueError when empty)
        self.values

    @property
    def policy_column(self) -> str:
        return "policies" if _is_set(self.policies) else "parent_policies"

    @property
    def values(self) -> list[str]:
        text = self.policies if _is_set(self.policies) else self.parent_policies
        return parse_policy_list(text, self.delimiter)

    def window(self, now: int) -> tuple[int, int | None]:
        return window_bounds(now, self.hours_ago, self.day_range, self.full_days)

    def hour_predicate(self, now: int, column: str = "hour") -> Column:
        lo, hi = self.window(now)
        pred = F.col(column) >= F.lit(lo)
        if hi is not None:
            pred = pred & (F.col(column) < F.lit(hi))
        return pred
