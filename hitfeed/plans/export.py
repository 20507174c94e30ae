"""Full export of a feed (job A): prune to the window, one row per wanted policy hit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from hitfeed.functions.render import render_nested
from hitfeed.operators.hits import explode_policies
from hitfeed.operators.multifeed import multi_feed_hits
from hitfeed.plans.feed import FeedSpec


def export_feed(logs: DataFrame, spec: FeedSpec, now: int, *, mode: str = "overlap",
                render: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """Policy hits of one feed.

    The window predicate is a literal on the ``hour`` partition column, so it reaches the
    scan as a partition filter; ``mode`` picks how the policy list is applied (see
    :func:`hitfeed.operators.hits.explode_policies`).  Nested columns
    are rendered to text (``render=False`` keeps them typed).  ``columns`` restricts the
    output (column pruning reaches the scan); default: every column in table order.
    """
    scoped = logs.filter(spec.hour_predicate(now))
    if columns is not None:
        unknown = [c for c in columns if c not in logs.columns and c != "policy"]
        if unknown:
            raise ValueError(f"unknown columns {unknown}")
        keep = [c for c in logs.columns if c in set(columns) | {spec.policy_column}]
        scoped = scoped.select(*keep)
    hits = explode_policies(scoped, spec.policy_column, spec.values, mode=mode)
    return render_nested(hits) if render else hits


def export_multi(logs: DataFrame, feeds, now: int, *, policy_column: str = "parent_policies", render: bool = True,
                 salt_buckets: int | None = None) -> DataFrame:
    """Many feeds in one scan: the union of ``export_feed`` over ``feeds``, tagged by feed
    name (see :func:`hitfeed.operators.multifeed.multi_feed_hits`)."""
    hits = multi_feed_hits(logs, feeds, now, policy_column=policy_column, salt_buckets=salt_buckets)
    return render_nested(hits) if render else hits
