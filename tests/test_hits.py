"""Explode semantics (lateral unnest) and the filter-inside-explode rewrite."""

from pyspark.sql import functions as F

from hitfeed.functions.render import render_nested
from hitfeed.operators.hits import explode_policies
from hitfeed.plans.export import export_feed
from hitfeed.plans.feed import FeedSpec
from literal_rows import H, frame

import pytest


def test_one_request_two_policies(spark):
    dns = frame(spark, "dns")
    out = export_feed(dns, FeedSpec(parent_policies="sb-phishing-page,sb-infected-page", hours_ago=0), H + 60)
    rows = out.filter(F.col("client_address") == "10.2.3.4").collect()
    assert sorted(r["policy"] for r in rows) == ["sb-infected-page", "sb-phishing-page"]
    # in-place projection: policy sits where parent_policies was, policies stays
    assert out.columns.index("policy") == 13 and "policies" in out.columns


def test_policies_column_and_null_elements(spark):
    out = export_feed(frame(spark, "dns"), FeedSpec(policies="pol-a,pol-b", hours_ago=5), H + 60)
    assert sorted(r["policy"] for r in out.collect()) == ["pol-a", "pol-a", "pol-b"]
    with pytest.raises(ValueError):
        export_feed(frame(spark, "proxy"), FeedSpec(policies="x", hours_ago=1), H)


def test_duplicates_nulls_empty(spark, small_log):
    full = explode_policies(small_log, "parent_policies")
    n_expected = small_log.select(
        F.sum(F.when(F.col("parent_policies").isNull(), 0).otherwise(F.size("parent_policies")))).first()[0]
    assert full.count() == n_expected  # null and empty arrays give no row
    dup = full.groupBy("event_id", "policy").count().filter("count > 1").count()
    assert dup > 0  # duplicate elements give duplicate rows


def test_modes_agree(spark, small_log):
    vals = ["view", "p3", "click"]
    a, b, c = (render_nested(explode_policies(small_log, "parent_policies", vals, mode=m))
               for m in ("overlap", "after", "inside"))
    for x, y in ((a, b), (a, c)):
        assert x.count() == y.count() and x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0
    with pytest.raises(ValueError):
        explode_policies(small_log, "parent_policies", vals, mode="fast")


def test_mode_plans(spark, small_log):
    inside = explode_policies(small_log, "parent_policies", ["view"], mode="inside")
    assert "Generate explode(filter(" in inside._jdf.queryExecution().optimizedPlan().toString()
    overlap = explode_policies(small_log, "parent_policies", ["view"])
    plan = overlap._jdf.queryExecution().executedPlan().toString()
    assert plan.index("arrays_overlap") > plan.index("Generate")  # the pre-filter sits below Generate
    assert "WholeStageCodegen" in overlap._jdf.queryExecution().executedPlan().treeString() or "*(" in plan
