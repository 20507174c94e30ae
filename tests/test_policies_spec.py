import pytest

from hitfeed.functions.policies import parse_policy_list, unique_policies
from hitfeed.plans.feed import FeedSpec
from hitfeed.schemas import DNS_COLUMNS, PARTITION_COLUMNS, PROXY_COLUMNS, normalize_kind, target_columns


def test_policy_list():
    assert parse_policy_list("a,,b, c") == ["a", "b", " c"]
    assert parse_policy_list("a|b||a", "|") == ["a", "b", "a"]
    assert unique_policies(["view", "view", "click"]) == ["view", "click"]
    with pytest.raises(ValueError):
        parse_policy_list(",,")


def test_spec_validation():
    s = FeedSpec(parent_policies="x,y", hours_ago=3)
    assert s.policy_column == "parent_policies" and s.values == ["x", "y"]
    assert FeedSpec(policies="x", day_range="20240101-20240102").policy_column == "policies"
    for kw in [dict(hours_ago=1), dict(policies="a", parent_policies="b", hours_ago=1),
               dict(policies="a"), dict(policies="a", hours_ago=1, day_range="20240101-20240102"),
               dict(policies="a", hours_ago=-1), dict(policies="a", hours_ago=1, full_days="false"),
               dict(policies=",", hours_ago=1), dict(policies="a", day_range="2024-01-01")]:
        with pytest.raises(ValueError):
            FeedSpec(**kw)


def test_schema_shapes(spark):
    from hitfeed.schemas import schema_for
    assert len(DNS_COLUMNS) == 44 and len(PROXY_COLUMNS) == 50 and len(PARTITION_COLUMNS) == 5
    dns, proxy = schema_for("DNS"), schema_for("proxy")
    assert len(dns.fields) == 49 and len(proxy.fields) == 55
    assert [f.name for f in dns.fields][-5:] == ["subscriber", "year", "month", "day", "hour"]
    assert dns["meta_timestamp"].dataType.simpleString() == "bigint"
    assert proxy["meta_timestamp"].dataType.simpleString() == "int"
    assert proxy["request_version"].dataType.simpleString() == "float"
    cols = target_columns(dns, "policies")
    assert cols.index("policy") == 14 and "parent_policies" in cols and "policies" not in cols
    with pytest.raises(ValueError):
        target_columns(proxy, "policies")  # proxy logs have parent_policies only
    with pytest.raises(ValueError):
        normalize_kind("web")
