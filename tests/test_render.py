"""Rendering of nested values (maps, structs, arrays) to feed text."""

from pyspark.sql import functions as F

from hitfeed.functions.render import csv_safe, render_nested
from literal_rows import frame


def test_dns_nested(spark):
    df = render_nested(frame(spark, "dns")).orderBy("start_time")
    rows = {r["client_address"]: r for r in df.collect()}
    r = rows["10.2.3.4"]
    assert r["dns_answer"] == "[{name=malware.bad, ttl=60}, {}]"
    assert r["dns_authority"] == "[{ns=a.example, ttl=None}]"
    assert r["dns_additional"] == "[]"
    assert r["dns_answer_ips"] == ("[{ip=1.2.3.4, cc=US, region=None, city=X, asnum=1, asname=A}, "
                                   "{ip=5.6.7.8, cc=None, region=None, city=None, asnum=None, asname=None}]")
    assert r["parent_policies"] == "[sb-phishing-page, sb-infected-page]"
    assert r["policies"] == "[pol-a, null, pol-b]"
    assert r["start_time"] == 1706652000000005  # scalars keep their type
    r2 = rows["10.9.9.9"]
    assert r2["dns_answer"] is None and r2["dns_answer_ips"] == "[]" and r2["parent_policies"] is None


def test_proxy_maps_and_text(spark):
    df = csv_safe(frame(spark, "proxy"))
    r = df.first()
    # (a map built from a Python dict has no fixed entry order)
    assert sorted(r["annotations"][1:-1].split(", ")) == ["k=v", "n=None"]
    assert r["request_headers"] == "{}"
    assert r["response_headers"] is None
    assert r["ssl_core_domains"] == "[1, 2, null]"
    assert r["request_version"] == "1.5" and r["meta_timestamp"] == "1706652009"
    assert all(t == "string" for _, t in df.dtypes)


def test_render_is_native(spark):
    df = render_nested(frame(spark, "proxy"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_top_level_struct(spark):
    df = spark.createDataFrame([((1, None),), (None,)], "s struct<a:int,b:string>")
    assert [r[0] for r in render_nested(df).collect()] == ["{a=1, b=None}", None]
    assert render_nested(df.select(F.array("s").alias("l"))).first()[0] == "[{a=1, b=None}]"
