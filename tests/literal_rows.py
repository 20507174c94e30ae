"""Hand-written rows in the two full log schemas (types the synthetic tables lack)."""

from hitfeed.schemas import schema_for

H = 1706652000  # 2024-01-30 22:00 UTC
T0 = H * 1_000_000


def _row(schema, values):
    unknown = set(values) - set(schema.names)
    assert not unknown, unknown
    return tuple(values.get(f.name) for f in schema.fields)


def dns_rows():
    return [
        dict(start_time=T0 + 5, resolver="pm-resolver", client_address="10.2.3.4", request_length=60,
             core_domain="malware.bad", parent_policies=["sb-phishing-page", "sb-infected-page"],
             policies=["pol-a", None, "pol-b"], rtt=3, flags=["RD"], meta_timestamp=1706652005123,
             dns_flags=[], dns_authority=[{"ns": "a.example", "ttl": None}],
             dns_additional=[], dns_answer=[{"name": "malware.bad", "ttl": "60"}, {}],
             dns_answer_ips=[{"ip": "1.2.3.4", "cc": "US", "region": None, "city": "X", "asnum": "1", "asname": "A"},
                             {"ip": "5.6.7.8", "cc": None, "region": None, "city": None, "asnum": None, "asname": None}],
             subscriber="sub.dod", year=2024, month=1, day=30, hour=H),
        dict(start_time=T0 + 7, resolver="pm-resolver", client_address="10.9.9.9",
             parent_policies=None, policies=["pol-a"], dns_answer=None, dns_answer_ips=[],
             subscriber="sub.dod", year=2024, month=1, day=30, hour=H),
        dict(start_time=T0 - 3600 * 1_000_000, resolver="r2", parent_policies=["sb-phishing-page"],
             policies=[], subscriber="sub.x", year=2024, month=1, day=30, hour=H - 3600),
    ]


def proxy_rows():
    return [
        dict(start_time=T0 + 9, elapsed_time=12, protocol="https", client_address="10.0.0.1",
             annotations={"k": "v", "n": None}, request_headers={}, response_headers=None,
             request_version=1.5, response_version=2.0, flags=["a", "b"], meta_timestamp=1706652009,
             ssl_server_names=["x.example"], ssl_core_domains=[1, 2, None], parent_policies=["sb-block"],
             policy_name='quote " and, comma', subscriber="sub.dod.proxy", year=2024, month=1, day=30, hour=H),
    ]


def frame(spark, kind):
    schema = schema_for(kind)
    rows = dns_rows() if kind == "dns" else proxy_rows()
    return spark.createDataFrame([_row(schema, r) for r in rows], schema)
