"""Fixed log schemas (DNS, proxy), partition columns and the feed's target column list.

Schemas are given, never inferred: the files and the table definition may differ, and the
definition wins (missing columns read as null, extra ones are ignored).
"""

from __future__ import annotations

import functools

from pyspark.sql import types as T

# --- Fixed values: column names, order and types of the two log tables -------------------
# (they must equal the source tables' definitions; partition columns come last)

PARTITION_COLUMNS = [
    ("subscriber", "string"),
    ("year", "int"),
    ("month", "int"),
    ("day", "int"),
    ("hour", "int"),
]

_ANSWER_IP = "struct<ip:string,cc:string,region:string,city:string,asnum:string,asname:string>"

DNS_COLUMNS = [
    ("start_time", "bigint"),
    ("resolver", "string"),
    ("client_address", "string"),
    ("request_length", "int"),
    ("res_serial", "bigint"),
    ("elapsed_time", "int"),
    ("response_length", "int"),
    ("client_port", "int"),
    ("address_family", "int"),
    ("core_domain", "string"),
    ("client_qname", "string"),
    ("service_view", "string"),
    ("server_address", "string"),
    ("parent_policies", "array<string>"),
    ("policies", "array<string>"),
    ("rtt", "int"),
    ("flags", "array<string>"),
    ("meta_timestamp", "bigint"),
    ("meta_engine_type", "string"),
    ("meta_engine_version", "string"),
    ("meta_anonymizer_key_hash", "string"),
    ("meta_customer_name", "string"),
    ("meta_node_id", "string"),
    ("dns_opcode", "string"),
    ("dns_flags", "array<string>"),
    ("dns_rcode", "string"),
    ("dns_id", "bigint"),
    ("dns_authority", "array<map<string,string>>"),
    ("dns_additional", "array<map<string,string>>"),
    ("dns_question_rdtype", "string"),
    ("dns_question_name", "string"),
    ("dns_question_rdclass", "string"),
    ("dns_answer", "array<map<string,string>>"),
    ("dns_answer_ips", f"array<{_ANSWER_IP}>"),
    ("dns_simple_answer", "string"),
    ("dns_simple_authority", "string"),
    ("tld", "string"),
    ("client_cc", "string"),
    ("client_region", "string"),
    ("client_city", "string"),
    ("client_asnum", "string"),
    ("client_asname", "string"),
    ("rec_type", "string"),
    ("data_version", "string"),
]

PROXY_COLUMNS = [
    ("start_time", "bigint"),
    ("elapsed_time", "int"),
    ("protocol", "string"),
    ("client_address", "string"),
    ("client_port", "int"),
    ("server_address", "string"),
    ("server_port", "int"),
    ("proxy_address", "string"),
    ("proxy_port", "int"),
    ("proxy_source_address", "string"),
    ("proxy_source_port", "int"),
    ("client_bytes_received", "bigint"),
    ("client_bytes_sent", "bigint"),
    ("server_bytes_received", "bigint"),
    ("server_bytes_sent", "bigint"),
    ("service_view", "string"),
    ("policy_name", "string"),
    ("policy_conditions", "string"),
    ("policy_actions", "string"),
    ("policy_lists", "string"),
    ("policy_lists_matched", "string"),
    ("annotations", "map<string,string>"),
    ("beacon_url", "string"),
    ("request_version", "float"),
    ("request_method", "string"),
    ("request_host", "string"),
    ("request_path", "string"),
    ("request_core_domains", "int"),
    ("request_headers", "map<string,string>"),
    ("request_ua", "string"),
    ("response_version", "float"),
    ("response_status_code", "int"),
    ("response_headers", "map<string,string>"),
    ("flags", "array<string>"),
    ("meta_timestamp", "int"),
    ("meta_engine_type", "string"),
    ("meta_engine_version", "string"),
    ("meta_node_id", "string"),
    ("ssl_version_major", "int"),
    ("ssl_version_minor", "int"),
    ("ssl_server_names", "array<string>"),
    ("ssl_core_domains", "array<int>"),
    ("client_cc", "string"),
    ("client_region", "string"),
    ("client_city", "string"),
    ("client_asnum", "string"),
    ("client_asname", "string"),
    ("tld", "string"),
    ("parent_policies", "array<string>"),
    ("data_version", "string"),
]

# A subscriber directory with this suffix holds proxy logs; any other holds DNS logs.
PROXY_SUFFIX = ".proxy"
KINDS = ("dns", "proxy")
POLICY_COLUMNS = ("policies", "parent_policies")
# -------------------------------------------------------------------------------------------


def ddl(columns) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in columns)


@functools.cache
def struct_from_ddl(text: str) -> T.StructType:
    """Parsed by Spark itself (needs an active session; built on first use)."""
    return T.StructType.fromDDL(text)


DNS_DDL = ddl(DNS_COLUMNS + PARTITION_COLUMNS)
PROXY_DDL = ddl(PROXY_COLUMNS + PARTITION_COLUMNS)
PARTITION_NAMES = [n for n, _ in PARTITION_COLUMNS]


def normalize_kind(kind: str) -> str:
    """``dns`` or ``proxy``, case-insensitive; anything else is an error."""
    k = (kind or "").lower()
    if k not in KINDS:
        raise ValueError(f"invalid kind {kind!r}; expected one of {KINDS}")
    return k


def schema_for(kind: str) -> T.StructType:
    return struct_from_ddl(DNS_DDL if normalize_kind(kind) == "dns" else PROXY_DDL)


def target_columns(schema: T.StructType, policy_column: str) -> list[str]:
    """Ordered output columns of a feed: the schema order with ``policy_column`` replaced
    in place by ``policy``.  The policy column must occur exactly once."""
    names = [f.name for f in schema.fields]
    n = names.count(policy_column)
    if n != 1:
        raise ValueError(f"expected exactly one {policy_column!r} column, found {n} in {names}")
    return ["policy" if c == policy_column else c for c in names]
