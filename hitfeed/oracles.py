"""DuckDB twins of the registered queries (same tables, pre-registered as views).

Bounds are written out with plain arithmetic here, independently of the library code.
"""

from __future__ import annotations

import hashlib

from hitfeed.schemas import DNS_COLUMNS, PROXY_COLUMNS


def _pbkdf2(salt: str, ordinal: str, subscriber: str, receiver: str) -> str:
    return hashlib.pbkdf2_hmac("sha512", (subscriber + receiver).encode(), (salt + ordinal).encode(), 100000).hex()


SALT = "example-salt"
SUBSCRIBERS = [f"sub.{i}{s}" for i in range(3) for s in ("", ".proxy")]

NOW = 1706659200
H, D = 3600, 86400

POLICY_LOG = """
e AS (SELECT *, epoch_us(ts) AS start_time FROM events),
policy_log AS (
  SELECT event_id, start_time, user_id, event_type,
    CASE WHEN user_id % 11 = 0 THEN CAST(NULL AS VARCHAR[])
         WHEN user_id % 13 = 0 THEN CAST([] AS VARCHAR[])
         WHEN user_id % 5 = 0 THEN [event_type, 'p' || CAST(user_id % 5 AS VARCHAR), event_type]
         ELSE [event_type, 'p' || CAST(user_id % 5 AS VARCHAR)] END AS parent_policies,
    MAP {'k': props->>'$.k', 't': event_type} AS annotations,
    'sub.' || CAST(user_id % 3 AS VARCHAR) || CASE WHEN user_id % 2 = 0 THEN '.proxy' ELSE '' END AS subscriber,
    CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
    CAST((start_time // 3600000000) * 3600 AS INTEGER) AS hour
  FROM e)"""


def render_map(col: str) -> str:
    return (f"'{{' || array_to_string(list_transform(map_entries({col}), "
            f"lambda x: x.key || '=' || coalesce(x.value, 'None')), ', ') || '}}'")


HIT_COLS = ["event_id", "start_time", "user_id", "event_type", "policy", "annotations",
            "subscriber", "year", "month", "day", "hour"]


def _in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def hits_from(where: str = "TRUE", policies=None) -> str:
    """CTE text ``hits`` (rendered, typed) for a window and policy list."""
    pol = f"WHERE policy IN ({_in(policies)})" if policies else ""
    return f"""{POLICY_LOG},
exploded AS (
  SELECT event_id, start_time, user_id, event_type, unnest(parent_policies) AS policy,
         annotations, subscriber, year, month, day, hour
  FROM policy_log WHERE {where}),
hits AS (
  SELECT event_id, start_time, user_id, event_type, policy, {render_map('annotations')} AS annotations,
         subscriber, year, month, day, hour
  FROM exploded {pol})"""


def hits(where="TRUE", policies=None) -> str:
    return f"WITH {hits_from(where, policies)} SELECT * FROM hits"


def hits_text(where="TRUE", policies=None, outer_where="TRUE") -> str:
    cols = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in HIT_COLS)
    return f"WITH {hits_from(where, policies)} SELECT {cols} FROM hits WHERE {outer_where}"


FLAG = ["error", "p3"]
FLAG_WHERE = f"hour >= {NOW - 72 * H}"


def _prev_where(t: int, hours: int = 72) -> str:
    """The feed as exported at ``t`` from the source as it stood at ``t``."""
    return f"hour >= {((t - hours * H) // H) * H} AND start_time < {t * 1_000_000}"


T_LAST = NOW - 5 * H - 1234

ORACLES: dict[str, str] = {
    "policy_hits_hours_ago": hits(FLAG_WHERE, FLAG),
    "policy_hits_full_days": hits(f"hour >= {((NOW - 30 * H) // D) * D}", ["purchase", "p1"]),
    "policy_hits_day_range": hits("hour >= 1704844800 AND hour < 1705104000", ["signup", "p2", "p4"]),
    "explode_duplicates_and_nulls": f"WITH {POLICY_LOG} SELECT event_id, user_id, unnest(parent_policies) AS policy FROM policy_log",
    "policy_hits_prefiltered": hits(f"hour >= {NOW - 168 * H}", ["view", "p0", "p4"]),
    "policy_hits_unnest_then_filter": hits(f"hour >= {NOW - 168 * H}", ["view", "p0", "p4"]),
    "policy_hits_filter_in_generator": hits(f"hour >= {NOW - 168 * H}", ["view", "p0", "p4"]),
    "policy_list_filter": hits(f"hour >= {NOW - 720 * H}", ["view", " p3", "p1", "click ", "purchase"]),
    "kind_dns": hits(FLAG_WHERE + " AND subscriber NOT LIKE '%.proxy'", FLAG),
    "kind_proxy": hits(FLAG_WHERE + " AND subscriber LIKE '%.proxy'", FLAG),
    "union_all_subscribers": f"""WITH {POLICY_LOG}, r AS (
        SELECT event_id, start_time, user_id, event_type, CAST(parent_policies AS VARCHAR) AS parent_policies,
               {render_map('annotations')} AS annotations, subscriber, year, month, day, hour FROM policy_log)
      SELECT * FROM r WHERE subscriber LIKE 'sub.0%'
      UNION ALL BY NAME SELECT * FROM r WHERE subscriber LIKE 'sub.1%'
      UNION ALL BY NAME SELECT * FROM r WHERE subscriber LIKE 'sub.2%'""",
    "source_names": f"""WITH {POLICY_LOG}, b AS (SELECT DISTINCT subscriber || '-' || event_type AS bucket FROM policy_log)
      SELECT bucket, translate('hitfeed-logs-' || bucket, '-.', '__') AS database_name,
             split_part(bucket, '-', 1) AS subscriber_name FROM b""",
    "stored_partitions": f"WITH {POLICY_LOG} SELECT DISTINCT subscriber, year, month, day, hour FROM policy_log",
    "missing_partitions": f"WITH {POLICY_LOG} SELECT DISTINCT subscriber, year, month, day, hour FROM policy_log WHERE hour >= 1706400000",
    "sync_partitions": f"WITH {POLICY_LOG} SELECT DISTINCT subscriber, year, month, day, hour FROM policy_log WHERE subscriber NOT LIKE '%.proxy'",
    "catalog_table_export": hits(FLAG_WHERE, FLAG),
    "latest_snapshot_rows": hits_text(FLAG_WHERE, FLAG),
    "retained_snapshot": hits_text(_prev_where(NOW - H), FLAG, f"hour >= {NOW - 48 * H}"),
    "seam_snapshot": hits_text(_prev_where(NOW - H), FLAG, f"hour < {NOW - 24 * H}"),
    "last_seen_hour": f"""WITH {hits_from(_prev_where(T_LAST), FLAG)}, m AS (SELECT max(start_time) AS s FROM hits)
      SELECT s AS last_start_time, CAST((s // 1000000 // 3600) * 3600 AS BIGINT) AS last_seen_hour,
             CAST((s // 1000000 // 86400) * 86400 AS BIGINT) AS last_seen_day FROM m""",
    "refresh_feed_strict": hits_text(FLAG_WHERE, FLAG),
    "refresh_feed_catchup": hits_text(FLAG_WHERE, FLAG),
    "refresh_hour_table": hits(FLAG_WHERE, FLAG),
    "run_metrics": f"""WITH {hits_from("TRUE", FLAG)}
      SELECT
        CAST(count(*) FILTER (WHERE hour >= {NOW - H - 72 * H} AND start_time < {(NOW - H) * 1_000_000}) AS BIGINT) AS input_rows,
        CAST(count(*) FILTER (WHERE hour >= {NOW - 72 * H} AND start_time < {(NOW - H) * 1_000_000}) AS BIGINT) AS in_window_rows,
        CAST(count(*) FILTER (WHERE hour >= {NOW - 72 * H} AND hour < {NOW - H} AND start_time < {(NOW - H) * 1_000_000}) AS BIGINT) AS kept_rows,
        CAST(count(*) FILTER (WHERE hour >= {NOW - H}) AS BIGINT) AS new_rows
      FROM hits""",
    "csv_roundtrip": """SELECT CAST(doc_id AS VARCHAR) AS doc_id, NULLIF(text, '') AS text, NULLIF(lang, '') AS lang,
                               NULLIF(source, '') AS source, CAST(n_chars AS VARCHAR) AS n_chars FROM documents""",
    "render_array": f"WITH {POLICY_LOG} SELECT event_id, CAST(parent_policies AS VARCHAR) AS parent_policies FROM policy_log",
    "render_map": f"""WITH m AS (SELECT event_id,
        CASE WHEN user_id % 11 = 0 THEN NULL
             WHEN user_id % 13 = 0 THEN CAST(MAP {{}} AS MAP(VARCHAR, VARCHAR))
             ELSE MAP {{'k': props->>'$.k', 'n': CASE WHEN user_id % 7 = 0 THEN NULL ELSE event_type END}} END AS attrs
      FROM events)
      SELECT event_id, {render_map('attrs')} AS attrs FROM m""",
    "render_nested": """SELECT event_id,
        CASE WHEN user_id % 11 = 0 THEN NULL
             WHEN user_id % 13 = 0 THEN '[]'
             ELSE '[{name=' || event_type || '.example, ttl=' || CAST(user_id AS VARCHAR) || '}, {k='
                  || coalesce(props->>'$.k', 'None') || '}]' END AS dns_answer,
        CASE WHEN user_id % 11 = 0 THEN NULL
             ELSE '[{ip=10.0.0.' || CAST(user_id % 256 AS VARCHAR) || ', cc='
                  || CASE WHEN user_id % 2 = 0 THEN 'US' ELSE 'None' END || ', asnum=' || CAST(user_id AS VARCHAR)
                  || '}, {ip=10.1.0.' || CAST(event_id % 256 AS VARCHAR) || ', cc=DE, asnum=None}]' END AS dns_answer_ips
      FROM events""",
    "hits_ordered": f"""WITH {hits_from(FLAG_WHERE, FLAG)}
      SELECT row_number() OVER (ORDER BY start_time, event_id, policy) AS ordinal,
             event_id, start_time, policy, subscriber FROM hits""",
    "multi_feed_hits": f"""WITH {hits_from("TRUE")}
      SELECT 'a' AS feed, * FROM hits WHERE hour >= {((NOW - 72 * H) // D) * D} AND policy IN ('error', 'p3')
      UNION ALL SELECT 'b' AS feed, * FROM hits WHERE hour >= {((NOW - 1 * H) // D) * D} AND policy IN ('p3')
      UNION ALL SELECT 'c' AS feed, * FROM hits WHERE hour >= {((NOW - 720 * H) // D) * D} AND policy IN ('view', 'view', 'click')""",
    "stream_hits_dns": hits("subscriber NOT LIKE '%.proxy'", FLAG),
    "stream_hits_proxy": hits("subscriber LIKE '%.proxy'", FLAG),
    "stream_hits_available_now": hits("TRUE", FLAG),
    "stream_hits_retained": hits(FLAG_WHERE, FLAG),
}


_LOC_CASE = " ".join(f"WHEN '{s}' THEN '{_pbkdf2(SALT, '1', s, 'soc@' + s)}'" for s in SUBSCRIBERS)
ORACLES["feed_locations"] = f"""WITH {POLICY_LOG}
  SELECT subscriber, 'soc@' || subscriber AS receiver, '1' AS ordinal,
         CASE subscriber {_LOC_CASE} END AS feed_location
  FROM (SELECT DISTINCT subscriber FROM policy_log)"""

_FEED_LOC = {n: _pbkdf2(SALT, str(i + 1), f"sub.{i}", f"soc{i}@example.org") for i, n in enumerate("abc")}
_text_cols = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in HIT_COLS)
ORACLES["multi_feed_csv"] = f"""WITH {hits_from("TRUE")}, m AS (
      SELECT 'a' AS feed, * FROM hits WHERE hour >= {((NOW - 72 * H) // D) * D} AND policy IN ('error', 'p3')
      UNION ALL SELECT 'b' AS feed, * FROM hits WHERE hour >= {((NOW - 1 * H) // D) * D} AND policy IN ('p3')
      UNION ALL SELECT 'c' AS feed, * FROM hits WHERE hour >= {((NOW - 720 * H) // D) * D} AND policy IN ('view', 'click'))
  SELECT feed, {_text_cols},
         CASE feed {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _FEED_LOC.items())} END AS feed_location
  FROM m"""
ORACLES["saved_view_sql"] = hits(FLAG_WHERE, FLAG)
ORACLES["feed_export_job"] = hits_text(FLAG_WHERE, FLAG)
ORACLES["feed_export_republish"] = hits_text(FLAG_WHERE, FLAG)
ORACLES["latest_snapshot_many_incomplete"] = hits_text(FLAG_WHERE, FLAG)
ORACLES["repair_then_read"] = hits(FLAG_WHERE + " AND subscriber NOT LIKE '%.proxy'", FLAG)
ORACLES["sync_with_locations"] = f"""WITH {hits_from(FLAG_WHERE + " AND hour >= 1706400000", FLAG)}
  SELECT * REPLACE (subscriber || ':x' AS subscriber) FROM hits"""
ORACLES["refresh_hour_table_corrected"] = hits(f"hour >= {NOW - 72 * H} AND hour <> {NOW - 5 * H}", FLAG)
ORACLES["multi_feed_by_day"] = f"""WITH {hits_from("TRUE")}
  SELECT policy || '-' || printf('%04d%02d%02d', year, month, day) AS feed, * FROM hits"""
ORACLES["multi_feed_by_source"] = f"""WITH {hits_from("TRUE")}
  SELECT 's0' AS feed, * FROM hits WHERE hour >= 1706313600 AND hour < 1706486400 AND policy IN ('error', 'p3')
    AND subscriber IN ('sub.0', 'sub.0.proxy')
  UNION ALL SELECT 's1' AS feed, * FROM hits WHERE hour >= {((NOW - 72 * H) // D) * D} AND policy = 'error'
    AND subscriber IN ('sub.1', 'sub.1.proxy')
  UNION ALL SELECT 'all' AS feed, * FROM hits WHERE hour >= {NOW - 10 * H} AND policy IN ('p3', 'error')
    AND subscriber LIKE '%.proxy'"""
#: The check's value of each column type, rendered, by the column's name {c} and place {i}.
_RENDERED = {
    "string": "'{c}/' || event_id % 97", "int": "CAST((event_id + {i}) % 1000 AS INTEGER)", "bigint": "CAST(event_id * 1000 + {i} AS BIGINT)",
    "float": "CAST(event_id % 100 + 0.5 AS FLOAT)", "array<string>": "'[{c}, ' || event_type || ']'", "array<int>": "'[' || event_id % 7 || ', {i}]'",
    "map<string,string>": "'{{k=' || event_type || ', n=' || event_id % 5 || '}}'",
    "array<map<string,string>>": "'[{{name=' || event_type || '.example}}, {{ttl=' || event_id % 11 || '}}]'",
    "array<struct<ip:string,cc:string,region:string,city:string,asnum:string,asname:string>>":
        "'[{{ip=10.0.0.' || event_id % 256 || ', cc=US, region=None, city=' || event_type || ', asnum=' || event_id % 9 || ', asname={c}}}]'",
}
for _kind, _not, _columns in (("dns", "NOT ", DNS_COLUMNS), ("proxy", "", PROXY_COLUMNS)):
    _own = {"start_time": "start_time", "parent_policies": "CAST(parent_policies AS VARCHAR)", "policies": "'[' || event_type || ', any]'"}
    _values = ",\n    ".join(f"{_own.get(c) or _RENDERED[t].format(c=c, i=i)} AS {c}" for i, (c, t) in enumerate(_columns))
    ORACLES[f"read_{_kind}_full_schema"] = f"""WITH {POLICY_LOG}
  SELECT {_values}, subscriber, year, month, day, hour
  FROM policy_log WHERE subscriber {_not}LIKE '%.proxy'"""
ORACLES["add_partition_at_location"] = f"""WITH {POLICY_LOG}
  SELECT event_id, start_time, 'it''s:here' AS subscriber, 2024 AS year, 1 AS month, 31 AS day, {NOW} AS hour FROM policy_log"""
_forms = {"hours": f"hour >= {NOW - 5 * H}", "current": f"hour >= {NOW}", "days": f"hour >= {((NOW - 30 * H) // D) * D}",
          "range": "hour >= 1705708800 AND hour < 1705881600"}
ORACLES["window_choice"] = f"WITH {POLICY_LOG} " + " UNION ALL ".join(
    f"SELECT '{k}' AS form, count(*) AS n, min(hour) AS first, max(hour) AS last FROM policy_log WHERE {w}" for k, w in _forms.items())
ORACLES["policy_column_choice"] = f"""WITH {POLICY_LOG},
  x AS (SELECT start_time, unnest([event_type, 'any']) AS policy, CAST(parent_policies AS VARCHAR) AS parent_policies,
               subscriber, year, month, day, hour FROM policy_log WHERE {FLAG_WHERE} AND subscriber NOT LIKE '%.proxy')
  SELECT * FROM x WHERE policy IN ('error', 'any')"""
ORACLES["refresh_hour_feed_csv"] = hits_text(FLAG_WHERE, FLAG)

ORACLES["stream_hits_compacted"] = ORACLES["stream_hits_proxy"]
ORACLES["csv_roundtrip_escaped"] = ORACLES["csv_roundtrip"]
ORACLES["feed_statistics"] = f"""WITH {hits_from(FLAG_WHERE, FLAG)}
  SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(max(start_time) AS BIGINT) AS max_start_time, CAST(min(hour) AS BIGINT) AS min_hour,
         CAST(max(hour) AS BIGINT) AS max_hour FROM hits"""
