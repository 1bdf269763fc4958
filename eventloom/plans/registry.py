"""Queries by name, each with the SQL that it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The model of ``sources.model`` in DuckDB's SQL; queries' SQL begins with it.
MODEL = """
with ov as (
  select cast(user_id as varchar) as distinct_id, cast(user_id + 1 as varchar) as now_id
  from (select distinct user_id from events where user_id % 10 = 0)),
ev as (
  select e.event_id, e.event_type as event_name, cast(e.user_id as varchar) as distinct_id, cast(e.user_id as varchar) as raw_person_id,
         coalesce(ov.now_id, cast(e.user_id as varchar)) as person_id, e.ts, (epoch_us(e.ts) // 1000) as ms, e.value,
         left(e.props, length(e.props) - 1) || case e.event_id % 5 when 1 then ', "plan": "free", "ok": true}' when 2 then ', "plan": "pro", "ok": false}'
           when 3 then ', "plan": "", "ok": null}' when 4 then ', "plan": "12.5", "seen": "2024-01-15"}' else '}' end as properties,
         's' || (e.user_id % 5) as segment,
         cast(e.user_id as varchar) || '-' || strftime(e.ts, '%Y-%m-%d') as session_id, '/' || e.event_type || '/' || (e.event_id % 7) as page_path,
         case when e.event_id % 4 = 0 then '' else 'ref' || (e.event_id % 4) end as referrer,
         case e.user_id % 3 when 0 then 'desktop' when 1 then 'mobile' else 'tablet' end as device_type,
         case e.user_id % 3 when 0 then 'chrome' when 1 then 'firefox' else 'safari' end as browser,
         case e.user_id % 3 when 0 then 'linux' when 1 then 'windows' else 'macos' end as os, e.user_id
  from events e left join ov on cast(e.user_id as varchar) = ov.distinct_id),
pe as (
  select *, coalesce(json_extract_string(properties, '$.plan'), '') as plan, json_extract(properties, '$.plan') is not null as has_plan,
         coalesce(json_extract_string(properties, '$.ok'), '') as ok, json_extract(properties, '$.ok') is not null as has_ok,
         cast(json_extract_string(properties, '$.k') as double) as k, coalesce(json_extract_string(properties, '$.seen'), '') as seen from ev)
"""


def query(sql: str | None = None, name: str | None = None):
    """Register a query; ``sql`` goes after MODEL's common tables."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"two queries are named {key}")
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = (MODEL + sql) if not sql.lstrip().startswith("--bare") else sql.lstrip()[len("--bare") :]
        return f

    return add
