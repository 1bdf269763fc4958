"""Queries of funnels, paths, web analytics and cohorts with their SQL."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from eventloom.functions.filters import Filter
from eventloom.functions.timeutil import bucket
from eventloom.operators import cohorts as C
from eventloom.operators import funnel as U
from eventloom.operators import paths as P
from eventloom.operators import web as W
from eventloom.plans.insights import _MEMBERS, FROM, IN, TO, members
from eventloom.plans.registry import MODEL, ORACLES, query
from eventloom.plans import fixtures as M

HOUR = 3_600_000
STEPS = (U.Step(("signup",)), U.Step(("view",)), U.Step(("purchase",)))
FUNNEL = U.FunnelSpec(STEPS, FROM, TO, window=6, window_unit="hour")


def _chain(steps: list[str], window: int, inside: str = IN, more: str = "''") -> str:
    """Common tables s1 ... sn: for each event that can be a step, the newest window start that it goes back to."""
    out = f", e as (select person_id, ms, event_id, event_name, plan, k, {more} as b from pe where {inside}), s1 as (select person_id, ms, event_id, ms as st from e where {steps[0]})"
    for k, step in enumerate(steps[1:], 2):
        out += f", s{k} as (select e.person_id, e.ms, e.event_id, max(s.st) as st from e join s{k - 1} s on e.person_id = s.person_id and (s.ms < e.ms or s.ms = e.ms and s.event_id < e.event_id) and e.ms <= s.st + {window} where {step} group by 1, 2, 3)"
    levels = " union all ".join(f"select distinct person_id, {k} as l from s{k}" for k in range(1, len(steps) + 1))
    return out + f", lv as (select person_id, max(l) as max_step from ({levels}) group by person_id)"


def _counts(n: int, by: str = "") -> str:
    """Step counts from lv (max_step, and the column by)."""
    group = f"{by}, " if by else ""
    part = f"partition by {by} " if by else ""
    return f""", c as (select {group}s.step::int as step, count_if(max_step >= s.step)::bigint as n_persons from lv cross join (select unnest(range(1, {n + 1})) as step) s group by {group}s.step),
w as (select *, first_value(n_persons) over ({part}order by step) as top, lead(n_persons) over ({part}order by step) as nxt from c)
select {group}step, n_persons, case when top > 0 then floor(n_persons * 100.0 / top * 10.0 + 0.5) / 10.0 else 0.0 end as conversion_rate,
  (case when nxt is null then 0 else n_persons - nxt end)::bigint as drop_off,
  case when n_persons > 0 then floor((case when nxt is null then 0 else n_persons - nxt end) * 100.0 / n_persons * 10.0 + 0.5) / 10.0 else 0.0 end as drop_off_rate from w"""


_NAMES = ["event_name = 'signup'", "event_name = 'view'", "event_name = 'purchase'"]
_E_NAMES = ["e." + x for x in _NAMES]
_E = [_NAMES[0], *_E_NAMES[1:]]


def _funnel(name: str, sql: str | None, spec: U.FunnelSpec) -> None:
    query(sql, name)(lambda spark, sf: U.funnel(M.events(spark, sf), spec))


_funnel("funnel_ordered", _chain(_E, 6 * HOUR) + _counts(3), FUNNEL)
_funnel("funnel_ordered_window_minutes", _chain(_E, HOUR // 2) + _counts(3), replace(FUNNEL, window=30, window_unit="minute"))
_funnel("funnel_or_steps", _chain([_NAMES[0], "e.event_name in ('view', 'click')"], 6 * HOUR) + _counts(2), replace(FUNNEL, steps=(STEPS[0], U.Step(("view", "click")))))
_PLAN = (Filter("properties.plan", "in", values=("free", "pro")),)
_funnel("funnel_step_filter", _chain([_NAMES[0], "e.event_name = 'view' and e.plan in ('free', 'pro')", _E[2]], 6 * HOUR) + _counts(3), replace(FUNNEL, steps=(STEPS[0], U.Step(("view",), _PLAN), STEPS[2])))
_COVER = f""", e as (select person_id, ms, case event_name when 'signup' then 0 when 'view' then 1 else 2 end as s from ev where event_name in ('signup', 'view', 'purchase') and {IN}),
has0 as (select distinct person_id from e where s = 0),
cov as (select a.person_id, a.ms, a.s as own, count(distinct b.s) as n from e a join e b on a.person_id = b.person_id and b.ms between a.ms and a.ms + {6 * HOUR} where a.person_id in (select person_id from has0) group by 1, 2, 3),
lv as (select person_id, max(n) as max_step from cov group by person_id)"""
UNORDERED = replace(FUNNEL, mode="unordered")
_funnel("funnel_unordered", _COVER + _counts(3), UNORDERED)
_STRICT_ON = f"s.level > 0 and o.m = s.level and o.ms <= s.begin + {3 * 24 * HOUR}"
_STRICT = f""", od as (select person_id, ms, row_number() over (partition by person_id order by ms, event_id) as rn, case event_name when 'signup' then 0 when 'view' then 1 when 'purchase' then 2 else -1 end as m
  from ev where {IN} and person_id in (select person_id from ev where {IN} and event_name in ('signup', 'view', 'purchase'))),
st as (select distinct person_id, 0::bigint as rn, 0 as level, 0::bigint as begin, false as done from od
  union all
  select o.person_id, o.rn, case when s.done or s.level >= 3 then s.level when {_STRICT_ON} then s.level + 1 when o.m = 0 and s.level <= 1 then 1 else s.level end,
    case when s.done or s.level >= 3 or ({_STRICT_ON}) then s.begin when o.m = 0 and s.level <= 1 then o.ms else s.begin end,
    case when s.done or s.level >= 3 then s.done when {_STRICT_ON} then false when o.m = 0 and s.level <= 1 then false when s.level = 0 then s.done else true end
  from st s join od o on o.person_id = s.person_id and o.rn = s.rn + 1),
lv as (select person_id, max_by(level, rn) as max_step from st group by person_id)"""
_funnel("funnel_strict", "--bare " + MODEL.replace("with ov", "with recursive ov") + _STRICT + _counts(3), replace(FUNNEL, mode="strict", window=3, window_unit="day"))
_funnel("funnel_sampled", None, replace(FUNNEL, sampling=0.25))
_EXCLUDED = f""", f as (select person_id, ms from ev where event_name = 'signup' and {IN}), t as (select person_id, ms from ev where event_name = 'view' and {IN}), x as (select person_id, ms from ev where event_name = 'error' and {IN}),
pr as (select f.person_id, exists (select 1 from x where x.person_id = f.person_id and x.ms > f.ms and x.ms < t.ms) as bad from f join t on f.person_id = t.person_id and t.ms > f.ms and t.ms <= f.ms + {6 * HOUR}),
ban as (select person_id from pr group by person_id having bool_and(bad))"""
_funnel(
    "funnel_exclusion",
    _chain(_E, 6 * HOUR).replace("lv as (select", "lv0 as (select") + _EXCLUDED + ", lv as (select * from lv0 where person_id not in (select person_id from ban))" + _counts(3),
    replace(FUNNEL, exclusions=(U.Exclusion("error", 0, 1),)),
)
_BREAK = _chain(_E, 6 * HOUR, more="device_type").replace("lv as (select", "lv0 as (select")


@query(_chain(_E, 6 * HOUR) + _counts(3))
def funnel_aggregate_steps(spark, sf):
    """The steps of all groups together are those of the funnel without a breakdown, if all groups are shown."""
    return U.aggregate_steps(U.funnel_breakdown(M.events(spark, sf), replace(FUNNEL, breakdown="device_type")), 3)


@query(_BREAK + ", fv as (select person_id, min_by(b, (ms, event_id)) as breakdown from e where event_name = 'signup' group by 1), fs as (select person_id, max_step, coalesce(breakdown, '(none)') as breakdown from lv0 left join fv using (person_id)), ns as (select distinct person_id, 0 as max_step, '(none)' as breakdown from e where event_name in ('view', 'purchase') and person_id not in (select person_id from lv0)), lv as (select * from fs union all select * from ns)" + _counts(3, "breakdown"))
def funnel_breakdown(spark, sf):
    return U.funnel_breakdown(M.events(spark, sf), replace(FUNNEL, breakdown="device_type"))


@query(_chain(_E, 6 * HOUR).replace("lv as (select", "lv0 as (select") + f", {_MEMBERS}, lv as (select cohort_id, person_id, max_step from lv0 join mem using (person_id))" + _counts(3, "cohort_id"))
def funnel_cohort_breakdown(spark, sf):
    people = U.funnel_by_cohort(M.events(spark, sf), FUNNEL, members(spark, sf))
    return people


_TIMES = f""", d as (select person_id from lv where max_step >= {{need}}),
pl as (select person_id, min(ms) as p from e where event_name = '{{to}}' and person_id in (select person_id from d) group by 1),
z0 as (select pl.person_id, p, min(e.ms) as s0 from pl join e on e.person_id = pl.person_id and e.event_name = 'signup' and e.ms <= p and p - e.ms <= {6 * HOUR} group by 1, 2)"""


@query(_chain(_E, 6 * HOUR) + _TIMES.format(need=3, to="purchase") + " select avg((p - s0) / 1000.0) as avg_seconds, count(*) as n_converted from z0 where p > s0 and s0 > 0")
def funnel_avg_time(spark, sf):
    return U.average_time(M.events(spark, sf), FUNNEL)


@query(_chain(_E, 6 * HOUR) + _counts(3).replace("select step, n_persons", ", fin as (select step, n_persons") + ") select case when max(case step when 1 then n_persons end) > 0 then floor(max(case step when 3 then n_persons end) * 100.0 / max(case step when 1 then n_persons end) * 10.0 + 0.5) / 10.0 else 0.0 end as conversion_rate from fin")
def funnel_overall_conversion(spark, sf):
    return U.overall_conversion(U.funnel(M.events(spark, sf), FUNNEL))


_TTC = _chain(_E, 6 * HOUR) + _TIMES.format(need=2, to="view") + f", z1 as (select z0.person_id, s0, min(e.ms) as s1 from z0 join e on e.person_id = z0.person_id and e.event_name = 'view' and e.ms >= s0 group by 1, 2), tt as (select person_id, (s1 - s0) / 1000.0 as seconds from z1 where s1 - s0 between 0 and {6 * HOUR})"


@query(_TTC + " select count(*) as n, avg(seconds) as avg_seconds, quantile_cont(seconds, 0.5) as median_seconds from tt")
def ttc_stats(spark, sf):
    return U.time_stats(U.conversion_times(M.events(spark, sf), FUNNEL, 0, 1))


@query(
    _TTC
    + """, h as (select count(*) as n, min(seconds) as low, max(seconds) as high from tt), h2 as (select *, case when high = low then 1 else least(60, greatest(1, ceil(round(cbrt(n), 9))))::int end as bins from h),
h3 as (select *, greatest(1.0, ceil((high - low) / bins)) as width from h2 where n > 0),
b as (select unnest(range(0, bins)) as bin, low, width from h3), cn as (select least(floor((seconds - low) / width), bins - 1)::int as bin, count(*) as n from tt cross join h3 group by 1)
select b.bin::int as bin, (low + b.bin * width)::double as low, coalesce(n, 0)::bigint as n_persons from b left join cn on b.bin = cn.bin"""
)
def ttc_histogram(spark, sf):
    return U.time_histogram(U.conversion_times(M.events(spark, sf), FUNNEL, 0, 1))


@query(
    _COVER
    + f""", fa as (select person_id, coalesce(max(ms) filter (where own = 0), max(ms) filter (where own = 1), max(ms) filter (where own = 2)) as a from cov where n = 3 group by 1),
tt as (select fa.person_id, min(e.ms) filter (where s = 0) as f, min(e.ms) filter (where s = 1) as t from fa join e on e.person_id = fa.person_id and e.ms between a and a + {6 * HOUR} group by 1)
select count(*) as n, avg((t - f) / 1000.0) as avg_seconds, quantile_cont((t - f) / 1000.0, 0.5) as median_seconds from tt where t >= f and f > 0"""
)
def ttc_unordered(spark, sf):
    return U.time_stats(U.conversion_times(M.events(spark, sf), UNORDERED, 0, 1))


# Paths
def _paths_sql(limit: int, where: str = "true", name: str = "event_name", start: str = "", end: str = "") -> str:
    sql = f""", e as (select person_id, ms, event_id, {name} as name from ev where {IN} and {where}),
l as (select *, lag(name) over (partition by person_id order by ms, event_id) as p from e),
q as (select person_id, name, row_number() over (partition by person_id order by ms, event_id) as i from l where p is null or p <> name),
r0 as (select person_id, name, i from q where i <= {limit})"""
    if start:
        sql += f", b as (select person_id, min(i) as f from r0 where name = '{start}' group by 1), r1 as (select person_id, name, i - f + 1 as i from r0 join b using (person_id) where i >= f), r1c as (select person_id from r1 group by 1 having count(*) >= 2), r2 as (select * from r1 where person_id in (select person_id from r1c))"
    else:
        sql += ", r2 as (select * from r0)"
    if end:
        sql += f", z as (select person_id, min(i) as t from r2 where name = '{end}' group by 1), r3 as (select person_id, name, i from r2 join z using (person_id) where i < t)"
    else:
        sql += ", r3 as (select * from r2)"
    return sql + ", ok as (select person_id from r3 group by 1 having count(*) >= 2), path as (select * from r3 where person_id in (select person_id from ok))"


_TRANS = " select a.i::int as step, a.name as source, b.name as target, count(distinct a.person_id) as n_persons from path a join path b on a.person_id = b.person_id and b.i = a.i + 1 group by 1, 2, 3"
PATHS = P.PathSpec(FROM, TO)


@query(_paths_sql(5) + _TRANS)
def path_transitions(spark, sf):
    return P.transitions(M.events(spark, sf), PATHS)


@query(_paths_sql(3) + ", w as (select person_id, string_agg(name, ' > ' order by i) as path from path group by 1) select path, count(*) as n_persons from w group by 1 order by 2 desc, 1 limit 20")
def path_top(spark, sf):
    return P.top_paths(M.events(spark, sf), replace(PATHS, step_limit=3))


@query(_paths_sql(12, f"person_id in (select person_id from ev where event_name = 'signup' and {IN})", start="signup", end="purchase") + _TRANS)
def path_start_end(spark, sf):
    return P.transitions(M.events(spark, sf), replace(PATHS, step_limit=12, start_event="signup", end_event="purchase"))


@query(_paths_sql(5, name="case when event_name like 'sign%' then 'entry' when event_name like '_lick' then 'touch' when regexp_matches(event_name, 'view|purch') then 'shop' else event_name end") + _TRANS)
def path_cleaned(spark, sf):
    return P.transitions(M.events(spark, sf), replace(PATHS, groups=(("entry", ("sign*",)), ("touch", ("?lick",))), rules=(("shop", "view|purch"),)))


@query(_paths_sql(5, "event_name <> 'error'") + _TRANS + " having count(distinct a.person_id) >= 3")
def path_exclusions(spark, sf):
    return P.transitions(M.events(spark, sf), replace(PATHS, exclusions=("error",), min_persons=3))


# Web
def _web_sql(inside: str = IN) -> str:
    return f""", s0 as (select session_id, count_if(event_name = 'view') as pageviews, min(ts) as start, floor((max(ms) - min(ms)) / 1000)::bigint as seconds, min(person_id) as person_id,
  min_by(page_path, (ts, event_id)) filter (where event_name = 'view') as entry_page, max_by(page_path, (ts, event_id)) filter (where event_name = 'view') as exit_page,
  min_by(referrer, (ts, event_id)) as referrer, min_by(device_type, (ts, event_id)) as device_type, min_by(browser, (ts, event_id)) as browser, min_by(os, (ts, event_id)) as os, min(user_id) as user_id
  from ev where {inside} group by 1), s as (select *, pageviews = 1 and seconds < 10 as bounced from s0 where pageviews > 0)"""


_KPI = "count(distinct person_id) as visitors, coalesce(sum(pageviews), 0)::bigint as pageviews, count(*) as n_sessions, coalesce(floor(avg(seconds) * 100.0 + 0.5) / 100.0, 0.0) as avg_seconds, case when count(*) > 0 then floor(count_if(bounced) * 100.0 / count(*) * 100.0 + 0.5) / 100.0 else 0.0 end as bounce_rate"


def sessions(spark, sf, a=FROM, b=TO):
    return W.sessions(M.events(spark, sf), a, b)


@query(_web_sql() + f" select {_KPI} from s")
def web_kpis(spark, sf):
    return W.kpis(sessions(spark, sf))


@query(_web_sql("ts >= timestamp '2024-01-08' and ts <= timestamp '2024-01-16 23:59:59'") + f" select {_KPI} from s")
def web_kpis_previous(spark, sf):
    from eventloom.functions.timeutil import previous_period

    return W.kpis(sessions(spark, sf, *previous_period("2024-01-17", TO)))


@query(_web_sql() + f" select strftime(start, '%Y-%m-%d') as bucket, {_KPI} from s group by 1")
def web_timeseries(spark, sf):
    return W.timeseries(sessions(spark, sf))


def _top(name: str, column: str, rows=sessions) -> None:
    sql = _web_sql() + f" select {column} as value, count(distinct person_id) as visitors, sum(pageviews)::bigint as pageviews from s where {column} <> '' group by 1 order by 2 desc, 1 limit 20"
    query(sql, name)(lambda spark, sf: W.top_by(rows(spark, sf), column))


_top("web_entry_pages", "entry_page")
_top("web_exit_pages", "exit_page")
_top("web_sources", "referrer")
_top("web_devices", "device_type")
_top("web_browsers", "browser")
_top("web_systems", "os")


@query(f"select page_path as value, count(distinct person_id) as visitors, count(*) as pageviews from ev where event_name = 'view' and {IN} group by 1 order by 3 desc, 1 limit 20")
def web_top_pages(spark, sf):
    return W.top_pages(M.events(spark, sf), FROM, TO)


def _placed(spark, sf):
    """Events with places of the user, and with properties that name a campaign."""
    rows = M.with_geography(spark, sf, M.events(spark, sf)).withColumn("city", F.when(F.col("user_id") % 6 > 0, F.concat(F.lit("c"), (F.col("user_id") % 6).cast("string"))).otherwise(""))
    bag = F.format_string('{"utm_source": "s%d", "utm_medium": "%s", "utm_campaign": null}', F.col("event_id") % 3, F.when(F.col("event_id") % 4 == 0, "").otherwise("mail"))
    return rows.withColumn("properties", F.when(F.col("event_id") % 5 > 0, bag).otherwise(F.lit("{}")))


def _dimension(name: str, dimension: str, value: str) -> None:
    sql = f", d as (select person_id, {value} as value from ev join nation n on ev.user_id % 25 = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey where event_name = 'view' and {IN}) select value, count(distinct person_id) as visitors, count(*) as pageviews from d where value <> '' group by 1 order by 2 desc, 1 limit 20"
    query(sql, name)(lambda spark, sf: W.top_dimension(_placed(spark, sf), dimension, FROM, TO))


_dimension("web_regions", "region", "r_name")
_dimension("web_cities", "city", "case when user_id % 6 > 0 then 'c' || (user_id % 6) else '' end")
_dimension("web_utm_sources", "utm_source", "case when event_id % 5 > 0 then 's' || (event_id % 3) else '' end")
_dimension("web_utm_mediums", "utm_medium", "case when event_id % 5 > 0 and event_id % 4 > 0 then 'mail' else '' end")
_dimension("web_utm_campaigns", "utm_campaign", "''")


@query(_web_sql().replace("min(user_id) as user_id", "min_by(n.n_name, (ts, event_id)) as country").replace("from ev where", "from ev join nation n on ev.user_id % 25 = n.n_nationkey where") + " select country as value, count(distinct person_id) as visitors, sum(pageviews)::bigint as pageviews from s group by 1 order by 2 desc, 1 limit 20")
def web_geography(spark, sf):
    return W.top_by(W.sessions(M.with_geography(spark, sf, M.events(spark, sf)), FROM, TO), "country")


# Cohorts
AS_OF = datetime(2024, 1, 25, 12)
_NOW = "timestamp '2024-01-25 12:00:00'"


def _ago(days: int) -> str:
    return f"ts >= {_NOW} - interval {days} day and ts <= {_NOW}"


def context(spark, sf, date_from=None):
    return C.Context(M.events(spark, sf), C.Bounds(AS_OF, date_from), members(spark, sf))


def _cohort(name: str, node: dict, sql: str, date_from: str | None = None) -> None:
    query(sql, name)(lambda spark, sf: C.persons(context(spark, sf, date_from), node))


EVENT = {"type": "event", "event_name": "purchase", "count_operator": "gte", "count": 3, "time_window_days": 7}
_COUNT = f"select person_id from ev where event_name = 'purchase' and {_ago(7)} group by 1 having count(*) >= 3"
_cohort("cohort_event_count", EVENT, _COUNT)
_cohort("cohort_event_zero", {**EVENT, "count_operator": "eq", "count": 0}, f"select person_id from ev where {_ago(7)} group by 1 having count_if(event_name = 'purchase') = 0")
for _kind, _value in (("sum", "sum(k)"), ("avg", "avg(k)"), ("min", "min(k)"), ("max", "max(k)"), ("median", "quantile_cont(k, 0.5)"), ("p75", "quantile_cont(k, 0.75)"), ("p90", "quantile_cont(k, 0.9)"), ("p95", "quantile_cont(k, 0.95)"), ("p99", "quantile_cont(k, 0.99)")):
    _cohort(f"cohort_event_{_kind}", {**EVENT, "aggregation_type": _kind, "aggregation_property": "properties.k", "count": 60, "time_window_days": 14}, f"select person_id from pe where event_name = 'purchase' and {_ago(14)} group by 1 having {_value} >= 60")
_cohort("cohort_event_filtered", {**EVENT, "count": 1, "event_filters": [{"property": "properties.plan", "operator": "eq", "value": "pro"}]}, f"select distinct person_id from pe where event_name = 'purchase' and plan = 'pro' and {_ago(7)}")
_cohort("cohort_property", {"type": "person_property", "property": "user_properties.segment", "operator": "in", "values": ["s1", "s3"]}, "select person_id from ev group by 1 having max_by(segment, (ts, event_id)) in ('s1', 's3')")
_cohort("cohort_first_time", {"type": "first_time_event", "event_name": "purchase", "time_window_days": 20}, f"select person_id from ev where event_name = 'purchase' and ts <= {_NOW} group by 1 having min(ts) >= {_NOW} - interval 20 day")
_cohort("cohort_not_performed", {"type": "not_performed_event", "event_name": "purchase", "time_window_days": 5}, f"select person_id from ev where {_ago(5)} group by 1 having count_if(event_name = 'purchase') = 0")
_cohort("cohort_not_performed_range", {"type": "not_performed_event", "event_name": "purchase", "time_window_days": 30}, f"select person_id from ev where ts >= timestamp '2024-01-20' and ts <= {_NOW} group by 1 having count_if(event_name = 'purchase') = 0", "2024-01-20")
SEQUENCE = {"type": "event_sequence", "steps": [{"event_name": "signup"}, {"event_name": "purchase"}], "window_days": 1, "time_window_days": 20}
#: Two steps: the first step's first event is never left for a later one, so the gap counts from there to any later second step.
_SEQ = f""", sq as (select person_id, ms, event_id, event_name from ev where event_name in ('signup', 'purchase') and {_ago(20)}),
f1 as (select person_id, min((ms, event_id)) as f from sq where event_name = 'signup' group by 1),
dn as (select distinct sq.person_id from sq join f1 using (person_id) where event_name = 'purchase' and (sq.ms, sq.event_id) > f1.f and sq.ms - f1.f[1] <= 86400000)"""
_cohort("cohort_sequence", SEQUENCE, _SEQ + " select person_id from dn")
_cohort("cohort_not_sequence", {**SEQUENCE, "type": "not_performed_event_sequence"}, _SEQ + " select distinct person_id from sq where person_id not in (select person_id from dn)")
_cohort("cohort_not_sequence_range", {**SEQUENCE, "type": "not_performed_event_sequence"}, _SEQ.replace(_ago(20), f"ts >= timestamp '2024-01-15' and ts <= {_NOW}") + f" select distinct person_id from ev where ts >= timestamp '2024-01-15' and ts <= {_NOW} and person_id not in (select person_id from dn)", "2024-01-15")
_cohort("cohort_regular", {"type": "performed_regularly", "event_name": "view", "period_type": "week", "min_periods": 3, "time_window_days": 24}, f"select person_id from ev where event_name = 'view' and {_ago(24)} group by 1 having count(distinct date_trunc('week', ts)) >= 3")
_cohort("cohort_stopped", {"type": "stopped_performing", "event_name": "purchase", "recent_window_days": 5, "historical_window_days": 20}, f"select distinct person_id from ev where event_name = 'purchase' and ts >= {_NOW} - interval 20 day and ts < {_NOW} - interval 5 day and person_id not in (select person_id from ev where event_name = 'purchase' and {_ago(5)})")
_cohort("cohort_restarted", {"type": "restarted_performing", "event_name": "purchase", "recent_window_days": 4, "gap_window_days": 4, "historical_window_days": 24}, f"select distinct person_id from ev where event_name = 'purchase' and ts >= {_NOW} - interval 24 day and ts < {_NOW} - interval 8 day and person_id not in (select person_id from ev where event_name = 'purchase' and ts >= {_NOW} - interval 8 day and ts < {_NOW} - interval 4 day) and person_id in (select person_id from ev where event_name = 'purchase' and {_ago(4)})")
_cohort("cohort_ref", {"type": "cohort", "cohort_id": "c_static"}, "select distinct cast(user_id as varchar) as person_id from events where user_id % 4 = 0")
_cohort("cohort_ref_negated", {"type": "cohort", "cohort_id": "c_dynamic", "negated": True}, f"select distinct person_id from ev where ts <= {_NOW} and person_id not in (select cast(user_id as varchar) from events where user_id % 7 < 3)")
NESTED = {"type": "AND", "values": [{"type": "OR", "values": [EVENT, {"type": "cohort", "cohort_id": "c_static"}]}, {"type": "cohort", "cohort_id": "c_dynamic"}]}
_cohort("cohort_and_or_nested", NESTED, f"select distinct cast(user_id as varchar) as person_id from events where user_id % 7 < 3 and (user_id % 4 = 0 or cast(user_id as varchar) in ({_COUNT}))")


@query(f"select event_id from ev where event_name = 'view' and {IN} and person_id in ({_COUNT})")
def cohort_filtered_events(spark, sf):
    from eventloom.functions.timeutil import in_range

    rows = M.events(spark, sf).where((F.col("event_name") == "view") & in_range(FROM, TO))
    return C.restrict(rows, context(spark, sf), [EVENT]).select("event_id")


@query(f", mt as (select 'a' as cohort_id, person_id from ({_COUNT}) union all select 'b', person_id from ({_COUNT}) where person_id in (select cast(user_id as varchar) from events where user_id % 4 = 0)) select cohort_id, count(distinct person_id) as n_persons from mt group by 1")
def cohort_materialized_sizes(spark, sf):
    nested = {"type": "AND", "values": [{"type": "cohort", "cohort_id": "a"}, {"type": "cohort", "cohort_id": "c_static"}]}
    c = context(spark, sf)
    c.members = c.members.withColumn("version", F.lit(0).cast("long"))
    rows = C.materialize(c, {"b": nested, "a": EVENT}, 7)
    return C.sizes(C.latest_members(rows).where("version = 7"))


@query("select 'c_dynamic' as cohort_id, strftime(ts, '%Y-%m-%d') as \"date\", max_by(n, ts) as n_persons from (select date_trunc('hour', ts) as ts, count(distinct user_id) as n from ev where ts >= timestamp '2024-01-10' group by 1) group by 2")
def cohort_size_history(spark, sf):
    hours = M.events(spark, sf).groupBy(bucket(F.col("ts"), "hour").alias("recorded_at")).agg(F.count_distinct("user_id").alias("count"))
    rows = hours.select(F.lit("c_dynamic").alias("cohort_id"), F.to_date("recorded_at").alias("date"), "count", "recorded_at")
    return C.size_history(rows, "2024-01-10").select("cohort_id", F.col("date").cast("string").alias("date"), F.col("count").alias("n_persons"))


_STATIC = "select cast(user_id as varchar) as person_id from events where user_id % 4 = 0"


@query(f"--bare select 'c_static' as cohort_id, person_id from (({_STATIC}) union (select cast(user_id as varchar) from events where user_id % 9 = 1)) where cast(person_id as int) % 8 <> 0 union select 'copy', person_id from ({_STATIC})")
def cohort_static_members(spark, sf):
    """A static cohort after adding persons, removing others, and a copy of what it was."""
    users = M.read(spark, sf, "events").select(F.col("user_id").cast("string").alias("person_id"), "user_id").distinct()
    before = M.static_members(spark, sf)
    now = C.add_members(before, "c_static", users.where("user_id % 9 = 1").select("person_id"))
    now = C.remove_members(now, "c_static", users.where("user_id % 8 = 0").select("person_id"))
    return now.unionByName(C.duplicate_as_static(before, "c_static", "copy"))


@query(f", r as (select 'inline' as kind, person_id from ({_COUNT}) union select 'static', person_id from ({_STATIC}) union select 'computed', cast(user_id as varchar) from events where user_id % 7 < 3) select kind, count(distinct person_id) as n_persons from r group by 1")
def cohort_routing(spark, sf):
    c, static, computed = context(spark, sf), M.static_members(spark, sf), M.materialized_members(spark, sf)
    kinds = {"inline": {"cohort_id": "x", "definition": EVENT}, "static": {"cohort_id": "c_static", "is_static": True}, "computed": {"cohort_id": "c_dynamic", "materialized": True}}
    parts = [C.members_of(c, cohort, static, computed).select(F.lit(kind).alias("kind"), "person_id") for kind, cohort in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count_distinct("person_id").alias("n_persons"))


@query(f"--bare select 'known' as case_, count(distinct user_id) as n from events where user_id % 4 = 0 union all select 'none known', count(distinct user_id) from events where user_id % 4 = 0")
def cohort_drop_orphans(spark, sf):
    members = M.static_members(spark, sf)
    more = members.unionByName(members.select(F.lit("gone").alias("cohort_id"), "person_id"))
    known = members.select("cohort_id").distinct()
    left, all_ = C.drop_orphans(more, known), C.drop_orphans(members, known.where("false"))
    return left.select(F.lit("known").alias("case_")).unionByName(all_.select(F.lit("none known").alias("case_"))).groupBy("case_").agg(F.count("*").alias("n"))


#: The same questions with a limit above which most persons are cut into chunks; the answers are those of whole arrays.
CUT = {"most_events": 45, "whole_bytes": 0}


def _cut(name: str, of: str, ask) -> None:
    query("--bare " + ORACLES[of], name)(ask)


_cut("funnel_cut_ordered", "funnel_ordered", lambda spark, sf: U.funnel(M.events(spark, sf), replace(FUNNEL, **CUT)))
_cut("funnel_cut_strict", "funnel_strict", lambda spark, sf: U.funnel(M.events(spark, sf), replace(FUNNEL, mode="strict", window=3, window_unit="day", **CUT)))
_cut("funnel_cut_unordered", "funnel_unordered", lambda spark, sf: U.funnel(M.events(spark, sf), replace(UNORDERED, **CUT)))
_cut("funnel_cut_exclusion", "funnel_exclusion", lambda spark, sf: U.funnel(M.events(spark, sf), replace(FUNNEL, exclusions=(U.Exclusion("error", 0, 1),), **CUT)))
_cut("ttc_cut", "ttc_stats", lambda spark, sf: U.time_stats(U.conversion_times(M.events(spark, sf), replace(FUNNEL, **CUT), 0, 1)))
_cut("ttc_cut_unordered", "ttc_unordered", lambda spark, sf: U.time_stats(U.conversion_times(M.events(spark, sf), replace(UNORDERED, **CUT), 0, 1)))
_cut("cohort_cut_sequence", "cohort_sequence", lambda spark, sf: C.persons(replace(context(spark, sf), most_events=10, whole_bytes=0), SEQUENCE))
_cut("ttc_selected", "ttc_stats", lambda spark, sf: U.selected_time_stats(U.conversion_times(M.events(spark, sf), FUNNEL, 0, 1)))


@query(f", mt as (select 'a' as cohort_id, person_id from ({_COUNT}) union all select 'b', person_id from ({_COUNT}) where person_id in (select cast(user_id as varchar) from events where user_id % 4 = 0) union all select 'c', person_id from ({_COUNT}) where person_id not in (select cast(user_id as varchar) from events where user_id % 4 = 0)) select cohort_id, person_id, case cohort_id when 'a' then 1 else 2 end::bigint as version from mt")
def cohort_refreshed(spark, sf):
    """Three levels of cohorts as tables; then one of the second level is due, and what refers to it with it."""
    nested = {"type": "AND", "values": [{"type": "cohort", "cohort_id": "a"}, {"type": "cohort", "cohort_id": "c_static"}]}
    rest = {"type": "AND", "values": [{"type": "cohort", "cohort_id": "a"}, {"type": "cohort", "cohort_id": "b", "negated": True}]}
    folder, definitions, c = M.scratch(spark, "cohorts"), {"b": nested, "a": EVENT, "c": rest}, context(spark, sf)
    C.refresh(c, definitions, folder, 1)
    return C.refreshed(spark, folder, C.refresh(c, definitions, folder, 2, {"b"}))
