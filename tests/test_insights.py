"""Handcrafted scenarios with literal results."""

from datetime import datetime, timedelta

import pytest

from eventloom.functions import timeutil as T
from eventloom.functions.filters import OPERATORS, Filter, condition
from eventloom.operators import adhoc, cohorts, drilldown, funnel, paths, retention, trend, web
from eventloom.operators.funnel import Exclusion, FunnelSpec, Step
from eventloom.operators.retention import ActivitySpec
from eventloom.operators.trend import Series, TrendSpec

START = datetime(2024, 1, 10, 8)
SCHEMA = "person_id string, event_name string, ts timestamp_ntz, ms long, event_id long, properties string, user_properties string, session_id string, page_path string, referrer string, value double"


def rows(spark, *events):
    """Events (person, name, minutes or time, properties)."""
    out = []
    for k, (person, name, at, *more) in enumerate(events):
        ts = START + timedelta(minutes=at) if isinstance(at, int | float) else datetime.fromisoformat(at)
        ms = int((ts - datetime(1970, 1, 1)).total_seconds() * 1000)
        out.append((person, name, ts, ms, k, more[0] if more else "{}", "{}", f"{person}-1", f"/{name}", "", 1.0))
    return spark.createDataFrame(out, SCHEMA)


def sequence(spark, person, names, step=1):
    return [(person, n, k * step) for k, n in enumerate(names)]


def counts(df):
    return [r["n_persons"] for r in df.orderBy("step").collect()]


ABC = tuple(Step((n,)) for n in "ABC")
DAY = dict(date_from="2024-01-10", date_to="2024-01-10")


def test_three_step_funnel(spark):
    e = rows(spark, *sequence(spark, "p", ["A", "B", "C"]), ("q", "B", 1))
    assert counts(funnel.funnel(e, FunnelSpec((Step(("A",)), Step(("B",)), Step(("C",))), **DAY))) == [1, 1, 1]
    e = rows(spark, *sequence(spark, "p", ["A", "B", "C"]), ("q", "A", 1))
    assert counts(funnel.funnel(e, FunnelSpec(ABC, **DAY))) == [2, 1, 1]


def test_funnel_without_events_has_zero_rows_for_each_step(spark):
    got = funnel.funnel(rows(spark, ("p", "X", 0)), FunnelSpec(ABC, **DAY)).orderBy("step").collect()
    assert [(r["n_persons"], r["conversion_rate"], r["drop_off"]) for r in got] == [(0, 0.0, 0)] * 3


@pytest.mark.parametrize(
    ("names", "level"),
    [("A X B", 1), ("A X A B", 1), ("A A B", 2), ("A B A B", 2), ("X A B C", 3), ("A C B", 1), ("A B X C", 2), ("A B C X", 3)],
)
def test_strict_order(spark, names, level):
    people = funnel.per_person(rows(spark, *sequence(spark, "p", names.split())), FunnelSpec(ABC, mode="strict", **DAY))
    assert people.first()["max_step"] == level


def test_strict_counts_of_three_persons(spark):
    e = rows(spark, *sequence(spark, "a", "A B C".split()), *sequence(spark, "b", "A B X C".split()), *sequence(spark, "c", "A X B C".split()))
    assert counts(funnel.funnel(e, FunnelSpec(ABC, mode="strict", **DAY))) == [3, 2, 1]


def test_window_restarts_and_an_event_fills_one_step(spark):
    e = rows(spark, ("p", "A", 0), ("p", "A", 100), ("p", "B", 130))
    assert counts(funnel.funnel(e, FunnelSpec(ABC[:2], window=1, window_unit="hour", **DAY))) == [1, 1]
    e = rows(spark, ("p", "A", 0), ("p", "B", 61))
    assert counts(funnel.funnel(e, FunnelSpec(ABC[:2], window=1, window_unit="hour", **DAY))) == [1, 0]
    e = rows(spark, ("p", "A", 0))
    assert counts(funnel.funnel(e, FunnelSpec((ABC[0], ABC[0]), **DAY))) == [1, 0]
    e = rows(spark, ("p", "A", 0), ("p", "B", 0.2 / 60))
    assert counts(funnel.funnel(e, FunnelSpec(ABC[:2], window=1, window_unit="second", **DAY))) == [1, 1]


def test_unordered_funnel_and_retry(spark):
    e = rows(spark, *sequence(spark, "p", "C A B".split()), ("q", "B", 0), ("r", "A", 0), ("r", "A", 300), ("r", "B", 310))
    spec = FunnelSpec(ABC, mode="unordered", window=1, window_unit="hour", **DAY)
    assert counts(funnel.funnel(e, spec)) == [2, 2, 1]
    ordered = funnel.per_person(e, FunnelSpec(ABC, window=1, window_unit="hour", **DAY)).where("max_step = 3").count()
    assert ordered <= funnel.per_person(e, spec).where("max_step = 3").count()
    with pytest.raises(ValueError):
        FunnelSpec((ABC[0], ABC[0]), mode="unordered", **DAY).validate()


def test_exclusion_spares_a_clean_way(spark):
    spec = FunnelSpec(ABC[:2], exclusions=(Exclusion("X", 0, 1),), **DAY)
    e = rows(spark, *sequence(spark, "p", "A X B".split()), *sequence(spark, "q", "A X A B".split()), *sequence(spark, "r", "A B X".split()))
    assert {r["person_id"] for r in funnel.per_person(e, spec).collect()} == {"q", "r"}
    with pytest.raises(ValueError):
        FunnelSpec(ABC, exclusions=(Exclusion("X", 1, 1),), **DAY).validate()


def test_sampling_ends(spark):
    e = rows(spark, *[(f"p{k}", "A", k) for k in range(50)])
    assert funnel.sampled(e, 0.0).count() == 0 and funnel.sampled(e, 1.5).count() == 50 and funnel.sampled(e, float("nan")).count() == 50
    assert 0 < funnel.sampled(e, 0.5).count() < 50


def test_average_time_and_histogram(spark):
    e = rows(spark, ("p", "A", 0), ("p", "A", 10), ("p", "B", 12), ("q", "A", 0), ("q", "B", 4))
    spec = FunnelSpec(ABC[:2], **DAY)
    assert funnel.average_time(e, spec).first()["avg_seconds"] == (720 + 240) / 2
    strict = FunnelSpec(ABC[:2], mode="strict", **DAY)
    assert funnel.average_time(e, strict).first()["avg_seconds"] == (120 + 240) / 2
    times = funnel.conversion_times(e, spec, 0, 1)
    assert {(r["person_id"], r["seconds"]) for r in times.collect()} == {("p", 720.0), ("q", 240.0)}
    assert sum(r["n_persons"] for r in funnel.time_histogram(times).collect()) == 2
    assert [tuple(r) for r in funnel.time_histogram(times.where("person_id = 'p'")).collect()] == [(0, 720.0, 1)]
    assert funnel.time_histogram(times.where("false")).collect() == []


def test_breakdown_keeps_the_empty_value(spark):
    e = rows(spark, ("p", "A", 0, '{"x": "u"}'), ("p", "B", 1), ("q", "A", 0), ("r", "A", 0, '{"x": "v"}'), ("s", "A", 0, '{"x": "w"}'))
    got = funnel.funnel_breakdown(e, FunnelSpec(ABC[:2], breakdown="properties.x", breakdown_limit=2, **DAY)).where("step = 1").collect()
    assert {r["breakdown"]: r["n_persons"] for r in got} == {"u": 1, "v": 1, "(none)": 1}
    assert funnel.truncated(e, FunnelSpec(ABC[:2], breakdown="properties.x", breakdown_limit=2, **DAY)).first()[0]


PROPS = ['{"x": "abc"}', '{"x": 5}', '{"x": true}', '{"x": null}', '{"x": ""}', "{}", "broken", '{"x": "130.9"}', '{"x": "2024-01-15T10:00:00"}', '{"x": {"y": 1}}']


@pytest.mark.parametrize(
    ("f", "hits"),
    [
        (Filter("properties.x", "eq", "true"), [2]),
        (Filter("properties.x", "eq", "5"), [1]),
        (Filter("properties.x", "neq", "abc"), [1, 2, 3, 4, 7, 8, 9]),
        (Filter("properties.x", "is_set"), [0, 1, 2, 7, 8, 9]),
        (Filter("properties.x", "is_not_set"), [3, 4, 5, 6]),
        (Filter("properties.x", "gt", "100"), [7]),
        (Filter("properties.x", "lte", "0"), [0, 2, 3, 4, 5, 6, 8, 9]),
        (Filter("properties.x", "not_contains", "b"), [1, 2, 3, 4, 7, 8, 9]),
        (Filter("properties.x", "not_in", values=("abc",)), [1, 2, 3, 4, 5, 6, 7, 8, 9]),
        (Filter("properties.x", "in"), []),
        (Filter("properties.x", "not_in"), list(range(10))),
        (Filter("properties.x", "is_date_exact", "2024-01-15"), [8]),
        (Filter("properties.x", "is_date_before", "not a date"), []),
        (Filter("properties.x.y", "eq", "1"), [9]),
        (Filter("event_name", "contains_multi", values=("Q", "A")), list(range(10))),
    ],
)
def test_filters_on_json_kinds(spark, f, hits):
    e = rows(spark, *[("p", "A", k, p) for k, p in enumerate(PROPS)])
    assert sorted(r["event_id"] for r in e.where(condition(f)).collect()) == hits


def test_all_operators_are_known_and_others_fail(spark):
    assert len(OPERATORS) == 21
    with pytest.raises(ValueError):
        condition(Filter("event_name", "like"))


def test_last_second_and_time_zones(spark):
    e = rows(spark, ("p", "A", "2024-01-10T23:59:59"), ("q", "A", "2024-01-10T23:59:59.001"), ("r", "A", "2024-01-11T04:59:59"))
    got = trend.trend(e, TrendSpec((Series(("A",)),), "2024-01-10", "2024-01-10", metric="unique_users")).collect()
    assert [(r["bucket"], r["n_users"]) for r in got] == [("2024-01-10", 1)]
    got = trend.trend(e, TrendSpec((Series(("A",)),), "2024-01-10", "2024-01-10", tz="America/New_York")).collect()
    assert [(r["bucket"], r["n_events"]) for r in got] == [("2024-01-10", 3)]
    with pytest.raises(ValueError):
        TrendSpec((Series(("A",)),), "2024-01-01", "2024-01-30", "hour").validate()


def test_property_metrics_count_missing_as_zero(spark):
    e = rows(spark, ("p", "A", 0, '{"v": "130.9"}'), ("p", "A", 1), ("q", "A", 2, '{"v": -10}'))
    value = lambda m: trend.trend(e, TrendSpec((Series(("A",)),), metric=f"property_{m}", property="properties.v", **DAY)).first()["value"]
    assert (round(value("sum"), 6), round(value("avg"), 6), value("min"), value("max")) == (120.9, 40.3, -10.0, 130.9)


def test_formula(spark):
    e = rows(spark, ("p", "A", 0), ("p", "A", 1), ("q", "B", 2), ("q", "B", "2024-01-11T10:00:00"))
    out = trend.trend(e, TrendSpec((Series(("A",)), Series(("B",))), "2024-01-10", "2024-01-11"))
    assert {r["bucket"]: r["value"] for r in trend.formula(out, "-B / A + 2*(1 - 0.5)", 2).collect()} == {"2024-01-10": 0.5, "2024-01-11": 1.0}
    with pytest.raises(ValueError):
        trend.formula(out, "__import__('os')", 2)


def test_relative_dates_and_periods():
    day = T.date(2024, 3, 31)
    assert [T.relative_date(x, day).isoformat() for x in ("-7d", "-1y", "mStart", "yStart", "2024-01-05")] == ["2024-03-24", "2023-04-01", "2024-03-01", "2024-01-01", "2024-01-05"]
    assert T.previous_period("2024-01-08", "2024-01-14") == ("2024-01-01", "2024-01-07")
    assert [T.n_periods("2024-01-03", "2024-02-01", u) for u in ("day", "week", "month")] == [30, 5, 2]
    assert [T.auto_unit("2024-01-01", d) for d in ("2024-01-02", "2024-03-01", "2024-06-01", "2025-06-01")] == ["hour", "day", "week", "month"]


def test_retention_with_a_cohort_without_returners(spark):
    e = rows(spark, ("p", "A", "2024-01-10T10:00:00"), ("p", "A", "2024-01-11T10:00:00"), ("q", "A", "2024-01-10T10:00:00"), ("r", "A", "2024-01-12T10:00:00"))
    spec = ActivitySpec(("A",), "2024-01-10", "2024-01-12", periods=2)
    got = {(r["cohort"], r["offset"]): (r["cohort_size"], r["n_persons"], r["rate"]) for r in retention.retention(e, spec).collect()}
    assert got == {("2024-01-10", 0): (2, 2, 100.0), ("2024-01-10", 1): (2, 1, 50.0), ("2024-01-11", 0): (1, 1, 100.0), ("2024-01-12", 0): (1, 1, 100.0)}
    other = ActivitySpec(("A",), "2024-01-12", "2024-01-12", periods=2, return_names=("B",))
    assert [tuple(r) for r in retention.retention(e, other).collect()] == [("2024-01-12", 1, None, 0, 0.0)]
    average = {r["offset"]: r["rate"] for r in retention.retention_average(e, spec, "2024-01-13").collect()}
    assert average == {0: 100.0, 1: 33.33, 2: 0.0}


def test_lifecycle_statuses(spark):
    e = rows(spark, *[("p", "A", f"2024-01-{d}T10:00:00") for d in (10, 11, 13)], ("q", "A", "2024-01-05T10:00:00"), ("q", "A", "2024-01-11T10:00:00"))
    got = {(r["bucket"], r["status"]): r["n_persons"] for r in retention.lifecycle(e, ActivitySpec(("A",), "2024-01-10", "2024-01-13")).collect()}
    assert got == {("2024-01-10", "new"): 1, ("2024-01-11", "returning"): 1, ("2024-01-11", "resurrecting"): 1, ("2024-01-12", "dormant"): -2, ("2024-01-13", "resurrecting"): 1}


def test_lifecycle_over_a_clock_change(spark):
    e = rows(spark, *[("p", "A", f"2024-03-{d}T16:00:00") for d in ("09", "10", "11")])
    got = {(r["bucket"], r["status"]) for r in retention.lifecycle(e, ActivitySpec(("A",), "2024-03-10", "2024-03-11", tz="America/New_York")).collect()}
    assert got == {("2024-03-10", "returning"), ("2024-03-11", "returning")}


def test_stickiness_by_local_day(spark):
    e = rows(spark, ("p", "A", "2024-01-10T20:59:00"), ("p", "A", "2024-01-10T21:01:00"))
    spec = dict(names=("A",), date_from="2024-01-10", date_to="2024-01-11")
    assert [r["n_active"] for r in retention.stickiness(e, ActivitySpec(**spec)).collect()] == [1]
    got = retention.stickiness(e, ActivitySpec(**spec, tz="Europe/Moscow")).collect()
    assert [tuple(r) for r in got] == [(2, 1, 100.0, 2)]


def test_paths_compact_before_the_limit(spark):
    e = rows(spark, *sequence(spark, "p", ["A"] * 9 + ["B", "C", "D"]))
    spec = paths.PathSpec("2024-01-10", "2024-01-10", step_limit=3)
    assert paths.top_paths(e, spec).first()["path"] == "A > B > C"
    assert {(r["step"], r["source"], r["target"]) for r in paths.transitions(e, spec).collect()} == {(1, "A", "B"), (2, "B", "C")}
    to = paths.PathSpec("2024-01-10", "2024-01-10", start_event="B", end_event="D", step_limit=9)
    assert paths.top_paths(e, to).first()["path"] == "B > C"
    assert paths.top_paths(e, paths.PathSpec("2024-01-10", "2024-01-10", end_event="Z")).collect() == []


def test_sessions_and_bounces(spark):
    e = rows(spark, ("p", "view", 0), ("q", "view", 0), ("q", "view", 1), ("r", "click", 0))
    got = web.kpis(web.sessions(e, "2024-01-10", "2024-01-10")).first()
    assert (got["visitors"], got["pageviews"], got["n_sessions"], got["avg_seconds"], got["bounce_rate"]) == (2, 3, 2, 30.0, 50.0)
    none = web.kpis(web.sessions(e, "2023-01-10", "2023-01-10")).first()
    assert (none["visitors"], none["pageviews"], none["bounce_rate"]) == (0, 0, 0.0)


def cohort(spark, e, node, **more):
    members = spark.createDataFrame([("s", "p")], "cohort_id string, person_id string")
    c = cohorts.Context(e, cohorts.Bounds(datetime(2024, 1, 11), **more), members)
    return sorted(r["person_id"] for r in cohorts.persons(c, node).collect())


def test_sequence_cohort(spark):
    node = {"type": "event_sequence", "steps": [{"event_name": "A"}, {"event_name": "B"}], "window_days": 1, "time_window_days": 5}
    e = rows(spark, ("p", "A", 0), ("p", "B", 0.05 / 60), ("q", "B", 0), ("q", "A", 1), ("r", "X", 0))
    assert cohort(spark, e, node) == ["p"]
    absent = {**node, "type": "not_performed_event_sequence"}
    assert cohort(spark, e, absent) == ["q"]
    assert cohort(spark, e, absent, date_from="2024-01-01") == ["q", "r"]


def test_cohort_trees_follow_the_tree(spark):
    e = rows(spark, ("p", "A", 0), ("q", "B", 0), ("r", "A", 0), ("r", "B", 1))
    has = lambda n: {"type": "event", "event_name": n, "count_operator": "gte", "count": 1, "time_window_days": 3}
    node = {"type": "AND", "values": [{"type": "OR", "values": [has("A"), has("B")]}, has("B")]}
    assert cohort(spark, e, node) == ["q", "r"]
    assert cohort(spark, e, {"type": "OR", "values": []}) == []
    assert cohort(spark, e, {"type": "cohort", "cohort_id": "s", "negated": True}) == ["q", "r"]
    with pytest.raises(ValueError):
        cohorts.validate({"type": "OR", "values": [has("A")] * 51})
    with pytest.raises(ValueError):
        cohort(spark, e, {"type": "stopped_performing", "event_name": "A", "recent_window_days": 9, "historical_window_days": 9})


def test_order_of_computation():
    ref = lambda x: {"type": "cohort", "cohort_id": x}
    found, circles = cohorts.levels({"a": ref("b"), "b": ref("zzz"), "c": {"type": "AND", "values": [ref("a"), ref("b")]}, "d": ref("e"), "e": ref("d")})
    assert found == [["b"], ["a"], ["c"]] and circles == ["d", "e"]


def test_stale_cohorts_wait_after_errors(spark):
    at = datetime(2024, 1, 10, 12)
    table = [("new", False, 0, None, None), ("fresh", False, 0, at - timedelta(minutes=5), None), ("old", False, 0, at - timedelta(minutes=20), None), ("fixed", True, 0, None, None), ("bad", False, 1, None, at - timedelta(minutes=30)), ("again", False, 1, None, at - timedelta(minutes=61)), ("dead", False, 20, None, at - timedelta(days=99))]
    df = spark.createDataFrame(table, "cohort_id string, is_static boolean, errors_calculating int, computed_at timestamp_ntz, last_error_at timestamp_ntz")
    assert sorted(r[0] for r in cohorts.stale(df, "2024-01-10 12:00:00").collect()) == ["again", "new", "old"]


def test_member_import_by_email_and_id(spark):
    people = spark.createDataFrame([("p", '{"email": "Ann@X.org"}')], "person_id string, properties string")
    ids = spark.createDataFrame([("p", "d1"), ("q", "d2")], "person_id string, distinct_id string")
    up = spark.createDataFrame([(" ann@x.ORG ",), ("",), (None,)], "id string")
    assert [tuple(r) for r in cohorts.import_members(up, "email", "c", ids, people).collect()] == [("c", "p")]
    up = spark.createDataFrame([("d2",), ("zz",)], "id string")
    assert [tuple(r) for r in cohorts.import_members(up, "distinct_id", "c", ids, people).collect()] == [("c", "q")]


def test_value_types(spark):
    from pyspark.sql import functions as F

    cases = [("k", "5", "BIGINT", "Numeric"), ("utm_source", "5", "BIGINT", "String"), ("ok", "true", "BOOLEAN", "Boolean"), ("created_at", "2024-01-01", "STRING", "DateTime"), ("x", "12.5", "STRING", "Numeric"), ("x", "abc", "STRING", "String"), ("x", None, "VOID", None), ("x", '{"a":1}', "OBJECT<a: BIGINT>", None)]
    df = spark.createDataFrame([(c[0], c[1], c[2]) for c in cases], "name string, text string, kind string")
    got = [r[0] for r in df.select(drilldown.value_type(F.col("name"), F.col("text"), F.col("kind"))).collect()]
    assert got == [c[3] for c in cases]


def test_equal_times_are_one_bin(spark):
    times = spark.createDataFrame([("p", 5), ("q", 5)], "person_id string, seconds long")
    assert [tuple(r) for r in adhoc.equal_bins(times).collect()] == [(0, 2)]
    assert adhoc.equal_bins(times.where("false")).collect() == []
