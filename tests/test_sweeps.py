"""The one-pass folds of funnels and the paths' windows against plain definitions over all pairs of events, on random histories."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F
from test_insights import ABC, DAY, rows

from eventloom.functions.values import history
from eventloom.operators import cohorts, funnel, paths
from eventloom.operators.funnel import Exclusion, FunnelSpec, Step

WINDOW = 10 * 60_000


def histories(n=300, names="ABCX", seed=3):
    """Random events of n persons, many at equal times."""
    r = random.Random(seed)
    return {f"p{k}": [(r.choice(names), r.randint(0, 25)) for _ in range(r.randint(1, 9))] for k in range(n)}


def frame(spark, people):
    return rows(spark, *[(p, name, minute) for p, events in people.items() for name, minute in events])


def covered(events, at):
    return len({n for n, m in events if n in "ABC" and at <= m * 60_000 <= at + WINDOW})


def test_unordered_sweep_is_the_best_window(spark):
    people = histories()
    spec = FunnelSpec(ABC, mode="unordered", window=10, window_unit="minute", **DAY)
    base = 1704873600000  # 2024-01-10 08:00
    got = {r["person_id"]: (r["max_step"], r["anchor"] - base if r["anchor"] is not None else None) for r in funnel.per_person(frame(spark, people), spec).collect()}
    want = {}
    for p, events in people.items():
        if any(n == "A" for n, _ in events):
            own = [(n, m * 60_000) for n, m in events if n in "ABC"]
            anchors = [max((m for n, m in own if n == step and covered(events, m) == 3), default=None) for step in "ABC"]
            want[p] = max(covered(events, m) for _, m in own), next((a for a in anchors if a is not None), None)
    assert got == want and {w[0] for w in want.values()} == {1, 2, 3}


@pytest.mark.parametrize("mode", ["ordered", "unordered"])
def test_exclusions_are_those_of_all_pairs(spark, mode):
    people = histories(seed=5)
    spec = FunnelSpec(ABC[:2], mode=mode, window=10, window_unit="minute", exclusions=(Exclusion("X", 0, 1), Exclusion("C", 0, 1)), **DAY)
    before = {r["person_id"]: r["anchor"] for r in funnel.per_person(frame(spark, people), spec, exclude=False).collect()}
    got = {r["person_id"] for r in funnel.per_person(frame(spark, people), spec).collect()}
    base = 1704873600000

    def banned(p, name):
        begins = [m * 60_000 for n, m in people[p] if n == "A"]
        if mode == "unordered":
            if before[p] is None:
                return False
            begins = [f for f in begins if before[p] - base <= f <= before[p] - base + WINDOW]
        pairs = [(f, m * 60_000) for f in begins for n, m in people[p] if n == "B" and f < m * 60_000 <= f + WINDOW]
        bad = [any(n == name and f < m * 60_000 < t for n, m in people[p]) for f, t in pairs]
        return any(bad) and all(bad)

    want = {p for p in before if not banned(p, "X") and not banned(p, "C")}
    assert got == want and len(want) < len(before)


def test_paths_keep_the_first_names_without_repeats(spark):
    people = histories(seed=8)
    got = {r["person_id"]: r["path"] for r in paths.person_paths(frame(spark, people), paths.PathSpec("2024-01-10", "2024-01-10", step_limit=4)).collect()}
    event_ids = iter(range(10_000))
    want = {}
    for p, events in people.items():
        order = sorted((m, next(event_ids), n) for n, m in events)
        path = [n for n, _ in groupby(n for _, _, n in order)][:4]
        if len(path) > 1:
            want[p] = path
    assert got == want


def test_strict_and_ordered_funnels_step_by_step(spark):
    people = histories(seed=13)
    ordered = {r["person_id"]: r["max_step"] for r in funnel.per_person(frame(spark, people), FunnelSpec(ABC, window=10, window_unit="minute", **DAY)).collect()}
    ids = iter(range(10_000))
    for p, events in people.items():
        start = [None] * 3
        for m, _, n in sorted((m * 60_000, next(ids), n) for n, m in events):
            k = "ABC".find(n)
            if k == 0:
                start[0] = m
            elif k > 0 and start[k - 1] is not None and m <= start[k - 1] + WINDOW:
                start[k] = start[k - 1]
        level = sum(s is not None for s in start)
        assert ordered.get(p, 0) == level


def test_history_sorts_by_its_fields(spark):
    df = spark.createDataFrame([("p", 2, 1, "b"), ("p", 1, 9, "a"), ("p", 2, 0, "c")], "person_id string, ms long, event_id long, name string")
    assert [e["name"] for e in df.groupBy("person_id").agg(history("ms", "event_id", "name").alias("h")).first()["h"]] == ["a", "c", "b"]


@pytest.mark.parametrize("change", [{"steps": ABC[:1]}, {"steps": ABC * 4}, {"sampling": 0.001}, {"sampling": 1.5}, {"breakdown_limit": 1}, {"breakdown_limit": 26}, {"window": 91}])
def test_limits_of_funnels(change):
    with pytest.raises(ValueError):
        FunnelSpec(**({"steps": (Step(("A",)), Step(("B",)))} | DAY | change)).validate()


def test_limits_of_cohorts(spark):
    leaf = {"type": "event", "event_name": "A", "count_operator": "gte", "count": 1, "time_window_days": 30}
    assert cohorts.validate({"type": "AND", "values": [leaf] * 20}) == 20
    for bad in ({"type": "AND", "values": [leaf] * 21}, {**leaf, "time_window_days": 366}, {**leaf, "time_window_days": 0}):
        with pytest.raises(ValueError):
            cohorts.validate(bad)
    with pytest.raises(ValueError):
        cohorts.restrict(spark.range(1), None, [leaf] * 21)
    node = {"type": "OR", "values": [{"type": "cohort", "cohort_id": "a"}, {"type": "AND", "values": [{"type": "cohort", "cohort_id": "b", "negated": True}, leaf]}]}
    marked = cohorts.stamped(node, {"b"})
    assert marked["values"][0]["is_static"] is False and marked["values"][1]["values"][0] == {"type": "cohort", "cohort_id": "b", "negated": True, "is_static": True}


def test_incomplete_periods_and_empty_aggregate_steps(spark):
    df = spark.createDataFrame([("2024-01-09",), ("2024-01-10",), ("2024-01-11",)], "bucket string")
    assert [r["incomplete"] for r in funnel.incomplete(df, "2024-01-10 12:00:00", "day").orderBy("bucket").collect()] == [False, True, True]
    none = spark.createDataFrame([], "breakdown string, step int, n_persons long")
    assert [(r["step"], r["n_persons"], r["conversion_rate"]) for r in funnel.aggregate_steps(none, 3).orderBy(F.col("step")).collect()] == [(1, 0, 0.0), (2, 0, 0.0), (3, 0, 0.0)]
