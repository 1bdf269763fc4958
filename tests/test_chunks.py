"""Funnels and sequences of persons whose events are cut into chunks equal those of whole arrays."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from test_insights import ABC, DAY, rows

from eventloom.operators import chunks, cohorts, funnel
from eventloom.operators.funnel import Exclusion, FunnelSpec

CUT = {"most_events": 30, "whole_bytes": 0}


@pytest.fixture(scope="module")
def events(spark):
    """Persons with few events and some with up to ninety, at equal times often; more tasks than persons."""
    r = random.Random(11)
    people = [(f"p{k}", r.choice("ABCX" if k % 3 else "AABCXY"), r.randint(0, 400 if k % 4 else 30)) for k in range(40) for _ in range(r.choice([3, 9, 40, 90]))]
    people += [("only x", "X", m) for m in range(60)] + [("no first", "BC"[m % 2], m) for m in range(60)]
    for k in range(6):  # strict ways that end after many first steps, at any place of a chunk
        people += [(f"s{k}", n, m) for m, n in enumerate("A" * (25 + 7 * k) + "BC" + "XA" * 20)]
    frame = rows(spark, *people)
    return frame.withColumn("page_path", F.concat(F.lit("/"), F.col("event_id").cast("string"))).persist()


def spec(mode, **more):
    return FunnelSpec(ABC, mode=mode, window=10, window_unit="minute", **DAY, **more)


@pytest.mark.parametrize("mode", ["ordered", "strict", "unordered"])
@pytest.mark.parametrize("ways", [(), (Exclusion("X", 0, 1), Exclusion("C", 0, 1), Exclusion("A", 1, 2))])
def test_cut_persons_are_as_whole_ones(spark, events, mode, ways):
    more = {"breakdown": "page_path", "exclusions": ways}
    whole, cut = spec(mode, **more), spec(mode, **more, **CUT)
    _, hot, people = funnel._people(events, cut)
    assert hot.select("person_id").distinct().count() > 15 and hot.groupBy("person_id").agg(F.count_distinct("chunk").alias("n")).agg(F.max("n")).first()[0] > 2
    result = lambda s: sorted(map(tuple, funnel.per_person(events, s).collect()))
    assert result(cut) == result(whole) and len(result(whole)) > 3


@pytest.mark.parametrize("mode", ["ordered", "strict", "unordered"])
def test_times_of_cut_persons(spark, events, mode):
    whole, cut = spec(mode), spec(mode, **CUT)
    assert funnel.average_time(events, cut).collect() == funnel.average_time(events, whole).collect()
    for a, b in ((0, 2), (0, 1), (1, 2)):
        got, want = (sorted(map(tuple, funnel.conversion_times(events, s, a, b).collect())) for s in (cut, whole))
        assert got == want and got


def test_sequences_of_cut_persons(spark, events):
    x = {"steps": [{"event_name": n} for n in "ABC"], "window_days": 1}
    seconds = events.withColumn("ms", F.lit(1704873600000) + (F.col("ms") - 1704873600000) * 60 * 5)
    bounds = cohorts.Bounds(datetime(2024, 1, 20))
    found = [sorted(map(tuple, cohorts.completers(cohorts.Context(seconds, bounds, **more), x, bounds.ago(30)).collect())) for more in ({}, CUT)]
    assert found[0] == found[1] and {d for _, d in found[0]} == {True, False}


@pytest.mark.parametrize("size", [150, chunks.MOST_EVENTS])
def test_tasks_are_as_many_as_events_take(spark, events, monkeypatch, size):
    """However many chunks there are: several of them share a range, and ranges are of the size that a task takes."""
    monkeypatch.setattr(chunks, "MOST_EVENTS", size)
    rows = events.select("person_id", "ms", "event_id")
    _, hot = chunks.split(rows, **{"most": 30, "whole_bytes": 0})
    n, ranges = hot.count(), chunks.dealt(hot).rdd.getNumPartitions()
    parts = hot.groupBy("person_id", "chunk").agg(F.count("*").alias("n"), F.min("ms").alias("low"), F.max("ms").alias("high")).collect()
    assert n > 1000 and ranges <= n // size + 2 and len(parts) > n // 30
    assert hot.groupBy("person_id", "ms").agg(F.count_distinct("chunk").alias("n")).agg(F.max("n")).first()[0] == 1
    for person in {r["person_id"] for r in parts}:
        own = sorted((r["chunk"], r["low"], r["high"]) for r in parts if r["person_id"] == person)
        assert all(a[2] < b[1] for a, b in zip(own, own[1:]))


@pytest.mark.parametrize("mode", ["ordered", "strict", "unordered"])
def test_chunks_in_several_ranges(spark, events, monkeypatch, mode):
    monkeypatch.setattr(chunks, "MOST_EVENTS", 150)
    ways = (Exclusion("X", 0, 1), Exclusion("A", 1, 2))
    got, want = (sorted(map(tuple, funnel.per_person(events, spec(mode, exclusions=ways, **more)).collect())) for more in ({"most_events": 20, "whole_bytes": 0}, {}))
    assert got == want and len(got) > 3


def most_tasks(spark, group, ask):
    """The most tasks that a stage of a question has."""
    spark.sparkContext.setJobGroup(group, group)
    ask()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    return max(s.numTasks for s in stages if s is not None)


CUT_FUNNELS = {"strict": {}, "ordered": {"exclusions": (Exclusion("X", 0, 1),)}}


@pytest.mark.parametrize("mode", CUT_FUNNELS)
def test_cut_funnels_have_few_tasks(spark, events, mode):
    """Over a thousand events in some sixty chunks, far less than a task takes."""
    assert most_tasks(spark, f"few tasks, {mode}", lambda: funnel.per_person(events, spec(mode, **CUT_FUNNELS[mode], **CUT)).collect()) <= 8


def test_nobody_is_cut_in_small_tables(spark, events):
    table, hot = chunks.split(spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumnRenamed("user_id", "person_id"))
    assert hot is None and chunks.input_bytes(table) < chunks.WHOLE_BYTES
    assert chunks.split(events, most=10_000, whole_bytes=0)[1] is None
