"""The ingest job's state: seen keys, dead letters, merges in time, persons, catalogs, admission; against plain replays."""

import json
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventloom.operators import merges
from eventloom.streaming import admission, catalogs, tables
from eventloom.streaming import ingest as stream
from eventloom.streaming.ingest import Job
from eventloom.streaming.seen import SeenKeys

LEAN = Job(persons=False, catalogs=False, keys=2000, attempts=1)


def event(n, name, d, **more):
    return {"project_id": "p", "event_id": n, "event": name, "distinct_id": d} | more


def send(tmp_path, *files):
    (tmp_path / "in").mkdir(exist_ok=True)
    for lines in files:
        k = len(list((tmp_path / "in").iterdir()))
        path = tmp_path / f"in/{k}.json"
        path.write_text("\n".join(map(json.dumps, lines)))
        os.utime(path, (1_700_000_000 + k, 1_700_000_000 + k))  # the stream reads older files first


def start(spark, tmp_path, job=LEAN):
    stream.start(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", files=1, imported=True, job=job).awaitTermination()
    return f"{tmp_path}/out"


def ids(spark, out):
    return sorted(r["event_id"] for r in spark.read.parquet(f"{out}/events").collect())


# ---- seen keys

def test_no_repeat_passes_while_the_filter_grows(spark, tmp_path):
    keys = lambda a, b: spark.range(a, b).selectExpr("'p' as project_id", "md5(cast(id as string)) as event_id")
    index = SeenKeys(spark, str(tmp_path), capacity=1000)
    for k in range(4):
        rows = keys(max(0, k * 500 - 200), k * 500 + 500)
        fresh = index.fresh(rows.unionByName(rows), k * 1000)
        fresh.write.parquet(f"{tmp_path}/batch{k}")
        assert spark.read.parquet(f"{tmp_path}/batch{k}").count() == 500
        index.add(spark.read.parquet(f"{tmp_path}/batch{k}"), k * 1000)
    _, slots, n = index._filter(1 << 40)
    assert (slots, n) == (2, 2000)
    assert index.repeats(keys(0, 4000), 1 << 40).count() == 2000
    assert index.fresh(keys(1500, 2500), 3000).count() == 1000  # a batch that comes again doesn't see its own keys
    index.forget(3000)
    assert index.fresh(keys(1000, 2500), 1 << 40).count() == 1000


def test_a_new_key_hardly_ever_opens_a_bucket(spark, tmp_path):
    keys = lambda a, b: spark.range(a, b).selectExpr("'p' as project_id", "md5(cast(id as string)) as event_id")
    index, asked = SeenKeys(spark, str(tmp_path), capacity=20_000), []
    index.add(keys(0, 20_000), 0)
    whole = index.stored
    index.stored = lambda buckets, step: (asked.append(buckets), whole(buckets, step))[1]
    assert index.repeats(keys(20_000, 40_000), 1000).count() == 0
    assert len(asked[0]) <= 3


# ---- dead letters

def test_the_stream_goes_on_past_a_dead_batch(spark, tmp_path, monkeypatch):
    send(tmp_path, [event("1", "view", "a")], [event("2", "view", "a"), event("3", "poison", "b")], [event("4", "view", "a"), event("3", "later", "b")])
    whole, calls = stream.write_batch, []

    def broken(batch, out, number, *args, **more):
        calls.append(number)
        whole(batch, out, number, *args, **more)
        if batch.where("event_name = 'poison'").count():
            raise OSError("no space")  # after all was written

    monkeypatch.setattr(stream, "write_batch", broken)
    out = start(spark, tmp_path, Job(persons=False, catalogs=False, keys=2000, attempts=2))
    assert calls == [0, 1, 1, 2] and stream.dead_batches(spark, out) == [1]
    assert ids(spark, out) == ["1", "3", "4"]
    kinds = [r["kind"] for r in tables.log(spark, out).orderBy("at_ms").collect()]
    assert kinds == ["written", "attempt", "attempt", "dead", "written"]
    assert stream.replay(spark, out) == [] and stream.dead_batches(spark, out) == [1]
    monkeypatch.setattr(stream, "write_batch", whole)
    assert stream.replay(spark, out, job=LEAN) == [1] and stream.dead_batches(spark, out) == []
    #: Event 3 came with a later batch in the meantime.
    assert ids(spark, out) == ["1", "2", "3", "4"] and spark.read.parquet(f"{out}/events").where("event_name = 'poison'").count() == 0
    send(tmp_path, [event("2", "view", "a"), event("5", "view", "a")])
    start(spark, tmp_path)
    assert ids(spark, out) == ["1", "2", "3", "4", "5"] and stream.replay(spark, out) == []


def test_replays_rest_after_failures_also_in_another_process(spark, tmp_path, monkeypatch):
    out = f"{tmp_path}/out"
    for k in range(7):
        spark.range(1).write.parquet(f"{out}/dead/batch={k}")
    tried = []

    def broken(batch, out, number, *_):
        tried.append(number)
        raise OSError("no space")

    monkeypatch.setattr(stream, "write_batch", broken)
    assert stream.replay(spark, out, failures=5, rest_ms=1000, now_ms=10_000) == [] and tried == [0, 1, 2, 3, 4]
    assert stream.replay(spark, out, failures=5, rest_ms=1000, now_ms=10_900) == [] and len(tried) == 5
    assert stream.replay(spark, out, failures=5, rest_ms=1000, now_ms=11_000) == [] and tried[5:] == [0]  # one failure more, and it rests again
    monkeypatch.setattr(stream, "write_batch", lambda *_: None)
    assert stream.replay(spark, out, failures=5, rest_ms=1000, now_ms=12_000) == list(range(7))
    assert tables.open_until(spark, out, 5, 1000) == 0


# ---- merges

def replayed(moves, people):
    """Owners after each move, and properties in the end."""
    owner, bags, states = {p: p for p in people}, {p: dict(b) for p, b in people.items()}, []
    for a, u, at in sorted(moves, key=lambda m: m[2]):
        x, y = owner[a], owner[u]
        if x != y:
            owner = {k: y if v == x else v for k, v in owner.items()}
            for name, value in bags.pop(x).items():
                bags[y].setdefault(name, value)
        states.append((at, owner))
    return states, owner, bags


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7)), max_size=20))
def test_forest_is_a_replay(pairs):
    moves = [(f"p{a}", f"p{u}", (k, "")) for k, (a, u) in enumerate(pairs) if a != u]
    states, owner, _ = replayed(moves, {f"p{k}": {} for k in range(8)})
    forest = merges.Forest()
    for a, u, at in moves:
        forest.merge(a, u, at)
    for p in owner:
        way = forest.way(p)
        assert (way[-1][2] if way else p) == owner[p]
        for at, then in states:
            assert next((w[2] for w in reversed(way) if w[:2] <= at), p) == then[p]


@pytest.mark.parametrize("one_group", [0, 10_000])
def test_merges_chains_and_circles(spark, one_group):
    rng = random.Random(one_group)
    people = {f"p{k}": {rng.choice("abc"): f"v{k}"} for k in range(150)}
    moves = [(f"p{rng.randrange(150)}", f"p{rng.randrange(150)}", (rng.randrange(40), f"{k:03d}")) for k in range(110)]
    moves += [("p1", "p2", (50, "x")), ("p2", "p3", (51, "x")), ("p3", "p1", (52, "x")), ("p1", "p4", (53, "x")), ("p1", "p2", (54, "x"))]
    states, owner, bags = replayed([m for m in moves if m[0] != m[1]], people)
    frame = spark.createDataFrame([(a, u, *at) for a, u, at in moves], "anonymous string, user string, ms long, event_id string")
    ways = merges.merge_ways(frame, one_group).persist()
    ids = spark.createDataFrame([(p, p) for p in people], "distinct_id string, person_id string")
    assert {r["distinct_id"]: r["person_id"] for r in merges.persons_now(ids, ways).collect()} == owner
    events = [(f"p{rng.randrange(150)}", rng.randrange(-1, 56), rng.choice(["000", "055", "x", "z"])) for _ in range(400)]
    at = merges.persons_at(spark.createDataFrame([(p, *e, p) for p, *e in events], "distinct_id string, ms long, event_id string, person_id string"), ways).collect()
    for r in at:
        assert r["person_id"] == next((o[r["distinct_id"]] for t, o in reversed(states) if t <= (r["ms"], r["event_id"])), r["distinct_id"])
    got = merges.merged_people(spark.createDataFrame([(p, *x) for p, b in people.items() for x in b.items()], "person_id string, name string, value string"), ways)
    assert {tuple(r) for r in got.collect()} == {(p, *x) for p, b in bags.items() for x in b.items()}


def test_a_person_takes_all_its_ids_along(spark, tmp_path):
    """a goes to b, then in a later batch a (by then b's) to c: b's own events are c's too, now and from then on."""
    t = lambda m: f"2024-01-10T10:{m:02d}:00Z"
    send(tmp_path, [event("1", "view", "a", timestamp=t(1)), event("2", "$identify", "b", anonymous_id="a", timestamp=t(2), user_properties='{"plan": "pro", "x": 1}'), event("3", "view", "a", timestamp=t(3))])
    send(tmp_path, [event("4", "$identify", "c", anonymous_id="a", timestamp=t(5)), event("5", "view", "b", timestamp=t(4)), event("6", "view", "b", timestamp=t(6)), event("7", "view", "c", timestamp=t(7), user_properties='{"plan": "free"}')])
    out = start(spark, tmp_path, Job(keys=2000))
    person = {r["event_id"]: r["person_id"] for r in spark.read.parquet(f"{out}/events").collect()}
    a, b, c = person["1"], person["2"], person["4"]
    assert len({a, b, c}) == 3 and [person[k] for k in "3567"] == [b, b, c, c]
    from eventloom.sources import model

    now = model.resolve_persons(spark.read.parquet(f"{out}/events"), spark.read.parquet(f"{out}/overrides"))
    assert {r["person_id"] for r in now.collect()} == {c}
    assert {tuple(r) for r in stream.current_persons(spark, out).collect()} == {(c, "plan", "free"), (c, "x", "1")}


# ---- catalogs

def test_catalog_fixes_types_and_skips_what_is_too_large(spark):
    many = json.dumps({f"k{i}": 1 for i in range(10_001)})
    one = [("p", "a", "1", 5, '{"x": null, "$set": {"age": 4}, "$groups": 1}', "{}"), ("p", "a", "2", 6, '{"x": 3}', '{"$set_once": {"c": "d"}}'), ("p", "big", "3", 7, many, None), ("p", "n" * 201, "4", 8, "{}", "{}"), ("p", "a", "5", 9, json.dumps({"k" * 201: 1}), "not json")]
    two = [("p", "a", "6", 1, '{"x": "text"}', None), ("q", "a", "7", 2, "{}", None)]
    schema = "project_id string, event_name string, event_id string, ms long, properties string, user_properties string"
    known = spark.createDataFrame([], catalogs.CATALOG)
    for rows in (one, two):
        known = catalogs.merged(known, catalogs.definitions_seen(spark.createDataFrame(rows, schema)))
    got = {(r["kind"], r["project_id"], r["event_name"], r["property_name"], r["property_type"]): (r["value_type"], r["last_seen_ms"]) for r in known.collect()}
    assert got == {
        ("event", "p", "a", "", ""): (None, 9), ("event", "q", "a", "", ""): (None, 2),
        ("property", "p", "", "properties.x", "event"): ("Numeric", 6), ("event_property", "p", "a", "properties.x", "event"): (None, 6),
        ("property", "p", "", "user_properties.age", "person"): ("Numeric", 5), ("event_property", "p", "a", "user_properties.age", "person"): (None, 5),
        ("property", "p", "", "user_properties.c", "person"): ("String", 6), ("event_property", "p", "a", "user_properties.c", "person"): (None, 6),
    }


# ---- admission

def test_admission_is_a_replay_of_buckets(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(0, 400_000), f"{k:04d}") for k in range(900)]
    plans = {"a": 90, "b": None}
    counters, got = spark.createDataFrame([], admission.COUNTERS), {}
    for low, high in ((0, 150_000), (150_000, 400_000)):
        part = spark.createDataFrame([r for r in rows if low <= r[1] < high], "project_id string, ms long, event_id string")
        judged, counters = admission.admit(part, counters, spark.createDataFrame(list(plans.items()), admission.PLANS), rate=20)
        got |= {r["event_id"]: r["answer"] for r in judged.collect()}
        counters = spark.createDataFrame(counters.collect(), admission.COUNTERS)
    want = {}
    for project in ("a", "b", None):
        let_in, used = {}, 0
        own = sorted((ms, e) for p, ms, e in rows if p == project)
        for ms, e in own:
            bucket = ms // 10_000
            if sum(let_in.get(bucket - i, 0) for i in range(6)) >= 20:
                want[e] = "rate_limited"
            elif plans.get(project) is not None and used >= plans[project]:
                want[e] = "quota_limited"
            else:
                want[e], used = None, used + 1
                let_in[bucket] = let_in.get(bucket, 0) + 1
    assert got == want and set(want.values()) == {None, "rate_limited", "quota_limited"}
    assert counters.where("kind = 'bucket'").groupBy("project_id").count().agg(F.max("count")).first()[0] <= 6


def test_refused_events_are_put_aside_and_may_come_again(spark, tmp_path):
    lines = [event(str(k), "view", "a", timestamp="2024-01-10T10:00:00Z") for k in range(5)]
    send(tmp_path, lines)
    out = start(spark, tmp_path, Job(persons=False, catalogs=False, keys=2000, rate=3))
    assert ids(spark, out) == ["0", "1", "2"] and [r["answer"] for r in spark.read.parquet(f"{out}/refused").collect()] == ["rate_limited"] * 2
    send(tmp_path, [line | {"timestamp": "2024-01-10T10:05:00Z"} for line in lines])
    start(spark, tmp_path, Job(persons=False, catalogs=False, keys=2000, rate=3))
    assert ids(spark, out) == ["0", "1", "2", "3", "4"]
