"""The driver's contract, plans, ingest and files."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from eventloom import catalog
from eventloom.operators import ingest
from eventloom.plans import fixtures
from eventloom.sources import files, model
from eventloom.streaming import ingest as stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(value):
    return f"{float(value):.9g}" if isinstance(value, int | float) and not isinstance(value, bool) or type(value).__name__ == "Decimal" else str(value)


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.queries()[name](spark, SF)
    found = con.execute(catalog.oracles()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted([plain(r[columns.index(c)]) for c in sorted(columns)] for r in found.fetchall())
    assert sorted([plain(r[c]) for c in sorted(columns)] for r in df.collect()) == want


def test_filters_reach_the_scan_and_no_python_runs(spark):
    queries = catalog.queries()
    plan = queries["trend_total_day"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), IsNotNull(event_type), GreaterThanOrEqual(ts" in plan and "FileScan parquet [ts#" in plan
    for name in ("funnel_ordered", "funnel_strict", "path_transitions", "cohort_sequence", "property_definitions", "lifecycle_day"):
        plan = queries[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Cartesian" not in plan


def test_override_of_the_last_version_wins(spark):
    rows = spark.createDataFrame([("p1", "d", "x", 1), ("p1", "d", "y", 3), ("p1", "d", "z", 2)], "project_id string, distinct_id string, person_id string, version long")
    e = spark.createDataFrame([("p1", "d", "own"), ("p1", "e", "own2")], "project_id string, distinct_id string, person_id string")
    got = {(r["distinct_id"], r["person_id"], r["raw_person_id"]) for r in model.resolve_persons(e, rows).collect()}
    assert got == {("d", "y", "own"), ("e", "own2", "own2")}


def test_validation_and_skew(spark):
    rows = [("p", "ok", "u1", "{}"), ("p", "", "u1", "{}"), ("p", "ok", "Guest", "{}"), (None, "ok", "u", None), ("p", "ok", "u", json.dumps({f"k{k}": 1 for k in range(201)})), ("p", "n" * 256, "u", "{}")]
    df = spark.createDataFrame(rows, "project_id string, event_name string, distinct_id string, properties string")
    assert [r["problem"] for r in ingest.validated(df).collect()] == [None, "invalid_event", "illegal_distinct_id", "invalid_event", "invalid_properties", "invalid_event"]
    times = [(10_000, 9_000, 8_500, 9_500), (10_000, None, 1, 10_000), (10_000, 100, 200, 10_000), (10**9, 10**9, 0, 10**9)]
    df = spark.createDataFrame(times, "server long, sent long, client long, want long")
    assert df.where(ingest.corrected_ms(F.col("server"), F.col("sent"), F.col("client")) != F.col("want")).count() == 0


def test_person_ids_are_stable_uuids(spark):
    df = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "a")], "project string, id string")
    got = [r[0] for r in df.select(ingest.person_id(F.col("project"), F.col("id"))).collect()]
    assert len(set(got)) == 3
    import uuid

    assert all(uuid.UUID(x).version == 5 and uuid.UUID(x).variant == uuid.RFC_4122 for x in got)


def test_identify_gives_overrides(spark):
    df = spark.createDataFrame([("p", "$identify", "u", "anon", "P", 5), ("p", "$identify", "v", "anon", "Q", 9), ("p", "view", "u", "x", "P", 6), ("p", "$identify", "u", "u", "P", 7)], "project_id string, event_name string, distinct_id string, anonymous_id string, person_id string, ms long")
    assert [tuple(r) for r in ingest.merges(df).collect()] == [("p", "anon", "Q", 9)]


def test_property_changes(spark):
    rows = [("p", "a", "1", "set", 1, 1), ("p", "a", "2", "set_once", 2, 2), ("p", "b", "3", "set_once", 1, 3), ("p", "b", "4", "set_once", 2, 4), ("p", "c", "5", "set", 1, 5), ("p", "c", None, "unset", 2, 6)]
    df = spark.createDataFrame(rows, "person_id string, name string, value string, kind string, ms long, event_id long")
    assert {(r["name"], r["value"]) for r in ingest.person_properties(df).collect()} == {("a", "1"), ("b", "3")}


def test_country_blocks_wider_than_a_join_key(spark):
    ranges = spark.createDataFrame([(0, 3 * 65536 - 1, "aa"), (3 * 65536, 4 * 65536, "bb")], "low long, high long, country string")
    rows = spark.createDataFrame([("0.2.0.1",), ("0.3.0.0",), ("9.9.9.9",), ("::1",), (None,)], "ip string")
    assert [r["country"] for r in ingest.with_country(rows, ranges).orderBy("ip").collect()] == ["", "aa", "bb", "", ""]


def test_stream_drops_repeats_and_keeps_warnings(spark, tmp_path):
    lines = [{"project_id": "p", "event_id": "1", "event": "$pageview", "distinct_id": "u", "timestamp": "2024-01-01T00:00:00Z"}] * 2
    lines.append({"project_id": "p", "event_id": "2", "event": "buy", "distinct_id": "null"})
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    for _ in range(2):  # a second run finds nothing new
        stream.start(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", imported=True).awaitTermination()
    events = spark.read.parquet(f"{tmp_path}/out/events").collect()
    assert [(r["event_id"], r["event_type"], r["ms"]) for r in events] == [("1", "pageview", 1704067200000)]
    assert sorted(r["type"] for r in spark.read.parquet(f"{tmp_path}/out/warnings").collect()) == ["illegal_distinct_id", "invalid_event"]


def test_stream_of_several_batches_loses_no_event(spark, tmp_path):
    def line(event_id, time, **more):
        return {"project_id": "p", "event_id": event_id, "event": "view", "distinct_id": "u", "timestamp": time} | more

    bad = line("1", None, distinct_id="null")
    batches = [
        [line("0", "2024-01-31T00:00:00Z"), line("now", None), line(None, "2024-01-31T00:00:00Z"), line(None, "2024-01-31T00:00:00Z"), bad],
        [line("1", "2024-01-01T00:00:00Z"), line("1", "2024-01-01T00:00:00Z"), line(None, "2024-01-01T00:00:00Z"), bad, bad],
        [line("2", "2023-12-01T00:00:00Z"), line("0", "2024-01-31T00:00:00Z"), line("1", "2024-01-01T00:00:00Z")],
    ]
    (tmp_path / "in").mkdir()
    for k, lines in enumerate(batches):
        file = tmp_path / f"in/{k}.json"
        file.write_text("\n".join(map(json.dumps, lines)))
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))  # the stream reads older files first
    stream.start(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", files=1).awaitTermination()
    events = spark.read.parquet(f"{tmp_path}/out/events").collect()
    ids = {r["event_id"] for r in events}
    assert len({r["batch"] for r in events}) == 3 and len(events) == len(ids) == 7
    assert {"0", "1", "2", "now"} < ids and None not in ids
    assert spark.read.parquet(f"{tmp_path}/out/warnings").count() == 3


def test_member_csv_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("E-Mail,x\na@b.c,1\n")
    rows, kind = files.read_member_csv(spark, f"{tmp_path}/a.csv")
    assert kind == "email" and [r["id"] for r in rows.collect()] == ["a@b.c"]
    (tmp_path / "b.csv").write_text("name\nx\n")
    with pytest.raises(ValueError):
        files.read_member_csv(spark, f"{tmp_path}/b.csv")


def test_events_by_month_prune_and_expire(spark, tmp_path):
    files.write_events(fixtures.raw_events(spark, SF), f"{tmp_path}/t", "overwrite")
    back = spark.read.parquet(f"{tmp_path}/t")
    assert back.count() == spark.read.parquet(f"{SF}/events.parquet").count()
    assert back.where("event_month = '2023-12'").count() == 0
    assert files.drop_expired(back, "2025-01-10 00:00:00").count() < back.count()
    files.delete_where(spark, f"{tmp_path}/t", f"{tmp_path}/u", F.col("event_name") == "error")
    assert spark.read.parquet(f"{tmp_path}/u").where("event_name = 'error'").count() == 0


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", None)], "x string, y int")
    files.export_markdown(df, f"{tmp_path}/m")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/m").collect()] in (["| x | y |", "| --- | --- |", "| a\\|b |  |"], ["| a\\|b |  |", "| x | y |", "| --- | --- |"])
    assert sorted(f for f in os.listdir(f"{tmp_path}/m") if f[0] not in "._")[0] == "header-00000.txt"
    files.export_csv(df, f"{tmp_path}/c")
    assert spark.read.csv(f"{tmp_path}/c", header=True).columns == ["x", "y"]


def test_import_without_timestamp_fails(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"project_id": "p", "event": "x", "distinct_id": "u"}\n')
    with pytest.raises(Exception, match="timestamp"):
        files.read_import(spark, f"{tmp_path}/a.json").collect()


def test_batch_files_are_read_with_their_broken_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"project_id": "p", "event": "x", "distinct_id": "u"}\nbroken\n')
    rows = files.read_batch(spark, f"{tmp_path}/a.json").collect()
    assert sorted((r["event"] or "", r["_corrupt"] or "") for r in rows) == [("", "broken"), ("x", "")]


def test_identify_moves_later_events_and_changes_are_kept(spark, tmp_path):
    def run(name, lines):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{name}.json").write_text("\n".join(map(json.dumps, lines)))
        stream.start(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()

    event = lambda n, name, d, **more: {"project_id": "p", "event_id": n, "event": name, "distinct_id": d} | more
    run("a", [event("1", "view", "anon"), event("2", "$identify", "user", anonymous_id="anon", user_properties='{"plan": "pro", "$set_once": {"first": 1}}')])
    run("b", [event("3", "view", "anon", user_agent="Firefox/1 Windows", browser="Own"), event("4", "view", "user")])
    events = {r["event_id"]: r for r in spark.read.parquet(f"{tmp_path}/out/events").collect()}
    assert events["1"]["person_id"] != events["2"]["person_id"] == events["3"]["person_id"] == events["4"]["person_id"]
    assert (events["3"]["browser"], events["3"]["os"]) == ("Own", "Windows")
    overrides = spark.read.parquet(f"{tmp_path}/out/overrides")
    now = {r["event_id"]: r["person_id"] for r in model.resolve_persons(spark.read.parquet(f"{tmp_path}/out/events"), overrides).collect()}
    assert len(set(now.values())) == 1
    changes = {(r["person_id"], r["name"], r["value"], r["kind"]) for r in spark.read.parquet(f"{tmp_path}/out/changes").collect()}
    assert changes == {(events["2"]["person_id"], "plan", "pro", "set"), (events["2"]["person_id"], "first", "1", "set_once")}


def test_minute_counts(spark):
    rows = spark.sql("select 'p' as project_id, timestamp'2024-01-01 00:00:10' + make_interval(0, 0, 0, 0, 0, 0, 25 * id) as time from range(5)")
    assert sorted(r["n"] for r in stream.minute_counts(rows).collect()) == [2, 3]


def test_ids_that_stand_for_nobody(spark):
    ids = [*ingest.BLACKLIST, " NULL ", "[Object object]", "id", "email", "distinct_id", "not_authenticated", "x" * 255, "x" * 256]
    df = spark.createDataFrame([("p", "e", i, "{}", "s" * 129 if i == "id" else "s") for i in ids], "project_id string, event_name string, distinct_id string, properties string, session_id string")
    got = [r[0] for r in df.select(ingest.problem()).collect()]
    assert got == ["illegal_distinct_id"] * 13 + [None] * 5 + ["illegal_distinct_id"]
    assert [r[0] for r in df.select(ingest.problem(("session_id",))).collect()][13] == "invalid_context"


def test_user_properties_are_parsed(spark):
    bags = ['{"a": 1, "$set": {"a": 2, "b": {"c": 3}}, "$browser": "x", "$unset": ["$ip", "d", 5]}', "not json", None, "[]", '{"$set_once": {"$os": 1, "e": null}}', '{"$set": 5, "$unset": "x", "f": true}']
    df = spark.createDataFrame(list(enumerate(bags)), "k int, user_properties string")
    got = {(r["k"], r["name"], r["value"], r["kind"]) for r in ingest.property_changes(df, "k").collect()}
    assert {(0, "a", "1", "set"), (0, "b", '{"c":3}', "set"), (0, "$ip", None, "unset"), (0, "d", None, "unset"), (5, "f", "true", "set")} <= got
    assert not any(name in ("$browser", "$os") for _, name, _, _ in got) and {k for k, *_ in got} <= {0, 4, 5}


def test_screen_dimensions(spark):
    df = spark.createDataFrame([("1024px", 1024), ("0", 0), ("-3", 0), (None, 0), ("x", 0), (" 70000", 70000), ("12.7", 12)], "w string, want long")
    assert df.where(ingest.screen_dimension(F.col("w")) != F.col("want")).count() == 0


ZONES = ["UTC", "America/New_York", "Australia/Lord_Howe"]


@pytest.mark.parametrize("zone", ZONES)
def test_times_do_not_pass_through_the_session_zone(spark, zone):
    """Among them times that the zone's clock change leaves out or has twice."""
    from datetime import datetime, timedelta

    from eventloom.functions import timeutil as T

    times = [datetime(2024, 3, 10, 2, 30), datetime(2024, 3, 10, 6, 59, 59, 999_999), datetime(2024, 11, 3, 1, 30), datetime(2024, 10, 6, 2, 15), datetime(2024, 7, 1), datetime(1969, 12, 31, 23, 0, 0)]
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("select * from values " + ", ".join(f"(timestamp_ntz'{t}')" for t in times) + " as t(ts)")
        rows = df.select(F.col("ts").cast("string").alias("text"), T.millis(F.col("ts")).alias("ms"), *[T.label(T.bucket(F.col("ts"), u), u).alias(u) for u in T.UNITS], T.month(F.col("ts")).alias("m")).collect()
        for t, r in zip(times, rows, strict=True):
            week = t - timedelta(days=t.weekday())
            assert r["ms"] == (t - datetime(1970, 1, 1)) // timedelta(milliseconds=1)
            assert (r["hour"], r["day"], r["week"], r["month"], r["m"]) == (f"{t:%Y-%m-%d %H}:00:00", f"{t:%Y-%m-%d}", f"{week:%Y-%m-%d}", f"{t:%Y-%m}-01", f"{t:%Y-%m}")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


@pytest.mark.parametrize("name", "clock_skew event_definitions funnel_ordered lifecycle_week path_top query_persons rate_limit_buckets retention_recurring_day time_between_events trend_hour trend_month trend_timezone_shift ttc_stats web_timeseries calendar_heatmap cohort_size_history".split())
def test_query_agrees_with_its_sql_in_another_zone(spark, name):
    if name not in catalog.oracles():
        pytest.skip("no such query")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        test_query_agrees_with_its_sql(spark, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_person_events_filter_reaches_the_scan(spark):
    from eventloom.operators import drilldown

    rows = drilldown.person_events(fixtures.raw_events(spark, SF), model.latest_overrides(fixtures.overrides(spark, SF)), "11")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "user_id" in plan and any("cast(user_id" in line and "Filter" in line for line in plan.splitlines())


def test_stored_tables_give_the_model(spark, tmp_path):
    files.write_events(fixtures.raw_events(spark, SF).drop("ms"), f"{tmp_path}/e", "overwrite")
    fixtures.overrides(spark, SF).write.parquet(f"{tmp_path}/o")
    rows = model.stored_events(spark, f"{tmp_path}/e", model.stored_overrides(spark, f"{tmp_path}/o"))
    want = fixtures.events(spark, SF)
    pick = lambda df: sorted(map(tuple, df.select("event_id", "ms", "person_id", "raw_person_id").collect()))
    assert pick(rows) == pick(want)
    assert len([f for f in (tmp_path / "e").rglob("*.parquet")]) >= 1


def test_shared_folder_is_asked_for_on_a_cluster(spark, monkeypatch):
    class Far:
        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"
            getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

    with pytest.raises(RuntimeError):
        fixtures.scratch(Far, "x")


@pytest.mark.parametrize("zone", ZONES)
def test_times_are_read_and_written_as_text(spark, zone):
    from eventloom.functions import timeutil as T

    texts = {
        "2024-01-15": "2024-01-15T00:00:00.000Z", "2024-03-10 02:30:00": "2024-03-10T02:30:00.000Z", "2024-01-15T10:00:00Z": "2024-01-15T10:00:00.000Z",
        "2024-01-15T10:00:00.1234+02:00": "2024-01-15T08:00:00.000Z", "2024/1/5 10:00:00": "2024-01-05T10:00:00.000Z", "15/01/2024": "2024-01-15T00:00:00.000Z",
        "15.01.2024 23:59:59": "2024-01-15T23:59:59.000Z", " 1705312800 ": "2024-01-15T10:00:00.000Z", "1705312800250": "2024-01-15T10:00:00.000Z", "Feb 27 2026": "2026-02-27T00:00:00.000Z", "December 3, 2025 10:20:30": "2025-12-03T10:20:30.000Z", "Foo 3 2025": None, "": None, "x": None, "2024-13-45": None, "12": None,
    }
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", T.iso_text(T.read_time(F.col("x"))).alias("iso")).collect()
        assert {r["x"]: r["iso"] for r in rows} == texts
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
