"""Imports, deletion by partition, cohort tables, exact selection and limits, against plain versions."""

import json
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_insights import ABC, DAY, rows, sequence

from eventloom.functions.selection import exact_percentiles
from eventloom.operators import cohorts, funnel, ingest
from eventloom.sources import files

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]


@pytest.mark.parametrize("kind", ["normal", "ties", "spread", "one", "huge"])
def test_selection_equals_percentiles(spark, kind):
    rng = np.random.default_rng(7)
    values = {
        "normal": rng.normal(size=5000),
        "ties": rng.integers(0, 5, 4000).astype(float),
        "spread": np.concatenate([10.0 ** rng.integers(-300, 300, 3000) * rng.choice([-1, 1], 3000), np.zeros(800)]),
        "one": np.array([3.5]),
        "huge": np.array([-1.7e308, 1.7e308, 0.0, 5e-324, 1e-323] * 300),
    }[kind]
    frame = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    exact = [F.expr(f"percentile(v, {s})") for s in SHARES] + [F.expr(f"percentile_disc({s}) within group (order by v)") for s in SHARES]
    want = list(frame.where("not isnan(v)").agg(*exact).first())
    for parts, few in ((8, 3), (4096, 100)):
        got = exact_percentiles(frame, F.col("v"), SHARES, parts=parts, few=few) + exact_percentiles(frame, F.col("v"), SHARES, discrete=True, parts=parts, few=few)
        assert got == want


def test_selection_of_nothing(spark):
    assert exact_percentiles(spark.createDataFrame([(None,)], "v double"), F.col("v"), [0.5]) == [None]


def event(**more):
    return json.dumps({"project_id": "p", "event": "x", "distinct_id": "u", "timestamp": "2024-01-01T00:00:00Z"} | more)


@pytest.mark.parametrize("bad", ["broken", event(timestamp=None), event(timestamp=" ")])
def test_an_import_with_a_bad_line_leaves_nothing(spark, tmp_path, bad):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join([event()] * 300 + [bad]))
    with pytest.raises(files.ImportRejected) as error:
        files.import_events(spark, f"{tmp_path}/in", f"{tmp_path}/out", "one")
    assert (error.value.bad, error.value.lines) == (1, 301) and not list((tmp_path / "out").glob("*"))
    (tmp_path / "in/a.json").write_text("\n".join([event()] * 300))
    for _ in range(2):
        assert files.import_events(spark, f"{tmp_path}/in", f"{tmp_path}/out", "one") == 300
    assert spark.read.parquet(f"{tmp_path}/out").count() == 300 and [f.name for f in (tmp_path / "out").glob("[!.]*")] == ["import=one"]


def test_a_read_import_fails_whatever_is_read(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join([event(), event(timestamp=None)]))
    for ask in (lambda df: df.count(), lambda df: df.select("event").collect(), lambda df: df.collect()):
        with pytest.raises(Exception, match="no timestamp"):
            ask(files.read_import(spark, f"{tmp_path}/a.json"))


def test_deletion_leaves_other_partitions_as_they_are(spark, tmp_path):
    path = f"{tmp_path}/t"
    frame = spark.range(400).selectExpr("id", "case when id % 5 = 4 then null else concat('m', id % 5) end as event_month", "if(id % 7 = 0, null, id % 7) as x")
    frame.repartition(3).write.partitionBy("event_month").parquet(path)
    before = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    gone = files.delete_in_place(spark, path, F.col("event_month").isin("m1") | (F.col("event_month").isNull() & (F.col("x") == 3)))
    assert gone == [None, "m1"]
    after = {str(f): f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    same = {f for f in before if "m0" in f or "m2" in f or "m3" in f}
    assert same and all(after.get(f) == before[f] for f in same) and not any("m1" in f for f in after)
    want = sorted(r["id"] for r in frame.where("not (coalesce(event_month = 'm1', false) or (event_month is null and coalesce(x = 3, false)))").collect())
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == want
    assert files.delete_in_place(spark, path, F.col("x") == 99) == []


def test_cohort_tables_have_plans_of_one_level(spark, tmp_path):
    frame = rows(spark, *[(f"p{k}", "A", k) for k in range(8)]).persist()
    leaf = {"type": "event", "event_name": "A", "count_operator": "gte", "count": 1, "time_window_days": 30}
    ref = lambda k: {"type": "AND", "values": [{"type": "cohort", "cohort_id": k}, {"type": "cohort", "cohort_id": k}]}
    definitions = {"c0": leaf} | {f"c{k}": ref(f"c{k - 1}") for k in range(1, 11)} | {"x": ref("y"), "y": ref("x")}
    c = cohorts.Context(frame, cohorts.Bounds(datetime(2024, 1, 11)))
    versions = cohorts.refresh(c, definitions, str(tmp_path), 1)
    assert versions == {f"c{k}": 1 for k in range(11)}  # ten levels; circles are left out
    assert cohorts.refreshed(spark, str(tmp_path), versions).groupBy("cohort_id").count().where("count = 8").count() == 11
    versions = cohorts.refresh(c, definitions, str(tmp_path), 2, {"c9"})
    assert {k for k, v in versions.items() if v == 2} == {"c9", "c10"}
    for v in (3, 4):
        versions = cohorts.refresh(c, definitions, str(tmp_path), v, {"c10"})
    assert sorted(f.name for f in (tmp_path / "cohort=c10").iterdir()) == ["version=3", "version=4"]
    assert cohorts.refreshed(spark, str(tmp_path), {}).count() == 0


def test_markdown_cells_have_one_line(spark, tmp_path):
    files.export_markdown(spark.createDataFrame([("a\nb\r\nc|d",)], "x string"), f"{tmp_path}/m")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/m").collect()) == ["| --- |", "| a b c\\|d |", "| x |"]


def test_more_limits(spark):
    keys = lambda n: json.dumps({f"k{i}": 1 for i in range(n)})
    sent = [("x" * 255, keys(200)), ("x" * 256, "{}"), (None, keys(201)), (None, None)]
    df = spark.createDataFrame([("p", "e", "u", "{}", *r) for r in sent], "project_id string, event_name string, distinct_id string, properties string, anonymous_id string, user_properties string")
    assert [r[0] for r in df.select(ingest.problem((), tuple(df.columns))).collect()] == [None, "invalid_event", "invalid_properties", None]
    frame = rows(spark, *sequence(spark, "p", "ABC"))
    members = lambda n: spark.createDataFrame([(f"c{k}", "p") for k in range(n)], "cohort_id string, person_id string")
    assert funnel.funnel_by_cohort(frame, funnel.FunnelSpec(ABC, **DAY), members(10)).count() == 30
    with pytest.raises(ValueError):
        funnel.funnel_by_cohort(frame, funnel.FunnelSpec(ABC, **DAY), members(11))


def test_a_person_with_many_ids_is_joined(spark):
    from eventloom.operators import drilldown

    raw = spark.createDataFrame([(k, "p", f"d{k % 7}", f"q{k % 5}", k) for k in range(70)] + [(99, "p", "d1", None, 1)], "event_id long, project_id string, distinct_id string, person_id string, ts long")
    now = spark.createDataFrame([("p", f"d{k}", "q0" if k < 4 else "q9") for k in range(6)], "project_id string, distinct_id string, person_id string")
    few, many = (sorted(map(str, drilldown.person_events(raw, now, "q0", most_ids=n).collect())) for n in (100, 2))
    assert few == many and len(few) > 20


def test_places_are_those_of_the_smallest_block(spark):
    import ipaddress
    import random

    rng = random.Random(2)
    some = lambda v: ipaddress.ip_address(rng.getrandbits(32 if v == 4 else 128) & ((0x0A0000FF if v == 4 else 0xFD0F << 112) | rng.getrandbits(8)))
    networks = [ipaddress.ip_network((int(some(v)) if v == 4 else some(v), rng.choice([0, 4, 8, 13, 24, 29, 32] if v == 4 else [0, 7, 12, 16, 121, 128])), strict=False) for v in (4, 6) for _ in range(40)]
    addresses = [some(v) for v in (4, 6) for _ in range(200)]
    texts = {str(a): a for a in addresses} | {a.exploded: a for a in addresses} | {"::ffff:" + str(a): a for a in addresses if a.version == 4}
    wrong = ["", "x", "1.2.3", "1.2.3.4.5", "256.1.1.1", "1::2::3", ":::", "1:2:3:4:5:6:7", "12345::", "1:2:3:4:5:6:7:8:9", "g::"]
    frame = spark.createDataFrame([(t, "old") for t in [*texts, *wrong]] + [(None, "old")], "ip string, country string")
    blocks = spark.createDataFrame([(str(n), f"c{k}") for k, n in enumerate(networks)] + [("nonsense", "x"), ("1.2.3.4", "x"), (None, "x")], "network string, country string")
    first = {}
    for k, n in enumerate(networks):
        first[n] = min(first.get(n, f"c{k}"), f"c{k}")

    def place(text):
        hits = [n for n in networks if text in texts and texts[text].version == n.version and texts[text] in n]
        #: An IPv4 address is a mapped IPv6 one, too.
        if text in texts and texts[text].version == 4:
            hits += [n for n in networks if n.version == 6 and ipaddress.ip_address("::ffff:" + str(texts[text])) in n]
        return first[max(hits, key=lambda n: n.prefixlen + (96 if n.version == 4 else 0))] if hits else ""

    got = {r["ip"]: r["country"] for r in ingest.with_place(frame, blocks).collect()}
    assert got == {t: place(t) for t in [*texts, *wrong, None]} and len(set(got.values())) > 5


def test_places_of_many_users_are_those_of_sql(spark, tmp_path):
    """Users whose numbers don't fit into an octet, or a group of an IPv6 address, any more."""
    import duckdb

    from eventloom import catalog

    numbers = "select unnest([0, 1, 2, 3, 255, 256, 257, 258, 511, 512, 513, 5625, 65535, 65536, 65537, 65538, 131072, 131074, 16777217, 4294967298]) as hi"
    duckdb.sql(f"""copy (select row_number() over (order by hi, lo, k) as event_id, timestamp '2024-01-10' as ts, hi * 16 + lo as user_id, 'view' as event_type, 1.0::double as value, '{{"k": 1}}' as props
      from ({numbers}), (select unnest([0, 7, 8, 15]) as lo), (select unnest(range(6)) as k)) to '{tmp_path}/events.parquet' (format parquet)""")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = con.execute("select event_id, country from (" + catalog.oracles()["geo_prefixes"] + ")").fetchall()
    got = [(r["event_id"], r["country"]) for r in catalog.queries()["geo_prefixes"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len({c for _, c in want}) == 7


@pytest.mark.parametrize("kind", sorted(cohorts.PERCENTILES))
def test_percentiles_at_a_limit_are_those_of_sql(spark, tmp_path, kind):
    """Persons of n numbers, low ones and high ones, whose percentile is at the limit of 60 or near it."""
    import duckdb

    spark.range(2, 12).selectExpr("id as n", "explode(sequence(40, 60)) as lo").selectExpr("*", "explode(sequence(60, 85)) as hi").selectExpr(
        "concat_ws('-', n, lo, hi) as person_id", f"explode(transform(sequence(0, n - 1), i -> if(i <= floor((n - 1) * {cohorts.PERCENTILES[kind]}D), lo, hi))) as k"
    ).write.parquet(f"{tmp_path}/rows")
    numbers = spark.read.parquet(f"{tmp_path}/rows").selectExpr("person_id", "'A' as event_name", "timestamp_ntz'2024-01-10' as ts", "format_string('{\"k\": %d}', k) as properties")
    node = {"type": "event", "event_name": "A", "aggregation_type": kind, "aggregation_property": "properties.k", "count_operator": "gte", "count": 60, "time_window_days": 20}
    got = {r["person_id"] for r in cohorts.persons(cohorts.Context(numbers, cohorts.Bounds(datetime(2024, 1, 20))), node).collect()}
    want = duckdb.sql(f"select person_id from '{tmp_path}/rows/*.parquet' group by 1 having quantile_cont(k::double, {cohorts.PERCENTILES[kind]}) >= 60").fetchall()
    assert got == {p for (p,) in want} and 0 < len(got) < 10 * 21 * 26


def test_queries_are_named_without_a_session():
    """Nothing asks Spark for anything while modules are imported."""
    import subprocess
    import sys
    from pathlib import Path

    ask = "import __spark_entry__ as e; assert len(e.queries()) > 200 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", ask], cwd=Path(__file__).resolve().parents[1], check=True)
